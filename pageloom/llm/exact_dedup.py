"""Exact dedup by content-defined chunk recipes.

A text is cut where its own content says so, every chunk becomes a short identifier, and texts are
compared by their ordered lists of identifiers: a long document moves as eight bytes a chunk, and
its characters never move. Cuts come after sentence marks and line ends, at least LEAST characters
on; a stretch of more than MOST characters without such a mark (scripts without them, code, encoded
data) is cut behind every character where the hash of the SPAN characters up to it has its MASK lowest
bits zero. No cut depends on a position, so an edit changes the chunks around it and none further on;
runs of one character have no cut, and a chunk has no greatest length, as chunks are read in place.
Short identifiers are verified: a 64-bit hash counts as identifier of a chunk only while all
chunks that have it share one SHA-256 digest; otherwise the digests under it are numbered.

Only built-in DataFrame functions are used.

Defined results: a null text counts as empty, the empty text has the empty recipe (all empty
texts are one group); of equal texts the row with the largest id stays; rows that repeat an id
are counted each; an empty table gives an empty result; further columns are ignored, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import settle


LEAST, MOST, SPAN, MASK = 512, 4096, 16, 10


def stretches(text: Column, least: int = LEAST) -> Column:
    """The text's pieces up to a sentence mark or line end at least `least` characters on, in order."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{{least - 1},}}?(?:[.!?\n]|\z)|.+"), F.lit(0))


def _short(chunk: Column, bits: int) -> Column:
    h = F.xxhash64(chunk)
    return h if bits == 64 else F.pmod(h, F.lit(1 << bits))


def _ref(chunk: Column, bits: int) -> Column:
    return F.struct(_short(chunk, bits).alias("h"), F.unhex(F.sha2(chunk, 256)).alias("d"))


def _parts(stretch: Column, mask: int) -> Column:
    """A long stretch's chunks between the cuts that its hashes make, as bytes that no text has."""

    def cut(b: Column) -> Column:
        n = (F.octet_length(b) / 4).cast("int")
        # Four bytes a character, so that a window is cut out without a walk through the stretch.
        ends = F.filter(F.sequence(F.lit(SPAN), n), lambda i: F.xxhash64(F.substring(b, (i - SPAN) * 4 + 1, F.lit(4 * SPAN))).bitwiseAND((1 << mask) - 1) == 0)
        bounds = F.array_distinct(F.concat(F.array(F.lit(0)), ends, F.array(n)))

        def between(c: Column) -> Column:
            return F.transform(F.slice(c, F.lit(2), F.size(c)), lambda end, i: F.concat(F.substring(b, F.get(c, i) * 4 + 1, (end - F.get(c, i)) * 4), F.lit(b"\xff")))

        return F.get(F.transform(F.array(bounds), between), 0)

    return F.get(F.transform(F.array(F.encode(stretch, "UTF-32")), cut), 0)


def references(text: Column, least: int = LEAST, most: int = MOST, mask: int = MASK, bits: int = 64) -> Column:
    """array<struct<h, d>>: short identifier and SHA-256 of each chunk, in order; bytes of parts end with 255, so no part passes for a text."""
    whole = lambda s: F.array(_ref(s, bits))
    cut = lambda s: F.transform(_parts(s, mask), lambda c: _ref(c, bits))
    return F.flatten(F.transform(stretches(text, least), lambda s: F.when(F.length(s) > most, cut(s)).otherwise(whole(s))))


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, most: int = MOST, mask: int = MASK, bits: int = 64) -> DataFrame:
    """(id, recipe array<bigint>, text_sha256) of every row; recipes are equal iff texts are.

    bits: width of the short identifiers; fewer than 64 serve tests of the numbering.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("id"), text.alias("t"))
    named = settle(base.select("id", references(F.col("t"), least, most, mask, bits).alias("refs"), F.sha2("t", 256).alias("text_sha256")))
    pairs = named.select(F.explode("refs").alias("r")).select("r.h", "r.d").distinct()
    unsure = settle(pairs.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"))
    if unsure.isEmpty():
        return named.select("id", F.transform("refs", lambda r: r["h"]).alias("recipe"), "text_sha256")
    number = pairs.join(unsure, "h", "left_semi").select("h", "d", F.row_number().over(W.partitionBy("h").orderBy("d")).cast("long").alias("no"))
    rows = named.withColumn("row", F.monotonically_increasing_id())
    rows = settle(rows)
    spread = rows.select("row", F.posexplode("refs").alias("pos", "r")).select("row", "pos", "r.h", "r.d")
    lists = (
        spread.join(number, ["h", "d"], "left")
        .groupBy("row")
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "h", F.coalesce("no", F.lit(0).cast("long")).alias("no")))), lambda x: F.array(x["h"], x["no"])).alias("ids"))
    )
    return rows.join(lists, "row", "left").select("id", F.flatten(F.coalesce("ids", F.array().cast("array<array<bigint>>"))).alias("recipe"), "text_sha256")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, most: int = MOST, mask: int = MASK, bits: int = 64) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) of every row.

    Groups are counted with map-side sums. Only groups of two or more come back to their rows,
    over an exchange that adaptive execution may split, so that one huge group of copies
    doesn't land in one task.
    """
    rows = recipes(docs, id_col, text_col, least, most, mask, bits)
    groups = settle(rows.groupBy("recipe").agg(F.max("id").alias("top"), F.count("*").alias("n")).where("n > 1"))
    return rows.join(groups, "recipe", "left").select(
        "id",
        F.coalesce("top", "id").alias("keep_id"),
        F.coalesce("n", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce(F.col("id") == F.coalesce("top", "id"), F.lit(False)).alias("kept"),
        "text_sha256",
    )


def query(spark, sf_dir: str) -> DataFrame:
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")


SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
