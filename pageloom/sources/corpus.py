"""Tables derived from a page corpus: codepoints of pages, segments, glyphs, conditions, patches.

One row of documents is a page view; a codepoint counts once a page. The corpus holds no fonts, so
fonts are stood in for by rules: a glyph for each codepoint in order, bytes by glyph number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

INIT_MAX = 32  # codepoints up to here are in the initial font
BLOCK = 8  # codepoints of a segment
OVERHEAD = 75  # bytes a request costs
RATIO = 0.5  # compressed size over raw size


def codepoints(text: Column) -> Column:
    """The distinct codepoints of a text, sorted, as array<int>."""
    return F.array_sort(F.transform(F.filter(F.array_distinct(F.split(text, "")), lambda c: c != ""), lambda c: F.ascii(c)))


def pages(spark, sf_dir: str) -> DataFrame:
    """(page, dataset, cps) of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select(F.col("doc_id").alias("page"), F.col("lang").alias("dataset"), codepoints(F.col("text")).alias("cps"))


def page_codepoints(pages: DataFrame) -> DataFrame:
    """(page, dataset, cp); distinct within a page already, so nothing is shuffled."""
    # Explode would infer a filter on cps, below it, and make cps of the text a second time for it.
    return pages.select("page", "dataset", F.explode_outer("cps").alias("cp")).where("cp is not null")


def font(pages: DataFrame) -> DataFrame:
    """(cp, gid): the nominal map, glyphs numbered by codepoint. One row a codepoint of the corpus (Unicode bounds it)."""
    return number(page_codepoints(pages).select("cp"))


def number(seen: DataFrame) -> DataFrame:
    """(cp, gid) of seen(cp), where codepoints may repeat."""
    return seen.distinct().select("cp", F.row_number().over(W.orderBy("cp")).alias("gid"))


def segments(font: DataFrame) -> DataFrame:
    """(segment_id, cp, gid): blocks of codepoints in order, outside the initial font."""
    rest = font.where(F.col("cp") > INIT_MAX)
    number = F.row_number().over(W.orderBy("cp")) - 1
    return rest.select(F.floor(number / BLOCK).cast("int").alias("segment_id"), "cp", "gid")


def glyph_bytes(gid: Column) -> Column:
    return (40 + (gid * 37) % 200).cast("long")


def conditions(segments: DataFrame) -> DataFrame:
    """(condition_id, groups): one for each segment alone, either of two neighbours (even first), both of two at distance two (first divisible by three)."""
    ids = segments.select("segment_id").distinct()
    top = ids.agg(F.max("segment_id").alias("top"))
    s = F.col("segment_id")
    one = ids.select(s.alias("condition_id"), F.array(F.array(s)).alias("groups"))
    both = ids.join(F.broadcast(top)).where(s + 1 <= F.col("top")).where(s % 2 == 0).select((1000 + s).alias("condition_id"), F.array(F.array(s, s + 1)).alias("groups"))
    far = ids.join(F.broadcast(top)).where(s + 2 <= F.col("top")).where(s % 3 == 0).select((2000 + s).alias("condition_id"), F.array(F.array(s), F.array(s + 2)).alias("groups"))
    return one.unionByName(both).unionByName(far)


def literals(conditions: DataFrame) -> DataFrame:
    """(condition_id, group_no, segment_id)."""
    groups = conditions.select("condition_id", F.posexplode("groups").alias("group_no", "g"))
    return groups.select("condition_id", "group_no", F.explode("g").alias("segment_id"))


def patch_glyphs(segments: DataFrame, conditions: DataFrame) -> DataFrame:
    """(condition_id, gid): a segment's own glyphs; two further glyphs for each composite condition."""
    own = segments.select(F.col("segment_id").alias("condition_id"), "gid")
    more = conditions.where("condition_id >= 1000").select("condition_id", F.explode(F.array(F.col("condition_id") * 2, F.col("condition_id") * 2 + 1)).alias("gid"))
    return own.unionByName(more)
