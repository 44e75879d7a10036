"""Mixing sources to target weights by a low-discrepancy schedule.

Targets. Sources are ordered by code point, the null source last, and weigh 3, 1, 2, repeating.
They share budget * all words by weight; a target stops at twice its source's words and what it
can't take goes to the others by weight (water filling: target = min(cap, lambda * weight)).

Blocks. A source's documents, shuffled, are cut into blocks of equal words (the last block also
takes the remainder). Blocks have `block` words at most, fewer for small corpora, so that there
are about LEAST_SLOTS slots or more.

Schedule. Slot i of the mix is the point frac(i * golden ratio), in integer arithmetic, mapped
through the cumulative wanted slots (target over words of a block) to a source; slots are ranked
within their source. A source's slot number r plays its block r; when all blocks were played they
are played again, and what the sequence deals to a source beyond `times` passes is void. How often
a block plays is thus what the sequence says, and a source's words are off its target by the few
slots by which the sequence is off an even share (its discrepancy, which grows with the logarithm
of the number of slots).

Only built-in DataFrame functions are used. All running sums over documents and slots have two
levels (salted by hash or by slot range), so that a source with a third of all rows is spread over
many tasks; running sums over sources are in one task each.

Defined results: a null text or one of separators only has size 0 and is never taken; an empty
table gives an empty result; if all sizes are 0, so are all targets; rows that repeat an id, or
are equal in all columns, are separate documents and have a row each; further columns are ignored,
whatever their names. The shuffle is by md5 of seed and id, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import settle

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
LEAST_SLOTS = 1 << 16
BITS = 40  # of a point
GOLDEN = 679537719365  # 2^40 / golden ratio, odd
MOST_SLOTS = 1 << 38
UNIT = 1024  # parts of a slot in which wanted slots are counted
PART = 65536


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix", carry: tuple[str, ...] = ()) -> DataFrame:
    """(row, id, source, size, order_key, carried columns) of every row."""
    return docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).alias("id"),
        F.col(source_col).alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.concat(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")))).alias("order_key"),
        F.struct(F.lit(0).alias("none"), *carry).alias("carried"),
    )


def targets(totals: DataFrame, budget: float = 1.5, times: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """totals(source, source_size) -> with src, weight and target (double).

    One row a source; the windows run over sources, not documents.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    rows = totals.withColumn("src", F.row_number().over(by_name).cast("long") - 1)
    rows = rows.withColumn("weight", F.element_at(cycle, (F.pmod("src", F.lit(len(weights))) + 1).cast("int")))
    rows = rows.withColumn("cap", times * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    filled = W.orderBy("ratio", "src").rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    rows = rows.withColumn("share", budget * F.sum("source_size").over(everything))
    rows = rows.withColumn(
        "level",
        (F.col("share") - F.coalesce(F.sum("cap").over(filled), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(filled), F.lit(0.0))),
    )
    # The level at the first source, by cap/weight, that it doesn't fill; none if every cap is met.
    rows = rows.withColumn("water", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "src", "level"))).over(everything)["level"])
    rows = rows.withColumn("target", F.coalesce(F.least("cap", F.col("water") * F.col("weight")), F.col("cap")))
    return rows.select("src", "source", "source_size", "weight", "target")


def block_plan(goals: DataFrame, block: int) -> DataFrame:
    """Adds length (words of a block), blocks (in one pass) and wanted (slots, in UNITs); goals without words have none."""
    size, blocks = F.col("source_size"), F.col("blocks")
    planned = goals.withColumn("length", F.greatest(F.least(F.lit(block).cast("long"), size), F.lit(1).cast("long")))
    planned = planned.withColumn("blocks", F.greatest(F.expr("source_size div length"), F.lit(1).cast("long")))
    return planned.withColumn("wanted", F.when(size > 0, F.floor(F.col("target") * blocks / size * UNIT + 0.5).cast("long")).otherwise(F.lit(0).cast("long")))


def schedule(goals: DataFrame, times: float = 2.0) -> DataFrame:
    """The mix as slots: (slot, src, rank, block_no). goals: block_plan()'s rows.

    A source owns the points between its bounds on the grid of 2^BITS; the grid's cells, about
    twice as many as sources, bring each slot to the few sources that it may belong to.
    """
    spark = goals.sparkSession
    wanted, sources = goals.agg(F.coalesce(F.sum("wanted"), F.lit(0)).cast("long"), F.count("*")).first()
    total = (wanted + UNIT // 2) // UNIT
    shift = BITS - max(12, int(sources).bit_length() + 1)
    # slot * GOLDEN modulo 2^BITS, in two halves that stay below 2^62
    low, high = GOLDEN % (1 << 20), GOLDEN >> 20
    point = F.pmod(F.pmod("id", F.lit(1 << 20)) * F.lit(high) * F.lit(1 << 20) + F.pmod("id", F.lit(1 << BITS)) * F.lit(low), F.lit(1 << BITS))
    slots = spark.range(total).select(F.col("id").alias("slot"), point.alias("point")).withColumn("cell", F.shiftright("point", shift))
    upto = F.sum("wanted").over(W.orderBy("src").rowsBetween(W.unboundedPreceding, 0))
    bounds = goals.where("wanted > 0").select("src", "blocks", upto.alias("upto"), "wanted")
    grid = "cast((cast({} as decimal(38,0)) * {}) div {} as bigint)"
    bounds = bounds.select("src", "blocks", F.expr(grid.format("upto - wanted", 1 << BITS, max(wanted, 1))).alias("lo"), F.expr(grid.format("upto", 1 << BITS, max(wanted, 1))).alias("hi")).where("lo < hi")
    cells = bounds.select("src", "blocks", "lo", "hi", F.explode(F.sequence(F.shiftright("lo", shift), F.shiftright(F.col("hi") - 1, shift))).alias("cell"))
    placed = slots.join(cells, "cell").where("lo <= point and point < hi").select("slot", "src", "blocks", F.floor(F.col("slot") / PART).alias("part"))
    # Ranks within a source by two levels: slots before this range, then within it.
    counts = placed.groupBy("src", "part").agg(F.count("*").alias("n"))
    before = counts.select("src", "part", (F.sum("n").over(W.partitionBy("src").orderBy("part")) - F.col("n")).alias("before"))
    ranked = placed.join(before, ["src", "part"]).select(
        "slot", "src", "blocks", (F.col("before") + F.row_number().over(W.partitionBy("src", "part").orderBy("slot")) - 1).alias("rank")
    )
    return ranked.where(F.col("rank") < F.lit(int(times)) * F.col("blocks")).select("slot", "src", "rank", F.pmod("rank", "blocks").alias("block_no"))


def pieces(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """Documents in their source's shuffled order, split at block bounds.

    (row, src, block_no, words): so many words of the block are the document's; documents of size
    0 have no rows. Running sums: the shuffle key's first three hex digits make 4096 buckets a
    source; sums of buckets first, then within each.
    """
    salted = rows.where("size > 0").withColumn("bucket", F.substring("order_key", 1, 3))
    sums = salted.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    known = goals.select(F.col("source").alias("of"), "src", "length", "blocks")
    named = sums.join(known, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    offsets = named.withColumn("offset", F.sum("n").over(W.partitionBy("src").orderBy("bucket")) - F.col("n"))
    offsets = settle(offsets.select(F.col("source").alias("of"), F.col("bucket").alias("at"), "src", "length", "blocks", "offset"))
    placed = salted.join(offsets, F.col("source").eqNullSafe(F.col("of")) & (F.col("bucket") == F.col("at"))).drop("of", "at")
    within = W.partitionBy("src", "bucket").orderBy("order_key", "id", "row").rowsBetween(W.unboundedPreceding, 0)
    placed = placed.withColumn("end", F.col("offset") + F.sum("size").over(within)).withColumn("start", F.col("end") - F.col("size"))
    first, last = F.expr("least(start div length, blocks - 1)"), F.expr("least((end - 1) div length, blocks - 1)")
    cut = placed.select("row", "src", "start", "end", "length", "blocks", F.explode(F.sequence(first, last)).alias("block_no"))
    # The last block ends where the source does, which no document goes beyond.
    block_end = F.when(F.col("block_no") == F.col("blocks") - 1, F.col("end")).otherwise((F.col("block_no") + 1) * F.col("length"))
    return cut.select("row", "src", "block_no", (F.least("end", block_end) - F.greatest(F.col("start"), F.col("block_no") * F.col("length"))).alias("words"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", budget: float = 1.5, times: float = 2.0, weights: tuple[int, ...] = WEIGHTS, block: int = 4096, seed: str = "mix", carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, size, source_size, target, taken, n_slots, first_slot, carried columns) of every row.

    taken: words that the mix takes, repeats counted; n_slots: slots that play some of the
    document, first_slot the first of them (null without).
    """
    rows = settle(sized(docs, id_col, text_col, source_col, seed, carry))
    totals = settle(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), budget, times, weights))
    words = float(totals.agg(F.coalesce(F.sum("target"), F.lit(0.0))).first()[0])
    block = max(1, min(block, int(words // LEAST_SLOTS)), int(words // MOST_SLOTS))
    goals = settle(block_plan(totals, block))
    uses = schedule(goals, times).groupBy("src", "block_no").agg(F.count("*").alias("plays"), F.min("slot").alias("first"))
    got = pieces(rows, goals).join(uses, ["src", "block_no"])
    told = got.groupBy("row").agg(F.sum(F.col("plays") * F.col("words")).alias("taken"), F.sum("plays").alias("n_slots"), F.min("first").alias("first_slot"))
    of = goals.select(F.col("source").alias("of"), "source_size", "target")
    none = F.lit(0).cast("long")
    out = rows.join(told, "row", "left").join(of, F.col("source").eqNullSafe(F.col("of")))
    return out.select(
        "id", "size", "source_size", "target", F.coalesce("taken", none).alias("taken"), F.coalesce("n_slots", none).alias("n_slots"), "first_slot", *[F.col("carried")[c].alias(c) for c in carry]
    )


def query(spark, sf_dir: str) -> DataFrame:
    out = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", F.round("target", 6).alias("target"), "taken", "n_slots", "first_slot")


SQL = r"""
WITH d AS (
    SELECT row_number() OVER () AS row, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5('mix' || doc_id::VARCHAR) AS k
    FROM documents
), t AS (
    SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS src
    FROM d GROUP BY source
), w AS (
    SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][(src % 3 + 1)::BIGINT] AS weight, 2.0::DOUBLE * source_size AS cap FROM t
), s AS (
    SELECT *, cap / weight AS ratio, (1.5::DOUBLE * sum(source_size) OVER ())::DOUBLE AS share, sum(weight) OVER () AS all_w FROM w
), l AS (
    SELECT *,
        (share - coalesce(sum(cap) OVER f, 0)) / (all_w - coalesce(sum(weight) OVER f, 0)) AS level
    FROM s WINDOW f AS (ORDER BY ratio, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), g AS (
    SELECT source, src, source_size,
        coalesce(least(cap, weight * (SELECT arg_min(level, (ratio, src)) FROM l WHERE level <= ratio)), cap) AS target
    FROM l
), b AS (
    SELECT greatest(1, least(4096, (SELECT floor(sum(target) / 65536) FROM g)::BIGINT)) AS block
), h AS (
    SELECT *, greatest(least(block, source_size), 1) AS length FROM g, b
), i AS (
    SELECT *, greatest(source_size // length, 1) AS blocks FROM h
), j AS (
    SELECT *, CASE WHEN source_size > 0 THEN floor(target * blocks / source_size * 1024 + 0.5)::BIGINT ELSE 0 END AS wanted FROM i
), n AS (
    SELECT *, (sum(wanted) OVER (ORDER BY src))::HUGEINT AS upto, (sum(wanted) OVER ())::HUGEINT AS everything FROM j
), o AS (
    SELECT *, ((upto - wanted) * 1099511627776) // greatest(everything, 1) AS lo, (upto * 1099511627776) // greatest(everything, 1) AS hi FROM n
), p AS (
    SELECT slot, (slot::HUGEINT * 679537719365) % 1099511627776 AS point
    FROM range((SELECT (coalesce(max(everything), 0) + 512) // 1024 FROM n)::BIGINT) r(slot)
), q AS (
    SELECT slot, src, blocks, row_number() OVER (PARTITION BY src ORDER BY slot) - 1 AS rank
    FROM p JOIN o ON lo <= point AND point < hi
), u AS (
    SELECT src, rank % blocks AS block_no, count(*) AS plays, min(slot) AS first FROM q WHERE rank < 2 * blocks GROUP BY 1, 2
), x AS (
    SELECT row, src, length, blocks, size, sum(size) OVER (PARTITION BY src ORDER BY k, doc_id, row ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS fin
    FROM d JOIN j ON d.source IS NOT DISTINCT FROM j.source WHERE size > 0
), y AS (
    SELECT *, unnest(range(least((fin - size) // length, blocks - 1), least((fin - 1) // length, blocks - 1) + 1)) AS block_no FROM x
), z AS (
    SELECT row, src, block_no, least(fin, CASE WHEN block_no = blocks - 1 THEN fin ELSE (block_no + 1) * length END) - greatest(fin - size, block_no * length) AS words FROM y
), v AS (
    SELECT row, sum(plays * words)::BIGINT AS taken, sum(plays)::BIGINT AS n_slots, min(first) AS first_slot FROM z JOIN u USING (src, block_no) GROUP BY row
)
SELECT doc_id, size, source_size, round(target, 6) AS target, coalesce(taken, 0) AS taken, coalesce(n_slots, 0) AS n_slots, first_slot
FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source LEFT JOIN v USING (row)
"""
