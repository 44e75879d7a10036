"""Segments: definition, merge groups, ordering, pre-grouping, cutoffs, script detection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Codepoints of a font up to which a quality level is picked, and the level.
QUALITY_BINS = ((300, 7), (1500, 6), (3100, 4), (30000, 2))
QUALITY_REST = 1


def define(features: DataFrame, font: DataFrame, init_max: int) -> DataFrame:
    """(segment_id, kind, value): one segment a feature in order, then one a codepoint that isn't initial."""
    f = features.select(F.lit(0).alias("part"), F.lit("feature").alias("kind"), F.col("tag").alias("value"), F.lit(0).alias("cp"))
    c = font.where(F.col("cp") > init_max).select(F.lit(1).alias("part"), F.lit("codepoint").alias("kind"), F.col("cp").cast("string").alias("value"), "cp")
    return f.unionByName(c).select((F.row_number().over(W.orderBy("part", "cp", "value")) - 1).alias("segment_id"), "kind", "value")


def merge_groups(segments: DataFrame, covered: DataFrame) -> DataFrame:
    """(dataset, segment_id): segments(segment_id, cp) with a codepoint that the dataset covers(dataset, cp)."""
    return segments.join(covered, "cp").select("dataset", "segment_id").distinct()


def classify(segments: DataFrame, groups: DataFrame) -> DataFrame:
    """(segment_id, n_groups, kind): ungrouped, grouped, or shared by several groups."""
    n = groups.groupBy("segment_id").agg(F.count("*").alias("n_groups"))
    rows = segments.select("segment_id").distinct().join(n, "segment_id", "left").withColumn("n_groups", F.coalesce("n_groups", F.lit(0).cast("long")))
    return rows.withColumn("kind", F.when(F.col("n_groups") == 0, "ungrouped").when(F.col("n_groups") == 1, "grouped").otherwise("shared"))


def best_bounds(groups: DataFrame, bounds: DataFrame) -> DataFrame:
    """(segment_id, p_min, p_max): over a segment's groups the bounds with the greatest lower one."""
    met = groups.join(bounds, ["dataset", "segment_id"]).groupBy("segment_id").agg(F.max(F.struct("p_min", "p_max")).alias("b"))
    return met.select("segment_id", "b.p_min", "b.p_max")


def order(segments: DataFrame) -> DataFrame:
    """segments(segment_id, group_no null if ungrouped, shared, p) with ord: groups in order, likely ones first; then shared, then ungrouped.

    A ranking over segments, which are as many as codepoints at most.
    """
    by = W.orderBy(F.when(F.col("group_no").isNull(), 2).when(F.col("shared"), 1).otherwise(0), F.when(F.col("shared"), 0).otherwise(F.col("group_no")), F.desc("p"), "segment_id")
    return segments.withColumn("ord", F.row_number().over(by) - 1)


def pregroup(ordered: DataFrame, threshold: float, k: int) -> DataFrame:
    """ordered(ord, segment_id, p) with head: in the tail below the threshold, each k segments in order become one, named by the first."""
    tail = ordered.where(F.col("p") < threshold).withColumn("block", F.floor((F.row_number().over(W.orderBy("ord")) - 1) / k))
    heads = tail.groupBy("block").agg(F.min("ord").alias("head"))
    return ordered.join(tail.join(heads, "block").select("ord", "head"), "ord", "left").withColumn("head", F.coalesce("head", "ord"))


def cutoff(costs: DataFrame, fraction: float) -> DataFrame:
    """costs(ord, cost) with kept: from the last one back, what adds up to less than the fraction of the total goes."""
    total = costs.agg(F.sum("cost").alias("total"))
    back = F.sum("cost").over(W.orderBy(F.desc("ord")).rowsBetween(W.unboundedPreceding, 0))
    return costs.withColumn("tail", back).crossJoin(F.broadcast(total)).withColumn("kept", F.col("tail") >= F.col("total") * fraction).drop("tail", "total")


def common_codepoints(covered: DataFrame) -> DataFrame:
    """(cp, n) in more than one dataset."""
    return covered.groupBy("cp").agg(F.countDistinct("dataset").alias("n")).where("n > 1")


def detect(covered: DataFrame, font: DataFrame, least: int = 2) -> DataFrame:
    """(dataset, own): datasets of which the font has `least` or more codepoints that no other one covers."""
    own = covered.join(common_codepoints(covered), "cp", "left_anti").join(font.select("cp"), "cp", "left_semi")
    return own.groupBy("dataset").agg(F.count("*").alias("own")).where(F.col("own") >= least)


def quality(n):
    """The quality level for a font of n codepoints."""
    out = F.lit(None)
    for bound, level in QUALITY_BINS:
        out = F.when(n <= bound, level) if bound == QUALITY_BINS[0][0] else out.when(n <= bound, level)
    return out.otherwise(QUALITY_REST)
