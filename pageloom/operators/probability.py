"""Probabilities of sets of codepoints and of conditions over segments, with bounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frequency import LAYOUT_TAG, pair_probability


def any_of(rows: DataFrame, *keys: str, p: str = "p") -> DataFrame:
    """1 - product(1 - p): that at least one of independent things is there."""
    return rows.groupBy(*keys).agg((1 - F.product(1 - F.col(p))).alias("p"))


def all_of(rows: DataFrame, *keys: str, p: str = "p") -> DataFrame:
    return rows.groupBy(*keys).agg(F.product(p).alias("p"))


def bound_average(p_min="p_min", p_max="p_max"):
    return (F.col(p_min) + F.col(p_max)) / 2


def pair_bounds(seg_cp: DataFrame, prob: DataFrame, key: str = "segment_id") -> DataFrame:
    """seg_cp(dataset, key, cp, p) -> (dataset, key, p_min, p_max), from single and pair probabilities.

    Lower: the largest of sum(p) - sum(pairs), any one pair's union, any one p. Upper: sum(p) less
    the best star of pairs around one codepoint, at most 1. Certain members make both 1.
    """
    keys = ["dataset", key]
    x = seg_cp.select(*keys, F.col("cp").alias("a"), F.col("p").alias("pa"))
    y = seg_cp.select(*keys, F.col("cp").alias("b"), F.col("p").alias("pb"))
    pairs = pair_probability(x.join(y, keys).where("a < b"), prob)
    ones = seg_cp.groupBy(*keys).agg(F.sum("p").alias("s1"), F.max("p").alias("m1"))
    twos = pairs.groupBy(*keys).agg(F.sum("pab").alias("s2"), F.max(F.col("pa") + F.col("pb") - F.col("pab")).alias("m2"))
    arms = pairs.select(*keys, F.explode(F.array("a", "b")).alias("j"), "pab").groupBy(*keys, "j").agg(F.sum("pab").alias("t"))
    star = arms.groupBy(*keys).agg(F.max("t").alias("star"))
    zero = F.lit(0.0)
    s2, m2, st = (F.coalesce(c, zero) for c in ("s2", "m2", "star"))
    low = F.greatest(F.col("s1") - s2, m2, F.col("m1"))
    high = F.greatest(F.least(F.col("s1") - st, F.lit(1.0)), low)
    sure = (F.col("m1") >= 1) | (m2 >= 1)
    met = ones.join(twos, keys, "left").join(star, keys, "left")
    return met.select(*keys, F.when(sure, 1.0).otherwise(low).alias("p_min"), F.when(sure, 1.0).otherwise(high).alias("p_max"))


def with_tags(bounds: DataFrame, tags: str = "n_tags") -> DataFrame:
    """Bounds of segments that also have layout features."""
    n = F.col(tags)
    least = F.when(n > 0, F.greatest("p_min", F.lit(LAYOUT_TAG))).otherwise(F.col("p_min"))
    most = F.least(F.lit(1.0), F.col("p_max") + F.least(F.lit(1.0), n * LAYOUT_TAG))
    return bounds.withColumn("p_max", most).withColumn("p_min", least)


def conjunctive_bounds(rows: DataFrame, *keys: str) -> DataFrame:
    """Of things that must all be there, from each one's bounds."""
    return rows.groupBy(*keys).agg(
        F.greatest(F.lit(0.0), F.sum("p_min") - F.count("*") + 1).alias("p_min"),
        F.least(F.lit(1.0), F.min("p_max")).alias("p_max"),
    )


def condition_probability(literals: DataFrame, segment_p: DataFrame) -> DataFrame:
    """literals(condition_id, group_no, segment_id) x segment_p(dataset, segment_id, p): groups by any, then conditions by all."""
    met = literals.join(segment_p, "segment_id")
    return all_of(any_of(met, "dataset", "condition_id", "group_no"), "dataset", "condition_id")


def condition_bounds(literals: DataFrame, seg_cp: DataFrame, segment_bounds: DataFrame, prob: DataFrame) -> DataFrame:
    """Bounds of conditions: a group's from the union of its segments' codepoints, at least its best segment's lower bound; then all groups."""
    members = literals.join(seg_cp, "segment_id").withColumn("part", F.concat_ws(":", "condition_id", "group_no"))
    groups = pair_bounds(members.select("dataset", "part", "cp", "p"), prob, "part")
    best = literals.join(segment_bounds, "segment_id").groupBy("dataset", "condition_id", "group_no").agg(F.max("p_min").alias("best"))
    best = best.withColumn("part", F.concat_ws(":", "condition_id", "group_no"))
    met = groups.join(best, ["dataset", "part"])
    met = met.select("dataset", "condition_id", F.greatest("p_min", "best").alias("p_min"), F.greatest("p_max", "best").alias("p_max"))
    return conjunctive_bounds(met, "dataset", "condition_id")
