"""Exact links and pairs of sets, by prefix filtering. Only built-in DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import free, packed, settle


def alike(percent: int, a: Column | None = None, b: Column | None = None) -> Column:
    """Of arrays without repeats (sa and sb, if not given): 100 * intersection >= percent * union."""
    a, b = F.col("sa") if a is None else a, F.col("sb") if b is None else b
    common = F.size(F.array_intersect(a, b))
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    return (100 * small >= percent * large) & (100 * common >= percent * (F.size(a) + F.size(b) - common))


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets(id, set) are alike."""
    with_b = pairs.select("a", "b").join(sets.select(F.col("id").alias("b"), F.col("set").alias("sb")), "b")
    both = with_b.join(sets.select(F.col("id").alias("a"), F.col("set").alias("sa")), "a")
    return settle(both.where(alike(percent)).select("a", "b").distinct())


def pairs_across(sets: DataFrame, percent: int, promising: Column) -> DataFrame:
    """All pairs (a, b, na, nb) of different roots in sets(id, root, n, bits, set) that can be alike; n: the set's size.

    Alike sets have at least percent / (100 + percent) of both sizes in common, so they share an
    element among the first n - ceil(percent * n / 100) + 1 of each, in any order that holds for
    all. Rare elements stand first here: those of one set only can't be shared but use up its
    prefix, so sets whose likeness is a common passage drop out at once. An element at place i of
    n leaves n - i + 1 elements that can be common; where that is too few for either side the pair
    isn't made, so near copies that each have too much of their own don't meet through what the
    group has in common. What is left of the pairs of a prefix element is held against promising,
    a condition on na, nb, ba and bb that no alike pair fails, in the join itself, so pairs that
    merely share a frequent element are never rows. Where the sets with a prefix element belong
    mostly to one root, only the others are compared with all: what is one component already is
    never paired with itself.
    """
    sets = packed(sets.where("n > 0"))
    free(sets)
    first = F.col("n") - F.ceil(F.lit(percent) * F.col("n") / F.lit(100)) + 1
    sized = sets.select("id", F.col("n"), F.explode("set").alias("s"))
    shared = sized.groupBy("s").agg(F.count("*").alias("df")).where("df > 1")
    met = sized.join(shared, "s")
    of_set = W.partitionBy("id")
    met = met.withColumn("no", F.col("n") - F.count("*").over(of_set) + F.row_number().over(of_set.orderBy("df", "s")))
    told = sets.select("id", "root", "bits")
    prefix = settle(met.where(F.col("no") <= first).select("s", "id", "n", "no").join(told, "id"))
    counts = prefix.groupBy("s", "root").agg(F.count("*").alias("k"))
    free(sets)
    most = packed(counts.groupBy("s").agg(F.count("*").alias("roots"), F.max(F.struct("k", "root"))["root"].alias("top")).where("roots > 1").select("s", "top"))
    mixed = prefix.join(most, "s")
    left = mixed.where("root <> top").select("s", F.col("id").alias("x"), F.col("root").alias("rx"), F.col("n").alias("na"), F.col("no").alias("ia"), F.col("bits").alias("ba"))
    right = mixed.select(F.col("s").alias("in"), F.col("id").alias("y"), F.col("root").alias("ry"), F.col("n").alias("nb"), F.col("no").alias("ib"), F.col("bits").alias("bb"))
    reach = (100 + percent) * (F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib")) + 1) >= percent * (F.col("na") + F.col("nb"))
    met = left.join(right, (F.col("s") == F.col("in")) & (F.col("rx") != F.col("ry")) & reach & promising)
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.least("na", "nb").alias("na"), F.greatest("na", "nb").alias("nb")).distinct()
