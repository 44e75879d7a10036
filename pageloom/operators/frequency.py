"""Codepoint and pair frequencies of a corpus, and the probabilities made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

LAYOUT_TAG = 0.001  # probability of any one layout feature


def single_counts(pages: DataFrame) -> DataFrame:
    """(dataset, cp1, cp2, n) with cp1 = cp2: pages that have the codepoint."""
    # Explode would infer a filter on cps, below it, and make cps of the text a second time for it.
    each = pages.select("dataset", F.explode_outer("cps").alias("cp1")).where("cp1 is not null")
    return each.groupBy("dataset", "cp1").agg(F.count("*").alias("n")).select("dataset", "cp1", F.col("cp1").alias("cp2"), "n")


def pair_counts(pages: DataFrame) -> DataFrame:
    """(dataset, cp1, cp2, n) with cp1 < cp2: pages that have both.

    A page's pairs are made from its own array, so no page is joined with itself; counts are
    summed up before the exchange and the exchange has one row a pair and task.
    """
    return _met(pages, 2)


def counts(pages: DataFrame) -> DataFrame:
    """single_counts and pair_counts in one pass."""
    return _met(pages, 1)


def _met(pages: DataFrame, ahead: int) -> DataFrame:
    """Each codepoint of a page, whose cps are sorted and distinct, with those from `ahead` places after it, counted from 1 for itself."""
    first = pages.select("dataset", "cps", F.posexplode_outer("cps").alias("at", "cp1"))
    both = first.select("dataset", "cp1", F.explode_outer(F.slice("cps", F.col("at") + ahead, F.size("cps"))).alias("cp2"))
    return both.where("cp2 is not null").groupBy("dataset", "cp1", "cp2").agg(F.count("*").alias("n"))


def accumulate(records: DataFrame, *keys: str) -> DataFrame:
    """(.., cp1, cp2, count) in either order -> sums by unordered pair."""
    low, high = F.least("cp1", "cp2"), F.greatest("cp1", "cp2")
    return records.groupBy(*keys, low.alias("cp1"), high.alias("cp2")).agg(F.sum("count").alias("n"))


def probabilities(counts: DataFrame) -> DataFrame:
    """(dataset, cp1, cp2, p): counts over the dataset's largest one. Any filter must come after."""
    top = counts.groupBy("dataset").agg(F.max("n").alias("top"))
    return counts.join(top, "dataset").select("dataset", "cp1", "cp2", (F.col("n") / F.col("top")).alias("p"))


def unknown(counts: DataFrame) -> DataFrame:
    """(dataset, unknown): the probability of what isn't in the data."""
    return counts.groupBy("dataset").agg((F.lit(1.0) / F.max("n")).alias("unknown"))


def single_probability(wanted: DataFrame, prob: DataFrame, rest: DataFrame) -> DataFrame:
    """wanted(dataset, cp, ..) with p; what isn't known gets the unknown's, a dataset without data 0."""
    known = prob.where("cp1 = cp2").select("dataset", F.col("cp1").alias("cp"), "p")
    return wanted.join(known, ["dataset", "cp"], "left").join(rest, "dataset", "left").withColumn("p", F.coalesce("p", "unknown", F.lit(0.0))).drop("unknown")


def pair_probability(wanted: DataFrame, prob: DataFrame) -> DataFrame:
    """wanted(dataset, a, b, pa, pb, ..), a < b, with pab; unknown pairs count as independent."""
    known = prob.where("cp1 < cp2").select("dataset", F.col("cp1").alias("a"), F.col("cp2").alias("b"), F.col("p").alias("pab"))
    return wanted.join(known, ["dataset", "a", "b"], "left").withColumn("pab", F.coalesce("pab", F.col("pa") * F.col("pb")))


def coverage(counts: DataFrame) -> DataFrame:
    """(dataset, cps): the codepoints that a dataset has data on."""
    return counts.where("cp1 = cp2").groupBy("dataset").agg(F.array_sort(F.collect_set("cp1")).alias("cps"))


def listing(prob: DataFrame) -> DataFrame:
    """(dataset, ord, line): codepoints by falling probability, as text with ten decimals."""
    rows = prob.where("cp1 = cp2")
    by = W.partitionBy("dataset").orderBy(F.desc("p"), "cp1")
    return rows.select("dataset", F.row_number().over(by).alias("ord"), F.format_string("0x%04x, %.10f", "cp1", "p").alias("line"))
