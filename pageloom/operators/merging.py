"""Merging segments and patches where that lowers the expected bytes.

Probabilities p(segment_id, p) may have further columns, as a dataset or merge group; results are
then made for each of their values, which they carry.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cnf
from ..sources.corpus import OVERHEAD, glyph_bytes
from .sizes import estimate

LEAST_GROWTH = 6  # bytes that a merged patch grows by at least
BEST_CASE = 0.5  # share of its size that the smaller part may shrink to


def candidates(segments: DataFrame) -> DataFrame:
    """(base, other): every later segment as a merge with each base; segments are as many as codepoints at most."""
    ids = segments.select("segment_id").distinct()
    return ids.select(F.col("segment_id").alias("base")).join(ids.select(F.col("segment_id").alias("other")), F.col("base") < F.col("other"))


def _keys(df: DataFrame, *own: str) -> list[str]:
    return [c for c in df.columns if c not in own]


def best_case(sizes: DataFrame, pairs: DataFrame, p: DataFrame, overhead: int = OVERHEAD) -> DataFrame:
    """Pairs whose merge could lower the cost at best: the larger patch plus half the smaller one's bytes, at least LEAST_GROWTH."""
    keys = _keys(p, "segment_id", "p")
    a = sizes.select(F.col("segment_id").alias("base"), F.col("size").alias("sa")).join(p.select(*keys, F.col("segment_id").alias("base"), F.col("p").alias("pa")), "base")
    b = sizes.select(F.col("segment_id").alias("other"), F.col("size").alias("sb")).join(p.select(*keys, F.col("segment_id").alias("other"), F.col("p").alias("pb")), "other")
    both = pairs.join(a, "base").join(b, [*keys, "other"])
    merged = 1 - (1 - F.col("pa")) * (1 - F.col("pb"))
    size = F.greatest("sa", "sb") + F.greatest(F.floor(F.least("sa", "sb") * F.lit(BEST_CASE)), F.lit(LEAST_GROWTH))
    delta = merged * (size + overhead) - F.col("pa") * (F.col("sa") + overhead) - F.col("pb") * (F.col("sb") + overhead)
    return both.select(*keys, "base", "other", delta.alias("delta"))


def cost_deltas(pairs: DataFrame, conditions: DataFrame, patch_glyphs: DataFrame, sizes: DataFrame, p: DataFrame, overhead: int = OVERHEAD) -> DataFrame:
    """(base, other, delta): change of the expected bytes over all conditions that a merge touches.

    conditions(condition_id, groups), patch_glyphs(condition_id, gid), sizes(condition_id, size),
    p(segment_id, p). Conditions that become equal share a patch of all their glyphs; the merged
    segment's probability is that either was there.
    """
    touched = pairs.join(conditions, F.array_contains(F.flatten("groups"), F.col("base")) | F.array_contains(F.flatten("groups"), F.col("other")))
    touched = touched.select("base", "other", "condition_id", "groups", cnf.replace(F.col("groups"), F.col("base"), F.array("base", "other")).alias("new"))
    keys = _keys(p, "segment_id", "p")
    first, second = (p.select(*keys, F.col("segment_id").alias(name), F.col("p").alias(as_)) for name, as_ in (("base", "pa"), ("other", "pb")))
    either = first.join(F.broadcast(second), keys) if keys else first.crossJoin(F.broadcast(second))
    merged = either.where("base < other").select(*keys, "base", "other", (1 - (1 - F.col("pa")) * (1 - F.col("pb"))).alias("pm"))

    def probability(rows: DataFrame, groups: str, use_merged: bool) -> DataFrame:
        lit = rows.select("base", "other", groups, F.posexplode(groups).alias("no", "g")).select("base", "other", groups, "no", F.explode("g").alias("segment_id"))
        q = lit.join(p, "segment_id")
        if use_merged:
            q = q.join(merged, [*keys, "base", "other"]).withColumn("p", F.when(F.col("segment_id") == F.col("base"), F.col("pm")).otherwise(F.col("p")))
        any_ = q.groupBy(*keys, "base", "other", groups, "no").agg((1 - F.product(1 - F.col("p"))).alias("p"))
        return any_.groupBy(*keys, "base", "other", groups).agg(F.product("p").alias("p"))

    before = touched.join(probability(touched, "groups", False), ["base", "other", "groups"]).join(sizes, "condition_id")
    before = before.groupBy(*keys, "base", "other").agg(F.sum(F.col("p") * (F.col("size") + overhead)).alias("before"))
    glyphs = touched.join(patch_glyphs, "condition_id").select("base", "other", "new", "gid").distinct()
    new = glyphs.groupBy("base", "other", "new").agg(estimate(F.count("*"), F.sum(glyph_bytes(F.col("gid")))).alias("size"))
    after = new.join(probability(touched.select("base", "other", "new").distinct(), "new", True), ["base", "other", "new"])
    after = after.groupBy(*keys, "base", "other").agg(F.sum(F.col("p") * (F.col("size") + overhead)).alias("after"))
    return before.join(after, [*keys, "base", "other"]).select(*keys, "base", "other", (F.col("after") - F.col("before")).alias("delta"))


def best(deltas: DataFrame) -> DataFrame:
    """The merge that lowers the cost most; ties to the smaller base, then the smaller other."""
    keys = _keys(deltas, "delta", "base", "other")
    return deltas.where("delta < 0").groupBy(*keys).agg(F.min(F.struct("delta", "base", "other")).alias("m")).where("m is not null").select(*keys, "m.*")


def apply(segments: DataFrame, merge: DataFrame) -> DataFrame:
    """segments(segment_id, ..) with the other one's members under the base; ids stay as they are.

    Where merge has further columns, segments have them too, and each merge is applied to its own.
    """
    keys = _keys(merge, "delta", "base", "other")
    own = merge.select(*keys, F.col("other").alias("segment_id"), "base")
    return segments.join(F.broadcast(own), [*keys, "segment_id"], "left").withColumn("segment_id", F.coalesce("base", "segment_id")).select(*segments.columns)
