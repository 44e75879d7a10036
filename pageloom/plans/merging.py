"""Queries on single steps of the merge optimiser, for the dataset en.

Those named ``.._by_dataset`` give one result per data set, which is the whole job; the others
are the same steps on en alone.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.iterate import settle
from ..operators import merging as mg
from ..operators import probability as pr
from ..operators import sizes as sz
from .algebra import _canon
from .registry import query
from .sqltext import query as sql
from .statistics import World, r9

_P = "SELECT segment_id, p FROM seg_uni WHERE dataset = 'en'"
_PAIRS = "SELECT a.segment_id AS base, b.segment_id AS other FROM ids a JOIN ids b ON a.segment_id < b.segment_id"
_TOUCHED = "SELECT base, other, condition_id, groups, " + _canon("list_transform(groups, lambda g: list_transform(g, lambda s: CASE WHEN s = other THEN base ELSE s END))") + " AS fresh FROM prs JOIN cond ON list_contains(flatten(groups), base) OR list_contains(flatten(groups), other)"
_OLDLIT = "SELECT base, other, condition_id, no, unnest(g) AS segment_id FROM (SELECT base, other, condition_id, unnest(range(len(groups))) AS no, unnest(groups) AS g FROM tch)"
_OLD = "SELECT base, other, sum(p * (size + 75)) AS cost FROM (SELECT base, other, condition_id, product(q) AS p FROM (SELECT base, other, condition_id, no, 1 - product(1 - p) AS q FROM ol JOIN pp USING (segment_id) GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3) JOIN sizes USING (condition_id) GROUP BY 1, 2"
_NEWLIT = "SELECT base, other, fresh, no, unnest(g) AS segment_id FROM (SELECT base, other, fresh, unnest(range(len(fresh))) AS no, unnest(fresh) AS g FROM (SELECT DISTINCT base, other, fresh FROM tch))"
_NEWP = "SELECT base, other, fresh, product(q) AS p FROM (SELECT n.base, n.other, n.fresh, n.no, 1 - product(1 - CASE WHEN n.segment_id = n.base THEN 1 - (1 - a.p) * (1 - b.p) ELSE s.p END) AS q FROM nl n JOIN pp s ON s.segment_id = n.segment_id JOIN pp a ON a.segment_id = n.base JOIN pp b ON b.segment_id = n.other GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3"
_NEWSIZE = "SELECT base, other, fresh, (29 + floor((5 + count(*) * CASE WHEN count(*) > 255 THEN 3 ELSE 2 END + 4 + 4 * (count(*) + 1) + sum(40 + (gid * 37) % 200)) * 0.5::DOUBLE))::BIGINT AS size FROM (SELECT DISTINCT base, other, fresh, gid FROM tch JOIN glyphs USING (condition_id)) GROUP BY 1, 2, 3"
_NEW = "SELECT base, other, sum(p * (size + 75)) AS cost FROM np JOIN ns USING (base, other, fresh) GROUP BY 1, 2"
_DELTA = "SELECT base, other, round(n.cost - o.cost, 6) AS delta FROM oc o JOIN nc n USING (base, other)"
_M = dict(pp=_P, prs=_PAIRS, tch=_TOUCHED, ol=_OLDLIT, oc=_OLD, nl=_NEWLIT, np=_NEWP, ns=_NEWSIZE, nc=_NEW, dl=_DELTA)


def _world(spark, sf_dir):
    w = World(spark, sf_dir)
    p = settle(pr.any_of(w.seg_cp().where("dataset = 'en'"), "segment_id"))
    return w, p


def _worlds(spark, sf_dir):
    w = World(spark, sf_dir)
    p = settle(pr.any_of(w.seg_cp(), "dataset", "segment_id"))
    return w, p


def _deltas(spark, sf_dir, world=_world):
    w, p = world(spark, sf_dir)
    glyphs = settle(w.patch_glyphs())
    d = mg.cost_deltas(mg.candidates(w.segments()), settle(w.conditions()), glyphs, sz.patch_sizes(glyphs), p)
    return w, d.withColumn("delta", F.round("delta", 6))


@query("m3_candidate_merges", sql("SELECT base, other FROM prs", "ids", prs=_PAIRS))
def m3(spark, sf_dir):
    return mg.candidates(World(spark, sf_dir).segments())


@query("m4_composite_candidates", sql("SELECT condition_id, segment_id FROM lit WHERE condition_id >= 1000", "lit"))
def m4(spark, sf_dir):
    """Segments of every composite condition, as sets to merge."""
    return World(spark, sf_dir).literals().where("condition_id >= 1000").select("condition_id", "segment_id")


@query("m5_best_case", sql("SELECT base, other, round((1 - (1 - a.p) * (1 - b.p)) * (greatest(x.size, y.size) + greatest(floor(least(x.size, y.size) * 0.5::DOUBLE), 6) + 75) - a.p * (x.size + 75) - b.p * (y.size + 75), 6) AS delta FROM prs JOIN pp a ON a.segment_id = base JOIN pp b ON b.segment_id = other JOIN sizes x ON x.condition_id = base JOIN sizes y ON y.condition_id = other", "ids", "sizes", "seg_uni", pp=_P, prs=_PAIRS))
def m5(spark, sf_dir):
    w, p = _world(spark, sf_dir)
    sizes = sz.patch_sizes(w.patch_glyphs()).withColumnRenamed("condition_id", "segment_id")
    return mg.best_case(sizes, mg.candidates(w.segments()), p).withColumn("delta", F.round("delta", 6))


@query("m7_cost_deltas", sql("SELECT base, other, delta FROM dl", "ids", "cond", "sizes", "seg_uni", **_M))
def m7(spark, sf_dir):
    return _deltas(spark, sf_dir)[1]


@query("o14_best_candidate", sql("SELECT delta, base, other FROM dl WHERE delta < 0 ORDER BY delta, base, other LIMIT 1", "ids", "cond", "sizes", "seg_uni", **_M))
def o14(spark, sf_dir):
    return mg.best(_deltas(spark, sf_dir)[1])


@query("m12_apply_merge", sql("SELECT CASE WHEN segment_id = (SELECT other FROM bst) THEN (SELECT base FROM bst) ELSE segment_id END AS segment_id, cp FROM seg", "ids", "cond", "sizes", "seg_uni", **_M, bst="SELECT base, other FROM dl WHERE delta < 0 ORDER BY delta, base, other LIMIT 1"))
def m12(spark, sf_dir):
    """Segments after the best merge."""
    w, d = _deltas(spark, sf_dir)
    return mg.apply(w.segments().select("segment_id", "cp"), settle(mg.best(d)))


@query("m8_inert_threshold", sql("SELECT segment_id, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, 6 * p / (size + 75))), 9) AS threshold FROM pp JOIN sizes ON condition_id = segment_id", "sizes", "seg_uni", pp=_P))
def m8(spark, sf_dir):
    """Probability below which no merge with a segment can pay, by the least growth of its patch."""
    w, p = _world(spark, sf_dir)
    met = p.join(sz.patch_sizes(w.patch_glyphs()), F.col("condition_id") == F.col("segment_id"))
    return met.select("segment_id", r9(F.greatest(F.lit(0.0), F.least(F.lit(1.0), mg.LEAST_GROWTH * F.col("p") / (F.col("size") + 75)))).alias("threshold"))


@query("m11_too_small_patches", sql("SELECT condition_id, n FROM (SELECT condition_id, count(*)::BIGINT AS n FROM glyphs GROUP BY 1) WHERE n < 8", "glyphs"))
def m11(spark, sf_dir):
    """Patches below a least number of glyphs, that the heuristic merges first."""
    return World(spark, sf_dir).patch_glyphs().groupBy("condition_id").agg(F.count("*").alias("n")).where("n < 8")


@query("m13_init_moves", sql("SELECT segment_id, round(size - p * (size + 75), 6) AS delta FROM pp JOIN sizes ON condition_id = segment_id WHERE size - p * (size + 75) < 0", "sizes", "seg_uni", pp=_P))
def m13(spark, sf_dir):
    """Segments that cost less in the initial font: their bytes once, against their expected load."""
    w, p = _world(spark, sf_dir)
    delta = F.col("size") - F.col("p") * (F.col("size") + 75)
    return p.join(sz.patch_sizes(w.patch_glyphs()), F.col("condition_id") == F.col("segment_id")).where(delta < 0).select("segment_id", F.round(delta, 6).alias("delta"))


_ALL = _M | dict(
    pp="SELECT dataset, segment_id, p FROM seg_uni",
    oc="SELECT dataset, base, other, sum(p * (size + 75)) AS cost FROM (SELECT dataset, base, other, condition_id, product(q) AS p FROM (SELECT dataset, base, other, condition_id, no, 1 - product(1 - p) AS q FROM ol JOIN pp USING (segment_id) GROUP BY 1, 2, 3, 4, 5) GROUP BY 1, 2, 3, 4) JOIN sizes USING (condition_id) GROUP BY 1, 2, 3",
    np="SELECT dataset, base, other, fresh, product(q) AS p FROM (SELECT s.dataset, n.base, n.other, n.fresh, n.no, 1 - product(1 - CASE WHEN n.segment_id = n.base THEN 1 - (1 - a.p) * (1 - b.p) ELSE s.p END) AS q FROM nl n JOIN pp s ON s.segment_id = n.segment_id JOIN pp a ON a.segment_id = n.base AND a.dataset = s.dataset JOIN pp b ON b.segment_id = n.other AND b.dataset = s.dataset GROUP BY 1, 2, 3, 4, 5) GROUP BY 1, 2, 3, 4",
    nc="SELECT dataset, base, other, sum(p * (size + 75)) AS cost FROM np JOIN ns USING (base, other, fresh) GROUP BY 1, 2, 3",
    dl="SELECT dataset, base, other, round(n.cost - o.cost, 6) AS delta FROM oc o JOIN nc n USING (dataset, base, other)",
    bst="SELECT DISTINCT ON (dataset) dataset, delta, base, other FROM dl WHERE delta < 0 ORDER BY dataset, delta, base, other",
)
_PP = _ALL["pp"]


@query("m5_best_case_by_dataset", sql("SELECT a.dataset, base, other, round((1 - (1 - a.p) * (1 - b.p)) * (greatest(x.size, y.size) + greatest(floor(least(x.size, y.size) * 0.5::DOUBLE), 6) + 75) - a.p * (x.size + 75) - b.p * (y.size + 75), 6) AS delta FROM prs JOIN pp a ON a.segment_id = base JOIN pp b ON b.segment_id = other AND b.dataset = a.dataset JOIN sizes x ON x.condition_id = base JOIN sizes y ON y.condition_id = other", "ids", "sizes", "seg_uni", pp=_PP, prs=_PAIRS))
def m5_all(spark, sf_dir):
    w, p = _worlds(spark, sf_dir)
    sizes = sz.patch_sizes(w.patch_glyphs()).withColumnRenamed("condition_id", "segment_id")
    return mg.best_case(sizes, mg.candidates(w.segments()), p).withColumn("delta", F.round("delta", 6))


@query("m7_cost_deltas_by_dataset", sql("SELECT dataset, base, other, delta FROM dl", "ids", "cond", "sizes", "seg_uni", **_ALL))
def m7_all(spark, sf_dir):
    return _deltas(spark, sf_dir, _worlds)[1]


@query("o14_best_candidate_by_dataset", sql("SELECT dataset, delta, base, other FROM bst", "ids", "cond", "sizes", "seg_uni", **_ALL))
def o14_all(spark, sf_dir):
    return mg.best(_deltas(spark, sf_dir, _worlds)[1])


@query("m12_apply_merge_by_dataset", sql("SELECT d.dataset, coalesce(b.base, s.segment_id) AS segment_id, s.cp FROM seg s CROSS JOIN (SELECT DISTINCT dataset FROM pp) d LEFT JOIN bst b ON b.dataset = d.dataset AND b.other = s.segment_id", "ids", "cond", "sizes", "seg_uni", **_ALL))
def m12_all(spark, sf_dir):
    """Each data set's segments after its best merge."""
    w, p = _worlds(spark, sf_dir)
    d = _deltas(spark, sf_dir, lambda *_: (w, p))[1]
    segments = p.select("dataset").distinct().join(w.segments().select("segment_id", "cp"))
    return mg.apply(segments, settle(mg.best(d)))


@query("m8_inert_threshold_by_dataset", sql("SELECT dataset, segment_id, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, 6 * p / (size + 75))), 9) AS threshold FROM pp JOIN sizes ON condition_id = segment_id", "sizes", "seg_uni", pp=_PP))
def m8_all(spark, sf_dir):
    w, p = _worlds(spark, sf_dir)
    met = p.join(sz.patch_sizes(w.patch_glyphs()), F.col("condition_id") == F.col("segment_id"))
    return met.select("dataset", "segment_id", r9(F.greatest(F.lit(0.0), F.least(F.lit(1.0), mg.LEAST_GROWTH * F.col("p") / (F.col("size") + 75)))).alias("threshold"))


@query("m13_init_moves_by_dataset", sql("SELECT dataset, segment_id, round(size - p * (size + 75), 6) AS delta FROM pp JOIN sizes ON condition_id = segment_id WHERE size - p * (size + 75) < 0", "sizes", "seg_uni", pp=_PP))
def m13_all(spark, sf_dir):
    w, p = _worlds(spark, sf_dir)
    delta = F.col("size") - F.col("p") * (F.col("size") + 75)
    return p.join(sz.patch_sizes(w.patch_glyphs()), F.col("condition_id") == F.col("segment_id")).where(delta < 0).select("dataset", "segment_id", F.round(delta, 6).alias("delta"))
