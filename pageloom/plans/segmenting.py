"""Queries on the definition, order and selection of segments."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators import frequency as fr
from ..operators import probability as pr
from ..operators import segments as sg
from ..operators import sizes as sz
from .registry import query
from .sqltext import query as sql
from .statistics import World, r9


def _covered(w):
    return fr.coverage(w.single()).select("dataset", F.explode("cps").alias("cp"))


@query("o1_define_segments", sql("SELECT (row_number() OVER (ORDER BY part, cp, value) - 1)::INT AS segment_id, kind, value FROM (SELECT 0 AS part, 'feature' AS kind, unnest(['liga', 'smcp']) AS value, 0 AS cp UNION ALL SELECT 1, 'codepoint', cp::VARCHAR, cp FROM font WHERE cp > 32)", "font"))
def o1(spark, sf_dir):
    return sg.define(spark.createDataFrame([("liga",), ("smcp",)], "tag string"), World(spark, sf_dir).font(), 32)


_COV = "SELECT dataset, cp1 AS cp FROM single"
_GRP = "SELECT DISTINCT dataset, segment_id FROM seg JOIN cov USING (cp)"


@query("o3_merge_groups", sql("SELECT dataset, segment_id FROM mg", "seg", "single", cov=_COV, mg=_GRP))
def o3(spark, sf_dir):
    w = World(spark, sf_dir)
    return sg.merge_groups(w.segments(), _covered(w))


@query("o4_ungrouped_segments", sql("SELECT DISTINCT segment_id FROM seg WHERE segment_id NOT IN (SELECT segment_id FROM mg WHERE dataset IN ('en', 'de'))", "seg", "single", cov=_COV, mg=_GRP))
def o4(spark, sf_dir):
    """Segments outside the groups of en and de."""
    w = World(spark, sf_dir)
    groups = sg.merge_groups(w.segments(), _covered(w)).where("dataset in ('en', 'de')")
    return w.segments().join(groups, "segment_id", "left_anti").select("segment_id").distinct()


_CLASS = "SELECT segment_id, count(mg.dataset)::BIGINT AS n_groups FROM ids LEFT JOIN (SELECT * FROM mg WHERE dataset IN ('en', 'de')) mg USING (segment_id) GROUP BY 1"


@query("o5_classify_segments", sql("SELECT segment_id, n_groups, CASE n_groups WHEN 0 THEN 'ungrouped' WHEN 1 THEN 'grouped' ELSE 'shared' END AS kind FROM k", "ids", "single", cov=_COV, mg=_GRP, k=_CLASS))
def o5(spark, sf_dir):
    w = World(spark, sf_dir)
    return sg.classify(w.segments(), sg.merge_groups(w.segments(), _covered(w)).where("dataset in ('en', 'de')"))


_BEST = "SELECT segment_id, arg_max(p_min, (p_min, p_max)) AS p_min, arg_max(p_max, (p_min, p_max)) AS p_max FROM mg JOIN seg_bound USING (dataset, segment_id) GROUP BY 1"


@query("o6_segment_probabilities", sql("SELECT segment_id, round(p_min, 9) AS p_min, round(p_max, 9) AS p_max FROM bb", "seg", "single", "seg_bound", cov=_COV, mg=_GRP, bb=_BEST))
def o6(spark, sf_dir):
    w = World(spark, sf_dir, pairs=True)
    return sg.best_bounds(sg.merge_groups(w.segments(), _covered(w)), w.bounds()).withColumns({"p_min": r9("p_min"), "p_max": r9("p_max")})


_ORD = """
    SELECT segment_id, (row_number() OVER (ORDER BY CASE n_groups WHEN 0 THEN 2 WHEN 1 THEN 0 ELSE 1 END, CASE WHEN n_groups = 1 THEN g END, round((p_min + p_max) / 2, 9) DESC, segment_id) - 1)::INT AS ord, round((p_min + p_max) / 2, 9) AS p
    FROM k JOIN bb USING (segment_id) LEFT JOIN (SELECT segment_id, min(CASE dataset WHEN 'en' THEN 0 ELSE 1 END) AS g FROM mg WHERE dataset IN ('en', 'de') GROUP BY 1) USING (segment_id)"""
_ORDERED = dict(cov=_COV, mg=_GRP, k=_CLASS, bb=_BEST, o=_ORD)


def ordered(w):
    """(segment_id, ord, p) of the corpus's segments, with the groups en and de."""
    all_groups = sg.merge_groups(w.segments(), _covered(w))
    groups = all_groups.where("dataset in ('en', 'de')")
    p = sg.best_bounds(all_groups, w.bounds()).select("segment_id", r9(pr.bound_average()).alias("p"))
    number = groups.groupBy("segment_id").agg(F.min(F.when(F.col("dataset") == "en", 0).otherwise(1)).alias("group_no"))
    rows = sg.classify(w.segments(), groups).join(p, "segment_id").join(number, "segment_id", "left").withColumn("shared", F.col("kind") == "shared")
    return sg.order(rows).select("segment_id", "ord", "p")


@query("o7_segment_order", sql("SELECT segment_id, ord, p FROM o", "ids", "seg", "single", "seg_bound", **_ORDERED))
def o7(spark, sf_dir):
    return ordered(World(spark, sf_dir, pairs=True))


@query("o8_pregroup_segments", sql("SELECT ord, segment_id, p, coalesce(head, ord)::INT AS head FROM o LEFT JOIN (SELECT ord, min(ord) OVER (PARTITION BY block) AS head FROM (SELECT ord, (row_number() OVER (ORDER BY ord) - 1) // 3 AS block FROM o WHERE p < 0.9)) USING (ord)", "ids", "seg", "single", "seg_bound", **_ORDERED))
def o8(spark, sf_dir):
    return sg.pregroup(ordered(World(spark, sf_dir, pairs=True)), 0.9, 3).select("ord", "segment_id", "p", "head")


@query("o9_frequency_order", sql("SELECT cp1 AS cp, n, row_number() OVER (ORDER BY n DESC NULLS LAST, cp1)::INT AS ord FROM (SELECT cp1, CASE WHEN sum(n) > 1 THEN sum(n)::BIGINT END AS n FROM single GROUP BY 1)", "single"))
def o9(spark, sf_dir):
    """By falling frequency, unknown ones (seen once) last, then by codepoint."""
    s = World(spark, sf_dir).single().groupBy(F.col("cp1").alias("cp")).agg(F.sum("n").alias("n"))
    s = s.withColumn("n", F.when(F.col("n") > 1, F.col("n")))
    return s.withColumn("ord", F.row_number().over(W.orderBy(F.col("n").desc_nulls_last(), "cp")))


_COST = "SELECT ord, round(p * (size + 75), 6) AS cost FROM o JOIN sizes ON condition_id = segment_id"


@query("o10_segment_cutoff", sql("SELECT ord, cost, sum(cost) OVER (ORDER BY ord DESC) >= (SELECT sum(cost) FROM c) * 0.2 AS kept FROM c", "ids", "seg", "single", "seg_bound", "sizes", **_ORDERED, c=_COST))
def o10(spark, sf_dir):
    w = World(spark, sf_dir, pairs=True)
    costs = ordered(w).join(sz.patch_sizes(w.patch_glyphs()), F.col("condition_id") == F.col("segment_id")).select("ord", F.round(F.col("p") * (F.col("size") + 75), 6).alias("cost"))
    return sg.cutoff(costs, 0.2)


@query("o11_init_candidates", sql("SELECT segment_id FROM o WHERE p >= 0.95", "ids", "seg", "single", "seg_bound", **_ORDERED))
def o11(spark, sf_dir):
    """Segments likely enough to be checked for the initial font."""
    return ordered(World(spark, sf_dir, pairs=True)).where("p >= 0.95").select("segment_id")


@query("o12_patch_merge_order", sql("SELECT condition_id, round(p, 9) AS p, row_number() OVER (PARTITION BY dataset ORDER BY round(p, 9) DESC, condition_id)::INT AS ord, dataset FROM cp WHERE condition_id >= 1000", "lit", "seg_uni", cp="SELECT dataset, condition_id, product(g) AS p FROM (SELECT dataset, condition_id, group_no, 1 - product(1 - p) AS g FROM lit JOIN seg_uni USING (segment_id) GROUP BY 1, 2, 3) GROUP BY 1, 2"))
def o12(spark, sf_dir):
    w = World(spark, sf_dir)
    p = pr.condition_probability(w.literals().where("condition_id >= 1000"), pr.any_of(w.seg_cp(), "dataset", "segment_id")).withColumn("p", r9("p"))
    return p.withColumn("ord", F.row_number().over(W.partitionBy("dataset").orderBy(F.desc("p"), "condition_id")))


@query("o13_edge_order", sql("SELECT condition_id, size, row_number() OVER (ORDER BY size, condition_id)::INT AS ord FROM sizes", "sizes"))
def o13(spark, sf_dir):
    return sz.patch_sizes(World(spark, sf_dir).patch_glyphs()).withColumn("ord", F.row_number().over(W.orderBy("size", "condition_id")))


@query("o16_common_codepoints", sql("SELECT cp, count(DISTINCT dataset)::BIGINT AS n FROM cov GROUP BY 1 HAVING count(DISTINCT dataset) > 1", "single", cov=_COV))
def o16(spark, sf_dir):
    return sg.common_codepoints(_covered(World(spark, sf_dir)))


@query("o17_detect_datasets", sql("SELECT dataset, count(*)::BIGINT AS own FROM cov WHERE cp IN (SELECT cp FROM cov GROUP BY cp HAVING count(DISTINCT dataset) = 1) GROUP BY 1 HAVING count(*) >= 2", "single", cov=_COV))
def o17(spark, sf_dir):
    w = World(spark, sf_dir)
    return sg.detect(_covered(w), w.font())


@query("o18_base_script", "SELECT unnest(['de', 'en', 'es', 'fr']) AS dataset, 'latin' AS script")
def o18(spark, sf_dir):
    """The script of each dataset's language, from a fixed map."""
    known = spark.createDataFrame([(x, "latin") for x in ("de", "en", "es", "fr")], "dataset string, script string")
    return World(spark, sf_dir).pages.select("dataset").distinct().join(F.broadcast(known), "dataset")


@query("o19_quality", sql("SELECT count(*)::BIGINT AS n, CASE WHEN count(*) <= 300 THEN 7 WHEN count(*) <= 1500 THEN 6 WHEN count(*) <= 3100 THEN 4 WHEN count(*) <= 30000 THEN 2 ELSE 1 END AS quality FROM font", "font"))
def o19(spark, sf_dir):
    return World(spark, sf_dir).font().agg(F.count("*").alias("n")).select("n", sg.quality(F.col("n")).alias("quality"))


@query("u2_table_keyed_plan", sql("SELECT 1 + (CASE dataset WHEN 'en' THEN 0 ELSE 1 END) AS part, cp FROM cov WHERE dataset IN ('en', 'de') AND cp > 32 UNION ALL SELECT 3, cp FROM font WHERE cp > 32 AND cp NOT IN (SELECT cp FROM cov WHERE dataset IN ('en', 'de'))", "single", "font", cov=_COV))
def u2(spark, sf_dir):
    """Ordered codepoint sets less the initial one; what none of them has is a last set."""
    w = World(spark, sf_dir)
    c = _covered(w).where("cp > 32 and dataset in ('en', 'de')")
    rest = w.font().where("cp > 32").join(c, "cp", "left_anti").select(F.lit(3).alias("part"), "cp")
    return c.select(F.when(F.col("dataset") == "en", 1).otherwise(2).alias("part"), "cp").unionByName(rest)
