"""Queries on patch sizes, costs and what pages load."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import probability as pr
from ..operators import sizes as sz
from ..sources import corpus
from .registry import query
from .sqltext import query as sql
from .statistics import _COND_P, World, r9


@query("f21_patch_sizes", sql("SELECT condition_id, size FROM sizes", "sizes"))
def f21(spark, sf_dir):
    return sz.patch_sizes(World(spark, sf_dir).patch_glyphs())


@query("f22_compression_ratio", sql("SELECT round(size::DOUBLE / raw, 9) AS ratio FROM (SELECT (29 + floor((5 + count(*) * CASE WHEN count(*) > 255 THEN 3 ELSE 2 END + 4 + 4 * (count(*) + 1) + sum(40 + (gid * 37) % 200)) * 0.5::DOUBLE)) AS size, sum(40 + (gid * 37) % 200) AS raw FROM font)", "font"))
def f22(spark, sf_dir):
    """The size of one patch of all glyphs over their raw bytes."""
    g = World(spark, sf_dir).font().select(F.lit(0).alias("all"), "gid")
    raw = F.sum(corpus.glyph_bytes(F.col("gid")))
    return g.agg(F.round(sz.estimate(F.count("*"), raw) / raw, 9).alias("ratio"))


@query("c14_conditions_met", sql("SELECT dataset, condition_id, count(*)::BIGINT AS pages FROM hits GROUP BY 1, 2", "hits"))
def c14(spark, sf_dir):
    w = World(spark, sf_dir)
    met = sz.loaded(sz.page_segments(w.pages, w.segments()), w.literals())
    return met.groupBy("dataset", "condition_id").agg(F.count("*").alias("pages"))


@query("l1_extend_request", sql("SELECT page, count(*)::BIGINT AS fetches, array_to_string(list_sort(list(condition_id)), ',') AS patches, sum(size)::BIGINT AS bytes FROM hits JOIN sizes USING (condition_id) GROUP BY page", "hits", "sizes"))
def l1(spark, sf_dir):
    """The patches that each page's request loads, in one round trip, and their bytes."""
    w = World(spark, sf_dir)
    met = sz.loaded(sz.page_segments(w.pages, w.segments()), w.literals()).join(sz.patch_sizes(w.patch_glyphs()), "condition_id")
    listed = F.concat_ws(",", F.transform(F.array_sort(F.collect_list("condition_id")), lambda c: c.cast("string")))
    return met.groupBy("page").agg(F.count("*").alias("fetches"), listed.alias("patches"), F.sum("size").alias("bytes"))


@query("l3_fetched", sql("SELECT condition_id, count(*)::BIGINT AS fetched FROM hits GROUP BY 1", "hits"))
def l3(spark, sf_dir):
    w = World(spark, sf_dir)
    return sz.loaded(sz.page_segments(w.pages, w.segments()), w.literals()).groupBy("condition_id").agg(F.count("*").alias("fetched"))


_BOUNDS = """
    SELECT dataset, condition_id, greatest(0.0::DOUBLE, sum(g_min) - count(*) + 1) AS p_min, least(1.0::DOUBLE, min(g_max)) AS p_max FROM (
        SELECT dataset, condition_id, group_no, max(p_min) AS g_min, least(1.0::DOUBLE, sum(p_max)) AS g_max FROM lit JOIN seg_bound USING (segment_id) GROUP BY 1, 2, 3) GROUP BY 1, 2"""


def page_cost(w: World):
    """(dataset, n_pages, actual_avg, predicted_unigram, bound_min, bound_max): bytes of patches of an average page, loaded and predicted.

    Groups of several segments are bounded here by their best segment below and their sum above.
    """
    sizes = sz.patch_sizes(w.patch_glyphs())
    met = sz.loaded(sz.page_segments(w.pages, w.segments()), w.literals()).join(sizes, "condition_id")
    actual = met.groupBy("dataset").agg(F.sum(F.col("size") + corpus.OVERHEAD).alias("bytes"))
    n = w.pages.groupBy("dataset").agg(F.count("*").alias("n_pages"))
    single = pr.any_of(w.seg_cp(), "dataset", "segment_id")
    predicted = sz.expected_cost(pr.condition_probability(w.literals(), single), sizes).withColumnRenamed("cost", "predicted_unigram")
    group = w.literals().join(w.bounds(), "segment_id").groupBy("dataset", "condition_id", "group_no").agg(F.max("p_min").alias("p_min"), F.least(F.lit(1.0), F.sum("p_max")).alias("p_max"))
    bounds = pr.conjunctive_bounds(group, "dataset", "condition_id")
    low = sz.expected_cost(bounds, sizes, p="p_min").withColumnRenamed("cost", "bound_min")
    high = sz.expected_cost(bounds, sizes, p="p_max").withColumnRenamed("cost", "bound_max")
    rows = n.join(actual, "dataset").join(predicted, "dataset").join(low, "dataset").join(high, "dataset")
    return rows.select("dataset", "n_pages", r9(F.col("bytes") / F.col("n_pages")).alias("actual_avg"), *[F.round(c, 6).alias(c) for c in ("predicted_unigram", "bound_min", "bound_max")])


@query(
    "f24_page_cost",
    sql(
        """SELECT dataset, n_pages, round(bytes::DOUBLE / n_pages, 9) AS actual_avg, round(u, 6) AS predicted_unigram, round(lo, 6) AS bound_min, round(hi, 6) AS bound_max
        FROM (SELECT dataset, count(*) AS n_pages FROM pages GROUP BY 1)
        JOIN (SELECT dataset, sum(size + 75) AS bytes FROM hits JOIN sizes USING (condition_id) GROUP BY 1) USING (dataset)
        JOIN (SELECT dataset, sum(p * (size + 75)) AS u FROM cp JOIN sizes USING (condition_id) GROUP BY 1) USING (dataset)
        JOIN (SELECT dataset, sum(p_min * (size + 75)) AS lo, sum(p_max * (size + 75)) AS hi FROM cb JOIN sizes USING (condition_id) GROUP BY 1) USING (dataset)""",
        "hits", "sizes", "seg_uni", "seg_bound", cp=_COND_P, cb=_BOUNDS,
    ),
)
def f24_page(spark, sf_dir):
    return page_cost(World(spark, sf_dir, pairs=True))


@query(
    "f24_total_costs",
    sql(
        """SELECT dataset, round(sum(p * (size + 75)), 6) AS patches, (SELECT (29 + floor((5 + 2 * count(*) + 4 + 4 * (count(*) + 1) + coalesce(sum(40 + (gid * 37) % 200), 0)) * 0.5::DOUBLE))::BIGINT FROM font WHERE cp <= 32) AS init_font,
        (SELECT (29 + floor((5 + 2 * count(*) + 4 + 4 * (count(*) + 1) + sum(40 + (gid * 37) % 200)) * 0.5::DOUBLE))::BIGINT FROM font) AS whole_font,
        round((SELECT sum(coalesce(u.p, b.unknown)) FROM seg s JOIN best b ON b.dataset = cc.dataset LEFT JOIN uni u ON u.dataset = cc.dataset AND u.cp = s.cp) * (SELECT (29 + floor((5 + 2 * count(*) + 4 + 4 * (count(*) + 1) + sum(40 + (gid * 37) % 200)) * 0.5::DOUBLE)) / count(*) FROM font), 6) AS ideal
        FROM cq cc JOIN sizes USING (condition_id) GROUP BY dataset""",
        "sizes", "seg_uni", "lit", cq=_COND_P,
    ),
)
def f24_total(spark, sf_dir):
    """Expected patch bytes, the initial and the whole font, and what a perfect split of the whole would cost."""
    w = World(spark, sf_dir)
    single = pr.any_of(w.seg_cp(), "dataset", "segment_id")
    patches = sz.expected_cost(pr.condition_probability(w.literals(), single), sz.patch_sizes(w.patch_glyphs()))
    raw = F.coalesce(F.sum(corpus.glyph_bytes(F.col("gid"))), F.lit(0))
    init = w.font().where(F.col("cp") <= corpus.INIT_MAX).agg(sz.estimate(F.count("*"), raw).alias("init_font"))
    whole = w.font().agg(sz.estimate(F.count("*"), raw).alias("whole_font"), F.count("*").alias("glyphs"))
    mass = w.seg_cp().groupBy("dataset").agg(F.sum("p").alias("mass"))
    rows = patches.join(mass, "dataset").crossJoin(F.broadcast(init)).crossJoin(F.broadcast(whole))
    return rows.select("dataset", F.round("cost", 6).alias("patches"), "init_font", "whole_font", F.round(F.col("mass") * (F.col("whole_font") / F.col("glyphs")), 6).alias("ideal"))


@query("f25_fallback_cost", sql("SELECT count(*)::BIGINT AS fallback_glyphs, sum(40 + (gid * 37) % 200)::BIGINT AS fallback_bytes, (SELECT sum(40 + (gid * 37) % 200) FROM font)::BIGINT AS all_bytes FROM font WHERE NOT EXISTS (SELECT 1 FROM glyphs g WHERE g.gid = font.gid AND g.condition_id % 2 = 0)", "font", "glyphs"))
def f25(spark, sf_dir):
    """Glyphs that no patch of an even condition holds, were only those built."""
    w = World(spark, sf_dir)
    size = corpus.glyph_bytes(F.col("gid"))
    rest = w.font().join(w.patch_glyphs().where("condition_id % 2 = 0"), "gid", "left_anti").agg(F.count("*").alias("fallback_glyphs"), F.sum(size).alias("fallback_bytes"))
    return rest.crossJoin(F.broadcast(w.font().agg(F.sum(size).alias("all_bytes"))))


@query("f25_fallback_cost_all_patches", sql("SELECT count(*)::BIGINT AS fallback_glyphs, coalesce(sum(40 + (gid * 37) % 200), 0)::BIGINT AS fallback_bytes, (SELECT sum(40 + (gid * 37) % 200) FROM font)::BIGINT AS all_bytes FROM font WHERE NOT EXISTS (SELECT 1 FROM glyphs g WHERE g.gid = font.gid)", "font", "glyphs"))
def f25_all(spark, sf_dir):
    """Glyphs that no patch of the segmentation holds, and their bytes."""
    w = World(spark, sf_dir)
    size = corpus.glyph_bytes(F.col("gid"))
    rest = w.font().join(w.patch_glyphs(), "gid", "left_anti").agg(F.count("*").alias("fallback_glyphs"), F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("fallback_bytes"))
    return rest.crossJoin(F.broadcast(w.font().agg(F.sum(size).alias("all_bytes"))))


@query("u3_fallback_glyphs", sql("SELECT count(*)::BIGINT AS n FROM font WHERE NOT EXISTS (SELECT 1 FROM glyphs g WHERE g.gid = font.gid)", "font", "glyphs"))
def u3(spark, sf_dir):
    w = World(spark, sf_dir)
    return w.font().join(w.patch_glyphs(), "gid", "left_anti").agg(F.count("*").alias("n"))


_MERGED_SIZE = "SELECT (condition_id // 2)::INT AS pair, (29 + floor((5 + count(*) * 2 + 4 + 4 * (count(*) + 1) + sum(40 + (gid * 37) % 200)) * 0.5::DOUBLE))::BIGINT AS merged FROM glyphs WHERE condition_id < 1000 GROUP BY 1"


@query("f26_size_reduction_histogram", sql("SELECT floor(100 * merged::DOUBLE / apart)::INT AS percent, count(*)::BIGINT AS n FROM ms JOIN (SELECT (condition_id // 2)::INT AS pair, sum(size) AS apart FROM sizes WHERE condition_id < 1000 GROUP BY 1) USING (pair) GROUP BY 1", "sizes", ms=_MERGED_SIZE))
def f26(spark, sf_dir):
    """Sizes of neighbouring patches merged, in percent of both apart."""
    w = World(spark, sf_dir)
    own = w.patch_glyphs().where("condition_id < 1000")
    pair = F.floor(F.col("condition_id") / 2).cast("int").alias("pair")
    merged = sz.patch_sizes(own.select(pair, "gid"), "pair").withColumnRenamed("size", "merged")
    apart = sz.patch_sizes(own).groupBy(pair).agg(F.sum("size").alias("apart"))
    return merged.join(apart, "pair").groupBy(F.floor(100 * F.col("merged") / F.col("apart")).cast("int").alias("percent")).agg(F.count("*").alias("n"))


@query("f27_cost_report", sql("SELECT coalesce(dataset, 'ALL') AS dataset, round(sum(p * (size + 75)), 6) AS cost, count(*)::BIGINT AS conditions FROM cp JOIN sizes USING (condition_id) GROUP BY ROLLUP (dataset)", "sizes", "seg_uni", "lit", cp=_COND_P))
def f27(spark, sf_dir):
    """Expected cost of each dataset and of all."""
    w = World(spark, sf_dir)
    p = pr.condition_probability(w.literals(), pr.any_of(w.seg_cp(), "dataset", "segment_id"))
    rows = p.join(sz.patch_sizes(w.patch_glyphs()), "condition_id")
    return rows.rollup("dataset").agg(F.round(F.sum(F.col("p") * (F.col("size") + corpus.OVERHEAD)), 6).alias("cost"), F.count("*").alias("conditions")).withColumn("dataset", F.coalesce("dataset", F.lit("ALL")))
