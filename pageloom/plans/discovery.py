"""Queries on condition discovery and grouping."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import cnf
from ..functions.iterate import labels, settle
from ..operators import discover as dc
from ..sources import corpus
from ..sources import depgraph as dg
from .algebra import _groups, _said
from .graphs import _INIT, ALL, INIT, SEG, WITHOUT, Graph
from .registry import query
from .sqltext import query as sql

_PARTS = dg.SQL | dg.sql_closure(ALL, "ca") | dg.sql_closure(WITHOUT, "cw") | dg.sql_closure(SEG, "cs") | dg.sql_closure(INIT, "ci")
_PARTS |= {
    "dd": "SELECT r.request AS segment_id, a.node FROM (SELECT DISTINCT request FROM cw) r, ca a WHERE a.node LIKE 'G%' EXCEPT SELECT request, node FROM cw",
    "ii": "SELECT request AS segment_id, node FROM cs WHERE node LIKE 'G%' AND node NOT IN (SELECT node FROM ci)",
    "an": "SELECT coalesce(d.segment_id, i.segment_id) AS segment_id, coalesce(d.node, i.node) AS node, CASE WHEN d.node IS NOT NULL AND i.node IS NOT NULL THEN 'exclusive' WHEN d.node IS NOT NULL THEN 'and' ELSE 'or' END AS kind FROM dd d FULL JOIN ii i ON d.segment_id = i.segment_id AND d.node = i.node",
    "orn": "SELECT node, list_sort(list(segment_id)) AS g FROM an GROUP BY node HAVING count(*) FILTER (WHERE kind <> 'or') = 0",
    "org": "SELECT row_number() OVER (ORDER BY g) AS request, g FROM (SELECT DISTINCT g FROM orn)",
}
_PARTS |= dg.sql_closure(f"SELECT request, 'U' || cp AS node FROM seg, org WHERE NOT list_contains(g, segment_id) UNION ALL {_INIT.format('SELECT request FROM org')}", "cx")
_PARTS |= {
    "xx": "SELECT n.node, g FROM orn n JOIN org USING (g) JOIN cx ON cx.request = org.request AND cx.node = n.node",
    "gc": "SELECT node, CASE WHEN count(*) FILTER (WHERE kind <> 'or') > 0 THEN list_sort(list([segment_id]) FILTER (WHERE kind <> 'or')) ELSE [list_sort(list(segment_id))] END AS groups FROM an WHERE node NOT IN (SELECT node FROM xx) GROUP BY node",
    "gg": "SELECT groups, array_to_string(list_sort(list(node)), ',') AS nodes FROM gc GROUP BY groups",
}


def dsql(final, **more):
    return sql(final, "font", "seg", **_PARTS, **more)


class Discovery(Graph):
    """Closures of all segments in four batches, written once, and one of what is outside each `or` group.

    Glyphs that these others bring too have additional conditions; they get none here, as the fallback has them.
    """

    def __init__(self, spark, sf_dir):
        super().__init__(spark, sf_dir)
        glyph = F.col("node").like("G%")
        self.full = settle(self.closed(self.everything()).where(glyph).select("node"))
        self.init = settle(self.closed(self.initial()).where(glyph).select("node"))
        self.without = settle(self.closed(self.without_segment()).where(glyph).select(F.col("request").alias("segment_id"), "node"))
        self.alone = settle(self.closed(self.by_segment()).where(glyph).select(F.col("request").alias("segment_id"), "node"))
        self.analysis = settle(dc.analyse(self.full, self.without, self.alone, self.init))
        either = settle(dc.or_groups(self.analysis))
        self.extra = settle(dc.additional(either, self.outside(either.select("segments").distinct())))
        self.glyphs = settle(dc.glyph_conditions(self.analysis).join(self.extra, "node", "left_anti"))

    def outside(self, groups):
        """(segments, node): the closure of all segments but those of each group."""
        named = settle(groups.select((F.row_number().over(W.orderBy("segments"))).alias("request"), "segments"))
        rest = named.join(F.broadcast(self.segments().select("segment_id", "cp")), ~F.array_contains("segments", F.col("segment_id")))
        start = rest.select("request", F.concat(F.lit("U"), F.col("cp")).alias("node")).unionByName(self._init(named.select("request")))
        return self.closed(start).join(named, "request").select("segments", "node")


@query("n1_analyse_segments", dsql("SELECT segment_id, node, kind FROM an"))
def n1(spark, sf_dir):
    return Discovery(spark, sf_dir).analysis


@query("n4_inert_analysis", dsql("SELECT segment_id, count(*) FILTER (WHERE kind <> 'exclusive')::BIGINT AS mixed, count(*) FILTER (WHERE kind = 'exclusive')::BIGINT AS own FROM an GROUP BY 1"))
def n4(spark, sf_dir):
    a = Discovery(spark, sf_dir).analysis
    return a.groupBy("segment_id").agg(F.count(F.when(F.col("kind") != "exclusive", 1)).alias("mixed"), F.count(F.when(F.col("kind") == "exclusive", 1)).alias("own"))


@query("n5_glyph_conditions", dsql(f"SELECT node, {_said('groups')} AS condition FROM gc"))
def n5(spark, sf_dir):
    return Discovery(spark, sf_dir).glyphs.select("node", _groups(F.col("groups")).alias("condition"))


@query("n7_edge_conditions", dsql("SELECT edge_id, array_to_string(list_sort(list(seg)), '&') AS condition FROM (SELECT edge_id, group_no, array_to_string(list_sort(list(DISTINCT segment_id)), '|') AS seg FROM needs JOIN an USING (node) WHERE kind = 'exclusive' GROUP BY 1, 2) GROUP BY 1"))
def n7(spark, sf_dir):
    """Edges' requirements as conditions over the segments that alone bring their glyphs."""
    d = Discovery(spark, sf_dir)
    own = d.analysis.where("kind = 'exclusive'")
    group = d.needs.join(own, "node").groupBy("edge_id", "group_no").agg(F.concat_ws("|", F.transform(F.array_sort(F.collect_set("segment_id")), lambda s: s.cast("string"))).alias("seg"))
    return group.groupBy("edge_id").agg(F.concat_ws("&", F.array_sort(F.collect_list("seg"))).alias("condition"))


@query("n10_inert_segments", dsql("SELECT DISTINCT segment_id FROM seg WHERE segment_id NOT IN (SELECT unnest(flatten(groups)) FROM gc WHERE len(groups) > 1 OR len(flatten(groups)) > 1)"))
def n10(spark, sf_dir):
    d = Discovery(spark, sf_dir)
    return dc.inert(d.glyphs, d.segments())


@query("n11_group_glyphs", dsql(f"SELECT {_said('groups')} AS condition, nodes FROM gg"))
def n11(spark, sf_dir):
    return dc.grouped(Discovery(spark, sf_dir).glyphs).select(_groups(F.col("groups")).alias("condition"), F.concat_ws(",", "nodes").alias("nodes"))


@query("n11_unmapped_glyphs", dsql("SELECT node FROM ca WHERE node LIKE 'G%' AND node NOT IN (SELECT node FROM ci) AND node NOT IN (SELECT node FROM gc)"))
def n11u(spark, sf_dir):
    d = Discovery(spark, sf_dir)
    return dc.unmapped(d.full, d.init, d.glyphs)


@query("n12_additional_conditions", dsql("SELECT node, array_to_string(g, '|') AS condition FROM xx"))
def n12(spark, sf_dir):
    """Glyphs of `or` groups that still appear without all segments of the group, with that group."""
    return Discovery(spark, sf_dir).extra.select("node", F.concat_ws("|", F.transform("segments", lambda x: x.cast("string"))).alias("condition"))


@query("n15_combined_patches", dsql("SELECT root, count(*)::BIGINT AS n FROM (SELECT g.node, min(h.node) AS root FROM gc g JOIN gc h ON list_has_any(flatten(g.groups), flatten(h.groups)) AND len(flatten(g.groups)) = 1 AND len(flatten(h.groups)) = 1 GROUP BY 1) GROUP BY 1"))
def n15(spark, sf_dir):
    """Glyphs of one-segment conditions joined by their segment, as patches that are merged."""
    d = Discovery(spark, sf_dir)
    one = settle(d.glyphs.where(F.size(F.flatten("groups")) == 1).select("node", F.element_at(F.flatten("groups"), 1).alias("s")))
    first = one.groupBy("s").agg(F.min("node").alias("b"))
    links = one.join(first, "s").select(F.col("node").alias("a"), "b")
    return labels(links).groupBy("root").agg(F.count("*").alias("n"))


@query("n17_unique_mapping", dsql("SELECT count(*)::BIGINT AS clashes FROM (SELECT node FROM gc GROUP BY node HAVING count(*) > 1)"))
def n17(spark, sf_dir):
    return Discovery(spark, sf_dir).glyphs.groupBy("node").agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias("clashes"))


@query("n19_pure_conditions", dsql("SELECT node, " + _said("CASE WHEN len(groups) <= 1 OR len(list_filter(groups, lambda g: len(g) <> 1)) = 0 THEN groups ELSE list_filter(groups, lambda g: len(g) = 1) END") + " AS condition, len(groups) = 1 AND len(groups[1]) = 1 AS exclusive FROM gc"))
def n19(spark, sf_dir):
    g = F.col("groups")
    return Discovery(spark, sf_dir).glyphs.select("node", _groups(cnf.pure_superset(g)).alias("condition"), cnf.is_unitary(g).alias("exclusive"))


@query("n20_patch_ids", dsql(f"SELECT (row_number() OVER (ORDER BY len(groups), list_transform(groups, lambda g: {{'n': len(g), 'g': g}})) - 1)::INT AS patch_id, {_said('groups')} AS condition FROM gg"))
def n20(spark, sf_dir):
    g = dc.grouped(Discovery(spark, sf_dir).glyphs)
    return g.select((F.row_number().over(W.orderBy(cnf.sort_key(F.col("groups")))) - 1).alias("patch_id"), _groups(F.col("groups")).alias("condition"))


@query(
    "n21_validate",
    dsql(
        "SELECT (SELECT count(*) FROM gc WHERE node IN (SELECT node FROM ci))::BIGINT AS in_init, (SELECT count(*) FROM (SELECT node FROM gc GROUP BY 1 HAVING count(*) > 1))::BIGINT AS twice, (SELECT count(*) FROM ca WHERE node LIKE 'G%' AND node NOT IN (SELECT node FROM ci) AND node NOT IN (SELECT node FROM gc))::BIGINT AS missing"
    ),
)
def n21(spark, sf_dir):
    """Glyphs of patches that are initial, in two patches, or missing: none, for a valid segmentation; missing ones go to the fallback patch."""
    d = Discovery(spark, sf_dir)
    count = F.count("*")
    a = d.glyphs.join(d.init, "node", "left_semi").agg(count.alias("in_init"))
    b = d.glyphs.groupBy("node").agg(count.alias("n")).where("n > 1").agg(count.alias("twice"))
    return a.crossJoin(b).crossJoin(dc.unmapped(d.full, d.init, d.glyphs).agg(count.alias("missing")))


@query("n23_table_keyed_segments", sql("SELECT dataset, array_to_string(list_sort(list(DISTINCT cp)), ',') AS cps FROM page_cp WHERE cp > 32 GROUP BY 1", "page_cp"))
def n23(spark, sf_dir):
    """Each merge group's codepoints less the initial ones."""
    p = corpus.page_codepoints(corpus.pages(spark, sf_dir)).where(F.col("cp") > corpus.INIT_MAX)
    return p.groupBy("dataset").agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_set("cp")), lambda c: c.cast("string"))).alias("cps"))


@query("k4_segmentation_text", dsql(f"SELECT 'p' || (row_number() OVER (ORDER BY len(groups), list_transform(groups, lambda g: {{'n': len(g), 'g': g}})) - 1) || ': {{ ' || replace(nodes, ',', ', ') || ' }}' AS line FROM gg"))
def k4(spark, sf_dir):
    g = dc.grouped(Discovery(spark, sf_dir).glyphs)
    no = (F.row_number().over(W.orderBy(cnf.sort_key(F.col("groups")))) - 1).cast("string")
    return g.select(F.concat(F.lit("p"), no, F.lit(": { "), F.concat_ws(", ", "nodes"), F.lit(" }")).alias("line"))


@query("u1_trace_plan", dsql("SELECT DISTINCT unnest(flatten(c.groups)) AS segment_id FROM gc g JOIN gc c ON g.groups = c.groups WHERE g.node IN ('G101', 'G5003')"))
def u1(spark, sf_dir):
    """From glyphs to their patches' conditions to all segments of those."""
    d = Discovery(spark, sf_dir)
    hit = d.glyphs.where("node in ('G101', 'G5003')").select("groups").distinct()
    return d.glyphs.join(hit, "groups", "left_semi").select(F.explode(F.flatten("groups")).alias("segment_id")).distinct()


@query("u5_closure_requirement", dsql("SELECT count(*)::BIGINT AS missing FROM (SELECT s.request, s.node FROM cs s WHERE s.node LIKE 'G%' AND s.node NOT IN (SELECT node FROM ci) AND NOT EXISTS (SELECT 1 FROM gc WHERE gc.node = s.node AND len(list_filter(gc.groups, lambda g: NOT list_contains(g, s.request))) = 0) AND s.node IN (SELECT node FROM gc))"))
def u5(spark, sf_dir):
    """Glyphs in a segment's own closure whose condition the segment alone doesn't meet: what the fallback must cover."""
    d = Discovery(spark, sf_dir)
    need = d.alone.join(d.init, "node", "left_anti").join(d.glyphs, "node")
    return need.where(~F.forall("groups", lambda g: F.array_contains(g, F.col("segment_id")))).agg(F.count("*").alias("missing"))
