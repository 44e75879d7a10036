"""Queries on closures and reachability in the dependency graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.iterate import labels, settle
from ..operators import graph as gr
from ..sources import depgraph as dg
from .registry import query
from .sqltext import query as sql
from .statistics import World


class Graph(World):
    def __init__(self, spark, sf_dir):
        super().__init__(spark, sf_dir)
        f = settle(self.font())
        self._font = f
        e, n = dg.edges(f)
        self.edges, self.needs = settle(e), settle(n)

    def closed(self, start, phases=gr.PHASES):
        return gr.closure(start, self.edges, self.needs, phases)

    def by_segment(self):
        """(request, node): each segment's codepoints with the initial ones."""
        seg = self.segments().select(F.col("segment_id").alias("request"), F.concat(F.lit("U"), F.col("cp")).alias("node"))
        return seg.unionByName(self._init(seg.select("request").distinct()))

    def without_segment(self):
        """(request, node): all codepoints but each segment's."""
        seg = self.segments()
        each = seg.select(F.col("segment_id").alias("request")).distinct()
        rest = each.crossJoin(F.broadcast(seg.select("segment_id", "cp"))).where("request <> segment_id")
        return rest.select("request", F.concat(F.lit("U"), F.col("cp")).alias("node")).unionByName(self._init(each))

    def everything(self):
        return self._font.select(F.lit(-1).alias("request"), F.concat(F.lit("U"), F.col("cp")).alias("node"))

    def initial(self):
        return self._init(self.spark.createDataFrame([(-2,)], "request int"))

    def _init(self, requests):
        init = self._font.where("cp <= 32").select(F.concat(F.lit("U"), F.col("cp")).alias("node"))
        return requests.crossJoin(F.broadcast(init)).select("request", "node")


_INIT = "SELECT r.request, 'U' || cp AS node FROM font, ({}) r WHERE cp <= 32"
_EACH = "SELECT DISTINCT segment_id AS request FROM seg"
SEG = "SELECT segment_id AS request, 'U' || cp AS node FROM seg UNION ALL " + _INIT.format(_EACH)
WITHOUT = "SELECT r.request, 'U' || cp AS node FROM seg, (" + _EACH + ") r WHERE r.request <> segment_id UNION ALL " + _INIT.format(_EACH)
ALL = "SELECT -1 AS request, 'U' || cp AS node FROM font"
INIT = _INIT.format("SELECT -2 AS request")


def gsql(final, start=None, rounds=4, phases=(0, 1, 2), **more):
    parts = dict(dg.SQL)
    if start:
        parts |= dg.sql_closure(start, rounds=rounds, phases=phases)
    return sql(final, "font", "seg", **parts, **more)


@query("g1_unicode_closure", gsql("SELECT request, node FROM c WHERE node LIKE 'U%'", SEG, phases=(0,)))
def g1(spark, sf_dir):
    g = Graph(spark, sf_dir)
    return g.closed(g.by_segment(), (0,)).where("node like 'U%'")


@query("g2_glyph_closure", gsql("SELECT request, node FROM c WHERE node LIKE 'G%'", SEG))
def g2(spark, sf_dir):
    g = Graph(spark, sf_dir)
    return g.closed(g.by_segment()).where("node like 'G%'")


_FEAT = SEG + " UNION ALL SELECT request, 'Fsmcp' FROM (" + _EACH + ")"


@query("g3_closure_with_features", gsql("SELECT request, node FROM c", _FEAT))
def g3(spark, sf_dir):
    """Closure by phases, with a layout feature asked for."""
    g = Graph(spark, sf_dir)
    start = g.by_segment()
    return g.closed(start.unionByName(start.select("request", F.lit("Fsmcp").alias("node")).distinct()))


@query("g4_pending_edges", gsql("SELECT request, edge_id, (len(e.groups) - count(DISTINCT group_no))::BIGINT AS open FROM c JOIN needs n USING (node) JOIN every e USING (edge_id) GROUP BY request, edge_id, e.groups HAVING count(DISTINCT group_no) < len(e.groups)", SEG))
def g4(spark, sf_dir):
    """Edges that a closure touched without meeting all their groups."""
    g = Graph(spark, sf_dir)
    met = g.closed(g.by_segment()).join(g.needs, "node").select("request", "edge_id", "group_no").distinct().groupBy("request", "edge_id").agg(F.count("*").alias("k"))
    n = g.needs.groupBy("edge_id").agg(F.countDistinct("group_no").alias("n"))
    return met.join(n, "edge_id").where("k < n").select("request", "edge_id", (F.col("n") - F.col("k")).alias("open"))


@query("g5_constraints_satisfied", gsql("SELECT request, edge_id FROM c JOIN needs n USING (node) JOIN every e USING (edge_id) GROUP BY request, edge_id, e.groups HAVING count(DISTINCT group_no) = len(e.groups)", SEG))
def g5(spark, sf_dir):
    g = Graph(spark, sf_dir)
    met = g.closed(g.by_segment()).join(g.needs, "node").select("request", "edge_id", "group_no").distinct().groupBy("request", "edge_id").agg(F.count("*").alias("k"))
    n = g.needs.groupBy("edge_id").agg(F.countDistinct("group_no").alias("n"))
    return met.join(n, "edge_id").where("k = n").select("request", "edge_id")


@query("g6_filtered_closure", gsql("SELECT request, node FROM c", SEG, phases=(0, 2)))
def g6(spark, sf_dir):
    """Only codepoint and component edges are followed."""
    g = Graph(spark, sf_dir)
    return g.closed(g.by_segment(), (0, 2))


@query("g7_outgoing_codepoint_edges", gsql("SELECT src, dst FROM arcs WHERE src LIKE 'U%'"))
def g7(spark, sf_dir):
    g = Graph(spark, sf_dir)
    return gr.arcs(g.edges, g.needs).where("src like 'U%'")


@query("g8_outgoing_glyph_edges", gsql("SELECT src, dst FROM arcs WHERE src NOT LIKE 'U%'"))
def g8(spark, sf_dir):
    g = Graph(spark, sf_dir)
    return gr.arcs(g.edges, g.needs).where("src not like 'U%'")


@query("g9_context_edges", gsql("SELECT edge_id, n.node, dst FROM needs n JOIN every USING (edge_id) WHERE len(groups) > 1 AND n.group_no > 0"))
def g9(spark, sf_dir):
    """Each further requirement of an edge leads to its destination too."""
    g = Graph(spark, sf_dir)
    return g.needs.where("group_no > 0").join(g.edges, "edge_id").select("edge_id", "node", "dst")


@query("g10_requirements", gsql("SELECT edge_id, array_to_string(list_sort(list_transform(groups, lambda x: array_to_string(list_sort(x), '|'))), '&') AS req FROM every"))
def g10(spark, sf_dir):
    g = Graph(spark, sf_dir)
    each = g.needs.groupBy("edge_id", "group_no").agg(F.concat_ws("|", F.array_sort(F.collect_set("node"))).alias("g"))
    return each.groupBy("edge_id").agg(F.concat_ws("&", F.array_sort(F.collect_list("g"))).alias("req"))


@query("g11_required_glyphs", gsql("SELECT edge_id, count(DISTINCT node)::BIGINT AS n FROM needs WHERE node LIKE 'G%' GROUP BY 1"))
def g11(spark, sf_dir):
    return Graph(spark, sf_dir).needs.where("node like 'G%'").groupBy("edge_id").agg(F.countDistinct("node").alias("n"))


@query("g12_incoming_edges", gsql("SELECT dst, array_to_string(list_sort(list(DISTINCT req)), ';') AS reqs FROM (SELECT dst, array_to_string(list_sort(list_transform(groups, lambda x: array_to_string(list_sort(x), '|'))), '&') AS req FROM every) GROUP BY 1"))
def g12(spark, sf_dir):
    g = Graph(spark, sf_dir)
    each = g.needs.groupBy("edge_id", "group_no").agg(F.concat_ws("|", F.array_sort(F.collect_set("node"))).alias("g"))
    req = each.groupBy("edge_id").agg(F.concat_ws("&", F.array_sort(F.collect_list("g"))).alias("req"))
    return req.join(g.edges, "edge_id").groupBy("dst").agg(F.concat_ws(";", F.array_sort(F.collect_set("req"))).alias("reqs"))


_REACH = "SELECT src, src AS dst FROM (SELECT src FROM arcs UNION SELECT dst FROM arcs) UNION SELECT r.src, a.dst FROM reach r JOIN arcs a ON a.src = r.dst"


@query("g13_strong_components", gsql("SELECT x.src AS node, min(x.dst) AS root FROM reach x JOIN reach y ON x.src = y.dst AND x.dst = y.src GROUP BY 1", reach=_REACH))
def g13(spark, sf_dir):
    g = Graph(spark, sf_dir)
    return gr.strong_components(settle(gr.arcs(g.edges, g.needs)))


@query("g14_all_nodes", gsql("SELECT src AS node FROM arcs UNION SELECT dst FROM arcs"))
def g14(spark, sf_dir):
    g = Graph(spark, sf_dir)
    a = gr.arcs(g.edges, g.needs)
    return a.select(F.col("src").alias("node")).union(a.select("dst")).distinct()


@query("g15_traversal_summary", gsql("SELECT request, count(*) FILTER (WHERE node LIKE 'U%')::BIGINT AS codepoints, count(*) FILTER (WHERE node LIKE 'G%')::BIGINT AS glyphs FROM c GROUP BY 1", SEG))
def g15(spark, sf_dir):
    g = Graph(spark, sf_dir)
    return g.closed(g.by_segment()).groupBy("request").agg(F.count(F.when(F.col("node").like("U%"), 1)).alias("codepoints"), F.count(F.when(F.col("node").like("G%"), 1)).alias("glyphs"))


_BACK = "SELECT DISTINCT request, 'U' || g.gcp AS node FROM (SELECT request, try_cast(node[2:] AS INT) AS gcp FROM c WHERE node LIKE 'G%') g JOIN font ON font.cp = g.gcp UNION SELECT request, node FROM c"


@query("g16_expand_closure", gsql("SELECT request, node FROM d", SEG, back=_BACK, **dg.sql_closure("SELECT * FROM back", name="d")))
def g16(spark, sf_dir):
    """Glyph closure, the glyphs' codepoints, and so on until both are stable."""
    g = Graph(spark, sf_dir)
    known, n = g.closed(g.by_segment()), -1
    names = g.font().select(F.concat(F.lit("G"), F.col("cp")).alias("node"), F.concat(F.lit("U"), F.col("cp")).alias("u"))
    while (size := known.count()) != n:
        n = size
        known = g.closed(known.unionByName(known.join(names, "node").select("request", F.col("u").alias("node"))))
    return known


@query("g17_codepoints_for_glyphs", gsql("SELECT DISTINCT request, font.cp FROM c JOIN font ON c.node = 'G' || font.cp", SEG))
def g17(spark, sf_dir):
    g = Graph(spark, sf_dir)
    names = g.font().select(F.concat(F.lit("G"), F.col("cp")).alias("node"), "cp")
    return g.closed(g.by_segment()).join(names, "node").select("request", "cp").distinct()


@query("g18_segment_closure", gsql("SELECT request, count(*)::BIGINT AS n FROM c GROUP BY 1", SEG))
def g18(spark, sf_dir):
    g = Graph(spark, sf_dir)
    return g.closed(g.by_segment()).groupBy("request").agg(F.count("*").alias("n"))


@query("g19_except_segment", gsql("SELECT request, count(*)::BIGINT AS n FROM c GROUP BY 1", WITHOUT))
def g19(spark, sf_dir):
    g = Graph(spark, sf_dir)
    return g.closed(g.without_segment()).groupBy("request").agg(F.count("*").alias("n"))


@query("g20_additional_conditions", gsql("SELECT x.request, count(*)::BIGINT AS still FROM c x JOIN d y ON x.request = y.request AND x.node = y.node WHERE x.node LIKE 'G%' GROUP BY 1", SEG, **dg.sql_closure(WITHOUT, name="d")))
def g20(spark, sf_dir):
    """Glyphs of a segment's closure that appear without the segment too."""
    g = Graph(spark, sf_dir)
    own = g.closed(g.by_segment()).where("node like 'G%'")
    return own.join(g.closed(g.without_segment()), ["request", "node"], "left_semi").groupBy("request").agg(F.count("*").alias("still"))


_TO = "SELECT node AS target, node FROM (VALUES ('G5004'), ('G5010'), ('G101')) t(node) UNION SELECT b.target, a.src FROM back b JOIN arcs a ON a.dst = b.node"


@query("g21_interacting_segments", gsql("SELECT DISTINCT target AS request, segment_id FROM back JOIN seg ON node = 'U' || cp", back=_TO))
def g21(spark, sf_dir):
    """Segments from which some glyphs can be reached, whatever else an edge needs."""
    g = Graph(spark, sf_dir)
    targets = spark.createDataFrame([(x, x) for x in ("G5004", "G5010", "G101")], "request string, node string")
    names = g.segments().select("segment_id", F.concat(F.lit("U"), F.col("cp")).alias("node"))
    return gr.backward(targets, g.edges, g.needs).join(names, "node").select("request", "segment_id").distinct()


@query("g22_reachable_beyond_init", gsql("SELECT request, node FROM c EXCEPT SELECT request, node FROM (SELECT r.request, i.node FROM (SELECT DISTINCT segment_id AS request FROM seg) r, d i)", SEG, **dg.sql_closure(INIT, name="d")))
def g22(spark, sf_dir):
    g = Graph(spark, sf_dir)
    return g.closed(g.by_segment()).join(g.closed(g.initial()).select("node"), "node", "left_anti").select("request", "node")


_COMP = "SELECT node, node AS m FROM (SELECT src AS node FROM gg UNION SELECT dst FROM gg) UNION SELECT r.node, a.dst FROM cc r JOIN gg a ON a.src = r.m"


@query("g23_glyph_partition", gsql("SELECT node AS id, min(m) AS root FROM cc GROUP BY 1", gg="SELECT src, dst FROM arcs WHERE src LIKE 'G%' UNION SELECT dst, src FROM arcs WHERE src LIKE 'G%'", cc=_COMP))
def g23(spark, sf_dir):
    """Glyphs joined by any edge, as a union-find would join them."""
    g = Graph(spark, sf_dir)
    return labels(gr.arcs(g.edges, g.needs).where("src like 'G%'").select(F.col("src").alias("a"), F.col("dst").alias("b")))


@query("s9_decomposition_edges", gsql("SELECT edge_id, dst FROM okay WHERE phase = 0"))
def s9(spark, sf_dir):
    return Graph(spark, sf_dir).edges.where("phase = 0 and edge_id >= 100000").select("edge_id", "dst")
