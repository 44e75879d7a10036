"""Queries on the patch graph and codecs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import codec
from ..operators import patches as pt
from ..sources import corpus
from .registry import query
from .sqltext import query as sql
from .statistics import World


def _subsets(spark, sf_dir):
    """(i): one subset a dataset, by name."""
    from pyspark.sql import Window as W

    return corpus.pages(spark, sf_dir).select("dataset").distinct().select((F.row_number().over(W.orderBy("dataset")) - 1).alias("i"))


_SUB = "SELECT (row_number() OVER (ORDER BY dataset) - 1)::INT AS i FROM (SELECT DISTINCT dataset FROM pages)"
_COMBO = "SELECT [i] AS combo FROM sub UNION ALL SELECT [a.i, b.i] FROM sub a JOIN sub b ON a.i < b.i"
_NODES = "SELECT []::INT[] AS node UNION SELECT list_sort(list_concat(node, combo)) FROM nodes, combo WHERE NOT list_has_any(node, combo)"


def _csv(c):
    return F.concat_ws(",", F.transform(c, lambda x: x.cast("string")))


@query("p1_combinations", sql("SELECT array_to_string([a.i, b.i, c.i], ',') AS combo FROM sub a JOIN sub b ON a.i < b.i JOIN sub c ON b.i < c.i", "pages", sub=_SUB))
def p1(spark, sf_dir):
    return pt.combinations(_subsets(spark, sf_dir), 3).select(_csv("combo").alias("combo"))


@query("p2_outgoing_edges", sql("SELECT array_to_string(combo, ',') AS combo FROM combo WHERE NOT list_has_any(combo, [1])", "pages", sub=_SUB, combo=_COMBO))
def p2(spark, sf_dir):
    """From the node that has subset 1, edges of one or two others."""
    return pt.up_to(_subsets(spark, sf_dir), 2).where(~F.array_contains("combo", 1)).select(_csv("combo").alias("combo"))


@query("p3_jumps", sql("SELECT dataset, (row_number() OVER (PARTITION BY dataset ORDER BY ord) - 1)::INT AS jump_no, n FROM (SELECT dataset, ord, n, lag(n) OVER (PARTITION BY dataset ORDER BY ord) AS before FROM (SELECT x.dataset, x.k AS ord, count(DISTINCT y.cp)::INT AS n FROM (SELECT DISTINCT dataset, cp // 64 AS k FROM page_cp) x JOIN (SELECT DISTINCT dataset, cp, cp // 64 AS k FROM page_cp) y ON x.dataset = y.dataset AND y.k <= x.k GROUP BY 1, 2)) WHERE before IS NULL OR n > before", "page_cp"))
def p3(spark, sf_dir):
    """Each dataset's codepoints loaded by blocks of 64: sizes of the growing unions."""
    p = corpus.page_codepoints(corpus.pages(spark, sf_dir)).select("dataset", "cp").distinct()
    edge = p.groupBy(F.col("dataset").alias("edge_id"), F.floor(F.col("cp") / 64).alias("ord")).agg(F.array_sort(F.collect_list("cp")).alias("items"))
    return pt.jumps(edge).select(F.col("edge_id").alias("dataset"), "jump_no", F.size("held").alias("n"))


@query("p4_compile_graph", sql("SELECT DISTINCT array_to_string(node, ',') AS start, array_to_string(list_sort(list_concat(node, combo)), ',') AS finish FROM nodes, combo WHERE NOT list_has_any(node, combo)", "pages", sub=_SUB, combo=_COMBO, nodes=_NODES))
def p4(spark, sf_dir):
    _, edges = pt.compile_graph(_subsets(spark, sf_dir), 2)
    return edges.select(_csv("start").alias("start"), _csv("finish").alias("finish"))


@query("l2_graph_nodes", sql("SELECT array_to_string(node, ',') AS node FROM nodes", "pages", sub=_SUB, combo=_COMBO, nodes=_NODES))
def l2(spark, sf_dir):
    nodes, _ = pt.compile_graph(_subsets(spark, sf_dir), 2)
    return nodes.select(_csv("node").alias("node"))


@query("p5_edge_conditions", sql("SELECT array_to_string(list_transform(combo, lambda s: 's' || s), ' AND ') AS condition FROM combo", "pages", sub=_SUB, combo=_COMBO))
def p5(spark, sf_dir):
    return pt.up_to(_subsets(spark, sf_dir), 2).select(F.array_join(F.transform("combo", lambda s: F.concat(F.lit("s"), s.cast("string"))), " AND ").alias("condition"))


@query("p6_entry_nodes", sql("SELECT DISTINCT 'segment ' || segment_id AS node FROM lit UNION SELECT DISTINCT 'any ' || array_to_string(list_sort(g), ',') FROM grp WHERE len(g) > 1 UNION SELECT 'condition ' || condition_id FROM cond WHERE len(groups) > 1", "lit", "grp"))
def p6(spark, sf_dir):
    """Shared nodes of the entry graph: segments, disjunctions, conjunctions."""
    c = World(spark, sf_dir).conditions()
    groups = c.select(F.explode("groups").alias("g"))
    a = groups.select(F.explode("g").alias("s")).select(F.concat(F.lit("segment "), F.col("s").cast("string")).alias("node"))
    b = groups.where(F.size("g") > 1).select(F.concat(F.lit("any "), _csv(F.array_sort("g"))).alias("node"))
    d = c.where(F.size("groups") > 1).select(F.concat(F.lit("condition "), F.col("condition_id").cast("string")).alias("node"))
    return a.union(b).union(d).distinct()


@query("p7_child_chains", "SELECT parent, part, count(*)::BIGINT AS n FROM (SELECT parent, idx, CASE WHEN n <= 127 THEN 0 ELSE least(idx // 126, (n - 2) // 126) END::INT AS part FROM (SELECT n AS parent, n, unnest(range(n)) AS idx FROM (SELECT unnest([5, 127, 128, 253, 400]) AS n))) GROUP BY 1, 2")
def p7(spark, sf_dir):
    sizes = spark.createDataFrame([(n,) for n in (5, 127, 128, 253, 400)], "parent int")
    kids = sizes.select("parent", F.explode(F.sequence(F.lit(0), F.col("parent") - 1)).alias("idx"))
    return pt.child_chain(kids).groupBy("parent", "part").agg(F.count("*").alias("n"))


_ENTRY_ARCS = "SELECT 'c' || condition_id AS src, 's' || segment_id AS dst FROM lit"


@query("p8_topological_levels", sql("SELECT DISTINCT src AS node, 0 AS level FROM arcs UNION ALL SELECT DISTINCT dst, 1 FROM arcs", "lit", arcs=_ENTRY_ARCS))
def p8(spark, sf_dir):
    """Conditions stand above the segments that they name."""
    lit = World(spark, sf_dir).literals()
    arcs = lit.select(F.concat(F.lit("c"), F.col("condition_id").cast("string")).alias("src"), F.concat(F.lit("s"), F.col("segment_id").cast("string")).alias("dst"))
    return pt.levels(arcs)


@query("p10_entry_order", sql("SELECT node, (row_number() OVER (ORDER BY level DESC, node) - 1)::INT AS entry FROM (SELECT DISTINCT src AS node, 0 AS level FROM arcs UNION ALL SELECT DISTINCT dst, 1 FROM arcs)", "lit", arcs=_ENTRY_ARCS))
def p10(spark, sf_dir):
    """Entries, children before parents."""
    from pyspark.sql import Window as W

    return p8(spark, sf_dir).select("node", (F.row_number().over(W.orderBy(F.desc("level"), "node")) - 1).alias("entry"))


@query("p11_child_order_check", sql("SELECT count(*)::BIGINT AS wrong FROM arcs JOIN o a ON a.node = src JOIN o b ON b.node = dst WHERE b.entry >= a.entry", "lit", arcs=_ENTRY_ARCS, o="SELECT node, row_number() OVER (ORDER BY level DESC, node) AS entry FROM (SELECT DISTINCT src AS node, 0 AS level FROM arcs UNION ALL SELECT DISTINCT dst, 1 FROM arcs)"))
def p11(spark, sf_dir):
    """Children that don't come before their parents."""
    o = p10(spark, sf_dir)
    lit = World(spark, sf_dir).literals()
    arcs = lit.select(F.concat(F.lit("c"), F.col("condition_id").cast("string")).alias("src"), F.concat(F.lit("s"), F.col("segment_id").cast("string")).alias("dst"))
    a, b = (o.select(F.col("node").alias(n), F.col("entry").alias(f"{n}_entry")) for n in ("src", "dst"))
    return arcs.join(a, "src").join(b, "dst").where("dst_entry >= src_entry").agg(F.count("*").alias("wrong"))


@query("p12_plan_checks", sql("SELECT (SELECT count(*) FROM glyphs WHERE gid > 16777215)::BIGINT AS gid_range, (SELECT count(*) FROM (SELECT condition_id FROM cond GROUP BY 1 HAVING count(*) > 1))::BIGINT AS twice, (SELECT count(*) FROM glyphs WHERE condition_id NOT IN (SELECT condition_id FROM cond))::BIGINT AS unknown", "glyphs"))
def p12(spark, sf_dir):
    w = World(spark, sf_dir)
    g, c = w.patch_glyphs(), w.conditions()
    a = g.where("gid > 16777215").agg(F.count("*").alias("gid_range"))
    b = c.groupBy("condition_id").agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias("twice"))
    return a.crossJoin(b).crossJoin(g.join(c, "condition_id", "left_anti").agg(F.count("*").alias("unknown")))


@query("p14_patch_sets", sql("SELECT condition_id, axis FROM cond CROSS JOIN (SELECT unnest(['wght', 'wdth']) AS axis)", "cond"))
def p14(spark, sf_dir):
    """One set of patches a design space."""
    axes = spark.createDataFrame([("wght",), ("wdth",)], "axis string")
    return World(spark, sf_dir).conditions().select("condition_id").crossJoin(F.broadcast(axes))


@query("e7_table_diff", sql("SELECT coalesce(a.cp, b.cp)::VARCHAR AS tag, CASE WHEN a.cp IS NULL THEN 'new' WHEN b.cp IS NULL THEN 'removed' WHEN a.n <> b.n THEN 'replaced' ELSE 'unchanged' END AS change FROM (SELECT cp1 AS cp, n FROM single WHERE dataset = 'de') a FULL JOIN (SELECT cp1 AS cp, n FROM single WHERE dataset = 'fr') b ON a.cp = b.cp", "single"))
def e7(spark, sf_dir):
    """Two datasets as builds, codepoints as table tags and page counts as contents."""
    s = World(spark, sf_dir).single().select("dataset", F.col("cp1").cast("string").alias("tag"), F.col("n").alias("digest"))
    return pt.table_diff(s.where("dataset = 'de'").drop("dataset"), s.where("dataset = 'fr'").drop("dataset"))


@F.pandas_udf(T.BinaryType())
def encode_set(values: pd.Series) -> pd.Series:
    return values.map(lambda v: codec.encode_set([int(x) for x in v]))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def decode_set(data: pd.Series) -> pd.Series:
    return data.map(lambda b: codec.decode_set(b)[0])


@query("e1_sparse_bit_sets", sql("SELECT page, array_to_string(cps, ',') AS cps FROM pages", "pages"))
def e1(spark, sf_dir):
    """Every page's codepoints, encoded and decoded again."""
    return corpus.pages(spark, sf_dir).select("page", _csv(decode_set(encode_set("cps"))).alias("cps"))


_TEMPLATE = bytes([4]) + b"//x/" + bytes([133])


@F.pandas_udf(T.StringType())
def patch_url(number: pd.Series) -> pd.Series:
    return number.map(lambda n: codec.patch_url(_TEMPLATE, int(n)))


@query("e5_patch_urls", sql("SELECT condition_id, '//x/' || replace(replace(replace(base64(CASE WHEN condition_id < 256 THEN unhex(format('{:02x}', condition_id)) ELSE unhex(format('{:04x}', condition_id)) END), '+', '-'), '/', '_'), '=', '%3D') AS url FROM cond", "cond"))
def e5(spark, sf_dir):
    return World(spark, sf_dir).conditions().select("condition_id", patch_url("condition_id").alias("url"))


@F.pandas_udf(T.BinaryType())
def map_entry(cps: pd.Series) -> pd.Series:
    return cps.map(lambda v: codec.entry(0, codepoints=[int(x) for x in v], numbers=[1]))


@query("e3_patch_map_entries")
def e3(spark, sf_dir):
    """Each segment's entry of a patch map, as bytes in hex."""
    s = World(spark, sf_dir).segments().groupBy("segment_id").agg(F.array_sort(F.collect_list("cp")).alias("cps"))
    return s.select("segment_id", F.hex(map_entry("cps")).alias("entry"))


@query("e6_glyph_stream", sql("SELECT condition_id, (5 + count(*) * 2 + 4 + 4 * (count(*) + 1) + sum(40 + (gid * 37) % 200))::BIGINT AS nbytes, array_to_string(list_sort(list(gid)), ',') AS gids FROM glyphs GROUP BY 1", "glyphs"))
def e6(spark, sf_dir):
    """Layout of each patch's uncompressed stream: its length and glyphs."""
    g = World(spark, sf_dir).patch_glyphs()
    n = F.count("*")
    return g.groupBy("condition_id").agg((5 + n * 2 + 4 + 4 * (n + 1) + F.sum(corpus.glyph_bytes(F.col("gid")))).alias("nbytes"), _csv(F.array_sort(F.collect_list("gid"))).alias("gids"))
