"""Closure of a dependency graph whose edges may need several nodes at once.

edges(edge_id, phase, dst) and needs(edge_id, group_no, node): an edge is open when each of its
groups has a reached node; a plain edge has one group with its source. Requests are closed all at
once: every row carries its request's id, so one join serves all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.iterate import fixpoint

#: Phases in their order: codepoints to glyphs, substitutions, components.
PHASES = (0, 1, 2)


def satisfied(reached: DataFrame, edges: DataFrame, needs: DataFrame) -> DataFrame:
    """(request, node) that open edges lead to: relational division over the edges' groups."""
    n = needs.groupBy("edge_id").agg(F.countDistinct("group_no").alias("n"))
    met = reached.join(needs, "node").select("request", "edge_id", "group_no").distinct()
    full = met.groupBy("request", "edge_id").agg(F.count("*").alias("k")).join(n, "edge_id").where("k = n")
    return full.join(edges.select("edge_id", "dst"), "edge_id").select("request", F.col("dst").alias("node"))


def closure(start: DataFrame, edges: DataFrame, needs: DataFrame, phases=PHASES) -> DataFrame:
    """start(request, node) with all that follows, one fixpoint a phase; later phases never feed earlier ones."""
    reached = start.select("request", "node")
    for phase in phases:
        own = edges.where(F.col("phase") == phase)
        own_needs = needs.join(own.select("edge_id"), "edge_id", "left_semi")
        reached = fixpoint(reached, lambda r, own=own, own_needs=own_needs: satisfied(r, own, own_needs))
    return reached


def backward(targets: DataFrame, edges: DataFrame, needs: DataFrame) -> DataFrame:
    """targets(request, node) with all that could lead to them, whatever else an edge needs."""
    arcs = needs.join(edges.select("edge_id", "dst"), "edge_id").select(F.col("node").alias("src"), "dst").distinct()
    return fixpoint(targets, lambda r: r.join(arcs, r["node"] == arcs["dst"]).select("request", F.col("src").alias("node")))


def arcs(edges: DataFrame, needs: DataFrame) -> DataFrame:
    """(src, dst): edges with all they need, flattened."""
    return needs.join(edges.select("edge_id", "dst"), "edge_id").select(F.col("node").alias("src"), "dst").distinct()


def strong_components(arcs: DataFrame) -> DataFrame:
    """(node, root): nodes that reach each other, by the smallest: forward reachability met with its reverse."""
    nodes = arcs.select(F.col("src").alias("node")).union(arcs.select("dst")).distinct()
    reach = fixpoint(nodes.select(F.col("node").alias("src"), F.col("node").alias("dst")), lambda r: r.select("src", F.col("dst").alias("mid")).join(arcs.select(F.col("src").alias("mid"), "dst"), "mid").select("src", "dst"))
    back = reach.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return reach.join(back, ["src", "dst"]).groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("root"))
