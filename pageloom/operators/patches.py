"""The patch graph: what can be loaded after what, and the order of entries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.iterate import settle

CHILDREN = 127  # of an entry, at most


def combinations(items: DataFrame, k: int, key: str = "i") -> DataFrame:
    """items(i) -> (combo array): all k-combinations in order, by growing each by a later item."""
    grown = items.select(F.array(key).alias("combo"))
    for _ in range(k - 1):
        grown = grown.join(items, F.element_at("combo", -1) < F.col(key)).select(F.concat("combo", F.array(key)).alias("combo"))
    return grown


def up_to(items: DataFrame, most: int) -> DataFrame:
    out = combinations(items, 1)
    for k in range(2, most + 1):
        out = out.unionByName(combinations(items, k))
    return out


def compile_graph(subsets: DataFrame, jump: int, rounds: int = 20) -> tuple[DataFrame, DataFrame]:
    """Nodes are sets of loaded subsets, from none; edges load up to `jump` missing ones. (nodes(node), edges(start, finish)).

    Breadth first: each round extends what the last one found, by a join with all combinations.
    """
    combos = settle(up_to(subsets, jump))
    frontier = settle(subsets.sparkSession.createDataFrame([([],)], "node array<int>"))
    nodes, edges = frontier, None
    for _ in range(rounds):
        step = frontier.join(combos, ~F.arrays_overlap("node", "combo")).select(F.col("node").alias("start"), F.array_sort(F.array_union("node", "combo")).alias("finish"))
        step = settle(step.distinct())
        if step.isEmpty():
            return nodes, edges
        edges = step if edges is None else settle(edges.unionByName(step).distinct())
        frontier = settle(step.select(F.col("finish").alias("node")).distinct().join(nodes, "node", "left_anti"))
        nodes = settle(nodes.unionByName(frontier))
        if frontier.isEmpty():
            return nodes, edges
    raise RuntimeError(f"the graph is deeper than {rounds}")


def jumps(edge: DataFrame) -> DataFrame:
    """edge(edge_id, ord, items) -> (edge_id, jump_no, held): a chain of growing unions, without steps that add nothing."""
    by = W.partitionBy("edge_id").orderBy("ord").rowsBetween(W.unboundedPreceding, 0)
    grown = edge.withColumn("held", F.array_sort(F.array_distinct(F.flatten(F.collect_list("items").over(by)))))
    before = F.lag("held").over(W.partitionBy("edge_id").orderBy("ord"))
    new = grown.withColumn("last", before).where(F.col("last").isNull() | (F.size("held") > F.size("last")))
    return new.select("edge_id", (F.row_number().over(W.partitionBy("edge_id").orderBy("ord")) - 1).alias("jump_no"), "held")


def child_chain(children: DataFrame) -> DataFrame:
    """children(parent, idx) with part: an entry holds 126 children and the next part, the last one up to 127."""
    n = F.count("*").over(W.partitionBy("parent"))
    return children.withColumn("part", F.when(n <= CHILDREN, 0).otherwise(F.least(F.floor(F.col("idx") / (CHILDREN - 1)), F.floor((n - 2) / (CHILDREN - 1)))).cast("int"))


def levels(arcs: DataFrame, rounds: int = 50) -> DataFrame:
    """arcs(src, dst) of a DAG -> (node, level): Kahn's levels; a cycle is an error."""
    left = settle(arcs.select(F.col("src").alias("node")).union(arcs.select("dst")).distinct())
    out = None
    for level in range(rounds):
        if left.isEmpty():
            return out
        live = arcs.join(left.withColumnRenamed("node", "src"), "src")
        free = settle(left.join(live.select(F.col("dst").alias("node")), "node", "left_anti"))
        if free.isEmpty():
            raise ValueError("the entries have a cycle")
        done = free.withColumn("level", F.lit(level))
        out = done if out is None else out.unionByName(done)
        left = settle(left.join(free, "node", "left_anti"))
    raise RuntimeError(f"more than {rounds} levels")


def table_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(tag, digest) of two builds -> (tag, change): new, removed, replaced or unchanged."""
    b, a = before.withColumnRenamed("digest", "b"), after.withColumnRenamed("digest", "a")
    change = F.when(F.col("b").isNull(), "new").when(F.col("a").isNull(), "removed").when(F.col("a") != F.col("b"), "replaced").otherwise("unchanged")
    return b.join(a, "tag", "full").select("tag", change.alias("change"))
