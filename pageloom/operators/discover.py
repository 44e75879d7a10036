"""Which segments make each glyph necessary: closures compared, conditions, grouping, validation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Patch numbers follow the order of conditions; glyphs of one condition share a patch.


def analyse(everything: DataFrame, without: DataFrame, alone: DataFrame, init: DataFrame) -> DataFrame:
    """(segment_id, node, kind): what a segment's presence decides.

    everything(node): closure of all; without(segment_id, node): of all but the segment; alone: of the
    initial definition and the segment; init(node): of the initial definition. D = everything - without
    disappears without the segment, I = alone - init appears with it alone: D only is `and`, I only
    `or`, both `exclusive`.
    """
    ids = without.select("segment_id").distinct()
    d = ids.crossJoin(F.broadcast(everything)).join(without, ["segment_id", "node"], "left_anti").withColumn("d", F.lit(True))
    i = alone.join(init, "node", "left_anti").select("segment_id", "node").withColumn("i", F.lit(True))
    met = d.join(i, ["segment_id", "node"], "full")
    kind = F.when(F.col("d") & F.col("i"), "exclusive").when(F.col("d"), "and").otherwise("or")
    return met.select("segment_id", "node", kind.alias("kind"))


def glyph_conditions(analysis: DataFrame) -> DataFrame:
    """(node, groups): exclusive and `and` segments each are a group of their own, `or` segments one group together."""
    rows = analysis.groupBy("node").agg(
        F.array_sort(F.collect_set(F.when(F.col("kind") != "or", F.col("segment_id")))).alias("every"),
        F.array_sort(F.collect_set(F.when(F.col("kind") == "or", F.col("segment_id")))).alias("some"),
    )
    single = F.transform("every", lambda s: F.array(s))
    groups = F.when(F.size("every") > 0, single).otherwise(F.array(F.col("some")))
    return rows.select("node", groups.alias("groups"))


def or_groups(analysis: DataFrame) -> DataFrame:
    """(node, segments): the `or` segments of each glyph that no segment is necessary for."""
    kinds = analysis.groupBy("node").agg(F.count(F.when(F.col("kind") != "or", 1)).alias("needed"), F.array_sort(F.collect_set("segment_id")).alias("segments"))
    return kinds.where("needed = 0").select("node", "segments")


def additional(either: DataFrame, others: DataFrame) -> DataFrame:
    """(node, segments): glyphs that all segments outside their group bring together, so that the group isn't their whole condition.

    either: or_groups(); others(segments, node): the closure of all segments but the group's.
    """
    return either.join(others, ["segments", "node"], "left_semi").select("node", "segments")


def grouped(conditions: DataFrame) -> DataFrame:
    """(groups, nodes): glyphs by equal condition."""
    return conditions.groupBy("groups").agg(F.array_sort(F.collect_set("node")).alias("nodes"))


def inert(conditions: DataFrame, segments: DataFrame) -> DataFrame:
    """(segment_id): segments that occur in no condition of several segments."""
    mixed = conditions.where((F.size("groups") > 1) | (F.size(F.flatten("groups")) > 1)).select(F.explode(F.flatten("groups")).alias("segment_id"))
    return segments.select("segment_id").distinct().join(mixed, "segment_id", "left_anti")


def unmapped(everything: DataFrame, init: DataFrame, conditions: DataFrame) -> DataFrame:
    """(node): glyphs of the full closure that are neither initial nor under any condition."""
    return everything.join(init, "node", "left_anti").join(conditions, "node", "left_anti").select("node")
