"""Patch sizes by an estimate, and the costs of a segmentation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.corpus import OVERHEAD, RATIO, glyph_bytes, page_codepoints


def estimate(n, raw, tables: int = 1, ratio: float = RATIO):
    """Bytes of a patch of n glyphs with `raw` outline bytes: a header, and the stream's tables and data compressed."""
    width = F.when(n > 255, 3).otherwise(2)
    stream = 5 + n * width + 4 * tables + 4 * (n * tables + 1) + raw
    return (29 + F.floor(stream * F.lit(float(ratio)))).cast("long")


def patch_sizes(patch_glyphs: DataFrame, key: str = "condition_id", tables: int = 1, ratio: float = RATIO) -> DataFrame:
    """(key, size) of patches given as (key, gid)."""
    return patch_glyphs.groupBy(key).agg(estimate(F.count("*"), F.sum(glyph_bytes(F.col("gid"))), tables, ratio).alias("size"))


def expected_cost(condition_p: DataFrame, sizes: DataFrame, overhead: int = OVERHEAD, p: str = "p") -> DataFrame:
    """(dataset, cost): sum of probability * (size + overhead)."""
    return condition_p.join(sizes, "condition_id").groupBy("dataset").agg(F.sum(F.col(p) * (F.col("size") + overhead)).alias("cost"))


def loaded(page_segments: DataFrame, literals: DataFrame) -> DataFrame:
    """(page, dataset, condition_id): conditions that a page meets, every group by one of its segments.

    Relational division: a page's met groups are counted once each and compared with the condition's
    number. page_segments(page, dataset, segment_id) must be distinct.
    """
    need = literals.groupBy("condition_id").agg(F.countDistinct("group_no").alias("n"))
    met = page_segments.join(literals, "segment_id").select("page", "dataset", "condition_id", "group_no").distinct()
    return met.groupBy("page", "dataset", "condition_id").agg(F.count("*").alias("k")).join(need, "condition_id").where("k = n").select("page", "dataset", "condition_id")


def page_segments(pages: DataFrame, segments: DataFrame) -> DataFrame:
    """(page, dataset, segment_id), distinct; segments(segment_id, cp)."""
    each = page_codepoints(pages)
    return each.join(segments.select("cp", "segment_id"), "cp").select("page", "dataset", "segment_id").distinct()
