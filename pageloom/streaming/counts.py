"""Counts kept up on streams; an extension, for pages that keep coming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.corpus import codepoints


def page_counts(documents: DataFrame) -> DataFrame:
    """Streaming documents(text, lang) -> (dataset, cp, n), for complete or update mode."""
    each = documents.select(F.col("lang").alias("dataset"), F.explode(codepoints(F.col("text"))).alias("cp"))
    return each.groupBy("dataset", "cp").agg(F.count("*").alias("n"))


def windowed(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Streaming events(ts, event_type, value) -> (start, event_type, n, total) of tumbling windows; what is later than the watermark goes."""
    w = F.window("ts", window)
    return events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
