"""Event-time windows over streams, with the semantics of the batch operators: an extension beyond grids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, length: str = "1 hour", late: str = "2 hours", by: tuple[str, ...] = ("event_type",), method: str = "mean") -> DataFrame:
    """Aggregates of value over fixed windows of ts; events later than the watermark are dropped by the engine."""
    agg = {"mean": F.avg, "sum": F.sum, "max": F.max, "min": F.min}[method]("value")
    grouped = events.withWatermark("ts", late).groupBy(F.window("ts", length), *by).agg(agg.alias("v"), F.count("*").alias("n"))
    return grouped.select(F.col("window.start").alias("start"), *by, "v", "n")
