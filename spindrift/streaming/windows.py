"""Windowed aggregates over streams, with watermarks for late rows; the batch form of each is the same plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(df: DataFrame, time: str, value: str, by: str, width: str = "1 hour", step: str | None = None, late: str = "1 hour") -> DataFrame:
    """(start, by, n, total) of tumbling (or hopping) windows; rows later than the watermark are left out of a stream."""
    kept = df.withWatermark(time, late) if df.isStreaming else df
    window = F.window(time, width, step) if step else F.window(time, width)
    return kept.groupBy(window.alias("_w"), by).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("_w.start").alias("start"), by, "n", "total")


def sessions(df: DataFrame, time: str, by: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(by, start, stop, n) of sessions that end after a gap."""
    kept = df.withWatermark(time, late) if df.isStreaming else df
    return kept.groupBy(F.session_window(time, gap).alias("_w"), by).agg(F.count("*").alias("n")).select(by, F.col("_w.start").alias("start"), F.col("_w.end").alias("stop"), "n")
