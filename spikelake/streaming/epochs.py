"""Tumbling epochs and merged events over batch or streaming DataFrames with an event-time column.

On a stream, rows later than the watermark are dropped and a window is given out when the watermark passes
it; on a batch the same call gives all windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(rows: DataFrame, ts: str, duration: str, keys: list[str], value: str, late: str = "1 hour") -> DataFrame:
    """start, keys, n, total, low and high of the value in each window."""
    if rows.isStreaming:
        rows = rows.withWatermark(ts, late)
    found = rows.groupBy(F.window(ts, duration), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.min(value).alias("low"), F.max(value).alias("high"))
    return found.select(F.col("window.start").alias("start"), *keys, "n", "total", "low", "high")


def bursts(rows: DataFrame, ts: str, gap: str, keys: list[str], value: str, late: str = "1 hour") -> DataFrame:
    """Events of a key merged while they follow each other within the gap: start, stop (the last event's end of gap), n, peak."""
    if rows.isStreaming:
        rows = rows.withWatermark(ts, late)
    found = rows.groupBy(F.session_window(ts, gap), *keys).agg(F.count(F.lit(1)).alias("n"), F.max(value).alias("peak"))
    return found.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stop"), *keys, "n", "peak")
