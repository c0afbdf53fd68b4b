"""Event-time views that are the same on a bounded table and on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LATE = "10 minutes"


def tumbling(events: DataFrame, at: str, by: list[str], width: str = "1 hour") -> DataFrame:
    """(window_start, by, n, total) of each window; on a stream, events later than the watermark are dropped."""
    timed = events.withColumn(at, F.col(at).cast("timestamp"))
    timed = timed.withWatermark(at, LATE) if events.isStreaming else timed
    out = timed.groupBy(F.window(at, width), *by).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return out.select(F.col("window.start").alias("window_start"), *by, "n", "total")


def sessions(events: DataFrame, at: str, key: str, gap: str = "30 minutes") -> DataFrame:
    """(key, began, n): visits that a gap ends."""
    timed = events.withColumn(at, F.col(at).cast("timestamp"))
    timed = timed.withWatermark(at, LATE) if events.isStreaming else timed
    return timed.groupBy(key, F.session_window(at, gap)).agg(F.count("*").alias("n")).select(key, F.col("session_window.start").alias("began"), "n")


def first_of_key(attempts: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Each key once; on a stream a repeat within the watermark is dropped."""
    if not attempts.isStreaming:
        return attempts.dropDuplicates(keys)
    return attempts.withWatermark(at, LATE).dropDuplicatesWithinWatermark(keys)
