"""Event streams: windows, sessions and duplicates. Batch tables and streams take the same functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling_counts(events: DataFrame, width: str = "1 day", late: str = "1 hour", time_col: str = "ts", key: str = "event_type", value: str = "value") -> DataFrame:
    """window_start, key, n, total of each window. Rows that come later than ``late`` after newer ones are left out of a stream."""
    timed = events.withColumn(time_col, F.col(time_col).cast("timestamp")).withWatermark(time_col, late)
    return timed.groupBy(F.window(time_col, width), key).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), key, "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour", time_col: str = "ts", user: str = "user_id") -> DataFrame:
    """user, session_start, session_end, n: runs of a user's events without a pause longer than ``gap``."""
    timed = events.withColumn(time_col, F.col(time_col).cast("timestamp")).withWatermark(time_col, late)
    return timed.groupBy(user, F.session_window(time_col, gap)).agg(F.count("*").alias("n")).select(user, F.col("session_window.start").cast("timestamp_ntz").alias("session_start"), F.col("session_window.end").cast("timestamp_ntz").alias("session_end"), "n")


def first_by_id(events: DataFrame, id_col: str = "event_id", late: str = "1 hour", time_col: str = "ts") -> DataFrame:
    """Events without those whose id came before, as far back as the watermark goes in a stream."""
    timed = events.withColumn(time_col, F.col(time_col).cast("timestamp")).withWatermark(time_col, late)
    return timed.dropDuplicatesWithinWatermark([id_col]) if events.isStreaming else timed.dropDuplicates([id_col])
