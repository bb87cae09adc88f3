"""Event streams: windowed counts with a watermark, and sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def windowed_counts(events: DataFrame, *, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, event_type, events, value) per tumbling window; state older than the watermark is dropped."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    out = timed.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("value"))
    return out.select(F.col("window.start").alias("start"), "event_type", "events", "value")


def sessions(events: DataFrame, *, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """(user_id, start, end, events): runs of events of a user with no longer pause than `gap`."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    out = timed.groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("events"))
    return out.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "events")
