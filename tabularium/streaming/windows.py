"""Windows over the event stream; the same functions serve a batch and a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def timed(events: DataFrame, late: str | None = None) -> DataFrame:
    """Events with ``ts`` as a timestamp, with a watermark where ``late`` says how long to wait."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).where("ts is not null")
    return e.withWatermark("ts", late) if late else e


def tumbling(events: DataFrame, size: str = "1 hour", late: str | None = None) -> DataFrame:
    """(start, event_type, n, total): events per window and type."""
    e = timed(events, late)
    g = e.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, size: str = "1 day", step: str = "12 hours", late: str | None = None) -> DataFrame:
    """(start, n): events per overlapping window."""
    e = timed(events, late)
    return e.groupBy(F.window("ts", size, step).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """(user_id, start, n): bursts of a user's events with no pause longer than ``gap``."""
    e = timed(events, late)
    return e.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def distinct(events: DataFrame, late: str | None = None) -> DataFrame:
    """Events once per event_id, as far back as the watermark reaches in a stream."""
    e = timed(events, late)
    return e.dropDuplicatesWithinWatermark(["event_id"]) if late and e.isStreaming else e.dropDuplicates(["event_id"])
