"""Activity sessions: any activity restarts the idle timer."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

IDLE_SECONDS = 30 * 60


def activity_sessions(events: DataFrame, key: str, ts: str = "ts", idle_seconds: int = IDLE_SECONDS) -> DataFrame:
    """(key, session_start, session_end, n_events); a session ends ``idle_seconds`` after
    its last event, and an event at exactly that moment still belongs to it.

    Events are first reduced to (key, bucket) extremes with a bucket one idle period
    wide: inside it no pause can be longer, so sessions are found between buckets. The
    ordered window sees one row per key and bucket, not one per event."""
    idle = F.lit(idle_seconds * 1_000_000)
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    per_bucket = events.groupBy(F.col(key), F.floor(us / idle).alias("_bucket")).agg(
        F.min(us).alias("_first"), F.max(us).alias("_last"), F.count("*").alias("_n")
    )
    by_time = Window.partitionBy(key).orderBy("_bucket")
    starts = F.coalesce(F.col("_first") - F.lag("_last").over(by_time) > idle, F.lit(True)).cast("int")
    return (
        per_bucket.withColumn("_starts", starts)
        .withColumn("_session", F.sum("_starts").over(by_time))
        .groupBy(key, "_session")
        .agg(
            F.timestamp_micros(F.min("_first")).alias("session_start"),
            F.timestamp_micros(F.max("_last") + idle).alias("session_end"),
            F.sum("_n").alias("n_events"),
        )
        .drop("_session")
    )


def activity_stream(events: DataFrame, key: str, ts: str = "ts", idle: str = "30 minutes",
                    watermark: str = "10 minutes") -> DataFrame:
    """The same on a stream. A session is emitted once the watermark has passed its end."""
    return (
        events.withWatermark(ts, watermark)
        .groupBy(key, F.session_window(ts, idle).alias("_w"))
        .agg(F.count("*").alias("n_events"))
        .select(key, F.col("_w.start").alias("session_start"), F.col("_w.end").alias("session_end"), "n_events")
    )
