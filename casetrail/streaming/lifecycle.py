"""Job lifecycles from the event stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def per_row() -> list[Column]:
    """Lifecycle facts of single events in microseconds, to be merged outside of SQL."""
    kind, at, size = F.col("event_type"), F.unix_micros("ts"), F.col("size_bytes").cast("long")
    collected = F.coalesce(kind == "ItemCollected", F.lit(False))
    return [
        F.when(kind == "JobStarted", at).alias("started_at"),
        F.when(kind == "JobCompleted", at).alias("completed_at"),
        at.alias("first_event_at"),
        at.alias("last_event_at"),
        collected.cast("long").alias("items_collected"),
        F.when(collected, F.coalesce(size, F.lit(0))).otherwise(0).cast("long").alias("bytes_collected"),
        F.coalesce(kind == "BackoffTriggered", F.lit(False)).cast("long").alias("backoffs"),
    ]


def _summed() -> list[Column]:
    """Lifecycle facts of events, as mergeable aggregates."""
    kind = F.col("event_type")
    return [
        F.min(F.when(kind == "JobStarted", F.col("ts"))).alias("started_at"),
        F.max(F.when(kind == "JobCompleted", F.col("ts"))).alias("completed_at"),
        F.min("ts").alias("first_event_at"),
        F.max("ts").alias("last_event_at"),
        F.count_if(kind == "ItemCollected").alias("items_collected"),
        F.coalesce(F.sum(F.when(kind == "ItemCollected", F.col("size_bytes"))), F.lit(0)).alias("bytes_collected"),
        F.count_if(kind == "BackoffTriggered").alias("backoffs"),
    ]


def _merged() -> list[Column]:
    """The same facts over rows that hold them already."""
    return [
        F.min("started_at").alias("started_at"),
        F.max("completed_at").alias("completed_at"),
        F.max("last_event_at").alias("last_event_at"),
        F.sum("items_collected").alias("items_collected"),
        F.sum("bytes_collected").alias("bytes_collected"),
        F.sum("backoffs").alias("backoffs"),
    ]


def lifecycle_state() -> Column:
    """Completed, or TimedOut when the session closed without a completion."""
    return F.when(F.col("completed_at").isNotNull(), "Completed").otherwise("TimedOut")


def job_sessions(events: DataFrame, timeout_minutes: int = 30, watermark: str = "24 hours") -> DataFrame:
    """Runs of a job's events with no silence as long as ``timeout_minutes``.

    A session closes after that silence, so a job still open then has timed out. On a
    stream the state of a job is one session row, and sessions are merged on the map
    side first. A batch sorts every row of a job in one task, so events are summed by
    minute first: events of one minute always share a session, and a very busy job
    becomes at most one row per minute, stretched over its events by the length of its
    gap.
    """
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("ts", watermark)
        window = F.session_window("ts", f"{timeout_minutes} minutes")
        grouped = timed.groupBy(window.alias("s"), "job_id").agg(*_summed())
    else:
        minutes = timed.groupBy("job_id", F.date_trunc("minute", "ts").alias("minute")).agg(*_summed())
        stretch = F.unix_micros("last_event_at") - F.unix_micros("first_event_at")
        gap = F.concat((stretch + timeout_minutes * 60_000_000).cast("string"), F.lit(" microseconds"))
        window = F.session_window("first_event_at", gap)
        grouped = minutes.groupBy(window.alias("s"), "job_id").agg(*_merged())
    return grouped.select(
        "job_id",
        F.col("s.start").alias("session_start"),
        F.col("s.end").alias("session_end"),
        "started_at",
        "completed_at",
        "last_event_at",
        "items_collected",
        "bytes_collected",
        "backoffs",
    ).withColumn("state", lifecycle_state())
