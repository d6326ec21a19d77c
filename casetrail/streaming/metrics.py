"""Windowed metrics over a stream of points.

The watermark is the retention: state of windows older than it is dropped.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from casetrail.operators.metrics import counters, split_retention

RETENTION = "24 hours"


def as_event_time(points: DataFrame, column: str = "ts", retention: str = RETENTION) -> DataFrame:
    """A watermark needs an instant, so zoneless timestamps are cast first."""
    return points.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, retention)


def rolling_rates(points: DataFrame, minutes: int = 15, slide: str = "1 minute") -> DataFrame:
    """Sum, count, average and rate per minute of every metric over sliding windows, in any output mode.

    Each point is copied into all its windows; ``pane_rates`` gives the same without that, but cannot run in complete mode.
    """
    window = F.window("ts", f"{minutes} minutes", slide)
    return (
        as_event_time(points)
        .groupBy(window.alias("w"), "metric")
        .agg(F.sum("value").alias("total"), F.count(F.lit(1)).alias("points"), F.avg("value").alias("average"))
        .select(
            F.col("w.start").alias("window_start"),
            F.col("w.end").alias("window_end"),
            "metric",
            "total",
            "points",
            "average",
            (F.col("total") / minutes).alias("rate_per_minute"),
        )
    )


_SECONDS = {"second": 1, "minute": 60, "hour": 3600}


def _seconds(length: str) -> int:
    """Seconds of a length such as ``5 minutes``."""
    number, unit = length.split()
    return int(number) * _SECONDS[unit.removesuffix("s")]


def pane_sums(points: DataFrame, seconds: int) -> DataFrame:
    """Sum and count per metric and pane: the pieces that every window is made of."""
    return (
        as_event_time(points)
        .groupBy(F.window("ts", f"{seconds} seconds").alias("w"), "metric")
        .agg(F.sum("value").alias("total"), F.count(F.lit(1)).alias("points"), F.count("value").alias("valued"))
    )


def pane_rates(points: DataFrame, minutes: int = 15, slide: str = "1 minute") -> DataFrame:
    """The rows of ``rolling_rates``, for batches and streams in append mode.

    Points are added up once, in panes that windows and slides are multiples of; windows are made of panes. A point is never copied,
    and what is copied into each window is one row a metric and pane, however many points there are.
    """
    pane = math.gcd(minutes * 60, _seconds(slide))
    panes = pane_sums(points, pane).select(F.window_time("w").alias("pane"), "metric", "total", "points", "valued")
    return (
        panes.groupBy(F.window("pane", f"{minutes} minutes", slide).alias("w"), "metric")
        .agg(F.sum("total").alias("total"), F.sum("points").alias("points"), F.sum("valued").alias("valued"))
        .select(
            F.col("w.start").alias("window_start"),
            F.col("w.end").alias("window_end"),
            "metric",
            "total",
            "points",
            F.when(F.col("valued") > 0, F.col("total") / F.col("valued")).alias("average"),
            (F.col("total") / minutes).alias("rate_per_minute"),
        )
    )


def minute_sums(points: DataFrame) -> DataFrame:
    """Sums per metric and minute; their maximum over 24 hours is the peak."""
    return (
        as_event_time(points)
        .groupBy(F.window("ts", "1 minute").alias("w"), "metric")
        .agg(F.sum("value").alias("total"))
        .select(F.col("w.start").alias("minute"), "metric", "total")
    )


def hourly_peaks(points: DataFrame) -> DataFrame:
    """Peak minute per metric and hour, as chained windows of one streaming query."""
    per_minute = (
        as_event_time(points)
        .groupBy(F.window("ts", "1 minute").alias("w"), "metric")
        .agg(F.sum("value").alias("total"))
        .select(F.window_time("w").alias("minute_end"), "metric", "total")
    )
    return (
        per_minute.groupBy(F.window("minute_end", "1 hour").alias("w"), "metric")
        .agg(F.max("total").alias("peak_minute"))
        .select(F.col("w.start").alias("hour"), "metric", "peak_minute")
    )


def open_tail(points: DataFrame, watermark: str, minutes: int) -> DataFrame:
    """The points that can lie in a window of ``minutes`` which ends after the watermark."""
    return points.filter(F.col("ts") >= F.lit(watermark).cast("timestamp") - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes)))


def with_open_windows(closed: DataFrame, batch: DataFrame, end: Column, watermark: str | None) -> DataFrame:
    """Windows a stream has written, and those its watermark has not closed yet from the same operator over a batch.

    An append stream writes a window once its end is not above the watermark; ``batch`` is the
    operator's result over the stored points, of which only windows that end later are taken.
    """
    if watermark is None:
        return closed
    late = F.lit(watermark).cast("timestamp")
    return closed.unionByName(batch.filter(end > late).select(*closed.columns))


def retention_sink(kept_path: str, late_path: str, horizon_path: str, hours: int = 24):
    """``foreachBatch`` function that keeps fresh points and sets late ones aside.

    The horizon is the latest event time seen in earlier batches, remembered as one
    row per batch. All writes replace the folder of their batch, so a replay is harmless.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        newest = batch.agg(F.max("ts").alias("newest"))
        newest.write.mode("overwrite").parquet(f"{horizon_path}/batch_id={batch_id}")
        seen = spark.read.parquet(horizon_path).filter(F.col("batch_id") < batch_id)
        horizon = seen.agg(F.max("newest")).first()[0] if batch_id else None
        if horizon is None:
            kept, late = batch, batch.limit(0)
        else:
            kept, late = split_retention(batch, F.lit(horizon), hours)
        kept.write.mode("overwrite").parquet(f"{kept_path}/batch_id={batch_id}")
        late.write.mode("overwrite").parquet(f"{late_path}/batch_id={batch_id}")
        batch.unpersist()

    return write


def run_counters(events: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Running event counters, written whole to a new folder per batch.

    The state is one row per counter name, of which there are a few dozen.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return (
        counters(events)
        .writeStream.outputMode("complete")
        .foreachBatch(step)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def latest_batch(rows: DataFrame) -> DataFrame:
    """Rows of the last batch of a table written whole per batch."""
    newest = rows.agg(F.max("batch_id")).first()[0]
    return rows.filter(F.col("batch_id") == newest).drop("batch_id")
