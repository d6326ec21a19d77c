"""Throughput, error and status metrics over metric points (metric, value, ts)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIB = 1024 * 1024
WINDOW_MINUTES = {"15m": 15, "1h": 60, "24h": 1440}

# Metrics recorded for each event kind, as (metric, value column or constant).
EVENT_POINTS = {
    "ItemCollected": [
        ("items_collected", 1),
        ("bytes_collected", "size_bytes"),
        ("processing_duration_ms", "processing_duration_ms"),
    ],
    "BackoffTriggered": [("backoff_events", 1), ("backoff_delay_ms", "backoff_delay_ms")],
    "AutoRoutedToGDC": [("gdc_routing_events", 1)],
    "JobCompleted": [
        ("job_duration_ms", "duration_ms"),
        ("job_items_collected", "collected_items"),
        ("job_bytes_collected", "collected_size_bytes"),
    ],
}

# Failure events with the counter and the point of each.
FAILURE_EVENTS = {
    "AuthError": ("auth_errors_total", "auth_errors"),
    "TimeoutError": ("timeout_errors_total", "timeout_errors"),
    "RetrySucceeded": ("retry_success_total", "retry_success"),
    "RetryFailed": ("retry_failure_total", "retry_failure"),
}

# Job states that count as success.
SUCCESS_STATES = ("succeeded", "completed")


def _since(as_of: Column, minutes: int) -> Column:
    return (F.col("ts") >= as_of - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes))) & (F.col("ts") <= as_of)


def windowed_totals(points: DataFrame, as_of: Column, ever: tuple[str, ...] = ()) -> DataFrame:
    """Per metric: sum, count, rate per minute for 15 min, 1 h, 24 h; average and peak minute of 24 h.

    One scan. Points are first summed by minute on the map side; what is shuffled is
    at most one row per metric and minute. ``count_ever`` counts all points of the metrics in ``ever``, whatever their time; those
    outside the 24 h are one row per metric.
    """
    day = _since(as_of, WINDOW_MINUTES["24h"])
    recent = points.filter(day | F.col("metric").isin(*ever)) if ever else points.filter(day)
    aggregates = [F.count(F.lit(1)).alias("count_ever")]
    for label, minutes in WINDOW_MINUTES.items():
        inside = _since(as_of, minutes)
        aggregates.append(F.sum(F.when(inside, F.col("value"))).alias(f"sum_{label}"))
        aggregates.append(F.count_if(inside).alias(f"count_{label}"))
    by_minute = recent.groupBy("metric", F.when(day, F.date_trunc("minute", "ts")).alias("minute")).agg(*aggregates)
    rolled = [F.sum("count_ever").alias("count_ever")] if ever else []
    for label, minutes in WINDOW_MINUTES.items():
        total = F.coalesce(F.sum(f"sum_{label}"), F.lit(0.0))
        rolled.append(total.alias(f"sum_{label}"))
        rolled.append(F.sum(f"count_{label}").alias(f"count_{label}"))
        rolled.append((total / minutes).alias(f"rate_{label}"))
    return by_minute.groupBy("metric").agg(
        *rolled,
        (F.sum("sum_24h") / F.sum("count_24h")).alias("avg_24h"),
        F.max("sum_24h").alias("peak_minute_24h"),
    )


def peak_minute(points: DataFrame, as_of: Column) -> DataFrame:
    """Largest sum of one minute in the last 24 hours, per metric."""
    return windowed_totals(points, as_of).select("metric", "peak_minute_24h")


def rates(points: DataFrame, as_of: Column, label: str = "15m") -> DataFrame:
    """Sum over the window divided by its full length in minutes, per metric."""
    return windowed_totals(points, as_of).filter(F.col(f"count_{label}") > 0).select(
        "metric", F.col(f"rate_{label}").alias("rate_per_minute")
    )


def _cell(metric: str, column: str, default: float | int = 0) -> Column:
    return F.coalesce(F.max(F.when(F.col("metric") == metric, F.col(column))), F.lit(default))


def throughput_metrics(points: DataFrame, as_of: Column) -> DataFrame:
    """One row of throughput figures."""
    return windowed_totals(points, as_of).agg(
        _cell("items_collected", "rate_15m", 0.0).alias("items_per_minute_15m"),
        (_cell("bytes_collected", "rate_15m", 0.0) / MIB).alias("mb_per_minute_15m"),
        _cell("items_collected", "rate_1h", 0.0).alias("items_per_minute_1h"),
        (_cell("bytes_collected", "rate_1h", 0.0) / MIB).alias("mb_per_minute_1h"),
        _cell("items_collected", "peak_minute_24h", 0.0).alias("peak_items_per_minute"),
        (_cell("bytes_collected", "peak_minute_24h", 0.0) / MIB).alias("peak_mb_per_minute"),
        (_cell("job_duration_ms", "avg_24h", 0.0) / 60000).alias("average_job_minutes"),
    )


def retry_success_rate(successes: Column, failures: Column) -> Column:
    """1.0 when nothing was retried."""
    return F.when(successes + failures > 0, successes.cast("double") / (successes + failures)).otherwise(1.0)


def error_metrics(points: DataFrame, as_of: Column) -> DataFrame:
    """One row of error figures. Windows end at ``as_of``; the retry rate is over all points ever recorded."""
    retried = tuple(_cell(name, "count_ever") for name in ("retry_success", "retry_failure"))
    return (
        windowed_totals(points, as_of, ("retry_success", "retry_failure"))
        .agg(
            _cell("throttling_events", "count_15m").alias("throttling_15m"),
            _cell("throttling_events", "count_1h").alias("throttling_1h"),
            _cell("throttling_events", "count_24h").alias("throttling_24h"),
            _cell("server_errors", "count_1h").alias("server_errors_1h"),
            _cell("auth_errors", "count_1h").alias("auth_errors_1h"),
            _cell("timeout_errors", "count_1h").alias("timeout_errors_1h"),
            _cell("backoff_delay_ms", "avg_24h", 0.0).alias("average_backoff_ms"),
            retry_success_rate(*retried).alias("retry_success_rate"),
        )
    )


def status_text(error_rate: Column, throttling_rate: Column, active_jobs: Column) -> Column:
    return (
        F.when((error_rate > 10) | (throttling_rate > 20), "Degraded")
        .when(active_jobs > 100, "High Load")
        .otherwise("Healthy")
    )


def system_status(points: DataFrame, as_of: Column) -> DataFrame:
    """One row: status and the figures behind it.

    Active jobs are all starts minus all ends up to ``as_of``, from points
    ``jobs_started_total``, ``jobs_completed_total`` and ``jobs_failed_total``.
    """
    metric, value = F.col("metric"), F.col("value")
    recent = _since(as_of, 15)

    def total(name: str, condition: Column) -> Column:
        return F.coalesce(F.sum(F.when((metric == name) & condition, value)), F.lit(0.0))

    past = F.col("ts") <= as_of
    return (
        points.agg(
            (total("server_errors", recent) / 15).alias("error_rate"),
            (total("throttling_events", recent) / 15).alias("throttling_rate"),
            (
                total("jobs_started_total", past)
                - total("jobs_completed_total", past)
                - total("jobs_failed_total", past)
            )
            .cast("long")
            .alias("active_jobs"),
        )
        .withColumn(
            "system_status", status_text(F.col("error_rate"), F.col("throttling_rate"), F.col("active_jobs"))
        )
    )


def split_retention(points: DataFrame, as_of: Column, hours: int = 24) -> tuple[DataFrame, DataFrame]:
    """(points kept, points past retention)."""
    fresh = F.col("ts") >= as_of - F.make_dt_interval(F.lit(0), F.lit(hours))
    return points.filter(fresh), points.filter(~fresh)


def _succeeded() -> Column:
    return F.lower("status").isin(*SUCCESS_STATES)


def counters(events: DataFrame) -> DataFrame:
    """Event counters by name, exploded from each event and summed (map side first)."""
    kind, status = F.col("event_type"), F.lower(F.coalesce("status", F.lit("")))
    route, priority = F.lower(F.coalesce("route", F.lit(""))), F.lower(F.coalesce("priority", F.lit("")))
    code = F.col("http_status_code")

    def one(condition: Column, name: Column) -> Column:
        return F.when(condition, F.struct(name.alias("counter"), F.lit(1).cast("long").alias("n")))

    def add(condition: Column, name: str, amount: Column) -> Column:
        return F.when(
            condition, F.struct(F.lit(name).alias("counter"), F.coalesce(amount, F.lit(0)).cast("long").alias("n"))
        )

    done = kind == "JobCompleted"
    ok = _succeeded()
    marks = F.array(
        one(kind == "JobStarted", F.lit("jobs_started_total")),
        one(kind == "JobStarted", F.concat(F.lit("jobs_started_route_"), route)),
        one(kind == "ItemCollected", F.lit("items_collected_total")),
        add(kind == "ItemCollected", "bytes_collected_total", F.col("size_bytes")),
        one(kind == "BackoffTriggered", F.lit("backoff_triggered_total")),
        one((kind == "BackoffTriggered") & (code == 429), F.lit("throttling_429_total")),
        one((kind == "BackoffTriggered") & (code >= 500), F.lit("server_errors_5xx_total")),
        one((kind == "BackoffTriggered") & ((code == 429) | (code >= 500)), F.concat(F.lit("http_errors_"), code.cast("string"))),
        *[one(kind == event, F.lit(counter)) for event, (counter, _) in FAILURE_EVENTS.items()],
        one(kind == "AutoRoutedToGDC", F.lit("autorouted_to_gdc_total")),
        one(kind == "AutoRoutedToGDC", F.concat(F.lit("autorouted_priority_"), priority)),
        one(done, F.concat(F.lit("jobs_completed_"), status)),
        one(done, F.concat(F.lit("jobs_completed_route_"), route)),
        one(done & ok, F.lit("jobs_completed_total")),
        one(done & ~F.coalesce(ok, F.lit(False)), F.lit("jobs_failed_total")),
    )
    exploded = events.select(F.explode(F.filter(marks, lambda m: m.isNotNull())).alias("m"))
    return exploded.groupBy(F.col("m.counter").alias("counter")).agg(F.sum("m.n").alias("total"))


def points_from_events(events: DataFrame) -> DataFrame:
    """Metric points recorded for each event.

    A job's duration is recorded once, and job starts and ends are points too, so that
    they can be counted over a window.
    """
    kind, code = F.col("event_type"), F.col("http_status_code")

    def point(condition: Column, name: str, value: Column) -> Column:
        return F.when(condition, F.struct(F.lit(name).alias("metric"), value.cast("double").alias("value")))

    marks = []
    for event, recorded in EVENT_POINTS.items():
        for metric, value in recorded:
            amount = F.coalesce(F.col(value), F.lit(0)) if isinstance(value, str) else F.lit(value)
            marks.append(point(kind == event, metric, amount))
    ok = F.coalesce(_succeeded(), F.lit(False))
    marks += [
        point((kind == "BackoffTriggered") & (code == 429), "throttling_events", F.lit(1)),
        point((kind == "BackoffTriggered") & (code >= 500), "server_errors", F.lit(1)),
        *[point(kind == event, name, F.lit(1)) for event, (_, name) in FAILURE_EVENTS.items()],
        point(kind == "JobStarted", "jobs_started_total", F.lit(1)),
        point((kind == "JobCompleted") & ok, "jobs_completed_total", F.lit(1)),
        point((kind == "JobCompleted") & ~ok, "jobs_failed_total", F.lit(1)),
    ]
    return events.select(
        "ts", F.explode(F.filter(F.array(*marks), lambda m: m.isNotNull())).alias("p")
    ).select(F.col("p.metric").alias("metric"), F.col("p.value").alias("value"), "ts")
