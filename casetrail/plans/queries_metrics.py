"""Metric, counter and correlation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from casetrail.functions import measures
from casetrail.operators import audit, metrics
from casetrail.plans import domain
from casetrail.plans.catalog import query

_NOW = f"TIMESTAMP '{domain.AS_OF_METRICS}'"
_DAY = f"ts >= {_NOW} - INTERVAL 24 HOUR AND ts <= {_NOW}"


def _as_of():
    return domain.instant(domain.AS_OF_METRICS)


def _within(minutes: int) -> str:
    return f"ts >= {_NOW} - INTERVAL {minutes} MINUTE AND ts <= {_NOW}"


@query(
    "rate_15m",
    f"SELECT metric, round(sum(value) / 15, 6) AS rate_per_minute FROM metric_points WHERE {_within(15)} GROUP BY 1",
)
def rate_15m(spark, sf_dir):
    rows = metrics.rates(domain.metric_points(spark, sf_dir), _as_of(), "15m")
    return rows.withColumn("rate_per_minute", F.round("rate_per_minute", 6))


@query(
    "rate_1h",
    f"SELECT metric, round(sum(value) / 60, 6) AS rate_per_minute FROM metric_points WHERE {_within(60)} GROUP BY 1",
)
def rate_1h(spark, sf_dir):
    rows = metrics.rates(domain.metric_points(spark, sf_dir), _as_of(), "1h")
    return rows.withColumn("rate_per_minute", F.round("rate_per_minute", 6))


@query(
    "peak_minute",
    f"""SELECT metric, max(v) AS peak_minute_24h FROM (SELECT metric, date_trunc('minute', ts) AS m, sum(value) AS v
        FROM metric_points WHERE {_DAY} GROUP BY 1, 2) GROUP BY 1""",
)
def peak_minute(spark, sf_dir):
    return metrics.peak_minute(domain.metric_points(spark, sf_dir), _as_of())


@query(
    "metric_windows",
    f"""SELECT metric, count(*) FILTER (WHERE {_within(15)}) AS count_15m, count(*) FILTER (WHERE {_within(60)}) AS count_1h,
          count(*) AS count_24h, round(avg(value), 6) AS avg_24h FROM metric_points WHERE {_DAY} GROUP BY 1""",
)
def metric_windows(spark, sf_dir):
    rows = metrics.windowed_totals(domain.metric_points(spark, sf_dir), _as_of())
    return rows.select("metric", "count_15m", "count_1h", "count_24h", F.round("avg_24h", 6).alias("avg_24h"))


def _sum(metric: str, minutes: int) -> str:
    return f"coalesce(sum(value) FILTER (WHERE metric = '{metric}' AND {_within(minutes)}), 0)"


def _peak(metric: str) -> str:
    return (
        f"(SELECT coalesce(max(v), 0) FROM (SELECT sum(value) AS v FROM metric_points WHERE metric = '{metric}' AND {_DAY} "
        "GROUP BY date_trunc('minute', ts)))"
    )


@query(
    "throughput_metrics",
    f"""SELECT round({_sum('items_collected', 15)} / 15, 6) AS items_per_minute_15m,
          round({_sum('bytes_collected', 15)} / 15 / 1048576, 9) AS mb_per_minute_15m,
          round({_sum('items_collected', 60)} / 60, 6) AS items_per_minute_1h,
          round({_sum('bytes_collected', 60)} / 60 / 1048576, 9) AS mb_per_minute_1h,
          {_peak('items_collected')} AS peak_items_per_minute, round({_peak('bytes_collected')} / 1048576, 9) AS peak_mb_per_minute,
          round(coalesce(avg(value) FILTER (WHERE metric = 'job_duration_ms' AND {_DAY}), 0) / 60000, 9) AS average_job_minutes
        FROM metric_points""",
)
def throughput_metrics(spark, sf_dir):
    rows = metrics.throughput_metrics(domain.metric_points(spark, sf_dir), _as_of())
    digits = {"items_per_minute_15m": 6, "items_per_minute_1h": 6, "peak_items_per_minute": 6}
    return rows.select(*[F.round(c, digits.get(c, 9)).alias(c) for c in rows.columns])


def _counted(condition: str, minutes: int) -> str:
    return f"count(*) FILTER (WHERE {condition} AND {_within(minutes)})"


@query(
    "error_metrics",
    f"""SELECT {_counted("event_type = 'BackoffTriggered' AND http_status_code = 429", 15)} AS throttling_15m,
          {_counted("event_type = 'BackoffTriggered' AND http_status_code = 429", 60)} AS throttling_1h,
          {_counted("event_type = 'BackoffTriggered' AND http_status_code = 429", 1440)} AS throttling_24h,
          {_counted("event_type = 'BackoffTriggered' AND http_status_code >= 500", 60)} AS server_errors_1h,
          {_counted("event_type = 'AuthError'", 60)} AS auth_errors_1h, {_counted("event_type = 'TimeoutError'", 60)} AS timeout_errors_1h,
          round(coalesce(avg(backoff_delay_ms) FILTER (WHERE event_type = 'BackoffTriggered' AND {_DAY}), 0), 6) AS average_backoff_ms,
          round(count(*) FILTER (WHERE event_type = 'RetrySucceeded')
            / CAST(count(*) FILTER (WHERE event_type IN ('RetrySucceeded', 'RetryFailed')) AS DOUBLE), 9) AS retry_success_rate
        FROM failures""",
)
def error_metrics(spark, sf_dir):
    rows = metrics.error_metrics(metrics.points_from_events(domain.failure_events(spark, sf_dir)), _as_of())
    return rows.withColumns({"average_backoff_ms": F.round("average_backoff_ms", 6), "retry_success_rate": F.round("retry_success_rate", 9)})


_POINTS_SQL = """
  SELECT 'items_collected' AS metric, 1.0 AS value, ts FROM lifecycle WHERE event_type = 'ItemCollected'
  UNION ALL SELECT 'bytes_collected', size_bytes, ts FROM lifecycle WHERE event_type = 'ItemCollected'
  UNION ALL SELECT 'processing_duration_ms', processing_duration_ms, ts FROM lifecycle WHERE event_type = 'ItemCollected'
  UNION ALL SELECT 'backoff_events', 1, ts FROM lifecycle WHERE event_type = 'BackoffTriggered'
  UNION ALL SELECT 'backoff_delay_ms', backoff_delay_ms, ts FROM lifecycle WHERE event_type = 'BackoffTriggered'
  UNION ALL SELECT 'throttling_events', 1, ts FROM lifecycle WHERE event_type = 'BackoffTriggered' AND http_status_code = 429
  UNION ALL SELECT 'server_errors', 1, ts FROM lifecycle WHERE event_type = 'BackoffTriggered' AND http_status_code >= 500
  UNION ALL SELECT 'gdc_routing_events', 1, ts FROM lifecycle WHERE event_type = 'AutoRoutedToGDC'
  UNION ALL SELECT 'job_duration_ms', duration_ms, ts FROM lifecycle WHERE event_type = 'JobCompleted'
  UNION ALL SELECT 'job_items_collected', collected_items, ts FROM lifecycle WHERE event_type = 'JobCompleted'
  UNION ALL SELECT 'job_bytes_collected', collected_size_bytes, ts FROM lifecycle WHERE event_type = 'JobCompleted'
  UNION ALL SELECT 'jobs_started_total', 1, ts FROM lifecycle WHERE event_type = 'JobStarted'
  UNION ALL SELECT CASE WHEN status = 'Failed' THEN 'jobs_failed_total' ELSE 'jobs_completed_total' END, 1, ts
    FROM lifecycle WHERE event_type = 'JobCompleted'"""


@query(
    "metric_points_from_events",
    f"SELECT metric, count(*) AS points, CAST(sum(value) AS DOUBLE) AS total FROM ({_POINTS_SQL}) GROUP BY 1",
)
def metric_points_from_events(spark, sf_dir):
    points = metrics.points_from_events(domain.lifecycle_events(spark, sf_dir))
    return points.groupBy("metric").agg(F.count(F.lit(1)).alias("points"), F.sum("value").alias("total"))


@query(
    "system_status",
    f"""WITH s AS (SELECT
            coalesce(sum(value) FILTER (WHERE metric = 'server_errors' AND {_within(15)}), 0) / 15 AS error_rate,
            coalesce(sum(value) FILTER (WHERE metric = 'throttling_events' AND {_within(15)}), 0) / 15 AS throttling_rate,
            CAST(coalesce(sum(CASE WHEN metric = 'jobs_started_total' THEN value WHEN metric IN ('jobs_completed_total', 'jobs_failed_total')
              THEN -value END) FILTER (WHERE ts <= {_NOW}), 0) AS BIGINT) AS active_jobs FROM ({_POINTS_SQL}))
        SELECT round(CAST(error_rate AS DOUBLE), 6) AS error_rate, round(CAST(throttling_rate AS DOUBLE), 6) AS throttling_rate, active_jobs,
          CASE WHEN error_rate > 10 OR throttling_rate > 20 THEN 'Degraded' WHEN active_jobs > 100 THEN 'High Load' ELSE 'Healthy' END AS system_status
        FROM s""",
)
def system_status(spark, sf_dir):
    points = metrics.points_from_events(domain.lifecycle_events(spark, sf_dir))
    rows = metrics.system_status(points, _as_of())
    return rows.withColumn("error_rate", F.round("error_rate", 6)).withColumn(
        "throttling_rate", F.round("throttling_rate", 6)
    )


COUNTERS_SQL = """WITH c AS (
    SELECT 'jobs_started_total' AS counter, 1 AS n FROM lifecycle WHERE event_type = 'JobStarted'
    UNION ALL SELECT 'jobs_started_route_' || lower(route), 1 FROM lifecycle WHERE event_type = 'JobStarted'
    UNION ALL SELECT 'items_collected_total', 1 FROM lifecycle WHERE event_type = 'ItemCollected'
    UNION ALL SELECT 'bytes_collected_total', size_bytes FROM lifecycle WHERE event_type = 'ItemCollected'
    UNION ALL SELECT 'backoff_triggered_total', 1 FROM lifecycle WHERE event_type = 'BackoffTriggered'
    UNION ALL SELECT 'throttling_429_total', 1 FROM lifecycle WHERE event_type = 'BackoffTriggered' AND http_status_code = 429
    UNION ALL SELECT 'server_errors_5xx_total', 1 FROM lifecycle WHERE event_type = 'BackoffTriggered' AND http_status_code >= 500
    UNION ALL SELECT 'http_errors_' || http_status_code, 1 FROM lifecycle
      WHERE event_type = 'BackoffTriggered' AND (http_status_code = 429 OR http_status_code >= 500)
    UNION ALL SELECT 'auth_errors_total', 1 FROM lifecycle WHERE event_type = 'AuthError'
    UNION ALL SELECT 'timeout_errors_total', 1 FROM lifecycle WHERE event_type = 'TimeoutError'
    UNION ALL SELECT 'retry_success_total', 1 FROM lifecycle WHERE event_type = 'RetrySucceeded'
    UNION ALL SELECT 'retry_failure_total', 1 FROM lifecycle WHERE event_type = 'RetryFailed'
    UNION ALL SELECT 'autorouted_to_gdc_total', 1 FROM lifecycle WHERE event_type = 'AutoRoutedToGDC'
    UNION ALL SELECT 'autorouted_priority_' || lower(priority), 1 FROM lifecycle WHERE event_type = 'AutoRoutedToGDC'
    UNION ALL SELECT 'jobs_completed_' || lower(status), 1 FROM lifecycle WHERE event_type = 'JobCompleted'
    UNION ALL SELECT 'jobs_completed_route_' || lower(route), 1 FROM lifecycle WHERE event_type = 'JobCompleted'
    UNION ALL SELECT CASE WHEN status = 'Failed' THEN 'jobs_failed_total' ELSE 'jobs_completed_total' END, 1
      FROM lifecycle WHERE event_type = 'JobCompleted')
  SELECT counter, CAST(sum(n) AS BIGINT) AS total FROM c GROUP BY 1"""


@query("event_counters", COUNTERS_SQL)
def event_counters(spark, sf_dir):
    return metrics.counters(domain.lifecycle_events(spark, sf_dir))


@query("failure_counters", COUNTERS_SQL.replace("FROM lifecycle", "FROM failures"))
def failure_counters(spark, sf_dir):
    return metrics.counters(domain.failure_events(spark, sf_dir))


@query(
    "retry_success_rate",
    """SELECT job_id, CASE WHEN count(*) > 0 THEN count(*) FILTER (WHERE http_status_code <> 404) / CAST(count(*) AS DOUBLE) ELSE 1.0 END AS rate
       FROM lifecycle WHERE event_type = 'BackoffTriggered' GROUP BY 1""",
)
def retry_success_rate(spark, sf_dir):
    rows = domain.lifecycle_events(spark, sf_dir).filter("event_type = 'BackoffTriggered'")
    counted = rows.groupBy("job_id").agg(
        F.count_if(F.col("http_status_code") != 404).alias("ok"), F.count_if(F.col("http_status_code") == 404).alias("bad")
    )
    return counted.select("job_id", metrics.retry_success_rate(F.col("ok"), F.col("bad")).alias("rate"))


@query(
    "metric_retention",
    f"""SELECT metric, count(*) FILTER (WHERE ts >= {_NOW} - INTERVAL 24 HOUR) AS kept,
          count(*) FILTER (WHERE ts < {_NOW} - INTERVAL 24 HOUR) AS expired FROM metric_points GROUP BY 1""",
)
def metric_retention(spark, sf_dir):
    kept, expired = metrics.split_retention(domain.metric_points(spark, sf_dir), _as_of())
    both = kept.select("metric", F.lit(1).alias("k")).unionByName(expired.select("metric", F.lit(0).alias("k")))
    return both.groupBy("metric").agg(F.count_if(F.col("k") == 1).alias("kept"), F.count_if(F.col("k") == 0).alias("expired"))


@query(
    "correlation_chain",
    """SELECT correlation_id, event_id, event_type, CAST(row_number() OVER (PARTITION BY correlation_id
         ORDER BY ts, md5(event_type || '|' || event_id), event_id) AS BIGINT) AS position FROM lifecycle""",
)
def correlation_chain(spark, sf_dir):
    rows = audit.correlation_chain(domain.lifecycle_events(spark, sf_dir), hot_rows=50)
    return rows.select("correlation_id", "event_id", "event_type", "position")


@query(
    "correlation_summary",
    """SELECT correlation_id, count(*) AS event_count, round((max(epoch_us(ts)) - min(epoch_us(ts))) / 1000.0, 3) AS total_duration_ms,
         arg_min(event_type, ts) AS first_event, arg_max(event_type, ts) AS last_event FROM lifecycle GROUP BY 1""",
)
def correlation_summary(spark, sf_dir):
    rows = audit.correlation_summary(domain.lifecycle_events(spark, sf_dir))
    return rows.withColumn("total_duration_ms", F.round("total_duration_ms", 3))


@query(
    "item_throughput",
    """SELECT event_id, CASE WHEN duration_ms > 0 THEN round(collected_items * 1000.0 / duration_ms, 6) ELSE 0 END AS items_per_second,
         CASE WHEN duration_ms > 0 THEN round(collected_size_bytes / 1024.0 / 1024.0 * 1000.0 / duration_ms, 9) ELSE 0 END AS mb_per_second,
         CASE WHEN collected_items > 0 THEN round(collected_size_bytes / CAST(collected_items AS DOUBLE), 6) ELSE 0 END AS average_size
       FROM lifecycle WHERE event_type = 'JobCompleted'""",
)
def item_throughput(spark, sf_dir):
    rows = domain.lifecycle_events(spark, sf_dir).filter("event_type = 'JobCompleted'")
    items, size, ms = F.col("collected_items"), F.col("collected_size_bytes"), F.col("duration_ms")
    return rows.select(
        "event_id",
        F.round(measures.items_per_second(items, ms), 6).alias("items_per_second"),
        F.round(measures.megabytes_per_second(size, ms), 9).alias("mb_per_second"),
        F.round(measures.average_item_size(size, items), 6).alias("average_size"),
    )
