"""Shard, checkpoint and routing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from casetrail.functions import measures
from casetrail.operators import matters, routing, shards
from casetrail.operators.density import DensityOptions, daily_density, density_shards
from casetrail.operators.shards import ShardOptions
from casetrail.plans import domain
from casetrail.plans.catalog import query, stamp

YEARS = ShardOptions(window_days=365, max_shards_per_custodian=5)
SHORT = ShardOptions(window_days=3, max_shards_per_custodian=200)
LONG = ShardOptions(window_days=3650, max_shards_per_custodian=5)


@query(
    "shard_windows",
    """SELECT job_id, custodian, shard_index, CAST(count(*) OVER (PARTITION BY job_id, custodian) AS BIGINT) AS total_shards,
         strftime(from_date, '%Y-%m-%d %H:%M:%S.%f') AS start_date, strftime(to_date, '%Y-%m-%d %H:%M:%S.%f') AS end_date,
         split_part(custodian, '@', 1) || '_' || strftime(from_date, '%Y%m%d') || '_' || strftime(to_date, '%Y%m%d') AS shard_identifier
       FROM windows""",
)
def shard_windows(spark, sf_dir):
    rows = shards.shard_windows(domain.shard_requests(spark, sf_dir)).filter("kind = 'shard'")
    return rows.select(
        "job_id", "custodian", "shard_index", "total_shards", stamp("start_date").alias("start_date"),
        stamp("end_date").alias("end_date"), "shard_identifier",
    )


@query(
    "shard_coverage_gaps",
    """SELECT job_id, custodian, strftime(max(to_date), '%Y-%m-%d %H:%M:%S.%f') AS gap_start,
         strftime(any_value(last_date), '%Y-%m-%d %H:%M:%S.%f') AS gap_end
       FROM windows GROUP BY 1, 2 HAVING max(to_date) < any_value(last_date)
       UNION ALL SELECT r.job_id, c.custodian, strftime(r.start_date, '%Y-%m-%d %H:%M:%S.%f'), strftime(r.end_date, '%Y-%m-%d %H:%M:%S.%f')
       FROM shard_requests r CROSS JOIN unnest(r.custodians) AS c(custodian)
       WHERE r.start_date < r.end_date AND r.end_date - r.start_date < INTERVAL 1 DAY""",
)
def shard_coverage_gaps(spark, sf_dir):
    rows = shards.shard_windows(domain.shard_requests(spark, sf_dir)).filter("kind = 'gap'")
    return rows.select(
        "job_id", "custodian", stamp("start_date").alias("gap_start"), stamp("end_date").alias("gap_end")
    )


@query(
    "sharded_job_metrics",
    """SELECT r.job_id, coalesce(n, 0) AS total_shards, CAST(len(r.custodians) AS BIGINT) AS custodian_count,
         coalesce(n, 0) / CAST(len(r.custodians) AS DOUBLE) AS average_shards_per_custodian,
         round((epoch_us(r.end_date) - epoch_us(r.start_date)) / 86400000000.0, 6) AS date_range_days,
         CAST(coalesce(n, 0) * 2 AS BIGINT) AS estimated_hours
       FROM shard_requests r LEFT JOIN (SELECT job_id, count(*) AS n FROM windows GROUP BY 1) w ON r.job_id = w.job_id""",
)
def sharded_job_metrics(spark, sf_dir):
    requests = domain.shard_requests(spark, sf_dir)
    rows = shards.sharded_job_metrics(requests, shards.shard_windows(requests))
    return rows.select(
        "job_id", "total_shards", "custodian_count", "average_shards_per_custodian",
        F.round("date_range_days", 6).alias("date_range_days"), "estimated_hours",
    )


def _assigned(spark, sf_dir, boundary="half_open"):
    windows = shards.shard_windows(domain.shard_requests(spark, sf_dir), YEARS)
    return shards.assign_items(domain.dated_items(spark, sf_dir), windows, boundary=boundary)


_ASSIGN_SQL = """
  SELECT i.item_key, i.custodian, w.job_id AS shard_job_id, w.shard_index, i.size_bytes
  FROM dated_items i LEFT JOIN (SELECT *, shard_index = max(shard_index) OVER (PARTITION BY job_id, custodian) AS is_last
    FROM year_windows) w
  ON i.custodian = w.custodian AND i.item_date >= w.from_date AND (i.item_date < w.to_date OR (is_last AND i.item_date = w.to_date))"""


@query("item_shard_assignment", f"SELECT item_key, custodian, shard_job_id, shard_index FROM ({_ASSIGN_SQL})")
def item_shard_assignment(spark, sf_dir):
    return _assigned(spark, sf_dir).select("item_key", "custodian", "shard_job_id", "shard_index")


@query(
    "item_shard_assignment_inclusive",
    """SELECT i.item_key, w.shard_index FROM dated_items i LEFT JOIN year_windows w
       ON i.custodian = w.custodian AND i.item_date BETWEEN w.from_date AND w.to_date""",
)
def item_shard_assignment_inclusive(spark, sf_dir):
    return _assigned(spark, sf_dir, "inclusive").select("item_key", "shard_index")


@query(
    "item_window_assignment",
    """SELECT i.item_key, w.job_id AS shard_job_id, w.shard_index FROM dated_items i LEFT JOIN (
         SELECT job_id, custodian, shard_index, from_date, to_date, shard_index = max(shard_index) OVER (PARTITION BY job_id, custodian) AS is_last FROM windows
         UNION ALL SELECT 1000000000 + job_id, custodian, shard_index, from_date, to_date, shard_index = max(shard_index) OVER (PARTITION BY job_id, custodian) FROM short_windows
         UNION ALL SELECT 2000000000 + job_id, custodian, shard_index, from_date, to_date, shard_index = max(shard_index) OVER (PARTITION BY job_id, custodian) FROM long_windows) w
       ON i.custodian = w.custodian AND i.item_date >= w.from_date AND (i.item_date < w.to_date OR (is_last AND i.item_date = w.to_date))""",
)
def item_window_assignment(spark, sf_dir):
    """Items against three plans at once: windows of three days, a month and ten years. Caps leave gaps."""
    requests = domain.shard_requests(spark, sf_dir)
    plans = [
        shards.shard_windows(requests, options).withColumn("job_id", F.col("job_id") + number * 1_000_000_000)
        for number, options in enumerate((ShardOptions(), SHORT, LONG))
    ]
    windows = plans[0].unionByName(plans[1]).unionByName(plans[2])
    return shards.assign_items(domain.dated_items(spark, sf_dir), windows).select("item_key", "shard_job_id", "shard_index")


def _density_sql(max_items, max_bytes, align):
    """The same cuts, one day of every custodian per step of a recursive query."""
    period = f"date_trunc('{align}', d.day)::TIMESTAMP" if align else "CAST(NULL AS TIMESTAMP)"
    fits = lambda n, b: f"({n} = 0 OR ({n} + n <= {max_items} AND {b} + b <= {max_bytes}))"
    return f"""SELECT job_id, custodian, CAST(row_number() OVER (PARTITION BY job_id, custodian ORDER BY from_date) - 1 AS BIGINT) AS shard_index,
         strftime(from_date, '%Y-%m-%d %H:%M:%S.%f') AS start_date, strftime(to_date, '%Y-%m-%d %H:%M:%S.%f') AS end_date,
         n AS estimated_items, b AS estimated_bytes, n > {max_items} OR b > {max_bytes} AS over_limit
       FROM (WITH RECURSIVE daily AS (SELECT custodian, CAST(item_date AS DATE) AS day, count(*) AS n, CAST(sum(size_bytes) AS BIGINT) AS b FROM dated_items GROUP BY 1, 2),
         asked AS (SELECT job_id, c.custodian, start_date, end_date FROM shard_requests r CROSS JOIN unnest(r.custodians) AS c(custodian) WHERE start_date < end_date),
         days AS (SELECT a.job_id, a.custodian, d.day::TIMESTAMP AS day, d.n, d.b, row_number() OVER (PARTITION BY a.job_id, a.custodian ORDER BY d.day) AS k
           FROM asked a JOIN daily d ON a.custodian = d.custodian AND d.day BETWEEN CAST(a.start_date AS DATE) AND CAST(a.end_date - INTERVAL 1 MICROSECOND AS DATE)),
         steps AS (
           SELECT job_id, custodian, CAST(0 AS BIGINT) AS k, start_date AS s, end_date, CAST(0 AS BIGINT) AS items, CAST(0 AS BIGINT) AS bytes,
             CAST(NULL AS TIMESTAMP) AS edge, CAST(0 AS BIGINT) AS ti, CAST(0 AS BIGINT) AS tb, 0 AS act, CAST(NULL AS TIMESTAMP) AS old_s,
             CAST(NULL AS TIMESTAMP) AS old_edge, CAST(NULL AS TIMESTAMP) AS day, CAST(0 AS BIGINT) AS old_items, CAST(0 AS BIGINT) AS old_bytes,
             CAST(0 AS BIGINT) AS old_ti, CAST(0 AS BIGINT) AS old_tb FROM asked
           UNION ALL
           SELECT job_id, custodian, k, CASE a WHEN 0 THEN s WHEN 1 THEN e ELSE day END, end_date,
             CASE a WHEN 0 THEN items WHEN 1 THEN t ELSE 0 END + n, CASE a WHEN 0 THEN bytes WHEN 1 THEN u ELSE 0 END + b,
             CASE a WHEN 0 THEN e END, CASE WHEN a = 0 AND e IS NOT NULL THEN t + n ELSE 0 END, CASE WHEN a = 0 AND e IS NOT NULL THEN u + b ELSE 0 END,
             a, s, e, day, items, bytes, t, u
           FROM (SELECT *, CASE WHEN {fits("items", "bytes")} THEN 0 WHEN e IS NULL OR items = t THEN 3 WHEN {fits("t", "u")} THEN 1 ELSE 2 END AS a
             FROM (SELECT *, CASE WHEN fresh THEN p ELSE edge END AS e, CASE WHEN fresh THEN 0 ELSE ti END AS t, CASE WHEN fresh THEN 0 ELSE tb END AS u
               FROM (SELECT x.job_id, x.custodian, d.k, x.s, x.end_date, x.items, x.bytes, x.edge, x.ti, x.tb, d.day, d.n, d.b, {period} AS p,
                   coalesce({period} > x.s AND (x.edge IS NULL OR {period} > x.edge), false) AS fresh
                 FROM steps x JOIN days d ON x.job_id = d.job_id AND x.custodian = d.custodian AND d.k = x.k + 1))))
         SELECT job_id, custodian, old_s AS from_date, old_edge AS to_date, old_items - old_ti AS n, old_bytes - old_tb AS b FROM steps WHERE act IN (1, 2)
         UNION ALL SELECT job_id, custodian, old_edge, day, old_ti, old_tb FROM steps WHERE act = 2
         UNION ALL SELECT job_id, custodian, old_s, day, old_items, old_bytes FROM steps WHERE act = 3
         UNION ALL SELECT job_id, custodian, s, end_date, items, bytes FROM steps QUALIFY k = max(k) OVER (PARTITION BY job_id, custodian))"""


def _density_rows(spark, sf_dir, options):
    density = daily_density(domain.dated_items(spark, sf_dir))
    rows = density_shards(domain.shard_requests(spark, sf_dir), density, options)
    return rows.select(
        "job_id", "custodian", "shard_index", stamp("start_date").alias("start_date"), stamp("end_date").alias("end_date"),
        "estimated_items", "estimated_bytes", "over_limit",
    )


@query("density_shards", _density_sql(4, 600_000, None))
def density_shards_plain(spark, sf_dir):
    """Shards of at most four items and 600,000 bytes, a day being the least."""
    return _density_rows(spark, sf_dir, DensityOptions(4, 600_000))


@query("density_shards_monthly", _density_sql(5, 900_000, "month"))
def density_shards_monthly(spark, sf_dir):
    """The same with edges on the first of a month where there is one."""
    return _density_rows(spark, sf_dir, DensityOptions(5, 900_000, "month"))


def _shard_table(spark, sf_dir):
    """Planned shards with the work done so far and a state."""
    planned = shards.plan_shards(domain.shard_requests(spark, sf_dir), domain.instant(domain.CREATED), YEARS)
    done = shards.shard_activity(_assigned(spark, sf_dir), "size_bytes")
    joined = planned.join(done, ["job_id", "custodian", "shard_index"], "left")
    items = F.coalesce("processed_items", F.lit(0))
    turn = (F.col("job_id") + F.col("shard_index")) % 6
    status = (
        F.when(turn == 0, "Pending").when(turn == 1, "Assigned").when(turn == 2, "Processing")
        .when(turn == 3, "Running").when(turn == 4, "Completed").otherwise("Failed")
    )
    return (
        joined.withColumn("processed_items", items)
        .withColumn("processed_bytes", F.coalesce("processed_bytes", F.lit(0)))
        .withColumn("estimated_items", F.when(F.col("job_id") % 4 == 0, 0).otherwise(F.lit(20)).cast("long"))
        .withColumn(
            "progress_percentage",
            measures.progress_percentage(F.col("processed_items"), F.col("estimated_items"), F.lit(0.0)),
        )
        .withColumn("status", status)
        .withColumn("lock_expiry", F.when(F.col("job_id") % 5 == 0, F.col("start_date")))
    )


_SHARD_TABLE_SQL = f"""
  SELECT w.job_id, w.custodian, w.shard_index, w.from_date, w.to_date, coalesce(a.n, 0) AS processed_items,
    coalesce(a.b, 0) AS processed_bytes, CASE WHEN w.job_id % 4 = 0 THEN 0 ELSE 20 END AS estimated_items,
    CASE w.job_type WHEN 'Email' THEN 5 WHEN 'OneDrive' THEN 10 WHEN 'SharePoint' THEN 20 WHEN 'Teams' THEN 2 WHEN 'Mixed' THEN 25 ELSE 1 END
      * CAST(1073741824 AS BIGINT) AS estimated_bytes,
    CASE WHEN w.job_id % 4 = 0 THEN 0.0 ELSE least(100.0, CAST(coalesce(a.n, 0) AS DOUBLE) / 20 * 100) END AS progress,
    CASE (w.job_id + w.shard_index) % 6 WHEN 0 THEN 'Pending' WHEN 1 THEN 'Assigned' WHEN 2 THEN 'Processing' WHEN 3 THEN 'Running'
      WHEN 4 THEN 'Completed' ELSE 'Failed' END AS status,
    CASE WHEN w.job_id % 5 = 0 THEN w.from_date END AS lock_expiry
  FROM year_windows w LEFT JOIN (SELECT shard_job_id, custodian, shard_index, count(*) AS n, sum(size_bytes) AS b
    FROM ({_ASSIGN_SQL}) WHERE shard_index IS NOT NULL GROUP BY 1, 2, 3) a
  ON w.job_id = a.shard_job_id AND w.custodian = a.custodian AND w.shard_index = a.shard_index"""


@query(
    "job_progress",
    f"""SELECT job_id, count(*) AS total_shards, count(*) FILTER (WHERE status = 'Completed') AS completed_shards,
         count(*) FILTER (WHERE status = 'Failed') AS failed_shards,
         count(*) FILTER (WHERE status IN ('Processing', 'Running')) AS processing_shards,
         count(*) FILTER (WHERE status IN ('Pending', 'Assigned')) AS pending_shards,
         round(avg(progress), 6) AS overall_progress, CAST(sum(processed_items) AS BIGINT) AS items_processed,
         CAST(sum(processed_bytes) AS BIGINT) AS bytes_processed, CAST(sum(estimated_items) AS BIGINT) AS estimated_items,
         CAST(sum(estimated_bytes) AS BIGINT) AS estimated_bytes,
         CAST(CASE WHEN sum(processed_items) > 0 THEN floor(86400 * 30.0 * (greatest(sum(estimated_items) - sum(processed_items), 0) / sum(processed_items))) END AS BIGINT)
           AS remaining_seconds
       FROM ({_SHARD_TABLE_SQL}) GROUP BY 1""",
)
def job_progress(spark, sf_dir):
    # Thirty days after the shards were created.
    rows = shards.job_progress(_shard_table(spark, sf_dir), domain.instant("2024-07-01 00:00:00"))
    return rows.drop("estimated_completion").withColumn("overall_progress", F.round("overall_progress", 6))


_WINDOW_ESTIMATES = """CASE job_type WHEN 'Email' THEN 5 WHEN 'OneDrive' THEN 10 WHEN 'SharePoint' THEN 20 WHEN 'Teams' THEN 2 WHEN 'Mixed' THEN 25 ELSE 1 END
  * CAST(1073741824 AS BIGINT)"""


@query(
    "shard_routes",
    f"""SELECT job_id, custodian, shard_index, CASE WHEN b + 85899345920 < 107374182400 THEN 'GraphApi' ELSE 'GraphDataConnect' END AS route,
         CASE WHEN b + 85899345920 < 107374182400 THEN CAST(0.9 AS DOUBLE) ELSE CAST(0.8 AS DOUBLE) END AS route_confidence
       FROM (SELECT *, {_WINDOW_ESTIMATES} AS b FROM windows)""",
)
def shard_routes(spark, sf_dir):
    """Every shard of a plan with its route, 80 GiB of the quota being used."""
    rows = shards.plan_shards(domain.shard_requests(spark, sf_dir), domain.instant(domain.CREATED), used_bytes=F.lit(80 << 30))
    return rows.select("job_id", "custodian", "shard_index", "route", F.col("route_confidence").cast("double").alias("route_confidence"))


@query(
    "shard_size_split",
    f"""WITH w AS (SELECT *, {_WINDOW_ESTIMATES} AS b, CAST(floor((epoch_us(to_date) - epoch_us(from_date)) / 86400000000.0) AS BIGINT) AS days FROM windows),
         p AS (SELECT *, CAST(least(greatest(ceil(b / 4294967296.0), 1), greatest(days, 1)) AS BIGINT) AS parts FROM w)
       SELECT job_id, custodian, shard_index, part, CAST(b // parts + CASE WHEN part < b % parts THEN 1 ELSE 0 END AS BIGINT) AS estimated_bytes,
         strftime(make_timestamp(CAST(epoch_us(from_date) + (epoch_us(to_date) - epoch_us(from_date)) * part // parts AS BIGINT)), '%Y-%m-%d %H:%M:%S.%f') AS start_date
       FROM (SELECT *, CAST(unnest(range(parts)) AS INTEGER) AS part FROM p)""",
)
def shard_size_split(spark, sf_dir):
    """Shards above 4 GiB in parts."""
    options = ShardOptions(max_shard_bytes=4 << 30, max_shard_items=1 << 40)
    planned = shards.plan_shards(domain.shard_requests(spark, sf_dir), domain.instant(domain.CREATED))
    rows = shards.split_by_size(planned, options)
    return rows.select("job_id", "custodian", "shard_index", "part", "estimated_bytes", stamp("start_date").alias("start_date"))


@query(
    "shard_status_histogram",
    f"SELECT job_id, status, count(*) AS shard_count FROM ({_SHARD_TABLE_SQL}) GROUP BY 1, 2",
)
def shard_status_histogram(spark, sf_dir):
    return shards.shard_status_histogram(_shard_table(spark, sf_dir))


@query(
    "active_shards",
    f"SELECT job_id, custodian, shard_index, processed_items FROM ({_SHARD_TABLE_SQL}) WHERE status IN ('Processing', 'Running')",
)
def active_shards(spark, sf_dir):
    return shards.active_shards(_shard_table(spark, sf_dir)).select("job_id", "custodian", "shard_index", "processed_items")


@query(
    "shard_validity",
    f"""SELECT job_id, custodian, shard_index, CASE WHEN status NOT IN ('Assigned', 'Retrying') THEN 'InvalidState'
          WHEN lock_expiry < TIMESTAMP '1998-01-01' THEN 'LockExpired' WHEN from_date >= to_date THEN 'InvalidDateRange' END AS invalid_reason
        FROM ({_SHARD_TABLE_SQL})""",
)
def shard_validity(spark, sf_dir):
    rows = shards.shard_validity(_shard_table(spark, sf_dir), domain.instant("1998-01-01 00:00:00"))
    return rows.select("job_id", "custodian", "shard_index", "invalid_reason")


@query(
    "shard_backlog_top_k",
    f"""SELECT job_id, custodian, shard_index FROM ({_SHARD_TABLE_SQL})
        WHERE status = 'Pending' AND (lock_expiry IS NULL OR lock_expiry < TIMESTAMP '2000-01-01')
        ORDER BY shard_index, job_id, custodian LIMIT 25""",
)
def shard_backlog_top_k(spark, sf_dir):
    rows = matters.shard_backlog(_shard_table(spark, sf_dir), domain.instant(domain.AS_OF_JOBS), 25)
    return rows.select("job_id", "custodian", "shard_index")


@query(
    "sharding_recommendation",
    """SELECT job_id, days * n > 365 OR n > 5 OR days > 90 AS should_shard,
         CASE WHEN days * n > 365 OR n > 5 OR days > 90 THEN 'Job should be sharded due to: ' ||
           array_to_string([x FOR x IN [CASE WHEN days > 90 THEN 'Long date range (' || printf('%.0f', round(days)) || ' days)' END,
             CASE WHEN n > 5 THEN 'Many custodians (' || n || ')' END,
             CASE WHEN days * n > 365 THEN 'Large total scope (' || printf('%.0f', round(days * n)) || ' custodian-days)' END]
             IF x IS NOT NULL], ', ')
           ELSE 'Job is small enough to process without sharding' END AS reason,
         CAST(greatest(1, ceil(days * n / 30)) AS BIGINT) AS recommended_shards,
         round(least(30.0, days / greatest(1, floor(greatest(1, ceil(days * n / 30)) / n))), 6) AS recommended_window_days,
         CAST(floor(greatest(1, ceil(days * n / 30)) / n) AS BIGINT) AS recommended_shards_per_custodian
       FROM (SELECT job_id, (epoch_us(end_date) - epoch_us(start_date)) / 86400000000.0 AS days, len(custodians) AS n FROM shard_requests)""",
)
def sharding_recommendation(spark, sf_dir):
    rows = shards.sharding_recommendation(domain.shard_requests(spark, sf_dir))
    return rows.select(
        "job_id", "should_shard", "reason", "recommended_shards",
        F.round("recommended_window_days", 6).alias("recommended_window_days"), "recommended_shards_per_custodian",
    )


@query(
    "last_checkpoint",
    """SELECT shard_id, checkpoint_type, checkpoint_id, strftime(created_date, '%Y-%m-%d %H:%M:%S.%f') AS created_date
       FROM checkpoints WHERE is_completed
       QUALIFY row_number() OVER (PARTITION BY shard_id, checkpoint_type ORDER BY checkpoints.created_date DESC, checkpoint_id DESC) = 1""",
)
def last_checkpoint(spark, sf_dir):
    rows = shards.last_checkpoints(domain.checkpoints(spark, sf_dir))
    return rows.select("shard_id", "checkpoint_type", "checkpoint_id", stamp("created_date").alias("created_date"))


@query(
    "checkpoint_sequence_errors",
    """SELECT shard_id, checkpoint_type, prev_id AS incomplete_id, checkpoint_id AS completed_id,
         'Checkpoint sequence error in ' || checkpoint_type || ': incomplete checkpoint ' || prev_id || ' followed by completed ' || checkpoint_id AS error
       FROM checkpoint_pairs WHERE is_completed AND NOT prev_completed""",
)
def checkpoint_sequence_errors(spark, sf_dir):
    return shards.sequence_errors(domain.checkpoints(spark, sf_dir), hot_rows=10)


@query(
    "checkpoint_validation",
    """SELECT shard_id, count(*) AS total_checkpoints, count(*) FILTER (WHERE is_completed) AS completed_checkpoints,
         count(*) FILTER (WHERE NOT is_completed) AS incomplete_checkpoints,
         count(*) FILTER (WHERE is_completed AND NOT prev_completed) AS error_count,
         count(*) FILTER (WHERE is_completed AND NOT prev_completed) = 0 AS is_valid
       FROM checkpoint_pairs GROUP BY 1""",
)
def checkpoint_validation(spark, sf_dir):
    return shards.checkpoint_validation(domain.checkpoints(spark, sf_dir))


@query(
    "resume_set",
    """SELECT shard_id, checkpoint_id, checkpoint_type FROM checkpoints WHERE NOT is_completed
         AND shard_id NOT IN (SELECT shard_id FROM checkpoint_pairs WHERE is_completed AND NOT prev_completed)""",
)
def resume_set(spark, sf_dir):
    return shards.resume_set(domain.checkpoints(spark, sf_dir)).select("shard_id", "checkpoint_id", "checkpoint_type")


@query(
    "checkpoint_payloads",
    """SELECT event_id AS checkpoint_id, CASE event_type WHEN 'view' THEN 'f' || event_id WHEN 'click' THEN 'd' || event_id
         WHEN 'error' THEN 's/l' || event_id WHEN 'signup' THEN 't/c' || event_id ELSE 'b' END AS container,
         CASE WHEN event_type = 'view' THEN 'tok' END AS delta_token, event_id % 100 AS items_processed FROM events""",
)
def checkpoint_payloads(spark, sf_dir):
    payload = measures.checkpoint_payload(F.col("checkpoint_data"))
    rows = domain.checkpoints(spark, sf_dir).select("checkpoint_id", payload.alias("p"))
    return rows.select("checkpoint_id", "p.container", "p.delta_token", "p.items_processed")


@query(
    "heartbeat_gaps",
    """SELECT worker_id, strftime(prev, '%Y-%m-%d %H:%M:%S.%f') AS silent_from, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS silent_to
       FROM (SELECT worker_id, ts, lag(ts) OVER (PARTITION BY worker_id ORDER BY ts) AS prev FROM heartbeats)
       WHERE ts - prev > INTERVAL 30 MINUTE""",
)
def heartbeat_gaps(spark, sf_dir):
    rows = shards.heartbeat_gaps(domain.heartbeats(spark, sf_dir), hot_rows=100)
    return rows.select("worker_id", stamp("silent_from").alias("silent_from"), stamp("silent_to").alias("silent_to"))


_ROOM = "used_bytes < 107374182400 AND used_items < 500000"
_FITS = "estimated_bytes + used_bytes < 107374182400 AND estimated_items + used_items < 500000"


@query(
    "route_decision",
    f"""SELECT request_id, CAST(estimated_bytes AS BIGINT) AS estimated_bytes, CAST(estimated_items AS BIGINT) AS estimated_items,
          CASE WHEN {_ROOM} AND {_FITS} THEN 'GraphApi' ELSE 'GraphDataConnect' END AS route,
          CASE WHEN NOT ({_ROOM}) THEN 'Current quota usage exceeds Graph API thresholds'
            WHEN {_FITS} THEN 'Collection fits within Graph API limits' ELSE 'Collection would exceed Graph API limits' END AS reason,
          CAST(CASE WHEN {_ROOM} AND NOT ({_FITS}) THEN 0.8 ELSE 0.9 END AS DOUBLE) AS confidence
        FROM collection_requests""",
)
def route_decision(spark, sf_dir):
    requests = routing.with_estimates(domain.collection_requests(spark, sf_dir))
    rows = routing.decide_route(requests, F.col("used_bytes"), F.col("used_items"))
    return rows.select("request_id", "estimated_bytes", "estimated_items", "route", "reason", "confidence")


@query(
    "route_from_history",
    """SELECT r.request_id, CAST(coalesce(h.b, r.estimated_bytes) AS BIGINT) AS estimated_bytes,
         CAST(coalesce(h.n, r.estimated_items) AS BIGINT) AS estimated_items
       FROM collection_requests r LEFT JOIN (SELECT custodian, job_type, quantile_disc(actual_bytes, 0.5) AS b, CAST(round(avg(actual_items)) AS BIGINT) AS n
         FROM jobs WHERE status = 'Completed' GROUP BY 1, 2) h ON r.custodian = h.custodian AND r.job_type = h.job_type""",
)
def route_from_history(spark, sf_dir):
    history = routing.size_history(domain.jobs(spark, sf_dir))
    rows = routing.with_estimates(domain.collection_requests(spark, sf_dir), history)
    return rows.select("request_id", "estimated_bytes", "estimated_items")


@query(
    "request_priority",
    """WITH r AS (SELECT *, (epoch_us(end_date) - epoch_us(coalesce(start_date, TIMESTAMP '2024-02-15'))) / 86400000000.0 AS d,
           trunc((epoch_us(coalesce(end_date, TIMESTAMP '2024-02-15')) - epoch_us(coalesce(start_date, TIMESTAMP '2024-01-16'))) / 86400000000.0) AS days
         FROM collection_requests)
       SELECT request_id, CASE WHEN job_type = 'Email' AND trunc(d) <= 7 THEN 'High' WHEN job_type = 'Teams' THEN 'High'
           WHEN job_type = 'Mixed' THEN 'Medium' ELSE 'Normal' END AS priority,
         CAST(CASE job_type WHEN 'Email' THEN greatest(30, days * 2) WHEN 'OneDrive' THEN greatest(45, days * 3)
           WHEN 'SharePoint' THEN greatest(60, days * 4) WHEN 'Teams' THEN greatest(20, days * 1.5)
           WHEN 'Mixed' THEN greatest(90, days * 5) ELSE 30 END AS DOUBLE) AS minutes
       FROM r""",
)
def request_priority(spark, sf_dir):
    as_of = domain.instant(domain.AS_OF_CURSORS)
    kind, start, end = F.col("job_type"), F.col("start_date"), F.col("end_date")
    return domain.collection_requests(spark, sf_dir).select(
        "request_id",
        measures.request_priority(kind, start, end, as_of).alias("priority"),
        measures.estimated_minutes(kind, start, end, as_of).alias("minutes"),
    )
