"""Cursor and change queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from casetrail.operators import delta
from casetrail.operators.ordering import latest_by
from casetrail.plans import domain
from casetrail.plans.catalog import query, stamp


def _as_of():
    return domain.instant(domain.AS_OF_CURSORS)


@query(
    "delta_collectable",
    """SELECT item_id, version, scope_id FROM changes WHERE NOT deleted AND (delta_type = 'Mail' OR (NOT is_folder AND is_file))""",
)
def delta_collectable(spark, sf_dir):
    return delta.split_changes(domain.changes(spark, sf_dir))[0].select("item_id", "version", "scope_id")


@query("delta_tombstones", "SELECT item_id, version, scope_id FROM changes WHERE deleted")
def delta_tombstones(spark, sf_dir):
    return delta.split_changes(domain.changes(spark, sf_dir))[1].select("item_id", "version", "scope_id")


@query(
    "cursor_active",
    "SELECT job_id, scope_id, strftime(last_delta_time, '%Y-%m-%d %H:%M:%S.%f') AS last_delta_time FROM cursors WHERE is_active",
)
def cursor_active(spark, sf_dir):
    rows = delta.active_cursors(domain.cursors(spark, sf_dir))
    return rows.select("job_id", "scope_id", stamp("last_delta_time").alias("last_delta_time"))


@query("cursor_latest", "SELECT scope_id, delta_type, job_id, delta_token FROM latest_cursors")
def cursor_latest(spark, sf_dir):
    return delta.latest_cursors(domain.cursors(spark, sf_dir)).select("scope_id", "delta_type", "job_id", "delta_token")


@query(
    "cursor_due",
    "SELECT job_id, scope_id FROM cursors WHERE is_active AND TIMESTAMP '2024-02-15' - last_delta_time >= INTERVAL 60 MINUTE",
)
def cursor_due(spark, sf_dir):
    return delta.due_cursors(domain.cursors(spark, sf_dir), _as_of()).select("job_id", "scope_id")


@query(
    "cursor_stale",
    "SELECT job_id, scope_id FROM cursors WHERE is_active AND last_delta_time < TIMESTAMP '2024-02-15' - INTERVAL 30 DAY",
)
def cursor_stale(spark, sf_dir):
    return delta.stale_cursors(domain.cursors(spark, sf_dir), _as_of()).select("job_id", "scope_id")


@query(
    "cursor_mark_stale",
    """SELECT job_id, is_active AND NOT last_delta_time < TIMESTAMP '2024-02-15' - INTERVAL 30 DAY AS is_active,
         CASE WHEN is_active AND last_delta_time < TIMESTAMP '2024-02-15' - INTERVAL 30 DAY THEN 'Marked stale during cleanup' END AS error_message
       FROM cursors""",
)
def cursor_mark_stale(spark, sf_dir):
    return delta.mark_stale(domain.cursors(spark, sf_dir), _as_of()).select("job_id", "is_active", "error_message")


@query(
    "delta_or_full",
    """SELECT r.request_id, lower(r.delta_type) || ':' || lower(r.custodian) AS scope_id,
         CASE WHEN r.delta_type NOT IN ('Mail', 'OneDrive') THEN 'Delta not supported for type'
           WHEN c.scope_id IS NULL THEN 'No baseline cursor exists' WHEN c.failure_count > 3 THEN 'Reset to full collection mode'
           WHEN TIMESTAMP '2024-02-15' - c.last_delta_time > INTERVAL 30 DAY THEN 'Cursor too stale, full resync needed'
           ELSE 'Recent baseline available' END AS reason
       FROM delta_requests r LEFT JOIN latest_cursors c ON lower(r.delta_type) || ':' || lower(r.custodian) = c.scope_id""",
)
def delta_or_full(spark, sf_dir):
    rows = delta.delta_or_full(domain.delta_requests(spark, sf_dir), domain.cursors(spark, sf_dir), _as_of())
    return rows.select("request_id", "scope_id", "reason")


@query(
    "cursor_as_of",
    """WITH r AS (SELECT c_custkey AS request_id, CASE WHEN c_custkey % 4 = 0 THEN 'mail' ELSE 'onedrive' END || ':u' || (c_custkey % 710) || '@x.org' AS scope_id,
           TIMESTAMP '2024-02-01' + to_minutes((c_custkey * 7) % 1600) AS requested_at FROM customer),
         h AS (SELECT scope_id, updated_date, job_id, delta_token FROM cursors WHERE is_active)
       SELECT r.request_id, r.scope_id, h.job_id, h.delta_token FROM r ASOF LEFT JOIN h ON r.scope_id = h.scope_id AND r.requested_at >= h.updated_date""",
)
def cursor_as_of(spark, sf_dir):
    """The cursor that was current when each request came, from a history with several rows per scope."""
    requests = domain.table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS request_id",
        "concat(CASE WHEN c_custkey % 4 = 0 THEN 'mail' ELSE 'onedrive' END, ':u', c_custkey % 710, '@x.org') AS scope_id",
        "CASE WHEN c_custkey % 4 = 0 THEN 'Mail' ELSE 'OneDrive' END AS delta_type",
        "timestampadd(MINUTE, cast((c_custkey * 7) % 1600 AS INT), TIMESTAMP '2024-02-01 00:00:00') AS requested_at",
    )
    found = delta.cursors_as_of(requests, domain.cursors(spark, sf_dir))
    return found.select("request_id", "scope_id", "cursor.job_id", "cursor.delta_token")


def _base_and_changes(spark, sf_dir):
    rows = domain.changes(spark, sf_dir)
    until = domain.instant(domain.BASE_UNTIL)
    base = latest_by(rows.filter(F.col("ts") < until), ["item_id"], [F.col("version")]).filter("NOT deleted")
    return base, rows.filter(F.col("ts") >= until)


@query(
    "delta_apply",
    """WITH base AS (SELECT * FROM (SELECT * FROM changes WHERE ts < TIMESTAMP '2024-01-15'
           QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY version DESC) = 1) WHERE NOT deleted)
       SELECT item_id, version, size_bytes, scope_id FROM (
         SELECT * FROM (SELECT * FROM base UNION ALL SELECT * FROM changes WHERE ts >= TIMESTAMP '2024-01-15')
         QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY version DESC) = 1) WHERE NOT deleted""",
)
def delta_apply(spark, sf_dir):
    base, changes = _base_and_changes(spark, sf_dir)
    return delta.apply_changes(base, changes).select("item_id", "version", "size_bytes", "scope_id")


@query(
    "delta_query_results",
    """SELECT scope_id, count(*) FILTER (WHERE live) AS item_count, CAST(coalesce(sum(size_bytes) FILTER (WHERE live), 0) AS BIGINT) AS total_bytes,
         CAST(max(version) AS VARCHAR) AS next_token
       FROM (SELECT *, NOT deleted AND (delta_type = 'Mail' OR (NOT is_folder AND is_file)) AS live FROM changes) GROUP BY 1""",
)
def delta_query_results(spark, sf_dir):
    return delta.query_results(domain.changes(spark, sf_dir))


@query(
    "cursor_advance",
    """WITH r AS (SELECT scope_id, count(*) FILTER (WHERE live) AS n, coalesce(sum(size_bytes) FILTER (WHERE live), 0) AS b, max(version) AS v
         FROM (SELECT *, NOT deleted AND (delta_type = 'Mail' OR (NOT is_folder AND is_file)) AS live FROM changes) GROUP BY 1)
       SELECT c.scope_id, CASE WHEN r.v IS NOT NULL THEN CAST(r.v AS VARCHAR) ELSE c.delta_token END AS delta_token,
         CAST(CASE WHEN r.v IS NOT NULL THEN r.n ELSE c.last_delta_item_count END AS BIGINT) AS last_delta_item_count,
         CAST(CASE WHEN r.v IS NOT NULL THEN r.b ELSE c.last_delta_size_bytes END AS BIGINT) AS last_delta_size_bytes,
         c.delta_query_count + CASE WHEN r.v IS NOT NULL THEN 1 ELSE 0 END AS delta_query_count,
         strftime(CASE WHEN r.v IS NOT NULL THEN coalesce(c.baseline_completed_at, TIMESTAMP '2024-02-15') ELSE c.baseline_completed_at END,
           '%Y-%m-%d %H:%M:%S.%f') AS baseline_completed_at
       FROM latest_cursors c LEFT JOIN r ON c.scope_id = r.scope_id""",
)
def cursor_advance(spark, sf_dir):
    results = delta.query_results(domain.changes(spark, sf_dir))
    rows = delta.advance_cursors(delta.latest_cursors(domain.cursors(spark, sf_dir)), results, _as_of())
    return rows.select(
        "scope_id", "delta_token", "last_delta_item_count", "last_delta_size_bytes", "delta_query_count",
        stamp("baseline_completed_at").alias("baseline_completed_at"),
    )


def _commands(spark, sf_dir):
    return domain.table(spark, sf_dir, "customer").selectExpr(
        "concat('u', c_custkey % 1000, '@x.org') AS custodian",
        "CASE WHEN c_custkey % 2 = 0 THEN 'Mail' ELSE 'OneDrive' END AS delta_type",
        "CASE WHEN c_custkey % 4 < 2 THEN 'initialise' ELSE 'reset' END AS action",
        "timestampadd(MINUTE, cast(c_custkey AS INT), TIMESTAMP '2024-02-20 00:00:00') AS ts",
        "c_custkey AS job_id",
    )


@query(
    "cursor_commands",
    """WITH cmd AS (SELECT CASE WHEN c_custkey % 2 = 0 THEN 'mail' ELSE 'onedrive' END || ':u' || (c_custkey % 1000) || '@x.org' AS scope_id,
           CASE WHEN c_custkey % 4 < 2 THEN 'initialise' ELSE 'reset' END AS action, c_custkey AS k FROM customer),
         last AS (SELECT scope_id, arg_max(action, k) AS action, bool_or(action = 'reset') AS had_reset,
           bool_or(action = 'initialise') AS had_init FROM cmd GROUP BY 1)
       SELECT coalesce(c.scope_id, l.scope_id) AS scope_id,
         CASE WHEN c.scope_id IS NULL OR (l.action = 'initialise' AND l.had_reset) THEN '' ELSE c.delta_token END AS delta_token,
         CASE l.action WHEN 'initialise' THEN TRUE WHEN 'reset' THEN FALSE ELSE c.is_active END AS is_active,
         CASE WHEN l.action = 'reset' THEN 'Reset by user/system' END AS error_message
       FROM latest_cursors c FULL OUTER JOIN last l ON c.scope_id = l.scope_id
       WHERE c.scope_id IS NOT NULL OR l.had_init""",
)
def cursor_commands(spark, sf_dir):
    rows = delta.apply_commands(delta.latest_cursors(domain.cursors(spark, sf_dir)), _commands(spark, sf_dir))
    return rows.select("scope_id", "delta_token", "is_active", "error_message")
