"""The domain views as SQL for a second engine, written independently of the operators."""

from __future__ import annotations

import re

_JOB_TYPE = (
    "CASE {k} % 6 WHEN 0 THEN 'Email' WHEN 1 THEN 'OneDrive' WHEN 2 THEN 'SharePoint' "
    "WHEN 3 THEN 'Teams' WHEN 4 THEN 'Mixed' ELSE 'Other' END"
)


def stamp(column: str) -> str:
    """A timestamp as text, to the microsecond."""
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S.%f')"


VIEWS: dict[str, str] = {
    "source_manifest": r"""
        SELECT doc_id, 'job-' || (doc_id % 7) AS job_id, 'u' || (doc_id % 7) || '@x.org' AS custodian,
          source AS drive_id, CASE WHEN doc_id % 10 <> 3 THEN 'd' || doc_id END AS item_id,
          '\' || lang || '\' || CASE WHEN doc_id % 40 = 5 THEN 'Versions\' ELSE '' END || 'Doc' || doc_id || '.TXT' AS path,
          n_chars AS size, TIMESTAMP '2024-01-01' + to_minutes(doc_id) AS last_modified, sha256(text) AS sha256,
          CASE WHEN doc_id % 50 = 0 THEN 'Folder' ELSE 'File' END AS kind
        FROM documents""",
    "collected_manifest": r"""
        SELECT doc_id, job_id, custodian, drive_id, item_id, upper(replace(path, '\', '/')) AS path, size, last_modified,
          CASE WHEN doc_id % 23 = 0 THEN '0' || substr(upper(sha256), 2) ELSE upper(sha256) END AS sha256, kind
        FROM source_manifest WHERE doc_id % 17 <> 0
        UNION ALL
        SELECT doc_id, job_id, custodian, drive_id, 'x' || doc_id, upper(replace(path, '\', '/')), size, last_modified,
          CASE WHEN doc_id % 23 = 0 THEN '0' || substr(upper(sha256), 2) ELSE upper(sha256) END, kind
        FROM source_manifest WHERE doc_id % 101 = 1""",
    "source_scoped": r"""
        SELECT * REPLACE (lower(trim(replace(path, '\', '/'), '/')) AS path) FROM source_manifest
        WHERE lower(kind) <> 'folder' AND NOT ends_with(path, '/')
          AND NOT contains(lower(trim(replace(path, '\', '/'), '/')), '/recoverableitems/')
          AND NOT contains(lower(trim(replace(path, '\', '/'), '/')), '/versions/')
          AND NOT contains(lower(trim(replace(path, '\', '/'), '/')), '/recyclebin/')""",
    "collected_scoped": r"""
        SELECT * REPLACE (lower(trim(replace(path, '\', '/'), '/')) AS path) FROM collected_manifest
        WHERE lower(kind) <> 'folder' AND NOT ends_with(path, '/')
          AND NOT contains(lower(trim(replace(path, '\', '/'), '/')), '/recoverableitems/')
          AND NOT contains(lower(trim(replace(path, '\', '/'), '/')), '/versions/')
          AND NOT contains(lower(trim(replace(path, '\', '/'), '/')), '/recyclebin/')""",
    "source_keyed": """
        SELECT *, CASE WHEN coalesce(item_id, '') <> '' THEN item_id ELSE
          coalesce(drive_id, '') || '|' || path || '|' || size || '|' || strftime(last_modified, '%Y-%m-%dT%H:%M:%SZ') END AS key
        FROM source_scoped""",
    "collected_keyed": """
        SELECT *, CASE WHEN coalesce(item_id, '') <> '' THEN item_id ELSE
          coalesce(drive_id, '') || '|' || path || '|' || size || '|' || strftime(last_modified, '%Y-%m-%dT%H:%M:%SZ') END AS key
        FROM collected_scoped""",
    "recon_counts": """
        SELECT coalesce(s.job_id, c.job_id) AS job_id, coalesce(s.custodian, c.custodian) AS custodian,
          count(s.key) AS source_count, count(c.key) AS collected_count,
          count(*) FILTER (WHERE c.key IS NULL) AS missed_count, count(*) FILTER (WHERE s.key IS NULL) AS extra_count,
          count(*) FILTER (WHERE lower(s.sha256) <> lower(c.sha256)) AS hash_mismatch_count,
          CAST(coalesce(sum(s.size), 0) AS BIGINT) AS source_bytes, CAST(coalesce(sum(c.size), 0) AS BIGINT) AS collected_bytes
        FROM source_keyed s FULL OUTER JOIN collected_keyed c
          ON s.job_id = c.job_id AND s.custodian = c.custodian AND s.key = c.key
        GROUP BY 1, 2""",
    "recon_gates": """
        SELECT *, collected_bytes - source_bytes AS size_delta_bytes,
          CASE WHEN source_bytes = 0 THEN 0 ELSE abs(collected_bytes - source_bytes) / CAST(source_bytes AS DOUBLE) * 100 END AS size_delta_pct,
          CASE WHEN source_count = 0 THEN 0 ELSE CAST(extra_count AS DOUBLE) / source_count * 100 END AS extras_pct
        FROM recon_counts""",
    "jobs": f"""
        SELECT o_orderkey AS job_id, CAST(c_nationkey AS BIGINT) AS matter_id, 'c' || o_custkey || '@x.org' AS custodian,
          {_JOB_TYPE.format(k="o_orderkey")} AS job_type,
          CASE o_orderstatus WHEN 'F' THEN 'Completed' WHEN 'O' THEN 'Pending' ELSE 'Running' END AS status,
          CASE WHEN o_orderkey % 3 = 0 THEN 'GraphDataConnect' ELSE 'GraphApi' END AS route,
          CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS priority, o_orderdate AS created_date,
          o_orderdate + to_hours(1) AS start_time, o_orderdate + to_minutes(60 + o_orderkey % 600) AS end_time,
          CAST(floor(o_totalprice) AS BIGINT) AS estimated_bytes,
          CASE WHEN o_orderstatus = 'F' THEN CAST(floor(o_totalprice) AS BIGINT) ELSE 0 END AS actual_bytes,
          o_orderkey % 1000 AS estimated_items,
          CASE WHEN o_orderstatus = 'F' THEN o_orderkey % 1000 ELSE 0 END AS actual_items,
          'w' || (o_orderkey % 13) AS assigned_worker_id,
          CASE WHEN o_orderkey % 4 = 0 THEN o_orderdate + to_minutes(30) END AS lock_expiry
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "items": """
        SELECT l_orderkey AS job_id, l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS item_id,
          CASE l_linestatus WHEN 'O' THEN 'Email' ELSE 'File' END AS item_type, 'Part ' || l_partkey AS subject,
          l_shipdate AS item_date, l_shipdate AS collected_date, CAST(floor(l_extendedprice) AS BIGINT) AS size_bytes,
          sha256(l_orderkey || '|' || l_partkey || '|' || l_suppkey || '|' || l_linenumber || '|' ||
            CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) || '|' || l_returnflag || '|' || l_linestatus || '|' ||
            strftime(l_shipdate, '%Y-%m-%d')) AS sha256,
          l_returnflag <> 'R' AS is_successful
        FROM lineitem""",
    "sequenced": """
        SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY collected_date, md5(item_id), item_id, sha256) AS sequence
        FROM items""",
    "items_digest": """
        SELECT job_id, sha256(string_agg(d, '' ORDER BY chunk)) AS items_hash, CAST(sum(n) AS BIGINT) AS items_hash_rows
        FROM (SELECT job_id, (sequence - 1) // 250000 AS chunk, sha256(string_agg(sha256, '' ORDER BY sequence)) AS d, count(*) AS n
          FROM sequenced GROUP BY 1, 2) GROUP BY 1""",
    "totals": """
        SELECT job_id, count(*) AS total_items, count(*) FILTER (WHERE is_successful) AS successful_items,
          count(*) FILTER (WHERE NOT is_successful) AS failed_items,
          CAST(coalesce(sum(size_bytes) FILTER (WHERE is_successful), 0) AS BIGINT) AS total_size_bytes
        FROM items GROUP BY 1""",
    "built_manifests": """
        SELECT j.job_id, 'm' || j.job_id AS manifest_id, j.matter_id, j.custodian, j.job_type,
          coalesce(total_items, 0) AS total_items, coalesce(successful_items, 0) AS successful_items,
          coalesce(failed_items, 0) AS failed_items, coalesce(total_size_bytes, 0) AS total_size_bytes,
          coalesce(items_hash, sha256('')) AS items_hash
        FROM jobs j LEFT JOIN totals t ON j.job_id = t.job_id LEFT JOIN items_digest d ON j.job_id = d.job_id""",
    "hashed_manifests": """
        SELECT *, sha256('{"manifestId":"' || manifest_id || '","jobId":' || job_id || ',"matterId":' || matter_id ||
          ',"custodian":"' || custodian || '","jobType":"' || job_type || '","totalItems":' || total_items ||
          ',"totalSizeBytes":' || total_size_bytes || ',"createdDate":"2024-06-01T00:00:00Z","itemsHash":"' || items_hash ||
          '","itemsHashScheme":"sha256-chunks-250000"}')
          AS manifest_hash
        FROM built_manifests""",
    "stored_manifests": """
        SELECT manifest_id, CASE WHEN job_id % 21 = 0 THEN -job_id - 1 ELSE job_id END AS job_id,
          CASE WHEN job_id % 15 = 0 THEN NULL WHEN job_id % 10 = 0 THEN 'x' || substr(items_hash, 2) ELSE items_hash END AS items_hash,
          CASE WHEN job_id % 14 = 0 THEN 'x' || substr(manifest_hash, 2) ELSE upper(manifest_hash) END AS manifest_hash
        FROM hashed_manifests""",
    "verified": """
        SELECT s.manifest_id, s.job_id,
          CASE WHEN h.job_id IS NULL THEN 'Error' WHEN s.items_hash IS NULL THEN 'Inconclusive'
            WHEN lower(s.items_hash) = h.items_hash AND lower(s.manifest_hash) = h.manifest_hash THEN 'Valid' ELSE 'Invalid' END AS result
        FROM stored_manifests s LEFT JOIN hashed_manifests h ON s.job_id = h.job_id""",
    "verifications": """
        SELECT 'm' || l_orderkey AS manifest_id, l_shipdate AS verification_date,
          CASE l_returnflag WHEN 'A' THEN 'Valid' WHEN 'N' THEN 'Invalid' ELSE 'Inconclusive' END AS result
        FROM lineitem""",
    "sealed_manifests": """
        SELECT 'm' || o_orderkey AS manifest_id, o_orderkey AS job_id, o_orderkey % 5 = 0 AS is_sealed
        FROM orders WHERE o_orderstatus = 'F'""",
    "matters": """
        SELECT CAST(n_nationkey AS BIGINT) AS matter_id, n_name AS name,
          'CASE-' || lpad(CAST(n_nationkey AS VARCHAR), 3, '0') AS case_number, n_regionkey <> 2 AS is_active FROM nation""",
    "shard_requests": f"""
        SELECT o_custkey AS job_id,
          CASE WHEN o_custkey % 3 = 0 THEN ['c' || o_custkey || '@x.org', 'a' || o_custkey || '@x.org']
            ELSE ['c' || o_custkey || '@x.org'] END AS custodians,
          {_JOB_TYPE.format(k="o_custkey")} AS job_type, min(o_orderdate) AS start_date,
          max(o_orderdate) + to_hours(12) AS end_date
        FROM orders GROUP BY o_custkey""",
    "dated_items": """
        SELECT o_orderkey AS item_key, 'c' || o_custkey || '@x.org' AS custodian, o_orderdate AS item_date,
          CAST(floor(o_totalprice) AS BIGINT) AS size_bytes FROM orders""",
    "file_records": """
        SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN source WHEN doc_id % 13 <> 1 THEN source END AS drive,
          CASE WHEN doc_id % 19 <> 4 THEN 'd' || doc_id END AS id,
          CASE WHEN doc_id % 2 = 0 THEN 'https://x.org/' || doc_id END AS web_url,
          '/' || lang || '/Doc' || doc_id AS path,
          CASE WHEN doc_id % 3 = 0 THEN 'Doc' || doc_id || '.DOCX'
            WHEN doc_id % 11 <> 7 THEN 'Doc' || doc_id || CASE doc_id % 4 WHEN 0 THEN '.Txt' WHEN 1 THEN '.pdf' WHEN 2 THEN '.msg' ELSE '' END
          END AS file_name,
          CASE WHEN doc_id % 9 <> 0 THEN TIMESTAMP '2024-01-01' + to_minutes(doc_id) END AS modified,
          doc_id % 8 <> 0 AND doc_id % 16 <> 0 AS is_file, n_chars AS size, 'u' || (doc_id % 7) || '@x.org' AS custodian,
          lang AS matter, source AS dataset
        FROM documents""",
    "landed_content": """
        SELECT source AS drive, 'd' || doc_id AS id, sha256(text) AS content_sha256, strlen(text) AS content_length,
          '/store/' || doc_id AS storage_uri
        FROM documents WHERE doc_id % 14 <> 5""",
    "fetched": """
        SELECT r.*, row_number() OVER (PARTITION BY r.dataset ORDER BY r.doc_id) - 1 AS record_index,
          CASE WHEN r.drive IS NULL OR r.id IS NULL THEN 'Skipped' WHEN c.id IS NULL THEN 'Failed' ELSE 'Success' END AS outcome,
          CASE WHEN r.drive IS NOT NULL AND r.id IS NOT NULL THEN coalesce(c.content_length, 0) ELSE 0 END AS bytes_fetched,
          c.content_sha256
        FROM file_records r LEFT JOIN landed_content c ON r.drive = c.drive AND r.id = c.id WHERE r.is_file""",
    "fetched_counted": """
        SELECT *, coalesce(sum(CASE WHEN outcome = 'Failed' THEN 1 ELSE 0 END)
            OVER (PARTITION BY dataset ORDER BY record_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 2 AS counted
        FROM fetched""",
    "messages": """
        SELECT 'msg-' || conv_id || '-' || turn AS id, split_part(text, chr(10), 1) AS subject, text AS preview, role || '@x.org' AS sender,
          CASE role WHEN 'user' THEN 'assistant@x.org;log@x.org' ELSE 'user@x.org' END AS recipients,
          TIMESTAMP '2024-01-01' + to_hours(conv_id * 3 + turn) AS received, 'conv' || conv_id || '@x.org' AS custodian
        FROM conversations""",
    "metric_points": """
        SELECT CASE event_type WHEN 'click' THEN 'items_collected' WHEN 'view' THEN 'bytes_collected'
            WHEN 'error' THEN 'throttling_events' WHEN 'purchase' THEN 'job_duration_ms' ELSE 'backoff_delay_ms' END AS metric,
          round(value * 100) AS value, ts FROM events""",
    "lifecycle": f"""
        SELECT event_id, CASE event_type WHEN 'signup' THEN 'JobStarted' WHEN 'view' THEN 'ItemCollected'
            WHEN 'error' THEN 'BackoffTriggered' WHEN 'click' THEN 'AutoRoutedToGDC' ELSE 'JobCompleted' END AS event_type,
          ts, 'corr-' || (user_id % 97) AS correlation_id, user_id AS job_id, {_JOB_TYPE.format(k="user_id")} AS job_type,
          CASE WHEN user_id % 3 = 0 THEN 'GraphDataConnect' ELSE 'GraphApi' END AS route,
          CASE WHEN event_id % 4 = 0 THEN 'Failed' WHEN event_id % 4 = 1 THEN 'Succeeded' ELSE 'Completed' END AS status,
          CASE event_id % 3 WHEN 0 THEN 'High' WHEN 1 THEN 'Medium' ELSE 'Normal' END AS priority,
          CAST(round(value * 100) AS BIGINT) AS size_bytes, event_id % 1000 AS processing_duration_ms,
          CASE event_id % 5 WHEN 0 THEN 429 WHEN 1 THEN 503 WHEN 2 THEN 500 ELSE 404 END AS http_status_code,
          event_id % 5000 AS backoff_delay_ms, event_id % 100000 AS duration_ms, event_id % 50 AS collected_items,
          event_id % 7000 AS collected_size_bytes,
          CASE event_id % 4 WHEN 0 THEN 'Connection reset' WHEN 1 THEN 'request TIMEOUT' WHEN 2 THEN CASE WHEN event_id % 3 = 0 THEN 'Network unreachable' ELSE 'bad input' END END AS message
        FROM events""",
    "failures": """
        SELECT * REPLACE (CASE event_id % 9 WHEN 0 THEN 'AuthError' WHEN 1 THEN 'TimeoutError' WHEN 2 THEN 'RetrySucceeded'
          WHEN 3 THEN 'RetrySucceeded' WHEN 4 THEN 'RetryFailed' WHEN 5 THEN 'BackoffTriggered' ELSE event_type END AS event_type) FROM lifecycle""",
    "checkpoints": """
        SELECT event_id AS checkpoint_id, user_id AS shard_id, event_type AS checkpoint_type, ts AS created_date,
          user_id % 2 = 1 OR event_id % 40 <> 0 AS is_completed, event_id % 100 AS items_processed FROM events""",
    "checkpoint_pairs": """
        SELECT *, lag(is_completed) OVER w AS prev_completed, lag(checkpoint_id) OVER w AS prev_id
        FROM checkpoints WINDOW w AS (PARTITION BY shard_id, checkpoint_type ORDER BY created_date, checkpoint_id)""",
    "changes": """
        SELECT 'onedrive:u' || user_id || '@x.org' AS scope_id, 'i' || user_id || '-' || (event_id % 20) AS item_id,
          event_id AS version, CAST(round(value * 100) AS BIGINT) AS size_bytes, event_type = 'error' AS deleted,
          event_type = 'signup' AS is_folder, event_type <> 'signup' AS is_file,
          CASE WHEN user_id % 4 = 0 THEN 'Mail' ELSE 'OneDrive' END AS delta_type, ts FROM events""",
    "cursors": """
        SELECT CASE WHEN c_custkey % 3 = 0 THEN 'mail' ELSE 'onedrive' END || ':u' || (c_custkey % 700) || '@x.org' AS scope_id,
          CASE WHEN c_custkey % 3 = 0 THEN 'Mail' ELSE 'OneDrive' END AS delta_type, 'u' || (c_custkey % 700) || '@x.org' AS custodian,
          CASE WHEN c_custkey % 6 = 0 THEN '' ELSE 'tok' || c_custkey END AS delta_token,
          TIMESTAMP '2024-01-01' + to_hours(c_custkey % 1100) AS last_delta_time,
          CASE WHEN c_custkey % 2 = 0 THEN TIMESTAMP '2024-01-01' END AS baseline_completed_at,
          c_custkey % 10 AS last_delta_item_count, c_custkey % 1000 AS last_delta_size_bytes, c_custkey % 7 AS delta_query_count,
          c_custkey % 5 AS failure_count, c_custkey % 11 <> 0 AS is_active,
          TIMESTAMP '2024-02-01' + to_minutes(c_custkey) AS updated_date, c_custkey AS job_id
        FROM customer""",
    "latest_cursors": """
        SELECT * FROM cursors WHERE is_active
        QUALIFY row_number() OVER (PARTITION BY scope_id, delta_type ORDER BY updated_date DESC) = 1""",
    "delta_requests": """
        SELECT c_custkey AS request_id, 'U' || (c_custkey % 900) || '@X.org' AS custodian,
          CASE c_custkey % 5 WHEN 0 THEN 'Mail' WHEN 4 THEN 'Teams' ELSE 'OneDrive' END AS delta_type FROM customer""",
    "collection_requests": f"""
        SELECT c_custkey AS request_id, 'c' || c_custkey || '@x.org' AS custodian, {_JOB_TYPE.format(k="c_custkey")} AS job_type,
          CASE WHEN c_custkey % 7 <> 0 THEN TIMESTAMP '2024-01-01' END AS start_date,
          CASE WHEN c_custkey % 5 <> 0 THEN TIMESTAMP '2024-01-01' + to_hours(c_custkey % 2400) END AS end_date,
          (c_custkey % 120) * 1073741824 AS used_bytes, (c_custkey % 53) * 10000 AS used_items,
          CASE c_custkey % 6 WHEN 0 THEN 5 WHEN 1 THEN 10 WHEN 2 THEN 20 WHEN 3 THEN 2 WHEN 4 THEN 25 ELSE 1 END * CAST(1073741824 AS BIGINT) AS estimated_bytes,
          CASE c_custkey % 6 WHEN 0 THEN 10000 WHEN 1 THEN 5000 WHEN 2 THEN 15000 WHEN 3 THEN 20000 WHEN 4 THEN 30000 ELSE 1000 END AS estimated_items
        FROM customer""",
    "heartbeats": "SELECT 'w' || (user_id % 20) AS worker_id, ts FROM events",
}


def window_view(days: int, cap: int) -> str:
    """Shard windows of ``days`` with at most ``cap`` per custodian and one day as the least length."""
    return f"""
        SELECT r.job_id, c.custodian, r.job_type, CAST(p.pos AS BIGINT) AS shard_index,
          r.start_date + to_days(CAST({days} * p.pos AS INTEGER)) AS from_date,
          least(r.end_date, r.start_date + to_days(CAST({days} * (p.pos + 1) AS INTEGER))) AS to_date, r.end_date AS last_date
        FROM shard_requests r CROSS JOIN unnest(r.custodians) AS c(custodian) CROSS JOIN range({cap}) AS p(pos)
        WHERE r.start_date + to_days(CAST({days} * p.pos AS INTEGER)) < r.end_date
          AND least(r.end_date, r.start_date + to_days(CAST({days} * (p.pos + 1) AS INTEGER)))
            - (r.start_date + to_days(CAST({days} * p.pos AS INTEGER))) >= INTERVAL 1 DAY"""


VIEWS["windows"] = window_view(30, 12)
VIEWS["year_windows"] = window_view(365, 5)
VIEWS["short_windows"] = window_view(3, 200)
VIEWS["long_windows"] = window_view(3650, 5)

_NAMES = re.compile(r"\b(" + "|".join(VIEWS) + r")\b")


def with_views(body: str) -> str:
    """Prefix ``body`` with the views it uses, directly or through other views."""
    needed: dict[str, None] = {}

    def visit(sql: str) -> None:
        for name in dict.fromkeys(_NAMES.findall(sql)):
            if name not in needed and VIEWS[name] is not sql:  # not yet placed, and not itself
                visit(VIEWS[name])
                needed.setdefault(name)

    visit(body)
    ctes = ",\n".join(f"{name} AS ({VIEWS[name]})" for name in needed)
    if not ctes:
        return body
    # A body with views of its own joins the same WITH.
    return f"WITH {ctes},\n{body[4:]}" if body.startswith("WITH") else f"WITH {ctes}\n{body}"
