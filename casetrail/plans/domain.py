"""Evidence tables derived from the provided tables.

The provided data has no evidence tables; each view below is a projection of one of
them (or one equi-join), so its size grows with the input. The SQL twin of every view
is in ``reference_sql``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF_METRICS = "2024-01-30 12:00:00"
AS_OF_JOBS = "2000-01-01 00:00:00"
AS_OF_CURSORS = "2024-02-15 00:00:00"
CREATED = "2024-06-01 00:00:00"

JOB_TYPE = (
    "CASE {k} % 6 WHEN 0 THEN 'Email' WHEN 1 THEN 'OneDrive' WHEN 2 THEN 'SharePoint' "
    "WHEN 3 THEN 'Teams' WHEN 4 THEN 'Mixed' ELSE 'Other' END"
)


def instant(text: str):
    return F.lit(text).cast("timestamp")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def source_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr(
        "doc_id",
        "concat('job-', doc_id % 7) AS job_id",
        "concat('u', doc_id % 7, '@x.org') AS custodian",
        "source AS drive_id",
        "CASE WHEN doc_id % 10 <> 3 THEN concat('d', doc_id) END AS item_id",
        r"concat('\\', lang, '\\', CASE WHEN doc_id % 40 = 5 THEN 'Versions\\' ELSE '' END, 'Doc', doc_id, '.TXT') AS path",
        "n_chars AS size",
        "timestampadd(MINUTE, cast(doc_id AS INT), TIMESTAMP '2024-01-01 00:00:00') AS last_modified",
        "sha2(text, 256) AS sha256",
        "cast(NULL AS STRING) AS storage_uri",
        "cast(NULL AS TIMESTAMP) AS collected_utc",
        "CASE WHEN doc_id % 50 = 0 THEN 'Folder' ELSE 'File' END AS kind",
    )


def collected_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = source_manifest(spark, sf_dir)
    # One pass: each document yields its own row unless lost, and an extra row where due.
    copies = source.withColumn(
        "extra",
        F.explode(
            F.expr(
                "CASE WHEN doc_id % 17 <> 0 AND doc_id % 101 = 1 THEN array(false, true) "
                "WHEN doc_id % 17 <> 0 THEN array(false) WHEN doc_id % 101 = 1 THEN array(true) "
                "ELSE cast(array() AS array<boolean>) END"
            )
        ),
    )
    return copies.selectExpr(
        "job_id",
        "custodian",
        "drive_id",
        "CASE WHEN extra THEN concat('x', doc_id) ELSE item_id END AS item_id",
        r"upper(replace(path, '\\', '/')) AS path",
        "size",
        "last_modified",
        "CASE WHEN doc_id % 23 = 0 THEN concat('0', substr(upper(sha256), 2)) ELSE upper(sha256) END AS sha256",
        "concat('/store/', doc_id) AS storage_uri",
        "timestampadd(DAY, 1, last_modified) AS collected_utc",
        "kind",
    )


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return orders.join(customers, orders.o_custkey == customers.c_custkey).selectExpr(
        "o_orderkey AS job_id",
        "cast(c_nationkey AS BIGINT) AS matter_id",
        "concat('c', o_custkey, '@x.org') AS custodian",
        JOB_TYPE.format(k="o_orderkey") + " AS job_type",
        "CASE o_orderstatus WHEN 'F' THEN 'Completed' WHEN 'O' THEN 'Pending' ELSE 'Running' END AS status",
        "CASE WHEN o_orderkey % 3 = 0 THEN 'GraphDataConnect' ELSE 'GraphApi' END AS route",
        "cast(substr(o_orderpriority, 1, 1) AS INT) AS priority",
        "cast(o_orderdate AS TIMESTAMP) AS created_date",
        "timestampadd(HOUR, 1, cast(o_orderdate AS TIMESTAMP)) AS start_time",
        "timestampadd(MINUTE, cast(60 + o_orderkey % 600 AS INT), cast(o_orderdate AS TIMESTAMP)) AS end_time",
        "cast(floor(o_totalprice) AS BIGINT) AS estimated_bytes",
        "CASE WHEN o_orderstatus = 'F' THEN cast(floor(o_totalprice) AS BIGINT) ELSE 0L END AS actual_bytes",
        "o_orderkey % 1000 AS estimated_items",
        "CASE WHEN o_orderstatus = 'F' THEN o_orderkey % 1000 ELSE 0L END AS actual_items",
        "concat('w', o_orderkey % 13) AS assigned_worker_id",
        "CASE WHEN o_orderkey % 4 = 0 THEN timestampadd(MINUTE, 30, cast(o_orderdate AS TIMESTAMP)) END AS lock_expiry",
    )


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS job_id",
        "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS item_id",
        "CASE l_linestatus WHEN 'O' THEN 'Email' ELSE 'File' END AS item_type",
        "concat('Part ', l_partkey) AS subject",
        "concat('s', l_suppkey, '@x.org') AS sender",
        "cast(NULL AS STRING) AS recipients",
        "cast(l_shipdate AS TIMESTAMP) AS item_date",
        "cast(l_shipdate AS TIMESTAMP) AS collected_date",
        "cast(floor(l_extendedprice) AS BIGINT) AS size_bytes",
        "sha2(concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber, "
        "cast(cast(l_extendedprice AS DECIMAL(18,2)) AS STRING), l_returnflag, l_linestatus, "
        "date_format(l_shipdate, 'yyyy-MM-dd')), 256) AS sha256",
        "concat('/out/', l_orderkey, '/', l_linenumber) AS file_path",
        "l_returnflag <> 'R' AS is_successful",
        "CASE WHEN l_returnflag = 'R' THEN 'returned' END AS error_message",
    )


def verifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(
        "concat('m', l_orderkey) AS manifest_id",
        "cast(l_shipdate AS TIMESTAMP) AS verification_date",
        "'HashVerification' AS verification_type",
        "CASE l_returnflag WHEN 'A' THEN 'Valid' WHEN 'N' THEN 'Invalid' ELSE 'Inconclusive' END AS result",
    )


def sealed_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest rows of the completed jobs, without digests."""
    return table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").selectExpr(
        "concat('m', o_orderkey) AS manifest_id",
        "o_orderkey AS job_id",
        "cast(o_orderdate AS TIMESTAMP) AS created_date",
        "o_orderkey % 5 = 0 AS is_sealed",
    )


def matters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").selectExpr(
        "cast(n_nationkey AS BIGINT) AS matter_id",
        "n_name AS name",
        "concat('CASE-', lpad(n_nationkey, 3, '0')) AS case_number",
        "n_regionkey <> 2 AS is_active",
    )


def shard_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = (
        table(spark, sf_dir, "orders")
        .groupBy("o_custkey")
        .agg(
            F.min("o_orderdate").cast("timestamp").alias("start_date"),
            F.max("o_orderdate").cast("timestamp").alias("end_date"),
        )
    )
    return spans.selectExpr(
        "o_custkey AS job_id",
        "CASE WHEN o_custkey % 3 = 0 THEN array(concat('c', o_custkey, '@x.org'), concat('a', o_custkey, '@x.org')) "
        "ELSE array(concat('c', o_custkey, '@x.org')) END AS custodians",
        JOB_TYPE.format(k="o_custkey") + " AS job_type",
        "start_date",
        "timestampadd(HOUR, 12, end_date) AS end_date",
    )


def dated_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS item_key",
        "concat('c', o_custkey, '@x.org') AS custodian",
        "cast(o_orderdate AS TIMESTAMP) AS item_date",
        "cast(floor(o_totalprice) AS BIGINT) AS size_bytes",
    )


def file_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as nested file records; text is not carried."""
    return table(spark, sf_dir, "documents").selectExpr(
        "doc_id",
        "CASE WHEN doc_id % 4 = 0 THEN source END AS driveId",
        "CASE WHEN doc_id % 19 <> 4 THEN concat('d', doc_id) END AS id",
        "named_struct('driveId', CASE WHEN doc_id % 13 <> 1 THEN source END) AS parentReference",
        "CASE WHEN doc_id % 2 = 0 THEN concat('https://x.org/', doc_id) END AS webUrl",
        "concat('/', lang, '/Doc', doc_id) AS path",
        "CASE WHEN doc_id % 3 = 0 THEN concat('Doc', doc_id, '.DOCX') END AS fileName",
        "CASE WHEN doc_id % 11 <> 7 THEN concat('Doc', doc_id, CASE doc_id % 4 WHEN 0 THEN '.Txt' WHEN 1 THEN '.pdf' "
        "WHEN 2 THEN '.msg' ELSE '' END) END AS name",
        "CASE WHEN doc_id % 9 <> 0 THEN timestampadd(MINUTE, cast(doc_id AS INT), TIMESTAMP '2024-01-01 00:00:00') END "
        "AS lastModifiedDateTime",
        "n_chars AS size",
        "CASE WHEN doc_id % 8 <> 0 THEN named_struct('mimeType', 'text/plain') END AS file",
        "CASE WHEN doc_id % 16 = 0 THEN named_struct('childCount', 1) END AS folder",
        "concat('u', doc_id % 7, '@x.org') AS custodian",
        "lang AS matter",
        "source AS dataset",
    )


def landed_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content digests of the documents that were landed."""
    return table(spark, sf_dir, "documents").filter("doc_id % 14 <> 5").selectExpr(
        "source AS drive",
        "concat('d', doc_id) AS id",
        "sha2(text, 256) AS content_sha256",
        "cast(octet_length(text) AS BIGINT) AS content_length",
        "concat('/store/', doc_id) AS storage_uri",
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").selectExpr(
        "concat('msg-', conv_id, '-', turn) AS id",
        r"split(text, '\n')[0] AS subject",
        "text AS preview",
        "concat(role, '@x.org') AS sender",
        "CASE role WHEN 'user' THEN array(named_struct('address', 'assistant@x.org'), named_struct('address', 'log@x.org')) "
        "ELSE array(named_struct('address', 'user@x.org')) END AS recipients",
        "timestampadd(HOUR, cast(conv_id * 3 + turn AS INT), TIMESTAMP '2024-01-01 00:00:00') AS received",
        "concat('conv', conv_id, '@x.org') AS custodian",
    )


METRIC_OF_EVENT = (
    "CASE event_type WHEN 'click' THEN 'items_collected' WHEN 'view' THEN 'bytes_collected' "
    "WHEN 'error' THEN 'throttling_events' WHEN 'purchase' THEN 'job_duration_ms' ELSE 'backoff_delay_ms' END"
)


def metric_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Values are whole hundredths, so sums do not depend on the order of addition.
    return table(spark, sf_dir, "events").selectExpr(
        METRIC_OF_EVENT + " AS metric",
        "cast(round(value * 100) AS DOUBLE) AS value",
        "cast(ts AS TIMESTAMP) AS ts",
    )


def lifecycle_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "event_id",
        "CASE event_type WHEN 'signup' THEN 'JobStarted' WHEN 'view' THEN 'ItemCollected' "
        "WHEN 'error' THEN 'BackoffTriggered' WHEN 'click' THEN 'AutoRoutedToGDC' ELSE 'JobCompleted' END AS event_type",
        "cast(ts AS TIMESTAMP) AS ts",
        "concat('corr-', user_id % 97) AS correlation_id",
        "user_id AS job_id",
        JOB_TYPE.format(k="user_id") + " AS job_type",
        "CASE WHEN user_id % 3 = 0 THEN 'GraphDataConnect' ELSE 'GraphApi' END AS route",
        "CASE WHEN event_id % 4 = 0 THEN 'Failed' WHEN event_id % 4 = 1 THEN 'Succeeded' ELSE 'Completed' END AS status",
        "CASE event_id % 3 WHEN 0 THEN 'High' WHEN 1 THEN 'Medium' ELSE 'Normal' END AS priority",
        "cast(round(value * 100) AS BIGINT) AS size_bytes",
        "event_id % 1000 AS processing_duration_ms",
        "CASE event_id % 5 WHEN 0 THEN 429 WHEN 1 THEN 503 WHEN 2 THEN 500 ELSE 404 END AS http_status_code",
        "event_id % 5000 AS backoff_delay_ms",
        "event_id % 100000 AS duration_ms",
        "event_id % 50 AS collected_items",
        "event_id % 7000 AS collected_size_bytes",
        "CASE event_id % 4 WHEN 0 THEN 'Connection reset' WHEN 1 THEN 'request TIMEOUT' WHEN 2 THEN CASE WHEN event_id % 3 = 0 THEN 'Network unreachable' ELSE 'bad input' END END AS message",
    )


def failure_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lifecycle events of which a part are errors and retries instead."""
    return lifecycle_events(spark, sf_dir).withColumn(
        "event_type",
        F.expr(
            "CASE event_id % 9 WHEN 0 THEN 'AuthError' WHEN 1 THEN 'TimeoutError' WHEN 2 THEN 'RetrySucceeded' "
            "WHEN 3 THEN 'RetrySucceeded' WHEN 4 THEN 'RetryFailed' WHEN 5 THEN 'BackoffTriggered' ELSE event_type END"
        ),
    )


def checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "event_id AS checkpoint_id",
        "user_id AS shard_id",
        "event_type AS checkpoint_type",
        "concat('k', event_id) AS checkpoint_key",
        "CASE event_type WHEN 'view' THEN to_json(named_struct('FolderId', concat('f', event_id), 'DeltaToken', 'tok', "
        "'ItemsProcessedInFolder', event_id % 100)) "
        "WHEN 'click' THEN to_json(named_struct('DriveId', concat('d', event_id), 'ItemsProcessedInDrive', event_id % 100)) "
        "WHEN 'error' THEN to_json(named_struct('SiteId', 's', 'ListId', concat('l', event_id), 'ItemsProcessedInList', event_id % 100)) "
        "WHEN 'signup' THEN to_json(named_struct('TeamId', 't', 'ChannelId', concat('c', event_id), 'ItemsProcessedInChannel', event_id % 100)) "
        "ELSE to_json(named_struct('BatchType', 'b', 'BatchSize', cast(event_id % 100 AS INT))) END AS checkpoint_data",
        "cast(ts AS TIMESTAMP) AS created_date",
        # Mostly complete, so that both sound and unsound shards occur.
        "user_id % 2 = 1 OR event_id % 40 <> 0 AS is_completed",
        "event_id % 100 AS items_processed",
    )


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A change log over items of each user; ``version`` is the event number."""
    return table(spark, sf_dir, "events").selectExpr(
        "concat('onedrive:u', user_id, '@x.org') AS scope_id",
        "concat('i', user_id, '-', event_id % 20) AS item_id",
        "event_id AS version",
        "cast(round(value * 100) AS BIGINT) AS size_bytes",
        "event_type = 'error' AS deleted",
        "event_type = 'signup' AS is_folder",
        "event_type <> 'signup' AS is_file",
        "CASE WHEN user_id % 4 = 0 THEN 'Mail' ELSE 'OneDrive' END AS delta_type",
        "cast(ts AS TIMESTAMP) AS ts",
    )


CHANGE_SCHEMA = (
    "scope_id string, item_id string, version bigint, size_bytes bigint, deleted boolean, "
    "is_folder boolean, is_file boolean, delta_type string, ts timestamp"
)
# First day of the events.
EVENTS_FROM = "2024-01-01"
BASE_UNTIL = "2024-01-15 00:00:00"


def cursors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several cursor rows per scope, as an unguarded history would have them."""
    return table(spark, sf_dir, "customer").selectExpr(
        "concat(CASE WHEN c_custkey % 3 = 0 THEN 'mail' ELSE 'onedrive' END, ':u', c_custkey % 700, '@x.org') AS scope_id",
        "CASE WHEN c_custkey % 3 = 0 THEN 'Mail' ELSE 'OneDrive' END AS delta_type",
        "concat('u', c_custkey % 700, '@x.org') AS custodian",
        "CASE WHEN c_custkey % 6 = 0 THEN '' ELSE concat('tok', c_custkey) END AS delta_token",
        "timestampadd(HOUR, cast(c_custkey % 1100 AS INT), TIMESTAMP '2024-01-01 00:00:00') AS last_delta_time",
        "CASE WHEN c_custkey % 2 = 0 THEN TIMESTAMP '2024-01-01 00:00:00' END AS baseline_completed_at",
        "c_custkey % 10 AS last_delta_item_count",
        "c_custkey % 1000 AS last_delta_size_bytes",
        "c_custkey % 7 AS delta_query_count",
        "c_custkey % 5 AS failure_count",
        "c_custkey % 11 <> 0 AS is_active",
        "TIMESTAMP '2023-12-01 00:00:00' AS created_date",
        "timestampadd(MINUTE, cast(c_custkey AS INT), TIMESTAMP '2024-02-01 00:00:00') AS updated_date",
        "cast(NULL AS STRING) AS error_message",
        "c_custkey AS job_id",
    )


def delta_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS request_id",
        "concat('U', c_custkey % 900, '@X.org') AS custodian",
        "CASE c_custkey % 5 WHEN 0 THEN 'Mail' WHEN 4 THEN 'Teams' ELSE 'OneDrive' END AS delta_type",
    )


def collection_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS request_id",
        "concat('c', c_custkey, '@x.org') AS custodian",
        JOB_TYPE.format(k="c_custkey") + " AS job_type",
        "CASE WHEN c_custkey % 7 <> 0 THEN TIMESTAMP '2024-01-01 00:00:00' END AS start_date",
        "CASE WHEN c_custkey % 5 <> 0 THEN timestampadd(HOUR, cast(c_custkey % 2400 AS INT), "
        "TIMESTAMP '2024-01-01 00:00:00') END AS end_date",
        # Usage from empty to above the limits, hitting the exact limit at times.
        "(c_custkey % 120) * 1073741824L AS used_bytes",
        "(c_custkey % 53) * 10000L AS used_items",
    )


def heartbeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "concat('w', user_id % 20) AS worker_id", "cast(ts AS TIMESTAMP) AS ts"
    )
