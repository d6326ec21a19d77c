"""Custody, matter and backlog queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from casetrail.operators import custody, matters
from casetrail.plans import domain
from casetrail.plans.catalog import query, stamp


# Small enough that groups of the provided data are split as huge ones would be.
HOT = 1000


@query("collection_sequence", "SELECT job_id, item_id, sha256, sequence FROM sequenced")
def collection_sequence(spark, sf_dir):
    return custody.collection_sequence(domain.items(spark, sf_dir)).select("job_id", "item_id", "sha256", "sequence")


# Two groups only: every task numbers a part of the same group.
@query(
    "matter_sequence",
    """SELECT job_id AS order_key, item_id, CAST(row_number() OVER (PARTITION BY job_id % 2 ORDER BY collected_date, md5(item_id), item_id, sha256) AS BIGINT) AS sequence
       FROM items""",
)
def matter_sequence(spark, sf_dir):
    rows = domain.items(spark, sf_dir).withColumn("order_key", F.col("job_id")).withColumn("job_id", F.col("job_id") % 2)
    return custody.collection_sequence(rows, HOT).select("order_key", "item_id", "sequence")


@query("manifest_totals", "SELECT * FROM totals")
def manifest_totals(spark, sf_dir):
    return custody.manifest_totals(domain.items(spark, sf_dir))


@query("items_hash", "SELECT job_id, items_hash, items_hash_rows FROM items_digest")
def items_hash(spark, sf_dir):
    digests = custody.items_hash(custody.collection_sequence(domain.items(spark, sf_dir)))
    return digests.select("job_id", "items_hash", "items_hash_rows")


@query(
    "items_hash_tree",
    """WITH chunks AS (SELECT matter, (seq - 1) // 1000 AS chunk, sha256(string_agg(sha256, '' ORDER BY seq)) AS d, count(*) AS n
         FROM (SELECT job_id % 4 AS matter, sha256, row_number() OVER (PARTITION BY job_id % 4
           ORDER BY collected_date, md5(item_id), item_id, sha256) AS seq FROM items) GROUP BY 1, 2)
       SELECT matter, sha256(string_agg(d, '' ORDER BY chunk)) AS items_hash,
         'sha256-chunks-1000' AS items_hash_scheme, CAST(sum(n) AS BIGINT) AS items_hash_rows
       FROM chunks GROUP BY 1""",
)
def items_hash_tree(spark, sf_dir):
    rows = domain.items(spark, sf_dir).withColumn("job_id", F.col("job_id") % 4)
    digests = custody.items_hash(custody.collection_sequence(rows, HOT), chunk_rows=1000)
    return digests.withColumnRenamed("job_id", "matter")


@query(
    "collection_hash",
    """SELECT job_id, sha256(string_agg(d, '' ORDER BY chunk)) AS collection_hash FROM (SELECT job_id, (sequence - 1) // 250000 AS chunk,
           sha256('[' || string_agg('{"ItemId":"' || item_id || '","Sha256Hash":"' || sha256 || '"}', ',' ORDER BY sequence) || ']') AS d
         FROM sequenced GROUP BY 1, 2) GROUP BY 1""",
)
def collection_hash(spark, sf_dir):
    rows = custody.collection_sequence(domain.items(spark, sf_dir))
    return custody.collection_hash(rows).select("job_id", "collection_hash")


def _manifests(spark, sf_dir):
    return custody.job_manifests(
        domain.jobs(spark, sf_dir), domain.items(spark, sf_dir), domain.instant(domain.CREATED)
    )


@query(
    "manifest_hash",
    """SELECT manifest_id, job_id, total_items, successful_items, failed_items, total_size_bytes, items_hash, manifest_hash
       FROM hashed_manifests""",
)
def manifest_hash(spark, sf_dir):
    return _manifests(spark, sf_dir).select(
        "manifest_id", "job_id", "total_items", "successful_items", "failed_items", "total_size_bytes",
        "items_hash", "manifest_hash",
    )


def _tampered(manifests):
    """Stored digests: some missing, some altered, some of a job that no longer exists."""
    job = F.col("job_id")
    return manifests.select(
        "manifest_id",
        F.when(job % 21 == 0, -job - 1).otherwise(job).alias("job_id"),
        F.when(job % 15 == 0, F.lit(None).cast("string"))
        .when(job % 10 == 0, F.concat(F.lit("x"), F.substring("items_hash", 2, 63)))
        .otherwise(F.col("items_hash"))
        .alias("items_hash"),
        F.when(job % 14 == 0, F.concat(F.lit("x"), F.substring("manifest_hash", 2, 63)))
        .otherwise(F.upper("manifest_hash"))
        .alias("manifest_hash"),
    )


def _verified(spark, sf_dir):
    built = _manifests(spark, sf_dir)
    return custody.verify_manifests(_tampered(built), built)


@query("verify_manifest", "SELECT manifest_id, job_id, result FROM verified")
def verify_manifest(spark, sf_dir):
    return _verified(spark, sf_dir).select("manifest_id", "job_id", "result")


@query(
    "custody_validation",
    """WITH checked AS (SELECT job_id, item_id, CASE WHEN l_bad THEN 'zz' ELSE sha256 END AS sha256
           FROM (SELECT *, size_bytes % 50 = 0 AS l_bad FROM items)),
         logged AS (SELECT DISTINCT item_id FROM items WHERE size_bytes % 33 <> 0),
         bad AS (SELECT job_id, count(*) AS n FROM checked WHERE NOT regexp_full_match(sha256, '[0-9a-f]{64}') GROUP BY 1),
         unlogged AS (SELECT c.job_id, count(*) AS n FROM checked c ANTI JOIN logged l ON c.item_id = l.item_id GROUP BY 1),
         broken AS (SELECT job_id, count(*) AS n FROM verified WHERE result <> 'Valid' GROUP BY 1)
       SELECT j.job_id, coalesce(bad.n, 0) AS malformed_hashes, coalesce(unlogged.n, 0) AS unlogged_items,
         coalesce(broken.n, 0) AS invalid_manifests,
         coalesce(bad.n, 0) + coalesce(unlogged.n, 0) + coalesce(broken.n, 0) = 0 AS is_valid
       FROM jobs j LEFT JOIN bad ON j.job_id = bad.job_id LEFT JOIN unlogged ON j.job_id = unlogged.job_id
         LEFT JOIN broken ON j.job_id = broken.job_id""",
)
def custody_validation(spark, sf_dir):
    rows = domain.items(spark, sf_dir)
    damaged = rows.withColumn("sha256", F.when(F.col("size_bytes") % 50 == 0, "zz").otherwise(F.col("sha256")))
    events = rows.filter("size_bytes % 33 <> 0").select("item_id")
    return custody.custody_validation(domain.jobs(spark, sf_dir), damaged, _verified(spark, sf_dir), events)


@query(
    "content_rehash",
    """SELECT m.storage_uri, CASE WHEN c.id IS NULL THEN 'Missing' WHEN c.content_sha256 = lower(m.sha256) THEN 'Match' ELSE 'Mismatch' END AS outcome
       FROM (SELECT '/store/' || doc_id AS storage_uri, sha256 FROM collected_manifest) m
       LEFT JOIN landed_content c ON m.storage_uri = c.storage_uri""",
)
def content_rehash(spark, sf_dir):
    return custody.rehash_check(
        domain.collected_manifest(spark, sf_dir), domain.landed_content(spark, sf_dir), "storage_uri"
    )


@query(
    "verification_due",
    """SELECT m.manifest_id, m.job_id, strftime(v.d, '%Y-%m-%d %H:%M:%S.%f') AS last_verified
       FROM sealed_manifests m LEFT JOIN (SELECT manifest_id, max(verification_date) FILTER (WHERE result = 'Valid') AS d
         FROM verifications GROUP BY 1) v ON m.manifest_id = v.manifest_id
       WHERE v.d IS NULL OR v.d < TIMESTAMP '2000-01-01' - INTERVAL 24 HOUR""",
)
def verification_due(spark, sf_dir):
    rows = custody.verification_due(
        domain.sealed_manifests(spark, sf_dir), domain.verifications(spark, sf_dir), domain.instant(domain.AS_OF_JOBS)
    )
    return rows.select("manifest_id", "job_id", stamp("last_verified").alias("last_verified"))


_JOB_CUSTODY_SQL = """
  SELECT j.matter_id, j.job_id, j.custodian, j.status, j.actual_items AS total_items, j.actual_bytes AS total_size_bytes,
    m.n IS NOT NULL AS has_manifest, coalesce(m.n, 0) AS manifest_count, coalesce(m.sealed, FALSE) AS manifest_sealed,
    strftime(m.last, '%Y-%m-%d %H:%M:%S.%f') AS last_verified
  FROM jobs j LEFT JOIN (
    SELECT s.job_id, count(*) AS n, bool_or(s.is_sealed) AS sealed, max(v.d) AS last
    FROM sealed_manifests s LEFT JOIN (SELECT manifest_id, max(verification_date) AS d FROM verifications
      WHERE result = 'Valid' GROUP BY 1) v ON s.manifest_id = v.manifest_id GROUP BY 1) m ON j.job_id = m.job_id"""


def _job_custody(spark, sf_dir):
    return matters.job_custody(
        domain.jobs(spark, sf_dir), domain.sealed_manifests(spark, sf_dir), domain.verifications(spark, sf_dir)
    )


@query("job_custody", _JOB_CUSTODY_SQL)
def job_custody(spark, sf_dir):
    return _job_custody(spark, sf_dir).withColumn("last_verified", stamp("last_verified"))


@query(
    "matter_custody_summary",
    f"""SELECT matter_id, count(*) AS total_jobs, count(*) FILTER (WHERE has_manifest) AS jobs_with_manifests,
         count(*) FILTER (WHERE manifest_sealed) AS sealed_manifests, CAST(sum(total_items) AS BIGINT) AS total_items,
         CAST(sum(total_size_bytes) AS BIGINT) AS total_size_bytes FROM ({_JOB_CUSTODY_SQL}) GROUP BY 1""",
)
def matter_custody_summary(spark, sf_dir):
    return matters.matter_summary(_job_custody(spark, sf_dir))


@query("active_matters", "SELECT matter_id, name, case_number FROM matters WHERE is_active")
def active_matters(spark, sf_dir):
    return matters.active_matters(domain.matters(spark, sf_dir)).select("matter_id", "name", "case_number")


@query(
    "matter_job_items",
    """SELECT m.matter_id, m.name, j.job_id, i.item_id, i.size_bytes
       FROM matters m LEFT JOIN (jobs j LEFT JOIN items i ON j.job_id = i.job_id) ON m.matter_id = j.matter_id""",
)
def matter_job_items(spark, sf_dir):
    jobs = domain.jobs(spark, sf_dir).select("matter_id", "job_id")
    items = domain.items(spark, sf_dir).select("job_id", "item_id", "size_bytes")
    with_items = matters.with_children(jobs, items, "job_id")
    return matters.with_children(domain.matters(spark, sf_dir).select("matter_id", "name"), with_items, "matter_id", direct=jobs)


@query(
    "job_logs_newest_first",
    """SELECT j.job_id, j.status, l.event_id, l.event_type FROM jobs j LEFT JOIN lifecycle l ON j.job_id = l.job_id""",
)
def job_logs_newest_first(spark, sf_dir):
    logged = domain.lifecycle_events(spark, sf_dir).select("job_id", "event_id", "event_type", "ts")
    jobs = domain.jobs(spark, sf_dir).select("job_id", "status")
    return matters.children_newest_first(jobs, logged, "job_id", "ts", "event_id").drop("ts")


@query(
    "manifest_verifications_newest_first",
    """SELECT m.manifest_id, m.is_sealed, v.result, strftime(v.verification_date, '%Y-%m-%d') AS verified_on
       FROM sealed_manifests m LEFT JOIN verifications v ON m.manifest_id = v.manifest_id""",
)
def manifest_verifications_newest_first(spark, sf_dir):
    manifests = domain.sealed_manifests(spark, sf_dir).select("manifest_id", "is_sealed")
    checks = domain.verifications(spark, sf_dir).select("manifest_id", "result", "verification_date")
    rows = matters.children_newest_first(manifests, checks, "manifest_id", "verification_date", "result")
    return rows.select("manifest_id", "is_sealed", "result", F.date_format("verification_date", "yyyy-MM-dd").alias("verified_on"))


@query(
    "shard_checkpoints",
    """SELECT s.shard_id, c.checkpoint_id, c.checkpoint_type FROM (SELECT DISTINCT user_id + 1 AS shard_id FROM events) s
       LEFT JOIN checkpoints c ON s.shard_id = c.shard_id""",
)
def shard_checkpoints(spark, sf_dir):
    shards = domain.table(spark, sf_dir, "events").select((F.col("user_id") + 1).alias("shard_id")).distinct()
    stored = domain.checkpoints(spark, sf_dir).select("shard_id", "checkpoint_id", "checkpoint_type")
    return matters.with_children(shards, stored, "shard_id")


@query(
    "job_item_counts",
    """SELECT j.job_id, coalesce(n, 0) AS item_count FROM jobs j
       LEFT JOIN (SELECT job_id, count(*) AS n FROM items GROUP BY 1) c ON j.job_id = c.job_id""",
)
def job_item_counts(spark, sf_dir):
    jobs = domain.jobs(spark, sf_dir).select("job_id")
    return matters.child_counts(jobs, domain.items(spark, sf_dir), "job_id", "item_count")


@query(
    "jobs_newest_first",
    "SELECT job_id, strftime(created_date, '%Y-%m-%d %H:%M:%S.%f') AS created_date, status FROM jobs ORDER BY created_date DESC, job_id",
)
def jobs_newest_first(spark, sf_dir):
    rows = matters.newest_first(domain.jobs(spark, sf_dir), "created_date", "job_id")
    return rows.select("job_id", stamp("created_date").alias("created_date"), "status")


@query(
    "first_five_items",
    """SELECT job_id, item_id, position FROM (SELECT job_id, item_id, CAST(row_number() OVER
         (PARTITION BY job_id ORDER BY collected_date, md5(item_id), item_id, sha256) AS INTEGER) AS position FROM items) WHERE position <= 5""",
)
def first_five_items(spark, sf_dir):
    return matters.first_items(domain.items(spark, sf_dir)).select("job_id", "item_id", "position")


@query(
    "avg_duration_by_type",
    """SELECT job_type, round(avg(epoch_us(end_time - start_time) / 1000.0), 3) AS avg_duration_ms
       FROM jobs WHERE status = 'Completed' GROUP BY 1"""
    .replace("epoch_us(end_time - start_time)", "(epoch_us(end_time) - epoch_us(start_time))"),
)
def avg_duration_by_type(spark, sf_dir):
    rows = matters.average_duration_by_type(domain.jobs(spark, sf_dir))
    return rows.select("job_type", F.round("avg_duration_ms", 3).alias("avg_duration_ms"))


_AVAILABLE = "status = 'Pending' AND (lock_expiry IS NULL OR lock_expiry < TIMESTAMP '2000-01-01')"


@query("available_jobs", f"SELECT job_id, priority FROM jobs WHERE {_AVAILABLE}")
def available_jobs(spark, sf_dir):
    rows = matters.available_work(domain.jobs(spark, sf_dir), domain.instant(domain.AS_OF_JOBS))
    return rows.select("job_id", "priority")


@query(
    "backlog_top_k",
    f"""SELECT job_id, priority, strftime(created_date, '%Y-%m-%d %H:%M:%S.%f') AS created_date FROM jobs WHERE {_AVAILABLE}
        ORDER BY priority, jobs.created_date, job_id LIMIT 20""",
)
def backlog_top_k(spark, sf_dir):
    rows = matters.job_backlog(domain.jobs(spark, sf_dir), domain.instant(domain.AS_OF_JOBS), 20)
    return rows.select("job_id", "priority", stamp("created_date").alias("created_date"))


def _worked_shards(jobs):
    return jobs.select(
        F.concat_ws("-", "custodian", "job_id").alias("shard_key"),
        F.when(F.col("job_id") % 2 == 0, "Assigned").otherwise("Running").alias("status"),
        "lock_expiry",
    )


def _assignments(jobs):
    return jobs.select(
        F.col("job_id").alias("assignment_id"),
        F.when(F.col("job_id") % 8 == 0, "Processing").otherwise("Completed").alias("status"),
        "lock_expiry",
    )


@query(
    "expired_leases",
    """SELECT 'job' AS kind, CAST(job_id AS VARCHAR) AS row_key, status, 'Pending' AS corrected_status FROM jobs
         WHERE lock_expiry < TIMESTAMP '2000-01-01'
       UNION ALL SELECT 'shard', custodian || '-' || job_id, 'Assigned', 'Pending' FROM jobs
         WHERE lock_expiry < TIMESTAMP '2000-01-01' AND job_id % 2 = 0
       UNION ALL SELECT 'assignment', CAST(job_id AS VARCHAR), 'Processing', 'Expired' FROM jobs
         WHERE lock_expiry < TIMESTAMP '2000-01-01' AND job_id % 8 = 0""",
)
def expired_leases(spark, sf_dir):
    jobs = domain.jobs(spark, sf_dir)
    rows = matters.expired_leases(jobs, _worked_shards(jobs), _assignments(jobs), domain.instant(domain.AS_OF_JOBS))
    return rows.select("kind", "row_key", "status", "corrected_status")
