"""Reconciliation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casetrail.functions import paths
from casetrail.operators import reconcile
from casetrail.operators.reconcile import ReconcileOptions
from casetrail.plans import domain
from casetrail.plans.catalog import query, stamp

OPTIONS = ReconcileOptions(require_hash_match=True)
AS_OF = "2024-06-01 00:00:00"


def _sides(spark, sf_dir):
    return domain.source_manifest(spark, sf_dir), domain.collected_manifest(spark, sf_dir)


def _scope(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({"scope_job_id": "job_id", "scope_custodian": "custodian"})


@query(
    "reconcile_summary",
    """SELECT job_id, custodian, source_count, collected_count, missed_count, extra_count, hash_mismatch_count,
         source_bytes, collected_bytes, size_delta_bytes, round(size_delta_pct, 6) AS size_delta_pct,
         round(extras_pct, 6) AS extras_pct
       FROM recon_gates""",
)
def reconcile_summary(spark, sf_dir):
    rows = _scope(reconcile.summarize(*_sides(spark, sf_dir), OPTIONS))
    return rows.select(
        "job_id", "custodian", "source_count", "collected_count", "missed_count", "extra_count",
        "hash_mismatch_count", "source_bytes", "collected_bytes", "size_delta_bytes",
        F.round("size_delta_pct", 6).alias("size_delta_pct"), F.round("extras_pct", 6).alias("extras_pct"),
    )


@query(
    "reconcile_gates",
    """SELECT job_id, custodian, missed_count = 0 AS cardinality_passed,
         CASE WHEN source_count = 0 THEN extra_count = 0 ELSE extras_pct <= 0.5 END AS extras_passed,
         CASE WHEN source_bytes = 0 THEN collected_bytes = 0 ELSE size_delta_pct <= 5.0 END AS size_passed,
         hash_mismatch_count = 0 AS hash_passed, FALSE AS overall_passed, 'CompletedWithWarnings' AS status
       FROM recon_gates WHERE missed_count > 0
       UNION ALL
       SELECT job_id, custodian, TRUE, CASE WHEN source_count = 0 THEN extra_count = 0 ELSE extras_pct <= 0.5 END,
         CASE WHEN source_bytes = 0 THEN collected_bytes = 0 ELSE size_delta_pct <= 5.0 END, hash_mismatch_count = 0,
         (CASE WHEN source_count = 0 THEN extra_count = 0 ELSE extras_pct <= 0.5 END)
           AND (CASE WHEN source_bytes = 0 THEN collected_bytes = 0 ELSE size_delta_pct <= 5.0 END) AND hash_mismatch_count = 0,
         CASE WHEN (CASE WHEN source_count = 0 THEN extra_count = 0 ELSE extras_pct <= 0.5 END)
           AND (CASE WHEN source_bytes = 0 THEN collected_bytes = 0 ELSE size_delta_pct <= 5.0 END) AND hash_mismatch_count = 0
           THEN 'Completed' ELSE 'CompletedWithWarnings' END
       FROM recon_gates WHERE missed_count = 0""",
)
def reconcile_gates(spark, sf_dir):
    options = ReconcileOptions(
        require_hash_match=True, size_tolerance_pct=5.0, extra_tolerance_pct=0.5, soft_fail=True
    )
    rows = _scope(reconcile.summarize(*_sides(spark, sf_dir), options))
    return rows.select(
        "job_id", "custodian", "cardinality_passed", "extras_passed", "size_passed", "hash_passed",
        "overall_passed", "status",
    )


def _findings(spark, sf_dir, kind):
    rows = reconcile.discrepancies(*_sides(spark, sf_dir), OPTIONS, domain.instant(AS_OF)).filter(F.col("type") == kind)
    return rows.select(
        F.col("scope_job_id").alias("job_id"), "key", "custodian", "drive_id", "item_id", "path", "size",
        stamp("last_modified").alias("last_modified"), "source_sha256", "collected_sha256", "reason",
    )


_MISSED_SQL = """SELECT s.job_id, s.key, s.custodian, s.drive_id, s.item_id, s.path, s.size,
  strftime(s.last_modified, '%Y-%m-%d %H:%M:%S.%f') AS last_modified, s.sha256 AS source_sha256,
  CAST(NULL AS VARCHAR) AS collected_sha256, 'Item present in source manifest but not found in collected manifest' AS reason
  FROM source_keyed s ANTI JOIN collected_keyed c ON s.job_id = c.job_id AND s.custodian = c.custodian AND s.key = c.key"""
_EXTRA_SQL = """SELECT s.job_id, s.key, s.custodian, s.drive_id, s.item_id, s.path, s.size,
  strftime(s.last_modified, '%Y-%m-%d %H:%M:%S.%f') AS last_modified, CAST(NULL AS VARCHAR) AS source_sha256,
  s.sha256 AS collected_sha256, 'Item found in collected manifest but not present in source manifest' AS reason
  FROM collected_keyed s ANTI JOIN source_keyed c ON s.job_id = c.job_id AND s.custodian = c.custodian AND s.key = c.key"""
_MISMATCH_SQL = """SELECT s.job_id, s.key, s.custodian, s.drive_id, s.item_id, s.path, s.size,
  strftime(s.last_modified, '%Y-%m-%d %H:%M:%S.%f') AS last_modified, s.sha256 AS source_sha256,
  c.sha256 AS collected_sha256, 'SHA-256 hash mismatch between source and collected item' AS reason
  FROM source_keyed s JOIN collected_keyed c ON s.job_id = c.job_id AND s.custodian = c.custodian AND s.key = c.key
  WHERE lower(s.sha256) <> lower(c.sha256)"""


@query("reconcile_missed", _MISSED_SQL)
def reconcile_missed(spark, sf_dir):
    return _findings(spark, sf_dir, "Missed")


@query("reconcile_extra", _EXTRA_SQL)
def reconcile_extra(spark, sf_dir):
    return _findings(spark, sf_dir, "Extra")


@query("reconcile_hash_mismatch", _MISMATCH_SQL)
def reconcile_hash_mismatch(spark, sf_dir):
    return _findings(spark, sf_dir, "HashMismatch")


@query(
    "reconcile_report",
    f"""SELECT job_id, 'Missed' AS section, key, path, CAST(size AS VARCHAR) AS size, reason FROM ({_MISSED_SQL})
       UNION ALL SELECT job_id, 'Extras', key, path, CAST(size AS VARCHAR), reason FROM ({_EXTRA_SQL})
       UNION ALL SELECT job_id, 'HashMismatches', key, path, CAST(size AS VARCHAR), reason FROM ({_MISMATCH_SQL})
       UNION ALL SELECT job_id, 'Summary', 'SUMMARY', '', '',
         'SourceCount:' || source_count || ' CollectedCount:' || collected_count || ' MissedCount:' || missed_count ||
         ' ExtraCount:' || extra_count || ' HashMismatchCount:' || hash_mismatch_count || ' SourceBytes:' || source_bytes ||
         ' CollectedBytes:' || collected_bytes || ' SizeDeltaBytes:' || size_delta_bytes ||
         ' SizeDeltaPct:' || printf('%.2f', size_delta_pct) || '% ExtrasPct:' || printf('%.2f', extras_pct) ||
         '% CardinalityPassed:' || CASE WHEN missed_count = 0 THEN 'True' ELSE 'False' END ||
         ' ExtrasPassed:' || CASE WHEN extras_pct <= 0.05 THEN 'True' ELSE 'False' END ||
         ' SizePassed:' || CASE WHEN size_delta_pct <= 0.1 THEN 'True' ELSE 'False' END ||
         ' HashPassed:' || CASE WHEN hash_mismatch_count = 0 THEN 'True' ELSE 'False' END ||
         ' OverallPassed:' || CASE WHEN missed_count = 0 AND extras_pct <= 0.05 AND size_delta_pct <= 0.1
            AND hash_mismatch_count = 0 THEN 'True' ELSE 'False' END ||
         ' SizeTolerancePct:0.1% ExtraTolerancePct:0.05% RequireHashMatch:True'
       FROM recon_gates""",
)
def reconcile_report(spark, sf_dir):
    rows = reconcile.report(*_sides(spark, sf_dir), OPTIONS, domain.instant(AS_OF))
    return rows.select(
        F.col("scope_job_id").alias("job_id"), F.col("Section").alias("section"), F.col("Key").alias("key"),
        F.col("Path").alias("path"), F.col("Size").alias("size"), F.col("Reason").alias("reason"),
    )


@query(
    "reconcile_duplicates",
    """SELECT lower(custodian) AS custodian, sha256 AS key, count(*) AS row_count FROM source_scoped
       GROUP BY 1, 2 HAVING count(*) > 1""",
)
def reconcile_duplicates(spark, sf_dir):
    # The content digest as item id makes exact copies collide.
    rows = domain.source_manifest(spark, sf_dir).withColumn("item_id", F.col("sha256"))
    found = reconcile.duplicate_keys(rows, ReconcileOptions(scope=("custodian",)))
    return found.withColumnRenamed("scope_custodian", "custodian")


@query(
    "reconcile_first_of_duplicates",
    """WITH s AS (SELECT custodian, sha256 AS key, min(size) AS size FROM source_scoped GROUP BY 1, 2),
         c AS (SELECT custodian, lower(sha256) AS key, min(size) AS size FROM collected_scoped GROUP BY 1, 2)
       SELECT coalesce(s.custodian, c.custodian) AS custodian, count(s.key) AS source_count, count(c.key) AS collected_count,
         count(*) FILTER (WHERE c.key IS NULL) AS missed_count, count(*) FILTER (WHERE s.key IS NULL) AS extra_count,
         CAST(coalesce(sum(s.size), 0) AS BIGINT) AS source_bytes, CAST(coalesce(sum(c.size), 0) AS BIGINT) AS collected_bytes
       FROM s FULL OUTER JOIN c ON s.custodian = c.custodian AND s.key = c.key GROUP BY 1""",
)
def reconcile_first_of_duplicates(spark, sf_dir):
    source, collected = _sides(spark, sf_dir)
    options = ReconcileOptions(scope=("custodian",), on_duplicate="first")
    keyed = [df.withColumn("item_id", F.lower("sha256")) for df in (source, collected)]
    return reconcile.summarize(*keyed, options).select(
        F.col("scope_custodian").alias("custodian"), "source_count", "collected_count", "missed_count",
        "extra_count", "source_bytes", "collected_bytes",
    )


@query(
    "manifest_scope_filter",
    """SELECT doc_id, custodian, path, kind, size FROM source_scoped WHERE lower(custodian) = 'u3@x.org'""",
)
def manifest_scope_filter(spark, sf_dir):
    rows = reconcile.scope_filter(domain.source_manifest(spark, sf_dir), OPTIONS, custodian="U3@X.ORG")
    return rows.select("doc_id", "custodian", "path", "kind", "size")


@query(
    "manifest_keys",
    """SELECT doc_id, lower(trim(replace(path, '\\', '/'), '/')) AS normal_path,
         CASE WHEN coalesce(item_id, '') <> '' THEN item_id ELSE
           coalesce(drive_id, '') || '|' || path || '|' || size || '|' || strftime(last_modified, '%Y-%m-%dT%H:%M:%SZ') END AS key,
         lower(kind) = 'folder' AS folder
       FROM source_manifest""",
)
def manifest_keys(spark, sf_dir):
    return domain.source_manifest(spark, sf_dir).select(
        "doc_id",
        paths.normalize_path(F.col("path")).alias("normal_path"),
        reconcile.manifest_key().alias("key"),
        paths.is_folder(F.col("kind"), F.col("path")).alias("folder"),
    )


@query(
    "reconcile_gates_mixed",
    """WITH d AS (SELECT doc_id, doc_id % 8 AS j, CASE WHEN doc_id % 8 = 4 THEN 0 ELSE n_chars END AS size FROM documents),
         s AS (SELECT * FROM d WHERE j <> 6),
         c AS (SELECT doc_id, j, CASE WHEN j = 3 THEN size * 2 ELSE size END AS size FROM d WHERE j <> 5 AND NOT (j = 1 AND doc_id % 3 = 0)),
         n AS (SELECT coalesce(s.j, c.j) AS j, count(s.doc_id) AS source_count, count(*) FILTER (WHERE c.doc_id IS NULL) AS missed,
             count(*) FILTER (WHERE s.doc_id IS NULL) AS extra, count(*) FILTER (WHERE s.j = 2 AND s.doc_id % 5 = 0 AND c.doc_id IS NOT NULL) AS bad,
             coalesce(sum(s.size), 0) AS sb, coalesce(sum(c.size), 0) AS cb FROM s FULL JOIN c ON s.doc_id = c.doc_id GROUP BY 1),
         g AS (SELECT *, missed = 0 AS p1, CASE WHEN source_count = 0 THEN extra = 0 ELSE extra * 100.0 / source_count <= 0.05 END AS p2,
             CASE WHEN sb = 0 THEN cb = 0 ELSE abs(cb - sb) * 100.0 / sb <= 0.1 END AS p3, bad = 0 AS p4 FROM n)
       SELECT 'job-' || j AS job_id, 'u' || j || '@x.org' AS custodian, source_count, missed AS missed_count, extra AS extra_count,
         p1 AS cardinality_passed, p2 AS extras_passed, p3 AS size_passed, p4 AS hash_passed, p1 AND p2 AND p3 AND p4 AS overall_passed,
         CASE WHEN p1 AND p2 AND p3 AND p4 THEN 'Completed' ELSE 'Failed' END AS status FROM g""",
)
def reconcile_gates_mixed(spark, sf_dir):
    """Jobs that pass, fail one gate each, have no source or no bytes; half the collected rows name no custodian."""
    rows = domain.table(spark, sf_dir, "documents").selectExpr(
        "doc_id", "doc_id % 8 AS j", "CASE WHEN doc_id % 8 = 4 THEN 0 ELSE n_chars END AS size", "sha2(text, 256) AS hash"
    )
    shared = ["concat('job-', j) AS job_id", "concat('i', doc_id) AS item_id", "'drive' AS drive_id", "concat('/f/', doc_id) AS path",
              "'File' AS kind", "cast(NULL AS TIMESTAMP) AS last_modified"]
    source = rows.filter("j <> 6").selectExpr(*shared, "concat('u', j, '@x.org') AS custodian", "size", "hash AS sha256")
    collected = rows.filter("j <> 5 AND NOT (j = 1 AND doc_id % 3 = 0)").selectExpr(
        *shared,
        "CASE WHEN doc_id % 16 < 8 THEN concat('U', j, '@x.org') WHEN doc_id % 3 = 0 THEN '' END AS custodian",
        "CASE WHEN j = 3 THEN size * 2 ELSE size END AS size",
        "CASE WHEN j = 2 AND doc_id % 5 = 0 THEN 'other' ELSE upper(hash) END AS sha256",
    )
    jobs = spark.range(8).selectExpr("concat('job-', id) AS job_id", "concat('u', id, '@x.org') AS custodian")
    filled = reconcile.fill_custodian(collected, jobs)
    found = _scope(reconcile.summarize(source, filled, ReconcileOptions(require_hash_match=True)))
    return found.select(
        "job_id", "custodian", "source_count", "missed_count", "extra_count", "cardinality_passed", "extras_passed", "size_passed",
        "hash_passed", "overall_passed", "status",
    )


@query(
    "reconcile_expected_skips",
    """SELECT job_id, custodian, 'Missed' AS section, missed_count AS row_count FROM recon_counts WHERE missed_count > 0
       UNION ALL SELECT job_id, custodian, 'Extras', extra_count FROM recon_counts WHERE extra_count > 0
       UNION ALL SELECT job_id, custodian, 'HashMismatches', hash_mismatch_count FROM recon_counts WHERE hash_mismatch_count > 0
       UNION ALL SELECT job_id, custodian, 'ExpectedSkips', extra_count FROM recon_counts WHERE extra_count > 0
       UNION ALL SELECT job_id, custodian, 'Summary', 1 FROM recon_counts""",
)
def reconcile_expected_skips(spark, sf_dir):
    """A report whose fourth section lists what was meant to be left out."""
    as_of = domain.instant(AS_OF)
    skips = reconcile.discrepancies(*_sides(spark, sf_dir), OPTIONS, as_of).filter("type = 'Extra'")
    rows = reconcile.report(*_sides(spark, sf_dir), OPTIONS, as_of, skips)
    counted = rows.groupBy("scope_job_id", "scope_custodian", F.col("Section").alias("section")).agg(F.count(F.lit(1)).alias("row_count"))
    return _scope(counted)
