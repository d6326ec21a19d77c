"""Sources and sinks, exercised on whole derived tables.

Each query writes a table derived from the provided ones below the workspace, then
reads it back with the operator under test.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casetrail import schemas
from casetrail.operators import audit, custody, delta, reconcile, shards
from casetrail.operators.reconcile import ReconcileOptions
from casetrail.operators.ordering import held
from casetrail.plans import domain
from casetrail.plans.catalog import query, stamp
from casetrail.sinks import files
from casetrail.sinks.cursors import CursorStore
from casetrail.sources import datasets, landing, logs, manifests
from casetrail.workspace import list_names, new_folder, remove_folder, rename_file

_MANIFEST_SQL = """SELECT custodian, kind, drive_id, coalesce(item_id, '') AS item_id, path, size, sha256 FROM collected_manifest"""


@query("manifest_csv_roundtrip", _MANIFEST_SQL)
def manifest_csv_roundtrip(spark, sf_dir):
    path = files.write_manifest_csv(domain.collected_manifest(spark, sf_dir), new_folder(spark, "manifest-csv"))
    rows, _ = manifests.read_manifest(spark, path, "csv")
    return rows.select(
        "custodian", "kind", "drive_id", F.coalesce("item_id", F.lit("")).alias("item_id"), "path", "size", "sha256"
    )


@query("manifest_json_roundtrip", _MANIFEST_SQL)
def manifest_json_roundtrip(spark, sf_dir):
    entries = domain.collected_manifest(spark, sf_dir).withColumn("mime_type", F.lit("text/plain"))
    path = files.write_manifest_json(entries, new_folder(spark, "manifest-json"))
    rows, _ = manifests.read_manifest(spark, path, "json")
    return rows.select(
        "custodian", "kind", "drive_id", F.coalesce("item_id", F.lit("")).alias("item_id"), "path", "size", "sha256"
    )


@query(
    "manifest_csv_aliases",
    """SELECT 'row' AS outcome, 'd' || doc_id AS item_id, 'P' || doc_id AS path,
         CASE WHEN doc_id % 9 = 0 THEN 0 ELSE n_chars END AS size,
         CASE WHEN doc_id % 4 = 0 THEN NULL ELSE strftime(TIMESTAMP '2024-01-01' + to_minutes(doc_id), '%Y-%m-%d %H:%M:%S.%f') END AS last_modified,
         CAST(NULL AS VARCHAR) AS reason
       FROM documents WHERE doc_id % 6 <> 0
       UNION ALL SELECT 'reject', NULL, NULL, NULL, NULL, 'no path' FROM documents WHERE doc_id % 6 = 0""",
)
def manifest_csv_aliases(spark, sf_dir):
    raw = domain.table(spark, sf_dir, "documents").selectExpr(
        "concat('d', doc_id) AS id",
        "CASE WHEN doc_id % 6 <> 0 THEN concat('P', doc_id) ELSE '' END AS File_Path",
        "CASE WHEN doc_id % 9 = 0 THEN 'n/a' ELSE cast(n_chars AS STRING) END AS FileSize",
        "CASE WHEN doc_id % 4 = 0 THEN 'unknown' ELSE date_format(timestampadd(MINUTE, cast(doc_id AS INT), "
        "TIMESTAMP '2024-01-01 00:00:00'), 'M/d/yyyy H:mm:ss') END AS modified",
    )
    path = new_folder(spark, "manifest-alias")
    raw.write.option("header", True).option("escape", '"').csv(path)
    good, rejects = manifests.read_manifest(spark, path, "csv")
    rows = good.select(
        F.lit("row").alias("outcome"),
        "item_id",
        "path",
        "size",
        stamp("last_modified").alias("last_modified"),
        F.lit(None).cast("string").alias("reason"),
    )
    return rows.unionByName(
        rejects.select(F.lit("reject").alias("outcome"), "reason"), allowMissingColumns=True
    )


@query(
    "dataset_scan",
    """SELECT doc_id, matter, custodian, id, file_name, drive, is_file FROM file_records""",
)
def dataset_scan(spark, sf_dir):
    extract = new_folder(spark, "extract")
    records = domain.file_records(spark, sf_dir)
    records.withColumn("size", F.col("doc_id")).drop("dataset").write.partitionBy("matter", "custodian").parquet(extract)
    # Parquet extract to landing JSON, one folder per matter and custodian.
    target = new_folder(spark, "landing")
    spark.read.parquet(extract).write.partitionBy("matter", "custodian").json(target)
    found, _ = datasets.read_file_records(spark, target)
    strip = lambda c: F.regexp_replace(c, "^[a-z]+=", "")
    return found.select(
        F.col("size").alias("doc_id"),
        strip("matter").alias("matter"),
        strip("custodian").alias("custodian"),
        "id",
        F.coalesce("fileName", "name").alias("file_name"),
        F.coalesce("driveId", F.col("parentReference.driveId")).alias("drive"),
        (F.col("file").isNotNull() & F.col("folder").isNull()).alias("is_file"),
    )


@query(
    "dataset_metadata",
    "SELECT custodian, matter, count(*) AS record_count FROM file_records GROUP BY 1, 2",
)
def dataset_metadata(spark, sf_dir):
    records = domain.file_records(spark, sf_dir).withColumn(
        "source_file", F.concat_ws("/", F.lit("/land"), "matter", "custodian", F.lit("dataset.json"))
    )
    derived = datasets.with_path_metadata(records.drop("matter", "custodian"))
    return datasets.dataset_metadata(derived).select("custodian", "matter", "record_count")


@query(
    "landing_discovery",
    """WITH f AS (SELECT '/land/' || lang || '/run' || (doc_id % 9) || '/' || CASE WHEN doc_id % 10 = 0 THEN 'files-' WHEN doc_id % 2 = 0 THEN 'part-' ELSE 'sub/part-' END
           || doc_id || CASE WHEN doc_id % 7 = 3 THEN '.txt' ELSE '.json' END AS path FROM documents),
         m AS (SELECT DISTINCT '/land/' || lang || '/run' || (doc_id % 9) AS folder FROM documents WHERE doc_id % 9 < 3)
       SELECT DISTINCT path FROM f WHERE path LIKE '%.json' AND (path LIKE '%/files-%' OR EXISTS (
         SELECT 1 FROM m WHERE starts_with(f.path, m.folder || '/')))""",
)
def landing_discovery(spark, sf_dir):
    documents = domain.table(spark, sf_dir, "documents")
    listing = documents.selectExpr(
        "concat('/land/', lang, '/run', doc_id % 9, '/', CASE WHEN doc_id % 10 = 0 THEN 'files-' WHEN doc_id % 2 = 0 THEN 'part-' "
        "ELSE 'sub/part-' END, doc_id, CASE WHEN doc_id % 7 = 3 THEN '.txt' ELSE '.json' END) AS path"
    )
    markers = (
        documents.filter("doc_id % 9 < 3")
        .selectExpr("concat('/land/', lang, '/run', doc_id % 9, CASE doc_id % 2 WHEN 0 THEN '/_SUCCESS' ELSE '/run.complete' END) AS path")
        .distinct()
    )
    return landing.discover_datasets(listing, markers)


@query(
    "manifest_pairing",
    """WITH c AS (SELECT o_orderkey AS k, 'c_' || o_custkey || '@x.org' AS custodian, CAST(o_orderkey AS VARCHAR) AS job FROM orders),
         s AS (SELECT custodian || '_' || job || '_source.csv' AS name FROM c WHERE k % 5 = 0
           UNION SELECT custodian || '_' || job || '_source.json' FROM c WHERE k % 5 IN (0, 1)
           UNION SELECT custodian || '_source.json' FROM c WHERE k % 50 = 2
           UNION SELECT 'source_' || job || '.csv' FROM c WHERE k % 5 = 3)
       SELECT c.custodian, c.job AS job_id, CASE
         WHEN custodian || '_' || job || '_source.csv' IN (SELECT name FROM s) THEN '/src/' || custodian || '_' || job || '_source.csv'
         WHEN custodian || '_' || job || '_source.json' IN (SELECT name FROM s) THEN '/src/' || custodian || '_' || job || '_source.json'
         WHEN custodian || '_source.json' IN (SELECT name FROM s) THEN '/src/' || custodian || '_source.json'
         WHEN 'source_' || job || '.csv' IN (SELECT name FROM s) THEN '/src/source_' || job || '.csv' END AS source_path
       FROM c WHERE k % 8 <> 1""",
)
def manifest_pairing(spark, sf_dir):
    orders = domain.table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS k", "concat('c_', o_custkey, '@x.org') AS custodian", "cast(o_orderkey AS STRING) AS job"
    )
    collected = orders.select(F.concat(F.lit("/col/"), "custodian", F.lit("_"), "job", F.lit("_collected.csv")).alias("path"))
    names = F.array(
        F.when(F.col("k") % 5 == 0, F.concat("custodian", F.lit("_"), "job", F.lit("_source.csv"))),
        F.when((F.col("k") % 5).isin(0, 1), F.concat("custodian", F.lit("_"), "job", F.lit("_source.json"))),
        F.when(F.col("k") % 50 == 2, F.concat("custodian", F.lit("_source.json"))),
        F.when(F.col("k") % 5 == 3, F.concat(F.lit("source_"), "job", F.lit(".csv"))),
    )
    sources = (
        orders.select(F.explode(names).alias("name"))
        .filter("name IS NOT NULL")
        .distinct()
        .select(F.concat(F.lit("/src/"), "name").alias("path"))
    )
    reports = orders.filter("k % 8 = 1").select(F.concat(F.lit("/rep/recon_report_"), "job", F.lit(".csv")).alias("path"))
    return landing.pair_manifests(collected, sources, reports).select("custodian", "job_id", "source_path")


# --- compliance log ----------------------------------------------------------


def _log_folder(spark, sf_dir):
    """Every lifecycle event as a log line, some with a continuation line."""
    events = domain.lifecycle_events(spark, sf_dir)
    prefix = F.concat(F.lit("["), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS"), F.lit(" +00:00] "))
    payload = F.to_json(F.struct(F.col("event_type").alias("Action"), F.struct(F.col("job_id").alias("JobId")).alias("Data")))
    custodian = F.when(F.col("event_id") % 3 == 0, "null").otherwise(F.concat(F.lit("u"), "job_id", F.lit("@x.org")))
    audit_line = F.concat(
        F.lit("AUDIT: "), "event_type", F.lit(" | Custodian: "), custodian, F.lit(" | CorrelationId: "),
        "correlation_id", F.lit(" | Data: "), payload,
    )
    custody_line = F.concat(
        F.lit("CHAIN_OF_CUSTODY: Collected | ItemId: i"), "event_id", F.lit(" | Hash: "),
        F.sha2(F.col("event_id").cast("string"), 256), F.lit(" | CorrelationId: "), "correlation_id",
        F.lit(" | Data: "), payload,
    )
    performance_line = F.concat(
        F.lit("PERFORMANCE: "), "event_type", F.lit(" | Duration: "), "duration_ms", F.lit("ms | Items: "),
        "collected_items", F.lit(" | Size: "), "collected_size_bytes", F.lit(" bytes | CorrelationId: "),
        "correlation_id", F.lit(" | Throughput: 1.00 items/sec, 0.10 MB/sec"),
    )
    security_line = F.concat(
        F.lit("SECURITY: "), "event_type", F.lit(" | CorrelationId: "), "correlation_id", F.lit(" | User: svc"),
        F.col("event_id") % 7, F.lit(" | Data: "), payload,
    )
    collection_line = F.concat(
        F.lit("DATA_COLLECTION: u"), "job_id", F.lit("@x.org | Type: Email | Route: GraphApi | Items: "), "collected_items",
        F.lit(" | Size: "), F.format_string("%d.%02d", F.col("event_id") % 50, (F.col("event_id") % 4) * 25),
        F.lit(" MB | CorrelationId: "), "correlation_id",
    )
    error_line = F.concat(
        F.lit("ERROR: While "), "event_type", F.lit(" | Exception: TimeoutException | CorrelationId: "), "correlation_id",
        F.lit(" | Data: "), payload,
    )
    quota = F.when(F.col("event_id") % 3 == 0, "N/A").otherwise(F.concat(F.col("event_id") % 100, F.lit("%")))
    api_line = F.concat(
        F.lit("GRAPH_API: GET /users/u"), "job_id", F.lit("/messages | Status: "),
        F.when(F.col("event_id") % 2 == 0, "200").otherwise("429"), F.lit(" | Duration: "), "duration_ms",
        F.lit("ms | CorrelationId: "), "correlation_id", F.lit(" | Quota: "), quota,
    )
    plain_line = F.concat(F.lit("Worker heartbeat "), "event_id")
    turn = F.col("event_id") % 8
    lines = [audit_line, custody_line, performance_line, plain_line, security_line, collection_line, error_line, api_line]
    body = F.lit(None).cast("string")
    for number, line in enumerate(lines):
        body = F.when(turn == number, line).otherwise(body)
    tail = F.when(F.col("event_id") % 10 == 3, "\nSELECT continued").otherwise("")
    path = new_folder(spark, "log")
    events.select(F.concat(prefix, body, tail).alias("value")).write.text(path)
    return path


@query(
    "compliance_log_scan",
    """WITH l AS (SELECT *, event_id % 8 AS t,
         ['AUDIT', 'CHAIN_OF_CUSTODY', 'PERFORMANCE', NULL, 'SECURITY', 'DATA_COLLECTION', 'ERROR', 'GRAPH_API'][event_id % 8 + 1] AS category FROM lifecycle)
       SELECT strftime(ts, '%Y-%m-%d %H:%M:%S.%g') AS ts, category,
         CASE t WHEN 1 THEN 'Collected' WHEN 3 THEN NULL WHEN 5 THEN 'DataCollected' WHEN 6 THEN 'While ' || event_type
           WHEN 7 THEN 'GET /users/u' || job_id || '/messages' ELSE event_type END AS name,
         CASE WHEN t = 5 OR t = 0 AND event_id % 3 <> 0 THEN 'u' || job_id || '@x.org' END AS custodian,
         CASE WHEN t <> 3 THEN correlation_id END AS correlation_id,
         CASE WHEN t = 1 THEN 'i' || event_id END AS item_id,
         CASE WHEN t = 1 THEN sha256(CAST(event_id AS VARCHAR)) END AS hash,
         CASE WHEN t IN (2, 7) THEN duration_ms END AS duration_ms,
         CASE WHEN t IN (2, 5) THEN collected_items END AS item_count,
         CASE t WHEN 2 THEN collected_size_bytes WHEN 5 THEN (event_id % 50) * 1048576 + (event_id % 4) * 262144 END AS size_bytes,
         CASE WHEN t IN (0, 1, 4, 6) THEN CAST(job_id AS VARCHAR) END AS job_id,
         CASE WHEN t = 4 THEN 'svc' || (event_id % 7) END AS user_context,
         CASE WHEN t = 6 THEN 'TimeoutException' END AS exception_type,
         CASE WHEN t = 5 THEN 'Email' END AS job_type, CASE WHEN t = 5 THEN 'GraphApi' END AS route,
         CASE WHEN t = 7 AND event_id % 3 <> 0 THEN (event_id % 100) || '%' END AS quota,
         CASE WHEN t = 7 THEN CASE WHEN event_id % 2 = 0 THEN 200 ELSE 429 END END AS status_code,
         CASE WHEN t = 7 THEN '/users/u' || job_id || '/messages' END AS endpoint
       FROM l""",
)
def compliance_log_scan(spark, sf_dir):
    rows, _ = logs.read_log(spark, _log_folder(spark, sf_dir))
    return rows.select(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS").alias("ts"), "category", "name", "custodian",
        "correlation_id", "item_id", "hash", "duration_ms", "item_count", "size_bytes",
        logs.data_field("$.Data.JobId").alias("job_id"), "user_context", "exception_type", "job_type", "route", "quota",
        "status_code", "endpoint",
    )


@query(
    "log_routing",
    """SELECT CASE WHEN event_id % 8 IN (2, 5, 7) THEN 'collection' WHEN event_id % 8 IN (3, 6) THEN 'general' ELSE 'audit' END AS destination, count(*) AS line_count
       FROM lifecycle GROUP BY 1
       UNION ALL SELECT 'unmatched', count(*) FROM lifecycle WHERE event_id % 10 = 3""",
)
def log_routing(spark, sf_dir):
    rows, unmatched = logs.read_log(spark, _log_folder(spark, sf_dir))
    routed = audit.route_log(rows).groupBy("destination").agg(F.count(F.lit(1)).alias("line_count"))
    return routed.unionByName(unmatched.agg(F.count(F.lit(1)).alias("line_count")).withColumn("destination", F.lit("unmatched")))


# --- sinks -------------------------------------------------------------------


@query(
    "report_files",
    """SELECT job_id AS job, 'Missed' AS section, missed_count AS row_count FROM recon_counts WHERE missed_count > 0
       UNION ALL SELECT job_id, 'Extras', extra_count FROM recon_counts WHERE extra_count > 0
       UNION ALL SELECT job_id, 'HashMismatches', hash_mismatch_count FROM recon_counts WHERE hash_mismatch_count > 0
       UNION ALL SELECT job_id, 'Summary', 1 FROM recon_counts""",
)
def report_files(spark, sf_dir):
    options = ReconcileOptions(require_hash_match=True)
    rows = reconcile.report(
        domain.source_manifest(spark, sf_dir),
        domain.collected_manifest(spark, sf_dir),
        options,
        domain.instant(domain.CREATED),
    )
    path = files.write_report(rows, new_folder(spark, "report"))
    written = spark.read.option("header", True).option("escape", '"').csv(path)
    return written.groupBy("job", F.col("Section").alias("section")).agg(F.count(F.lit(1)).alias("row_count"))


def _manifests(spark, sf_dir, columns=None):
    """Manifests and numbered items, which read the same columns of the items and so share a shuffle; all columns unless given."""
    items = domain.items(spark, sf_dir)
    sequenced = held(custody.collection_sequence(items), columns or items.columns)
    return custody.job_manifests(domain.jobs(spark, sf_dir), items, domain.instant(domain.CREATED), sequenced=sequenced), sequenced


@query(
    "job_manifest_rows",
    """SELECT job_id, CAST(0 AS BIGINT) AS ord, 'MANIFEST_HEADER' AS type, CAST(total_items AS VARCHAR) AS total_items, manifest_hash AS digest FROM hashed_manifests
       UNION ALL SELECT job_id, sequence, 'ITEM', NULL, sha256 FROM sequenced""",
)
def job_manifest_rows(spark, sf_dir):
    rows = files.job_manifest_rows(*_manifests(spark, sf_dir, custody.MANIFEST_COLUMNS))
    return rows.select(
        "job_id", "ord", F.col("Type").alias("type"), F.col("TotalItems").alias("total_items"),
        F.coalesce("ManifestHash", "Sha256Hash").alias("digest"),
    )


@query(
    "job_documents",
    """SELECT h.job_id, CAST(total_items AS INTEGER) AS items, CAST(ceil(total_items / 50000.0) AS BIGINT) AS item_parts, items_hash, manifest_hash,
         coalesce(n, 0) AS written_items, CAST(coalesce(last, 0) AS BIGINT) AS last_sequence
       FROM hashed_manifests h LEFT JOIN (SELECT job_id, count(*) AS n, max(sequence) AS last FROM sequenced GROUP BY 1) s ON h.job_id = s.job_id""",
)
def job_documents(spark, sf_dir):
    # Two writes, so two shuffles; the one for the headers reads no more than they need.
    built, sequenced = _manifests(spark, sf_dir, custody.MANIFEST_COLUMNS)
    path = files.write_job_manifest_json(built, sequenced, new_folder(spark, "job-json"))
    value = F.col("value")
    headers = spark.read.text(f"{path}/documents").select(
        F.get_json_object(value, "$.jobId").cast("long").alias("job_id"),
        F.get_json_object(value, "$.totalItems").cast("int").alias("items"),
        F.get_json_object(value, "$.itemParts").cast("long").alias("item_parts"),
        F.get_json_object(value, "$.integrity.itemsHash").alias("items_hash"),
        F.get_json_object(value, "$.integrity.manifestHash").alias("manifest_hash"),
    )
    written = spark.read.parquet(f"{path}/items").groupBy("job_id").agg(
        F.count(F.get_json_object(value, "$.sha256Hash")).alias("written_items"),
        F.max(F.get_json_object(value, "$.collectionSequence").cast("long")).alias("last_sequence"),
    )
    zero = F.lit(0).cast("long")
    joined = headers.join(written, "job_id", "left")
    return joined.withColumns({c: F.coalesce(c, zero) for c in ("written_items", "last_sequence")})


@query(
    "job_manifest_csv",
    """SELECT 'MANIFEST_HEADER' AS type, CAST(job_id AS VARCHAR) AS job_id, CAST(NULL AS VARCHAR) AS sequence, manifest_hash AS digest FROM hashed_manifests
       UNION ALL SELECT 'ITEM', CAST(job_id AS VARCHAR), CAST(sequence AS VARCHAR), sha256 FROM sequenced""",
)
def job_manifest_csv(spark, sf_dir):
    path = files.write_job_manifest_csv(*_manifests(spark, sf_dir), new_folder(spark, "job-csv"))
    written = spark.read.option("header", True).option("escape", '"').csv(path)
    return written.select(
        F.col("Type").alias("type"), "job_id", F.col("Sequence").alias("sequence"), F.coalesce("ManifestHash", "Sha256Hash").alias("digest")
    )


@query(
    "content_inventory_files",
    """SELECT lang || '/' || source AS name, CAST(sum(strlen(text) + 1) AS BIGINT) AS content_length,
         sha256(string_agg(text || chr(10), '' ORDER BY doc_id)) AS content_sha256 FROM documents GROUP BY 1""",
)
def content_inventory_files(spark, sf_dir):
    """Documents landed as one file for each language and source, then hashed as files."""
    documents = domain.table(spark, sf_dir, "documents").select("lang", "source", "doc_id", "text")
    path = new_folder(spark, "landed")
    placed = documents.repartition(8, "lang", "source").sortWithinPartitions("lang", "source", "doc_id")
    placed.drop("doc_id").write.partitionBy("lang", "source").text(path)
    found = datasets.read_content(spark, path, "*.txt")
    name = F.regexp_extract("source_file", "lang=([^/]+)/source=([^/]+)/", 1), F.regexp_extract("source_file", "lang=([^/]+)/source=([^/]+)/", 2)
    return found.select(F.concat_ws("/", *name).alias("name"), "content_length", "content_sha256")


@query(
    "manifest_digest_sidecar",
    """SELECT custodian, count(*) AS row_count, TRUE AS digest_matches FROM collected_manifest GROUP BY 1""",
)
def manifest_digest_sidecar(spark, sf_dir):
    """Digest sidecar of a written manifest, checked against digests of the bytes as Spark reads them."""
    entries = domain.collected_manifest(spark, sf_dir).withColumn("owner", F.col("custodian"))
    path = files.write_manifest_csv(entries, new_folder(spark, "manifest-csv"), ["owner"])
    sidecar = spark.read.text(files.write_manifest_digest(spark, path, new_folder(spark, "digest")))
    stored = sidecar.select(F.substring_index("value", "  ", 1).alias("stored"), F.regexp_extract("value", "owner=([^/]+)$", 1).alias("custodian"))
    whole = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").load(path)
    parts = whole.select(F.regexp_extract("path", "owner=([^/]+)/", 1).alias("custodian"), F.struct("path", F.sha2("content", 256).alias("d")).alias("p"))
    again = parts.groupBy("custodian").agg(
        F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["d"]), ""), 256).alias("again")
    )
    rows, _ = manifests.read_manifest(spark, path, "csv")
    counts = rows.groupBy("custodian").agg(F.count(F.lit(1)).alias("row_count"))
    return counts.join(stored, "custodian").join(again, "custodian").select("custodian", "row_count", (F.col("stored") == F.col("again")).alias("digest_matches"))


@query("landing_json", "SELECT dataset, doc_id, id, drive, is_file FROM file_records")
def landing_json(spark, sf_dir):
    """A Parquet extract turned into landing JSON and read as a dataset."""
    extract = new_folder(spark, "extract")
    domain.file_records(spark, sf_dir).withColumn("size", F.col("doc_id")).withColumn("fileName", F.col("dataset")).write.parquet(extract)
    target = files.parquet_to_landing_json(spark, extract, new_folder(spark, "landing"))
    found, _ = datasets.read_file_records(spark, target)
    return found.select(
        F.col("fileName").alias("dataset"), F.col("size").alias("doc_id"), "id",
        F.coalesce("driveId", F.col("parentReference.driveId")).alias("drive"),
        (F.col("file").isNotNull() & F.col("folder").isNull()).alias("is_file"),
    )


@query(
    "marker_discovery",
    """SELECT DISTINCT lang, source FROM documents WHERE lang IN ('en', 'de') OR source = 'src1'""",
)
def marker_discovery(spark, sf_dir):
    """Datasets released by real markers, one of them many folders above its files."""
    documents = domain.table(spark, sf_dir, "documents").select("lang", "source", "doc_id").distinct()
    root = new_folder(spark, "zone")
    for lang in ("en", "de"):
        mine = documents.filter(F.col("lang") == lang)
        mine.withColumn("deep", F.lit("x")).write.partitionBy("lang", "source", "deep").json(f"{root}/a/b/c/d/e/f/{lang}-run")
    other = documents.filter("lang NOT IN ('en', 'de')")
    # No marker of its own: only the files named as datasets are released.
    other.repartition("lang", "source").write.partitionBy("lang", "source").json(f"{root}/open")
    remove_folder(spark, f"{root}/open/_SUCCESS")
    for path in list_names(spark, f"{root}/open/lang=*/source=src1/part-*.json"):
        rename_file(spark, path, path.replace("part-", "dataset-"))
    found = landing.discover_datasets(landing.list_files(spark, root, "*.json"), landing.marker_files(spark, root))
    return found.select(
        F.regexp_extract("path", "lang=([^/]+)/", 1).alias("lang"), F.regexp_extract("path", "source=([^/]+)/", 1).alias("source")
    ).distinct()


@query("declared_tables", "SELECT shard_id, checkpoint_id, is_completed FROM checkpoints")
def declared_tables(spark, sf_dir):
    """The checkpoint table written and read back with its declared schema."""
    root = new_folder(spark, "tables")
    domain.checkpoints(spark, sf_dir).write.parquet(f"{root}/checkpoints")
    return datasets.read_table(spark, root, "checkpoints").select("shard_id", "checkpoint_id", "is_completed")


def _planned_shards(spark, sf_dir):
    return shards.plan_shards(domain.shard_requests(spark, sf_dir), domain.instant(domain.CREATED))


def _job_logs(spark, sf_dir):
    return domain.lifecycle_events(spark, sf_dir).selectExpr(
        "event_id AS log_id", "job_id", "ts", "'Information' AS level", "event_type AS category", "concat('event ', event_id) AS message", "correlation_id"
    )


# Each declared table: its rows, a number and a time over its columns, and the same over the provided tables.
_DECLARED = {
    "matters": (domain.matters, "sum(matter_id)", "min(created_date)", "SELECT count(*), sum(n_nationkey), NULL FROM nation"),
    "jobs": (domain.jobs, "sum(estimated_bytes)", "max(start_time)", "SELECT count(*), sum(floor(o_totalprice)), max(o_orderdate) + INTERVAL 1 HOUR FROM orders"),
    "items": (domain.items, "sum(size_bytes)", "min(item_date)", "SELECT count(*), sum(floor(l_extendedprice)), min(l_shipdate) FROM lineitem"),
    "job_logs": (_job_logs, "sum(log_id)", "max(ts)", "SELECT count(*), sum(event_id), max(ts) FROM events"),
    "manifests": (
        domain.sealed_manifests, "count_if(is_sealed)", "min(created_date)",
        "SELECT count(*), count(*) FILTER (WHERE o_orderkey % 5 = 0), min(o_orderdate) FROM orders WHERE o_orderstatus = 'F'",
    ),
    "verifications": (
        domain.verifications, "count_if(result = 'Valid')", "max(verification_date)",
        "SELECT count(*), count(*) FILTER (WHERE l_returnflag = 'A'), max(l_shipdate) FROM lineitem",
    ),
    "shard_requests": (
        domain.shard_requests, "sum(size(custodians))", "max(end_date)", "SELECT count(*), sum(len(custodians)), max(end_date) FROM shard_requests",
    ),
    "shards": (_planned_shards, "sum(shard_index * 3 + max_retries)", "max(end_date)", "SELECT count(*), sum(shard_index * 3 + 3), max(to_date) FROM windows"),
    "checkpoints": (domain.checkpoints, "sum(items_processed)", "min(created_date)", "SELECT count(*), sum(event_id % 100), min(ts) FROM events"),
    "cursors": (
        domain.cursors, "sum(last_delta_size_bytes)", "max(updated_date)",
        "SELECT count(*), sum(c_custkey % 1000), TIMESTAMP '2024-02-01' + to_minutes(max(c_custkey)) FROM customer",
    ),
    "metric_points": (domain.metric_points, "cast(sum(value) AS BIGINT)", "max(ts)", "SELECT count(*), sum(round(value * 100)), max(ts) FROM events"),
    "lifecycle_events": (domain.lifecycle_events, "sum(size_bytes)", "min(ts)", "SELECT count(*), sum(round(value * 100)), min(ts) FROM events"),
}


@query(
    "declared_tables_all",
    " UNION ALL ".join(
        f"SELECT '{name}' AS table_name, CAST(n AS BIGINT) AS n_rows, CAST(t AS BIGINT) AS total, strftime(CAST(e AS TIMESTAMP), '%Y-%m-%d %H:%M:%S.%f') AS edge FROM ({sql}) AS v(n, t, e)"
        for name, (_, _, _, sql) in _DECLARED.items()
    ),
)
def declared_tables_all(spark, sf_dir):
    """Every declared table written and read back with its schema; columns that its files lack are null."""
    root = new_folder(spark, "all-tables")
    found = []
    for name, (rows, total, edge, _) in _DECLARED.items():
        made = rows(spark, sf_dir)
        declared = [f for f in schemas.TABLES[name].fields if f.name in made.columns]
        made.select(*[F.col(f.name).cast(f.dataType) for f in declared]).write.parquet(f"{root}/{name}")
        table = datasets.read_table(spark, root, name)
        found.append(
            table.agg(
                F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n_rows"), F.expr(total).cast("long").alias("total"), stamp(F.expr(edge)).alias("edge")
            )
        )
    return reduce(DataFrame.unionByName, found)


@query(
    "manifest_csv_mixed_headers",
    """SELECT doc_id % 3 AS form, custodian, coalesce(item_id, '') AS item_id, path, size, CASE WHEN doc_id % 3 < 2 THEN sha256 END AS sha256 FROM source_manifest""",
)
def manifest_csv_mixed_headers(spark, sf_dir):
    """One folder of CSV files with three headers: other orders, other names, other widths."""
    rows = domain.source_manifest(spark, sf_dir)
    root = new_folder(spark, "mixed-csv")
    forms = (
        ["custodian", "item_id", "path", "size", "sha256"],
        ["size AS FileSize", "sha256 AS Hash", "path AS File_Path", "custodian AS Custodian", "item_id AS ID"],
        ["drive_id AS DriveId", "path AS `Path`", "item_id AS ItemId", "size AS Size", "custodian AS CUSTODIAN", "kind AS Kind"],
    )
    for number, form in enumerate(forms):
        rows.filter(F.col("doc_id") % 3 == number).selectExpr(*form).write.mode("append").option("header", True).option("escape", '"').csv(f"{root}/f{number}")
    found, _ = manifests.read_manifest(spark, root, "csv")
    form = F.regexp_extract("source_file", "/f([0-9])/", 1).cast("long")
    return found.select(form.alias("form"), "custodian", F.coalesce("item_id", F.lit("")).alias("item_id"), "path", "size", "sha256")


def _mixed_json(spark, rows, label):
    """A folder with JSON lines beside files of one array, some pretty-printed."""
    root = new_folder(spark, label)
    lines = rows.select(F.to_json(F.struct(*rows.columns)).alias("value"), (F.abs(F.xxhash64(*rows.columns)) % 4).alias("k"))
    lines.filter("k < 2").select("value").write.mode("append").text(f"{root}/lines")
    arrays = lines.filter("k >= 2").groupBy("k").agg(F.concat(F.lit("\n[ "), F.array_join(F.collect_list("value"), ",\n  "), F.lit("\n]")).alias("value"))
    arrays.write.partitionBy("k").text(f"{root}/arrays")
    return root


@query("manifest_json_mixed_forms", _MANIFEST_SQL)
def manifest_json_mixed_forms(spark, sf_dir):
    entries = domain.collected_manifest(spark, sf_dir).select(
        "custodian", "kind", F.col("drive_id").alias("DriveId"), F.col("item_id").alias("itemId"), "path", "size", F.col("sha256").alias("SHA256")
    )
    found, _ = manifests.read_manifest(spark, _mixed_json(spark, entries, "mixed-json"), "json")
    return found.select(
        "custodian", "kind", "drive_id", F.coalesce("item_id", F.lit("")).alias("item_id"), "path", "size", "sha256"
    )


@query("dataset_scan_mixed", "SELECT doc_id, id, file_name, drive, is_file FROM file_records")
def dataset_scan_mixed(spark, sf_dir):
    records = domain.file_records(spark, sf_dir).withColumn("size", F.col("doc_id")).drop("dataset", "matter", "custodian", "doc_id")
    found, _ = datasets.read_file_records(spark, _mixed_json(spark, records, "mixed-records"))
    return found.select(
        F.col("size").alias("doc_id"), "id", F.coalesce("fileName", "name").alias("file_name"),
        F.coalesce("driveId", F.col("parentReference.driveId")).alias("drive"),
        (F.col("file").isNotNull() & F.col("folder").isNull()).alias("is_file"),
    )


@query(
    "extract_layout",
    """SELECT 'w' || (user_id % 5) || '@x.org' AS custodian_email, strftime(ts, '%Y-%m-%d') AS date, count(*) AS row_count
       FROM events WHERE ts >= TIMESTAMP '2024-01-10' GROUP BY 1, 2""",
)
def extract_layout(spark, sf_dir):
    rows = domain.table(spark, sf_dir, "events").selectExpr(
        "event_id", "concat('w', user_id % 5, '@x.org') AS custodian", "ts AS date", "value"
    )
    path = files.write_extract(rows, new_folder(spark, "extract"))
    kept = files.retained(spark.read.parquet(path), domain.instant("2024-01-30 00:00:00"), days=20)
    return kept.groupBy("custodian_email", F.date_format("date", "yyyy-MM-dd").alias("date")).agg(
        F.count(F.lit(1)).alias("row_count")
    )


@query(
    "cursor_store",
    """SELECT scope_id, CASE WHEN job_id % 4 = 0 THEN 'new' ELSE delta_token END AS delta_token, is_active
       FROM latest_cursors WHERE job_id % 10 <> 3""",
)
def cursor_store(spark, sf_dir):
    store = CursorStore(spark, new_folder(spark, "cursors"))
    store.save(delta.latest_cursors(domain.cursors(spark, sf_dir)))
    store.upsert(store.load().filter("job_id % 4 = 0").withColumn("delta_token", F.lit("new")))
    store.remove(store.load().filter("job_id % 10 = 3"))
    return store.load().select("scope_id", "delta_token", "is_active")
