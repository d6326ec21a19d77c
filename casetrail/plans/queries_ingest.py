"""Dataset ingest, message and content queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from casetrail.functions import measures, paths
from casetrail.operators import ingest, messages
from casetrail.plans import domain
from casetrail.plans.catalog import query, stamp

MAX_ERRORS = 2
BLOCK = 64


@query(
    "file_record_filter",
    """SELECT doc_id, file_name, custodian FROM file_records
       WHERE is_file AND file_name IS NOT NULL AND lower(regexp_extract(file_name, '(\\.[^./\\\\]+)$', 1)) IN ('.docx', '.txt')
         AND (modified IS NULL OR modified >= TIMESTAMP '2024-01-01 05:00:00')
         AND custodian IN ('u1@x.org', 'u2@x.org', 'u3@x.org')""",
)
def file_record_filter(spark, sf_dir):
    kept = ingest.filter_records(
        domain.file_records(spark, sf_dir),
        extensions=[".docx", ".TXT"],
        modified_after=domain.instant("2024-01-01 05:00:00"),
        custodians=["U1@x.org", "u2@x.org", "u3@x.org"],
    )
    return kept.select("doc_id", paths.resolved_file_name(F.col("fileName"), F.col("name")).alias("file_name"), "custodian")


@query(
    "file_record_triage",
    """SELECT doc_id, coalesce(drive, '') || '/' || coalesce(id, '') AS record_key,
         CASE WHEN drive IS NULL OR id IS NULL THEN 'Skipped' ELSE 'Ready' END AS outcome,
         CASE WHEN drive IS NOT NULL AND id IS NOT NULL THEN NULL WHEN web_url IS NOT NULL
           THEN 'SkippedNoId - webUrl resolution not implemented' ELSE 'SkippedNoId - missing driveId or itemId' END AS skip_reason
       FROM file_records WHERE is_file""",
)
def file_record_triage(spark, sf_dir):
    rows = ingest.triage(ingest.filter_records(domain.file_records(spark, sf_dir)))
    return rows.select("doc_id", "record_key", "outcome", "skip_reason")


def _results(spark, sf_dir):
    kept = ingest.triage(ingest.filter_records(domain.file_records(spark, sf_dir)))
    indexed = ingest.index_records(
        kept, "dataset", [F.col("doc_id")], coarse=F.floor(F.col("doc_id") / BLOCK), hot_rows=20
    )
    fetched = ingest.fetch(indexed, domain.landed_content(spark, sf_dir), "/evidence")
    return ingest.cut_off(fetched, "dataset", MAX_ERRORS)


@query(
    "record_index",
    """SELECT doc_id, dataset, record_index,
         CASE WHEN outcome <> 'Skipped' THEN '/evidence/matter/' || matter || '/GDC/' || custodian || '/' ||
           printf('%06d', record_index) || '_' || coalesce(file_name, 'unknown_file') END AS output_path
       FROM fetched""",
)
def record_index(spark, sf_dir):
    return _results(spark, sf_dir).select("doc_id", "dataset", "record_index", "output_path")


@query("max_errors_cutoff", "SELECT doc_id, dataset, record_index, outcome, counted FROM fetched_counted")
def max_errors_cutoff(spark, sf_dir):
    return _results(spark, sf_dir).select("doc_id", "dataset", "record_index", "outcome", "counted")


@query(
    "fetch_summary",
    """SELECT dataset, count(*) AS total_records, count(*) FILTER (WHERE counted AND outcome = 'Success') AS successful,
         count(*) FILTER (WHERE counted AND outcome = 'Failed') AS failed, count(*) FILTER (WHERE counted AND outcome = 'Skipped') AS skipped,
         CAST(coalesce(sum(bytes_fetched) FILTER (WHERE counted), 0) AS BIGINT) AS total_bytes,
         count(*) FILTER (WHERE counted AND outcome = 'Failed') < 2 AS success
       FROM fetched_counted GROUP BY 1""",
)
def fetch_summary(spark, sf_dir):
    return ingest.fetch_summary(_results(spark, sf_dir), "dataset", MAX_ERRORS)


@query(
    "fetch_manifest",
    """SELECT custodian, 'File' AS kind, drive AS drive_id, id AS item_id, path, bytes_fetched AS size, content_sha256 AS sha256
       FROM fetched_counted WHERE counted AND outcome = 'Success'""",
)
def fetch_manifest(spark, sf_dir):
    rows = ingest.fetch_manifest(_results(spark, sf_dir), domain.instant(domain.CREATED))
    return rows.select("custodian", "kind", "drive_id", "item_id", "path", "size", "sha256")


@query(
    "content_hash_inventory",
    """SELECT 'document' AS kind, doc_id AS key, sha256(text) AS content_sha256, strlen(text) AS content_length FROM documents
       UNION ALL SELECT 'page', page_id, sha256(html), strlen(html) FROM pages""",
)
def content_hash_inventory(spark, sf_dir):
    documents = ingest.content_inventory(domain.table(spark, sf_dir, "documents"), ["doc_id"], "text")
    pages = ingest.content_inventory(domain.table(spark, sf_dir, "pages"), ["page_id"], "html")
    return (
        documents.withColumnRenamed("doc_id", "key")
        .withColumn("kind", F.lit("document"))
        .unionByName(pages.withColumnRenamed("page_id", "key").withColumn("kind", F.lit("page")))
    )


@query(
    "duplicate_content",
    """SELECT sha256(text) AS content_sha256, count(*) AS copies, min(doc_id) AS first_key FROM documents
       GROUP BY 1 HAVING count(*) > 1""",
)
def duplicate_content(spark, sf_dir):
    inventory = ingest.content_inventory(domain.table(spark, sf_dir, "documents"), ["doc_id"], "text")
    return ingest.duplicate_content(inventory, "doc_id")


@query(
    "mail_keyword_filter",
    """SELECT id, strftime(received, '%Y-%m-%d %H:%M:%S.%f') AS received FROM messages
       WHERE received >= TIMESTAMP '2024-01-03' AND received <= TIMESTAMP '2024-03-01'
         AND (contains(lower(subject), 'the') OR contains(lower(preview), 'the')
           OR contains(lower(subject), 'contract') OR contains(lower(preview), 'contract'))""",
)
def mail_keyword_filter(spark, sf_dir):
    kept = messages.mail_filter(
        domain.messages(spark, sf_dir),
        domain.instant("2024-01-03 00:00:00"),
        domain.instant("2024-03-01 00:00:00"),
        ["THE", "Contract"],
    )
    return kept.select("id", stamp("received").alias("received"))


@query(
    "mail_items",
    """SELECT id AS item_id, recipients, CAST(2 * length(subject) + 2 * length(preview) + 1024 AS BIGINT) AS size_bytes,
         '/out/' || custodian || '/Email/' ||
           substr(regexp_replace(id || '_' || subject || '.json', '[\\x00-\\x1f"<>|:*?\\\\/]', '', 'g'), 1, 100) AS file_path
       FROM messages""",
)
def mail_items(spark, sf_dir):
    rows = messages.mail_items(domain.messages(spark, sf_dir), "/out")
    return rows.select("item_id", "recipients", "size_bytes", "file_path")


@query(
    "drive_items",
    """SELECT id AS item_id, 'Doc' || doc_id || CASE doc_id % 4 WHEN 0 THEN '.Txt' WHEN 1 THEN '.pdf' WHEN 2 THEN '.msg' ELSE '' END AS subject,
         size AS size_bytes, custodian FROM file_records
       WHERE doc_id % 8 <> 0 AND doc_id % 11 <> 7 AND id IS NOT NULL
       UNION ALL SELECT coalesce(id, ''), CASE WHEN doc_id % 11 <> 7 THEN 'Doc' || doc_id || CASE doc_id % 4 WHEN 0 THEN '.Txt' WHEN 1 THEN '.pdf' WHEN 2 THEN '.msg' ELSE '' END END,
         size, custodian FROM file_records WHERE doc_id % 8 <> 0 AND NOT (doc_id % 11 <> 7 AND id IS NOT NULL)""",
)
def drive_items(spark, sf_dir):
    rows = messages.drive_item_rows(domain.file_records(spark, sf_dir), "/out")
    return rows.select("item_id", "subject", "size_bytes", "custodian")


@query(
    "safe_names",
    r"""WITH n AS (SELECT doc_id, lang, source, 'R' || chr(9) || 'e:' || doc_id || '?/' || lang || '|x<' || source || '>*"\.txt' AS name FROM documents)
       SELECT doc_id, regexp_replace(name, '[\x00-\x1f"<>|:*?\\/]', '_', 'g') AS replaced,
         substr(regexp_replace(name || repeat('y', 100), '[\x00-\x1f"<>|:*?\\/]', '', 'g'), 1, 100) AS dropped,
         '/evidence/matter/' || lang || '/GDC/' || source || '/' || printf('%06d', doc_id) || '_' ||
           regexp_replace(name, '[\x00-\x1f"<>|:*?\\/]', '_', 'g') AS output_path FROM n""",
)
def safe_names(spark, sf_dir):
    """Names in which every invalid character occurs."""
    rows = domain.table(spark, sf_dir, "documents").withColumn(
        "name",
        F.concat(F.lit("R\te:"), "doc_id", F.lit("?/"), "lang", F.lit("|x<"), "source", F.lit('>*"\\.txt')),
    )
    return rows.select(
        "doc_id",
        paths.sanitize_file_name(F.col("name")).alias("replaced"),
        paths.sanitize_file_name_drop(F.concat("name", F.repeat(F.lit("y"), F.lit(100)))).alias("dropped"),
        paths.output_path(F.lit("/evidence"), F.col("lang"), F.col("source"), F.col("doc_id"), F.col("name")).alias("output_path"),
    )


@query(
    "item_hashes",
    """SELECT id AS item_id, 'Email' AS item_type, sha256('{"id":' || to_json(id) || ',"subject":' || to_json(subject) || ',"sender":' || to_json(sender) ||
         ',"recipients":' || CASE sender WHEN 'user@x.org' THEN '[{"address":"assistant@x.org"},{"address":"log@x.org"}]' ELSE '[{"address":"user@x.org"}]' END ||
         ',"received":"' || strftime(received, '%Y-%m-%dT%H:%M:%S.000Z') || '","preview":' || to_json(preview) || '}') AS sha256
       FROM messages""",
)
def item_hashes(spark, sf_dir):
    """The digest of each message over its JSON text."""
    return messages.mail_items(domain.messages(spark, sf_dir), "/out").select("item_id", "item_type", "sha256")


@query(
    "retryable_errors",
    """SELECT event_id, http_status_code, message,
         http_status_code = 429 OR http_status_code BETWEEN 500 AND 599
           OR contains(lower(coalesce(message, '')), 'timeout') OR contains(lower(coalesce(message, '')), 'connection')
           OR contains(lower(coalesce(message, '')), 'network') AS retryable
       FROM lifecycle WHERE event_type = 'BackoffTriggered'""",
)
def retryable_errors(spark, sf_dir):
    rows = domain.lifecycle_events(spark, sf_dir).filter("event_type = 'BackoffTriggered'")
    return rows.select(
        "event_id",
        "http_status_code",
        "message",
        measures.is_retryable(F.col("http_status_code"), F.col("message")).alias("retryable"),
    )
