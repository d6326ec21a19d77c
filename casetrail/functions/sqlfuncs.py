"""The scalar functions under SQL names, for use in ``spark.sql``.

They are SQL-defined functions, which Spark inlines into the calling query: no
Python runs in the plan.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from casetrail.functions import measures

_ESTIMATE_BYTES = " ".join(
    f"WHEN '{name}' THEN {size}" for name, (size, _) in measures.SIZE_ESTIMATES.items()
)
_MINUTES = " ".join(
    f"WHEN '{name}' THEN greatest({least}, days * {per_day}D)"
    for name, (least, per_day) in measures.DURATION_ESTIMATES.items()
)
_ESTIMATE_ITEMS = " ".join(
    f"WHEN '{name}' THEN {items}" for name, (_, items) in measures.SIZE_ESTIMATES.items()
)

DEFINITIONS = {
    "normalize_path": (
        "p STRING",
        "STRING",
        r"lower(trim(BOTH '/' FROM replace(coalesce(p, ''), '\\', '/')))",
    ),
    "is_folder_path": (
        "kind STRING, p STRING",
        "BOOLEAN",
        "coalesce(lower(kind) = 'folder', false) OR coalesce(endswith(p, '/'), false)",
    ),
    "manifest_key": (
        "item_id STRING, drive_id STRING, p STRING, size BIGINT, modified TIMESTAMP",
        "STRING",
        "CASE WHEN length(coalesce(item_id, '')) > 0 THEN item_id ELSE concat("
        "coalesce(drive_id, ''), '|', coalesce(p, ''), '|', cast(coalesce(size, 0) AS STRING), '|', "
        "date_format(coalesce(modified, TIMESTAMP '0001-01-01 00:00:00'), "
        "\"yyyy-MM-dd'T'HH:mm:ss'Z'\")) END",
    ),
    "file_extension": ("name STRING", "STRING", r"lower(regexp_extract(name, '(\\.[^./\\\\]+)$', 1))"),
    "sanitize_file_name": (
        "name STRING",
        "STRING",
        r"""regexp_replace(name, '[\\x00-\\x1f"<>|:*?\\\\/]', '_')""",
    ),
    "sha256_hex": ("v STRING", "STRING", "sha2(v, 256)"),
    "delta_scope_id": (
        "delta_type STRING, email STRING",
        "STRING",
        "concat(lower(delta_type), ':', lower(email))",
    ),
    "shard_identifier": (
        "email STRING, s TIMESTAMP, e TIMESTAMP",
        "STRING",
        "concat_ws('_', split(email, '@')[0], date_format(s, 'yyyyMMdd'), date_format(e, 'yyyyMMdd'))",
    ),
    "estimate_message_size": (
        "subject STRING, preview STRING",
        "BIGINT",
        "cast(2 * coalesce(length(subject), 0) + 2 * coalesce(length(preview), 0) + 1024 AS BIGINT)",
    ),
    "estimate_job_bytes": (
        "job_type STRING",
        "BIGINT",
        f"CASE job_type {_ESTIMATE_BYTES} ELSE {measures.DEFAULT_ESTIMATE[0]} END",
    ),
    "estimate_job_items": (
        "job_type STRING",
        "BIGINT",
        f"CASE job_type {_ESTIMATE_ITEMS} ELSE {measures.DEFAULT_ESTIMATE[1]} END",
    ),
    "sanitize_file_name_drop": (
        "name STRING",
        "STRING",
        r"""substring(regexp_replace(name, '[\\x00-\\x1f"<>|:*?\\\\/]', ''), 1, 100)""",
    ),
    "request_priority": (
        "job_type STRING, days BIGINT",
        "STRING",
        "CASE WHEN job_type = 'Email' AND days <= 7 THEN 'High' WHEN job_type = 'Teams' THEN 'High' "
        "WHEN job_type = 'Mixed' THEN 'Medium' ELSE 'Normal' END",
    ),
    "estimate_minutes": (
        "job_type STRING, days BIGINT",
        "DOUBLE",
        f"cast(CASE job_type {_MINUTES} ELSE {measures.DEFAULT_DURATION_MINUTES} END AS DOUBLE)",
    ),
    "items_per_second": (
        "items BIGINT, duration_ms BIGINT",
        "DOUBLE",
        "CASE WHEN duration_ms > 0 THEN cast(items * 1000.0D / duration_ms AS DOUBLE) ELSE 0.0D END",
    ),
    "progress_percentage": (
        "processed BIGINT, estimated BIGINT, previous DOUBLE",
        "DOUBLE",
        "CASE WHEN estimated > 0 THEN least(100.0D, cast(processed AS DOUBLE) / estimated * 100) "
        "ELSE previous END",
    ),
    "is_retryable": (
        "status INT, message STRING",
        "BOOLEAN",
        "coalesce(status = 429 OR status BETWEEN 500 AND 599, false) "
        "OR lower(coalesce(message, '')) RLIKE 'timeout|connection|network'",
    ),
}


def register(spark: SparkSession) -> list[str]:
    """Define every function for this session and return the names."""
    for name, (params, returns, body) in DEFINITIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {returns} RETURN {body}")
    return list(DEFINITIONS)
