"""Record layouts. Timestamps are UTC instants, enums are stored by name."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(*fields: tuple) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


_S, _L, _I, _B, _D, _TS = (
    T.StringType(),
    T.LongType(),
    T.IntegerType(),
    T.BooleanType(),
    T.DoubleType(),
    T.TimestampType(),
)

MANIFEST = _struct(
    ("job_id", _S),
    ("custodian", _S),
    ("drive_id", _S),
    ("item_id", _S),
    ("path", _S),
    ("size", _L),
    ("last_modified", _TS),
    ("sha256", _S),
    ("storage_uri", _S),
    ("collected_utc", _TS),
    ("kind", _S),
)

_IDENTITY = _struct(("id", _S), ("displayName", _S), ("email", _S))
_APPLICATION = _struct(("id", _S), ("displayName", _S))
_ACTOR = _struct(("user", _IDENTITY), ("application", _APPLICATION))

# Names are the exact JSON property names of the dataset.
FILE_RECORD = _struct(
    ("driveId", _S),
    ("id", _S),
    (
        "parentReference",
        _struct(("driveId", _S), ("driveType", _S), ("id", _S), ("path", _S), ("siteId", _S)),
    ),
    ("webUrl", _S),
    ("siteId", _S),
    ("path", _S),
    ("fileName", _S),
    ("name", _S),
    ("lastModifiedDateTime", _TS),
    ("size", _L),
    (
        "file",
        _struct(
            ("mimeType", _S),
            ("hashes", _struct(("quickXorHash", _S), ("sha1Hash", _S), ("sha256Hash", _S))),
        ),
    ),
    ("folder", _struct(("childCount", _I))),
    ("createdDateTime", _TS),
    ("createdBy", _ACTOR),
    ("lastModifiedBy", _ACTOR),
)

MATTER = _struct(
    ("matter_id", _L),
    ("name", _S),
    ("case_number", _S),
    ("description", _S),
    ("created_by", _S),
    ("created_date", _TS),
    ("is_active", _B),
)

COLLECTION_JOB = _struct(
    ("job_id", _L),
    ("matter_id", _L),
    ("custodian", _S),
    ("job_type", _S),
    ("status", _S),
    ("route", _S),
    ("priority", _I),
    ("created_date", _TS),
    ("start_time", _TS),
    ("end_time", _TS),
    ("estimated_bytes", _L),
    ("actual_bytes", _L),
    ("estimated_items", _L),
    ("actual_items", _L),
    ("assigned_worker_id", _S),
    ("lock_expiry", _TS),
    ("manifest_hash", _S),
    ("error_message", _S),
)

COLLECTED_ITEM = _struct(
    ("job_id", _L),
    ("item_id", _S),
    ("item_type", _S),
    ("subject", _S),
    ("sender", _S),
    ("recipients", _S),
    ("item_date", _TS),
    ("collected_date", _TS),
    ("size_bytes", _L),
    ("sha256", _S),
    ("file_path", _S),
    ("is_successful", _B),
    ("error_message", _S),
)

JOB_MANIFEST = _struct(
    ("manifest_id", _S),
    ("job_id", _L),
    ("created_date", _TS),
    ("manifest_hash", _S),
    ("items_hash", _S),
    ("total_items", _L),
    ("total_size_bytes", _L),
    ("is_sealed", _B),
)

MANIFEST_VERIFICATION = _struct(
    ("manifest_id", _S),
    ("verification_date", _TS),
    ("verification_type", _S),
    ("result", _S),
)

SHARD_REQUEST = _struct(
    ("job_id", _L),
    ("custodians", T.ArrayType(_S)),
    ("job_type", _S),
    ("start_date", _TS),
    ("end_date", _TS),
)

CHECKPOINT = _struct(
    ("checkpoint_id", _L),
    ("shard_id", _L),
    ("checkpoint_type", _S),
    ("checkpoint_key", _S),
    ("checkpoint_data", _S),
    ("created_date", _TS),
    ("completed_date", _TS),
    ("is_completed", _B),
    ("items_processed", _L),
    ("bytes_processed", _L),
    ("correlation_id", _S),
)

DELTA_CURSOR = _struct(
    ("scope_id", _S),
    ("delta_type", _S),
    ("custodian", _S),
    ("delta_token", _S),
    ("last_delta_time", _TS),
    ("baseline_completed_at", _TS),
    ("last_delta_item_count", _L),
    ("last_delta_size_bytes", _L),
    ("delta_query_count", _L),
    ("failure_count", _L),
    ("is_active", _B),
    ("created_date", _TS),
    ("updated_date", _TS),
    ("error_message", _S),
    ("job_id", _L),
)

METRIC_POINT = _struct(("metric", _S), ("value", _D), ("ts", _TS))

# One wide nullable record for the five lifecycle event kinds.
LIFECYCLE_EVENT = _struct(
    ("event_type", _S),
    ("ts", _TS),
    ("correlation_id", _S),
    ("job_id", _L),
    ("custodian", _S),
    ("job_type", _S),
    ("route", _S),
    ("status", _S),
    ("priority", _S),
    ("item_id", _S),
    ("size_bytes", _L),
    ("processing_duration_ms", _L),
    ("http_status_code", _I),
    ("backoff_delay_ms", _L),
    ("duration_ms", _L),
    ("collected_items", _L),
    ("collected_size_bytes", _L),
)

JOB_LOG = _struct(
    ("log_id", _L),
    ("job_id", _L),
    ("ts", _TS),
    ("level", _S),
    ("category", _S),
    ("message", _S),
    ("details", _S),
    ("correlation_id", _S),
)

JOB_SHARD = _struct(
    ("job_id", _L),
    ("custodian", _S),
    ("start_date", _TS),
    ("end_date", _TS),
    ("job_type", _S),
    ("status", _S),
    ("route", _S),
    ("shard_index", _L),
    ("total_shards", _L),
    ("shard_identifier", _S),
    ("created_date", _TS),
    ("lock_expiry", _TS),
    ("estimated_bytes", _L),
    ("estimated_items", _L),
    ("processed_bytes", _L),
    ("processed_items", _L),
    ("max_retries", _I),
)

TABLES = {
    "matters": MATTER,
    "jobs": COLLECTION_JOB,
    "items": COLLECTED_ITEM,
    "job_logs": JOB_LOG,
    "shards": JOB_SHARD,
    "manifests": JOB_MANIFEST,
    "verifications": MANIFEST_VERIFICATION,
    "shard_requests": SHARD_REQUEST,
    "checkpoints": CHECKPOINT,
    "cursors": DELTA_CURSOR,
    "metric_points": METRIC_POINT,
    "lifecycle_events": LIFECYCLE_EVENT,
}
