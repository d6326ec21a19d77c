"""Compliance log files as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Line prefix and categories of the log format.
LINE = r"^\[(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d{3}) ([+-]\d{2}:\d{2})(?: [A-Z]{3})?\] (.*)$"
CATEGORIES = (
    "AUDIT",
    "SECURITY",
    "CHAIN_OF_CUSTODY",
    "PERFORMANCE",
    "DATA_COLLECTION",
    "ERROR",
    "GRAPH_API",
)
_CATEGORY = rf"^({'|'.join(CATEGORIES)}): ([^|]*?)(?: \| |$)"


# Labels of the fields, by the column they fill. A field ends at " | " or the line's end.
_TEXT_FIELDS = {
    "correlation_id": "CorrelationId",
    "item_id": "ItemId",
    "hash": "Hash",
    "user_context": "User",
    "exception_type": "Exception",
    "job_type": "Type",
    "route": "Route",
    "quota": "Quota",
}
_MEBIBYTE = 1 << 20


def _field(label: str, pattern: str = r"[^|]*?") -> Column:
    text = F.regexp_extract("message", rf"\| {label}: ({pattern})(?: \||\s*$)", 1)
    return F.when(text != "", text)


def _number(label: str, unit: str = "") -> Column:
    return _field(label, r"\d+" + unit)


def _size_bytes() -> Column:
    """A size in bytes, or in megabytes with two decimals, which are rounded to bytes."""
    size = _field("Size", r"\d+ bytes|[\d,]*\d\.?\d* MB")
    amount = F.replace(F.substring_index(size, " ", 1), F.lit(","))
    return F.when(F.endswith(size, F.lit(" MB")), F.round(amount.cast("double") * _MEBIBYTE).cast("long")).otherwise(amount.cast("long"))


def parse_log(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(structured lines, unmatched lines) from rows with ``value`` and ``source_file``.

    Continuation lines and lines without a timestamp prefix are unmatched, so they
    can be counted. Works on a batch or a stream.
    """
    stamp = F.regexp_extract("value", LINE, 1)
    matched = lines.filter(F.col("value").rlike(LINE)).select(
        "source_file",
        F.concat(stamp, F.regexp_extract("value", LINE, 2)).cast("timestamp").alias("ts"),
        F.regexp_extract("value", LINE, 3).alias("message"),
    )
    category = F.regexp_extract("message", _CATEGORY, 1)
    data = F.regexp_extract("message", r"\| Data: (\{.*\})\s*$", 1)
    of = F.when(category != "", category)
    first = F.when(category != "", F.regexp_extract("message", _CATEGORY, 2))
    # A collection line starts with its custodian, the other kinds with what was done.
    named = F.when(of == "DATA_COLLECTION", F.lit("DataCollected")).otherwise(first)
    custodian = F.when(of == "DATA_COLLECTION", first).otherwise(_field("Custodian"))
    rows = matched.select(
        "source_file",
        "ts",
        of.alias("category"),
        named.alias("name"),
        F.nullif(custodian, F.lit("null")).alias("custodian"),
        *[_field(label).alias(column) for column, label in _TEXT_FIELDS.items() if column != "quota"],
        F.nullif(_field("Quota"), F.lit("N/A")).alias("quota"),
        F.regexp_extract(F.coalesce(_field("Duration"), F.lit("")), r"^(\d+)ms$", 1).try_cast("long").alias("duration_ms"),
        _number("Items").cast("long").alias("item_count"),
        _size_bytes().alias("size_bytes"),
        _number("Status").cast("int").alias("status_code"),
        F.when(of == "GRAPH_API", F.substring_index(first, " ", 1)).alias("method"),
        F.when(of == "GRAPH_API", F.regexp_extract(first, r"^\S+ (.*)$", 1)).alias("endpoint"),
        F.when(data != "", data).alias("data"),
        "message",
    )
    unmatched = lines.filter(~F.col("value").rlike(LINE))
    return rows, unmatched


def read_log(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return parse_log(spark.read.text(path).select("value", F.col("_metadata.file_path").alias("source_file")))


def data_field(path: str) -> Column:
    """A field of the JSON payload, such as ``$.Data.JobId``."""
    return F.get_json_object("data", path)
