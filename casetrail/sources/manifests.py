"""Manifest files: CSV, JSON array, JSON lines, Parquet.

Readers return ``(rows, rejects)``: rows have the manifest schema without
``job_id`` plus ``source_file``; rejects have ``source_file``, ``raw`` and ``reason``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casetrail import schemas
from casetrail.functions.paths import blank
from casetrail.sources.json_blocks import read_json_values
from casetrail.sources.lines import BYTE_ORDER_MARK, first_lines, placed_lines

# CSV headers accepted for each field; the later column wins.
HEADER_ALIASES = {
    "custodian": ["custodian"],
    "drive_id": ["drive_id", "driveid"],
    "item_id": ["item_id", "itemid", "id"],
    "path": ["file_path", "filepath", "path"],
    "size": ["file_size", "filesize", "size"],
    "last_modified": ["last_modified", "lastmodified", "modified"],
    "sha256": ["sha256", "hash"],
    "storage_uri": ["storage_uri", "storageuri"],
    "collected_utc": ["collected_utc", "collectedutc", "collected"],
    "kind": ["kind"],
}

# JSON property names, matched without case; there are no aliases.
JSON_NAMES = {
    "custodian": "custodian",
    "drive_id": "driveid",
    "item_id": "itemid",
    "path": "path",
    "size": "size",
    "last_modified": "lastmodified",
    "sha256": "sha256",
    "storage_uri": "storageuri",
    "collected_utc": "collectedutc",
    "kind": "kind",
}

FIELDS = [f for f in schemas.MANIFEST.fieldNames() if f != "job_id"]
ROW_SCHEMA = T.StructType(
    [f for f in schemas.MANIFEST.fields if f.name != "job_id"] + [T.StructField("source_file", T.StringType())]
)
REJECT_SCHEMA = "source_file string, raw string, reason string"


def lenient_timestamp(text: Column) -> Column:
    """ISO forms first, then month/day/year; null when nothing fits. Zoneless text is UTC."""
    return F.coalesce(
        text.try_cast("timestamp"),
        F.try_to_timestamp(text, F.lit("M/d/yyyy H:mm:ss")),
        F.try_to_timestamp(text, F.lit("M/d/yyyy H:mm")),
        F.try_to_timestamp(text, F.lit("M/d/yyyy")),
    )


def _source_file() -> Column:
    return F.col("_metadata.file_path").alias("source_file")


def _is_absent(error: Exception) -> bool:
    return "PATH_NOT_FOUND" in str(error)


def empty_manifest(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    return spark.createDataFrame([], ROW_SCHEMA), spark.createDataFrame([], REJECT_SCHEMA)


def cells_of(line: Column) -> Column:
    """Cells of a CSV line: quoted ones without their quotes, doubled quotes as one, others as they stand."""
    found = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(r',("(?:[^"]|"")*"(?=,|$)|[^,]*)'), 1)
    quoted = lambda c: F.startswith(c, F.lit('"')) & F.endswith(c, F.lit('"')) & (F.length(c) > 1)
    return F.transform(
        found, lambda c: F.when(quoted(c), F.replace(F.substr(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(c)
    )


def read_csv_manifest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """CSV with header aliases, for one file or a folder; every file has a header of its own.

    Rows of the wrong width and rows without a path are rejected; a size or date
    that does not parse counts as missing.
    """
    return manifest_from_csv_lines(placed_lines(spark, path))


def manifest_from_csv_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Map each line by the header of its own file (rows of ``placed_lines``)."""
    names = F.transform(
        cells_of(F.ltrim(F.col("first"), F.lit(BYTE_ORDER_MARK))), lambda h: F.lower(F.trim(h, F.lit(' "')))
    )
    headers = first_lines(lines).select("of_file", "first_place", names.alias("__names"))
    rows = (
        lines.join(headers, F.col("source_file") == F.col("of_file"))
        .filter((F.col("place") != F.col("first_place")) & (F.trim("value") != ""))
        .select("value", "source_file", "__names", cells_of(F.col("value")).alias("__cells"))
    )

    def cell(field: str) -> Column:
        at = F.array_max(F.transform(F.array(*[F.lit(a) for a in HEADER_ALIASES[field]]), lambda a: F.array_position("__names", a)))
        return F.when(at > 0, F.trim(F.get("__cells", (at - 1).cast("int")), F.lit(' "')))

    parsed = rows.select(
        "value", "source_file", (F.size("__cells") != F.size("__names")).alias("__bad_width"), *[cell(f).alias(f) for f in FIELDS]
    )
    typed = {
        "size": F.coalesce(F.col("size").try_cast("long"), F.lit(0).cast("long")),
        "last_modified": lenient_timestamp(F.col("last_modified")),
        "collected_utc": lenient_timestamp(F.col("collected_utc")),
        "custodian": F.coalesce("custodian", F.lit("")),
    }
    # An empty cell is a missing value, but for the path, whose absence is a reason of its own.
    present = {f: F.nullif(F.col(f), F.lit("")) if f not in ("custodian", "path") else F.col(f) for f in FIELDS}
    no_path = blank(F.col("path"))
    good = parsed.filter(~F.col("__bad_width") & ~no_path).select(*[typed.get(f, present[f]).alias(f) for f in FIELDS], "source_file")
    rejects = parsed.filter(F.col("__bad_width") | no_path).select(
        "source_file",
        F.col("value").alias("raw"),
        F.when(F.col("__bad_width"), "wrong number of values").otherwise("no path").alias("reason"),
    )
    return good, rejects


def manifest_from_json_text(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parse one JSON object per row (``value``, ``source_file``), names without case."""
    text = F.ltrim(F.col("value"), F.lit("\ufeff"))
    objects = lines.filter(F.length(F.trim(text)) > 0).withColumn("__map", F.from_json(text, "map<string,string>"))
    return manifest_from_maps(objects)


def manifest_from_maps(objects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Manifest rows from ``__map`` (null when unreadable), ``value`` and ``source_file``."""
    pairs = F.transform(
        F.map_entries("__map"), lambda e: F.struct(F.lower(e.getField("key")).alias("key"), e.getField("value"))
    )

    # The last of several names differing only in case wins.
    def cell(field: str) -> Column:
        matching = F.filter("__pairs", lambda e: e.getField("key") == JSON_NAMES[field])
        return F.try_element_at(matching, F.lit(-1)).getField("value")

    parsed = objects.withColumn("__pairs", pairs).select(
        "value", "source_file", F.col("__map").isNull().alias("__bad"), *[cell(f).alias(f) for f in FIELDS]
    )
    size, modified, collected = (
        F.col("size").try_cast("long"),
        F.col("last_modified").try_cast("timestamp"),
        F.col("collected_utc").try_cast("timestamp"),
    )
    bad_type = (
        (F.col("size").isNotNull() & size.isNull())
        | (F.col("last_modified").isNotNull() & modified.isNull())
        | (F.col("collected_utc").isNotNull() & collected.isNull())
    )
    typed = {
        "size": F.coalesce(size, F.lit(0).cast("long")),
        "last_modified": modified,
        "collected_utc": collected,
        "custodian": F.coalesce("custodian", F.lit("")),
        "path": F.coalesce("path", F.lit("")),
    }
    good = parsed.filter(~F.col("__bad") & ~bad_type).select(
        *[typed.get(f, F.col(f)).alias(f) for f in FIELDS], "source_file"
    )
    rejects = parsed.filter(F.col("__bad") | bad_type).select(
        "source_file",
        F.coalesce("value", F.to_json(F.struct(*FIELDS))).alias("raw"),
        F.when(F.col("__bad"), "not a JSON object").otherwise("wrong value type").alias("reason"),
    )
    return good, rejects


def read_json_manifest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Files of JSON lines and of one JSON array, both split between tasks, also mixed in a folder."""
    return manifest_from_json_text(read_json_values(spark, path))


def read_manifest(spark: SparkSession, path: str, fmt: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Read by format or file extension. A missing path is an empty manifest."""
    kind = (fmt or path.rstrip("/").rsplit(".", 1)[-1]).lower()
    try:
        if kind == "csv":
            return read_csv_manifest(spark, path)
        if kind in ("json", "jsonl"):
            return read_json_manifest(spark, path)
        if kind == "parquet":
            rows = spark.read.parquet(path)
            present = set(rows.columns)
            columns = [
                (F.col(f.name) if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name)
                for f in ROW_SCHEMA.fields
                if f.name != "source_file"
            ]
            return rows.select(*columns, _source_file()), empty_manifest(spark)[1]
    except Exception as error:
        if _is_absent(error):
            return empty_manifest(spark)
        raise
    raise ValueError(f"unsupported manifest format: {kind}")
