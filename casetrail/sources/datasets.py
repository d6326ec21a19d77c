"""File-record datasets, landed content, and relational tables."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casetrail import schemas
from casetrail.functions import paths
from casetrail.session import ship
from casetrail.sources.json_blocks import read_json_values
from casetrail.sources.storage import file_system

_CORRUPT = "_corrupt_record"
#: Bytes of a file held at a time while it is hashed.
BLOCK_BYTES = 4 << 20


def with_path_metadata(records: DataFrame, column: str = "source_file") -> DataFrame:
    """``custodian`` and ``matter`` taken from the file path."""
    return records.withColumn("custodian", paths.path_custodian(F.col(column))).withColumn(
        "matter", paths.path_matter(F.col(column))
    )


def read_file_records(spark: SparkSession, path: str | list[str] | DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, rejects) of a dataset of JSON lines and JSON arrays; names are exact.

    Each file's form is found from its own first character, so a folder may mix them. Files may be rows of ``list_json_files``.
    """
    layout = T.StructType([*schemas.FILE_RECORD.fields, T.StructField(_CORRUPT, T.StringType())])
    parsed = read_json_values(spark, path).select(
        "value",
        "source_file",
        F.from_json("value", layout, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}).alias("record"),
    )
    bad = F.col("record").isNull() | F.col(f"record.{_CORRUPT}").isNotNull()
    good = parsed.filter(~bad).select(*[F.col("record")[f.name].alias(f.name) for f in schemas.FILE_RECORD.fields], "source_file")
    rejects = parsed.filter(bad).select("source_file", F.col("value").alias("raw"), F.lit("not a record").alias("reason"))
    return with_path_metadata(good), rejects


def dataset_metadata(records: DataFrame) -> DataFrame:
    """Custodian, matter and record count per dataset file."""
    return records.groupBy("source_file", "custodian", "matter").agg(F.count(F.lit(1)).alias("record_count"))


def read_content(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Path, length and digest of landed binary files of any size.

    Only the listing goes through Spark's reader. The files are spread by name, and each is
    read in blocks of a fixed size where it is hashed, so a task's memory does not depend on a file's length.
    """
    ship(spark)
    listed = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", True)
        .load(path)
        .select("path")
    )

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_digest_of(p) for p in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([n for n, _ in found], pa.int64()), pa.array([d for _, d in found], pa.string())],
                ["source_file", "content_length", "content_sha256"],
            )

    return listed.repartition("path").mapInArrow(digest, "source_file string, content_length long, content_sha256 string")


def _digest_of(path: str) -> tuple[int, str]:
    """Length and SHA-256 of a file, read in blocks from the file system its path names."""
    system, name = file_system(path)
    hasher, length = hashlib.sha256(), 0
    with system.open_input_stream(name) as stream:
        while block := stream.read(BLOCK_BYTES):
            hasher.update(block)
            length += len(block)
    return length, hasher.hexdigest()


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One of the relational tables, as Parquet below ``root``, with its declared schema."""
    return spark.read.schema(schemas.TABLES[name]).parquet(f"{root.rstrip('/')}/{name}")
