"""Lines of text files with their place.

The header is a fact of one file. It is found by an aggregate with one short
row per file and joined back, so a folder may mix headers, and nothing is read on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BYTE_ORDER_MARK = "\ufeff"


def placed_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``value``, ``source_file`` and ``place``: (block start, line number in the scan), which orders a file's lines."""
    return (
        spark.read.option("recursiveFileLookup", True)
        .text(path)
        .select(
            "value",
            F.col("_metadata.file_path").alias("source_file"),
            F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")).alias("place"),
        )
    )


def first_lines(lines: DataFrame) -> DataFrame:
    """(``of_file``, ``first``, ``first_place``): the first line of each file that is not blank."""
    seen = lines.filter(F.trim(F.ltrim(F.col("value"), F.lit(BYTE_ORDER_MARK))) != "")
    return seen.groupBy(F.col("source_file").alias("of_file")).agg(
        F.min_by("value", "place").alias("first"), F.min("place").alias("first_place")
    )
