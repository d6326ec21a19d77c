"""Landing-zone discovery and pairing of manifest files, as joins over listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casetrail.sources.storage import list_folders, list_tree
from casetrail.workspace import qualified

# Names of source manifests, tried in this order.
SOURCE_PATTERNS = [
    "{custodian}_{job}_source.csv",
    "{custodian}_{job}_source.json",
    "{custodian}_source.csv",
    "{custodian}_source.json",
    "source_{job}.csv",
    "source_{job}.json",
]


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]+)$", 1)


def folder_of(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]+$", 1)


def list_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """Path, length and time of the files below ``root``; contents are not read."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", True)
        .load(root)
        .select("path", "length", "modificationTime")
    )


def marker_files(spark: SparkSession, root: str) -> DataFrame:
    """``_SUCCESS`` and ``*.complete`` markers anywhere below ``root``.

    Spark's readers leave out hidden and empty files, so the folders are listed in tasks, see ``list_tree``.
    """
    name = F.lower(file_name(F.col("path")))
    return list_tree(spark, root).filter(~F.col("is_folder") & ((name == "_success") | F.endswith(name, F.lit(".complete")))).select("path")


def ancestors_of(files: DataFrame) -> DataFrame:
    """The rows with ``folder``: one row for each folder above the file."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return files.withColumn("folder", F.explode(above))


def released_files(files: DataFrame, root: str) -> DataFrame:
    """The dataset files of a ``path`` column that a marker releases now.

    Only the folders above these files and not above ``root`` are looked into, each once and in a task.
    """
    top = qualified(files.sparkSession, root).rstrip("/")
    above = ancestors_of(files.select("path")).filter((F.col("folder") == top) | F.startswith("folder", F.lit(f"{top}/")))
    marked = list_folders(above.select(F.col("folder").alias("path")).distinct(), only_markers=True)
    by_folder = above.join(marked.select(folder_of(F.col("path")).alias("folder")).distinct(), "folder", "left_semi").select("path")
    by_itself = files.select("path").filter(is_marker(F.col("path")) & F.endswith(F.lower("path"), F.lit(".json")))
    return by_folder.unionByName(by_itself).distinct()


def is_marker(path: Column) -> Column:
    """``_SUCCESS``, ``*.complete``, or a JSON file named for files or a dataset."""
    name = file_name(path)
    lowered = F.lower(name)
    dataset = F.endswith(lowered, F.lit(".json")) & (
        F.contains(name, F.lit("files")) | F.contains(name, F.lit("dataset"))
    )
    return (lowered == "_success") | F.endswith(lowered, F.lit(".complete")) | dataset


def discover_datasets(files: DataFrame, markers: DataFrame) -> DataFrame:
    """Dataset files released by a marker, once each.

    A JSON marker releases itself; any other releases all JSON files in its folder
    and below. Each file's ancestor folders are exploded, so the match is an equi-join.
    """
    json_files = files.filter(F.endswith(F.lower("path"), F.lit(".json"))).select("path")
    by_itself = json_files.filter(is_marker(F.col("path")))
    folders = (
        files.select("path")
        .unionByName(markers.select("path"))
        .filter(is_marker(F.col("path")) & ~F.endswith(F.lower("path"), F.lit(".json")))
        .select(folder_of(F.col("path")).alias("folder"))
        .distinct()
    )
    ancestors = ancestors_of(json_files)
    released = ancestors.join(folders, "folder", "left_semi").select("path")
    return by_itself.unionByName(released).distinct()


def parse_collected_name(files: DataFrame) -> DataFrame:
    """``custodian`` and ``job_id`` of ``<custodian>_<job>_collected.csv`` files."""
    pattern = r"^(.+)_([^_]*)_collected\.csv$"
    name = file_name(F.col("path"))
    return files.filter(name.rlike(pattern)).select(
        F.col("path").alias("collected_path"),
        F.regexp_extract(name, pattern, 1).alias("custodian"),
        F.regexp_extract(name, pattern, 2).alias("job_id"),
    )


def pair_manifests(collected: DataFrame, sources: DataFrame, reports: DataFrame) -> DataFrame:
    """Each unreported collected manifest with its first existing source manifest.

    All three are listings with a ``path`` column. Unpaired ones keep a null source.
    """
    wanted = parse_collected_name(collected)
    done = reports.select(
        F.regexp_extract(file_name(F.col("path")), r"^recon_report_(.*)\.csv$", 1).alias("job_id")
    ).distinct()
    open_ = wanted.join(done, "job_id", "left_anti")
    candidates = F.array(
        *[
            F.struct(
                F.lit(i).alias("priority"),
                F.replace(
                    F.replace(F.lit(p), F.lit("{custodian}"), F.col("custodian")), F.lit("{job}"), F.col("job_id")
                ).alias("name"),
            )
            for i, p in enumerate(SOURCE_PATTERNS)
        ]
    )
    tried = open_.withColumn("c", F.explode(candidates)).select(
        "collected_path", "custodian", "job_id", "c.priority", "c.name"
    )
    existing = sources.select(F.col("path").alias("source_path"), file_name(F.col("path")).alias("name"))
    return (
        tried.join(existing, "name", "left")
        .groupBy("collected_path", "custodian", "job_id")
        .agg(F.min_by("source_path", F.when(F.col("source_path").isNotNull(), F.col("priority"))).alias("source_path"))
    )
