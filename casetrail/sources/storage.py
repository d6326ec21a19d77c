"""Files and folders as tasks see them: opened and listed where the work is, through Arrow's file systems."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casetrail.session import ship
from casetrail.workspace import qualified

_LISTED = "path string, is_folder boolean, length long, modificationTime timestamp"
#: Entries of a folder passed on at a time.
BATCH = 10_000


def file_system(path: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system a path with a scheme names, and the path within it."""
    scheme, rest = path.split(":", 1)
    return pa.fs.FileSystem.from_uri(f"{scheme}:{'' if rest.startswith('//') else '//'}{quote(rest, safe='/:@')}")


def list_folders(folders: DataFrame, only_markers: bool = False) -> DataFrame:
    """Entries (``path``, ``is_folder``, ``length``, ``modificationTime``) of the folders of a ``path`` column, one level deep.

    Each folder is listed in a task. Hidden and empty files, which Spark's readers skip, are
    listed too; a folder that does not exist has no entries. ``only_markers`` leaves out all but ``_SUCCESS`` and ``*.complete`` files.
    """
    ship(folders.sparkSession)

    def entries(folder: str) -> Iterator[tuple]:
        system, name = file_system(folder)
        prefix = folder.rstrip("/")
        for found in system.get_file_info(pa.fs.FileSelector(name, allow_not_found=True)):
            own = found.base_name
            if only_markers and (found.type != pa.fs.FileType.File or not (own.lower() == "_success" or own.lower().endswith(".complete"))):
                continue
            is_folder = found.type == pa.fs.FileType.Directory
            yield f"{prefix}/{own}", is_folder, None if is_folder else found.size, found.mtime or dt.datetime.fromtimestamp(0, dt.timezone.utc)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.bool_(), pa.int64(), pa.timestamp("us", "UTC")]
        names = ["path", "is_folder", "length", "modificationTime"]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 4, kinds)], names)

        for batch in batches:
            rows: list[tuple] = []
            for folder in batch.column(0).to_pylist():
                for row in entries(folder):
                    rows.append(row)
                    if len(rows) >= BATCH:
                        yield batch_of(rows)
                        rows = []
            yield batch_of(rows)

    return folders.select("path").mapInArrow(run, _LISTED)


def list_tree(spark: SparkSession, root: str) -> DataFrame:
    """Every entry below ``root``, hidden and empty files included, listed level by level in tasks.

    A level's folders are the rows of the level above; the driver is told how many there are, not what they are
    called. Each level is written to the checkpoint folder, so a lost task lists only its own folders again.
    """
    from casetrail.workspace import checkpointed

    level = spark.createDataFrame([(qualified(spark, root),)], "path string")
    found = spark.createDataFrame([], _LISTED)
    while True:
        entries = checkpointed(list_folders(level))
        found = found.unionByName(entries)
        # By name, so that neighbouring folders, which often grow together, go to different tasks.
        level = entries.filter("is_folder").select("path").repartition("path")
        if entries.filter("is_folder").isEmpty():
            return found
