"""Where jobs put intermediate tables, stream checkpoints and versioned state."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Folders of local sessions without the setting, by application; removed when the process ends.
_LOCAL_FOLDERS: dict[str, str] = {}
# Folders handed out to each application, which ``release`` removes.
_HANDED_OUT: dict[str, list[str]] = {}


def workspace_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own; on a
    cluster a machine-local folder would be lost with its executor, so the
    setting is required there.
    """
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if configured:
        return configured.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        app = spark.sparkContext.applicationId
        if app not in _LOCAL_FOLDERS:
            _LOCAL_FOLDERS[app] = tempfile.mkdtemp(prefix="casetrail-")
            atexit.register(shutil.rmtree, _LOCAL_FOLDERS[app], ignore_errors=True)
        return _LOCAL_FOLDERS[app]
    raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh path below the workspace; never reused, so never overwritten."""
    path = f"{workspace_root(spark)}/{label}-{uuid.uuid4().hex}"
    _HANDED_OUT.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def release(spark: SparkSession) -> int:
    """Remove the folders handed out to this application, once nothing reads them any more; how many there were."""
    paths = _HANDED_OUT.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        remove_folder(spark, path)
    return len(paths)


def _statuses(spark: SparkSession, pattern: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.globStatus(path)


def has_names(spark: SparkSession, pattern: str) -> bool:
    """Whether anything matches a Hadoop glob."""
    found = _statuses(spark, pattern)
    return found is not None and len(found) > 0


def list_names(spark: SparkSession, pattern: str) -> list[str]:
    """Paths matching a Hadoop glob, hidden files such as ``_SUCCESS`` included.

    Spark's own listing skips names starting with ``_`` or ``.``; this is used
    for marker files and version folders, of which there is one per run.
    """
    found = _statuses(spark, pattern)
    return sorted(str(status.getPath().toString()) for status in found) if found is not None else []


def qualified(spark: SparkSession, path: str) -> str:
    """A path with its scheme, as Spark's listings give it."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return str(target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(target).toString())


def checkpointed(frame: DataFrame) -> DataFrame:
    """The rows, written to the checkpoint folder once and read from there by whatever follows."""
    context = frame.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(workspace_root(frame.sparkSession))
    return frame.checkpoint(eager=True)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of this library's own state."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def rename_file(spark: SparkSession, path: str, target: str) -> None:
    """Give a file of this library's own another name; its new folder is made if need be."""
    Path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    old, new = Path(path), Path(target)
    fs = old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(new.getParent())
    if not fs.rename(old, new):
        raise OSError(f"cannot rename {path}")
