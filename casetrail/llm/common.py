"""Column helpers and lineage cuts shared by the text operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casetrail.workspace import workspace_root

# Words are runs of characters other than ASCII white space; fixed pattern.
WORD = r"[^\x20\x09-\x0D]+"
WORD_BREAK = r"[\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    """The words of a text as an array; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_BREAK), lambda w: w != "")


def word_count(text: Column) -> Column:
    """How many words a text has, without keeping them."""
    parts = F.split(F.coalesce(text, F.lit("")), WORD_BREAK)
    blank_end = (F.size(parts) > 1) & (F.element_at(parts, -1) == "")
    return (F.size(parts) - (F.get(parts, F.lit(0)) == "").cast("int") - blank_end.cast("int")).cast("long")


def cut(frame: DataFrame) -> DataFrame:
    """Materialise in the shared checkpoint folder, so that later jobs read it instead of repeating the work.

    The folder is ``spark.checkpoint.dir``; Spark removes a checkpoint once nothing refers to it
    (``spark.cleaner.referenceTracking.cleanCheckpoints``).
    """
    context = frame.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(workspace_root(frame.sparkSession))
    return frame.checkpoint(eager=True)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of a query when it has ended, not when the driver next collects its garbage.

    For operators of many short jobs, each of which ends in a checkpoint that later ones read.
    """
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
