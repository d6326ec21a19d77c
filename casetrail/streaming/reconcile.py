"""Reconcile manifests as they arrive."""

from __future__ import annotations

from dataclasses import replace
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from casetrail.functions.paths import blank
from casetrail.operators.reconcile import ReconcileOptions, duplicate_keys, report, summarize
from casetrail.sinks.files import write_report
from casetrail.sources import landing
from casetrail.sources.json_blocks import read_json_values
from casetrail.sources.lines import placed_lines
from casetrail.sources.manifests import empty_manifest, manifest_from_csv_lines, manifest_from_json_text
from casetrail.streaming.waiting import Ledger, WaitingRoom
from casetrail.workspace import checkpointed, remove_folder

# The columns of Spark's binary file source.
_LISTING = "path string, modificationTime timestamp, length bigint, content binary"
_ARRIVED = "path string, arrived timestamp"
#: Why a job is in the reject table.
REPEATED_KEY = "repeated key"
NO_SOURCE = "no source manifest within the waiting time"
NO_ROWS = "neither manifest has a row in scope"


def _listed(spark: SparkSession, root: str, pattern: str, side: str, max_files: int | None) -> DataFrame:
    reader = spark.readStream.format("binaryFile").schema(_LISTING).option("pathGlobFilter", pattern).option("recursiveFileLookup", True)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(root).select("path", F.col("modificationTime").alias("arrived"), F.lit(side).alias("side"))


def arrivals(spark: SparkSession, collected_root: str, source_root: str, max_files: int = 50) -> DataFrame:
    """Paths of new manifests of both sides; the content column is pruned, so nothing is read."""
    collected = _listed(spark, collected_root, "*_collected.csv", "collected", max_files)
    return collected.unionByName(_listed(spark, source_root, "{*_source,source_*}.{csv,json}", "source", None))


def _same_file(path: Column) -> Column:
    """A path in one spelling; listings and file metadata differ in slashes and escapes."""
    plain = F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(F.coalesce(plain, path), "^([A-Za-z0-9]+):/+", "$1:/")


def _read_side(spark: SparkSession, pairs: DataFrame, paths: list[str], column: str) -> DataFrame:
    """All manifests of one side in one scan per format, joined with their custodian and job by file."""
    kinds = {"csv": [p for p in paths if p.lower().endswith(".csv")], "json": [p for p in paths if p.lower().endswith(".json")]}
    empty, _ = empty_manifest(spark)
    rows = empty
    if kinds["csv"]:
        rows = rows.unionByName(manifest_from_csv_lines(placed_lines(spark, kinds["csv"]))[0])
    if kinds["json"]:
        rows = rows.unionByName(manifest_from_json_text(read_json_values(spark, kinds["json"]))[0])
    named = pairs.select(F.col("custodian").alias("of_custodian"), "job_id", _same_file(F.col(column)).alias("of_file"))
    joined = rows.join(named, _same_file(F.col("source_file")) == F.col("of_file"))
    own = blank(F.col("custodian")) | (F.lower("custodian") == F.lower("of_custodian"))
    return joined.filter(own).drop("of_custodian", "of_file")


def _pairs(waiting: DataFrame, sources: DataFrame) -> DataFrame:
    """Waiting collected manifests with the first source manifest among ``sources``; null where there is none."""
    none = waiting.sparkSession.createDataFrame([], "path string")
    found = landing.pair_manifests(waiting.select("path"), sources, none)
    return found.join(waiting.select(F.col("path").alias("collected_path"), "arrived"), "collected_path")


def _repeated(source: DataFrame, collected: DataFrame, options: ReconcileOptions) -> DataFrame:
    """(``scope_job_id``, ``reason``, ``detail``) of the jobs that cannot be reconciled because a key is repeated."""
    both = duplicate_keys(source, options).withColumn("side", F.lit("source")).unionByName(
        duplicate_keys(collected, options).withColumn("side", F.lit("collected"))
    )
    least = F.min(F.struct("side", "key"))
    return both.groupBy("scope_job_id").agg(
        F.lit(REPEATED_KEY).alias("reason"), F.concat(least["side"], F.lit(": "), least["key"]).alias("detail")
    )


def run_reconciliation(
    spark: SparkSession,
    collected_root: str,
    source_root: str,
    output: str,
    checkpoint: str,
    options: ReconcileOptions = ReconcileOptions(scope=("job_id",)),
    max_files: int = 50,
    max_wait: timedelta | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Reconcile every job once, as soon as both of its manifests have landed, whichever comes first.

    Both folders are streamed as listings. A collected manifest without a source manifest goes to
    a waiting room that each batch reads and writes; new source manifests are matched with what waits there, new collected ones with all
    sources known so far. What waits longer than ``max_wait`` (between its own time and the newest arrival's), a
    job with a repeated key (unless the options let its least row stand for it), and a job without any row go to
    ``rejects``; the others of the batch go on. A job that has been reported or rejected is done. State belongs to ``output``
    and is read below the batch's own number, so a replay gives the same; ``output`` and ``checkpoint`` belong together.

    What reaches the driver is the list of file pairs of one part of a batch, about ``max_files`` short rows, which name the
    files of its two scans. The custodian comes from the file name: rows naming another one are dropped, unnamed rows belong
    to it, so the scope is the job alone.

    Written per batch: ``summary``, ``reports``, ``rejects`` (``scope_job_id``, ``reason``, ``detail``) and the state below ``state``.
    """
    if "job_id" not in options.scope:
        raise ValueError("the scope must have the job")
    lenient = replace(options, on_duplicate="first")
    room = WaitingRoom(spark, f"{output}/state/waiting", _ARRIVED)
    known = Ledger(spark, f"{output}/state/sources", "path string")
    done = Ledger(spark, f"{output}/state/done", "done_job string")
    rejected_columns = ("scope_job_id", "reason", "detail")

    def reconcile_part(pairs: DataFrame, batch_id: int, part: int) -> None:
        found = pairs.filter(F.col("part") == part).select("collected_path", "source_path", "custodian", "job_id").collect()
        named = spark.createDataFrame(found, "collected_path string, source_path string, custodian string, job_id string")
        # Each side is parsed once and then read by the search for repeated keys, the summary and the report.
        source = checkpointed(_read_side(spark, named, sorted({p["source_path"] for p in found}), "source_path"))
        collected = checkpointed(_read_side(spark, named, sorted({p["collected_path"] for p in found}), "collected_path"))
        bad = spark.createDataFrame([], "scope_job_id string, reason string, detail string")
        if options.on_duplicate == "error":
            bad = checkpointed(_repeated(source, collected, lenient))
            sound = lambda side: side.join(
                bad.select(F.col("scope_job_id").alias("bad_job")), F.lower(F.coalesce("job_id", F.lit(""))) == F.col("bad_job"), "left_anti"
            )
            source, collected = sound(source), sound(collected)
        place = f"batch_id={batch_id}/part={part}"
        summarize(source, collected, lenient).write.mode("overwrite").parquet(f"{output}/summary/{place}")
        write_report(report(source, collected, lenient, F.current_timestamp()), f"{output}/reports/{place}", mode="overwrite")
        told = spark.read.parquet(f"{output}/summary/{place}").select("scope_job_id").unionByName(bad.select("scope_job_id"))
        empty = named.select(F.lower("job_id").alias("scope_job_id"), "collected_path").join(told, "scope_job_id", "left_anti")
        empty = empty.groupBy("scope_job_id").agg(F.lit(NO_ROWS).alias("reason"), F.min("collected_path").alias("detail"))
        bad.unionByName(empty).select(*rejected_columns).write.mode("overwrite").parquet(f"{output}/rejects/{place}")

    def step(batch: DataFrame, batch_id: int) -> None:
        for name in ("summary", "reports", "rejects"):
            remove_folder(spark, f"{output}/{name}/batch_id={batch_id}")
        new = checkpointed(batch)
        new_sources = new.filter("side = 'source'").select("path")
        known.save(new_sources, batch_id)
        matched = _pairs(room.load(batch_id), new_sources).unionByName(
            _pairs(new.filter("side = 'collected'").select("path", "arrived"), known.load(batch_id + 1))
        )
        open_ = matched.join(done.load(batch_id), F.lower("job_id") == F.col("done_job"), "left_anti")
        found = open_.filter("source_path IS NOT NULL")
        parts = max(1, -(-found.count() // max_files))
        pairs = checkpointed(found.withColumn("part", F.pmod(F.xxhash64(F.lower("job_id")), F.lit(parts)).cast("int")))
        waiting = open_.filter("source_path IS NULL").select(F.col("collected_path").alias("path"), "job_id", "arrived")
        # A job that is reported now need not wait for another custodian's file of the same job any more.
        waiting = waiting.join(pairs.select(F.lower("job_id").alias("done_job")), F.lower("job_id") == F.col("done_job"), "left_anti")
        late = F.lit(False)
        if max_wait is not None:
            newest = new.agg(F.max("arrived")).first()[0]
            late = F.col("arrived") < F.lit(newest - max_wait) if newest is not None else late
        waiting = checkpointed(waiting.withColumn("late", late))
        for part in sorted(r["part"] for r in pairs.select("part").distinct().collect()):
            reconcile_part(pairs, batch_id, part)
        overdue = waiting.filter("late").groupBy(F.lower("job_id").alias("scope_job_id"))
        overdue = overdue.agg(F.lit(NO_SOURCE).alias("reason"), F.min("path").alias("detail"))
        overdue.select(*rejected_columns).write.mode("overwrite").parquet(f"{output}/rejects/batch_id={batch_id}/part={parts}")
        room.save(waiting.filter("NOT late").select("path", "arrived"), batch_id)
        finished = pairs.select(F.lower("job_id").alias("done_job")).unionByName(overdue.select(F.col("scope_job_id").alias("done_job")))
        done.save(finished.distinct(), batch_id)

    return (
        arrivals(spark, collected_root, source_root, max_files)
        .writeStream.foreachBatch(step)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
