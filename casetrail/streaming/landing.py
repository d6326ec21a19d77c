"""Landing-zone ingest: dataset files as their markers release them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from casetrail.operators import ingest
from casetrail.sources.datasets import read_file_records
from casetrail.sources.json_blocks import list_json_files
from casetrail.sources.landing import released_files
from casetrail.streaming.waiting import WaitingRoom
from casetrail.workspace import checkpointed, remove_folder

# The columns of Spark's binary file source.
_LISTING = "path string, modificationTime timestamp, length bigint, content binary"
#: Numbers a batch of the stream is apart from the next, for the looks taken at starts in between.
LOOKS = 1_000_000


def landed_files(spark: SparkSession, root: str, heartbeat: str | None = None) -> DataFrame:
    """Paths of new dataset files and ``*.complete`` markers; contents are not read.

    A ``_SUCCESS`` marker is hidden from Spark's readers and starts no batch by itself. ``heartbeat``, an interval, adds a row without
    a path every so often, so that a running stream looks for markers although no file comes.
    """
    listed = (
        spark.readStream.format("binaryFile")
        .schema(_LISTING)
        .option("pathGlobFilter", "*.{json,JSON,complete}")
        .option("recursiveFileLookup", True)
        .load(root)
        .select("path")
    )
    if heartbeat is None:
        return listed
    rate = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).option("advanceMillisPerBatch", 1000).load()
    return listed.unionByName(rate.select(F.lit(None).cast("string").alias("path")))


class MarkerGate:
    """Dataset files that wait until a marker stands in one of the folders above them.

    Every look at the waiting files is a version. A look is finished once its files have been worked on; what an unfinished one left is
    removed at the next start, and its files are still with the version before.
    """

    def __init__(self, spark: SparkSession, root: str, state: str):
        self.spark, self.root = spark, root
        self.room = WaitingRoom(spark, f"{state}/waiting", "path string")
        self.finished = WaitingRoom(spark, f"{state}/finished", "files long")

    def last(self) -> int:
        """The last finished version; 0 before the first."""
        return max(self.finished.versions(), default=0)

    def forget_unfinished(self) -> list[int]:
        """Remove what unfinished versions have written; their numbers."""
        left = [v for v in self.room.versions() if v > self.last()]
        for version in left:
            remove_folder(self.spark, f"{self.room.folder}/batch_id={version}")
        return left

    def look(self, arrived: DataFrame, version: int) -> DataFrame:
        """The files that are released now, of those that arrived and those that waited; the others wait on.

        Only folders above waiting files are looked into, each in a task.
        """
        new = arrived.filter(F.endswith(F.lower("path"), F.lit(".json"))).select("path")
        waiting = checkpointed(self.room.load(version).unionByName(new).distinct())
        free = checkpointed(released_files(waiting, self.root))
        self.room.save(waiting.join(free, "path", "left_anti"), version)
        return free

    def finish(self, free: DataFrame, version: int) -> None:
        self.finished.save(free.agg(F.count(F.lit(1)).alias("files")), version)


def run_ingest(
    spark: SparkSession,
    root: str,
    content: DataFrame,
    output: str,
    checkpoint: str,
    base: str = "/evidence",
    max_errors: int = 10,
    max_files: int = 1000,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Filter, triage, index, fetch and summarise every dataset file once a marker has released it.

    A dataset file waits until ``_SUCCESS`` or a ``*.complete`` file stands in its folder or one above it up to ``root``; a JSON file named
    for files or a dataset releases itself. Files and markers may come in any order. Lines and arrays, also over
    several lines, are read as the batch reader does; what is no record goes to ``rejects``. A file is worked on
    whole in one batch, so its index and cut-off are complete there. With an interval trigger a heartbeat makes a running stream look for
    markers; with ``availableNow`` each start looks once more at what waits.

    All files that a look releases are rows of one pass, which reads ``content`` as often for many files as for one; the driver gets none of
    their names. ``max_files`` of them are a task's share. Results, summaries and rejects go to folders of the look, which a replay writes anew;
    ``output`` and ``checkpoint`` belong together.
    """
    trigger = trigger or {"availableNow": True}
    gate = MarkerGate(spark, root, f"{output}/state")

    def ingest_files(released: DataFrame, place: str) -> None:
        listed = list_json_files(spark, root, "*.{json,JSON}").join(released, "path", "left_semi")
        count = released.count()
        # Written once: what is found when is settled here, and a file that has gone since is not passed over.
        named = checkpointed(listed.repartition(max(1, -(-count // max_files)), "path"))
        if named.count() != count:
            raise FileNotFoundError(f"released files have gone from {root}")
        records, rejects = read_file_records(spark, named)
        kept = ingest.triage(ingest.filter_records(records))
        tie = F.md5(F.concat_ws("|", "id", "path", "name"))
        indexed = ingest.index_records(
            kept, "source_file", [tie, F.col("id"), F.col("path")], coarse=F.substring(tie, 1, 2), fine=[F.substring(tie, 1, 4)]
        )
        results = ingest.cut_off(ingest.fetch(indexed, content, base), "source_file", max_errors)
        results.write.mode("overwrite").parquet(f"{output}/results/{place}")
        rejects.write.mode("overwrite").parquet(f"{output}/rejects/{place}")
        written = spark.read.parquet(f"{output}/results/{place}")
        ingest.fetch_summary(written, "source_file", max_errors).write.mode("overwrite").parquet(f"{output}/summary/{place}")

    def take(arrived: DataFrame, version: int) -> None:
        released = gate.look(arrived, version)
        for name in ("results", "rejects", "summary"):
            remove_folder(spark, f"{output}/{name}/batch_id={version}")
        if not released.isEmpty():
            ingest_files(released, f"batch_id={version}/part=0")
        gate.finish(released, version)

    def step(batch: DataFrame, batch_id: int) -> None:
        version = (batch_id + 1) * LOOKS
        # A batch that was finished but not yet recorded by the stream comes again.
        if version > gate.last():
            take(batch.filter("path IS NOT NULL"), version)

    for version in gate.forget_unfinished():
        for name in ("results", "rejects", "summary"):
            remove_folder(spark, f"{output}/{name}/batch_id={version}")
    if gate.last():
        # For markers that came alone since the last run.
        take(spark.createDataFrame([], "path string"), gate.last() + 1)
    heartbeat = trigger.get("processingTime")
    return (
        landed_files(spark, root, heartbeat)
        .writeStream.foreachBatch(step)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )
