"""The incremental collection loop on a change feed."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from casetrail.operators.delta import advance_cursors, is_deleted, is_live, query_results
from casetrail.operators.ordering import latest_by
from casetrail.sinks.cursors import CursorStore
from casetrail.sinks.layers import LayeredTable


@dataclass(frozen=True)
class ChangeLog:
    """A snapshot and the changes after it in layers with the same buckets, merged when read.

    A batch shuffles and writes its own changes only; the snapshot is read, and written anew, bucket by bucket.
    """

    spark: SparkSession
    root: str
    schema: str
    buckets: int = 64

    @property
    def table(self) -> LayeredTable:
        return LayeredTable(self.spark, self.root, self.schema, buckets=self.buckets)

    def start(self, base: DataFrame) -> None:
        """Begin with a snapshot: one row per item."""
        self.table.start(base)

    def append(self, batch: DataFrame, batch_id: int) -> DataFrame:
        """Write the latest change of each item of the batch and return what was written.

        Changes of folders are kept beside an item's other changes: they move the token only.
        """
        marked = batch.withColumn("__taken", _taken())
        # A hot item is reduced before the shuffle; the rows that are left are dealt to buckets.
        return self.table.append(latest_by(marked, ["item_id", "__taken"], [F.col("version")]).drop("__taken"), batch_id)

    def snapshot(self) -> DataFrame:
        """Live items. The snapshot takes items to collect and deletions, without folders."""
        return self.table.state(_taken())

    def compact(self, batch_id: int) -> None:
        """Fold the changes up to a batch into a new snapshot."""
        self.table.compact(batch_id, _taken())


def _taken() -> Column:
    return is_live() | is_deleted()


def run_change_feed(
    feed: DataFrame,
    log: ChangeLog,
    cursors: CursorStore,
    checkpoint: str,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Start the loop: change log appended, cursors advanced.

    ``feed`` has ``scope_id``, ``item_id``, ``version``, ``size_bytes``, ``deleted``,
    ``is_folder``, ``is_file``, ``delta_type`` and ``ts``. A change may come at any time
    and more than once: the log keeps every batch, and the snapshot takes an item's
    highest version. Batch and cursor versions derive from the batch id, so a batch that is
    replayed after a failure writes the same state again.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        # The batch itself is evaluated once, by the append.
        written = log.append(batch, batch_id)
        moment = written.agg(F.max("ts")).first()[0]
        before = cursors.load(before=batch_id + 2)
        results = query_results(written)
        touched = before.join(results.select("scope_id"), "scope_id", "left_semi")
        cursors.append(advance_cursors(touched, results, F.lit(moment)), version=batch_id + 2)
        if log.table.due():
            log.compact(batch_id)

    return (
        feed.withColumn("ts", F.col("ts").cast("timestamp"))
        .writeStream.foreachBatch(step)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
