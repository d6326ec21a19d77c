"""A keyed table of states and changes in layers that share their buckets.

A layer is a folder of rows bucketed by the key. Layer ``2 * n + 1`` has the changes of round ``n``, layer
``2 * n + 2`` the state that includes them, and layer 0 the state to start from. All layers are partitions
of one bucketed table, so a scan brings the rows of a key together from every layer: reading
the state takes no shuffle, writing changes shuffles the changes only, and ``compact`` writes a
bucket from the files of that bucket. A layer counts once its ``_SUCCESS`` exists, and one that is written again
after a failure is replaced.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casetrail.operators.ordering import latest_by
from casetrail.workspace import list_names, remove_folder

#: A state is written anew after this many rounds of changes.
COMPACT_AFTER = 16
_TRACKED = "spark.sql.hive.manageFilesourcePartitions"


@dataclass(frozen=True)
class LayeredTable:
    """Rows with ``key``, ``version`` and ``deleted``; the highest version of a key is its state.

    The number of buckets is fixed for the life of a table: a bucket of all layers is read by one task.
    """

    spark: SparkSession
    root: str
    schema: str
    key: str = "item_id"
    version: str = "version"
    buckets: int = 64

    def layers(self) -> list[int]:
        """Committed layers, in order."""
        found = (re.search(r"/layer=(\d+)/_SUCCESS$", name) for name in list_names(self.spark, f"{self.root}/layer=*/_SUCCESS"))
        return sorted(int(m.group(1)) for m in found if m)

    def _write(self, rows: DataFrame, layer: int) -> None:
        name = f"layer_{uuid.uuid4().hex}"
        writer = rows.select(*self._names()).write.bucketBy(self.buckets, self.key).mode("overwrite").format("parquet")
        # The catalogue is only needed to write in buckets: the folder stays when the entry goes.
        writer.option("path", f"{self.root}/layer={layer}").saveAsTable(name)
        self.spark.sql(f"DROP TABLE {name}")

    def _names(self) -> list[str]:
        return T.StructType.fromDDL(self.schema).fieldNames()

    def _dealt(self, rows: DataFrame) -> DataFrame:
        return rows.repartition(self.buckets, F.col(self.key))

    def start(self, rows: DataFrame) -> None:
        """Write the state to start from: one row per key."""
        self._write(self._dealt(rows), 0)

    def append(self, rows: DataFrame, number: int) -> DataFrame:
        """Write the changes of round ``number``, at most a few per key, and return them as written."""
        self._write(self._dealt(rows), 2 * number + 1)
        return self.rows([2 * number + 1])

    def rows(self, layers: Sequence[int]) -> DataFrame:
        """The rows of some layers, of any number, in buckets."""
        name = f"layers_{uuid.uuid4().hex}"
        fields = T.StructType.fromDDL(f"{self.schema}, layer int")
        listed = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
        tracked = self.spark.conf.get(_TRACKED)
        # Folders are listed when the table is looked up, so that the rows can be read without the entry.
        self.spark.conf.set(_TRACKED, "false")
        try:
            self.spark.sql(
                f"CREATE TABLE {name} ({listed}) USING parquet PARTITIONED BY (layer)"
                f" CLUSTERED BY (`{self.key}`) INTO {self.buckets} BUCKETS LOCATION '{self.root}'"
            )
            found = self.spark.table(name)
            self.spark.sql(f"DROP TABLE {name}")
        finally:
            self.spark.conf.set(_TRACKED, tracked)
        return found.where(F.col("layer").isin([int(layer) for layer in layers])).drop("layer")

    def _live(self, below: int | None = None) -> list[int]:
        """The last state and the changes after it, of the layers below a number if given."""
        known = [layer for layer in self.layers() if below is None or layer < below]
        base = max((layer for layer in known if layer % 2 == 0), default=-1)
        return [layer for layer in known if layer == base or (layer > base and layer % 2)]

    def latest(self, where: str | Column = "true", below: int | None = None) -> DataFrame:
        """The highest version of every key, tombstones included, of the rows that ``where`` admits."""
        return latest_by(self.rows(self._live(below)).where(where), [self.key], [F.col(self.version)])

    def state(self, where: str | Column = "true") -> DataFrame:
        """What is there: the highest version of every key that is not deleted."""
        return self.latest(where).where("NOT coalesce(deleted, false)")

    def compact(self, number: int, where: str | Column = "true") -> None:
        """Write the state that includes round ``number``, tombstones too, so that nothing late brings a deleted key back.

        The state before it stays, since readers may still be at work on it; layers older than that are removed.
        """
        target = 2 * number + 2
        states = [layer for layer in self.layers() if layer % 2 == 0 and layer < target]
        self._write(self.latest(where, target), target)
        for layer in self.layers():
            if states and layer < states[-1]:
                remove_folder(self.spark, f"{self.root}/layer={layer}")

    def due(self) -> bool:
        """Whether enough rounds have come since the last state."""
        return sum(layer % 2 for layer in self._live()) >= COMPACT_AFTER
