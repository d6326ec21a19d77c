"""State that batches of a stream hand on: rows that wait for their counterpart, and rows known since earlier batches."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casetrail.workspace import has_names, list_names, remove_folder


@dataclass(frozen=True)
class WaitingRoom:
    """Rows that wait, written whole by each batch.

    A batch reads the newest version below its own number and writes its own, so a replay starts from the same state and
    replaces what it wrote. A version counts once its ``_SUCCESS`` marker exists; versions that no replay can need are removed.
    """

    spark: SparkSession
    folder: str
    schema: str

    def versions(self) -> list[int]:
        names = list_names(self.spark, f"{self.folder}/batch_id=*/_SUCCESS")
        return sorted(int(re.search(r"batch_id=(\d+)/", n).group(1)) for n in names)

    def load(self, before: int | None = None) -> DataFrame:
        known = [v for v in self.versions() if before is None or v < before]
        if not known:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/batch_id={known[-1]}")

    def save(self, rows: DataFrame, batch_id: int) -> None:
        earlier = [v for v in self.versions() if v < batch_id]
        rows.write.mode("overwrite").parquet(f"{self.folder}/batch_id={batch_id}")
        for version in earlier[:-1]:
            remove_folder(self.spark, f"{self.folder}/batch_id={version}")


@dataclass(frozen=True)
class Ledger:
    """Rows that stay known; each batch writes its own new ones."""

    spark: SparkSession
    folder: str
    schema: str

    def load(self, before: int) -> DataFrame:
        """What batches below this number have written."""
        if not has_names(self.spark, f"{self.folder}/batch_id=*/_SUCCESS"):
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(f"{self.schema}, batch_id long").parquet(self.folder)
        return rows.filter(F.col("batch_id") < before).drop("batch_id")

    def save(self, rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.folder}/batch_id={batch_id}")
