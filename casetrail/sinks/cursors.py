"""Versioned cursor table: load, upsert, remove.

The state is a base folder and the folders of changed rows written after it. A folder
counts once its ``_SUCCESS`` marker exists, so a lost executor or a failed write never
leaves a half state, and no path is overwritten while it is read. A change writes only
its own rows; every ``COMPACT_AFTER`` changes the state is written as a new base, and folders
older than the base before it are removed.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casetrail import schemas
from casetrail.operators.ordering import latest_by
from casetrail.workspace import list_names, remove_folder

COMPACT_AFTER = 16
_STORED = T.StructType(
    [*schemas.DELTA_CURSOR.fields, T.StructField("store_version", T.LongType()), T.StructField("removed", T.BooleanType())]
)


@dataclass(frozen=True)
class CursorStore:
    spark: SparkSession
    root: str

    def _folders(self) -> list[tuple[int, str]]:
        """Committed (version, kind): ``v`` holds changed rows, ``b`` a whole state that includes them."""
        markers = list_names(self.spark, f"{self.root}/[bv]*/_SUCCESS")
        found = (re.search(r"/([bv])(\d+)/_SUCCESS$", name) for name in markers)
        return sorted((int(m.group(2)), m.group(1)) for m in found if m)

    def versions(self) -> list[int]:
        """Committed versions, oldest first."""
        return sorted({version for version, _ in self._folders()})

    def _path(self, version: int, kind: str) -> str:
        return f"{self.root}/{kind}{version:08d}"

    def load(self, before: int | None = None) -> DataFrame:
        """The current state, or the last one below version ``before``; empty if there is none."""
        known = [f for f in self._folders() if before is None or f[0] < before]
        base = max((version for version, kind in known if kind == "b"), default=None)
        paths = [self._path(version, kind) for version, kind in known if base is None or version > base]
        if base is not None:
            paths.append(self._path(base, "b"))
        if not paths:
            return self.spark.createDataFrame([], schemas.DELTA_CURSOR)
        rows = latest_by(self.spark.read.schema(_STORED).json(paths), ["scope_id"], [F.col("store_version")])
        return rows.filter("NOT removed").select(*schemas.DELTA_CURSOR.fieldNames())

    def _next(self) -> int:
        return max(self.versions(), default=0) + 1

    def _write(self, rows: DataFrame, version: int, kind: str, removed: bool = False) -> int:
        stored = rows.select(
            *schemas.DELTA_CURSOR.fieldNames(), F.lit(version).cast("long").alias("store_version"), F.lit(removed).alias("removed")
        )
        # A failed attempt may have left an uncommitted folder of the same number.
        stored.write.mode("overwrite").json(self._path(version, kind))
        return version

    def save(self, cursors: DataFrame, version: int | None = None) -> int:
        """Write a whole new state (one row per scope) and return its version."""
        return self._write(cursors, version or self._next(), "b")

    def append(self, changed: DataFrame, version: int | None = None, removed: bool = False) -> int:
        """Write the changed scopes only (one row each) and return the version.

        A stream passes a version derived from its batch id, which makes a replayed
        batch write the same rows again.
        """
        version = self._write(changed, version or self._next(), "v", removed)
        folders = self._folders()
        bases = [v for v, kind in folders if kind == "b"]
        if sum(kind == "v" and v > max(bases, default=0) for v, kind in folders) >= COMPACT_AFTER:
            self._write(self.load(before=version + 1), version, "b")
            for old, kind in folders:
                if bases and old < max(bases):
                    remove_folder(self.spark, self._path(old, kind))
        return version

    def upsert(self, changed: DataFrame) -> int:
        """Replace or add the scopes in ``changed``."""
        return self.append(changed)

    def remove(self, scopes: DataFrame) -> int:
        nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in schemas.DELTA_CURSOR.fields if f.name != "scope_id"]
        return self.append(scopes.select("scope_id", *nothing).distinct(), removed=True)
