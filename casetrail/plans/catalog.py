"""The query catalogue: each operator over the provided tables, with its reference SQL.

``QUERIES`` maps a name to ``(spark, sf_dir) -> DataFrame``; ``ORACLES`` maps it to SQL
for a second engine over the same tables. Timestamps are shown as text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casetrail.plans.reference_sql import with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` may use any view of ``reference_sql``."""

    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return function

    return register


def stamp(column: str | Column) -> Column:
    """A timestamp as text, to the microsecond."""
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def load_all() -> tuple[dict[str, Query], dict[str, str]]:
    """Import every query module and return the catalogue."""
    from casetrail.plans import (  # noqa: F401
        queries_custody,
        queries_delta,
        queries_files,
        queries_ingest,
        queries_metrics,
        queries_reconcile,
        queries_shards,
        queries_streams,
    )

    return QUERIES, ORACLES
