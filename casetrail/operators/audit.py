"""Operators over parsed compliance-log lines and correlated events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casetrail.operators.ordering import HOT_ROWS, number_rows

# Log categories by destination.
COLLECTION_CATEGORIES = ("DATA_COLLECTION", "PERFORMANCE", "GRAPH_API")
AUDIT_CATEGORIES = ("AUDIT", "CHAIN_OF_CUSTODY", "SECURITY")


def route_log(lines: DataFrame) -> DataFrame:
    """``destination`` of each line: collection, audit, or general."""
    return lines.withColumn(
        "destination",
        F.when(F.col("category").isin(*COLLECTION_CATEGORIES), "collection")
        .when(F.col("category").isin(*AUDIT_CATEGORIES), "audit")
        .otherwise("general"),
    )


def correlation_chain(events: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Events of each correlation id, numbered in time order, as flat rows.

    A chain has no bound on its length, so it is never gathered into one value.
    """
    tie = F.md5(F.concat_ws("|", "event_type", "event_id"))
    return number_rows(
        events.select("correlation_id", "event_type", "event_id", "ts"),
        ["correlation_id"],
        [F.col("ts"), tie, F.col("event_id")],
        coarse=F.date_trunc("minute", "ts"),
        fine=[F.col("ts"), F.substring(tie, 1, 3)],
        name="position",
        hot_rows=hot_rows,
    )


def correlation_summary(events: DataFrame) -> DataFrame:
    """Number of events, total duration, first and last event per correlation id."""
    order = F.struct("ts", "event_id")
    return events.groupBy("correlation_id").agg(
        F.count(F.lit(1)).alias("event_count"),
        ((F.max(F.unix_micros("ts")) - F.min(F.unix_micros("ts"))) / 1000.0).alias("total_duration_ms"),
        F.min_by("event_type", order).alias("first_event"),
        F.max_by("event_type", order).alias("last_event"),
    )
