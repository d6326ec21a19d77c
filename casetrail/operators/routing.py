"""Which route a collection request takes, and how large it may be."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casetrail.functions import measures

# Routes and wording of decisions.
DIRECT_ROUTE = "GraphApi"
BULK_ROUTE = "GraphDataConnect"
FITS = "Collection fits within Graph API limits"
WOULD_EXCEED = "Collection would exceed Graph API limits"
EXCEEDED = "Current quota usage exceeds Graph API thresholds"


@dataclass(frozen=True)
class RouteOptions:
    max_bytes: int = 100 * measures.GIB
    max_items: int = 500_000
    high_confidence: float = 0.9
    medium_confidence: float = 0.8


def with_estimates(requests: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """``estimated_bytes`` and ``estimated_items`` by job type, or from history where there is any."""
    if history is None:
        return requests.withColumn("estimated_bytes", measures.estimated_bytes(F.col("job_type"))).withColumn(
            "estimated_items", measures.estimated_items(F.col("job_type"))
        )
    past = history.select("custodian", "job_type", "typical_bytes", "typical_items")
    return (
        requests.join(past, ["custodian", "job_type"], "left")
        .withColumn("estimated_bytes", F.coalesce("typical_bytes", measures.estimated_bytes(F.col("job_type"))))
        .withColumn("estimated_items", F.coalesce("typical_items", measures.estimated_items(F.col("job_type"))))
        .drop("typical_bytes", "typical_items")
    )


def size_history(jobs: DataFrame) -> DataFrame:
    """Median bytes and mean items of completed jobs per (custodian, type)."""
    return (
        jobs.filter(F.col("status") == "Completed")
        .groupBy("custodian", "job_type")
        .agg(
            F.percentile_approx("actual_bytes", 0.5).alias("typical_bytes"),
            F.round(F.avg("actual_items")).cast("long").alias("typical_items"),
        )
    )


def decide_route(
    requests: DataFrame, used_bytes: Column, used_items: Column, options: RouteOptions = RouteOptions()
) -> DataFrame:
    """Route, reason and confidence. Usage is a literal or a column of the request.

    Both limits are strict: usage plus estimate equal to a limit no longer fits.
    """
    room = (used_bytes < options.max_bytes) & (used_items < options.max_items)
    fits = (F.col("estimated_bytes") + used_bytes < options.max_bytes) & (
        F.col("estimated_items") + used_items < options.max_items
    )
    return (
        requests.withColumn("route", F.when(room & fits, DIRECT_ROUTE).otherwise(BULK_ROUTE))
        .withColumn("reason", F.when(~room, EXCEEDED).when(fits, FITS).otherwise(WOULD_EXCEED))
        .withColumn(
            "confidence",
            F.when(room & ~fits, options.medium_confidence).otherwise(options.high_confidence),
        )
    )
