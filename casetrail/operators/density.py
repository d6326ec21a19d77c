"""Shards cut where the data lie: daily densities, limits of items and bytes, edges on months or weeks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casetrail.functions import measures, paths


@dataclass(frozen=True)
class DensityOptions:
    max_items: int = 250_000
    max_bytes: int = 50 * measures.GIB
    #: ``month`` or ``week`` moves an edge back to the start of one where the shard holds one.
    align: str | None = None

    def __post_init__(self) -> None:
        if self.align not in (None, "month", "week"):
            raise ValueError("align must be None, 'month' or 'week'")


def daily_density(items: DataFrame, date: str = "item_date", size: str = "size_bytes") -> DataFrame:
    """Items and bytes per custodian and day, the least length of a shard.

    Densities of several inventories can be added: ``merge_density``. Items without a custodian or date have no place in a plan.
    """
    return (
        items.filter(F.col(date).isNotNull() & F.col("custodian").isNotNull())
        .groupBy("custodian", F.to_date(date).alias("day"))
        .agg(F.count(F.lit(1)).alias("items"), F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("bytes"))
    )


def merge_density(*densities: DataFrame) -> DataFrame:
    """The density of several inventories together."""
    first, *others = densities
    for other in others:
        first = first.unionByName(other)
    return first.groupBy("custodian", "day").agg(F.sum("items").alias("items"), F.sum("bytes").alias("bytes"))


def _step(options: DensityOptions):
    """Takes one day into the open shard, or closes the shard first.

    The state is the open shard (start, items, bytes), the last month or week edge inside it, what lies behind that edge, and the
    closed shards. A shard that a day would overfill ends at the edge, if it has one, and what lies behind the edge opens the next one;
    if that is overfilled too, or there is no edge, the cut is at the day itself.
    """

    def fits(items: Column, size: Column, day: Column) -> Column:
        return (items == 0) | ((items + day["items"] <= options.max_items) & (size + day["bytes"] <= options.max_bytes))

    def shard(start: Column, end: Column, items: Column, size: Column) -> Column:
        return F.struct(start.alias("start"), end.alias("end"), items.alias("items"), size.alias("bytes"))

    def step(state: Column, day: Column) -> Column:
        date = day["day"].cast("timestamp")
        period = F.date_trunc(options.align, date) if options.align else F.lit(None).cast("timestamp")
        reached = F.coalesce((period > state["start"]) & (state["edge"].isNull() | (period > state["edge"])), F.lit(False))
        zero = F.lit(0).cast("long")
        edge = F.when(reached, period).otherwise(state["edge"])
        behind, behind_bytes = (F.when(reached, zero).otherwise(state[c]) for c in ("behind", "behind_bytes"))
        whole = fits(state["items"], state["bytes"], day)
        # An edge with nothing before it would close an empty shard.
        snaps = ~whole & edge.isNotNull() & (state["items"] > behind)
        rest = snaps & fits(behind, behind_bytes, day)
        at_edge = shard(state["start"], edge, state["items"] - behind, state["bytes"] - behind_bytes)
        closed = (
            F.when(whole, state["closed"])
            .when(rest, F.concat(state["closed"], F.array(at_edge)))
            .when(snaps, F.concat(state["closed"], F.array(at_edge, shard(edge, date, behind, behind_bytes))))
            .otherwise(F.concat(state["closed"], F.array(shard(state["start"], date, state["items"], state["bytes"]))))
        )

        def total(column: str, left: Column) -> Column:
            return (F.when(whole, state[column]).when(rest, left).otherwise(zero) + day[column]).cast("long")

        def tail(left: Column, column: str) -> Column:
            return F.when(whole & edge.isNotNull(), left + day[column]).otherwise(zero).cast("long")

        return F.struct(
            F.when(whole, state["start"]).when(rest, edge).otherwise(date).alias("start"),
            total("items", behind).alias("items"),
            total("bytes", behind_bytes).alias("bytes"),
            F.when(whole, edge).alias("edge"),
            tail(behind, "items").alias("behind"),
            tail(behind_bytes, "bytes").alias("behind_bytes"),
            closed.alias("closed"),
        )

    return step


_STATE = (
    "struct<start:timestamp,items:bigint,bytes:bigint,edge:timestamp,behind:bigint,behind_bytes:bigint,"
    "closed:array<struct<start:timestamp,end:timestamp,items:bigint,bytes:bigint>>>"
)


def density_shards(requests: DataFrame, density: DataFrame, options: DensityOptions = DensityOptions()) -> DataFrame:
    """Shards per (job, custodian) that cover the whole range of the request, as few as go on from its start.

    A shard holds at most ``max_items`` and ``max_bytes`` by the densities of whole days; one with ``over_limit`` holds the items of one
    day, which is the least that can be cut off. A range without items is one shard. Items are counted by day before anything is
    shuffled, and the days of one job and custodian are folded in one row: a century has 36,500.
    """
    last_day = F.to_date(F.timestamp_micros(F.unix_micros("end_date") - 1))
    spans = (
        requests.filter(F.col("start_date") < F.col("end_date"))
        .withColumn("custodian", F.explode("custodians"))
        .select("job_id", "custodian", "job_type", "start_date", "end_date", F.to_date("start_date").alias("__first"), last_day.alias("__last"))
        .distinct()
    )
    days = density.select(F.col("custodian").alias("__custodian"), "day", "items", "bytes")
    inside = (F.col("custodian") == F.col("__custodian")) & F.col("day").between(F.col("__first"), F.col("__last"))
    listed = F.when(F.col("day").isNotNull(), F.struct("day", "items", "bytes"))
    series = (
        spans.join(days, inside, "left")
        .groupBy("job_id", "custodian", "job_type", "start_date", "end_date")
        .agg(F.sort_array(F.collect_list(listed)).alias("__days"))
    )
    none = F.lit(None)
    zero = F.struct(
        F.col("start_date").alias("start"), F.lit(0).alias("items"), F.lit(0).alias("bytes"), none.alias("edge"),
        F.lit(0).alias("behind"), F.lit(0).alias("behind_bytes"), F.array().alias("closed"),
    ).cast(_STATE)

    def finish(state: Column) -> Column:
        open_shard = F.struct(state["start"].alias("start"), F.col("end_date").alias("end"), state["items"].alias("items"), state["bytes"].alias("bytes"))
        return F.concat(state["closed"], F.array(open_shard))

    step = _step(options)
    cut = series.withColumn("__shards", F.aggregate("__days", zero, lambda state, day: step(state, day).cast(_STATE), finish))
    over = (F.col("__shard.items") > options.max_items) | (F.col("__shard.bytes") > options.max_bytes)
    return (
        cut.select("job_id", "custodian", "job_type", F.size("__shards").cast("long").alias("total_shards"), F.posexplode("__shards").alias("__pos", "__shard"))
        .select(
            "job_id",
            "custodian",
            "job_type",
            F.col("__pos").cast("long").alias("shard_index"),
            "total_shards",
            F.col("__shard.start").alias("start_date"),
            F.col("__shard.end").alias("end_date"),
            F.col("__shard.items").alias("estimated_items"),
            F.col("__shard.bytes").alias("estimated_bytes"),
            over.alias("over_limit"),
        )
        .withColumn("shard_identifier", paths.shard_identifier(F.col("custodian"), F.col("start_date"), F.col("end_date")))
    )
