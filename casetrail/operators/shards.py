"""Date-window shards: planning, item assignment, progress, checkpoints."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casetrail.functions import measures, paths
from casetrail.operators.intervals import join_points
from casetrail.operators.ordering import HOT_ROWS, latest_by, previous_row
from casetrail.operators.routing import RouteOptions, decide_route

DAY_MICROS = 86_400_000_000


@dataclass(frozen=True)
class ShardOptions:
    window_days: int = 30
    max_shards_per_custodian: int = 12
    minimum_days: int = 1
    max_shard_bytes: int = 50 * measures.GIB
    max_shard_items: int = 250_000


def shard_windows(requests: DataFrame, options: ShardOptions = ShardOptions()) -> DataFrame:
    """Windows per (job, custodian) and, where they stop short, one ``gap`` row.

    A narrow generator: the number of windows and the end of cover are arithmetic on
    the request, so indices, totals and gaps need no window function and windows are not
    shuffled: requests are, by custodian.
    """
    start, end = F.unix_micros("start_date"), F.unix_micros("end_date")
    width = options.window_days * DAY_MICROS
    minimum = options.minimum_days * DAY_MICROS
    span = end - start
    whole = F.floor(span / F.lit(width))
    rest = span - whole * width
    # A window is kept when it is as long as the minimum; only the last can be shorter than the rest.
    full = F.when(F.lit(width >= minimum), whole).otherwise(F.lit(0))
    tail = F.when((rest > 0) & (rest >= minimum) & (F.lit(width >= minimum) | (whole == 0)), 1).otherwise(0)
    n_shards = F.least(full + tail, F.lit(options.max_shards_per_custodian)).cast("long")

    planned = (
        requests.filter(F.col("start_date") < F.col("end_date"))
        .withColumn("custodian", F.explode("custodians"))
        # Dealt while there is one row a request, so that what follows a custodian need not move its windows. The number is given
        # because adaptive execution would judge these rows by their own size and put all windows into a few tasks.
        .repartition(int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions")), "custodian")
        .withColumn("__start", start)
        .withColumn("__end", end)
        .withColumn("total_shards", n_shards)
        .withColumn("__covered", F.least(F.col("__end"), F.col("__start") + F.col("total_shards") * width))
        .withColumn("__rows", F.col("total_shards") + F.when(F.col("__covered") < F.col("__end"), 1).otherwise(0))
        .withColumn("__pos", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__rows") - 1)))
    )
    is_gap = F.col("__pos") == F.col("total_shards")
    from_micros = F.when(is_gap, F.col("__covered")).otherwise(F.col("__start") + F.col("__pos") * width)
    to_micros = F.when(is_gap, F.col("__end")).otherwise(
        F.least(F.col("__end"), F.col("__start") + (F.col("__pos") + 1) * width)
    )
    return planned.select(
        "job_id",
        "custodian",
        "job_type",
        F.when(is_gap, "gap").otherwise("shard").alias("kind"),
        F.when(~is_gap, F.col("__pos")).alias("shard_index"),
        "total_shards",
        F.timestamp_micros(from_micros).alias("start_date"),
        F.timestamp_micros(to_micros).alias("end_date"),
    ).withColumn(
        "shard_identifier",
        F.when(
            F.col("kind") == "shard",
            paths.shard_identifier(F.col("custodian"), F.col("start_date"), F.col("end_date")),
        ),
    )


def plan_shards(
    requests: DataFrame,
    created_date: Column,
    options: ShardOptions = ShardOptions(),
    used_bytes: Column | None = None,
    used_items: Column | None = None,
    limits: RouteOptions = RouteOptions(),
) -> DataFrame:
    """Shard rows ready to be worked on: size estimates by job type and the route decided for each.

    Usage so far is a literal or a column of the request; nothing is used by default.
    """
    nothing = F.lit(0).cast("long")
    planned = (
        shard_windows(requests, options)
        .filter("kind = 'shard'")
        .withColumn("status", F.lit("Pending"))
        .withColumn("estimated_bytes", measures.estimated_bytes(F.col("job_type")))
        .withColumn("estimated_items", measures.estimated_items(F.col("job_type")))
        .withColumn("created_date", created_date)
        .withColumn("max_retries", F.lit(3))
    )
    routed = decide_route(planned, nothing if used_bytes is None else used_bytes, nothing if used_items is None else used_items, limits)
    return routed.withColumnsRenamed({"reason": "route_reason", "confidence": "route_confidence"})


def split_by_size(shards: DataFrame, options: ShardOptions = ShardOptions()) -> DataFrame:
    """Shards of which an estimate exceeds a limit, cut into equal parts of their date range.

    An option of its own: the plan of windows alone does not do it. ``part`` numbers the
    ``parts`` of a shard from 0; estimates are shared out, remainders going to the first parts. Parts are
    not shorter than the least number of days.
    """
    days = F.greatest(F.floor(measures.duration_seconds(F.col("start_date"), F.col("end_date")) / 86400 / options.minimum_days), F.lit(1))
    wanted = F.greatest(
        F.ceil(F.col("estimated_bytes") / options.max_shard_bytes), F.ceil(F.col("estimated_items") / options.max_shard_items), F.lit(1)
    )
    span = F.unix_micros("end_date") - F.unix_micros("start_date")
    cut = shards.withColumn("parts", F.least(wanted, days).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))

    def edge(n: Column) -> Column:
        return F.timestamp_micros(F.unix_micros("start_date") + F.floor(span * n / F.col("parts")).cast("long"))

    def share(name: str) -> Column:
        total = F.col(name)
        return (F.floor(total / F.col("parts")) + (F.col("part") < total % F.col("parts")).cast("int")).cast("long")

    return cut.withColumns(
        {
            "start_date": edge(F.col("part")),
            "end_date": edge(F.col("part") + 1),
            "estimated_bytes": share("estimated_bytes"),
            "estimated_items": share("estimated_items"),
        }
    )


def sharded_job_metrics(
    requests: DataFrame, windows: DataFrame, options: ShardOptions = ShardOptions()
) -> DataFrame:
    """Per job: shards, custodians, average, date range and the configured limits."""
    counts = windows.filter("kind = 'shard'").groupBy("job_id").agg(F.count(F.lit(1)).alias("total_shards"))
    facts = requests.select(
        "job_id",
        F.size("custodians").cast("long").alias("custodian_count"),
        measures.duration_seconds(F.col("start_date"), F.col("end_date")).alias("__seconds"),
    )
    return facts.join(counts, "job_id", "left").select(
        "job_id",
        F.coalesce("total_shards", F.lit(0)).alias("total_shards"),
        "custodian_count",
        measures.ratio(F.coalesce("total_shards", F.lit(0)), F.col("custodian_count")).alias(
            "average_shards_per_custodian"
        ),
        (F.col("__seconds") / 86400).alias("date_range_days"),
        (F.coalesce("total_shards", F.lit(0)) * 2).alias("estimated_hours"),
        F.lit(options.max_shard_bytes / measures.GIB).alias("max_shard_gb"),
        F.lit(options.max_shard_items).cast("long").alias("max_items_per_shard"),
        F.lit(f"Date windows of {options.window_days} days per custodian").alias("sharding_strategy"),
    )


def assign_items(items: DataFrame, windows: DataFrame, date: str = "item_date", boundary: str = "half_open") -> DataFrame:
    """Items with the shard whose window holds their date.

    Windows may be of any lengths, days beside decades (see ``join_points``). Items outside every window keep a null shard.
    ``half_open`` gives each item one shard per job, the last one closed at its end; ``inclusive`` also repeats
    an item that lies exactly on a shared edge.
    """
    if boundary not in ("half_open", "inclusive"):
        raise ValueError("boundary must be 'half_open' or 'inclusive'")
    closed = F.lit(True) if boundary == "inclusive" else F.col("shard_index") == F.col("total_shards") - 1
    first, last = F.unix_micros("start_date"), F.unix_micros("end_date") - F.when(closed, 0).otherwise(1)
    plan = windows.filter("kind = 'shard'").select(
        F.col("job_id").alias("shard_job_id"), "custodian", "shard_index", first.alias("__from"), last.alias("__to")
    )
    at = F.unix_micros(F.col(date).cast("timestamp"))
    return join_points(items, at, plan, F.col("__from"), F.col("__to"), "custodian").drop("__from", "__to")


def shard_activity(assigned: DataFrame, size: str) -> DataFrame:
    """Items and bytes per (job, custodian, shard)."""
    return (
        assigned.filter(F.col("shard_index").isNotNull())
        .groupBy(F.col("shard_job_id").alias("job_id"), "custodian", "shard_index")
        .agg(F.count(F.lit(1)).alias("processed_items"), F.sum(size).alias("processed_bytes"))
    )


_PROCESSING = ("Processing", "Running")
_WAITING = ("Pending", "Assigned")


def job_progress(shards: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Roll-up of shard states per job, with the time left at the rate so far.

    With ``as_of`` and a ``created_date`` of the shards, ``remaining_seconds`` is the time since the first
    was created times what is left over what is done, and ``estimated_completion`` is that much after ``as_of``; both
    are null while nothing is done.
    """
    status = F.col("status")
    started = [] if as_of is None else [F.min("created_date").alias("__started")]
    rolled = shards.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("total_shards"),
        F.count_if(status == "Completed").alias("completed_shards"),
        F.count_if(status == "Failed").alias("failed_shards"),
        F.count_if(status.isin(*_PROCESSING)).alias("processing_shards"),
        F.count_if(status.isin(*_WAITING)).alias("pending_shards"),
        F.coalesce(F.avg("progress_percentage"), F.lit(0.0)).alias("overall_progress"),
        F.sum("processed_items").alias("items_processed"),
        F.sum("processed_bytes").alias("bytes_processed"),
        F.sum("estimated_items").alias("estimated_items"),
        F.sum("estimated_bytes").alias("estimated_bytes"),
        *started,
    )
    if as_of is None:
        return rolled
    left = F.greatest(F.col("estimated_items") - F.col("items_processed"), F.lit(0)) / F.col("items_processed")
    seconds = F.floor(measures.duration_seconds(F.col("__started"), as_of) * left).cast("long")
    return (
        rolled.withColumn("remaining_seconds", F.when(F.col("items_processed") > 0, seconds))
        .withColumn("estimated_completion", F.timestamp_micros(F.unix_micros(as_of) + F.col("remaining_seconds") * 1_000_000))
        .drop("__started")
    )


def shard_status_histogram(shards: DataFrame) -> DataFrame:
    return shards.groupBy("job_id", "status").agg(F.count(F.lit(1)).alias("shard_count"))


def active_shards(shards: DataFrame) -> DataFrame:
    return shards.filter(F.col("status").isin(*_PROCESSING))


def shard_validity(shards: DataFrame, as_of: Column) -> DataFrame:
    """``invalid_reason`` per shard: wrong state, expired lease or empty range; null when valid."""
    reason = (
        F.when(~F.col("status").isin("Assigned", "Retrying"), "InvalidState")
        .when(F.coalesce(F.col("lock_expiry") < as_of, F.lit(False)), "LockExpired")
        .when(F.col("start_date") >= F.col("end_date"), "InvalidDateRange")
    )
    return shards.withColumn("invalid_reason", reason)


def sharding_recommendation(requests: DataFrame) -> DataFrame:
    """Whether a request should be sharded, into how many windows of what size, and why.

    Integer division is kept where the original has it. A request without custodians
    gets nulls and a reason instead of a division by zero.
    """
    n = F.size("custodians")
    days = measures.duration_seconds(F.col("start_date"), F.col("end_date")) / 86400
    total = days * n
    count = F.greatest(F.lit(1), F.ceil(total / 30)).cast("long")
    per_custodian = F.when(n > 0, F.floor(count / n)).cast("long")
    window = F.when(n > 0, F.least(F.lit(30.0), days / F.greatest(F.lit(1), per_custodian)))
    factors = F.filter(
        F.array(
            F.when(days > 90, F.concat(F.lit("Long date range ("), F.format_string("%.0f", days), F.lit(" days)"))),
            F.when(n > 5, F.concat(F.lit("Many custodians ("), n.cast("string"), F.lit(")"))),
            F.when(
                total > 365,
                F.concat(F.lit("Large total scope ("), F.format_string("%.0f", total), F.lit(" custodian-days)")),
            ),
        ),
        lambda f: f.isNotNull(),
    )
    should = (total > 365) | (n > 5) | (days > 90)
    reason = (
        F.when(n == 0, "Request has no custodians")
        .when(should, F.concat(F.lit("Job should be sharded due to: "), F.array_join(factors, ", ")))
        .otherwise("Job is small enough to process without sharding")
    )
    return requests.select(
        "job_id",
        should.alias("should_shard"),
        reason.alias("reason"),
        count.alias("recommended_shards"),
        window.alias("recommended_window_days"),
        per_custodian.alias("recommended_shards_per_custodian"),
        days.alias("date_range_days"),
        n.cast("long").alias("custodian_count"),
        total.alias("total_custodian_days"),
    )


# --- checkpoints -------------------------------------------------------------


def last_checkpoints(checkpoints: DataFrame) -> DataFrame:
    """Last completed checkpoint per (shard, type)."""
    done = checkpoints.filter("is_completed")
    return latest_by(done, ["shard_id", "checkpoint_type"], [F.col("created_date"), F.col("checkpoint_id")])


def sequence_errors(checkpoints: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Completed checkpoints that directly follow an incomplete one of their (shard, type)."""
    linked = previous_row(
        checkpoints.select("shard_id", "checkpoint_type", "checkpoint_id", "created_date", "is_completed"),
        ["shard_id", "checkpoint_type"],
        [F.col("created_date"), F.col("checkpoint_id")],
        coarse=F.date_trunc("minute", "created_date"),
        carry=["checkpoint_id", "is_completed"],
        fine=[F.col("created_date"), F.floor(F.col("checkpoint_id") / 100_000)],
        hot_rows=hot_rows,
    )
    wrong = linked.filter(F.col("is_completed") & ~F.col("previous.is_completed"))
    return wrong.select(
        "shard_id",
        "checkpoint_type",
        F.col("previous.checkpoint_id").alias("incomplete_id"),
        F.col("checkpoint_id").alias("completed_id"),
        F.concat(
            F.lit("Checkpoint sequence error in "),
            F.col("checkpoint_type"),
            F.lit(": incomplete checkpoint "),
            F.col("previous.checkpoint_id").cast("string"),
            F.lit(" followed by completed "),
            F.col("checkpoint_id").cast("string"),
        ).alias("error"),
    )


def checkpoint_validation(checkpoints: DataFrame) -> DataFrame:
    """Counts per shard and whether its sequence is sound."""
    counts = checkpoints.groupBy("shard_id").agg(
        F.count(F.lit(1)).alias("total_checkpoints"),
        F.count_if("is_completed").alias("completed_checkpoints"),
        F.count_if(~F.col("is_completed")).alias("incomplete_checkpoints"),
    )
    errors = sequence_errors(checkpoints).groupBy("shard_id").agg(F.count(F.lit(1)).alias("error_count"))
    return (
        counts.join(errors, "shard_id", "left")
        .withColumn("error_count", F.coalesce("error_count", F.lit(0)))
        .withColumn("is_valid", F.col("error_count") == 0)
    )


def resume_set(checkpoints: DataFrame) -> DataFrame:
    """Incomplete checkpoints of shards whose sequence is sound; other shards start afresh."""
    unsound = sequence_errors(checkpoints).select("shard_id").distinct()
    return checkpoints.filter(~F.col("is_completed")).join(unsound, "shard_id", "left_anti")


def heartbeat_gaps(heartbeats: DataFrame, lease_minutes: int = 30, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Silences of a worker longer than its lease: from, to and seconds."""
    linked = previous_row(
        # Heartbeats of one instant say the same once.
        heartbeats.select("worker_id", "ts").distinct(),
        ["worker_id"],
        [F.col("ts")],
        coarse=F.date_trunc("minute", "ts"),
        carry=["ts"],
        fine=[F.date_trunc("second", "ts")],
        hot_rows=hot_rows,
    )
    silence = measures.duration_seconds(F.col("previous.ts"), F.col("ts"))
    return (
        linked.withColumn("gap_seconds", silence)
        .filter(F.col("gap_seconds") > lease_minutes * 60)
        .select("worker_id", F.col("previous.ts").alias("silent_from"), F.col("ts").alias("silent_to"), "gap_seconds")
    )
