"""Incremental collection: cursors, changes, decisions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casetrail.functions import paths
from casetrail.operators.ordering import HOT_ROWS, as_of_join, latest_by

# Notes left on cursors that were switched off.
RESET_NOTE = "Reset by user/system"
STALE_NOTE = "Marked stale during cleanup"


@dataclass(frozen=True)
class DeltaOptions:
    use_delta: bool = True
    enable_mail: bool = True
    enable_drive: bool = True
    max_age_days: int = 30
    interval_minutes: int = 60
    max_failures: int = 3


def _days(n: int) -> Column:
    return F.make_dt_interval(F.lit(n))


def split_changes(changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items to collect, tombstones).

    Drive changes must be files; deletions become tombstones instead of being lost.
    Needs ``delta_type``, ``deleted``, ``is_folder``, ``is_file``.
    """
    return changes.filter(is_live()), changes.filter(is_deleted())


def is_deleted() -> Column:
    return F.coalesce(F.col("deleted"), F.lit(False))


def is_live() -> Column:
    """A change that brings an item to collect: not a deletion, and mail or a file."""
    collectable = (F.col("delta_type") == "Mail") | (
        ~F.coalesce(F.col("is_folder"), F.lit(False)) & F.coalesce(F.col("is_file"), F.lit(False))
    )
    return ~is_deleted() & F.coalesce(collectable, F.lit(False))


def active_cursors(cursors: DataFrame) -> DataFrame:
    return cursors.filter("is_active")


def due_cursors(cursors: DataFrame, as_of: Column, options: DeltaOptions = DeltaOptions()) -> DataFrame:
    """Active cursors whose last query is at least one interval ago."""
    interval = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(options.interval_minutes))
    return active_cursors(cursors).filter(as_of - F.col("last_delta_time") >= interval)


def stale_cursors(cursors: DataFrame, as_of: Column, options: DeltaOptions = DeltaOptions()) -> DataFrame:
    """Active cursors older than the greatest age."""
    return active_cursors(cursors).filter(F.col("last_delta_time") < as_of - _days(options.max_age_days))


def latest_cursors(cursors: DataFrame) -> DataFrame:
    """Latest updated active cursor per (scope, type)."""
    return latest_by(active_cursors(cursors), ["scope_id", "delta_type"], [F.col("updated_date")])


def cursors_as_of(requests: DataFrame, history: DataFrame, at: str = "requested_at", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Each request (``scope_id``, ``delta_type`` and a time) with ``cursor``: the latest active row of its scope as of that time.

    Later updates don't count, so a request can be decided again as it was; ties in time go to the later job.
    """
    return as_of_join(requests, active_cursors(history), ["scope_id", "delta_type"], at, "updated_date", ["job_id"], "cursor", hot_rows)


def delta_or_full(
    requests: DataFrame, cursors: DataFrame, as_of: Column, options: DeltaOptions = DeltaOptions()
) -> DataFrame:
    """``use_delta`` and ``reason`` per request (``custodian``, ``delta_type``)."""
    current = latest_cursors(cursors).select(
        "scope_id", F.col("last_delta_time"), F.col("failure_count"), F.lit(True).alias("__found")
    )
    joined = requests.withColumn("scope_id", paths.scope_id(F.col("delta_type"), F.col("custodian"))).join(
        current, "scope_id", "left"
    )
    kind = F.col("delta_type")
    reason = (
        F.when(F.lit(not options.use_delta), "Delta disabled globally")
        .when((kind == "Mail") & F.lit(not options.enable_mail), "Delta disabled for mail")
        .when((kind == "OneDrive") & F.lit(not options.enable_drive), "Delta disabled for OneDrive")
        .when(~kind.isin("Mail", "OneDrive"), "Delta not supported for type")
        .when(F.col("__found").isNull(), "No baseline cursor exists")
        .when(F.coalesce(F.col("failure_count"), F.lit(0)) > options.max_failures, "Reset to full collection mode")
        .when(
            as_of - F.col("last_delta_time") > _days(options.max_age_days),
            "Cursor too stale, full resync needed",
        )
        .otherwise("Recent baseline available")
    )
    return joined.withColumn("reason", reason).withColumn(
        "use_delta", F.col("reason") == "Recent baseline available"
    ).drop("__found", "last_delta_time", "failure_count")


def mark_stale(cursors: DataFrame, as_of: Column, options: DeltaOptions = DeltaOptions()) -> DataFrame:
    """The cursor table with stale cursors switched off."""
    stale = F.col("is_active") & (F.col("last_delta_time") < as_of - _days(options.max_age_days))
    return (
        cursors.withColumn("__stale", stale)
        .withColumn("is_active", F.col("is_active") & ~F.col("__stale"))
        .withColumn("updated_date", F.when(F.col("__stale"), as_of).otherwise(F.col("updated_date")))
        .withColumn("error_message", F.when(F.col("__stale"), F.lit(STALE_NOTE)).otherwise(F.col("error_message")))
        .drop("__stale")
    )


def apply_commands(cursors: DataFrame, commands: DataFrame) -> DataFrame:
    """New cursor table after ``initialise`` and ``reset`` commands.

    ``cursors`` has one row per scope; ``commands`` has ``custodian``, ``delta_type``,
    ``action``, ``ts`` and ``job_id``. The last command of a scope decides. An
    initialise keeps a live cursor and starts a fresh one (empty token, so a baseline
    is taken) when there is none, when it is off, or when a reset came before.
    """
    asked = (
        commands.withColumn("scope_id", paths.scope_id(F.col("delta_type"), F.col("custodian")))
        .groupBy("scope_id")
        .agg(
            F.max_by(F.struct("action", "ts", "custodian", "delta_type", "job_id"), F.struct("ts", "action")).alias(
                "cmd"
            ),
            F.bool_or(F.col("action") == "reset").alias("had_reset"),
            F.bool_or(F.col("action") == "initialise").alias("had_init"),
        )
    )
    old = cursors.alias("old")
    joined = old.join(asked.alias("new"), "scope_id", "full_outer")
    exists = F.col("old.delta_type").isNotNull()
    commanded = F.col("cmd").isNotNull()
    init = commanded & (F.col("cmd.action") == "initialise")
    reset = commanded & (F.col("cmd.action") == "reset")
    fresh = init & (~exists | ~F.coalesce(F.col("old.is_active"), F.lit(False)) | F.col("had_reset"))
    # A reset of a scope that was never tracked leaves nothing behind.
    kept = joined.filter(exists | init | (reset & F.col("had_init")))
    created_here = ~exists & commanded
    zero = F.lit(0).cast("long")

    def pick(column: str, when_fresh: Column) -> Column:
        return F.when(fresh | created_here, when_fresh).otherwise(F.col(f"old.{column}")).alias(column)

    return kept.select(
        "scope_id",
        F.coalesce(F.col("old.delta_type"), F.col("cmd.delta_type")).alias("delta_type"),
        F.coalesce(F.col("old.custodian"), F.col("cmd.custodian")).alias("custodian"),
        pick("delta_token", F.lit("")),
        pick("last_delta_time", F.col("cmd.ts")),
        pick("baseline_completed_at", F.lit(None).cast("timestamp")),
        pick("last_delta_item_count", zero),
        pick("last_delta_size_bytes", zero),
        pick("delta_query_count", zero),
        pick("failure_count", zero),
        F.when(init, True).when(reset, False).otherwise(F.col("old.is_active")).alias("is_active"),
        F.coalesce(F.col("old.created_date"), F.col("cmd.ts")).alias("created_date"),
        F.coalesce(F.col("cmd.ts"), F.col("old.updated_date")).alias("updated_date"),
        F.when(reset, F.lit(RESET_NOTE))
        .when(init, F.lit(None).cast("string"))
        .otherwise(F.col("old.error_message"))
        .alias("error_message"),
        F.when(fresh | created_here, F.col("cmd.job_id")).otherwise(F.col("old.job_id")).alias("job_id"),
    )


def query_results(changes: DataFrame, scope: str = "scope_id", size: str = "size_bytes", version: str = "version") -> DataFrame:
    """Item count and bytes of what is to collect, and the highest version, per scope of one round of changes.

    Deletions and folders are not counted, but move the token like any other change.
    """
    return changes.groupBy(scope).agg(
        F.count_if(is_live()).alias("item_count"),
        F.coalesce(F.sum(F.when(is_live(), F.col(size))), F.lit(0)).alias("total_bytes"),
        F.max(version).cast("string").alias("next_token"),
    )


def advance_cursors(cursors: DataFrame, results: DataFrame, as_of: Column) -> DataFrame:
    """Active cursors moved on by ``query_results``; scopes without a new token stay as they are.

    A token that is a number never becomes a lower one, whatever arrives late.
    """
    joined = cursors.join(
        results.select("scope_id", "item_count", "total_bytes", "next_token"), "scope_id", "left"
    )
    moved = F.col("is_active") & ~paths.blank(F.col("next_token"))
    old, new = (F.col(c).try_cast("long") for c in ("delta_token", "next_token"))
    newer = F.when(old > new, F.col("delta_token")).otherwise(F.col("next_token"))

    def pick(value: Column, old: str) -> Column:
        return F.when(moved, value).otherwise(F.col(old)).alias(old)

    changed = {
        "delta_token": pick(newer, "delta_token"),
        "last_delta_time": pick(as_of, "last_delta_time"),
        "baseline_completed_at": pick(F.coalesce("baseline_completed_at", as_of), "baseline_completed_at"),
        "last_delta_item_count": pick(F.col("item_count"), "last_delta_item_count"),
        "last_delta_size_bytes": pick(F.col("total_bytes"), "last_delta_size_bytes"),
        "delta_query_count": pick(F.col("delta_query_count") + 1, "delta_query_count"),
        "updated_date": pick(as_of, "updated_date"),
        "error_message": pick(F.lit(None).cast("string"), "error_message"),
    }
    return joined.select(*[changed.get(c, F.col(c)) for c in cursors.columns])


def apply_changes(snapshot: DataFrame, changes: DataFrame, key: str = "item_id", version: str = "version") -> DataFrame:
    """The snapshot after a change log: latest version per item, tombstones dropped.

    An aggregate over snapshot and changes together, so an item changed very often
    is reduced before the shuffle. Both need the same columns and ``deleted``.
    """
    both = snapshot.unionByName(changes)
    return latest_by(both, [key], [F.col(version)]).filter(~F.coalesce(F.col("deleted"), F.lit(False)))
