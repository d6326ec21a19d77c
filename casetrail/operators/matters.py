"""Matter, job and item roll-ups over the relational tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casetrail.operators.custody import collection_order, last_valid_verification


def active_matters(matters: DataFrame) -> DataFrame:
    return matters.filter("is_active")


def job_custody(jobs: DataFrame, manifests: DataFrame, verifications: DataFrame) -> DataFrame:
    """Jobs with their manifests summed up; every join is to one row per key."""
    per_manifest = manifests.select("manifest_id", "job_id", "is_sealed").join(
        last_valid_verification(verifications), "manifest_id", "left"
    )
    per_job = per_manifest.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("manifest_count"),
        F.bool_or("is_sealed").alias("manifest_sealed"),
        F.max("last_verified").alias("last_verified"),
    )
    joined = jobs.select("matter_id", "job_id", "custodian", "status", "actual_items", "actual_bytes").join(
        per_job, "job_id", "left"
    )
    return joined.select(
        "matter_id",
        "job_id",
        "custodian",
        "status",
        F.col("actual_items").alias("total_items"),
        F.col("actual_bytes").alias("total_size_bytes"),
        F.col("manifest_count").isNotNull().alias("has_manifest"),
        F.coalesce("manifest_count", F.lit(0)).alias("manifest_count"),
        F.coalesce("manifest_sealed", F.lit(False)).alias("manifest_sealed"),
        "last_verified",
    )


def matter_summary(custody: DataFrame) -> DataFrame:
    """Totals per matter over ``job_custody`` rows."""
    return custody.groupBy("matter_id").agg(
        F.count(F.lit(1)).alias("total_jobs"),
        F.count_if("has_manifest").alias("jobs_with_manifests"),
        F.count_if("manifest_sealed").alias("sealed_manifests"),
        F.coalesce(F.sum("total_items"), F.lit(0)).alias("total_items"),
        F.coalesce(F.sum("total_size_bytes"), F.lit(0)).alias("total_size_bytes"),
    )


def with_children(parents: DataFrame, children: DataFrame, key: str, direct: DataFrame | None = None) -> DataFrame:
    """Parent rows with their child rows, childless parents kept.

    Written as an inner join plus the childless parents, because adaptive execution
    can split a hot key of an inner join but not the optional side of an outer one.
    Where ``children`` has children of its own, ``direct`` is the table of the direct children, whose
    keys alone say who is childless.
    """
    matched = parents.join(children, key)
    keys = (children if direct is None else direct).select(key).distinct()
    childless = parents.join(keys, key, "left_anti")
    return matched.unionByName(childless, allowMissingColumns=True)


def children_newest_first(parents: DataFrame, children: DataFrame, key: str, date: str, *ties: str) -> DataFrame:
    """Parents with their children, sorted by parent and then newest child first."""
    joined = with_children(parents, children, key)
    return joined.orderBy(key, F.col(date).desc_nulls_last(), *ties)


def child_counts(parents: DataFrame, children: DataFrame, key: str, name: str) -> DataFrame:
    """Parents with the number of their children."""
    counts = children.groupBy(key).agg(F.count(F.lit(1)).alias(name))
    return parents.join(counts, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def newest_first(rows: DataFrame, date: str, *ties: str) -> DataFrame:
    """Newest first with ascending tie-breakers (a range-partitioned global sort)."""
    return rows.orderBy(F.col(date).desc(), *[F.col(t).asc() for t in ties])


def first_items(items: DataFrame, per_job: int = 5) -> DataFrame:
    """The first items of each job in collection order, as a sample for the log."""
    order = Window.partitionBy("job_id").orderBy(*collection_order())
    return items.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= per_job)


def average_duration_by_type(jobs: DataFrame) -> DataFrame:
    """Mean duration of completed jobs by type, in milliseconds and in minutes."""
    ms = (F.unix_micros("end_time") - F.unix_micros("start_time")) / 1000.0
    return (
        jobs.filter(F.col("status") == "Completed")
        .groupBy("job_type")
        .agg(F.avg(ms).alias("avg_duration_ms"))
        .withColumn("avg_duration_minutes", F.round(F.col("avg_duration_ms") / 60000, 2))
    )


def lease_expired(expiry: Column, as_of: Column) -> Column:
    return F.coalesce(expiry < as_of, F.lit(False))


def available_work(rows: DataFrame, as_of: Column) -> DataFrame:
    """Pending rows whose lock is absent or expired."""
    return rows.filter(
        (F.col("status") == "Pending") & (F.col("lock_expiry").isNull() | (F.col("lock_expiry") < as_of))
    )


def job_backlog(jobs: DataFrame, as_of: Column, k: int) -> DataFrame:
    """First ``k`` available jobs by priority, then age."""
    return available_work(jobs, as_of).orderBy("priority", "created_date", "job_id").limit(k)


def shard_backlog(shards: DataFrame, as_of: Column, k: int) -> DataFrame:
    """First ``k`` available shards by age, then index."""
    return (
        available_work(shards, as_of)
        .orderBy("created_date", "shard_index", "job_id", "custodian")
        .limit(k)
    )


def expired_leases(jobs: DataFrame, shards: DataFrame, assignments: DataFrame, as_of: Column) -> DataFrame:
    """Rows whose lease ran out, with the status they should have.

    Jobs lose any expired lease; shards only while Assigned; assignments only while
    Processing.
    """
    expired = lease_expired(F.col("lock_expiry"), as_of)

    def rows(df: DataFrame, kind: str, key: Column, condition: Column, corrected: str) -> DataFrame:
        return df.filter(expired & condition).select(
            F.lit(kind).alias("kind"),
            key.cast("string").alias("row_key"),
            F.col("status").alias("status"),
            F.lit(corrected).alias("corrected_status"),
            "lock_expiry",
        )

    return (
        rows(jobs, "job", F.col("job_id"), F.lit(True), "Pending")
        .unionByName(rows(shards, "shard", F.col("shard_key"), F.col("status") == "Assigned", "Pending"))
        .unionByName(
            rows(assignments, "assignment", F.col("assignment_id"), F.col("status") == "Processing", "Expired")
        )
    )
