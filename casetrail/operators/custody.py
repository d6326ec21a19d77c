"""Custody manifests: sequence, totals, digests, verification, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casetrail.functions import paths
from casetrail.operators.digests import CHUNK_ROWS, ordered_digest, scheme
from casetrail.operators.ordering import HOT_ROWS, number_rows

# Fixed value: SHA-256 of no bytes, the items hash of a job without items.
EMPTY_DIGEST = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
HASH_PATTERN = "^[0-9a-f]{64}$"


def collection_order() -> list[Column]:
    """Order of collection. Items of one instant are ordered by a digest of their id.

    Spark rows have no arrival order to fall back on, and a digest prefix lets any
    number of items with one timestamp be numbered by many tasks.
    """
    return [F.col("collected_date"), F.md5(F.col("item_id")), F.col("item_id"), F.col("sha256")]


def collection_sequence(items: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``sequence`` 1..n per job in collection order; jobs above ``hot_rows`` are split."""
    order = collection_order()
    return number_rows(
        items,
        ["job_id"],
        order,
        coarse=F.date_trunc("minute", "collected_date"),
        fine=[F.col("collected_date"), F.substring(order[1], 1, 3)],
        name="sequence",
        hot_rows=hot_rows,
    )


def manifest_totals(items: DataFrame) -> DataFrame:
    """Counts per job; bytes of successful items only."""
    return items.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("total_items"),
        F.count_if("is_successful").alias("successful_items"),
        F.count_if(~F.col("is_successful")).alias("failed_items"),
        F.coalesce(F.sum(F.when(F.col("is_successful"), F.col("size_bytes"))), F.lit(0)).alias("total_size_bytes"),
    )


def items_hash(sequenced: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Digest of the item hashes of a job in sequence order."""
    return ordered_digest(sequenced, ["job_id"], "sequence", F.col("sha256"), chunk_rows=chunk_rows, name="items_hash")


def collection_hash(sequenced: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Digest of (ItemId, Sha256Hash) in sequence order; a chunk is a JSON array."""
    piece = F.to_json(F.struct(F.col("item_id").alias("ItemId"), F.col("sha256").alias("Sha256Hash")))
    return ordered_digest(
        sequenced,
        ["job_id"],
        "sequence",
        piece,
        separator=",",
        prefix="[",
        suffix="]",
        chunk_rows=chunk_rows,
        name="collection_hash",
    )


def manifest_hash_input() -> Column:
    """The fixed field list of a manifest as JSON, in fixed order."""
    return F.to_json(
        F.struct(
            F.col("manifest_id").alias("manifestId"),
            F.col("job_id").alias("jobId"),
            F.col("matter_id").alias("matterId"),
            F.col("custodian").alias("custodian"),
            F.col("job_type").alias("jobType"),
            F.col("total_items").alias("totalItems"),
            F.col("total_size_bytes").alias("totalSizeBytes"),
            paths.iso_seconds(F.col("created_date")).alias("createdDate"),
            F.col("items_hash").alias("itemsHash"),
            F.col("items_hash_scheme").alias("itemsHashScheme"),
        )
    )


#: Columns of items that a manifest is made of.
MANIFEST_COLUMNS = ("job_id", "item_id", "collected_date", "sha256", "is_successful", "size_bytes")


def job_manifests(
    jobs: DataFrame, items: DataFrame, created_date: Column, chunk_rows: int = CHUNK_ROWS, sequenced: DataFrame | None = None
) -> DataFrame:
    """One manifest per job, jobs without items included.

    Totals and digest come from one pass over the items; the jobs side is joined to
    one row per job only. ``sequenced`` is the items' ``collection_sequence`` where the caller has it.
    """
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    successful = F.coalesce(F.col("is_successful"), F.lit(False))
    digests = ordered_digest(
        collection_sequence(items) if sequenced is None else sequenced,
        ["job_id"],
        "sequence",
        F.col("sha256"),
        chunk_rows=chunk_rows,
        name="items_hash",
        sums={
            "successful_items": F.when(successful, one).otherwise(zero),
            "failed_items": F.when(successful, zero).otherwise(one),
            "total_size_bytes": F.when(successful, F.col("size_bytes")).otherwise(zero),
        },
    ).withColumnRenamed("items_hash_rows", "total_items")
    built = jobs.select("job_id", "matter_id", "custodian", "job_type", "route", "start_time", "end_time").join(
        digests, "job_id", "left"
    )
    return (
        built.withColumn("manifest_id", F.concat(F.lit("m"), F.col("job_id").cast("string")))
        .withColumn("created_date", created_date)
        .withColumn("total_items", F.coalesce("total_items", zero))
        .withColumn("successful_items", F.coalesce("successful_items", zero))
        .withColumn("failed_items", F.coalesce("failed_items", zero))
        .withColumn("total_size_bytes", F.coalesce("total_size_bytes", zero))
        .withColumn("items_hash", F.coalesce("items_hash", F.lit(EMPTY_DIGEST)))
        .withColumn("items_hash_scheme", F.coalesce("items_hash_scheme", F.lit(scheme(chunk_rows))))
        .withColumn("manifest_hash", F.sha2(manifest_hash_input(), 256))
    )


def verify_manifests(stored: DataFrame, recomputed: DataFrame) -> DataFrame:
    """Compare stored digests with recomputed ones (both keyed by ``job_id``).

    Error: the job is gone. Inconclusive: nothing was stored to compare with.
    """
    ours = recomputed.select(
        "job_id",
        F.col("items_hash").alias("__items"),
        F.col("manifest_hash").alias("__manifest"),
    )
    checked = stored.join(ours, "job_id", "left")
    no_stored = paths.blank(F.col("items_hash")) | paths.blank(F.col("manifest_hash"))
    same_items = F.lower("items_hash") == F.col("__items")
    same_manifest = F.lower("manifest_hash") == F.col("__manifest")
    result = (
        F.when(F.col("__items").isNull(), "Error")
        .when(no_stored, "Inconclusive")
        .when(same_items & same_manifest, "Valid")
        .otherwise("Invalid")
    )
    detail = (
        F.when(F.col("__items").isNull(), "Manifest has no job")
        .when(no_stored, "No stored hash")
        .when(~same_items, "Items hash differs")
        .when(~same_manifest, "Manifest hash differs")
    )
    return checked.select("manifest_id", "job_id", result.alias("result"), detail.alias("error_details"))


def custody_findings(items: DataFrame, verifications: DataFrame, custody_events: DataFrame) -> DataFrame:
    """Problems per job: malformed item hashes, items without a custody event, bad manifests.

    ``custody_events`` has ``item_id``; ``verifications`` is the output of
    ``verify_manifests``. Each kind is counted on its own, then stacked.
    """
    bad_hash = items.filter(~F.coalesce(F.col("sha256").rlike(HASH_PATTERN), F.lit(False)))
    logged = custody_events.select("item_id").distinct()
    unlogged = items.join(logged, "item_id", "left_anti")
    broken = verifications.filter(F.col("result") != "Valid")

    def tally(rows: DataFrame, finding: str) -> DataFrame:
        return rows.groupBy("job_id").agg(F.count(F.lit(1)).alias("occurrences")).withColumn(
            "finding", F.lit(finding)
        )

    return (
        tally(bad_hash, "Malformed SHA-256 hash")
        .unionByName(tally(unlogged, "No custody log event"))
        .unionByName(tally(broken, "Manifest not valid"))
    )


def custody_validation(
    jobs: DataFrame, items: DataFrame, verifications: DataFrame, custody_events: DataFrame
) -> DataFrame:
    """One row per job: ``is_valid`` and the number of findings of each kind."""
    findings = custody_findings(items, verifications, custody_events)

    def of(finding: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("finding") == finding, F.col("occurrences"))), F.lit(0))

    per_job = findings.groupBy("job_id").agg(
        of("Malformed SHA-256 hash").alias("malformed_hashes"),
        of("No custody log event").alias("unlogged_items"),
        of("Manifest not valid").alias("invalid_manifests"),
    )
    zero = F.lit(0).cast("long")
    checked = jobs.select("job_id").join(per_job, "job_id", "left")
    for name in ("malformed_hashes", "unlogged_items", "invalid_manifests"):
        checked = checked.withColumn(name, F.coalesce(name, zero))
    return checked.withColumn(
        "is_valid", (F.col("malformed_hashes") + F.col("unlogged_items") + F.col("invalid_manifests")) == 0
    )


def rehash_check(manifest: DataFrame, inventory: DataFrame, key: str) -> DataFrame:
    """Content digests against the manifest: Match, Mismatch or Missing per manifest row."""
    joined = manifest.select(key, F.lower("sha256").alias("sha256")).join(
        inventory.select(key, "content_sha256"), key, "left"
    )
    outcome = (
        F.when(F.col("content_sha256").isNull(), "Missing")
        .when(F.col("content_sha256") == F.col("sha256"), "Match")
        .otherwise("Mismatch")
    )
    return joined.select(key, outcome.alias("outcome"))


def last_valid_verification(verifications: DataFrame) -> DataFrame:
    """Date of the last valid verification per manifest (null when there is none)."""
    valid = F.when(F.col("result") == "Valid", F.col("verification_date"))
    return verifications.groupBy("manifest_id").agg(F.max(valid).alias("last_verified"))


def verification_due(manifests: DataFrame, verifications: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    """Manifests never validly verified, or not within the interval before ``as_of``."""
    joined = manifests.select("manifest_id", "job_id").join(
        last_valid_verification(verifications), "manifest_id", "left"
    )
    limit = as_of - F.make_dt_interval(F.lit(0), F.lit(hours))
    return joined.filter(F.col("last_verified").isNull() | (F.col("last_verified") < limit))
