"""Reconciliation of what should have been collected with what was collected.

Source and collected rows are stacked and grouped once by (scope, key). That one
shuffle answers missed, extra and hash mismatch together, and because it is an
aggregate rather than a join, a key repeated many times is reduced on the map side
instead of multiplying.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casetrail.functions import paths

# Wording and names used in reports.
MISSED_REASON = "Item present in source manifest but not found in collected manifest"
EXTRA_REASON = "Item found in collected manifest but not present in source manifest"
MISMATCH_REASON = "SHA-256 hash mismatch between source and collected item"
SECTION_OF_TYPE = {
    "Missed": "Missed",
    "Extra": "Extras",
    "HashMismatch": "HashMismatches",
    "ExpectedSkip": "ExpectedSkips",
}
REPORT_COLUMNS = [
    "Section",
    "Key",
    "Type",
    "Custodian",
    "DriveId",
    "ItemId",
    "Path",
    "Size",
    "LastModified",
    "SourceSha256",
    "CollectedSha256",
    "Reason",
    "DetectedUtc",
]


@dataclass(frozen=True)
class ReconcileOptions:
    """Tolerances are in percent: 0.1 means 0.1 %."""

    size_tolerance_pct: float = 0.1
    extra_tolerance_pct: float = 0.05
    require_hash_match: bool = False
    soft_fail: bool = False
    normalize_paths: bool = True
    include_folders: bool = False
    strict_system_paths: bool = False
    # error: a repeated key fails the job; first: its least row stands for it.
    on_duplicate: str = "error"
    scope: Sequence[str] = field(default=("job_id", "custodian"))

    def __post_init__(self) -> None:
        if self.on_duplicate not in ("error", "first"):
            raise ValueError("on_duplicate must be 'error' or 'first'")


def scope_filter(
    manifest: DataFrame, options: ReconcileOptions = ReconcileOptions(), custodian: str | None = None
) -> DataFrame:
    """Rows that take part: custodian match (empty passes), no folders, no system paths.

    Folders are judged on the raw path, before it is normalised.
    """
    kept = manifest
    if custodian:
        kept = kept.filter(paths.blank(F.col("custodian")) | (F.lower("custodian") == custodian.lower()))
    if not options.include_folders:
        kept = kept.filter(~paths.is_folder(F.col("kind"), F.col("path")))
    kept = kept.filter(~paths.is_system_path(F.col("path"), options.strict_system_paths))
    if options.normalize_paths:
        kept = kept.withColumn("path", paths.normalize_path(F.col("path")))
    return kept


def fill_custodian(manifest: DataFrame, jobs: DataFrame) -> DataFrame:
    """Give rows without a custodian the one of their job (``job_id``, ``custodian``)."""
    named = manifest.filter(~paths.blank(F.col("custodian")))
    owner = jobs.select(F.col("job_id"), F.col("custodian").alias("__owner"))
    unnamed = manifest.filter(paths.blank(F.col("custodian"))).join(owner, "job_id", "left")
    filled = unnamed.withColumn("custodian", F.coalesce("__owner", F.lit(""))).select(*manifest.columns)
    return named.unionByName(filled)


def manifest_key() -> Column:
    return paths.primary_key(
        F.col("item_id"), F.col("drive_id"), F.col("path"), F.col("size"), F.col("last_modified")
    )


def _scope_keys(options: ReconcileOptions) -> list[Column]:
    """Scope values compare without case and null equals empty."""
    return [F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(f"scope_{c}") for c in options.scope]


# The leading fields decide which duplicate stands for its key, so the narrow row
# of the summary and the wide row of the report always pick the same one.
_NARROW = ("size", "sha256")
_WIDE = ("size", "sha256", "path", "drive_id", "item_id", "last_modified", "custodian")


def match_manifests(
    source: DataFrame, collected: DataFrame, options: ReconcileOptions, wide: bool = True
) -> DataFrame:
    """One row per (scope, key) with both sides: ``source`` and ``collected`` structs."""
    fields = _WIDE if wide else _NARROW

    def side(df: DataFrame, is_source: bool) -> DataFrame:
        row = F.struct(
            F.coalesce(F.col("size"), F.lit(0).cast("long")).alias("size"),
            *[F.col(c) for c in fields if c != "size"],
        )
        return scope_filter(df, options).select(
            *_scope_keys(options), manifest_key().alias("key"), F.lit(is_source).alias("is_source"), row.alias("row")
        )

    scope = [f"scope_{c}" for c in options.scope]
    both = side(source, True).unionByName(side(collected, False))
    matched = both.groupBy(*scope, "key").agg(
        F.count_if("is_source").alias("n_source"),
        F.count_if(~F.col("is_source")).alias("n_collected"),
        F.min(F.when(F.col("is_source"), F.col("row"))).alias("source"),
        F.min(F.when(~F.col("is_source"), F.col("row"))).alias("collected"),
    )
    if options.on_duplicate == "error":
        repeated = (F.col("n_source") > 1) | (F.col("n_collected") > 1)
        matched = matched.filter(
            F.when(
                repeated, F.raise_error(F.concat(F.lit("duplicate manifest key: "), F.col("key"))).cast("boolean")
            ).otherwise(F.lit(True))
        )
    return matched


def duplicate_keys(manifest: DataFrame, options: ReconcileOptions = ReconcileOptions()) -> DataFrame:
    """Keys that occur more than once after filtering, with their number of rows."""
    return (
        scope_filter(manifest, options)
        .select(*_scope_keys(options), manifest_key().alias("key"))
        .groupBy(*[f"scope_{c}" for c in options.scope], "key")
        .agg(F.count(F.lit(1)).alias("row_count"))
        .filter("row_count > 1")
    )


def _finding_type(options: ReconcileOptions) -> Column:
    finding = F.when(F.col("collected").isNull(), "Missed").when(F.col("source").isNull(), "Extra")
    if options.require_hash_match:
        ours, theirs = F.col("source.sha256"), F.col("collected.sha256")
        differs = ~paths.blank(ours) & ~paths.blank(theirs) & (F.lower(ours) != F.lower(theirs))
        finding = finding.when(differs, "HashMismatch")
    return finding


def discrepancies(
    source: DataFrame, collected: DataFrame, options: ReconcileOptions, as_of: Column
) -> DataFrame:
    """Missed, extra and mismatching items, one row each."""
    return _findings(match_manifests(source, collected, options), options, as_of)


def _findings(matched: DataFrame, options: ReconcileOptions, as_of: Column) -> DataFrame:
    found = matched.withColumn("type", _finding_type(options)).filter(F.col("type").isNotNull())
    shown = F.coalesce(F.col("source"), F.col("collected"))
    reason = (
        F.when(F.col("type") == "Missed", MISSED_REASON)
        .when(F.col("type") == "Extra", EXTRA_REASON)
        .otherwise(MISMATCH_REASON)
    )
    return found.select(
        *[f"scope_{c}" for c in options.scope],
        "type",
        "key",
        shown.getField("custodian").alias("custodian"),
        shown.getField("drive_id").alias("drive_id"),
        shown.getField("item_id").alias("item_id"),
        shown.getField("path").alias("path"),
        shown.getField("size").alias("size"),
        shown.getField("last_modified").alias("last_modified"),
        F.col("source.sha256").alias("source_sha256"),
        F.col("collected.sha256").alias("collected_sha256"),
        reason.alias("reason"),
        as_of.alias("detected_utc"),
    )


def gates(summary: DataFrame, options: ReconcileOptions) -> DataFrame:
    """Percentages, the four gates and the status on top of the counts."""
    src_n, src_b = F.col("source_count"), F.col("source_bytes")
    col_b, extra_n = F.col("collected_bytes"), F.col("extra_count")
    delta = col_b - src_b
    delta_pct = F.when(src_b == 0, 0.0).otherwise(F.abs(delta).cast("double") / src_b * 100)
    extras_pct = F.when(src_n == 0, 0.0).otherwise(extra_n.cast("double") / src_n * 100)
    if options.extra_tolerance_pct == 0:
        extras_ok = extra_n == 0
    else:
        extras_ok = F.when(src_n == 0, extra_n == 0).otherwise(extras_pct <= options.extra_tolerance_pct)
    size_ok = F.when(src_b == 0, col_b == 0).otherwise(delta_pct <= options.size_tolerance_pct)
    hash_ok = (F.col("hash_mismatch_count") == 0) | F.lit(not options.require_hash_match)
    judged = (
        summary.withColumn("size_delta_bytes", delta)
        .withColumn("size_delta_pct", delta_pct)
        .withColumn("extras_pct", extras_pct)
        .withColumn("cardinality_passed", F.col("missed_count") == 0)
        .withColumn("extras_passed", extras_ok)
        .withColumn("size_passed", size_ok)
        .withColumn("hash_passed", hash_ok)
    )
    passed = (
        F.col("cardinality_passed") & F.col("extras_passed") & F.col("size_passed") & F.col("hash_passed")
    )
    return judged.withColumn("overall_passed", passed).withColumn(
        "status",
        F.when(passed, "Completed").otherwise("CompletedWithWarnings" if options.soft_fail else "Failed"),
    )


def summarize(source: DataFrame, collected: DataFrame, options: ReconcileOptions) -> DataFrame:
    """Counts, bytes and gates per scope. Carries only sizes and hashes through the shuffle."""
    return _summary(match_manifests(source, collected, options, wide=False), options)


def _summary(matched: DataFrame, options: ReconcileOptions) -> DataFrame:
    judged = matched.withColumn("type", _finding_type(options))
    counts = judged.groupBy(*[f"scope_{c}" for c in options.scope]).agg(
        F.count_if(F.col("source").isNotNull()).alias("source_count"),
        F.count_if(F.col("collected").isNotNull()).alias("collected_count"),
        F.count_if(F.col("type") == "Missed").alias("missed_count"),
        F.count_if(F.col("type") == "Extra").alias("extra_count"),
        F.count_if(F.col("type") == "HashMismatch").alias("hash_mismatch_count"),
        F.coalesce(F.sum("source.size"), F.lit(0)).alias("source_bytes"),
        F.coalesce(F.sum("collected.size"), F.lit(0)).alias("collected_bytes"),
    )
    return gates(counts, options)


def summary_text(options: ReconcileOptions) -> Column:
    """The one-line summary of a report."""

    def named(label: str, column: str) -> list[Column]:
        return [F.lit(f"{label}:"), F.col(column).cast("string"), F.lit(" ")]

    def percent(label: str, column: str) -> list[Column]:
        return [F.lit(f"{label}:"), F.format_string("%.2f", F.col(column)), F.lit("% ")]

    def flag(label: str, column: str) -> list[Column]:
        return [F.lit(f"{label}:"), F.when(F.col(column), "True").otherwise("False"), F.lit(" ")]

    tail = (
        f"SizeTolerancePct:{options.size_tolerance_pct:g}% "
        f"ExtraTolerancePct:{options.extra_tolerance_pct:g}% "
        f"RequireHashMatch:{options.require_hash_match}"
    )
    return F.concat(
        *named("SourceCount", "source_count"),
        *named("CollectedCount", "collected_count"),
        *named("MissedCount", "missed_count"),
        *named("ExtraCount", "extra_count"),
        *named("HashMismatchCount", "hash_mismatch_count"),
        *named("SourceBytes", "source_bytes"),
        *named("CollectedBytes", "collected_bytes"),
        *named("SizeDeltaBytes", "size_delta_bytes"),
        *percent("SizeDeltaPct", "size_delta_pct"),
        *percent("ExtrasPct", "extras_pct"),
        *flag("CardinalityPassed", "cardinality_passed"),
        *flag("ExtrasPassed", "extras_passed"),
        *flag("SizePassed", "size_passed"),
        *flag("HashPassed", "hash_passed"),
        *flag("OverallPassed", "overall_passed"),
        F.lit(tail),
    )


def report(
    source: DataFrame,
    collected: DataFrame,
    options: ReconcileOptions,
    as_of: Column,
    expected_skips: DataFrame | None = None,
) -> DataFrame:
    """Report rows of every scope: the sections, then one summary row (``ord`` sorts them).

    ``expected_skips`` has the columns of ``discrepancies`` and fills the fourth section.
    Sections and summary start from the same match, whose shuffle Spark reuses.
    """
    scope = [f"scope_{c}" for c in options.scope]
    matched = match_manifests(source, collected, options)
    found = _findings(matched, options, as_of)
    if expected_skips is not None:
        found = found.unionByName(expected_skips.withColumn("type", F.lit("ExpectedSkip")))
    section = F.lit(None).cast("string")
    ord_ = F.lit(9)
    for position, (kind, title) in enumerate(SECTION_OF_TYPE.items()):
        section = F.when(F.col("type") == kind, title).otherwise(section)
        ord_ = F.when(F.col("type") == kind, position).otherwise(ord_)

    def text(column: str) -> Column:
        return F.coalesce(F.col(column).cast("string"), F.lit(""))

    rows = found.select(
        *scope,
        ord_.alias("ord"),
        section.alias("Section"),
        text("key").alias("Key"),
        F.col("type").alias("Type"),
        text("custodian").alias("Custodian"),
        text("drive_id").alias("DriveId"),
        text("item_id").alias("ItemId"),
        text("path").alias("Path"),
        text("size").alias("Size"),
        paths.iso_seconds(
            F.coalesce(F.col("last_modified").cast("timestamp"), F.lit(paths.FIRST_INSTANT).cast("timestamp"))
        ).alias("LastModified"),
        text("source_sha256").alias("SourceSha256"),
        text("collected_sha256").alias("CollectedSha256"),
        F.col("reason").alias("Reason"),
        paths.iso_seconds(F.col("detected_utc")).alias("DetectedUtc"),
    )
    empty = [F.lit("").alias(c) for c in REPORT_COLUMNS[4:11]]
    owner = F.col("scope_custodian") if "custodian" in options.scope else F.lit("")
    totals = _summary(matched, options).select(
        *scope,
        F.lit(len(SECTION_OF_TYPE)).alias("ord"),
        F.lit("Summary").alias("Section"),
        F.lit("SUMMARY").alias("Key"),
        F.lit("Summary").alias("Type"),
        owner.alias("Custodian"),
        *empty,
        summary_text(options).alias("Reason"),
        paths.iso_seconds(as_of).alias("DetectedUtc"),
    )
    return rows.unionByName(totals)
