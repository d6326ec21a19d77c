"""File-record datasets: filter, triage, fetch outcome, cut-off, summary, manifest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casetrail.functions import measures, paths
from casetrail.operators.ordering import HOT_ROWS, number_rows

# Outcomes of a record that cannot be fetched.
SKIP_WITH_URL = "SkippedNoId - webUrl resolution not implemented"
SKIP_WITHOUT_IDS = "SkippedNoId - missing driveId or itemId"
NO_CONTENT = "No content stream returned from Graph API"


def _drive() -> Column:
    return paths.resolved_drive_id(F.col("driveId"), F.col("parentReference"))


def _name() -> Column:
    return paths.resolved_file_name(F.col("fileName"), F.col("name"))


def filter_records(
    records: DataFrame,
    extensions: Sequence[str] = ("*",),
    modified_after: Column | None = None,
    custodians: Sequence[str] = ("*",),
    custodian_column: str = "custodian",
) -> DataFrame:
    """Files only; allowed extensions (``*`` is all, nameless records are dropped);
    not modified before ``modified_after`` (undated records pass); listed custodians."""
    kept = records.filter(paths.is_file(F.col("file"), F.col("folder")))
    if extensions and "*" not in extensions:
        allowed = [e.lower() for e in extensions]
        kept = kept.filter(~paths.blank(_name()) & paths.file_extension(_name()).isin(allowed))
    if modified_after is not None:
        kept = kept.filter(
            F.col("lastModifiedDateTime").isNull() | (F.col("lastModifiedDateTime") >= modified_after)
        )
    if custodians and "*" not in custodians:
        kept = kept.filter(F.lower(custodian_column).isin([c.lower() for c in custodians]))
    return kept


def triage(records: DataFrame) -> DataFrame:
    """Adds ``drive``, ``file_name``, ``record_key``, ``outcome`` and ``skip_reason``."""
    missing = paths.blank(F.col("drive")) | paths.blank(F.col("id"))
    reason = F.when(missing & ~paths.blank(F.col("webUrl")), SKIP_WITH_URL).when(missing, SKIP_WITHOUT_IDS)
    return (
        records.withColumn("drive", _drive())
        .withColumn("file_name", _name())
        .withColumn(
            "record_key",
            F.concat(F.coalesce("drive", F.lit("")), F.lit("/"), F.coalesce("id", F.lit(""))),
        )
        .withColumn("skip_reason", reason)
        .withColumn("outcome", F.when(F.col("skip_reason").isNotNull(), "Skipped").otherwise("Ready"))
    )


def index_records(
    records: DataFrame,
    dataset: str,
    order: Sequence[Column],
    coarse: Column,
    fine: Sequence[Column] = (),
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """0-based ``record_index`` per dataset in a stable order."""
    return number_rows(records, [dataset], order, coarse, fine, name="record_index", start=0, hot_rows=hot_rows)


def fetch(records: DataFrame, content: DataFrame, base: str) -> DataFrame:
    """Join triaged, indexed records with landed content.

    ``content`` has ``drive``, ``id``, ``content_sha256``, ``content_length``; hashing
    happened where the bytes are, so only digests are shuffled here. Needs columns
    ``matter``, ``custodian`` and ``record_index`` on the records.
    """
    landed = content.select("drive", "id", "content_sha256", "content_length")
    joined = records.join(landed, ["drive", "id"], "left")
    fetched = (F.col("outcome") == "Ready") & F.col("content_sha256").isNotNull()
    failed = (F.col("outcome") == "Ready") & F.col("content_sha256").isNull()
    target = paths.output_path(
        F.lit(base), F.col("matter"), F.col("custodian"), F.col("record_index"), F.col("file_name")
    )
    return (
        joined.withColumn("bytes_fetched", F.when(fetched, F.col("content_length")).otherwise(F.lit(0)))
        .withColumn("output_path", F.when(F.col("outcome") == "Ready", target))
        .withColumn("error_message", F.when(failed, NO_CONTENT))
        .withColumn(
            "outcome", F.when(fetched, "Success").when(failed, "Failed").otherwise(F.col("outcome"))
        )
    )


def cut_off(results: DataFrame, dataset: str, max_errors: int) -> DataFrame:
    """Adds ``counted``: false for results after the ``max_errors``-th failure of a dataset.

    Only the first failures of each dataset are ranked (Spark keeps at most
    ``max_errors`` per task before the shuffle); the position found is joined back
    as one row per dataset.
    """
    first_failures = Window.partitionBy(dataset).orderBy("record_index")
    stop = (
        results.filter(F.col("outcome") == "Failed")
        .select(dataset, "record_index")
        .withColumn("__nth", F.row_number().over(first_failures))
        .filter(F.col("__nth") <= max_errors)
        .filter(F.col("__nth") == max_errors)
        .select(dataset, F.col("record_index").alias("__stop"))
    )
    return (
        results.join(stop, dataset, "left")
        .withColumn("counted", F.col("__stop").isNull() | (F.col("record_index") <= F.col("__stop")))
        .drop("__stop")
    )


def fetch_summary(results: DataFrame, dataset: str, max_errors: int) -> DataFrame:
    """Totals per dataset; ``total_records`` counts every filtered record, the rest stop at the cut-off."""

    def counted(outcome: str) -> Column:
        return F.count_if(F.col("counted") & (F.col("outcome") == outcome))

    return (
        results.groupBy(dataset)
        .agg(
            F.count(F.lit(1)).alias("total_records"),
            counted("Success").alias("successful"),
            counted("Failed").alias("failed"),
            counted("Skipped").alias("skipped"),
            F.coalesce(F.sum(F.when(F.col("counted"), F.col("bytes_fetched"))), F.lit(0)).alias("total_bytes"),
        )
        .withColumn("success", F.col("failed") < max_errors)
    )


def fetch_manifest(results: DataFrame, collected_utc: Column) -> DataFrame:
    """Manifest entries of the successful, counted results."""
    return results.filter(F.col("counted") & (F.col("outcome") == "Success")).select(
        "custodian",
        F.lit("File").alias("kind"),
        F.col("drive").alias("drive_id"),
        F.col("id").alias("item_id"),
        "path",
        F.col("bytes_fetched").alias("size"),
        F.col("content_sha256").alias("sha256"),
        F.col("output_path").alias("storage_uri"),
        collected_utc.alias("collected_utc"),
        F.col("file.mimeType").alias("mime_type"),
        F.col("lastModifiedDateTime").alias("last_modified"),
    )


def content_inventory(content: DataFrame, keys: Sequence[str], body: str) -> DataFrame:
    """Digest and length per landed document; the body itself does not leave the scan stage."""
    return content.select(
        *keys,
        measures.sha256_hex(F.col(body)).alias("content_sha256"),
        F.octet_length(F.col(body)).cast("long").alias("content_length"),
    )


def duplicate_content(inventory: DataFrame, key: str, digest: str = "content_sha256") -> DataFrame:
    """Digests that occur more than once, how often, and the least key."""
    return (
        inventory.groupBy(digest)
        .agg(F.count(F.lit(1)).alias("copies"), F.min(key).alias("first_key"))
        .filter("copies > 1")
    )
