"""Mail and drive items: filters and projection to collected items."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casetrail.functions import measures, paths


def mail_filter(
    messages: DataFrame,
    start: Column | None = None,
    end: Column | None = None,
    keywords: Sequence[str] = (),
) -> DataFrame:
    """Received in [start, end] and any keyword in subject or preview, without case."""
    kept = messages
    if start is not None:
        kept = kept.filter(F.col("received") >= start)
    if end is not None:
        kept = kept.filter(F.col("received") <= end)
    if keywords:
        subject = F.lower(F.coalesce("subject", F.lit("")))
        preview = F.lower(F.coalesce("preview", F.lit("")))
        hit = F.lit(False)
        for word in keywords:
            hit = hit | F.contains(subject, F.lit(word.lower())) | F.contains(preview, F.lit(word.lower()))
        kept = kept.filter(hit)
    return kept


def drive_files(drive_items: DataFrame) -> DataFrame:
    """Drive items that are files."""
    return drive_items.filter(F.col("file").isNotNull())


def _item_path(base: str, owner: Column, folder: str, name: Column) -> Column:
    return F.concat_ws("/", F.lit(base), owner, F.lit(folder), paths.sanitize_file_name_drop(name))


def mail_items(messages: DataFrame, base: str) -> DataFrame:
    """Messages (``id``, ``subject``, ``sender``, ``recipients``, ``received``, ``preview``,
    ``custodian``) as collected items. The hash covers the message as one JSON object."""
    body = F.to_json(F.struct("id", "subject", "sender", "recipients", "received", "preview"))
    file_name = F.concat(F.col("id"), F.lit("_"), F.coalesce("subject", F.lit("")), F.lit(".json"))
    return messages.select(
        F.coalesce("id", F.lit("")).alias("item_id"),
        F.lit("Email").alias("item_type"),
        "subject",
        F.col("sender").alias("sender"),
        measures.join_recipients(F.col("recipients")).alias("recipients"),
        F.col("received").alias("item_date"),
        measures.estimate_message_size(F.col("subject"), F.col("preview")).alias("size_bytes"),
        _item_path(base, F.col("custodian"), "Email", file_name).alias("file_path"),
        measures.sha256_hex(body).alias("sha256"),
        "custodian",
    )


def drive_item_rows(drive_items: DataFrame, base: str) -> DataFrame:
    """Drive files (``id``, ``name``, ``size``, ``lastModifiedDateTime``, ``file``, ``custodian``)
    as collected items; only metadata is hashed."""
    body = F.to_json(F.struct("id", "name", "size", "lastModifiedDateTime", "file"))
    file_name = F.concat(F.col("id"), F.lit("_"), F.coalesce("name", F.lit("")), F.lit("_metadata.json"))
    return drive_files(drive_items).select(
        F.coalesce("id", F.lit("")).alias("item_id"),
        F.lit("File").alias("item_type"),
        F.col("name").alias("subject"),
        F.lit(None).cast("string").alias("sender"),
        F.lit(None).cast("string").alias("recipients"),
        F.col("lastModifiedDateTime").alias("item_date"),
        F.coalesce("size", F.lit(0)).cast("long").alias("size_bytes"),
        _item_path(base, F.col("custodian"), "OneDrive", file_name).alias("file_path"),
        measures.sha256_hex(body).alias("sha256"),
        "custodian",
    )
