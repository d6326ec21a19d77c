"""Hashes, sizes, rates, estimates and error classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GIB = 1024 * 1024 * 1024

# Estimated bytes and items by job type; any other type is 1 GiB and 1000 items.
SIZE_ESTIMATES = {
    "Email": (5 * GIB, 10_000),
    "OneDrive": (10 * GIB, 5_000),
    "SharePoint": (20 * GIB, 15_000),
    "Teams": (2 * GIB, 20_000),
    "Mixed": (25 * GIB, 30_000),
}
DEFAULT_ESTIMATE = (1 * GIB, 1_000)

# Least minutes and minutes per day by job type; any other type is 30 minutes.
DURATION_ESTIMATES = {
    "Email": (30, 2.0),
    "OneDrive": (45, 3.0),
    "SharePoint": (60, 4.0),
    "Teams": (20, 1.5),
    "Mixed": (90, 5.0),
}
DEFAULT_DURATION_MINUTES = 30

# Words that mark a transport error as worth a retry.
RETRYABLE_WORDS = ("timeout", "connection", "network")


def sha256_hex(value: Column) -> Column:
    return F.sha2(value, 256)


def ratio(top: Column, bottom: Column, empty: float = 0.0) -> Column:
    """``top / bottom`` with a fixed answer when there is nothing to divide by."""
    return F.when(bottom > 0, top.cast("double") / bottom).otherwise(F.lit(empty))


def estimate_message_size(subject: Column, preview: Column) -> Column:
    """Two bytes a character plus 1024 for headers (characters are code points)."""
    chars = F.coalesce(F.length(subject), F.lit(0)) + F.coalesce(F.length(preview), F.lit(0))
    return (chars * 2 + 1024).cast("long")


def join_recipients(recipients: Column) -> Column:
    """Addresses of an array of structs with an ``address`` field, joined by ``;``."""
    addresses = F.transform(recipients, lambda r: F.coalesce(r.getField("address"), F.lit("")))
    return F.coalesce(F.array_join(addresses, ";"), F.lit(""))


def items_per_second(items: Column, duration_ms: Column) -> Column:
    return ratio(items * 1000.0, duration_ms)


def megabytes_per_second(size_bytes: Column, duration_ms: Column) -> Column:
    return ratio(size_bytes / 1024.0 / 1024.0 * 1000.0, duration_ms)


def average_item_size(total_bytes: Column, items: Column) -> Column:
    return ratio(total_bytes, items)


def duration_seconds(start: Column, end: Column) -> Column:
    return (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 1e6


def whole_days(start: Column, end: Column) -> Column:
    """Days between two instants, truncated towards zero."""
    seconds = duration_seconds(start, end)
    return F.when(seconds >= 0, F.floor(seconds / 86400)).otherwise(F.ceil(seconds / 86400)).cast("long")


def progress_percentage(processed: Column, estimated: Column, previous: Column) -> Column:
    """Capped at 100; unchanged when nothing was estimated."""
    percent = F.least(F.lit(100.0), processed.cast("double") / estimated * 100)
    return F.when(estimated > 0, percent).otherwise(previous)


def request_priority(job_type: Column, start: Column, end: Column, as_of: Column) -> Column:
    """High for mail of at most seven days and for chat, Medium for mixed, else Normal."""
    days = whole_days(F.coalesce(start, as_of), end)
    return (
        F.when((job_type == "Email") & (days <= 7), "High")
        .when(job_type == "Teams", "High")
        .when(job_type == "Mixed", "Medium")
        .otherwise("Normal")
    )


def estimated_minutes(job_type: Column, start: Column, end: Column, as_of: Column) -> Column:
    """Duration estimate in minutes; an open range means the thirty days before ``as_of``."""
    begin = F.coalesce(start, as_of - F.expr("INTERVAL 30 DAYS"))
    days = whole_days(begin, F.coalesce(end, as_of))
    minutes = F.lit(float(DEFAULT_DURATION_MINUTES))
    for name, (least, per_day) in DURATION_ESTIMATES.items():
        minutes = F.when(
            job_type == name, F.greatest(F.lit(float(least)), days * F.lit(per_day))
        ).otherwise(minutes)
    return minutes


def estimated_bytes(job_type: Column) -> Column:
    value = F.lit(DEFAULT_ESTIMATE[0]).cast("long")
    for name, (size, _) in SIZE_ESTIMATES.items():
        value = F.when(job_type == name, F.lit(size).cast("long")).otherwise(value)
    return value


def estimated_items(job_type: Column) -> Column:
    value = F.lit(DEFAULT_ESTIMATE[1]).cast("long")
    for name, (_, items) in SIZE_ESTIMATES.items():
        value = F.when(job_type == name, F.lit(items).cast("long")).otherwise(value)
    return value


def is_retryable(status_code: Column, message: Column) -> Column:
    """429 and 5xx answers, or a transport message naming a network cause."""
    by_status = (status_code == 429) | ((status_code >= 500) & (status_code < 600))
    text = F.lower(F.coalesce(message, F.lit("")))
    by_text = F.lit(False)
    for word in RETRYABLE_WORDS:
        by_text = by_text | F.contains(text, F.lit(word))
    return F.coalesce(by_status, F.lit(False)) | by_text


# The five checkpoint payload shapes merged into one schema.
CHECKPOINT_PAYLOAD = """
    FolderId string, FolderName string, DriveId string, SiteId string, ListId string,
    TeamId string, ChannelId string, BatchType string, BatchSize int, BatchContext string,
    DeltaToken string, LastProcessedTime timestamp, LastProcessedFolderId string,
    ItemsProcessedInFolder long, ItemsProcessedInDrive long, ItemsProcessedInList long,
    ItemsProcessedInChannel long,
    ProcessedMessageIds array<string>, ProcessedFileIds array<string>, ProcessedItemIds array<string>
"""


def checkpoint_payload(data: Column) -> Column:
    """Checkpoint JSON as one struct with the container, token and count of its kind."""
    raw = F.from_json(data, CHECKPOINT_PAYLOAD)
    field = raw.getField
    container = F.coalesce(
        field("FolderId"),
        field("DriveId"),
        F.concat(field("SiteId"), F.lit("/"), field("ListId")),
        F.concat(field("TeamId"), F.lit("/"), field("ChannelId")),
        field("BatchType"),
    )
    processed = F.coalesce(
        field("ItemsProcessedInFolder"),
        field("ItemsProcessedInDrive"),
        field("ItemsProcessedInList"),
        field("ItemsProcessedInChannel"),
        field("BatchSize").cast("long"),
    )
    ids = F.coalesce(field("ProcessedMessageIds"), field("ProcessedFileIds"), field("ProcessedItemIds"))
    return F.struct(
        container.alias("container"),
        field("DeltaToken").alias("delta_token"),
        field("LastProcessedTime").alias("last_processed_time"),
        processed.alias("items_processed"),
        ids.alias("processed_ids"),
    )
