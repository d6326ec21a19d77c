"""Paths, file names and manifest keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Path segments that hold system copies rather than user files.
SYSTEM_SEGMENTS = ("/recoverableitems/", "/versions/", "/recyclebin/")

# Characters a Windows file name cannot contain.
INVALID_FILE_NAME_CHARS = r'[\x00-\x1f"<>|:*?\\/]'

ISO_SECONDS = "yyyy-MM-dd'T'HH:mm:ss'Z'"
ISO_MILLIS = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"
FIRST_INSTANT = "0001-01-01 00:00:00"


def blank(column: Column) -> Column:
    """True for null and for the empty string, which mean the same in a key."""
    return F.length(F.coalesce(column, F.lit(""))) == 0


def iso_seconds(ts: Column) -> Column:
    return F.date_format(ts, ISO_SECONDS)


def normalize_path(path: Column) -> Column:
    """Backslashes to slashes, all outer slashes stripped, lower case."""
    slashed = F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/"))
    return F.lower(F.trim(slashed, F.lit("/")))


def is_folder(kind: Column, path: Column) -> Column:
    """A folder by kind, or by a trailing slash of the path as given."""
    return F.coalesce(F.lower(kind) == "folder", F.lit(False)) | F.coalesce(
        F.endswith(path, F.lit("/")), F.lit(False)
    )


def is_system_path(path: Column, strict: bool = False) -> Column:
    """True when a system segment occurs inside the normalised path.

    The outer slashes are stripped first, so a system folder at the very top is
    not recognised unless ``strict`` is set.
    """
    normal = normalize_path(path)
    probe = F.concat(F.lit("/"), normal) if strict else normal
    found = F.lit(False)
    for segment in SYSTEM_SEGMENTS:
        found = found | F.contains(probe, F.lit(segment))
    return found


def primary_key(item_id: Column, drive_id: Column, path: Column, size: Column, modified: Column) -> Column:
    """The item id, or drive|path|size|modified when there is none.

    A missing size counts as 0 and a missing date as the first instant of year 1.
    """
    modified_or_first = F.coalesce(modified.cast("timestamp"), F.lit(FIRST_INSTANT).cast("timestamp"))
    fallback = F.concat(
        F.coalesce(drive_id, F.lit("")),
        F.lit("|"),
        F.coalesce(path, F.lit("")),
        F.lit("|"),
        F.coalesce(size, F.lit(0)).cast("string"),
        F.lit("|"),
        iso_seconds(modified_or_first),
    )
    return F.when(blank(item_id), fallback).otherwise(item_id)


def resolved_drive_id(drive_id: Column, parent_reference: Column) -> Column:
    return F.coalesce(drive_id, parent_reference.getField("driveId"))


def resolved_file_name(file_name: Column, name: Column) -> Column:
    return F.coalesce(file_name, name)


def is_file(file_facet: Column, folder_facet: Column) -> Column:
    return file_facet.isNotNull() & folder_facet.isNull()


def file_extension(name: Column) -> Column:
    """The last dot and what follows it, lower case; empty when there is none."""
    return F.lower(F.regexp_extract(name, r"(\.[^./\\]+)$", 1))


def sanitize_file_name(name: Column) -> Column:
    return F.regexp_replace(name, INVALID_FILE_NAME_CHARS, "_")


def sanitize_file_name_drop(name: Column, max_length: int = 100) -> Column:
    return F.substring(F.regexp_replace(name, INVALID_FILE_NAME_CHARS, ""), 1, max_length)


def output_path(base: Column, matter: Column, custodian: Column, index: Column, name: Column) -> Column:
    """base/matter/<matter>/GDC/<custodian>/<six-digit index>_<safe name>"""
    safe = sanitize_file_name(F.coalesce(name, F.lit("unknown_file")))
    return F.concat_ws(
        "/",
        base,
        F.lit("matter"),
        matter,
        F.lit("GDC"),
        custodian,
        F.format_string("%06d_%s", index.cast("long"), safe),
    )


def scope_id(delta_type: Column, email: Column) -> Column:
    return F.concat(F.lower(delta_type), F.lit(":"), F.lower(email))


def shard_identifier(email: Column, start: Column, end: Column) -> Column:
    day = "yyyyMMdd"
    return F.concat_ws(
        "_", F.split(email, "@").getItem(0), F.date_format(start, day), F.date_format(end, day)
    )


def path_custodian(path: Column) -> Column:
    """Last path segment containing ``@``, else ``unknown``."""
    parts = F.reverse(F.filter(F.split(path, "[/\\\\]"), lambda part: F.contains(part, F.lit("@"))))
    return F.coalesce(F.try_element_at(parts, F.lit(1)), F.lit("unknown"))


def path_matter(path: Column) -> Column:
    """Third path segment from the end, else ``DefaultMatter``."""
    parts = F.filter(F.split(path, "[/\\\\]"), lambda part: F.length(part) > 0)
    return F.when(F.size(parts) > 2, F.try_element_at(parts, F.lit(-3))).otherwise("DefaultMatter")
