"""Path functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def extension(path: Column) -> Column:
    """Lower-cased, after the last dot if that follows the last slash or backslash; else empty."""
    return F.lower(F.regexp_extract(path, r"\.([^./\\]*)$", 1))


def filename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def directory(path: Column) -> Column:
    """Before the last slash; "." without one."""
    return F.when(path.rlike(r"[/\\]"), F.regexp_replace(path, r"[/\\][^/\\]*$", "")).otherwise(F.lit("."))


def change_extension(path: Column, ext: Column) -> Column:
    return F.concat(F.regexp_replace(path, r"\.[^./\\]*$", ""), F.lit("."), ext)
