"""Partition keys as text, integers and dates."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

# The partition key as text, as directory name, and as long window bound.
KEY_FORMAT = "yyyy-MM-dd"
DIRECTORY_FORMAT = "yyyyMMdd"
WINDOW_FORMAT = "yyyyMMddHHmmss"


def decode_partition(col: Column | str) -> Column:
    """``20220101`` (integer or text) to a date; NULL where the directory name is no date."""
    return F.try_to_date(F.col(col).cast("string") if isinstance(col, str) else col.cast("string"), DIRECTORY_FORMAT)


def encode_partition(col: Column | str) -> Column:
    """A date to the integer used as directory name."""
    return F.date_format(col, DIRECTORY_FORMAT).cast("int")


def partition_key(col: Column | str) -> Column:
    """A date to the partition key text ``2022-01-01``."""
    return F.date_format(col, KEY_FORMAT)


def window_label(start: Column | str) -> Column:
    """Text of the half-open day window that starts at ``start``: ``20220101000000_20220102000000``."""
    day = F.to_date(start)
    return F.concat_ws("_", F.date_format(day, WINDOW_FORMAT), F.date_format(F.date_add(day, 1), WINDOW_FORMAT))


def next_day(key: Column | str) -> Column:
    """The day after a partition key given as text or date."""
    return F.date_add(F.to_date(key), 1)


def directory_value(day: date) -> int:
    """Directory name of one day, for literals in filters."""
    return int(day.strftime("%Y%m%d"))


def calendar(start: date, end: date) -> Column:
    """Array of the days in the half-open window ``[start, end)``."""
    if end <= start:
        return F.array().cast("array<date>")
    return F.sequence(F.lit(start), F.lit(end - timedelta(days=1)), F.expr("interval 1 day"))
