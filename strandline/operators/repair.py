"""Late days: repair of a stored history around them, per key.

A row that comes late, or goes, changes the flags of its neighbours in the key's order and so no more than the versions
between the last start before it and the second start after it:

* the last start before the late days keeps its own neighbour before it, so it stays a start, and what ends before it
  stays as it was;
* the second start after them follows a row that is later than them, so it stays a start as well, and closes what is
  before it.

The landing rows of the touched keys between these two starts are compressed anew, and their versions take the place of
those that began there. Where there is no second start the key's open version, and with it its tail, is new too.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.operators.history import key_window

FROM, BEFORE = "__from", "__before"


def same_key(df: DataFrame, other: DataFrame, key: Sequence[str]) -> tuple[DataFrame, Column]:
    """``other`` with its key columns renamed, and the condition that keys are equal; NULL keys are one key."""
    names = {c: f"__of_{c}" for c in key}
    return other.withColumnsRenamed(names), reduce(and_, [F.col(f"`{c}`").eqNullSafe(F.col(f"`{n}`")) for c, n in names.items()])


def windows(versions: DataFrame, touched: DataFrame, key: Sequence[str], time: str) -> DataFrame:
    """Per touched key, the first time to compress anew (``__from``) and the start to stop at (``__before``, NULL if none).

    ``touched`` has the key and time of every row that is new, changed or gone; ``versions`` are those in force.
    """
    span = touched.groupBy(*key).agg(F.min(time).alias("__first"), F.max(time).alias("__last"))
    starts = versions.select(*key, "valid_from")
    keys, equal = same_key(starts, span.select(*key), key)
    starts = starts.join(keys, equal, "left_semi")
    starts = starts.withColumn("__second", F.lead("valid_from").over(key_window(key, ["valid_from"])))
    starts, equal = same_key(span, starts, key)
    found = span.join(starts, equal, "left").groupBy(*key, "__first").agg(
        F.max(F.when(F.col("valid_from") < F.col("__first"), F.col("valid_from"))).alias(FROM),
        F.min(F.when(F.col("valid_from") > F.col("__last"), F.col("__second"))).alias(BEFORE),
    )
    return found.select(*key, F.coalesce(FROM, "__first").alias(FROM), BEFORE)


def inside(df: DataFrame, within: DataFrame, key: Sequence[str], time: str, how: str, *, closed: bool) -> DataFrame:
    """Join of rows with the window of their key that they lie in; ``closed`` takes the start that it stops at too."""
    within, equal = same_key(df, within, key)
    at, stop = F.col(f"`{time}`"), F.col(BEFORE)
    low = stop.isNull() | ((at <= stop) if closed else (at < stop))
    return df.join(within, equal & (at >= F.col(FROM)) & low, how)


def rows_to_compress(rows: DataFrame, within: DataFrame, key: Sequence[str], time: str) -> DataFrame:
    """The landing rows in the windows, with ``__before``. Only the days that some window covers are read."""
    # One row.
    low, high, open_ended = within.agg(F.min(FROM), F.max(BEFORE), F.bool_or(F.col(BEFORE).isNull())).first()
    if low is None:
        return rows.limit(0).withColumn(BEFORE, F.col(time))
    rows = rows.filter(F.col(time) >= F.lit(low))
    if not open_ended:
        rows = rows.filter(F.col(time) <= F.lit(high))
    return inside(rows, within, key, time, "inner", closed=True).select(*(f"`{c}`" for c in rows.columns), BEFORE)


def without_keys(df: DataFrame, keys: DataFrame, key: Sequence[str]) -> DataFrame:
    others, equal = same_key(df, keys.select(*key), key)
    return df.join(others, equal, "left_anti")
