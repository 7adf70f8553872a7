"""SCD2 history compression.

For each key, rows are put in order and one row per attribute change is kept, with ``valid_from`` and
an inclusive ``valid_to``: the last time the value was seen, or ``as_of`` for a key's last version.

All windows share one partitioning and one order, so Spark plans a single shuffle and a single sort
for the three of them. Each neighbour is read once, as a struct of the compared columns; the rows are
clustered before that struct is built, so that it is neither shuffled nor sorted.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from strandline.functions.changes import any_of, compared_columns, differs

START, END = "__start", "__end"
PREVIOUS, FOLLOWING = "__previous", "__following"

AsOf = date | datetime | Column | None


def key_window(key: Sequence[str], order: Sequence[str]) -> WindowSpec:
    """Rows of one key in ascending order, NULLs first."""
    return Window.partitionBy(*key).orderBy(*order)


def with_neighbours(df: DataFrame, key: Sequence[str], order: Sequence[str], compared: Sequence[str]) -> DataFrame:
    """Add the compared columns of the row before and the row after, each as one struct."""
    window, values = key_window(key, order), F.struct(*compared)
    clustered = df.repartition(*key).sortWithinPartitions(*key, *order)
    return clustered.select(
        "*", F.lag(values).over(window).alias(PREVIOUS), F.lead(values).over(window).alias(FOLLOWING)
    )


def flag_columns(compared: Sequence[str], null_mode: str) -> tuple[Column, Column]:
    """Change-start and change-end flags for rows that carry their neighbours."""
    changed = differs(null_mode)

    def flag(neighbour: str) -> Column:
        struct = F.col(neighbour)
        return any_of(changed(F.col(f"`{c}`"), struct[c], struct.isNotNull()) for c in compared)

    return flag(PREVIOUS), flag(FOLLOWING)


def flag_rows(
    df: DataFrame, key: Sequence[str], order: Sequence[str], compared: Sequence[str], null_mode: str
) -> DataFrame:
    start, end = flag_columns(compared, null_mode)
    rows = with_neighbours(df, key, order, compared)
    return rows.withColumns({START: start, END: end}).drop(PREVIOUS, FOLLOWING)


def change_flags(
    df: DataFrame,
    key: Sequence[str],
    order: Sequence[str],
    columns: Sequence[str],
    *,
    null_mode: str = "reference",
    start_name: str = "is_start",
    end_name: str = "is_end",
) -> DataFrame:
    """Add to each row whether its values start, and whether they end, a run of equal values."""
    flagged = flag_rows(df, key, order, columns, null_mode)
    return flagged.withColumnsRenamed({START: start_name, END: end_name})


def open_end(df: DataFrame, time: str, as_of: AsOf) -> Column:
    """The open end as a column of the time column's type; today if not given."""
    if as_of is None:
        return F.current_date().cast(df.schema[time].dataType)
    value = as_of if isinstance(as_of, Column) else F.lit(as_of)
    return value.cast(df.schema[time].dataType)


def kept_rows(flagged: DataFrame) -> DataFrame:
    """Rows that start or end a run of equal values; a NULL flag counts as no."""
    return flagged.filter(F.col(START) | F.col(END))


def close_versions(
    kept: DataFrame, time: str, window: WindowSpec, as_of: AsOf, open_flag: str | None
) -> DataFrame:
    """From the kept rows to versions: the start rows with their ``valid_to``.

    The next time is taken twice on purpose: first among all kept rows, then among the starts only.
    """
    next_time = F.lead(time).over(window)
    starts = kept.withColumn("valid_to", F.when(F.col(END), F.col(time)).otherwise(next_time)).filter(START)
    last = next_time.isNull()
    added = {"valid_to": F.when(last, open_end(kept, time, as_of)).otherwise(F.col("valid_to"))}
    if open_flag:
        added[open_flag] = last
    return starts.withColumns(added).withColumnRenamed(time, "valid_from").drop(START, END)


def compress_history(
    df: DataFrame,
    key: Sequence[str],
    order: Sequence[str],
    time: str,
    ignored: Sequence[str] = (),
    *,
    as_of: AsOf = None,
    null_mode: str = "reference",
    tie_breaker: Sequence[str] = (),
    open_flag: str | None = None,
) -> DataFrame:
    """One row per key and attribute change, with ``valid_from`` and ``valid_to``.

    ``ignored`` columns are not compared and keep the values of a version's first row. Rows that tie on
    ``order`` within a key come out in no fixed order; name a ``tie_breaker`` to make it fixed.
    ``open_flag`` adds a boolean column of that name, true for each key's last version.

    A key's rows are sorted in one task. That is safe where the order is a date without ties, since the
    calendar bounds the group; otherwise use :func:`strandline.operators.slicing.compress_history_sliced`.
    """
    order = [*order, *tie_breaker]
    compared = compared_columns(df, key, order, ignored)
    kept = kept_rows(flag_rows(df, key, order, compared, null_mode))
    return close_versions(kept, time, key_window(key, order), as_of, open_flag)


def order_violations(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Groups of rows that tie on key and order, with their size; empty if the history is well defined."""
    return df.groupBy(*key, *order).agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > 1)
