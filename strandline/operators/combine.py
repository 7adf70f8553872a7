"""Point-in-time combination of histories."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.operators.slicing import (
    PLACE,
    ROWS_PER_SLICE,
    SLICE,
    Sliced,
    each_place,
    split_heavy,
    with_copies,
    without_copies,
)
from strandline.scratch import stored

VALIDITY = ("valid_from", "valid_to")
AT, SIDE = "__at", "__side"


def attributes(df: DataFrame, key: Sequence[str]) -> list[str]:
    return df.drop(*key, *VALIDITY).columns


def distinct_attributes(left: DataFrame, right: DataFrame, key: Sequence[str]) -> tuple[list[str], list[str]]:
    ours, theirs = attributes(left, key), attributes(right, key)
    shared = {c.lower() for c in ours} & {c.lower() for c in theirs}
    if shared:
        raise ValueError(f"both histories have columns {sorted(shared)}; rename them first")
    return ours, theirs


def join_overlap(left: DataFrame, right: DataFrame, key: Sequence[str]) -> DataFrame:
    """The pairs of :func:`combine_overlap` for any intervals, as an equi-join on the key.

    Within a key it compares all versions with all, also for intervals that are no history.
    """
    ours, theirs = distinct_attributes(left, right, key)
    start, end = F.greatest("valid_from", "__from"), F.least("valid_to", "__to")
    other = right.withColumnsRenamed({"valid_from": "__from", "valid_to": "__to"})
    together = (F.col("valid_from") <= F.col("__to")) & (F.col("__from") <= F.col("valid_to"))
    found = left.join(other, list(key)).filter(together)
    return found.select(*key, *ours, *theirs, start.alias("valid_from"), end.alias("valid_to"))


def combine_overlap(
    left: DataFrame, right: DataFrame, key: Sequence[str], *, rows_per_slice: int | None = ROWS_PER_SLICE
) -> DataFrame:
    """Pairs of versions of the same key that were valid at a common time, with the common interval."""
    return combine_histories([left, right], key, rows_per_slice=rows_per_slice)


def combine_histories(
    histories: Sequence[DataFrame], key: Sequence[str], *, rows_per_slice: int | None = ROWS_PER_SLICE
) -> DataFrame:
    """Sets of versions, one of each history, of the same key that were valid at a common time.

    The version of a set that starts last starts while the others are valid. So all histories are merged into one
    time line per key, and each version looks back at the versions of the others that started before it. Versions of
    one history that start together are one entry of the line. Within a history a version ends at the latest when
    the next one starts, and that may be the same time, so of each other history the last two entries are all that
    can still be valid. That is one sort per key, however many histories there are, instead of comparing all pairs.

    The inputs are histories as made by ``compress_history``: key, ``valid_from`` and ``valid_to``; a result of this
    function is one too. Their other columns must not share names. As in any join, NULL keys match nothing.

    With dates, a key has at most one entry per history and day. With times there is no such bound, so keys
    with more than ``rows_per_slice`` entries are cut into slices.
    """
    if len(histories) == 1:
        return histories[0].dropna(subset=list(key))
    for one, other in combinations(histories, 2):
        distinct_attributes(one, other, key)
    columns = [attributes(df, key) for df in histories]
    sides = [_entries(df, key, columns[i], i) for i, df in enumerate(histories)]
    line = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sides)
    sliced = None
    if rows_per_slice is not None and not isinstance(line.schema[AT].dataType, T.DateType):
        # Stored before its keys are counted: what the histories come from is run once.
        line, sliced = split_heavy(stored(line, "time-line"), key, [AT, SIDE], rows_per_slice)
    found = _sets(_look_back(line, key, [AT, SIDE], len(sides)), key, columns)
    if sliced is not None:
        found = found.unionByName(_sets(_look_back_in_slices(sliced, key, len(sides)), key, columns))
    return found


def _own(side: int) -> str:
    return f"__v{side}"


def _back(side: int, how_far: int) -> str:
    return f"__v{side}_{how_far}"


def _entries(df: DataFrame, key: Sequence[str], columns: Sequence[str], side: int) -> DataFrame:
    """The versions of a history that start together, as an array."""
    version = F.struct(*VALIDITY, *(F.col(f"`{c}`") for c in columns))
    grouped = df.dropna(subset=list(key)).groupBy(*key, F.col("valid_from").alias(AT))
    return grouped.agg(F.collect_list(version).alias(_own(side))).withColumn(SIDE, F.lit(side))


def _look_back(line: DataFrame, key: Sequence[str], order: Sequence[str], sides: int) -> DataFrame:
    """Add to each entry the last and the last but one entry of every history that came before it."""
    earlier = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)

    def latest(value: Column) -> Column:
        return F.last(value, ignorenulls=True).over(earlier)

    line = line.withColumns({_back(i, 1): latest(F.col(_own(i))) for i in range(sides)})
    second = lambda i: F.when(F.col(_own(i)).isNotNull(), F.struct(F.col(_back(i, 1)).alias("back")))
    return line.withColumns({_back(i, 2): latest(second(i))["back"] for i in range(sides)})


def _look_back_in_slices(sliced: Sliced, key: Sequence[str], sides: int) -> DataFrame:
    """The same per slice, after copying in the last two entries of every history from earlier slices."""
    slice_key = [*key, SLICE]
    newest = Window.partitionBy(*slice_key, SIDE).orderBy(F.desc(PLACE))
    ends = sliced.rows.select(*slice_key, SIDE, PLACE).withColumn("n", F.row_number().over(newest)).filter("n <= 2")
    # The entry before a slice's last one is in the same slice, or the last one of an earlier slice.
    before = F.lag(PLACE).over(Window.partitionBy(*key, SIDE).orderBy(PLACE))
    ends = ends.withColumn("before", before).filter("n = 1")
    two = F.struct(F.col(PLACE).alias("last"), "before")
    names = [f"e{i}" for i in range(sides)]
    ends = ends.groupBy(*slice_key).agg(*(F.max(F.when(F.col(SIDE) == i, two)).alias(n) for i, n in enumerate(names)))
    earlier = Window.partitionBy(*key).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(SLICE, *(F.last(n, ignorenulls=True).over(earlier).alias(n) for n in names))
    wanted = each_place(ends, *(f"{n}.{part}" for n in names for part in ("last", "before")))
    seen = with_copies(sliced.rows, wanted, 2 * sides * sliced.pairs)
    return without_copies(_look_back(seen, slice_key, [PLACE], sides))


def _sets(line: DataFrame, key: Sequence[str], columns: Sequence[Sequence[str]]) -> DataFrame:
    """The versions of each entry with those it found of every other history, where all are valid at once."""
    sides = range(len(columns))
    chosen: list[str] = []
    found = line
    for i in sides:
        none = F.array().cast(line.schema[_own(i)].dataType)
        seen = F.concat(F.coalesce(_back(i, 1), none), F.coalesce(_back(i, 2), none))
        found = found.withColumn(f"__x{i}", F.explode(F.when(F.col(SIDE) == i, F.col(_own(i))).otherwise(seen)))
        x = F.col(f"__x{i}")
        for other in chosen:
            y = F.col(other)
            found = found.filter((x["valid_from"] <= y["valid_to"]) & (y["valid_from"] <= x["valid_to"]))
        chosen.append(f"__x{i}")
    return found.select(
        *key,
        *(F.col(x)[c].alias(c) for x, own in zip(chosen, columns, strict=True) for c in own),
        F.greatest(*(F.col(x)["valid_from"] for x in chosen)).alias("valid_from"),
        F.least(*(F.col(x)["valid_to"] for x in chosen)).alias("valid_to"),
    )
