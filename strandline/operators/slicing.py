"""History compression when single keys hold too many rows for one task.

Keys above a row limit are cut along their order into slices of near equal size by Spark's range
partitioner. Windows then run per key and slice. What a slice has to know of its neighbours is one
row before and one row after it; those are found by an aggregation that leaves two rows per slice and
are copied into the slice, where the windows see them. So the result is the same as without slices,
and no task holds more than about one slice.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import partial, reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.changes import compared_columns
from strandline.operators.history import (
    END,
    START,
    AsOf,
    change_flags,
    close_versions,
    compress_history,
    flag_rows,
    kept_rows,
    key_window,
)
from strandline.scratch import stored

ROWS_PER_SLICE = 5_000_000
# Rows of two whole numbers each that may be broadcast: 16 MB.
BROADCAST_ROWS = 1_000_000
SLICE, PLACE, ROW, COPY = "__slice", "__place", "__row", "__copy"

# (rows, key, order) -> the same rows with change flags
Flag = Callable[[DataFrame, Sequence[str], Sequence[str]], DataFrame]


@dataclass(frozen=True)
class Sliced:
    """Rows of the heavy keys with slice and place, and a bound on the pairs of key and slice."""

    rows: DataFrame
    pairs: int


def heavy_keys(df: DataFrame, key: Sequence[str], limit: int) -> DataFrame:
    """Keys with more than ``limit`` rows. There are at most (rows / limit) of them."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > limit)


def on_key(df: DataFrame, keys: DataFrame, key: Sequence[str], how: str) -> DataFrame:
    """Semi or anti join on the key in which NULL keys match, as they do in grouping."""
    keys = keys.select(*(F.col(f"`{c}`").alias(f"__{c}") for c in key))
    return df.join(keys, reduce(and_, [F.col(f"`{c}`").eqNullSafe(F.col(f"`__{c}`")) for c in key]), how)


def split_heavy(
    df: DataFrame, key: Sequence[str], order: Sequence[str], rows_per_slice: int | None
) -> tuple[DataFrame, Sliced | None]:
    """Rows of the ordinary keys, and the slices of the heavy ones if there are any.

    Runs one aggregation over the key columns; ``rows_per_slice`` None spares it.
    """
    if rows_per_slice is None:
        return df, None
    # Stored before it is looked at, so that what ``df`` comes from is run for it once.
    heavy = stored(heavy_keys(df, key, rows_per_slice), "heavy-keys")
    found = heavy.agg(F.count(F.lit(1)).alias("keys"), F.sum("rows").alias("rows")).first()
    if found["keys"] == 0:
        return df, None
    slices = -(-found["rows"] // rows_per_slice)
    rows = cut_into_slices(on_key(df, heavy, key, "left_semi"), key, order, slices)
    # Each slice shares at most one key with the next, so this bounds the pairs.
    return on_key(df, heavy, key, "left_anti"), Sliced(rows, slices + found["keys"])


def cut_into_slices(df: DataFrame, key: Sequence[str], order: Sequence[str], slices: int) -> DataFrame:
    """Rows with a slice number and a place, fixed by a write.

    Slices are contiguous in (key, order) and near equal in size; places are numbers that stand for
    (key, order) from here on. The row id makes rows that tie on everything else separable, copies too;
    it is fixed by a write of its own, since a repeated task may see its input in another order.
    """
    numbered = stored(df.withColumn(ROW, F.monotonically_increasing_id()), "numbered")
    ranged = numbered.repartitionByRange(slices, *key, *order, ROW).sortWithinPartitions(*key, *order, ROW)
    # After the sort this counts up within a partition and from one partition to the next.
    placed = ranged.drop(ROW).withColumns({SLICE: F.spark_partition_id(), PLACE: F.monotonically_increasing_id()})
    return stored(placed, "slices")


def with_copies(rows: DataFrame, wanted: DataFrame, most: int) -> DataFrame:
    """Rows plus a marked copy of each row whose place is wanted in another slice.

    ``wanted`` has columns slice and place, and at most ``most`` rows; it is broadcast if that is few.
    """
    wanted = wanted.select(F.col(SLICE).alias("__for"), F.col("place").alias("__wanted"))
    if most <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    copies = rows.join(wanted, rows[PLACE] == wanted["__wanted"])
    copies = copies.withColumn(SLICE, F.col("__for")).select(*rows.columns)
    return rows.withColumn(COPY, F.lit(False)).unionByName(copies.withColumn(COPY, F.lit(True)))


def each_place(df: DataFrame, *columns: str) -> DataFrame:
    """One row per slice and place out of the given columns."""
    places = F.array_distinct(F.array_compact(F.array(*columns)))
    return df.select(SLICE, F.explode(places).alias("place"))


def without_copies(df: DataFrame) -> DataFrame:
    return df.filter(~F.col(COPY)).drop(COPY)


def flags_in_slices(sliced: Sliced, key: Sequence[str], flag: Flag) -> DataFrame:
    """All rows with their flags.

    Those of a slice's outer rows need the last row before it and the first row after it.
    """
    slice_key, place = [*key, SLICE], F.col(PLACE)
    across = Window.partitionBy(*key).orderBy(SLICE)
    edges = sliced.rows.groupBy(*slice_key).agg(F.min(place).alias("first"), F.max(place).alias("last"))
    edges = edges.select(SLICE, F.lag("last").over(across).alias("a"), F.lead("first").over(across).alias("b"))
    seen = with_copies(sliced.rows, each_place(edges, "a", "b"), 2 * sliced.pairs)
    return without_copies(flag(seen, slice_key, [PLACE]))


def kept_in_slices(sliced: Sliced, key: Sequence[str], flag: Flag) -> DataFrame:
    """Rows that start or end a run of equal values, fixed by a write."""
    return stored(kept_rows(flags_in_slices(sliced, key, flag)), "kept-rows")


def close_in_slices(
    kept: DataFrame, pairs: int, key: Sequence[str], time: str, as_of: AsOf, open_flag: str | None
) -> DataFrame:
    """Versions of the kept rows.

    Closing a slice's last ones needs the next kept row and the next start row, however many slices ahead.
    """
    slice_key, place = [*key, SLICE], F.col(PLACE)
    heads = kept.groupBy(*slice_key).agg(
        F.min(place).alias("kept"), F.min(F.when(F.col(START), place)).alias("start")
    )
    ahead = Window.partitionBy(*key).orderBy(F.desc(SLICE)).rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select(SLICE, F.min("kept").over(ahead).alias("a"), F.min("start").over(ahead).alias("b"))
    seen = with_copies(kept, each_place(heads, "a", "b"), 2 * pairs)
    closed = close_versions(seen, time, key_window(slice_key, [PLACE]), as_of, open_flag)
    return without_copies(closed).drop(SLICE, PLACE)


def tail_of_slices(kept: DataFrame, key: Sequence[str]) -> DataFrame:
    """Each key's rows from its last start on."""
    last = kept.filter(START).groupBy(*key).agg(F.max(PLACE).alias("__from"))
    last = last.select(*(F.col(f"`{c}`").alias(f"__{c}") for c in key), "__from")
    same = reduce(and_, [F.col(f"`{c}`").eqNullSafe(F.col(f"`__{c}`")) for c in key])
    return kept.join(last, same & (F.col(PLACE) >= F.col("__from")), "left_semi").drop(SLICE, PLACE)


def change_flags_sliced(
    df: DataFrame,
    key: Sequence[str],
    order: Sequence[str],
    columns: Sequence[str],
    *,
    null_mode: str = "reference",
    start_name: str = "is_start",
    end_name: str = "is_end",
    rows_per_slice: int | None = ROWS_PER_SLICE,
) -> DataFrame:
    """Same result as :func:`change_flags`, with no bound on the rows of one key."""
    names = {"start_name": start_name, "end_name": end_name}
    light, sliced = split_heavy(df, key, order, rows_per_slice)
    plain = change_flags(light, key, order, columns, null_mode=null_mode, **names)
    if sliced is None:
        return plain
    flag = partial(flag_rows, compared=columns, null_mode=null_mode)
    heavy = flags_in_slices(sliced, key, flag).drop(SLICE, PLACE)
    return plain.unionByName(heavy.withColumnsRenamed({START: start_name, END: end_name}))


def compress_history_sliced(
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
    rows_per_slice: int | None = ROWS_PER_SLICE,
) -> DataFrame:
    """Same result as :func:`compress_history`, with no bound on the rows of one key.

    Without heavy keys the plain plan is returned; ``rows_per_slice`` None asks for it unseen.
    """
    order = [*order, *tie_breaker]
    light, sliced = split_heavy(df, key, order, rows_per_slice)
    plain = compress_history(
        light, key, order, time, ignored, as_of=as_of, null_mode=null_mode, open_flag=open_flag
    )
    if sliced is None:
        return plain
    compared = compared_columns(df, key, order, ignored)
    kept = kept_in_slices(sliced, key, partial(flag_rows, compared=compared, null_mode=null_mode))
    return plain.unionByName(close_in_slices(kept, sliced.pairs, key, time, as_of, open_flag))
