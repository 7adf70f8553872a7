"""Change predicates between neighbouring versions of a row."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame

NULL_MODES = ("reference", "distinct")


def compared_columns(df: DataFrame, *excluded: Sequence[str]) -> list[str]:
    """Columns of ``df`` without key, order and ignored ones, in their order."""
    return df.drop(*(name for group in excluded for name in group)).columns


def any_of(predicates: Iterable[Column]) -> Column:
    """Three-valued OR over at least one predicate."""
    found = list(predicates)
    if not found:
        raise ValueError("no columns left to compare: every column is key, order or ignored")
    return reduce(or_, found)


def differs(null_mode: str) -> Callable[[Column, Column, Column], Column]:
    """Predicate ``(current, neighbour, neighbour_exists) -> changed``.

    ``reference``: ``current <> neighbour OR neighbour IS NULL`` in three-valued logic. A value turning
    NULL is no change (the predicate is NULL), and every row next to a NULL is one.
    ``distinct``: NULL is a value like any other; a row without neighbour is a change.
    """
    if null_mode == "reference":
        return lambda current, neighbour, _: (current != neighbour) | neighbour.isNull()
    if null_mode == "distinct":
        return lambda current, neighbour, exists: ~exists | ~current.eqNullSafe(neighbour)
    raise ValueError(f"null_mode must be one of {NULL_MODES}, not {null_mode!r}")
