"""Checks on a column: the failing values with their number of rows. No row means the check passed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unique(df: DataFrame, column: str) -> DataFrame:
    """Values that occur more than once; NULLs are not compared."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n_rows"))
    return counts.filter(F.col("n_rows") > 1)


def not_null(df: DataFrame, column: str) -> DataFrame:
    """Rows without a value."""
    return df.filter(F.col(column).isNull())


def run_checks(tables: dict[str, DataFrame], checks: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Number of failures per ``(table, column, check)``, in one frame."""
    known = {"unique": unique, "not_null": not_null}
    parts = [
        known[check](tables[table], column)
        .agg(F.count(F.lit(1)).alias("failures"))
        .select(
            F.lit(table).alias("table"), F.lit(column).alias("column"), F.lit(check).alias("check"), "failures"
        )
        for table, column, check in checks
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result
