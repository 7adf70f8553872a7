"""Seeded synthetic rows, and the CSV sink used to hand rows to a landing zone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS = 10_000_000


def synthetic_rows(spark: SparkSession, rows: int = ROWS, seed: int = 42) -> DataFrame:
    """``foo`` constant, ``bar_col`` and ``baz_col`` uniform in [0, 1)."""
    drawn = spark.range(rows).select(F.rand(seed), F.rand(seed + 1), F.lit("foo"))
    return drawn.toDF("baz_col", "bar_col", "foo").select("foo", "bar_col", "baz_col")


# CSV as pandas reads it by default, and times to the microsecond.
CSV_FORMAT = {
    "header": "true",
    "quote": '"',
    "escape": '"',
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}


def write_csv(df: DataFrame, path: str, *partition_by: str) -> None:
    """CSV with a header line per file, quotes doubled inside quotes; one folder per partition value."""
    writer = df.write.mode("overwrite").options(**CSV_FORMAT)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.csv(path)
