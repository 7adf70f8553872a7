"""Landing zone: one CSV file per table and day, read with lineage columns.

The zone is a directory tree on any file system Spark reads. Where date and table stand in a path is
given by a template; many days are read in one job.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from datetime import date
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.files import any_match, folder_exists
from strandline.functions.casting import parse_text
from strandline.spec import PARTITION_COLUMN, TableSpec

# The default layout below the base folder, and the text form of a date in it.
DEFAULT_TEMPLATE = "{date}/{file}"
DATE_PATTERN = r"\d{4}-\d{2}-\d{2}"
DATE_GLOB = "[0-9][0-9][0-9][0-9]-[0-9][0-9]-[0-9][0-9]"
DEFAULT_BASE = "upload"

# The columns of Spark's binary file source.
FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"

# Quotes are optional and doubled inside quotes. A header that does not name the declared columns in their order
# fails the job, so that no value ends up in another column.
CSV_OPTIONS = {"header": "true", "quote": '"', "escape": '"', "enforceSchema": "false"}


@dataclass(frozen=True)
class LandingZone:
    """Base folder plus the template of the paths below it, with ``{date}`` and ``{file}`` in it."""

    base: str = DEFAULT_BASE
    template: str = DEFAULT_TEMPLATE

    def path(self, spec: TableSpec, day: date | str) -> str:
        """The file of one table and day."""
        return self._fill(spec.file_name, str(day))

    def glob(self, spec: TableSpec) -> str:
        """The files of one table, all days; folders that are no date are not listed."""
        return self._fill(spec.file_name, DATE_GLOB)

    def path_column(self, spec: TableSpec, key: Column) -> Column:
        """The file of one table as a column, for a partition key column."""
        before, after = self._fill(spec.file_name, "\0").split("\0")
        return F.concat(F.lit(before), key, F.lit(after))

    def date_column(self, spec: TableSpec, path: Column) -> Column:
        """Partition key text found in the path of one of the table's files."""
        before, after = self.template.format(date="\0", file=spec.file_name).split("\0")
        # Spark may have written the file as a folder of part files.
        pattern = f"/{re.escape(before)}({DATE_PATTERN}){re.escape(after)}(?:/[^/]*)?$"
        return F.regexp_extract(path, pattern, 1)

    def _fill(self, file: str, day: str) -> str:
        return f"{self.base.rstrip('/')}/{self.template.format(date=day, file=file)}"


def csv_options(spec: TableSpec, more: dict[str, str]) -> dict[str, str]:
    """Reader options of a feed; with line breaks in quotes its files cannot be split."""
    lines = {"multiLine": "true"} if spec.multi_line else {}
    return {**CSV_OPTIONS, **lines, **spec.reader_options, **more}


def text_schema(spec: TableSpec) -> T.StructType:
    return T.StructType([T.StructField(f.name, T.StringType()) for f in spec.schema])


def rejected_values(spec: TableSpec) -> Column:
    """How many of a raw row's texts stand for a value and do not fit their type."""

    def one(field: T.StructField) -> Column:
        text = F.col(f"`{field.name}`")
        there = parse_text(text, T.StringType(), missing=spec.missing).isNotNull()
        return (there & parse_text(text, field.dataType, missing=spec.missing).isNull()).cast("int")

    typed = [one(f) for f in spec.schema if not isinstance(f.dataType, T.StringType)]
    return reduce(add, typed, F.lit(0))


def with_lineage(
    raw: DataFrame, spec: TableSpec, zone: LandingZone, strict: bool, rejected: str | None = None
) -> DataFrame:
    """Typed columns, then ``event_dt`` (partition key text), ``load_ts`` and ``dt`` (directory number).

    ``rejected`` names a column to add, of the number of values that did not fit.
    """
    typed = [parse_text(F.col(f"`{f.name}`"), f.dataType, strict, spec.missing).alias(f.name) for f in spec.schema]
    # The path is percent-encoded, in which a plus sign stands for itself.
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    lineage = raw.select(
        *typed,
        zone.date_column(spec, path).alias("event_dt"),
        F.current_timestamp().alias("load_ts"),
        *([rejected_values(spec).alias(rejected)] if rejected else []),
    )
    undated = F.raise_error(F.lit(f"a file of {spec.name} has no date in its path where {zone.template} has one"))
    number = F.translate("event_dt", "-", "")
    return lineage.withColumn(PARTITION_COLUMN, F.when(number != "", number).otherwise(undated).cast("int"))


def read_landing(
    spark: SparkSession,
    spec: TableSpec,
    zone: LandingZone,
    days: Iterable[date | str] | None = None,
    *,
    strict: bool = False,
    rejected: str | None = None,
    **reader_options: str,
) -> DataFrame:
    """One table's landing rows of the given days, or of all days.

    Values are read as text and cast to the declared schema, so a column cannot change its type between
    days. ``strict`` fails on a value that does not fit; otherwise it becomes NULL, and the column ``rejected``,
    if named, counts those of each row.
    """
    paths = [zone.glob(spec)] if days is None else [zone.path(spec, day) for day in days]
    options = csv_options(spec, reader_options)
    raw = spark.read.schema(text_schema(spec)).options(**options).csv(paths)
    return with_lineage(raw, spec, zone, strict, rejected)


def stream_landing(
    spark: SparkSession, spec: TableSpec, zone: LandingZone, *, strict: bool = False, **reader_options: str
) -> DataFrame:
    """The same rows as a stream: every file is delivered once."""
    options = csv_options(spec, reader_options)
    raw = spark.readStream.schema(text_schema(spec)).options(**options).csv(zone.glob(spec))
    return with_lineage(raw, spec, zone, strict)


def arrival_columns(files: DataFrame, spec: TableSpec, zone: LandingZone) -> DataFrame:
    day = zone.date_column(spec, F.col("path"))
    return files.select(
        F.lit(spec.landing_asset).alias("asset"),
        F.try_to_date(day).alias("partition"),
        zone.path_column(spec, day).alias("run_key"),
        F.col("path"),
        F.col("length"),
        F.col("modificationTime").alias("arrived_at"),
    )


def arrivals(spark: SparkSession, spec: TableSpec, zone: LandingZone) -> DataFrame:
    """Listing of one table's landing files; no file is opened."""
    if any_match(spark, zone.glob(spec)):
        files = spark.read.format("binaryFile").schema(FILE_SCHEMA).load(zone.glob(spec))
    else:
        files = spark.createDataFrame([], FILE_SCHEMA)
    return arrival_columns(files.drop("content"), spec, zone)


def stream_arrivals(spark: SparkSession, spec: TableSpec, zone: LandingZone, **source_options: str) -> DataFrame:
    """The listing as a stream: each new file once, no file opened."""
    files = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).options(**source_options).load(zone.glob(spec))
    return arrival_columns(files.drop("content"), spec, zone)


def landed(spark: SparkSession, spec: TableSpec, zone: LandingZone, day: date | str) -> bool:
    """Whether one table's file of one day is there."""
    return folder_exists(spark, zone.path(spec, day))
