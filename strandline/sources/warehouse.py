"""Zoned parquet tables: writes with row counts, reads, views.

A table is a folder ``{base}/{zone}/{name}``; a partitioned one has a folder ``dt=yyyyMMdd`` per day,
replaced as a whole when that day is written again. Every write declares the columns next to the data, so a read
infers nothing, and a read of some days lists no other day's folder.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.files import delete_folder, folder_exists
from strandline.functions.dates import directory_value
from strandline.scratch import stored
from strandline.sources.manifest import Manifest
from strandline.spec import PARTITION_COLUMN

COMPRESSION = "gzip"
SCHEMA_FOLDER = "_schema"


@dataclass(frozen=True)
class Written:
    """What one write left behind."""

    path: str
    row_count: int
    metrics: dict[str, int] = field(default_factory=dict)


def quoted(*parts: str) -> str:
    return ".".join("`" + p.replace("`", "``") + "`" for p in parts)


class Warehouse:
    """Tables of one base folder, grouped by zone; every zone is a schema of the session's catalog."""

    def __init__(self, spark: SparkSession, base: str, default_zone: str = "warehouse"):
        self.spark = spark
        self.base = base.rstrip("/")
        self.default_zone = default_zone

    def path(self, name: str, zone: str | None = None) -> str:
        return f"{self.base}/{zone or self.default_zone}/{name}"

    def table_name(self, name: str, zone: str | None = None) -> str:
        return quoted(zone or self.default_zone, name)

    def write_partitioned(
        self,
        df: DataFrame,
        name: str,
        zone: str | None = None,
        by: str | tuple[str, ...] = PARTITION_COLUMN,
        *,
        metrics: Mapping[str, Column] | None = None,
        drop: Sequence[str] = (),
        even_files: bool = False,
    ) -> Written:
        """Write the partitions found in ``df``, each replacing what it held; others stay.

        ``even_files`` shuffles by partition first: one file for a small partition, several of the
        advisory size for a large one. Use it where the input's own split would scatter partitions.
        """
        columns = (by,) if isinstance(by, str) else by
        path = self.path(name, zone)
        written = self.write_folder(df, path, columns, metrics, drop, even_files=even_files)
        self._declare(path, df.drop(*drop).schema, columns)
        return written

    def write_folder(
        self,
        df: DataFrame,
        path: str,
        by: Sequence[str] = (),
        metrics: Mapping[str, Column] | None = None,
        drop: Sequence[str] = (),
        *,
        even_files: bool = False,
    ) -> Written:
        """Write ``df`` to a folder, by partitions if ``by`` names columns; the partitions that it has are replaced.

        ``metrics`` are aggregates that are observed in the writing stage, over columns that may be dropped behind it.
        """
        self._require_frame(df)
        if even_files:
            df = df.hint("rebalance", *map(F.col, by))
        if not by:
            return self._write(df, path, lambda w: w, metrics, drop)
        return self._write(
            df, path, lambda w: w.partitionBy(*by).option("partitionOverwriteMode", "dynamic"), metrics, drop
        )

    def write_table(self, df: DataFrame, name: str, zone: str | None = None) -> Written:
        """Write ``df`` in place of the whole table."""
        self._require_frame(df)
        path = self.path(name, zone)
        written = self._write(df, path, lambda w: w.option("partitionOverwriteMode", "static"))
        self._declare(path, df.schema)
        return written

    def declared_schema(self, name: str, zone: str | None = None) -> T.StructType | None:
        """The table's columns as the last write declared them, partition columns last; None if none did."""
        _, content = Manifest(self.spark, f"{self.path(name, zone)}/{SCHEMA_FOLDER}").newest()
        return T.StructType.fromJson(content) if content else None

    def _declare(self, path: str, schema: T.StructType, by: Sequence[str] = ()) -> None:
        fields = sorted(schema.fields, key=lambda f: f.name in by)
        nullable = T.StructType([T.StructField(f.name, f.dataType, True, f.metadata) for f in fields])
        declared = Manifest(self.spark, f"{path}/{SCHEMA_FOLDER}")
        number, content = declared.newest()
        if content != nullable.jsonValue():
            declared.switch(number, nullable.jsonValue())
            declared.forget()

    def read_table(self, name: str, zone: str | None = None, schema: T.StructType | None = None) -> DataFrame:
        """All rows of a table, with its partition column; with the declared schema, no file is opened for it."""
        schema = schema or self.declared_schema(name, zone)
        reader = self.spark.read.schema(schema) if schema else self.spark.read
        return reader.parquet(self.path(name, zone))

    def read_partition(self, name: str, day: date, zone: str | None = None) -> DataFrame:
        """Rows of one day; only that day's folder is read."""
        return self.read_partitions(name, [day], zone).filter(F.col(PARTITION_COLUMN) == directory_value(day))

    def read_partitions(self, name: str, days: Sequence[date], zone: str | None = None) -> DataFrame:
        """Rows of some days. Only their folders are listed, however many others the table has."""
        schema = self.declared_schema(name, zone)
        if schema is None:
            return self.read_table(name, zone).filter(F.col(PARTITION_COLUMN).isin(*map(directory_value, days)))
        path = self.path(name, zone)
        folders = [f"{path}/{PARTITION_COLUMN}={directory_value(day)}" for day in days]
        folders = [f for f in folders if folder_exists(self.spark, f)]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", path).parquet(*folders)

    def exists(self, name: str, zone: str | None = None) -> bool:
        return folder_exists(self.spark, self.path(name, zone))

    def partition_counts(self, name: str, zone: str | None = None, by: str = PARTITION_COLUMN) -> DataFrame:
        """Stored rows per partition, from the file footers: no column is read."""
        return self.read_table(name, zone).groupBy(by).agg(F.count(F.lit(1)).alias("row_count"))

    def compact(self, name: str, day: date, zone: str | None = None) -> Written:
        """Rewrite one day with files of the advisory size."""
        rows = stored(self.read_partition(name, day, zone), "compact")
        return self.write_partitioned(rows, name, zone, even_files=True)

    def drop_partition(self, name: str, value: int, zone: str | None = None, by: str = PARTITION_COLUMN) -> None:
        """Remove one partition's folder; a day delivered again without rows leaves none behind."""
        delete_folder(self.spark, f"{self.path(name, zone)}/{by}={value}")

    def register_view(self, name: str, zone: str | None = None, path: str | None = None) -> str:
        """Create or replace the view ``zone.name`` over the table's folder, or over ``path``."""
        view = self.table_name(name, zone)
        self.create_zone(zone)
        source = quoted(path or self.path(name, zone))
        self.spark.sql(f"CREATE OR REPLACE VIEW {view} AS SELECT * FROM parquet.{source}")
        return view

    def create_zone(self, zone: str | None = None) -> None:
        name = zone or self.default_zone
        location = f"{self.base}/{name}".replace("\\", "\\\\").replace("'", "\\'")
        self.spark.sql(f"CREATE SCHEMA IF NOT EXISTS {quoted(name)} LOCATION '{location}'")

    def view(self, name: str, zone: str | None = None) -> DataFrame:
        return self.spark.table(self.table_name(name, zone))

    def _require_frame(self, df: object) -> None:
        if not isinstance(df, DataFrame):
            raise TypeError(f"outputs of type {type(df).__name__} are not supported, only Spark DataFrames")

    def _write(
        self,
        df: DataFrame,
        path: str,
        configure,
        metrics: Mapping[str, Column] | None = None,
        drop: Sequence[str] = (),
    ) -> Written:
        # The counts are observed right below the write, in its own stage: one execution, and a retried
        # task is counted once.
        observation = Observation()
        named = [column.alias(name) for name, column in (metrics or {}).items()]
        counted = df.observe(observation, F.count(F.lit(1)).alias("row_count"), *named).drop(*drop)
        configure(counted.write.mode("overwrite").option("compression", COMPRESSION)).parquet(path)
        found = observation.get
        return Written(path, found["row_count"], {name: found[name] for name in metrics or {}})
