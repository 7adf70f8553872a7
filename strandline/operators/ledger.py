"""Ledger of materializations, and the questions asked of it.

One row per table (or table partition) and write, with the rows written and, of landing files, the values that did not
fit their type. Every question is an aggregation or a filter over the ledger; the newest record is found by ``max_by``,
never by sorting.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from datetime import date, datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.files import child_names, delete_folder, make_folder
from strandline.sources.manifest import Manifest

LEDGER_SCHEMA = T.StructType(
    [
        T.StructField("asset", T.StringType()),
        T.StructField("partition", T.DateType()),
        T.StructField("latest_partition", T.DateType()),
        T.StructField("row_count", T.LongType()),
        T.StructField("rejected", T.LongType()),
        T.StructField("path", T.StringType()),
        T.StructField("window_start", T.TimestampType()),
        T.StructField("window_end", T.TimestampType()),
        T.StructField("run_key", T.StringType()),
        T.StructField("recorded_at", T.TimestampType()),
        T.StructField("seq", T.LongType()),
    ]
)


class Ledger:
    """Append-only table of materialization records.

    Every append adds a file to ``log``. Once there are ``compact_after`` of them they are folded into one snapshot;
    the manifest says which snapshot counts and which files of the log it holds. A file is deleted one compaction
    after the one that folded it, so readers of either state find all records, once.
    """

    def __init__(self, spark: SparkSession, path: str, compact_after: int = 200):
        self.spark = spark
        self.path = path
        self.compact_after = compact_after
        self.manifest = Manifest(spark, f"{path}/_manifest")

    def read(self) -> DataFrame:
        """All records; of a record appended twice (a retried batch) only the newest."""
        return newest(self.read_all(), ["asset", "partition", "run_key"]).select(*LEDGER_SCHEMA.names)

    def read_all(self) -> DataFrame:
        """Every record as it was appended."""
        _, content = self.manifest.newest()
        return self._read(content, self._unfolded(content))

    def stream(self, **options: str) -> DataFrame:
        """Records as they are appended."""
        make_folder(self.spark, f"{self.path}/log")
        return self.spark.readStream.schema(LEDGER_SCHEMA).options(**options).parquet(f"{self.path}/log")

    def append(self, records: Sequence[dict]) -> None:
        """Append records of one run; ``seq`` and ``recorded_at`` are set here.

        ``seq`` counts on from the highest on record, whoever wrote it, so the order of records does not hang on clocks.
        """
        _, content = self.manifest.newest()
        names = self._unfolded(content)
        last = self._read(content, names).agg(F.max("seq")).first()[0] or 0
        now = self._now()
        filled = [_filled(record, last + 1 + i, now) for i, record in enumerate(records)]
        rows = [tuple(record.get(name) for name in LEDGER_SCHEMA.names) for record in filled]
        self.spark.createDataFrame(rows, LEDGER_SCHEMA).coalesce(1).write.mode("append").parquet(f"{self.path}/log")
        if len(names) + 1 >= self.compact_after:
            self.compact()

    def _now(self) -> datetime:
        return datetime.now(timezone.utc)

    def compact(self) -> None:
        """Fold the log into a snapshot. If another job does so at the same time, that one's counts."""
        number, content = self.manifest.newest()
        names = self._unfolded(content)
        if not names:
            return
        snapshot = f"snapshot-{number + 1:012}-{uuid.uuid4().hex}"
        self._read(content, names).hint("rebalance").write.parquet(f"{self.path}/{snapshot}")
        there = set(self._log())
        before = [n for n in content["folded"] if n in there] if content else []
        try:
            self.manifest.switch(number, {"snapshot": snapshot, "folded": [*before, *names]})
        except FileExistsError:
            delete_folder(self.spark, f"{self.path}/{snapshot}")
            return
        for name in before:
            delete_folder(self.spark, f"{self.path}/log/{name}")
        named = {content["snapshot"] for content in self.manifest.forget()}
        for name in child_names(self.spark, self.path):
            if name.startswith("snapshot-") and name < snapshot and name not in named:
                delete_folder(self.spark, f"{self.path}/{name}")

    def _log(self) -> list[str]:
        return [n for n in child_names(self.spark, f"{self.path}/log") if not n.startswith(("_", "."))]

    def _unfolded(self, content: dict | None) -> list[str]:
        folded = set(content["folded"]) if content else set()
        return [n for n in self._log() if n not in folded]

    def _read(self, content: dict | None, names: Sequence[str]) -> DataFrame:
        paths = [f"{self.path}/log/{n}" for n in names] + ([f"{self.path}/{content['snapshot']}"] if content else [])
        if not paths:
            return self.spark.createDataFrame([], LEDGER_SCHEMA)
        return self.spark.read.schema(LEDGER_SCHEMA).parquet(*paths)


def _filled(record: dict, seq: int, now: datetime) -> dict:
    unknown = set(record) - set(LEDGER_SCHEMA.names)
    if unknown:
        raise ValueError(f"no such ledger columns: {sorted(unknown)}")
    day: date | None = record.get("partition")
    window = {}
    if day is not None:
        start = datetime(day.year, day.month, day.day, tzinfo=timezone.utc)
        window = {"window_start": start, "window_end": start + timedelta(days=1)}
    return {"run_key": str(seq), **window, **record, "recorded_at": now, "seq": seq}


def sequence(records: DataFrame) -> Column:
    """What the newest record is found by.

    ``seq`` comes first. Writers that append at once may take the same one; then the later day decides, and only
    after that the clock. Columns that ``records`` lacks play no part.
    """
    days = [F.col(c) for c in ("latest_partition", "partition") if c in records.columns]
    clock = [F.col(c) for c in ("recorded_at", "run_key") if c in records.columns]
    return F.struct("seq", *([F.coalesce(*days).alias("day")] if days else []), *clock)


def newest(records: DataFrame, by: Sequence[str]) -> DataFrame:
    """The newest record per group, all columns."""
    rest = [c for c in records.columns if c not in by]
    best = F.max_by(F.struct(*rest), sequence(records)).alias("record")
    return records.groupBy(*by).agg(best).select(*by, "record.*")


def latest_records(ledger: DataFrame) -> DataFrame:
    """Newest record of each asset."""
    return newest(ledger, ["asset"])


def latest_partitions(ledger: DataFrame) -> DataFrame:
    """Latest partition named by each asset's newest record."""
    return ledger.groupBy("asset").agg(F.max_by("latest_partition", sequence(ledger)).alias("latest_partition"))


def records_for(ledger: DataFrame, asset: str | None = None, partition: date | None = None) -> DataFrame:
    """Records of an asset, of a partition, or of both."""
    if asset is not None:
        ledger = ledger.filter(F.col("asset") == asset)
    if partition is not None:
        ledger = ledger.filter(F.col("partition") == F.lit(partition))
    return ledger


def materialized(ledger: DataFrame, asset: str, partition: date | None = None) -> bool:
    """Whether a record of the asset, and of the partition if given, exists."""
    return not records_for(ledger, asset, partition).isEmpty()


def record_counts(ledger: DataFrame) -> DataFrame:
    """Records per asset and partition, with the rows written by all of them and by the newest."""
    return ledger.groupBy("asset", "partition").agg(
        F.count(F.lit(1)).alias("records"),
        F.sum("row_count").alias("rows_written"),
        F.max_by("row_count", sequence(ledger)).alias("row_count"),
    )


def run_count(ledger: DataFrame) -> DataFrame:
    """Number of runs on record."""
    return ledger.select("run_key").distinct().agg(F.count(F.col("run_key")).alias("runs"))


def entry(entries: Column | str, label: str) -> Column:
    """Value of a free-text metadata map by label; NULL if the label is missing."""
    return F.try_element_at(F.col(entries) if isinstance(entries, str) else entries, F.lit(label))


def latest_partition(rows: DataFrame, column: str) -> DataFrame:
    """Newest partition contained in a table, to pass on to what is built from it."""
    return rows.agg(F.max(column).alias("latest_partition"))
