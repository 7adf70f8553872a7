"""The daily flow: landing files to landing table, to history, to combined table and models.

Each step writes a table, registers its view and appends to the ledger. Steps can be repeated: a day is
replaced, in the landing table and in the history, and the ledger keeps the newest record of a run key.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.files import child_names, delete_folder, folder_exists
from strandline.functions.dates import decode_partition, directory_value
from strandline.operators.combine import combine_histories
from strandline.operators.frontier import due_path, next_due, next_ready, readiness, requests
from strandline.operators.history import order_violations
from strandline.operators.incremental import HistoryTable
from strandline.operators.ledger import Ledger, latest_partitions, records_for
from strandline.plans.models import Models
from strandline.sources.landing import LandingZone, read_landing
from strandline.sources.warehouse import Warehouse, Written
from strandline.spec import LANDING_ZONE, PARTITION_COLUMN, STAGING_ZONE, TableSpec

COMBINED = "combined_asset"
# Landing days written by one job, which observes two counts for each.
DAYS_AT_ONCE = 64
REJECTED = "__rejected"
REPLACED = "_replaced"


class DailyFlow:
    """The steps for one set of feeds, one landing zone and one warehouse."""

    def __init__(
        self,
        warehouse: Warehouse,
        ledger: Ledger,
        zone: LandingZone,
        specs: Sequence[TableSpec],
    ):
        self.warehouse = warehouse
        self.ledger = ledger
        self.zone = zone
        self.specs = list(specs)
        self.spark = warehouse.spark

    def requests(self) -> DataFrame:
        """Per table, the next due day and whether its file is there, or why it is skipped.

        The due paths are looked up one by one, so the rest of the landing zone, however long, is not listed.
        """
        records = self.ledger.read()

        def one(spec: TableSpec) -> DataFrame:
            asset = self.spark.range(1).select(F.lit(spec.landing_asset).alias("asset"))
            due = next_due(records, asset, spec.start)
            return due.withColumn("path", due_path(spec, self.zone))

        # One row per table.
        due = reduce(DataFrame.unionByName, map(one, self.specs)).collect()
        there = [(r["asset"], r["next_date"]) for r in due if folder_exists(self.spark, r["path"])]
        arrived = self.spark.createDataFrame(there, "asset string, partition date")
        wanted = self.spark.createDataFrame([tuple(r) for r in due], "asset string, next_date date, path string")
        return requests(wanted, arrived, F.col("path"))

    def ingest(self, spec: TableSpec, days: Sequence[date]) -> Written:
        """Read the landing files of some days and replace those days of the landing table.

        Rows, and values that do not fit their type, are counted per day in the stage that writes them.
        """
        days = list(days)
        self._keep_replaced(spec, days)
        parts = [self._ingest(spec, days[i : i + DAYS_AT_ONCE]) for i in range(0, len(days), DAYS_AT_ONCE)]
        self.warehouse.register_view(spec.landing_asset, LANDING_ZONE)
        counts = {day: found for part in parts for day, found in part.items()}
        path = self.warehouse.path(spec.landing_asset, LANDING_ZONE)
        self.ledger.append(
            [
                {
                    "asset": spec.landing_asset,
                    "partition": day,
                    "row_count": rows,
                    "rejected": rejected,
                    "path": path,
                    "run_key": self.zone.path(spec, day),
                }
                for day, (rows, rejected) in counts.items()
            ]
        )
        total = {"rejected": sum(rejected for _, rejected in counts.values())}
        return Written(path, sum(rows for rows, _ in counts.values()), total)

    def _ingest(self, spec: TableSpec, days: Sequence[date]) -> dict[date, tuple[int, int]]:
        """Write some days; rows and rejected values of each."""
        rows = read_landing(self.spark, spec, self.zone, days, rejected=REJECTED)
        metrics: dict[str, Column] = {}
        for i, day in enumerate(days):
            own = F.col(PARTITION_COLUMN) == directory_value(day)
            metrics[f"rows_{i}"] = F.count_if(own)
            metrics[f"rejected_{i}"] = F.coalesce(F.sum(F.when(own, F.col(REJECTED))), F.lit(0))
        written = self.warehouse.write_partitioned(
            rows, spec.landing_asset, LANDING_ZONE, metrics=metrics, drop=[REJECTED]
        )
        found = {day: (written.metrics[f"rows_{i}"], written.metrics[f"rejected_{i}"]) for i, day in enumerate(days)}
        for day, (count, _) in found.items():
            if not count:  # a day delivered again without rows is not among the partitions written
                self.warehouse.drop_partition(spec.landing_asset, directory_value(day), LANDING_ZONE)
        return found

    def _keep_replaced(self, spec: TableSpec, days: Sequence[date]) -> None:
        """Note the keys of days that are about to be replaced: a repair of the history has to look at them."""
        table = self.history_table(spec)
        folder = self.warehouse.path(spec.landing_asset, LANDING_ZONE)
        there = [d for d in days if folder_exists(self.spark, f"{folder}/{PARTITION_COLUMN}={directory_value(d)}")]
        if there and table.states():
            gone = self.landing(spec, there).select(*spec.key, spec.time).distinct()
            self.warehouse.write_folder(gone, f"{table.path}/{REPLACED}/{uuid.uuid4().hex}")

    def landing(self, spec: TableSpec, days: Sequence[date] | None = None) -> DataFrame:
        """The landing table, or some days of it, with its partition number decoded to a date."""
        if days is None:
            rows = self.warehouse.read_table(spec.landing_asset, LANDING_ZONE)
        else:
            rows = self.warehouse.read_partitions(spec.landing_asset, days, LANDING_ZONE)
        return rows.withColumn(PARTITION_COLUMN, decode_partition(PARTITION_COLUMN))

    def history_table(self, spec: TableSpec) -> HistoryTable:
        order = [*spec.order, *spec.tie_breaker]
        return HistoryTable(
            self.warehouse, spec.history_asset, STAGING_ZONE, spec.key, order, spec.time, spec.ignored
        )

    def refresh_history(self, spec: TableSpec, days: Sequence[date] | None = None, run_key: str | None = None) -> int:
        """Bring the history up to date after ``days`` were ingested; without them, rebuild all of it.

        Returns the number of versions the history has.
        """
        known = records_for(self.ledger.read(), spec.landing_asset)
        first, last = known.agg(F.min("partition"), F.max("partition")).first()
        if last is None:
            raise ValueError(f"the ledger has no day of {spec.landing_asset}; ingest one first")
        table, rows = self.history_table(spec), self.landing(spec)
        # Rows that tie in the order have no defined history; only the days at hand are looked at.
        fresh = self.landing(spec, days) if days else rows
        tied = order_violations(fresh, spec.key, [*spec.order, *spec.tie_breaker]).take(3)
        if tied:
            raise ValueError(f"{spec.name} has rows with the same key and order, such as {[r.asDict() for r in tied]}")
        # Read by the update, and deleted once it is through.
        notes = [f"{table.path}/{REPLACED}/{n}" for n in child_names(self.spark, f"{table.path}/{REPLACED}")]
        replaced = self.spark.read.parquet(*notes) if notes else None
        by_day = days if spec.time == PARTITION_COLUMN else None
        versions = table.update(rows, min(days) if days else first, last, by_day, replaced)
        for note in notes:
            delete_folder(self.spark, note)
        record = {
            "asset": spec.history_asset,
            "latest_partition": last,
            "row_count": versions,
            "path": table.path,
        }
        self.ledger.append([record if run_key is None else {**record, "run_key": run_key}])
        return versions

    def history(self, spec: TableSpec, as_of: date | None = None) -> DataFrame:
        return self.history_table(spec).read(as_of)

    def ready(self, days: DataFrame, mode: str = "at_least") -> DataFrame:
        """Per day, whether all landing tables have it and all histories contain it."""
        partitioned = [s.landing_asset for s in self.specs]
        return readiness(self.ledger.read(), partitioned, [s.history_asset for s in self.specs], days, mode)

    def combine_when_ready(
        self, days: DataFrame, mode: str = "at_least", as_of: date | None = None, models: Models | None = None
    ) -> date | None:
        """Build the combined table, and the models on it, if the next day in order is ready.

        The table is built from the histories as they stand, so it is recorded, and returned, as of the last day that
        all of them contain; a backlog of days is taken in at once.
        """
        start = min(s.start for s in self.specs)
        records = self.ledger.read()
        if next_ready(self.ready(days, mode), records, COMBINED, start).first() is None:
            return None
        histories = records.filter(F.col("asset").isin([s.history_asset for s in self.specs]))
        day = latest_partitions(histories).agg(F.min("latest_partition")).first()[0]
        written = self.warehouse.write_table(self.combined(as_of), COMBINED)
        self.warehouse.register_view(COMBINED)
        self._record(COMBINED, day, written)
        if models is not None:
            self.build_models(models, day)
        return day

    def build_models(self, models: Models, day: date) -> None:
        """Build the models in order; each has a record, without a count where it is a view and writes nothing."""
        for name, written in models.build().items():
            self._record(name, day, written)

    def _record(self, asset: str, day: date, written: Written | None) -> None:
        found = {} if written is None else {"row_count": written.row_count, "path": written.path}
        self.ledger.append([{"asset": asset, "latest_partition": day, **found}])

    def combined(self, as_of: date | None = None) -> DataFrame:
        """The histories joined on their keys, as text, over the time they were valid together."""
        sizes = {len(spec.key) for spec in self.specs}
        if len(sizes) > 1:
            raise ValueError("only tables with the same number of key columns can be combined")
        names = ["key"] if sizes == {1} else [f"key_{i + 1}" for i in range(max(sizes))]
        histories = [self._renamed(spec, names, as_of) for spec in self.specs]
        return combine_histories(histories, names)

    def _renamed(self, spec: TableSpec, names: Sequence[str], as_of: date | None) -> DataFrame:
        history = self.history(spec, as_of).drop(*spec.ignored)
        keys = [F.col(c).cast("string").alias(name) for c, name in zip(spec.key, names, strict=True)]
        others = [c for c in history.columns if c not in (*spec.key, "valid_from", "valid_to")]
        return history.select(*keys, *(F.col(c).alias(f"{spec.name}_{c}") for c in others), "valid_from", "valid_to")
