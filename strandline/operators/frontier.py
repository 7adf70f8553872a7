"""Which dates have arrived, are next, are missing, are ready.

``arrivals`` and ``ledger`` are frames with ``asset`` and ``partition`` (date) columns. Duplicates are
removed before any window, so a group holds at most one row per calendar day.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.dates import calendar, partition_key
from strandline.operators.ledger import latest_partitions
from strandline.sources.landing import LandingZone
from strandline.spec import TableSpec

READINESS_MODES = ("exact", "at_least")


def asset_days(records: DataFrame) -> DataFrame:
    """Each asset's partitions, once."""
    return records.select("asset", "partition").filter(F.col("partition").isNotNull()).distinct()


def arrival_frontier(arrivals: DataFrame, start: date) -> DataFrame:
    """The arrived dates up to the first missing one, per asset, counted from ``start``."""
    days = asset_days(arrivals).filter(F.col("partition") >= F.lit(start))
    rank = F.row_number().over(Window.partitionBy("asset").orderBy("partition"))
    ranked = days.withColumn("rank", rank)
    return ranked.filter(F.datediff("partition", F.lit(start)) == F.col("rank") - 1).drop("rank")


def next_due(ledger: DataFrame, assets: DataFrame, start: date) -> DataFrame:
    """The day after each asset's last partition on record; ``start`` if there is none."""
    done = ledger.groupBy("asset").agg(F.max("partition").alias("last"))
    due = F.coalesce(F.date_add("last", 1), F.lit(start)).alias("next_date")
    return assets.select("asset").distinct().join(done, "asset", "left").select("asset", due)


def requests(due: DataFrame, arrivals: DataFrame, path: Column) -> DataFrame:
    """What to do about each due date: request its file, or skip and say why.

    ``path`` is the landing path as a column over ``asset`` and ``next_date``.
    """
    there = asset_days(arrivals).select("asset", F.col("partition").alias("next_date"), F.lit(True).alias("there"))
    wanted = due.withColumn("path", path).join(there, ["asset", "next_date"], "left")
    found = F.coalesce("there", F.lit(False))
    reason = F.when(~found, F.concat(F.lit("Did not find file "), F.col("path")))
    return wanted.select("asset", "next_date", "path", found.alias("requested"), reason.alias("skip_reason"))


def due_path(spec: TableSpec, zone: LandingZone) -> Column:
    """Landing path of ``next_date``."""
    return zone.path_column(spec, partition_key("next_date"))


def unprocessed(arrivals: DataFrame, ledger: DataFrame, on: Sequence[str] = ("run_key",)) -> DataFrame:
    """Arrivals that no run on record was requested for."""
    done = ledger.select(*on).distinct()
    return arrivals.join(done, list(on), "left_anti")


def backlog(ledger: DataFrame, assets: DataFrame, start: date, end: date) -> DataFrame:
    """Days of the calendar ``[start, end)`` that an asset has no record for."""
    wanted = assets.select("asset").distinct().select("asset", F.explode(calendar(start, end)).alias("partition"))
    return wanted.join(asset_days(ledger), ["asset", "partition"], "left_anti")


def readiness(
    ledger: DataFrame,
    partitioned: Sequence[str],
    unpartitioned: Sequence[str],
    days: DataFrame,
    mode: str = "exact",
) -> DataFrame:
    """Per day of ``days`` (column ``partition``), whether everything built from it can start.

    Ready means: each of ``partitioned`` has a record for the day, and the newest record of each of
    ``unpartitioned`` names the day (``exact``), or a day not before it (``at_least``) as its latest
    partition. A table with no record or no latest partition is not ready.
    """
    if mode not in READINESS_MODES:
        raise ValueError(f"mode must be one of {READINESS_MODES}, not {mode!r}")
    present = (
        asset_days(ledger.filter(F.col("asset").isin(*partitioned)))
        .groupBy("partition")
        .agg(F.count(F.lit(1)).alias("present"))
    )
    # One row per unpartitioned asset, folded into one row; read as scalar subqueries.
    newest_days = latest_partitions(ledger.filter(F.col("asset").isin(*unpartitioned)))
    known = newest_days.agg(F.count("latest_partition").alias("n")).scalar()
    lowest = newest_days.agg(F.min("latest_partition").alias("d")).scalar()
    highest = newest_days.agg(F.max("latest_partition").alias("d")).scalar()

    day = F.col("partition")
    inputs = F.coalesce("present", F.lit(0)) == len(set(partitioned))
    ready = inputs
    if unpartitioned:
        complete = known == len(set(unpartitioned))
        reached = (lowest == day) & (highest == day) if mode == "exact" else lowest >= day
        ready = inputs & complete & F.coalesce(reached, F.lit(False))
    return days.select("partition").distinct().join(present, "partition", "left").select("partition", ready.alias("ready"))


def next_ready(ready: DataFrame, ledger: DataFrame, child: str, start: date) -> DataFrame:
    """The one day the child may be built for now; empty if that day is not ready.

    It is the day after the newest one the child was built for, so days are taken in order.
    """
    built = latest_partitions(ledger.filter(F.col("asset") == child))
    last = built.agg(F.max("latest_partition").alias("d")).scalar()
    due = F.coalesce(F.date_add(last, 1), F.lit(start))
    return ready.filter(F.col("ready") & (F.col("partition") == due)).select("partition")
