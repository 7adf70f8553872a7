"""Registered queries: every operator, run over whole tables.

The given tables stand in for feeds: customers and users as keys, days as partitions, event types,
users and order priorities as assets of a ledger.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from datetime import date, datetime, timedelta
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.functions.casting import decimal_to_double
from strandline.functions.dates import calendar, decode_partition, encode_partition, next_day, partition_key, window_label
from strandline.operators import frontier, ledger, quality
from strandline.operators.combine import combine_histories, combine_overlap
from strandline.operators.history import change_flags, compress_history, order_violations
from strandline.operators.incremental import (
    HistoryTable,
    append_versions,
    closed_versions,
    current_history,
    land_in_buckets,
    open_versions,
    rebuild_buckets,
    tail_rows,
)
from strandline.operators.slicing import change_flags_sliced, compress_history_sliced
from strandline.plans.flow import COMBINED, DailyFlow
from strandline.plans.models import Models, example_models
from strandline.scratch import scratch_dir, stored
from strandline.sources.landing import LandingZone, arrivals, read_landing
from strandline.sources.synthetic import write_csv
from strandline.sources.warehouse import Warehouse
from strandline.spec import LANDING_ZONE, STAGING_ZONE, TableSpec
from strandline.streaming.gate import gate_stream
from strandline.streaming.ingest import ingest_stream

AS_OF = date(2030, 1, 1)
EVENTS_START, EVENTS_END = date(2024, 1, 1), date(2024, 1, 31)
ORDERS_START = date(1995, 1, 1)
# Inner borders of the three batches the events' days are delivered in.
FIRST_CUT, SECOND_CUT = date(2024, 1, 11), date(2024, 1, 21)
# Landing folders as Spark writes them in one job.
FOLDER_TEMPLATE = "day={date}/file={file}"
QUERY_BUCKETS = 8

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    """Register a query under its name, less the trailing underscore that keeps it apart from an operator."""
    QUERIES[function.__name__.rstrip("_")] = function
    return function


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def daily_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per customer and day: the status of the day's last order."""
    orders = table(spark, sf_dir, "orders")
    return orders.groupBy("o_custkey", F.to_date("o_orderdate").alias("dt")).agg(
        F.max_by("o_orderstatus", "o_orderkey").alias("o_orderstatus")
    )


def value_band(value: str = "value"):
    """Value in tens, NULL above 20."""
    return F.when(F.col(value) <= 20, F.floor(F.col(value) / 10))


def daily_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per user and day: type and value band of the day's last event."""
    last = F.max_by(F.struct("event_type", "value"), "event_id").alias("last")
    days = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("dt")).agg(last)
    return days.select("user_id", "dt", "last.event_type", value_band("last.value").alias("vb"))


def events_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events read as a ledger: one record each, of the asset named by the event type."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("asset"),
        F.to_date("ts").alias("partition"),
        F.to_date("ts").alias("latest_partition"),
        F.floor("value").alias("row_count"),
        F.col("user_id").cast("string").alias("run_key"),
        F.from_json("props", "map<string,bigint>").alias("entries"),
        F.col("event_id").alias("seq"),
    )


def user_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as arrivals: the user is the asset."""
    events = table(spark, sf_dir, "events")
    return events.select(F.col("user_id").cast("string").alias("asset"), F.to_date("ts").alias("partition"), "event_type")


# --- history -----------------------------------------------------------------------------------------


@query
def scd2_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress_history(daily_orders(spark, sf_dir), ["o_custkey"], ["dt"], "dt", as_of=AS_OF)


@query
def scd2_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress_history(daily_events(spark, sf_dir), ["user_id"], ["dt"], "dt", as_of=AS_OF)


@query
def scd2_events_one_col(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress_history(daily_events(spark, sf_dir), ["user_id"], ["dt"], "dt", ["event_type"], as_of=AS_OF)


@query
def scd2_events_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = daily_events(spark, sf_dir)
    return compress_history(days, ["user_id"], ["dt"], "dt", as_of=AS_OF, null_mode="distinct")


def hot_history(events: DataFrame, attribute: str, rows_per_slice: int) -> DataFrame:
    """History of one attribute per event type, in the order of time and then number."""
    rows = events.select("event_type", "ts", "event_id", attribute)
    return compress_history_sliced(
        rows,
        ["event_type"],
        ["ts"],
        "ts",
        as_of=datetime(2030, 1, 1),
        tie_breaker=["event_id"],
        rows_per_slice=rows_per_slice,
    )


def a_twentieth(events: DataFrame) -> int:
    return max(1, events.count() // 20)


@query
def scd2_hot_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five keys hold all events; each is cut into slices of a twentieth of the table."""
    events = table(spark, sf_dir, "events").withColumn("vb", value_band())
    return hot_history(events, "vb", a_twentieth(events))


@query
def scd2_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three deliveries, the middle days last; each rebuilds the buckets it touches."""
    warehouse = Warehouse(spark, scratch_dir(spark, "incremental"))
    days = stored(daily_events(spark, sf_dir), "daily-events")
    dt = F.col("dt")
    key, history = ["user_id"], ("history", STAGING_ZONE)
    for part in (dt < FIRST_CUT, dt >= SECOND_CUT, (dt >= FIRST_CUT) & (dt < SECOND_CUT)):
        batch = days.filter(part)
        landed = batch.withColumn("dt", encode_partition("dt"))
        touched = land_in_buckets(warehouse, "daily", LANDING_ZONE, landed, key, QUERY_BUCKETS)
        rows = warehouse.read_table("daily", LANDING_ZONE).withColumn("dt", decode_partition("dt"))
        # One row per user and day: no key can be heavy.
        rebuild_buckets(
            warehouse, *history, rows, touched, key, ["dt"], "dt", buckets=QUERY_BUCKETS, rows_per_slice=None
        )
    return current_history(warehouse.read_table(*history), AS_OF)


@query
def scd2_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three deliveries in order; each reads the tail the one before left, and no older rows."""
    days = stored(daily_events(spark, sf_dir), "daily-events")
    dt = F.col("dt")
    key, order = ["user_id"], ["dt"]
    tail, closed = None, []
    for part in (dt < FIRST_CUT, (dt >= FIRST_CUT) & (dt < SECOND_CUT), dt >= SECOND_CUT):
        settled = stored(append_versions(tail, days.filter(part), key, order, "dt"), "settled")
        closed.append(closed_versions(settled, "dt"))
        tail = tail_rows(settled)
    every = reduce(DataFrame.unionByName, closed, open_versions(tail, "dt"))
    return current_history(every, AS_OF)


@query
def scd2_late_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored history whose second week comes after all else, and the next two days once more: it is repaired around them."""
    warehouse = Warehouse(spark, scratch_dir(spark, "late"))
    days = stored(daily_events(spark, sf_dir), "daily-events")
    history = HistoryTable(warehouse, "late_days", STAGING_ZONE, ["user_id"], ["dt"], "dt", tails=1)
    dt = F.col("dt")
    late = [FIRST_CUT - timedelta(days=n) for n in (3, 2, 1)]
    again = [FIRST_CUT, FIRST_CUT + timedelta(days=1)]
    # Of the two days that come again, the first delivery lacks one user in three and has other values.
    first = days.filter(~dt.isin(late)).withColumn("vb", F.when(dt.isin(again), F.col("vb") + 1).otherwise(F.col("vb")))
    first = first.filter(~dt.isin(again) | (F.col("user_id") % 3 > 0))
    last = EVENTS_END - timedelta(days=1)
    for end in (SECOND_CUT - timedelta(days=1), last):
        history.update(first.filter(dt <= end), EVENTS_START if end < last else SECOND_CUT, end)
    replaced = first.filter(dt.isin(again)).select("user_id", "dt")
    history.update(days, late[0], last, [*late, *again], replaced)
    return history.read(AS_OF)


@query
def change_flags_(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = daily_events(spark, sf_dir)
    return change_flags(days, ["user_id"], ["dt"], ["vb"])


@query
def change_flags_hot_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_type", "ts", "event_id", value_band().alias("vb"))
    order = ["ts", "event_id"]
    return change_flags_sliced(events, ["event_type"], order, ["vb"], rows_per_slice=a_twentieth(events))


@query
def history_order_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_violations(table(spark, sf_dir, "lineitem"), ["l_orderkey"], ["l_linenumber"])


# --- combination -------------------------------------------------------------------------------------


def attribute_history(days: DataFrame, attribute: str) -> DataFrame:
    one = days.select("user_id", "dt", attribute)
    return compress_history(one, ["user_id"], ["dt"], "dt", as_of=AS_OF)


@query
def combine_overlap_(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = scd2_events(spark, sf_dir).drop("vb")
    right = scd2_events_one_col(spark, sf_dir).drop("event_type")
    return combine_overlap(left, right, ["user_id"])


@query
def combine_three(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = daily_events(spark, sf_dir).withColumn("failed", F.col("event_type") == "error")
    return combine_histories([attribute_history(days, c) for c in ("event_type", "vb", "failed")], ["user_id"])


@query
def combine_three_nullable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two attributes that turn NULL: versions then end on the day the next one starts, several on the same day."""
    days = daily_events(spark, sf_dir).withColumn("failed", F.col("event_type") == "error")
    days = days.withColumn("event_type", F.expr("nullif(event_type, 'click')"))
    return combine_histories([attribute_history(days, c) for c in ("event_type", "vb", "failed")], ["user_id"])


@query
def combine_hot_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two histories of thousands of versions under each of five keys."""
    events = table(spark, sf_dir, "events").withColumns({"vb": value_band(), "ub": F.floor(F.col("user_id") / 50)})
    size = a_twentieth(events)
    left = hot_history(events, "vb", size).withColumnRenamed("event_id", "vb_event")
    right = hot_history(events, "ub", size).withColumnRenamed("event_id", "ub_event")
    return combine_overlap(left, right, ["event_type"], rows_per_slice=size)


# --- landing and warehouse ---------------------------------------------------------------------------


def replace_type(field: T.StructField, dtype: T.DataType) -> T.StructField:
    return T.StructField(field.name, dtype, field.nullable)


EVENTS_SPEC = TableSpec(
    name="events",
    schema=T.StructType(
        [
            T.StructField("event_id", T.LongType()),
            T.StructField("ts", T.TimestampNTZType()),
            T.StructField("user_id", T.LongType()),
            T.StructField("event_type", T.StringType()),
            T.StructField("value", T.DoubleType()),
            T.StructField("props", T.StringType()),
        ]
    ),
    key=("event_id",),
    start=EVENTS_START,
)
DAILY_SPEC = TableSpec(
    name="daily",
    schema=T.StructType(
        [
            T.StructField("user_id", T.LongType()),
            T.StructField("event_type", T.StringType()),
            T.StructField("vb", T.LongType()),
        ]
    ),
    key=("user_id",),
    start=EVENTS_START,
)


def landing_zone(rows: DataFrame, day: str, spec: TableSpec) -> LandingZone:
    """Write rows as the landing files of their days."""
    zone = LandingZone(scratch_dir(rows.sparkSession, "landing"), FOLDER_TEMPLATE)
    filed = rows.select(
        *spec.schema.names, partition_key(day).alias("day"), F.lit(spec.file_name).alias("file")
    )
    write_csv(filed.hint("rebalance", F.col("day")), zone.base, "day", "file")
    return zone


def events_landing(spark: SparkSession, sf_dir: str) -> LandingZone:
    return landing_zone(table(spark, sf_dir, "events"), "ts", EVENTS_SPEC)


@query
def arrivals_(spark: SparkSession, sf_dir: str) -> DataFrame:
    zone = events_landing(spark, sf_dir)
    return frontier.asset_days(arrivals(spark, EVENTS_SPEC, zone))


@query
def landing_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    zone = events_landing(spark, sf_dir)
    return read_landing(spark, EVENTS_SPEC, zone, strict=True).drop("load_ts")


NARROW_SPEC = replace(
    EVENTS_SPEC,
    schema=T.StructType([replace_type(f, T.ByteType()) if f.name == "user_id" else f for f in EVENTS_SPEC.schema]),
)


@query
def rejected_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per day on record, the rows written and the values that did not fit: users are numbered beyond a byte."""
    base = scratch_dir(spark, "rejected")
    zone = landing_zone(table(spark, sf_dir, "events"), "ts", NARROW_SPEC)
    records = ledger.Ledger(spark, f"{base}/ledger")
    flow = DailyFlow(Warehouse(spark, f"{base}/warehouse"), records, zone, [NARROW_SPEC])
    # One row per day of the calendar.
    days = frontier.asset_days(arrivals(spark, NARROW_SPEC, zone)).select("partition").collect()
    flow.ingest(NARROW_SPEC, sorted(row["partition"] for row in days))
    return records.read().select("asset", "partition", "row_count", "rejected")


def monthly_orders(spark: SparkSession, sf_dir: str) -> Warehouse:
    warehouse = Warehouse(spark, scratch_dir(spark, "orders"))
    month = encode_partition(F.trunc(F.to_date("o_orderdate"), "month"))
    orders = table(spark, sf_dir, "orders").withColumn("dt", month)
    warehouse.write_partitioned(orders, "orders", LANDING_ZONE, even_files=True)
    return warehouse


@query
def partition_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monthly_orders(spark, sf_dir).read_table("orders", LANDING_ZONE)


@query
def partition_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monthly_orders(spark, sf_dir).read_partition("orders", date(1996, 3, 1), LANDING_ZONE)


@query
def partition_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = monthly_orders(spark, sf_dir).read_table("orders", LANDING_ZONE)
    day = decode_partition("dt")
    return rows.select(
        "o_orderkey",
        day.alias("month"),
        partition_key(day).alias("partition_key"),
        window_label("o_orderdate").alias("window"),
        next_day(partition_key("o_orderdate")).alias("next_day"),
    )


@query
def partition_row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monthly_orders(spark, sf_dir).partition_counts("orders", LANDING_ZONE)


@query
def written_row_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The count that is observed during a write, next to the rows found afterwards."""
    warehouse = Warehouse(spark, scratch_dir(spark, "lineitem"))
    written = warehouse.write_table(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate"), "lineitem")
    found = warehouse.read_table("lineitem").agg(F.count(F.lit(1)).alias("found"))
    return found.select(F.lit(written.row_count).cast("long").alias("observed"), "found")


@query
def zone_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    warehouse = Warehouse(spark, scratch_dir(spark, "views"))
    warehouse.register_view("customer", LANDING_ZONE, path=f"{sf_dir}/customer.parquet")
    return warehouse.view("customer", LANDING_ZONE)


@query
def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    path = scratch_dir(spark, "csv")
    write_csv(orders, path)
    return spark.read.schema(orders.schema).option("header", True).csv(path)


@query
def decimal_to_double_(spark: SparkSession, sf_dir: str) -> DataFrame:
    price, tax = F.col("l_extendedprice").cast("decimal(15,2)"), F.col("l_tax").cast("decimal(4,2)")
    items = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        price.alias("price"),
        F.struct(tax.alias("tax"), F.array(price).alias("prices")).alias("nested"),
        F.create_map(F.col("l_returnflag"), price).alias("by_flag"),
    )
    cast = decimal_to_double(items)
    return cast.select(
        "l_orderkey",
        "l_linenumber",
        "price",
        F.col("nested.tax").alias("tax"),
        F.col("nested.prices")[0].alias("first_price"),
        F.map_values("by_flag")[0].alias("flag_price"),
    )


# --- ledger and triggers -----------------------------------------------------------------------------


@query
def ledger_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = ledger.latest_records(events_ledger(spark, sf_dir))
    return latest.select("asset", "latest_partition", "run_key", "seq", ledger.entry("entries", "k").alias("k"))


@query
def ledger_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ledger.records_for(events_ledger(spark, sf_dir), "signup", date(2024, 1, 5))
    return found.groupBy("run_key").agg(F.count(F.lit(1)).alias("records"))


@query
def ledger_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.record_counts(events_ledger(spark, sf_dir))


@query
def ledger_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.run_count(events_ledger(spark, sf_dir))


@query
def ledger_latest_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.latest_partition(daily_orders(spark, sf_dir), "dt")


@query
def arrival_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frontier.arrival_frontier(user_days(spark, sf_dir), EVENTS_START)


def customer_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return orders.select(
        F.col("o_custkey").cast("string").alias("asset"), F.to_date("o_orderdate").alias("partition")
    )


def customer_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("asset"))


@query
def next_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frontier.next_due(customer_ledger(spark, sf_dir), customer_assets(spark, sf_dir), ORDERS_START)


@query
def due_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user is due on the day after the arrival frontier; was there an event that day?"""
    days = user_days(spark, sf_dir)
    due = frontier.next_due(frontier.arrival_frontier(days, EVENTS_START), days, EVENTS_START)
    path = F.concat(F.lit("upload/"), partition_key("next_date"), F.lit("/"), F.col("asset"), F.lit(".csv"))
    return frontier.requests(due, days, path)


@query
def unprocessed_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = user_days(spark, sf_dir)
    processed = days.filter(F.col("event_type").isin("click", "view"))
    return frontier.unprocessed(frontier.asset_days(days), processed, ["asset", "partition"])


@query
def pending_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = user_days(spark, sf_dir)
    return frontier.backlog(days, days, EVENTS_START, EVENTS_END)


# Order priorities as assets: three landing tables, one history built from them.
LANDED_PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM")
HISTORY_PRIORITIES = ("5-LOW",)


def priority_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.to_date("o_orderdate")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("asset"),
        day.alias("partition"),
        day.alias("latest_partition"),
        F.col("o_orderkey").alias("seq"),
    )


@query
def readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = priority_ledger(spark, sf_dir)
    modes = {
        mode: frontier.readiness(records, LANDED_PRIORITIES, HISTORY_PRIORITIES, records, mode)
        for mode in frontier.READINESS_MODES
    }
    exact = modes["exact"].withColumnRenamed("ready", "ready_exact")
    return exact.join(modes["at_least"].withColumnRenamed("ready", "ready_at_least"), "partition")


@query
def next_ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The day after the newest record of another priority, if it is ready."""
    records = priority_ledger(spark, sf_dir)
    ready = frontier.readiness(records, LANDED_PRIORITIES, HISTORY_PRIORITIES, records, "at_least")
    return frontier.next_ready(ready, records, "3-MEDIUM", ORDERS_START)


# --- models and checks -------------------------------------------------------------------------------


def customer_models(spark: SparkSession, sf_dir: str) -> Models:
    warehouse = Warehouse(spark, scratch_dir(spark, "models"))
    warehouse.register_view("customer", STAGING_ZONE, path=f"{sf_dir}/customer.parquet")
    models = Models(warehouse)
    models.source("customer", STAGING_ZONE)
    models.add(*example_models("customer"))
    models.build()
    return models


@query
def model_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customer_models(spark, sf_dir).read("model_first")


@query
def model_second(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customer_models(spark, sf_dir).read("model_second")


@query
def model_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customer_models(spark, sf_dir).check()


@query
def dq_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.unique(table(spark, sf_dir, "orders"), "o_custkey")


@query
def dq_not_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.not_null(daily_events(spark, sf_dir), "vb")


# --- streaming ---------------------------------------------------------------------------------------


def streamed(spark: SparkSession, zone: LandingZone, spec: TableSpec, history: bool) -> DailyFlow:
    base = scratch_dir(spark, "stream")
    flow = DailyFlow(
        Warehouse(spark, f"{base}/warehouse"),
        ledger.Ledger(spark, f"{base}/ledger"),
        zone,
        [spec],
    )
    ingest_stream(flow, spec, f"{base}/checkpoint", history=history).awaitTermination()
    return flow


@query
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    flow = streamed(spark, events_landing(spark, sf_dir), EVENTS_SPEC, history=False)
    return flow.landing(EVENTS_SPEC).drop("load_ts")


@query
def stream_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    zone = landing_zone(daily_events(spark, sf_dir), "dt", DAILY_SPEC)
    flow = streamed(spark, zone, DAILY_SPEC, history=True)
    return flow.history(DAILY_SPEC, AS_OF).drop("load_ts")


@query
def chain_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From landing files to the last model: ingest, history, combined table, models."""
    zone = landing_zone(daily_events(spark, sf_dir), "dt", DAILY_SPEC)
    flow = streamed(spark, zone, DAILY_SPEC, history=True)
    models = Models(flow.warehouse)
    models.source(COMBINED)
    models.add(*example_models(COMBINED))
    days = spark.range(1).select(F.explode(calendar(EVENTS_START, EVENTS_END)).alias("partition"))
    flow.combine_when_ready(days, as_of=AS_OF, models=models)
    return models.read("model_second")


def attribute_spec(name: str, column: str, dtype: T.DataType) -> TableSpec:
    fields = [T.StructField("user_id", T.LongType()), T.StructField(column, dtype)]
    return TableSpec(name=name, schema=T.StructType(fields), key=("user_id",), start=EVENTS_START)


ATTRIBUTE_SPECS = (
    attribute_spec("kind", "event_type", T.StringType()),
    attribute_spec("band", "vb", T.LongType()),
    attribute_spec("failing", "failed", T.BooleanType()),
)


@query
def chain_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three feeds, each with a stream of its own; the gate combines their histories and builds the models."""
    days = daily_events(spark, sf_dir).withColumn("failed", F.col("event_type") == "error")
    days = stored(days.withColumn("day", partition_key("dt")), "daily-events")
    base = scratch_dir(spark, "gate")
    for spec in ATTRIBUTE_SPECS:
        filed = days.select(*spec.schema.names, "day").hint("rebalance", F.col("day"))
        write_csv(filed, f"{base}/upload/{spec.name}", "day")
    # The feeds' folders differ, the rest of their layout does not.
    zone = LandingZone(f"{base}/upload", "{file}/day={date}")
    specs = [replace(spec, file=spec.name) for spec in ATTRIBUTE_SPECS]
    flow = DailyFlow(Warehouse(spark, f"{base}/warehouse"), ledger.Ledger(spark, f"{base}/ledger"), zone, specs)
    for spec in specs:
        ingest_stream(flow, spec, f"{base}/checkpoint-{spec.name}").awaitTermination()
    models = Models(flow.warehouse)
    models.source(COMBINED)
    models.add(*example_models(COMBINED))
    gate_stream(flow, f"{base}/checkpoint-gate", models=models, as_of=AS_OF).awaitTermination()
    return models.read("model_second")


@query
def stream_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the streamed ingest put on record."""
    flow = streamed(spark, events_landing(spark, sf_dir), EVENTS_SPEC, history=False)
    return flow.ledger.read().select("asset", "partition", "row_count")
