from datetime import date

import pytest
from feeds import DAYS, FILES, HISTORY, HISTORY_COLUMNS, TODAY, deliver, rows, sample_zone

from strandline.operators.ledger import Ledger, latest_records
from strandline.plans.flow import COMBINED, DailyFlow
from strandline.plans.models import Model, Models
from strandline.sources.landing import read_landing, stream_landing
from strandline.sources.warehouse import Warehouse
from strandline.spec import sample_specs
from strandline.streaming.gate import gate_stream
from strandline.streaming.ingest import ingest_stream

SPECS = sample_specs()


def flow_at(spark, base, zone):
    return DailyFlow(
        Warehouse(spark, str(base / "warehouse")), Ledger(spark, str(base / "ledger")), zone, SPECS.values()
    )


@pytest.fixture
def flow(spark, tmp_path):
    return flow_at(spark, tmp_path, sample_zone(tmp_path / "upload"))


def history(flow, name):
    return rows(flow.history(SPECS[name], TODAY), *HISTORY_COLUMNS)


def calendar(spark, n=3):
    return spark.createDataFrame([(d,) for d in [*DAYS, date(2022, 1, 4)][:n]], "partition date")


def test_nine_files_become_eight_versions(flow, spark):
    for name, spec in SPECS.items():
        written = flow.ingest(spec, DAYS)
        assert written.row_count == sum(f.count("\n") + 1 for f in FILES[name])
        flow.refresh_history(spec, DAYS)
        assert history(flow, name) == HISTORY[name]
    view = spark.table("staging.baz_scd2_asset")
    assert view.columns[:5] == ["foo", "bar_col", "baz_col", "event_dt", "load_ts"]
    assert view.filter("valid_to = current_date()").count() == 2
    latest = rows(latest_records(flow.ledger.read()), "asset", "partition", "latest_partition", "row_count")
    assert ("baz_asset", DAYS[2], None, 2) in latest
    assert ("baz_scd2_asset", None, DAYS[2], 4) in latest


def test_day_by_day_equals_all_at_once_and_late_days_fit_in(flow):
    spec = SPECS["baz"]
    for day in (DAYS[0], DAYS[2], DAYS[1]):
        flow.ingest(spec, [day])
        flow.refresh_history(spec, [day])
    assert history(flow, "baz") == HISTORY["baz"]


def test_a_day_in_order_does_not_read_the_days_before(flow):
    spec = SPECS["baz"]
    for day in DAYS:
        flow.ingest(spec, [day])
        flow.refresh_history(spec, [day])
        flow.warehouse.drop_partition(spec.landing_asset, int(f"{day:%Y%m%d}"), "landing")
    assert history(flow, "baz") == HISTORY["baz"]


def test_the_next_due_day_is_requested_or_skipped_with_the_reason(spark, tmp_path):
    base = tmp_path / "upload"
    deliver(base, "foo", DAYS[0])
    deliver(base, "foo", DAYS[1])
    flow = flow_at(spark, tmp_path, sample_zone(base, days=[]))
    flow.ingest(SPECS["foo"], DAYS[:1])
    missing = f"{base}/2022-01-01/{{}}.csv"
    assert rows(flow.requests(), "asset", "next_date", "requested", "skip_reason") == [
        ("bar_asset", DAYS[0], False, f"Did not find file {missing.format('bar')}"),
        ("baz_asset", DAYS[0], False, f"Did not find file {missing.format('baz')}"),
        ("foo_asset", DAYS[1], True, None),
    ]


def test_a_day_delivered_again_replaces_the_first_delivery(flow, tmp_path):
    spec = SPECS["baz"]
    flow.ingest(spec, DAYS)
    flow.refresh_history(spec, DAYS)
    deliver(tmp_path / "upload", "baz", DAYS[2], "baz,5,C")
    flow.ingest(spec, [DAYS[2]])
    flow.refresh_history(spec, [DAYS[2]])
    assert [r for r in history(flow, "baz") if r[0] == "baz2"] == [("baz2", 1, "A", "2022-01-01", DAYS[0], TODAY)]


def test_a_day_delivered_again_without_rows_is_emptied(flow, tmp_path):
    spec = SPECS["bar"]
    flow.ingest(spec, DAYS)
    deliver(tmp_path / "upload", "bar", DAYS[1], "")
    assert flow.ingest(spec, [DAYS[1]]).row_count == 0
    assert rows(flow.landing(spec), "event_dt") == [("2022-01-01",), ("2022-01-03",)]


def test_the_combined_table_is_built_day_by_day_when_all_is_ready(flow, spark):
    for spec in SPECS.values():
        flow.ingest(spec, DAYS[:2])
        flow.refresh_history(spec, DAYS[:2])
    models = Models(flow.warehouse)
    models.source(COMBINED)
    models.add(Model(name="first_model", sql=f"SELECT *, 1 AS id FROM {{{COMBINED}}}", needs=(COMBINED,), materialized="table"))
    models.add(Model(name="second_model", sql="SELECT * FROM {first_model} WHERE id = 1", needs=("first_model",)))
    # Two days at once: what is built contains both, and is recorded as of the second.
    assert flow.combine_when_ready(calendar(spark), as_of=TODAY, models=models) == DAYS[1]
    assert flow.combine_when_ready(calendar(spark), as_of=TODAY, models=models) is None
    assert flow.warehouse.exists(COMBINED)
    records = {r["asset"]: r for r in flow.ledger.read().collect()}
    assert [records[name]["latest_partition"] for name in (COMBINED, "first_model", "second_model")] == [DAYS[1]] * 3
    assert records["second_model"]["row_count"] is None
    assert models.read("second_model").count() == records["first_model"]["row_count"] == records[COMBINED]["row_count"]


def test_three_nullable_feeds_lose_no_combination(spark, tmp_path):
    base = tmp_path / "upload"
    days = [date(2022, 1, n) for n in range(1, 6)]
    values = {"foo": ["1", "", "", "1", "1"], "bar": ["2", "", "", "2", "2"], "baz": ["3", "3", "3", "4", "5"]}
    for name, column in values.items():
        for day, value in zip(days, column, strict=True):
            deliver(base, name, day, f"1,{value},A")
    flow = flow_at(spark, tmp_path, sample_zone(base, days=[]))
    for spec in SPECS.values():
        flow.ingest(spec, days)
        flow.refresh_history(spec, days)
    parts = [flow.history(spec, TODAY).select("bar_col", "valid_from", "valid_to").collect() for spec in SPECS.values()]
    expected = sorted(
        (
            (a[0], b[0], c[0], max(a[1], b[1], c[1]), min(a[2], b[2], c[2]))
            for a in parts[0] for b in parts[1] for c in parts[2]
            if max(a[1], b[1], c[1]) <= min(a[2], b[2], c[2])
        ),
        key=repr,
    )
    assert rows(flow.combined(TODAY), "foo_bar_col", "bar_bar_col", "baz_bar_col", "valid_from", "valid_to") == expected


def test_combined_histories_share_a_key(spark, tmp_path):
    base = tmp_path / "upload"
    for name, line in (("foo", "1,1,A"), ("bar", "1,2,B"), ("baz", "1,3,C")):
        deliver(base, name, DAYS[0], line)
    flow = flow_at(spark, tmp_path, sample_zone(base, days=[]))
    for spec in SPECS.values():
        flow.ingest(spec, DAYS[:1])
        flow.refresh_history(spec, DAYS[:1])
    assert rows(flow.combined(TODAY)) == [("1", 1, "A", 2, "B", 3, "C", DAYS[0], TODAY)]


def test_the_stream_takes_each_file_once(spark, tmp_path):
    base = tmp_path / "upload"
    flow = flow_at(spark, tmp_path, sample_zone(base, DAYS[:2]))
    spec, seen = SPECS["baz"], []

    def run():
        query = ingest_stream(
            flow, spec, str(tmp_path / "checkpoint"), files_per_batch=1, after=lambda _, days: seen.extend(days)
        )
        query.awaitTermination()

    run()
    assert sorted(seen) == DAYS[:2]
    run()
    assert len(seen) == 2
    deliver(base, "baz", DAYS[2])
    run()
    assert seen[2:] == DAYS[2:]
    assert history(flow, "baz") == HISTORY["baz"]
    assert rows(flow.landing(spec), "foo", "event_dt") == rows(
        read_landing(spark, spec, flow.zone), "foo", "event_dt"
    )
    assert flow.ledger.read().filter("asset = 'baz_asset'").count() == 3


def test_rows_can_be_streamed_too(spark, tmp_path):
    zone = sample_zone(tmp_path / "upload")
    query = (
        stream_landing(spark, SPECS["foo"], zone)
        .drop("load_ts")
        .writeStream.option("checkpointLocation", str(tmp_path / "checkpoint"))
        .trigger(availableNow=True)
        .format("parquet")
        .start(str(tmp_path / "out"))
    )
    query.awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "out")), "foo", "event_dt") == [
        (1, "2022-01-01"),
        (1, "2022-01-02"),
        (1, "2022-01-03"),
    ]


def test_values_that_do_not_fit_are_counted_per_day(spark, tmp_path):
    base = tmp_path / "upload"
    deliver(base, "bar", DAYS[0], "bar,1,A\nbar2,x,A\nbar3,,A\nbar4,NA,A")
    deliver(base, "bar", DAYS[1], "bar,1.5,A\nbar2,y,\nbar3,2,A")
    deliver(base, "bar", DAYS[2], "")
    flow = flow_at(spark, tmp_path, sample_zone(base, days=[]))
    written = flow.ingest(SPECS["bar"], DAYS)
    assert (written.row_count, written.metrics) == (7, {"rejected": 3})
    assert rows(flow.ledger.read(), "partition", "row_count", "rejected") == [
        (DAYS[0], 4, 1), (DAYS[1], 3, 2), (DAYS[2], 0, 0),
    ]
    assert "__rejected" not in flow.landing(SPECS["bar"]).columns


def test_many_days_are_written_in_parts(flow, monkeypatch):
    monkeypatch.setattr("strandline.plans.flow.DAYS_AT_ONCE", 2)
    assert flow.ingest(SPECS["baz"], DAYS).row_count == 6
    assert rows(flow.ledger.read(), "partition", "row_count") == [(d, 2) for d in DAYS]


def test_due_files_are_looked_up_without_a_listing(spark, tmp_path, monkeypatch):
    base = tmp_path / "upload"
    flow = flow_at(spark, tmp_path, sample_zone(base, DAYS))
    flow.ingest(SPECS["foo"], DAYS[:2])
    monkeypatch.setattr("strandline.sources.landing.any_match", lambda *_: pytest.fail("the zone is listed"))
    asked = {r["asset"]: (r["next_date"], r["requested"]) for r in flow.requests().collect()}
    assert asked == {"foo_asset": (DAYS[2], True), "bar_asset": (DAYS[0], True), "baz_asset": (DAYS[0], True)}


def test_late_and_replaced_days_are_repaired_through_the_flow(spark, tmp_path):
    base = tmp_path / "upload"
    days = [date(2022, 1, n) for n in range(1, 12)]
    line = lambda d, k: f"{k},{(d.day + len(k)) // 3},A"
    full = {d: "\n".join(line(d, k) for k in ("x", "yy", "zzz")) for d in days}
    for d in days:
        deliver(base, "bar", d, full[d])
    deliver(base, "bar", days[4], "yy,99,B\ngone,1,C")  # replaced later
    flow, spec = flow_at(spark, tmp_path, sample_zone(base, days=[])), SPECS["bar"]
    table = flow.history_table(spec)
    table.tails = 1
    flow.history_table = lambda _: table
    for part in ([d for d in days[:8] if d != days[2]], days[8:]):
        flow.ingest(spec, part)
        flow.refresh_history(spec, part)
    old = {s["name"] for s in table.states()}
    deliver(base, "bar", days[4], full[days[4]])
    flow.ingest(spec, [days[2], days[4]])
    versions = flow.refresh_history(spec, [days[2], days[4]])
    assert old < {s["name"] for s in table.states()}
    assert not list((tmp_path / "warehouse" / "staging" / "bar_scd2_asset" / "_replaced").glob("[!.]*"))
    again = flow_at(spark, tmp_path / "again", flow.zone)
    again.ingest(spec, days)
    assert again.refresh_history(spec, days) == versions
    assert history(flow, "bar") == history(again, "bar")
    assert not [r for r in history(flow, "bar") if r[0] == "gone"]


def test_the_gate_opens_once_for_each_complete_day(spark, flow, tmp_path, monkeypatch):
    built = []
    models = Models(flow.warehouse)
    models.source(COMBINED)
    models.add(Model(name="gated", sql=f"SELECT * FROM {{{COMBINED}}}", needs=(COMBINED,), materialized="table"))

    def gate():
        gate_stream(flow, str(tmp_path / "gate"), models=models, as_of=TODAY, after=built.append).awaitTermination()
        return list(built)

    def deliver_to(names, days):
        for name in names:
            flow.ingest(SPECS[name], days)
            flow.refresh_history(SPECS[name], days)

    deliver_to(["foo", "bar"], DAYS[:1])
    assert gate() == []
    deliver_to(["baz"], DAYS[:1])
    real = flow.combined
    monkeypatch.setattr(flow, "combined", lambda *_: (_ for _ in ()).throw(KeyError("killed")))
    with pytest.raises(Exception, match="killed"):
        gate()
    monkeypatch.setattr(flow, "combined", real)
    assert gate() == DAYS[:1]  # the batch that failed is done again
    deliver_to(["baz"], DAYS[:1])  # the same records again
    assert gate() == DAYS[:1]
    deliver_to(["foo", "bar", "baz"], DAYS[1:])
    assert gate() == [DAYS[0], DAYS[2]]  # both days at once
    assert flow.ledger.read().filter("asset = 'gated'").count() == 2
