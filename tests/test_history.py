import uuid
from datetime import date, datetime, timedelta

import pytest
from feeds import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from reference import compress

from strandline.operators.history import change_flags, compress_history, order_violations
from strandline.operators.incremental import (
    HistoryTable,
    append_versions,
    closed_versions,
    current_history,
    land_in_buckets,
    open_versions,
    rebuild_buckets,
    rows_of_buckets,
    tail_rows,
    touched_buckets,
)
from strandline.operators.repair import rows_to_compress, windows
from strandline.operators.slicing import compress_history_sliced
from strandline.scratch import stored
from strandline.sources.warehouse import Warehouse
from strandline.functions.dates import encode_partition, decode_partition

END = date(2030, 1, 1)
BASE = date(2022, 1, 1)
SCHEMA = "k int, d date, v string, w int"


def day(n):
    return BASE + timedelta(days=n - 1)


def frame(spark, records):
    return spark.createDataFrame(records, SCHEMA)


def expected(records, compared):
    named = [dict(zip(("k", "d", "v", "w"), r, strict=True)) for r in records]
    found = compress(named, "k", "d", compared, END)
    return sorted(((r["k"], r["d"], r["v"], r["w"], r["valid_to"]) for r in found), key=repr)


NULL_CASES = [(1, 1, "a"), (1, 2, None), (1, 3, None), (1, 4, "a"), (1, 5, "a"), (2, 1, None), (2, 2, None)]
NULL_CASES += [(3, 1, "x"), (3, 2, None)]
NULL_HISTORY = [
    (1, day(1), "a", day(1)),
    (1, day(3), None, day(4)),
    (1, day(4), "a", END),
    (2, day(1), None, day(1)),
    (2, day(2), None, END),
    (3, day(1), "x", END),
]


def test_nulls_are_three_valued(spark):
    df = spark.createDataFrame([(k, day(d), v) for k, d, v in NULL_CASES], "k int, d date, v string")
    assert rows(compress_history(df, ["k"], ["d"], "d", as_of=END)) == sorted(NULL_HISTORY, key=repr)


def test_distinct_mode_takes_null_as_a_value(spark):
    df = spark.createDataFrame([(k, day(d), v) for k, d, v in NULL_CASES], "k int, d date, v string")
    found = rows(compress_history(df, ["k"], ["d"], "d", as_of=END, null_mode="distinct"))
    assert found == sorted(
        [
            (1, day(1), "a", day(1)),
            (1, day(2), None, day(3)),
            (1, day(4), "a", END),
            (2, day(1), None, END),
            (3, day(1), "x", day(1)),
            (3, day(2), None, END),
        ],
        key=repr,
    )


def test_today_is_the_default_end_and_columns_keep_their_place(spark):
    df = frame(spark, [(1, day(1), "a", 1)])
    history = compress_history(df, ["k"], ["d"], "d", ["w"], open_flag="is_open")
    assert history.columns == ["k", "valid_from", "v", "w", "valid_to", "is_open"]
    assert history.select((F.col("valid_to") == F.current_date()) & F.col("is_open")).first()[0]


def test_a_time_outside_the_order_is_compared(spark):
    df = spark.createDataFrame([(1, 1, day(1), "a"), (1, 2, day(2), "a")], "k int, n int, d date, v string")
    assert compress_history(df, ["k"], ["n"], "d", as_of=END).count() == 2


def test_nothing_to_compare_fails_with_the_reason(spark):
    with pytest.raises(ValueError, match="no columns left to compare"):
        compress_history(frame(spark, []), ["k"], ["d"], "d", ["v", "w"])
    with pytest.raises(ValueError, match="null_mode"):
        compress_history(frame(spark, []), ["k"], ["d"], "d", null_mode="other")


def test_change_flags_are_null_where_the_value_turns_null(spark):
    df = frame(spark, [(1, day(1), "a", 1), (1, day(2), None, 1), (1, day(3), "a", 1)])
    found = change_flags(df, ["k"], ["d"], ["v"]).orderBy("d").select("is_start", "is_end")
    assert [tuple(r) for r in found.collect()] == [(True, True), (None, None), (True, True)]


def test_order_ties_are_counted(spark):
    df = frame(spark, [(1, day(1), "a", 1), (1, day(1), "b", 1), (2, day(1), "a", 1)])
    assert rows(order_violations(df, ["k"], ["d"])) == [(1, day(1), 2)]


def test_one_shuffle_and_one_sort_without_the_neighbour_struct(spark):
    df = frame(spark, [(1, day(1), "a", 1)])
    plan = compress_history(df, ["k"], ["d"], "d", as_of=END)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    assert plan.count("Sort ") == 1
    below_the_sort = plan[plan.index("Sort ") :]
    assert "struct(" not in below_the_sort


def test_a_key_filter_reaches_the_scan_and_a_time_filter_does_not(spark, tmp_path):
    frame(spark, [(1, day(1), "a", 1), (2, day(2), "a", 1)]).write.parquet(str(tmp_path / "t"))
    history = compress_history(spark.read.parquet(str(tmp_path / "t")), ["k"], ["d"], "d", as_of=END)
    by_key = history.filter("k = 1")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(k,1)" in by_key
    by_time = history.filter("valid_from = date'2022-01-02'")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(d" not in by_time


record = st.tuples(
    st.integers(1, 3), st.integers(1, 12), st.sampled_from(["a", "b", None]), st.sampled_from([1, 2, None])
)
feeds = st.lists(record, min_size=1, max_size=40, unique_by=lambda r: (r[0], r[1])).map(
    lambda found: [(k, day(d), v, w) for k, d, v, w in found]
)
relaxed = settings(
    max_examples=12, deadline=None, derandomize=True, suppress_health_check=[HealthCheck.function_scoped_fixture]
)


@relaxed
@given(records=feeds)
def test_any_history_matches_the_definition(spark, records):
    df = frame(spark, records)
    assert rows(compress_history(df, ["k"], ["d"], "d", as_of=END)) == expected(records, ["v", "w"])
    assert rows(compress_history(df, ["k"], ["d"], "d", ["w"], as_of=END)) == expected(records, ["v"])


@settings(relaxed, max_examples=8)
@given(records=feeds, size=st.integers(1, 6))
def test_slices_change_nothing(spark, records, size):
    df = frame(spark, records)
    sliced = compress_history_sliced(df, ["k"], ["d"], "d", as_of=END, rows_per_slice=size)
    assert rows(sliced) == expected(records, ["v", "w"])


def test_null_keys_are_one_key_in_slices_too(spark):
    records = [(None, day(d), "ab"[d // 4 % 2], 1) for d in range(1, 20)] + [(1, day(1), "a", 1)]
    df = frame(spark, records)
    plain = rows(compress_history(df, ["k"], ["d"], "d", as_of=END))
    assert rows(compress_history_sliced(df, ["k"], ["d"], "d", as_of=END, rows_per_slice=5)) == plain


def test_one_key_with_tied_rows_is_split(spark):
    df = spark.range(1000).select(F.lit("foo").alias("k"), F.lit(BASE).alias("d"), F.lit("x").alias("v"))
    history = compress_history_sliced(df, ["k"], ["d"], "d", as_of=END, rows_per_slice=100)
    assert rows(history) == [("foo", BASE, "x", END)]


def test_times_need_not_be_dates(spark):
    moment = datetime(2022, 1, 1)
    df = spark.createDataFrame([(1, moment, "a"), (1, moment + timedelta(hours=1), "b")], "k int, t timestamp_ntz, v string")
    history = compress_history(df, ["k"], ["t"], "t", as_of=datetime(2030, 1, 1))
    assert rows(history, "valid_from", "valid_to") == [
        (moment, moment),
        (moment + timedelta(hours=1), datetime(2030, 1, 1)),
    ]


@settings(relaxed, max_examples=6)
@given(
    records=feeds,
    cuts=st.lists(st.integers(1, 12), min_size=1, max_size=3),
    size=st.sampled_from([None, 2, 5]),
    null_mode=st.sampled_from(["reference", "distinct"]),
)
def test_appending_in_order_equals_a_full_run(spark, records, cuts, size, null_mode):
    df = frame(spark, records).cache()
    borders = [day(0), *sorted({day(c) for c in cuts}), day(13)]
    tail, versions = None, []
    for low, high in zip(borders, borders[1:], strict=False):
        batch = df.filter((F.col("d") > F.lit(low)) & (F.col("d") <= F.lit(high)))
        settled = append_versions(tail, batch, ["k"], ["d"], "d", null_mode=null_mode, rows_per_slice=size)
        versions += closed_versions(settled, "d").collect()
        new_tail = tail_rows(settled)
        kept = new_tail.collect()
        assert all(sum(r["k"] == k for r in kept) <= 3 for k in (1, 2, 3))
        tail = spark.createDataFrame(kept, new_tail.schema)
    current = open_versions(tail, "d")
    every = current.unionByName(spark.createDataFrame(versions, current.schema))
    found = rows(current_history(every, END).select("k", "valid_from", "v", "w", "valid_to"))
    full = compress_history(df, ["k"], ["d"], "d", as_of=END, null_mode=null_mode)
    assert found == rows(full.select("k", "valid_from", "v", "w", "valid_to"))


def test_a_stored_history_needs_a_date(spark, tmp_path):
    table = HistoryTable(Warehouse(spark, str(tmp_path)), "h", "staging", ["k"], ["n"], "n")
    with pytest.raises(TypeError, match="rebuild_buckets"):
        table.update(spark.createDataFrame([(1, 1, "a")], "k int, n int, v string"), BASE, BASE)


@settings(relaxed, max_examples=4)
@given(records=feeds, seed=st.randoms(use_true_random=False), tails=st.integers(1, 3))
def test_a_stored_history_takes_days_in_any_order(spark, tmp_path_factory, records, seed, tails):
    warehouse = Warehouse(spark, str(tmp_path_factory.mktemp("history")))
    table = HistoryTable(warehouse, "h", "staging", ["k"], ["d"], "d", rows_per_slice=4, tails=tails)
    days = sorted({r[1] for r in records})
    seed.shuffle(days)
    there = []
    for part in (days[::3], days[1::3], days[2::3], days[:1]):  # the last one delivered again
        if not part:
            continue
        there = [r for r in records if r[1] in part or r in there]
        versions = table.update(frame(spark, there), min(part), max(r[1] for r in there))
        assert len(table.through()) <= tails
    found = rows(table.read(END).select("k", "valid_from", "v", "w", "valid_to"))
    assert found == expected(records, ["v", "w"]) and len(found) == versions
    assert spark.table("staging.h").count() == versions


@settings(relaxed, max_examples=4)
@given(records=feeds, seed=st.randoms(use_true_random=False))
def test_buckets_in_any_order_equal_a_full_run(spark, tmp_path_factory, records, seed):
    warehouse = Warehouse(spark, str(tmp_path_factory.mktemp("buckets")))
    days = sorted({r[1] for r in records})
    seed.shuffle(days)
    for part in (days[::2], days[1::2]):
        if not part:
            continue
        batch = frame(spark, [r for r in records if r[1] in part])
        warehouse.write_partitioned(batch.withColumn("dt", encode_partition("d")).drop("d"), "rows")
        landed = warehouse.read_table("rows").withColumn("dt", decode_partition("dt"))
        touched = touched_buckets(batch, ["k"], 4)
        for _ in range(2):  # a repeated batch changes nothing
            rebuild_buckets(
                warehouse, "history", "staging", landed, touched, ["k"], ["dt"], "dt", buckets=4, rows_per_slice=3
            )
    stored = warehouse.read_table("history", "staging")
    found = rows(current_history(stored, END).select("k", "valid_from", "v", "w", "valid_to"))
    assert found == expected(records, ["v", "w"])


def test_appended_rows_that_tie_leave_one_open_version(spark):
    schema = "k int, d date, v string"
    one = spark.createDataFrame([(1, date(2022, 1, 1), "a")], schema)
    two = spark.createDataFrame([(1, date(2022, 1, 2), "b"), (1, date(2022, 1, 2), "c")], schema)
    for size in (None, 1):
        first = append_versions(None, one, ["k"], ["d"], "d", rows_per_slice=size)
        both = append_versions(tail_rows(first), two, ["k"], ["d"], "d", rows_per_slice=size)
        kept = stored(both, "both")
        assert open_versions(tail_rows(kept), "d").count() == 1
        assert closed_versions(first, "d").count() + closed_versions(kept, "d").count() == 2


def test_a_failed_update_leaves_the_history_as_it_was(spark, tmp_path):
    table = HistoryTable(Warehouse(spark, str(tmp_path)), "h_failing", "staging", ["k"], ["d"], "d")
    days = [BASE, BASE + timedelta(days=1)]
    good = spark.createDataFrame([(1, days[0], "a"), (1, days[1], "b")], "k int, d date, v string")
    table.update(good.filter(F.col("d") == days[0]), days[0], days[0])
    columns = ["k", "v", "valid_from", "valid_to"]
    before = rows(table.read(END), *columns)
    broken = good.withColumn("v", F.when(F.col("d") == days[1], F.raise_error(F.lit("broken"))).otherwise(F.col("v")))
    with pytest.raises(Exception, match="broken"):
        table.update(broken, days[0], days[1])
    view = spark.table("staging.h_failing").withColumn("valid_to", F.lit(END))
    assert rows(table.read(END), *columns) == before == rows(view, *columns)
    table.update(good, days[0], days[1])
    assert table.versions().count() == 2


def stored_history(spark, base, name="h", **options):
    return HistoryTable(Warehouse(spark, str(base)), name, "staging", ["k"], ["d"], "d", **options)


def of(table):
    return rows(table.read(END).select("k", "valid_from", "v", "w", "valid_to"))


@settings(relaxed, max_examples=6)
@given(
    records=feeds,
    late=st.sets(st.integers(1, 12), min_size=1, max_size=3),
    again=st.booleans(),
    null_mode=st.sampled_from(["reference", "distinct"]),
)
def test_days_older_than_all_tails_are_repaired_around_them(spark, tmp_path_factory, records, late, again, null_mode):
    base = tmp_path_factory.mktemp("late")
    table = stored_history(spark, base, f"late_{uuid.uuid4().hex}", tails=1, null_mode=null_mode)
    # The late days are missing at first, or have the values of another day.
    late = {day(n) for n in late}
    early = [(k, d, "z" if d.day % 2 else None, w) if d in late else (k, d, v, w) for k, d, v, w in records]
    early = [r for i, r in enumerate(early) if r[1] not in late or (again and i % 2)]
    days = sorted({r[1] for r in early})
    if not days or not {r[1] for r in records} & late:
        return
    for cut in (days[len(days) // 2], days[-1]):
        some = [r for r in early if r[1] <= cut]
        table.update(frame(spark, some), min(r[1] for r in some) if cut != days[-1] else cut, cut)
    before = frame(spark, [r for r in early if r[1] in late]).select("k", "d") if any(r[1] in late for r in early) else None
    landed = frame(spark, [r for r in records if r[1] in late] + [r for r in early if r[1] not in late])
    last = max(max(days), max(late))
    versions = table.update(landed, min(late), last, sorted(late), before)
    full = compress_history(landed, ["k"], ["d"], "d", as_of=END, null_mode=null_mode)
    assert of(table) == rows(full.select("k", "valid_from", "v", "w", "valid_to"))
    assert versions == len(of(table)) == table.versions().count() == spark.table(f"staging.{table.name}").count()
    # The days after a repair go on from its tail.
    more = landed.unionByName(frame(spark, [(1, day(20), "q", 1), (9, day(20), "q", 1)]))
    table.update(more, day(20), day(20), [day(20)])
    full = compress_history(more, ["k"], ["d"], "d", as_of=END, null_mode=null_mode)
    assert of(table) == rows(full.select("k", "valid_from", "v", "w", "valid_to"))


def long_feed(days=60, keys=4):
    # Values change every five days, at other days for other keys.
    return [(k, day(d), "abcdef"[(d + k) // 5 % 6], 1) for d in range(1, days + 1) for k in range(keys)]


def test_a_repair_reads_only_what_the_late_rows_touch(spark, tmp_path):
    records = long_feed()
    late = day(20)
    table = stored_history(spark, tmp_path, "few", tails=1)
    landed = Warehouse(spark, str(tmp_path / "landing"))

    def land(some):
        landed.write_partitioned(frame(spark, some).withColumn("dt", encode_partition("d")).drop("d"), "rows")
        return landed.read_table("rows").withColumn("d", decode_partition("dt")).drop("dt")

    early = [r for r in records if r[:2] != (1, late) and r[1] != late]
    for cut in (30, 60):
        table.update(land([r for r in early if r[1] <= day(cut)]), day(1) if cut == 30 else day(31), day(cut))
    one = [r for r in records if r[:2] == (1, late)]
    everything = land([*early, *one])
    within = windows(table.versions(), everything.filter(F.col("d") == late).select("k", "d"), ["k"], "d")
    assert within.count() == 1
    local = rows_to_compress(everything, within, ["k"], "d")
    assert local.select("k").distinct().count() == 1 and local.count() < 20
    assert any("PartitionFilters: [" in line and "dt#" in line for line in plan_of(local).splitlines())
    before = {s["name"] for s in table.states()}
    table.update(everything, late, day(60), [late])
    assert of(table) == expected([*early, *one], ["v", "w"])
    # What was there has not been written again.
    assert before < {s["name"] for s in table.states()} and table.states()[-1]["closed"] < 5


def plan_of(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_many_repairs_become_one_state(spark, tmp_path):
    records = long_feed(20, 2)
    table = stored_history(spark, tmp_path, "many", tails=2)
    there = [r for r in records if r[1].day % 3 or r[1] > day(15)]
    table.update(frame(spark, there), day(1), day(20))
    sizes = []
    for n in (3, 6, 9, 12, 15):
        there = [r for r in records if r in there or r[1] == day(n)]
        table.update(frame(spark, there), day(n), day(20), [day(n)])
        assert of(table) == expected(there, ["v", "w"])
        sizes.append(len(table.states()))
    assert max(sizes) <= 4 and 1 in sizes
    assert spark.table("staging.many").count() == table.versions().count()


# A kill after one step is a kill before the next.
STEPS = [("warehouse.write_folder", "before"), ("warehouse.write_folder", "after"), ("manifest.switch", "after"), ("register_view", "after")]


@pytest.mark.parametrize("late", [False, True])
@pytest.mark.parametrize("step, when", [*STEPS, ("manifest.forget", "after")])
def test_a_kill_between_any_two_steps_leaves_a_full_history(spark, tmp_path, monkeypatch, step, when, late):
    records = [(k, day(d), "abc"[(d + k) // 2 % 3], 1) for d in range(1, 9) for k in range(2)]
    first = [r for r in records if (r[1] != day(2) if late else r[1] < day(8))]
    table = stored_history(spark, tmp_path, "killed", tails=1)
    table.update(frame(spark, [r for r in first if r[1] <= day(4)]), day(1), day(4))
    table.update(frame(spark, first), day(5), max(r[1] for r in first))
    days = [day(2)] if late else [day(8)]
    old, new = expected(first, ["v", "w"]), expected(records, ["v", "w"])
    owner, name = (getattr(table, step.split(".")[0]), step.split(".")[1]) if "." in step else (table, step)
    real = getattr(owner, name)

    def die(*args, **kwargs):
        if when == "after":
            real(*args, **kwargs)
        raise KeyboardInterrupt

    with monkeypatch.context() as patched:
        patched.setattr(owner, name, die)
        with pytest.raises(KeyboardInterrupt):
            table.update(frame(spark, records), days[0], day(8), days)
    assert of(stored_history(spark, tmp_path, "killed", tails=1)) in (old, new)
    assert spark.table("staging.killed").count() in (len(old), len(new))
    again = stored_history(spark, tmp_path, "killed", tails=1)
    again.update(frame(spark, records), days[0], day(8), days)
    assert of(again) == new


def test_of_two_jobs_at_once_the_second_fails(spark, tmp_path, monkeypatch):
    one, two = (stored_history(spark, tmp_path, "twice") for _ in range(2))
    one.update(frame(spark, [(1, day(1), "a", 1)]), day(1), day(1))
    real = two._write

    def slow(*args, **kwargs):
        state = real(*args, **kwargs)
        one.update(frame(spark, [(1, day(1), "a", 1), (1, day(2), "b", 1)]), day(2), day(2))
        return state

    monkeypatch.setattr(two, "_write", slow)
    with pytest.raises(FileExistsError):
        two.update(frame(spark, [(1, day(1), "a", 1), (1, day(2), "c", 1)]), day(2), day(2))
    assert [r[2] for r in of(one)] == ["a", "b"]


def test_rows_laid_out_by_bucket_are_pruned(spark, tmp_path):
    warehouse = Warehouse(spark, str(tmp_path))
    records = [(k, day(d), "ab"[(d + k) // 3 % 2], 1) for d in range(1, 9) for k in range(20)]

    def land(some):
        return land_in_buckets(warehouse, "rows", "landing", frame(spark, some).withColumn("dt", encode_partition("d")).drop("d"), ["k"], 8)

    def rebuild(touched):
        rows_ = warehouse.read_table("rows", "landing").withColumn("dt", decode_partition("dt"))
        rebuild_buckets(warehouse, "history", "staging", rows_, touched, ["k"], ["dt"], "dt", buckets=8, rows_per_slice=None)
        return rows(current_history(warehouse.read_table("history", "staging"), END).select("k", "valid_from", "v", "w", "valid_to"))

    rebuild(land([*records, (99, day(4), "gone", 1)]))
    # One day comes again: with fewer keys, and one that changes.
    again = [(k, d, "z" if k == 3 else v, w) for k, d, v, w in records if d == day(4) and k < 5]
    touched = land(again)
    now = [r for r in records if r[1] != day(4)] + again
    assert rebuild(touched) == expected(now, ["v", "w"])
    part = rows_of_buckets(warehouse.read_table("rows", "landing"), touched[:1], ["k"], 8)
    filters = [line for line in plan_of(part).splitlines() if "PartitionFilters" in line]
    assert filters and all("bucket#" in line for line in filters)
    assert {r.bucket for r in part.collect()} == set(touched[:1])
