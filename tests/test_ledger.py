from datetime import date, datetime

import pytest
from feeds import rows
from pyspark.sql import functions as F

from strandline.operators.frontier import (
    arrival_frontier,
    backlog,
    due_path,
    next_due,
    next_ready,
    readiness,
    requests,
    unprocessed,
)
from strandline.operators.ledger import (
    Ledger,
    entry,
    latest_partition,
    latest_records,
    materialized,
    record_counts,
    records_for,
    run_count,
)
from strandline.sources.landing import LandingZone
from strandline.spec import sample_specs

START = date(2022, 1, 1)


def day(n):
    return date(2022, 1, n)


@pytest.fixture
def ledger(spark, tmp_path):
    return Ledger(spark, str(tmp_path / "ledger"))


def landing(asset, n, count=1):
    return {"asset": asset, "partition": day(n), "row_count": count, "run_key": f"upload/{day(n)}/{asset}"}


def history(asset, n):
    return {"asset": asset, "latest_partition": day(n), "row_count": 1}


def test_an_empty_ledger_reads_as_no_rows(ledger):
    assert ledger.read().count() == 0
    assert not materialized(ledger.read(), "a")


def test_records_are_found_and_the_newest_wins(ledger):
    ledger.append([landing("a", 1), landing("b", 1, 2)])
    ledger.append([history("h", 1)])
    ledger.append([history("h", 2)])
    found = ledger.read()
    assert found.count() == 4
    assert rows(latest_records(found), "asset", "latest_partition") == [("a", None), ("b", None), ("h", day(2))]
    assert materialized(found, "a", day(1)) and not materialized(found, "a", day(2))
    assert rows(records_for(found, partition=day(1)), "asset") == [("a",), ("b",)]
    window = records_for(found, "a").select("window_start", "window_end").first()
    assert tuple(window) == (datetime(2022, 1, 1), datetime(2022, 1, 2))
    assert run_count(found).first()[0] == 4


def test_a_repeated_record_counts_once(ledger):
    ledger.append([landing("a", 1, 5)])
    ledger.append([landing("a", 1, 7)])
    assert rows(ledger.read(), "asset", "row_count") == [("a", 7)]
    assert rows(record_counts(ledger.read_all()), "asset", "records", "rows_written", "row_count") == [("a", 2, 12, 7)]


def test_unknown_columns_are_refused(ledger):
    with pytest.raises(ValueError, match="no such ledger columns"):
        ledger.append([{"asset": "a", "rows": 1}])


def test_entries_by_label(spark):
    df = spark.sql("SELECT map('partition', '2022-01-01') AS m")
    assert tuple(df.select(entry("m", "partition"), entry("m", "other")).first()) == ("2022-01-01", None)


def partitions(spark, *found):
    return spark.createDataFrame([(a, day(n)) for a, n in found], "asset string, partition date")


def test_the_frontier_stops_at_the_first_gap(spark):
    arrived = partitions(spark, ("a", 1), ("a", 2), ("a", 2), ("a", 4), ("b", 2))
    assert rows(arrival_frontier(arrived, START)) == [("a", day(1)), ("a", day(2))]


def test_next_due_is_the_day_after_the_last_or_the_start(spark):
    assets = spark.createDataFrame([("a",), ("b",)], "asset string")
    assert rows(next_due(partitions(spark, ("a", 1), ("a", 3)), assets, START)) == [("a", day(4)), ("b", START)]


def test_missing_files_are_skipped_with_the_reason(spark):
    spec = sample_specs()["foo"]
    due = next_due(partitions(spark), spark.createDataFrame([("a",), ("b",)], "asset string"), START)
    asked = requests(due, partitions(spark, ("a", 1)), due_path(spec, LandingZone()))
    path = "upload/2022-01-01/foo.csv"
    assert rows(asked) == [("a", START, path, True, None), ("b", START, path, False, f"Did not find file {path}")]


def test_unprocessed_and_backlog(spark):
    arrived = partitions(spark, ("a", 1), ("a", 2))
    done = partitions(spark, ("a", 1))
    assert rows(unprocessed(arrived, done, ["asset", "partition"])) == [("a", day(2))]
    assets = spark.createDataFrame([("a",)], "asset string")
    assert rows(backlog(done, assets, START, day(4))) == [("a", day(2)), ("a", day(3))]


def days(spark, *numbers):
    return spark.createDataFrame([(day(n),) for n in numbers], "partition date")


def test_readiness_needs_every_input(spark, ledger):
    calendar = days(spark, 1, 2, 3)

    def ready(mode):
        found = readiness(ledger.read(), ["a", "b"], ["h"], calendar, mode)
        return [r["ready"] for r in found.orderBy("partition").collect()]

    ledger.append([landing("a", 1), landing("b", 1), landing("a", 2)])
    assert ready("exact") == [False, False, False]
    ledger.append([history("h", 1)])
    assert ready("exact") == [True, False, False]
    ledger.append([landing("b", 2), history("h", 2)])
    # The history has moved past day 1: equality never holds for it again.
    assert ready("exact") == [False, True, False]
    assert ready("at_least") == [True, True, False]
    ledger.append([{"asset": "h", "row_count": 1}])
    assert ready("at_least") == [False, False, False]
    with pytest.raises(ValueError, match="mode"):
        ready("other")


def test_days_are_built_in_order(spark, ledger):
    calendar = days(spark, 1, 2)
    ledger.append([landing("a", 1), landing("a", 2), history("h", 2)])

    def due():
        ready = readiness(ledger.read(), ["a"], ["h"], calendar, "at_least")
        return rows(next_ready(ready, ledger.read(), "child", START))

    assert due() == [(day(1),)]
    ledger.append([history("child", 1)])
    assert due() == [(day(2),)]
    ledger.append([history("child", 2)])
    assert due() == []


def test_the_newest_partition_is_passed_on(spark):
    assert latest_partition(partitions(spark, ("a", 1), ("a", 3)), "partition").first()[0] == day(3)
    assert latest_partition(partitions(spark), F.col("partition")).first()[0] is None


def test_records_keep_their_order_whatever_the_clocks_say(spark, ledger, monkeypatch):
    other = Ledger(spark, ledger.path)
    ledger.append([landing("a", 1, 5), history("h", 1)])
    monkeypatch.setattr(other, "_now", lambda: datetime(1999, 1, 1))  # the second writer's clock is set back
    other.append([landing("a", 1, 7), history("h", 2)])
    ledger.append([landing("b", 1, 1)])
    found = rows(latest_records(ledger.read()), "asset", "row_count", "latest_partition")
    assert found == [("a", 7, None), ("b", 1, None), ("h", 1, day(2))]
    assert [r.seq for r in ledger.read_all().orderBy("seq").collect()] == [1, 2, 3, 4, 5]


def test_writers_at_once_agree_on_the_newest(spark, tmp_path, monkeypatch):
    for turn in (0, 1):
        one, two = (Ledger(spark, str(tmp_path / str(turn))) for _ in range(2))
        first, second = ([history("h", 3)], [history("h", 2)])[:: 1 - 2 * turn]
        # Both look before either has written.
        monkeypatch.setattr(two, "_unfolded", lambda content: [])
        one.append(first)
        two.append(second)
        assert rows(latest_records(one.read()), "asset", "latest_partition") == [("h", day(3))]


@pytest.mark.parametrize("step", [None, "switch", "forget"])
def test_a_compacted_ledger_has_every_record_once(spark, tmp_path, monkeypatch, step):
    ledger = Ledger(spark, str(tmp_path / "ledger"), compact_after=3)
    reader = Ledger(spark, ledger.path)
    expected = []
    for n in range(1, 9):
        if step and n == 6:  # killed on the way
            with monkeypatch.context() as patched:
                patched.setattr(ledger.manifest, step, lambda *_: (_ for _ in ()).throw(KeyboardInterrupt))
                with pytest.raises(KeyboardInterrupt):
                    ledger.compact()
            assert rows(reader.read(), "asset", "partition") == expected
        ledger.append([landing("a", n)])
        expected.append(("a", day(n)))
        assert rows(reader.read_all(), "asset", "partition") == expected
    assert len(ledger._log()) < 8 and reader.manifest.newest()[0] >= 2
    assert [r.seq for r in ledger.read_all().orderBy("seq").collect()] == list(range(1, 9))


def test_a_reader_of_the_state_before_still_finds_it(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    ledger.append([landing("a", 1)])
    ledger.append([landing("a", 2)])
    before = ledger.read_all()  # its files are listed
    ledger.compact()
    ledger.append([landing("a", 3)])
    assert before.count() == 2 and ledger.read_all().count() == 3
    ledger.compact()
    assert ledger.read_all().count() == 3


def test_of_two_compactions_at_once_one_counts(spark, tmp_path, monkeypatch):
    one, two = (Ledger(spark, str(tmp_path / "ledger")) for _ in range(2))
    one.append([landing("a", 1)])
    seen = two.manifest.newest()
    one.compact()
    monkeypatch.setattr(two.manifest, "newest", lambda: seen)
    two.compact()
    monkeypatch.undo()
    assert rows(two.read_all(), "asset", "partition") == [("a", day(1))]
