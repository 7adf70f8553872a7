from datetime import date

import pytest
from feeds import DAYS, deliver, rows, sample_zone
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.functions.casting import MISSING_TOKENS, decimal_to_double
from strandline.functions.dates import calendar, decode_partition, encode_partition, next_day, window_label
from strandline.sources.landing import DATE_GLOB, LandingZone, arrivals, landed, read_landing
from strandline.sources.synthetic import synthetic_rows, write_csv
from strandline.spec import TableSpec, sample_specs

SPECS = sample_specs()


def test_paths_follow_the_template():
    zone = LandingZone()
    assert zone.path(SPECS["foo"], date(2022, 1, 1)) == "upload/2022-01-01/foo.csv"
    assert zone.glob(SPECS["foo"]) == f"upload/{DATE_GLOB}/foo.csv"


def test_rows_carry_lineage(spark, tmp_path):
    zone = sample_zone(tmp_path)
    found = read_landing(spark, SPECS["baz"], zone)
    assert found.columns == ["foo", "bar_col", "baz_col", "event_dt", "load_ts", "dt"]
    assert dict(found.dtypes) == {
        "foo": "string",
        "bar_col": "bigint",
        "baz_col": "string",
        "event_dt": "string",
        "load_ts": "timestamp",
        "dt": "int",
    }
    assert rows(found, "foo", "bar_col", "event_dt", "dt") == [
        ("baz", 1, "2022-01-01", 20220101),
        ("baz", 1, "2022-01-02", 20220102),
        ("baz", 5, "2022-01-03", 20220103),
        ("baz2", 1, "2022-01-01", 20220101),
        ("baz2", 1, "2022-01-02", 20220102),
        ("baz2", 20, "2022-01-03", 20220103),
    ]
    assert found.select("load_ts").distinct().count() == 1


def test_single_days_can_be_read(spark, tmp_path):
    zone = sample_zone(tmp_path)
    assert rows(read_landing(spark, SPECS["foo"], zone, DAYS[1:2]), "foo", "event_dt") == [(1, "2022-01-02")]


def test_folders_that_are_no_date_are_not_landing_files(spark, tmp_path):
    zone = sample_zone(tmp_path)
    (tmp_path / "old").mkdir()
    (tmp_path / "old" / "foo.csv").write_text("foo,bar_col,baz_col\n7,7,x")
    assert read_landing(spark, SPECS["foo"], zone).count() == 3


def test_missing_tokens_are_null_and_gaps_keep_the_type(spark, tmp_path):
    lines = "\n".join(f'{i},{token},"{token}"' for i, token in enumerate(MISSING_TOKENS))
    deliver(tmp_path, "foo", DAYS[0], lines)
    found = read_landing(spark, SPECS["foo"], LandingZone(str(tmp_path)))
    assert found.count() == len(MISSING_TOKENS)
    assert found.filter("bar_col IS NULL AND baz_col IS NULL").count() == len(MISSING_TOKENS)


def test_values_that_do_not_fit_become_null_or_fail(spark, tmp_path):
    deliver(tmp_path, "foo", DAYS[0], "1,many,A")
    zone = LandingZone(str(tmp_path))
    assert rows(read_landing(spark, SPECS["foo"], zone), "foo", "bar_col") == [(1, None)]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        read_landing(spark, SPECS["foo"], zone, strict=True).collect()


def test_quotes_are_doubled_and_reader_options_pass_through(spark, tmp_path):
    deliver(tmp_path, "foo", DAYS[0], '1;2;"say ""x; y"""')
    (tmp_path / "2022-01-01" / "foo.csv").write_text('foo;bar_col;baz_col\n1;2;"say ""x; y"""')
    found = read_landing(spark, SPECS["foo"], LandingZone(str(tmp_path)), sep=";")
    assert rows(found, "foo", "bar_col", "baz_col") == [(1, 2, 'say "x; y"')]


def test_arrivals_list_files_without_reading_them(spark, tmp_path):
    zone = sample_zone(tmp_path)
    found = arrivals(spark, SPECS["bar"], zone)
    assert rows(found, "asset", "partition", "run_key") == [
        ("bar_asset", day, zone.path(SPECS["bar"], day)) for day in DAYS
    ]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan
    assert landed(spark, SPECS["bar"], zone, DAYS[0])
    assert not landed(spark, SPECS["bar"], zone, date(2022, 1, 9))


def test_partition_keys(spark):
    df = spark.createDataFrame([(20220101, date(2022, 1, 31)), (20221399, None)], "n int, d date")
    found = df.select(decode_partition("n"), encode_partition("d"), next_day("d"), window_label("d")).collect()
    assert tuple(found[0]) == (date(2022, 1, 1), 20220131, date(2022, 2, 1), "20220131000000_20220201000000")
    assert found[1][0] is None and found[1][1] is None
    days = spark.range(1).select(calendar(date(2022, 1, 30), date(2022, 2, 2)), calendar(date(2022, 1, 1), date(2022, 1, 1)))
    assert [len(c) for c in days.first()] == [3, 0]


def test_decimals_become_doubles_at_any_depth(spark):
    df = spark.sql(
        """SELECT 1 AS id, CAST(1.5 AS DECIMAL(10,2)) AS d, array(CAST(2.5 AS DECIMAL(5,1))) AS a,
        map('k', CAST(1 AS DECIMAL(3,0))) AS m, named_struct('decimal(1,2)', 'text', 'x', CAST(3 AS DECIMAL(9,3))) AS s,
        'decimal' AS `decimal(3,4)`"""
    )
    cast = decimal_to_double(df)
    assert dict(cast.dtypes) == {
        "id": "int",
        "d": "double",
        "a": "array<double>",
        "m": "map<string,double>",
        "s": "struct<decimal(1,2):string,x:double>",
        "decimal(3,4)": "string",
    }
    assert cast.first()["s"] == ("text", 3.0)


def test_synthetic_rows_are_seeded(spark, tmp_path):
    found = synthetic_rows(spark, 1000)
    assert found.columns == ["foo", "bar_col", "baz_col"]
    assert found.exceptAll(synthetic_rows(spark, 1000)).isEmpty()
    spread = found.agg(F.count_distinct("foo"), F.min("bar_col"), F.max("baz_col"), F.count_distinct("bar_col")).first()
    assert spread[0] == 1 and spread[1] >= 0 and spread[2] < 1 and spread[3] == 1000
    write_csv(found, str(tmp_path / "csv"))
    back = spark.read.schema(found.schema).option("header", True).csv(str(tmp_path / "csv"))
    assert back.exceptAll(found).isEmpty() and back.count() == 1000


def one_file(base, name, content):
    (base / "2022-01-01").mkdir(parents=True)
    (base / "2022-01-01" / name).write_text(content)
    return LandingZone(str(base))


def spec_of(name="t", **more):
    return TableSpec(name=name, schema=T.StructType([T.StructField("k", T.LongType()), T.StructField("v", T.StringType())]), key=("k",), **more)


@pytest.mark.parametrize("header", ["v,k", "k", "k,v,w", "k,other"])
def test_a_header_that_is_not_the_declared_one_fails(spark, tmp_path, header):
    zone = one_file(tmp_path / "up", "t.csv", header + "\n" + ",".join("1" for _ in header.split(",")) + "\n")
    with pytest.raises(Exception, match="(?i)header"):
        read_landing(spark, spec_of(), zone).collect()


def test_line_breaks_in_quotes_and_own_missing_tokens(spark, tmp_path):
    zone = one_file(tmp_path / "up", "t.csv", 'k,v\n1,"two\nlines"\n2,NA\n3,-\n')
    spec = spec_of(multi_line=True, missing=("", "-"))
    assert [(r.k, r.v) for r in read_landing(spark, spec, zone).orderBy("k").collect()] == [(1, "two\nlines"), (2, "NA"), (3, None)]


def test_a_name_with_a_space_and_a_plus(spark, tmp_path):
    zone = one_file(tmp_path / "my up+", "my t.csv", "k,v\n1,a\n")
    assert [(r.event_dt, r.dt) for r in read_landing(spark, spec_of("my t"), zone).collect()] == [("2022-01-01", 20220101)]
