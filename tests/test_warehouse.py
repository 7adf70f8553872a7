from datetime import date

import pytest
from feeds import rows
from pyspark.sql import functions as F

from strandline.plans.models import Model, Models, example_models
from strandline.operators.quality import not_null, unique
from strandline.sources.warehouse import Warehouse, quoted


@pytest.fixture
def warehouse(spark, tmp_path):
    return Warehouse(spark, str(tmp_path), default_zone="main_zone")


def numbers(spark, *days):
    return spark.createDataFrame([(i, d) for d in days for i in range(3)], "n int, dt int")


def test_a_day_is_replaced_and_the_others_stay(spark, warehouse):
    assert warehouse.write_partitioned(numbers(spark, 20220101, 20220102), "t").row_count == 6
    again = spark.createDataFrame([(9, 20220102)], "n int, dt int")
    written = warehouse.write_partitioned(again, "t", even_files=True)
    assert written.row_count == 1 and written.path == warehouse.path("t")
    assert rows(warehouse.read_table("t"), "dt", "n") == [(20220101, 0), (20220101, 1), (20220101, 2), (20220102, 9)]
    assert rows(warehouse.partition_counts("t")) == [(20220101, 3), (20220102, 1)]
    warehouse.drop_partition("t", 20220101)
    assert warehouse.read_table("t").count() == 1


def test_a_day_of_many_files_is_compacted(spark, warehouse, tmp_path):
    warehouse.write_partitioned(numbers(spark, *[20220101] * 4, 20220102).repartition(6), "t", "landing")
    folder = tmp_path / "landing" / "t" / "dt=20220101"
    assert len(list(folder.glob("*.parquet"))) > 1
    assert warehouse.compact("t", date(2022, 1, 1), "landing").row_count == 12
    assert len(list(folder.glob("*.parquet"))) == 1
    assert warehouse.read_table("t", "landing").count() == 15


def test_files_are_gzip_parquet_in_day_folders(spark, warehouse, tmp_path):
    warehouse.write_partitioned(numbers(spark, 20220101), "t", "landing")
    files = [f.name for f in (tmp_path / "landing" / "t" / "dt=20220101").glob("*.parquet")]
    assert files and all(f.endswith(".gz.parquet") for f in files)


def test_one_day_is_read_from_its_folder_only(spark, warehouse):
    warehouse.write_partitioned(numbers(spark, 20220101, 20220102), "t")
    found = warehouse.read_partition("t", date(2022, 1, 2))
    assert rows(found) == [(0, 20220102), (1, 20220102), (2, 20220102)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dt" in plan and "= 20220102" in plan


def test_a_whole_table_is_replaced(spark, warehouse):
    warehouse.write_table(spark.range(5), "t")
    assert warehouse.write_table(spark.range(2), "t").row_count == 2
    assert warehouse.read_table("t").count() == 2
    assert warehouse.exists("t") and not warehouse.exists("u")


def test_views_show_days_written_later(spark, warehouse):
    warehouse.write_partitioned(numbers(spark, 20220101), "t", "landing_zone")
    assert warehouse.register_view("t", "landing_zone") == "`landing_zone`.`t`"
    warehouse.write_partitioned(numbers(spark, 20220102), "t", "landing_zone")
    assert warehouse.view("t", "landing_zone").count() == 6
    assert warehouse.view("t", "landing_zone").columns == ["n", "dt"]


def test_names_are_quoted_and_other_types_refused(warehouse):
    assert quoted("a", "b`c") == "`a`.`b``c`"
    assert warehouse.table_name("t") == "`main_zone`.`t`"
    for write in (warehouse.write_table, warehouse.write_partitioned):
        with pytest.raises(TypeError, match="list are not supported"):
            write([1, 2], "t")


def test_models_are_built_in_order_and_checked(spark, warehouse):
    # The stub the combined table started as: three rows.
    warehouse.write_table(spark.range(1, 4).toDF("foo"), "combined_asset")
    warehouse.register_view("combined_asset")
    models = Models(warehouse)
    models.source("combined_asset")
    models.add(*reversed(example_models("combined_asset")))
    assert models.order() == ["model_first", "model_second"]
    built = models.build()
    assert built["model_first"].row_count == 3 and built["model_second"] is None
    assert rows(models.read("model_second")) == [(1, 1), (2, 1), (3, 1)]
    assert dict(models.read("model_first").dtypes) == {"foo": "bigint", "id": "int"}
    # id is 1 in every row, so it cannot be unique.
    assert rows(models.check()) == [
        ("model_first", "id", "not_null", 0),
        ("model_first", "id", "unique", 1),
        ("model_second", "id", "not_null", 0),
        ("model_second", "id", "unique", 1),
    ]
    with pytest.raises(KeyError, match="no source or model"):
        models.table_name("other")
    with pytest.raises(ValueError, match="materialized"):
        Model("m", "SELECT 1", materialized="cube")


def test_checks_return_the_failing_values(spark):
    df = spark.createDataFrame([(1,), (1,), (2,), (None,), (None,)], "id int")
    assert rows(unique(df, "id")) == [(1, 2)]
    assert not_null(df, "id").count() == 2


def test_a_day_is_read_without_a_look_at_the_others(spark, tmp_path):
    warehouse = Warehouse(spark, str(tmp_path / "it's here"))
    every = spark.range(40).select("id", F.lit("x").alias("v"), (F.lit(20220101) + F.col("id") % 4).cast("int").alias("dt"))
    warehouse.write_partitioned(every, "t")
    day = warehouse.read_partition("t", date(2022, 1, 2))
    assert day.columns == ["id", "v", "dt"] and {r.dt for r in day.collect()} == {20220102} and day.count() == 10
    location = next(line for line in plan(day).splitlines() if "Location" in line)
    assert "dt=20220102" in location and "dt=20220101" not in location
    # No file is opened for the schema either: a broken one elsewhere is not noticed.
    (tmp_path / "it's here" / "warehouse" / "t" / "dt=20220103" / "part-0.parquet").write_text("broken")
    assert warehouse.read_partitions("t", [date(2022, 1, 1), date(2022, 1, 4)]).count() == 20
    assert warehouse.read_partition("t", date(2021, 1, 1)).count() == 0
    assert warehouse.declared_schema("t") == warehouse.read_table("t").schema


def plan(df):
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


def test_the_declared_schema_follows_the_last_write(spark, tmp_path):
    warehouse = Warehouse(spark, str(tmp_path))
    warehouse.write_partitioned(spark.sql("SELECT 1 AS a, 20220101 AS dt"), "t")
    warehouse.write_partitioned(spark.sql("SELECT 20220102 AS dt, 2 AS a, 'b' AS b"), "t")
    assert warehouse.read_table("t").columns == ["a", "b", "dt"]
    assert sorted(map(tuple, warehouse.read_table("t").collect())) == [(1, None, 20220101), (2, "b", 20220102)]
    warehouse.write_table(spark.sql("SELECT 1.5 AS c"), "t")
    assert warehouse.read_table("t").columns == ["c"]
