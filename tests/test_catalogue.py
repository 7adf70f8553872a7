import os

import pytest
from compare import TESTDATA, oracle, spark_rows, sql_rows

from __spark_entry__ import entry
from strandline.plans.catalogue import QUERIES
from strandline.plans.oracles import ORACLES

SF_DIR = f"{TESTDATA}/sf{os.environ.get('TEST_SF', '0.001')}"


@pytest.fixture(scope="module")
def duck():
    return oracle(SF_DIR)


def test_every_query_has_its_sql():
    assert set(ORACLES) == set(QUERIES)


def test_entry_returns_rows(spark):
    assert entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows_as_sql(spark, duck, name):
    assert spark_rows(QUERIES[name](spark, SF_DIR)) == sql_rows(duck, ORACLES[name])
