"""Every registered query against its SQL twin, and the driver's entry points."""

import pytest

import __spark_entry__ as driver
from balance_spark.verify.compare import compare, connect
from balance_spark.verify.oracles import ORACLES
from balance_spark.verify.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
@pytest.fixture(scope="module")
def second_engine():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, second_engine, name):
    _, count, difference = compare(spark, second_engine, name, FOLDER)
    assert difference is None
    assert count > 0


def test_entry_points(spark):
    assert driver.entry(spark).columns[:2] == ["state", "date"]
    assert set(QUERIES) <= set(driver.queries())
    assert set(ORACLES) == set(QUERIES)
