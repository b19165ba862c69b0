"""Every registered corpus query with an SQL twin, on the small tables."""

import pytest

from balance_spark.llm.queries import ORACLES, QUERIES
from balance_spark.verify.compare import connect, rows_of

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def second_engine():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_twin(spark, second_engine, name):
    table = QUERIES[name](spark, FOLDER)
    got = rows_of(table.columns, [tuple(r) for r in table.collect()])
    answer = second_engine.execute(ORACLES[name])
    assert got == rows_of([d[0] for d in answer.description], answer.fetchall())


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, len(QUERIES) + 1))
    assert set(ORACLES) <= set(QUERIES)
