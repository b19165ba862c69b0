from datetime import date

from pyspark.sql import functions as F

from balance_spark.operators.ranking import (
    balance_ranking,
    default_states,
    top_rank_by_year,
    top_states,
)
from balance_spark.sources import dims
from balance_spark.specs import PRODUCTION

DAY = date(2024, 1, 1)


def balances(spark, *pairs, day=DAY):
    return spark.createDataFrame(
        [(state, day, value, "TOTAL;FC") for state, value in pairs],
        "state string, date date, deficit double, def_id string",
    )


def test_top_states(spark):
    table = spark.createDataFrame(
        [("DE", "TOTAL", 5.0), ("DE", "TOTAL", 5.0), ("FR", "TOTAL", 9.0), ("ES", "TOTAL", 9.0),
         ("IT", "TOTAL", 1.0), ("PT", "TOTAL", None), ("PL", "CF", 99.0),
         ("EU27_2020", "TOTAL", 999.0)],
        "state string, siec string, energy_prod double",
    )
    got = top_states(table, PRODUCTION, "TOTAL").collect()
    assert [tuple(r) for r in got] == [("DE", 10.0), ("ES", 9.0), ("FR", 9.0), ("IT", 1.0)]
    assert [r.state for r in top_states(table, PRODUCTION, "TOTAL", k=1).collect()] == ["DE"]
    plan = top_states(table, PRODUCTION, "TOTAL")._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_default_states(spark, rows):
    assert rows(default_states(dims.countries(spark)), "state") == [
        ("DE",), ("ES",), ("FR",), ("IT",)
    ]


def test_five_largest_per_year(spark, rows):
    first = balances(
        spark, ("A", 9.0), ("B", 7.0), ("C", 7.0), ("D", 3.0), ("E", 2.0), ("F", 2.0),
        ("EU27_2020", 50.0),
    )
    second = balances(spark, ("A", -1.0), ("B", -2.0), day=date(2025, 1, 1))
    got = top_rank_by_year(first.union(second).union(second))
    assert rows(got, "date", "rank", "state") == [
        (DAY, 1, "A"), (DAY, 2, "B"), (DAY, 2, "C"), (DAY, 4, "D"), (DAY, 5, "E"),
        (date(2025, 1, 1), 1, "A"), (date(2025, 1, 1), 2, "B"),
    ]


def test_five_largest_are_cut_before_the_shuffle(spark):
    table = spark.range(100_000).select(
        F.concat(F.lit("S"), "id").alias("state"),
        F.make_date(2000 + (F.col("id") / 50_000).cast("int"), F.lit(1), F.lit(1)).alias("date"),
        F.col("id").cast("double").alias("deficit"),
    )
    got = top_rank_by_year(table)
    assert sorted(r.deficit for r in got.collect()) == [*range(49995, 50000), *range(99995, 100000)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "row_number(), 5, Partial" in plan and "row_number(), 5, Final" in plan, plan


def test_ranking(spark):
    table = balances(spark, ("DE", 4.0), ("FR", -2.0), ("IT", 0.0), ("EU27_2020", -1.0))
    other = balances(spark, ("DE", 99.0)).withColumn("def_id", F.lit("CF;FC"))
    earlier = balances(spark, ("DE", 99.0), day=date(2023, 1, 1))
    got = balance_ranking(table.union(other).union(earlier), "2024-01-01", 27).collect()
    assert [tuple(r) for r in got] == [
        ("DE", 4.0, "Maggiore"), ("IT", 0.0, "Minore"), ("EU", -1.0, "EU"), ("FR", -2.0, "Minore"),
    ]
