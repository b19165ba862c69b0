from datetime import date

from pyspark.sql import functions as F

from balance_spark.operators.annual import annual, cast_measure
from balance_spark.operators.balance import balance, population
from balance_spark.plans.reports import yearly_balance
from balance_spark.specs import BALANCE, CONSUMPTION, PRODUCTION, Measure

PRODUCED = "siec string, state string, date date, energy_prod double, unique_id string, predicted boolean"
CONSUMED = "nrg_bal string, state string, date date, energy_cons double, unique_id string, predicted boolean"


def produced(spark, *points, state="DE", siec="TOTAL"):
    return spark.createDataFrame(
        [(siec, state, day, value, f"{state};{siec}", flag) for day, value, flag in points], PRODUCED
    )


def consumed(spark, *points, state="DE", sector="FC"):
    return spark.createDataFrame(
        [(sector, state, day, value, f"{state};{sector}", flag) for day, value, flag in points],
        CONSUMED,
    )


def test_mixed_year_sum(spark, rows):
    table = produced(
        spark,
        (date(2024, 1, 1), 10.0, False),
        (date(2024, 2, 1), 10.0, False),
        (date(2024, 3, 1), 5.0, True),
        (date(2023, 1, 1), 1.0, False),
    )
    assert rows(annual(table, PRODUCTION), "date", "energy_prod", "predicted") == [
        (date(2023, 1, 1), 1.0, False),
        (date(2024, 1, 1), 25.0, False),
        (date(2024, 1, 1), 25.0, True),
    ]
    assert rows(annual(table, PRODUCTION, collapse=True), "date", "energy_prod", "predicted") == [
        (date(2023, 1, 1), 1.0, False),
        (date(2024, 1, 1), 25.0, True),
    ]


def test_mixed_year_mean_of_means(spark, rows):
    table = consumed(
        spark,
        (date(2024, 1, 1), 60.0, False),
        (date(2024, 3, 1), 72.0, True),
        (date(2024, 5, 1), 74.0, True),
        (date(2024, 7, 1), 76.0, True),
        (date(2025, 1, 1), 80.0, True),
    )
    assert rows(annual(table, CONSUMPTION, collapse=True), "date", "energy_cons", "predicted") == [
        (date(2024, 1, 1), 67.0, True),
        (date(2025, 1, 1), 80.0, True),
    ]
    assert len(rows(annual(table, CONSUMPTION))) == 3


def test_one_shuffle(spark):
    table = produced(spark, (date(2024, 1, 1), 10.0, False))
    plan = annual(table, PRODUCTION)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_truncation(spark, rows):
    table = spark.createDataFrame([(-1.9,), (1.9,), (None,)], "deficit double")
    assert rows(cast_measure(table, BALANCE)) == [(-1,), (1,), (None,)]


def test_balance_counts_totals_only(spark, rows):
    day = date(2024, 1, 1)
    supply = produced(spark, (day, 10.0, False)).unionByName(
        produced(spark, (day, 4.0, None), siec="CF")
    )
    demand = consumed(spark, (day, 7.0, True)).unionByName(
        consumed(spark, (day, 3.0, None), sector="FC_IND_E")
    )
    got = rows(balance(supply, demand), "def_id", "deficit", "predicted")
    assert got == [
        ("CF;FC", -7.0, True),
        ("CF;FC_IND_E", 0.0, False),
        ("TOTAL;FC", 3.0, True),
        ("TOTAL;FC_IND_E", 10.0, False),
    ]
    yearly = yearly_balance(supply, demand)
    assert rows(yearly, "state", "date", "deficit", "predicted") == [("DE", day, 3.0, True)]
    assert "unique_id_right" in yearly.columns and "predicted_right" not in yearly.columns


def test_balance_of_all_states_is_the_difference_of_the_sums(spark):
    day = date(2024, 1, 1)
    supply = spark.range(50).select(
        F.lit("TOTAL").alias("siec"),
        F.concat(F.lit("S"), "id").alias("state"),
        F.lit(day).alias("date"),
        (F.col("id") * 3.0).alias("energy_prod"),
        F.concat(F.lit("S"), "id", F.lit(";TOTAL")).alias("unique_id"),
        F.lit(False).alias("predicted"),
    )
    demand = supply.select(
        F.lit("FC").alias("nrg_bal"), "state", "date",
        (F.col("energy_prod") - 2).alias("energy_cons"), "unique_id", "predicted",
    )
    assert yearly_balance(supply, demand).agg(F.sum("deficit")).first()[0] == 100.0


def test_population_mean_where_both_exist(spark, rows):
    schema = "state string, date date, population double"
    observed = spark.createDataFrame([("DE", date(2024, 1, 1), 80.0)], schema)
    projected = spark.createDataFrame(
        [("DE", date(2024, 1, 1), 84.0), ("DE", date(2025, 1, 1), 85.0)], schema
    )
    assert rows(population(observed, projected)) == [
        ("DE", date(2024, 1, 1), 82.0),
        ("DE", date(2025, 1, 1), 85.0),
    ]


def test_measure_rejects_unknown_rollup():
    try:
        Measure("v", "c", "T", "median")
    except ValueError:
        return
    raise AssertionError("no error")


def test_unsaid_predicted_counts_as_actual(spark, rows):
    table = spark.createDataFrame(
        [("DE", "DE;TOTAL", "TOTAL", "2020-01-01", 5.0, None), ("DE", "DE;TOTAL", "TOTAL", "2020-02-01", 2.0, True)],
        "state string, unique_id string, siec string, date string, energy_prod double, predicted boolean",
    ).withColumn("date", F.col("date").cast("date"))
    for collapse, flags in ((False, [False, True]), (True, [True])):
        got = rows(annual(table, PRODUCTION, collapse=collapse), "energy_prod", "predicted")
        assert got == [(7.0, flag) for flag in flags]
