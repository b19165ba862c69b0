from datetime import date

import pytest
from pyspark.sql import functions as F

from balance_spark.operators import resample
from balance_spark.operators.resample import (
    date_grid,
    forward_fill,
    interpolate,
    one_per_date,
    upsample,
)
from balance_spark.specs import PRODUCTION

SCHEMA = "unique_id string, ds date, y double"


def points(spark, *pairs, key="DE;FC"):
    return spark.createDataFrame([(key, day, value) for day, value in pairs], SCHEMA)


def test_two_month_steps(spark, rows):
    table = points(spark, (date(2020, 1, 1), 0.0), (date(2021, 1, 1), 60.0))
    got = [row.y for row in upsample(table, 2).orderBy("ds").collect()]
    assert got == [0, 10, 20, 30, 40, 50, 60]


def test_over_a_missing_year(spark):
    table = points(spark, (date(2020, 1, 1), 0.0), (date(2022, 1, 1), 120.0))
    got = upsample(table, 2).orderBy("ds").collect()
    assert [row.y for row in got] == [10.0 * i for i in range(13)]
    assert got[-1].ds == date(2022, 1, 1)


def test_off_grid_points_are_left_out(spark, rows):
    table = points(
        spark, (date(2020, 1, 1), 1.0), (date(2020, 2, 1), 99.0), (date(2020, 5, 1), 3.0)
    )
    assert rows(date_grid(table, 2, off_grid="drop"), "ds", "y") == [
        (date(2020, 1, 1), 1.0), (date(2020, 3, 1), None), (date(2020, 5, 1), 3.0),
    ]


def test_off_grid_points_count_with_the_date_before(spark, rows):
    table = points(
        spark, (date(2020, 1, 1), 1.0), (date(2020, 2, 1), 99.0), (date(2020, 4, 1), 7.0),
        (date(2020, 9, 1), 3.0),
    )
    assert rows(date_grid(table, 2), "ds", "y") == [
        (date(2020, 1, 1), 50.0), (date(2020, 3, 1), 7.0), (date(2020, 5, 1), None),
        (date(2020, 7, 1), None), (date(2020, 9, 1), 3.0),
    ]
    assert [r[0] for r in rows(upsample(table, 2).orderBy("ds"), "y")] == sorted(
        [50.0, 7.0, 7 - 4 / 3, 7 - 8 / 3, 3.0], key=repr
    )
    assert rows(date_grid(table, 1), "y").count((None,)) == 5
    with pytest.raises(Exception, match="not on the grid: DE;FC 2020-02-01"):
        date_grid(table, 2, off_grid="error").collect()
    with pytest.raises(ValueError):
        date_grid(table, 2, off_grid="skip")


def test_grid_shuffles_once(spark, tmp_path):
    path = str(tmp_path / "points")
    points(spark, (date(2020, 1, 1), 1.0), (date(2020, 2, 1), 2.0)).write.parquet(path)
    plan = upsample(spark.read.parquet(path), 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1, plan


def test_fused_step_equals_its_parts(spark, rows):
    table = points(
        spark, (date(2019, 1, 1), 5.0), (date(2020, 1, 1), 1.0), (date(2023, 1, 1), -4.0)
    ).unionByName(points(spark, (date(2021, 1, 1), 7.0), key="FR;FC"))
    parts = forward_fill(interpolate(date_grid(table, 2)))
    digits = F.round("y", 9).alias("y")
    assert rows(parts, "unique_id", "ds", digits) == rows(
        upsample(table, 2), "unique_id", "ds", digits
    )


def test_ends_without_neighbours(spark):
    table = points(
        spark, (date(2020, 1, 1), None), (date(2020, 2, 1), 1.0), (date(2020, 3, 1), None),
        (date(2020, 4, 1), 3.0), (date(2020, 5, 1), None),
    )
    lined = interpolate(table)
    assert [r.y for r in lined.orderBy("ds").collect()] == [None, 1.0, 2.0, 3.0, None]
    assert [r.y for r in forward_fill(lined).orderBy("ds").collect()] == [None, 1.0, 2.0, 3.0, 3.0]


def test_repeated_dates_are_averaged(spark, rows):
    table = spark.createDataFrame(
        [("DE;CF", date(2020, 1, 1), 1.0), ("DE;CF", date(2020, 1, 1), 3.0)],
        "unique_id string, date date, energy_prod double",
    )
    assert rows(one_per_date(table, PRODUCTION)) == [("DE;CF", date(2020, 1, 1), 2.0)]


def test_grid_and_lines_share_one_shuffle(spark):
    table = points(spark, (date(2020, 1, 1), 0.0), (date(2021, 1, 1), 60.0)).repartition(3)
    plan = forward_fill(interpolate(date_grid(table, 2)))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1, text


def test_two_dates_of_one_month(spark, rows):
    table = spark.createDataFrame(
        [("a", "2020-01-01", 1.0), ("a", "2020-01-15", 3.0), ("a", "2020-03-20", 6.0)],
        "unique_id string, date string, energy_prod double",
    ).withColumn("date", F.col("date").cast("date"))
    points = resample.one_per_date(table, PRODUCTION)
    got = [(str(d), y) for d, y in rows(resample.upsample(points, 1), "ds", "y")]
    assert sorted(got) == [("2020-01-01", 2.0), ("2020-02-01", 4.0), ("2020-03-01", 6.0)]
    raw = table.select("unique_id", F.col("date").alias("ds"), F.col("energy_prod").alias("y"))
    assert min(str(d) for (d,) in rows(resample.date_grid(raw, 1), "ds")) == "2020-01-01"
    assert resample.upsample(raw, 1).count() >= 3
