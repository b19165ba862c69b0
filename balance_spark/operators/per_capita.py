"""Consumption per head against the aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from balance_spark.functions.numbers import whole
from balance_spark.operators.members import only_states, without_aggregate
from balance_spark.specs import AGGREGATE, Measure


def per_capita(annual_table: DataFrame, people: DataFrame, measure: Measure) -> DataFrame:
    """``energy_cons_per_capita``-style column: the whole-number measure per inhabitant."""
    value = whole(F.col(measure.value))
    ratio = F.round(F.try_divide(value, F.col("population")), 5)
    return (
        annual_table.withColumn(measure.value, value)
        .join(people, ["state", "date"])
        .withColumn(f"{measure.value}_per_capita", ratio)
    )


def per_capita_vs_average(
    annual_table: DataFrame,
    people: DataFrame,
    measure: Measure,
    labels: DataFrame,
    states=None,
    date=None,
    aggregate: str = AGGREGATE,
) -> DataFrame:
    """Per state, date and category: the value per head next to the aggregate's.

    The aggregate's side has one row per (date, category); Spark broadcasts it when it
    measures it to be small, and the other side keeps its distribution.
    """
    ratio = f"{measure.value}_per_capita"
    if date is not None:
        annual_table = annual_table.filter(F.col("date") == F.lit(date).cast("date"))
    heads = per_capita(annual_table, people, measure)
    average = (
        heads.filter(F.col("state") == aggregate)
        .groupBy("date", measure.category)
        .agg(F.avg(ratio).alias("average"))
    )
    chosen = only_states(without_aggregate(heads, aggregate), states)
    return (
        chosen.filter(F.col(measure.category) != measure.total)
        .groupBy("unique_id", "state", "date", measure.category)
        .agg(F.avg(ratio).alias(ratio))
        .join(average, ["date", measure.category])
        .join(labels, F.col(measure.category) == F.col("code"), "left")
        .withColumn("label", F.coalesce("label", measure.category))
        .drop("code")
    )


def above_average(compared: DataFrame, measure: Measure) -> DataFrame:
    """Rows whose value per head exceeds the aggregate's."""
    return compared.filter(F.col(f"{measure.value}_per_capita") > F.col("average"))
