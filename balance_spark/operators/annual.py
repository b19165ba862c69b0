"""Months to years, and the integers shown for a measure."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from balance_spark.functions.numbers import whole, year_start
from balance_spark.specs import Measure


def annual(table: DataFrame, measure: Measure, collapse: bool = False) -> DataFrame:
    """Yearly value per series: a sum, or the mean of the actual and forecast means.

    A year with actual and forecast rows comes out once per kind, both rows with the
    value of the whole year; ``collapse`` gives one row per series and year, predicted
    when any part of it is.  Both kinds are aggregated side by side, so the table is
    shuffled once, after partial aggregation.  Rows that do not say whether they are
    predicted (NULL) count as actual ones.
    """
    value = F.col(measure.value)
    predicted = F.coalesce(F.col("predicted"), F.lit(False))
    combine = F.sum if measure.annual == "sum" else F.avg
    keys = ["state", "unique_id", measure.category]
    both = (
        table.groupBy(*keys, year_start(F.col("date")).alias("date"))
        .agg(
            combine(F.when(~predicted, value)).alias("actual"),
            combine(F.when(predicted, value)).alias("forecast"),
            F.count_if(~predicted).alias("n_actual"),
            F.count_if(predicted).alias("n_forecast"),
        )
    )
    total = F.coalesce("actual", F.lit(0.0)) + F.coalesce("forecast", F.lit(0.0))
    if measure.annual == "mean":
        kinds = F.col("actual").isNotNull().cast("int") + F.col("forecast").isNotNull().cast("int")
        total = F.try_divide(total, kinds)
    if collapse:
        flag = F.col("n_forecast") > 0
    else:
        flag = F.explode(
            F.array_compact(
                F.array(
                    F.when(F.col("n_actual") > 0, False), F.when(F.col("n_forecast") > 0, True)
                )
            )
        )
    return both.select(*keys, "date", total.alias(measure.value), flag.alias("predicted"))


def cast_measure(table: DataFrame, measure: Measure) -> DataFrame:
    """The measure as a whole number, cut off towards zero."""
    return table.withColumn(measure.value, whole(F.col(measure.value)))
