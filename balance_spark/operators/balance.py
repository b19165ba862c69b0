"""Production against consumption, and the population both are measured by."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from balance_spark.specs import CONSUMPTION, PRODUCTION, Measure


def balance(
    produced: DataFrame,
    consumed: DataFrame,
    production: Measure = PRODUCTION,
    consumption: Measure = CONSUMPTION,
) -> DataFrame:
    """Join yearly production and consumption; ``deficit`` is the first minus the second.

    Categories other than the totals count as 0, and a row is predicted when either
    side is.
    """
    right = consumed.select(
        "state",
        "date",
        consumption.category,
        consumption.value,
        F.col("unique_id").alias("unique_id_right"),
        F.col("predicted").alias("predicted_right"),
    )
    supply = F.when(F.col(production.category) == production.total, F.col(production.value))
    demand = F.when(F.col(consumption.category) == consumption.total, F.col(consumption.value))
    either = F.coalesce(F.col("predicted") | F.col("predicted_right"), F.lit(False))
    return (
        produced.join(right, ["state", "date"])
        .withColumns(
            {
                "deficit": supply.otherwise(0.0) - demand.otherwise(0.0),
                "def_id": F.concat(production.category, F.lit(";"), consumption.category),
                "predicted": either,
            }
        )
        .drop("predicted_right")
    )


def population(observed: DataFrame, projected: DataFrame) -> DataFrame:
    """Observed and projected population; the mean where both are given."""
    return (
        observed.unionByName(projected)
        .groupBy("state", "date")
        .agg(F.avg("population").alias("population"))
    )
