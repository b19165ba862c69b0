"""What a map is coloured by."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from balance_spark.operators.members import without_aggregate
from balance_spark.specs import AGGREGATE, Measure


def map_values(
    table: DataFrame,
    measure: Measure,
    date,
    category: str,
    countries: DataFrame,
    aggregate: str = AGGREGATE,
) -> DataFrame:
    """One date and category, every state with its three-digit numeric code (``id``)."""
    numbers = countries.select("state", F.lpad(F.col("iso_numeric").cast("string"), 3, "0").alias("id"))
    return (
        without_aggregate(table, aggregate)
        .filter(F.col("date") == F.lit(date).cast("date"))
        .filter(F.col(measure.category) == category)
        .join(numbers, "state")
        .select("id", "state", measure.value)
    )


def map_table(shapes: DataFrame, values: DataFrame) -> DataFrame:
    """Every shape of the map (``id``) with the value of its state, if it has one."""
    return shapes.select("id").join(values, "id", "left")


def map_domain(values: DataFrame, measure: Measure) -> DataFrame:
    """One row: smallest and largest value of the map."""
    return values.agg(F.min(measure.value).alias("low"), F.max(measure.value).alias("high"))
