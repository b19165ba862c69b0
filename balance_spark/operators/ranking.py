"""Who is first: top states, yearly top five, yearly ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from balance_spark.functions.numbers import per_member
from balance_spark.operators.members import without_aggregate
from balance_spark.sources.dims import DEFAULT_STATES
from balance_spark.specs import AGGREGATE, BALANCE, Measure

# Classes of the yearly ranking and the short name of the aggregate.
SURPLUS, DEFICIT, AGGREGATE_CLASS = "Maggiore", "Minore", "EU"


def top_states(
    table: DataFrame, measure: Measure, category: str, k: int = 4, aggregate: str = AGGREGATE
) -> DataFrame:
    """``state, total_energy`` of the k states with the largest sum, ties by state code."""
    return (
        without_aggregate(table, aggregate)
        .filter(F.col(measure.category) == category)
        .groupBy("state")
        .agg(F.sum(measure.value).alias("total_energy"))
        .orderBy(F.desc_nulls_last("total_energy"), "state")
        .limit(k)
    )


def default_states(countries: DataFrame, names=DEFAULT_STATES) -> DataFrame:
    """The states shown when no category decides which ones are on top."""
    return countries.filter(F.col("name").isin(*names)).select("state", "name")


def top_rank_by_year(
    table: DataFrame,
    measure: Measure = BALANCE,
    k: int = 5,
    aggregate: str = AGGREGATE,
) -> DataFrame:
    """The k largest states of every date with their rank; equal values share a rank.

    Spark keeps only the first k rows per date and task before the shuffle, so a date
    may hold any number of states.
    """
    value = F.col(measure.value)
    largest = Window.partitionBy("date").orderBy(F.desc_nulls_last(measure.value), "state")
    ranked = Window.partitionBy("date").orderBy(F.desc_nulls_last(measure.value))
    return (
        without_aggregate(table, aggregate)
        .groupBy("state", "date")
        .agg(F.avg(value).alias(measure.value))
        .withColumn("row", F.row_number().over(largest))
        .filter(F.col("row") <= k)
        .withColumn("rank", F.rank().over(ranked))
        .drop("row")
    )


def balance_ranking(
    table: DataFrame,
    date,
    members,
    measure: Measure = BALANCE,
    aggregate: str = AGGREGATE,
) -> DataFrame:
    """One date's mean per state with its sign class; the aggregate per member, floored.

    ``members`` is the number of member states, a number or a scalar column.
    """
    value, is_aggregate = F.col(measure.value), F.col("state") == aggregate
    return (
        table.filter(
            (F.col("date") == F.lit(date).cast("date"))
            & (F.col(measure.category) == measure.total)
        )
        .groupBy("state")
        .agg(F.avg(measure.value).alias(measure.value))
        .select(
            F.when(is_aggregate, AGGREGATE_CLASS).otherwise(F.col("state")).alias("state"),
            F.when(is_aggregate, per_member(value, members)).otherwise(value).alias(measure.value),
            F.when(is_aggregate, AGGREGATE_CLASS)
            .when(value > 0, SURPLUS)
            .otherwise(DEFICIT)
            .alias(f"{measure.value}_status"),
        )
        .orderBy(F.desc_nulls_last(measure.value), "state")
    )
