"""Which states take part."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from balance_spark.sources.dims import fixed_rows
from balance_spark.specs import AGGREGATE


def member_filter(table: DataFrame, countries: DataFrame, aggregate: str = AGGREGATE) -> DataFrame:
    """Rows of the member states and of the aggregate, in one pass over ``table``."""
    spark = table.sparkSession
    wanted = (
        countries.filter("member")
        .select("state")
        .unionByName(fixed_rows(spark, [(aggregate,)], "state"))
    )
    return table.join(wanted, "state", "left_semi")


def member_count(countries: DataFrame):
    """Number of member states as a scalar subquery column."""
    return countries.agg(F.count_if("member").alias("members")).scalar()


def only_states(table: DataFrame, states) -> DataFrame:
    """Rows of the chosen states: a list of codes, or a table with a ``state`` column."""
    if states is None:
        return table
    if isinstance(states, DataFrame):
        return table.join(states.select("state").distinct(), "state", "left_semi")
    if isinstance(states, str):
        states = [states]
    return table.filter(F.col("state").isin(*states))


def without_aggregate(table: DataFrame, aggregate: str = AGGREGATE) -> DataFrame:
    return table.filter(F.col("state") != aggregate)
