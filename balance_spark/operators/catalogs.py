"""What there is to choose from: states, categories, years."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from balance_spark.operators.members import without_aggregate
from balance_spark.specs import AGGREGATE, Measure

# Fixed value: how the aggregate is called in headings.
AGGREGATE_TITLE = "Unione Europea"


def state_catalog(table: DataFrame, countries: DataFrame, aggregate: str = AGGREGATE) -> DataFrame:
    """``state, name, title`` of the states present, the aggregate included, by name.

    The aggregate has no country name: it is listed under its code and titled
    separately.  A state that the dimension does not know is listed under its code.
    """
    is_aggregate = F.col("state") == aggregate
    return (
        table.select("state")
        .distinct()
        .join(countries.select("state", "name"), "state", "left")
        .withColumn("name", F.when(is_aggregate, aggregate).otherwise(F.coalesce("name", "state")))
        .withColumn("title", F.when(is_aggregate, AGGREGATE_TITLE).otherwise(F.col("name")))
        .orderBy("name")
    )


def state_catalog_members(
    table: DataFrame, countries: DataFrame, aggregate: str = AGGREGATE
) -> DataFrame:
    """The same list without the aggregate: ``state, name``."""
    listed = state_catalog(without_aggregate(table, aggregate), countries, aggregate)
    return listed.select("state", "name")


def state_code_of(names: DataFrame, countries: DataFrame) -> DataFrame:
    """``name, state`` for a table of names as ``state_catalog`` lists them.

    The aggregate, and a state that the dimension does not know, is its own code.
    """
    known = countries.select("name", "state")
    return names.join(known, "name", "left").withColumn("state", F.coalesce("state", "name"))


def category_catalog(table: DataFrame, measure: Measure) -> DataFrame:
    """The sorted distinct category codes."""
    return table.select(measure.category).distinct().orderBy(measure.category)


def category_labels(table: DataFrame, measure: Measure, labels: DataFrame) -> DataFrame:
    """The category codes present, with the label a ``code, label`` dimension gives them.

    A code without a label is its own label.
    """
    return (
        table.select(F.col(measure.category).alias("code"))
        .distinct()
        .join(labels, "code", "left")
        .withColumn("label", F.coalesce("label", "code"))
        .orderBy("code")
    )


def year_domain(table: DataFrame) -> DataFrame:
    """Years to choose from: the first one up to, not including, the last one."""
    return (
        table.agg(F.min(F.year("date")).alias("first"), F.max(F.year("date")).alias("last"))
        .withColumn("year", F.explode(F.sequence("first", "last")))
        .filter(F.col("year") < F.col("last"))
        .select("year")
    )


def has_forecast(table: DataFrame, date) -> DataFrame:
    """One row: does this date hold forecast rows?"""
    return (
        table.filter((F.col("date") == F.lit(date).cast("date")) & F.col("predicted"))
        .agg((F.count("*") > 0).alias("has_forecast"))
    )
