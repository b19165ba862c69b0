"""Shares of a total, and whether the parts of a total are all there."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from balance_spark.functions.numbers import percent_of_group, whole, year_start
from balance_spark.specs import Measure


def shares(
    table: DataFrame,
    measure: Measure,
    labels: DataFrame,
    digits: int,
    parts: Sequence[str] | None = None,
) -> DataFrame:
    """Share of each category in its (state, date), with its label.

    ``parts`` names the categories that count; by default all but the total.
    Rows repeated for one category are averaged, not added.
    """
    category = F.col(measure.category)
    counted = table.filter(category.isin(*parts) if parts else category != measure.total)
    return (
        counted.groupBy("state", "date", measure.category)
        .agg(F.avg(measure.value).alias(measure.value))
        .withColumn(
            "percentage",
            percent_of_group(F.col(measure.value), "state", "date", digits=digits),
        )
        .join(labels, category == F.col("code"), "left")
        .withColumn("label", F.coalesce("label", measure.category))
        .drop("code")
    )


def sector_share(table: DataFrame, measure: Measure, labels: DataFrame) -> DataFrame:
    """Shares to two digits of every sector but the total."""
    return shares(table, measure, labels, digits=2)


def product_mix(
    table: DataFrame, measure: Measure, labels: DataFrame, parts: Sequence[str]
) -> DataFrame:
    """Shares to three digits of the given products, from a yearly table."""
    return shares(table, measure, labels, digits=3, parts=parts)


def share_table(shared: DataFrame, measure: Measure, states: Sequence[str]) -> DataFrame:
    """Shares side by side: per (date, category) a label, share and value per state."""
    keys = ["date", measure.category]
    columns = ["label", "percentage", measure.value]
    wide = (
        shared.groupBy(*keys)
        .pivot("state", list(states))
        .agg(*[F.first(name).alias(name) for name in columns])
    )
    return wide.select(
        *keys,
        *[
            F.col(f"`{state}_{name}`").alias(f"{name}_{state}")
            for name in columns
            for state in states
        ],
    )


def share_map(shared: DataFrame, measure: Measure) -> DataFrame:
    """Per (date, category) a map from every state to its label, share and value.

    The same as ``share_table`` where the states are not known beforehand.
    """
    row = F.struct("label", "percentage", measure.value)
    entries = F.array_sort(F.collect_list(F.struct("state", row.alias("row"))))
    return (
        shared.filter(F.col("state").isNotNull())
        .groupBy("date", measure.category, "state")
        .agg(F.min(row).alias("row"))
        .select("date", measure.category, "state", "row.*")
        .groupBy("date", measure.category)
        .agg(F.map_from_entries(entries).alias("states"))
    )


def completeness(
    table: DataFrame,
    measure: Measure,
    parts: Sequence[str],
    by: Sequence[str] = ("state", "date"),
    tolerance: float = 0.05,
    since=None,
) -> DataFrame:
    """Groups whose parts explain less than the total allows, with the missing percentage.

    ``by=("state",)`` compares all years at once; parts and totals are then taken from
    the same years.  One conditional aggregation, no self-join.
    """
    if since is not None:
        table = table.filter(F.col("date") >= F.lit(since).cast("date"))
    category, value = F.col(measure.category), F.col(measure.value)
    return (
        table.groupBy(*by)
        .agg(
            F.sum(F.when(category == measure.total, value)).alias("total"),
            F.coalesce(F.sum(F.when(category.isin(*parts), value)), F.lit(0.0)).alias("parts"),
        )
        .filter(F.col("parts") < F.col("total") * (1 - tolerance))
        .withColumn(
            "missing_percentage",
            (F.col("total") - F.col("parts")) / F.col("total") * 100,
        )
    )


def distinct_total(table: DataFrame, measure: Measure) -> DataFrame:
    """Per state, the sum of the distinct whole-number totals."""
    return (
        table.filter(F.col(measure.category) == measure.total)
        .groupBy("state")
        .agg(F.sum_distinct(whole(F.col(measure.value))).alias("total"))
    )


def single_total(table: DataFrame, measure: Measure) -> DataFrame:
    """Per (state, year), the one total there should be, and whether it is the only one."""
    value = whole(F.col(measure.value))
    return (
        table.filter(F.col(measure.category) == measure.total)
        .groupBy("state", year_start(F.col("date")).alias("date"))
        .agg(F.min(value).alias("total"), (F.min(value) == F.max(value)).alias("unique"))
    )
