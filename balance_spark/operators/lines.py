"""What line, band and area charts are drawn from."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from balance_spark.functions.numbers import whole
from balance_spark.operators.members import only_states, without_aggregate
from balance_spark.specs import AGGREGATE, Measure


def lines(
    table: DataFrame,
    measure: Measure,
    states=None,
    category: str | None = None,
    aggregate: str = AGGREGATE,
) -> DataFrame:
    """Rows of the chosen states, one category or all of them, without the aggregate."""
    if category is not None:
        table = table.filter(F.col(measure.category) == category)
    return only_states(without_aggregate(table, aggregate), states)


def sector_lines(table: DataFrame, measure: Measure, state: str) -> DataFrame:
    """All categories but the total of one state, the measure as a whole number."""
    return (
        table.filter(F.col("state") == state)
        .filter(F.col(measure.category) != measure.total)
        .withColumn(measure.value, whole(F.col(measure.value)))
    )


def pivot_lines(
    table: DataFrame, measure: Measure, column: str, values: Sequence[str]
) -> DataFrame:
    """One row per date, one column per state or category.  ``values`` names them, so
    that no job has to look for them first."""
    return table.groupBy("date").pivot(column, list(values)).agg(F.sum(measure.value))


def map_lines(table: DataFrame, measure: Measure, column: str) -> DataFrame:
    """One row per date with a map from every state or category there is to its sum.

    The same as ``pivot_lines`` where the columns are not known beforehand: whatever the
    table holds is there, and no job looks for names.  Rows without a name have no line.
    """
    sums = (
        table.filter(F.col(column).isNotNull())
        .groupBy("date", column)
        .agg(F.sum(measure.value).alias("sum"))
    )
    entries = F.array_sort(F.collect_list(F.struct(column, "sum")))
    return sums.groupBy("date").agg(F.map_from_entries(entries).alias("values"))


def last_point(table: DataFrame, key: str) -> DataFrame:
    """The forecast row with the latest date, per state or category."""
    row = F.struct(*table.columns)
    # Rows of one date are told apart by the whole row, so that the choice is stable.
    return (
        table.filter("predicted")
        .groupBy(key)
        .agg(F.max_by(row, F.struct("date", row)).alias("point"))
        .select("point.*")
    )


def forecast_span(table: DataFrame, start=None) -> DataFrame:
    """One row: where the forecast panel starts and ends.

    It runs to the last date of all rows from a given ``start``, else over the predicted
    rows; without any both ends are NULL.
    """
    if start:
        return table.agg(F.lit(start).cast("date").alias("start"), F.max("date").alias("end"))
    date = F.when(F.col("predicted"), F.col("date"))
    return table.agg(F.min(date).alias("start"), F.max(date).alias("end"))


def member_average(
    table: DataFrame, measure: Measure, category: str, members, aggregate: str = AGGREGATE
) -> DataFrame:
    """The aggregate's line of one category divided by the number of members (``y2``)."""
    return (
        table.filter((F.col("state") == aggregate) & (F.col(measure.category) == category))
        .withColumn("y2", F.col(measure.value) / members)
    )


def padded_domain(table: DataFrame, column: str, margin: float = 0.3) -> DataFrame:
    """One row: the range of a column, widened by a share of its ends."""
    low, high = F.min(column), F.max(column)
    return table.agg(
        (low - margin * low).alias("low"),
        (high + margin * high).alias("high"),
    )


def interval_band(table: DataFrame, measure: Measure, state: str) -> DataFrame:
    """Forecast interval per date and category of one state, the total left out."""
    return (
        sector_lines(table, measure, state)
        .filter("predicted")
        .select("date", measure.category, "low", "high")
    )


def stacked_area(
    table: DataFrame,
    measure: Measure,
    parts: Sequence[str],
    states=None,
    after=None,
    inclusive: bool = False,
) -> DataFrame:
    """Whole-number parts per (state, date) and the height each one is stacked up to.

    Exact duplicates count once.  ``after`` leaves out the date itself unless
    ``inclusive``.
    """
    if after is not None:
        limit = F.lit(after).cast("date")
        table = table.filter(F.col("date") >= limit if inclusive else F.col("date") > limit)
    upwards = (
        Window.partitionBy("state", "date")
        .orderBy(measure.category, "predicted", measure.value)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    columns = table.columns
    others = [name for name in columns if name not in ("state", "date")]
    # A set per (state, date) drops the copies before the shuffle and leaves the rows where
    # the running total needs them: one shuffle does for both.
    return (
        only_states(table, states)
        .filter(F.col(measure.category).isin(*parts))
        .withColumn(measure.value, whole(F.col(measure.value)))
        .groupBy("state", "date")
        .agg(F.collect_set(F.struct(*others)).alias("rows"))
        .select("state", "date", F.inline("rows"))
        .select(*columns)
        .withColumn("stacked_to", F.sum(measure.value).over(upwards))
    )
