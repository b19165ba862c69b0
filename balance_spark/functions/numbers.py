"""Column expressions on dates and numbers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def whole(value: Column) -> Column:
    """Cut the fraction off (towards zero): the integer shown for a measure."""
    return value.cast("bigint")


def per_member(value: Column, members: Column | int) -> Column:
    """Floor division of an aggregate by its number of members."""
    return F.floor(value / members).cast("double")


def not_below_zero(value: Column) -> Column:
    """Negative values become 0; NULL stays NULL."""
    return F.when(value < 0, F.lit(0.0)).otherwise(value)


def percent_of_group(value: Column, *keys: str, digits: int) -> Column:
    """Share of ``value`` in the sum over the rows with the same ``keys``."""
    total = F.sum(value).over(Window.partitionBy(*keys))
    return F.round(F.try_divide(value, total) * 100, digits)


def year_start(date: Column) -> Column:
    return F.trunc(date, "year")


def month_number(date: Column) -> Column:
    """Months since year 0, so that month arithmetic is integer arithmetic."""
    return F.year(date) * 12 + F.month(date)
