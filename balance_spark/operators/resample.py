"""Regular date grids, interpolation and filling, per series.

A series is the rows of one ``unique_id``, at most one row per period (see
``one_per_date``), so a series can never hold more rows than the calendar has periods:
that bounds every window below.  All steps partition by ``unique_id`` and share one
shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from balance_spark.functions.numbers import month_number
from balance_spark.specs import Measure


def one_per_date(table: DataFrame, measure: Measure) -> DataFrame:
    """``unique_id, ds, y``: the mean per series and month, whatever the input repeats.

    Dates inside a month count as its first day; a month is the finest period there is.
    """
    return (
        table.groupBy("unique_id", F.trunc("date", "month").alias("ds"))
        .agg(F.avg(measure.value).alias("y"))
    )


def _series():
    return Window.partitionBy("unique_id").orderBy("ds")


def _on_grid(points: DataFrame, step_months: int, off_grid: str) -> DataFrame:
    """Points on the grid that begins with the first point, with their ``offset`` in months.

    Points between two grid dates count, by ``off_grid``, with the date before them, the
    values of a date averaged ("mean"); not at all ("drop"); or are an error ("error").
    """
    month = month_number(F.col("ds"))
    placed = points.withColumn("offset", month - F.first(month).over(_series()))
    if step_months == 1:
        return placed
    beyond = F.col("offset") % step_months
    if off_grid == "drop":
        return placed.filter(beyond == 0)
    if off_grid == "error":
        missed = F.concat(F.lit("not on the grid: "), "unique_id", F.lit(" "), F.col("ds").cast("string"))
        return placed.withColumn("offset", F.when(beyond == 0, F.col("offset")).otherwise(F.raise_error(missed)))
    if off_grid != "mean":
        raise ValueError(f"off_grid must be 'mean', 'drop' or 'error', not {off_grid!r}")
    # The window above has brought each series together, so this shuffles nothing.
    return placed.groupBy(
        "unique_id",
        F.add_months("ds", -beyond).alias("ds"),
        (F.col("offset") - beyond).alias("offset"),
    ).agg(F.avg("y").alias("y"))


def _segments(points: DataFrame, step_months: int, off_grid: str) -> DataFrame:
    """Points on the grid with the number of steps to the next one (``steps``)."""
    gap = (F.lead("offset").over(_series()) - F.col("offset")) / step_months
    return _on_grid(points, step_months, off_grid).withColumn("steps", gap.cast("int"))


def _unroll(segments: DataFrame, step_months: int) -> DataFrame:
    """Every grid date of every segment; ``k`` counts from the segment's own point."""
    # Points of one month have no step between them; a sequence must not count down.
    inside = F.sequence(F.lit(0), F.greatest(F.coalesce(F.col("steps") - 1, F.lit(0)), F.lit(0)))
    return segments.withColumn("k", F.explode(inside)).withColumn(
        "ds", F.add_months("ds", F.col("k") * step_months)
    )


def date_grid(points: DataFrame, step_months: int, off_grid: str = "mean") -> DataFrame:
    """All dates from the first to the last point of a series; new dates have no value.

    ``off_grid`` says what becomes of points between the grid dates (see ``_on_grid``).
    """
    return _unroll(_segments(points, step_months, off_grid), step_months).select(
        "unique_id", "ds", F.when(F.col("k") == 0, F.col("y")).alias("y")
    )


def interpolate(grid: DataFrame) -> DataFrame:
    """Straight lines, by row position, between the nearest known neighbours."""
    known = F.when(F.col("y").isNotNull(), F.struct("i", "y"))
    rows_before = _series().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # Reading the series backwards turns "the next known value" into a running value.
    backwards = Window.partitionBy("unique_id").orderBy(F.desc("ds"))
    rows_after = backwards.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    left, right = F.col("left"), F.col("right")
    line = left.y + (right.y - left.y) * (F.col("i") - left.i) / (right.i - left.i)
    return (
        grid.withColumn("i", F.row_number().over(_series()))
        .withColumn("left", F.last(known, ignorenulls=True).over(rows_before))
        .withColumn("right", F.last(known, ignorenulls=True).over(rows_after))
        .select("unique_id", "ds", F.when(F.col("y").isNotNull(), F.col("y")).otherwise(line).alias("y"))
    )


def forward_fill(grid: DataFrame) -> DataFrame:
    """The last known value where there is none."""
    rows_before = _series().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return grid.withColumn("y", F.last("y", ignorenulls=True).over(rows_before))


def upsample(points: DataFrame, step_months: int, off_grid: str = "mean") -> DataFrame:
    """``date_grid`` and ``interpolate`` in one step for points that all have a value.

    Each point knows its successor, so the line is drawn while the grid is unrolled.
    """
    segments = _segments(points.filter(F.col("y").isNotNull()), step_months, off_grid)
    drawn = segments.withColumn("rise", F.lead("y").over(_series()) - F.col("y"))
    share = F.try_divide(F.col("k"), F.col("steps"))
    value = F.when(F.col("k") == 0, F.col("y")).otherwise(F.col("y") + F.col("rise") * share)
    return _unroll(drawn, step_months).select("unique_id", "ds", value.alias("y"))
