"""Continuing every series of a tidy table.

Four methods with one contract, ``unique_id, last, date, value, low, high, method`` with
``horizon`` rows per series after its ``last`` observed date:

* ``trend``: a straight line;
* ``seasonal``: straight trend plus seasonal means;
* ``smoothed``: additive smoothing of level, trend and season;
* ``auto``: of these three, per series, the one with the smallest AICc.

All are Spark functions, all series are continued in one job, and intervals widen with the
step.  Repeated observations are averaged per period before any series is put together, so
no series is longer than the calendar.  ``arma``, a seasonal ARMA model in numpy, can be asked
for; no other method uses it.
"""

from __future__ import annotations

from dataclasses import replace
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from balance_spark.functions.numbers import not_below_zero
from balance_spark.operators import seasonal_arma
from balance_spark.operators.members import only_states
from balance_spark.operators.resample import one_per_date, upsample
from balance_spark.operators.smoothing import smoothed, steps_ahead
from balance_spark.specs import ForecastPlan, Measure


# The fit travels to the executors inside the task, which need not have this package.
cloudpickle.register_pickle_by_value(seasonal_arma)


def _normal_width(level: float) -> float:
    """Half width of a central interval, in standard errors."""
    return round(NormalDist().inv_cdf((1 + level) / 2), 6)


def seasonal_profile(grid: DataFrame, plan: ForecastPlan) -> DataFrame:
    """Per series: the slope, a level per season position, and the leftover squares.

    This is the least-squares fit of a straight trend plus one level per position.  Its
    slope depends on the moments inside the positions only, so one aggregation per
    position and one per series are all it takes.  Without two full seasons all rows
    count as one position.
    """
    series = Window.partitionBy("unique_id").orderBy("ds")
    whole = Window.partitionBy("unique_id")
    placed = grid.withColumns(
        {"t": F.row_number().over(series) - 1, "length": F.count("*").over(whole)}
    ).withColumn(
        "phase",
        F.when(F.col("length") >= 2 * plan.season, F.col("t") % plan.season).otherwise(0),
    )
    y, t = F.col("y"), F.col("t").cast("double")
    positions = placed.groupBy("unique_id", "phase").agg(
        F.count("*").alias("n"),
        F.avg(y).alias("y"),
        F.avg(t).alias("t"),
        F.var_pop(y).alias("yy"),
        F.var_pop(t).alias("tt"),
        F.covar_pop(t, y).alias("ty"),
        F.max("ds").alias("last"),
        F.max("t").alias("last_t"),
    )
    n, slope = F.col("n"), F.coalesce(F.try_divide("ty", "tt"), F.lit(0.0))
    squares = F.col("yy") - 2 * slope * F.col("ty") + slope * slope * F.col("tt")
    free = F.col("length") - F.col("phases") - 1
    return (
        positions.groupBy("unique_id")
        .agg(
            F.max("last").alias("last"),
            F.max("last_t").alias("last_t"),
            F.sum("n").alias("length"),
            F.count("*").alias("phases"),
            F.sum(n * F.col("yy")).alias("yy"),
            F.sum(n * F.col("tt")).alias("tt"),
            F.sum(n * F.col("ty")).alias("ty"),
            F.sum(n * (F.col("yy") + y * y)).alias("power"),
            F.map_from_entries(
                F.collect_list(F.struct("phase", F.struct("y", "t", "n").alias("mean")))
            ).alias("means"),
        )
        .select(
            "unique_id",
            "last",
            "last_t",
            "means",
            "length",
            "phases",
            "power",
            "tt",
            slope.alias("slope"),
            F.greatest(squares, F.lit(0.0)).alias("squares"),
        )
        .withColumn("sd", F.when(free > 0, F.sqrt(F.col("squares") / free)).otherwise(0.0))
    )


def _ahead(fits: DataFrame, plan: ForecastPlan) -> DataFrame:
    """Every fit once for each step ``k`` ahead."""
    return fits.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(plan.horizon))))


def _line_ahead(profile: DataFrame, plan: ForecastPlan) -> DataFrame:
    """The steps of rows of ``seasonal_profile`` with ``value`` and ``half`` width.

    The variance of a prediction is that of the leftovers, of the position's level and of the
    slope, which counts the more the farther a step is from the position's mean date.
    """
    t = F.col("last_t") + F.col("k")
    mean = F.coalesce(
        F.try_element_at("means", t % plan.season), F.try_element_at("means", F.lit(0))
    )
    away = F.col("away")
    spread = 1 + 1 / F.col("mean.n") + F.coalesce(F.try_divide(away * away, "tt"), F.lit(0.0))
    return (
        _ahead(profile, plan)
        .withColumn("mean", mean)
        .withColumn("away", t - F.col("mean.t"))
        .withColumns(
            {
                "value": F.col("mean.y") + F.col("slope") * away,
                "half": F.col("sd") * F.sqrt(spread) * _normal_width(plan.level),
            }
        )
    )


def _score(parameters) -> Column:
    """AICc of a fit with ``squares`` over ``errors`` of ``length`` values; NULL without
    enough of them.  Fits closer than rounding count as equally close."""
    n, p = F.col("length"), parameters
    nearest = 1e-9 * F.col("power") / n + 1e-12
    error = F.greatest(F.coalesce(F.try_divide("squares", "errors"), F.lit(0.0)), nearest)
    return F.when(n > p + 1, n * F.log(error) + 2 * p + 2 * p * (p + 1) / (n - p - 1))


_STEPS = ("unique_id", "last", "method", "k", "value", "half", "score")


def _line_steps(points: DataFrame, plan: ForecastPlan, method: str) -> DataFrame:
    """``_STEPS`` of a fitted line, with or without seasons."""
    season = plan.season if method == "seasonal" else 1
    plan = replace(plan, season=season)
    fit = seasonal_profile(upsample(points, plan.step_months), plan)
    score = _score(F.col("phases") + 2)
    if method == "seasonal":
        score = F.when(F.col("phases") > 1, score)  # otherwise it is the trend
    fit = fit.withColumn("errors", F.col("length")).withColumn("score", score)
    return _line_ahead(fit, plan).withColumn("method", F.lit(method)).select(*_STEPS)


def _smooth_steps(points: DataFrame, plan: ForecastPlan) -> DataFrame:
    """``_STEPS`` by smoothing."""
    parameters = F.when(F.col("period") > 1, plan.season + 6).otherwise(5)
    fit = smoothed(series_rows(points, plan), plan).withColumn("squares", F.col("state.squares"))
    fit = fit.withColumns({"score": _score(parameters), "method": F.lit("smoothed")})
    return steps_ahead(_ahead(fit, plan), _normal_width(plan.level)).select(*_STEPS)


def _dated(steps: DataFrame, plan: ForecastPlan) -> DataFrame:
    return steps.select(
        "unique_id",
        "last",
        F.add_months("last", F.col("k") * plan.step_months).alias("date"),
        "value",
        (F.col("value") - F.col("half")).alias("low"),
        (F.col("value") + F.col("half")).alias("high"),
        "method",
    )


def forecast_trend(points: DataFrame, plan: ForecastPlan) -> DataFrame:
    """A straight line."""
    return _dated(_line_steps(points, plan, "trend"), plan)


def forecast_seasonal(points: DataFrame, plan: ForecastPlan) -> DataFrame:
    """Trend plus seasonal level; without two full seasons the trend."""
    return _dated(_line_steps(points, plan, "seasonal"), plan)


def forecast_smoothed(points: DataFrame, plan: ForecastPlan) -> DataFrame:
    """Additive smoothing of level, trend and season."""
    return _dated(_smooth_steps(points, plan), plan)


def forecast_auto(points: DataFrame, plan: ForecastPlan) -> DataFrame:
    """Per series the method with the smallest AICc, named in ``method``.

    Equal ones go to the simpler method; a series too short for any score gets its trend.
    The points are shuffled once, by series, for all three.
    """
    partitions = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    points = points.repartition(partitions, "unique_id")
    without = F.coalesce("score", F.lit(float("inf")))
    steps = (
        _line_steps(points, plan, "trend").withColumns({"score": without, "rank": F.lit(0)})
        .unionByName(_line_steps(points, plan, "seasonal").withColumn("rank", F.lit(1)))
        .unionByName(_smooth_steps(points, plan).withColumn("rank", F.lit(2)))
        .filter("score IS NOT NULL")
    )
    own = F.struct("score", "rank")
    best = steps.withColumn("best", F.min(own).over(Window.partitionBy("unique_id")))
    return _dated(best.filter(F.col("best.rank") == F.col("rank")), plan)


def series_rows(points: DataFrame, plan: ForecastPlan) -> DataFrame:
    """One row per series: ``unique_id, last`` and the values on the regular grid.

    The list holds one value per period between the first and the last date, so the
    calendar bounds its length, not the number of observations.  The series are spread
    over all shuffle partitions whatever their bytes: a fit costs time, not space, so
    merging small partitions would only make it wait.
    """
    partitions = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = F.array_sort(F.collect_list(F.struct("ds", "y")))
    return (
        upsample(points.repartition(partitions, "unique_id"), plan.step_months)
        .groupBy("unique_id")
        .agg(F.max("ds").alias("last"), ordered.alias("points"))
        .select("unique_id", "last", F.col("points.y").alias("y"))
    )


def forecast_arma(points: DataFrame, plan: ForecastPlan) -> DataFrame:
    """Seasonal ARMA model per series in numpy, short series by smoothing."""
    season, horizon = plan.season, plan.horizon
    width = _normal_width(plan.level)
    continue_batch = seasonal_arma.continue_batch

    def continue_series(batches):
        for batch in filter(len, batches):
            value, error = continue_batch(batch["y"].to_list(), season, horizon)
            yield pd.DataFrame(
                {
                    "unique_id": np.repeat(batch["unique_id"].to_numpy(), horizon),
                    "last": np.repeat(batch["last"].to_numpy(), horizon),
                    "k": np.tile(np.arange(1, horizon + 1), len(batch)),
                    "value": value.ravel(),
                    "low": (value - width * error).ravel(),
                    "high": (value + width * error).ravel(),
                }
            )

    return (
        series_rows(points, plan)
        .mapInPandas(
            continue_series,
            "unique_id string, last date, k int, value double, low double, high double",
        )
        .select(
            "unique_id",
            "last",
            F.add_months("last", F.col("k") * plan.step_months).alias("date"),
            "value",
            "low",
            "high",
            F.lit("arma").alias("method"),
        )
    )


METHODS = {
    "auto": forecast_auto,
    "trend": forecast_trend,
    "seasonal": forecast_seasonal,
    "smoothed": forecast_smoothed,
    "arma": forecast_arma,
}


def clip_nonnegative(table: DataFrame, *columns: str) -> DataFrame:
    """Negative values of the columns become 0; NULL stays NULL."""
    return table.withColumns({name: not_below_zero(F.col(name)) for name in columns})


def forecast_rows(
    table: DataFrame, measure: Measure, plan: ForecastPlan, from_next_year: bool = False
) -> DataFrame:
    """Forecast rows in the layout of the tidy table, none below zero.

    A forecast starts one step after the last observation.  For yearly data that is
    inside the last observed year; ``from_next_year`` leaves those rows out.
    """
    points = one_per_date(table, measure)
    ahead = METHODS[plan.method](points, plan)
    if from_next_year:
        ahead = ahead.filter(F.year("date") > F.year("last"))
    parts = F.split("unique_id", ";")
    return clip_nonnegative(
        ahead.select(
            parts[1].alias(measure.category),
            parts[0].alias("state"),
            "date",
            F.col("value").alias(measure.value),
            "unique_id",
            F.lit(True).alias("predicted"),
            "low",
            "high",
        ),
        measure.value,
        "low",
        "high",
    )


def with_forecast(
    table: DataFrame, measure: Measure, plan: ForecastPlan, from_next_year: bool = False
) -> DataFrame:
    """Actual rows, without bounds, followed by the forecast rows of every series."""
    actual = table.select(
        measure.category,
        "state",
        "date",
        measure.value,
        "unique_id",
        F.lit(False).alias("predicted"),
        F.lit(None).cast("double").alias("low"),
        F.lit(None).cast("double").alias("high"),
    )
    return actual.unionByName(forecast_rows(table, measure, plan, from_next_year))


def forecast_category(
    table: DataFrame, measure: Measure, plan: ForecastPlan, category: str, states=None
) -> DataFrame:
    """Every series of one category, or those of some states."""
    chosen = only_states(table.filter(F.col(measure.category) == category), states)
    return with_forecast(chosen, measure, plan)


def forecast_state(
    table: DataFrame, measure: Measure, plan: ForecastPlan, states
) -> DataFrame:
    """Every category of the chosen states."""
    return with_forecast(only_states(table, states), measure, plan)
