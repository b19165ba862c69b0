"""Additive smoothing of level, trend and season, as a fold over each series.

A state (level, trend, the seasons ahead as a ring, the squared errors so far) runs over the
values in order.  Every series runs once for each combination of rates; the combination with
the smallest squared one-step errors is kept.  All of it is Spark functions on one row per
series, so a series never leaves its task and nothing is shuffled after the series is put
together.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from balance_spark.specs import ForecastPlan

#: Rates of the level, the trend (of the level's) and the season (of what the level leaves).
LEVEL_RATES = (0.1, 0.3, 0.5, 0.7, 0.9)
TREND_RATES = (0.0, 0.05, 0.2)
SEASON_RATES = (0.0, 0.1, 0.3)


#: One value: what was expected misses it by ``e``, which moves level, trend and season.
_STEP = """
    transform(
        array(v - (s.level + s.trend + s.seasons[0])),
        e -> named_struct(
            'level', s.level + s.trend + rate.level * e,
            'trend', s.trend + rate.level * rate.trend * e,
            'seasons', concat(
                slice(s.seasons, 2, size(s.seasons) - 1),
                array(s.seasons[0] + rate.season * (1 - rate.level) * e)
            ),
            'squares', s.squares + e * e
        )
    )[0]"""


def _first_state(season: int) -> Column:
    """Level, trend and seasons from the first two seasons; without these, no season."""
    return F.expr(
        f"""
        if(size(y) >= {2 * season},
           transform(
               array(named_struct(
                   'one', aggregate(slice(y, 1, {season}), 0D, (total, v) -> total + v) / {season},
                   'two', aggregate(slice(y, {season + 1}, {season}), 0D, (total, v) -> total + v)
                          / {season})),
               m -> named_struct(
                   'level', m.one,
                   'trend', (m.two - m.one) / {season},
                   'seasons', transform(slice(y, 1, {season}), v -> v - m.one),
                   'squares', 0D))[0],
           named_struct(
               'level', y[0],
               'trend', if(size(y) > 2, get(y, 1) - y[0], 0D),
               'seasons', array(0D),
               'squares', 0D))"""
    )


def _rates() -> Column:
    combinations = ", ".join(
        f"named_struct('level', {a}D, 'trend', {b}D, 'season', {g}D)"
        for a, b, g in product(LEVEL_RATES, TREND_RATES, SEASON_RATES)
    )
    return F.expr(f"explode(array({combinations}))")


def smoothed(series: DataFrame, plan: ForecastPlan) -> DataFrame:
    """``series`` (``unique_id, last, y``) with the best ``rates``, the last ``state``, the
    ring's length ``period``, the number of one-step ``errors``, and ``length`` and ``power``
    (the sum of the squares) of the values.

    Without two full seasons there is no season, below three values no trend.
    """
    period = F.when(F.size("y") >= 2 * plan.season, plan.season).otherwise(1)
    run = series.withColumns({"period": period, "first": _first_state(plan.season)}).withColumn(
        "rate", _rates()
    )
    state = F.expr(f"aggregate(slice(y, period + 1, size(y)), first, (s, v) -> {_STEP})")
    errors = (F.size("y") - F.col("period")).alias("errors")
    power = F.expr("aggregate(y, 0D, (total, v) -> total + v * v)").alias("power")
    length = F.size("y").alias("length")
    kept = F.struct("last", F.col("rate").alias("rates"), "state", "period", errors, length, power)
    best = F.struct("state.squares", "rate")
    return (
        run.withColumn("state", state)
        .groupBy("unique_id")
        .agg(F.min_by(kept, best).alias("kept"))
        .select("unique_id", "kept.*")
    )


def steps_ahead(steps: DataFrame, width: float) -> DataFrame:
    """``value`` and ``half`` width of rows of ``smoothed`` for each step ``k``.

    A one-step error moves what is expected j steps later by a known share; the squared
    shares add up to the variance, so the interval widens with the step.
    """
    a, b, g = F.col("rates.level"), F.col("rates.trend"), F.col("g")
    state, period, j, turns = F.col("state"), F.col("period"), F.col("j"), F.col("turns")
    line = a * a * (j + b * j * (j + 1) + b * b * j * (j + 1) * (2 * j + 1) / 6)
    season = 2 * g * (a * turns + a * b * period * turns * (turns + 1) / 2) + g * g * turns
    error = F.coalesce(F.try_divide(state["squares"], F.col("errors")), F.lit(0.0))
    place = ((F.col("k") - 1) % period).cast("int")
    return steps.withColumns(
        {
            "g": F.when(period > 1, F.col("rates.season") * (1 - a)).otherwise(0.0),
            "j": (F.col("k") - 1).cast("double"),
            "turns": F.floor((F.col("k") - 1) / period).cast("double"),
        }
    ).withColumns(
        {
            "value": state["level"] + F.col("k") * state["trend"] + F.get(state["seasons"], place),
            "half": F.sqrt(error * (1 + line + season)) * width,
        }
    )
