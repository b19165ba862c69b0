"""Smoothing against the recursion written out, widening intervals, the choice of a method."""

from datetime import date
from itertools import product

import numpy as np
import pytest

from balance_spark.operators import smoothing
from balance_spark.operators.forecast import METHODS, forecast_auto, forecast_seasonal, forecast_smoothed
from balance_spark.specs import ForecastPlan

PLAN = ForecastPlan(season=4, step_months=1, horizon=13)
WIDTH = 1.959964


def points(spark, series):
    rows = [
        (name, date(2010 + k // 12, k % 12 + 1, 1), float(v))
        for name, values in series.items()
        for k, v in enumerate(values)
    ]
    return spark.createDataFrame(rows, "unique_id string, ds date, y double")


def plain(y, season, horizon):
    """Value and half width per step, by running every combination of rates."""
    n, m = len(y), season if len(y) >= 2 * season else 1
    best = None
    for a, b, g in product(smoothing.LEVEL_RATES, smoothing.TREND_RATES, smoothing.SEASON_RATES):
        if m > 1:
            level, trend = np.mean(y[:m]), (np.mean(y[m : 2 * m]) - np.mean(y[:m])) / m
            seasons = [v - level for v in y[:m]]
        else:
            level, trend, seasons = y[0], y[1] - y[0] if n > 2 else 0.0, [0.0]
        squares = 0.0
        for t in range(m, n):
            error = y[t] - (level + trend + seasons[t - m])
            level, trend = level + trend + a * error, trend + a * b * error
            seasons.append(seasons[t - m] + g * (1 - a) * error)
            squares += error * error
        if best is None or squares < best[0] - 1e-9:
            best = squares, a, b, g, level, trend, seasons[-m:]
    squares, a, b, g, level, trend, ring = best
    error, share = (squares / (n - m) if n > m else 0.0), 0.0
    out = []
    for k in range(1, horizon + 1):
        out.append((level + k * trend + ring[(k - 1) % m], WIDTH * np.sqrt(error * (1 + share))))
        share += (a + a * b * k + (g * (1 - a) if m > 1 and k % m == 0 else 0.0)) ** 2
    return np.array(out)


def test_smoothing_equals_the_recursion(spark):
    rng = np.random.default_rng(6)
    season = np.tile([3.0, -1.0, 0.5, -2.5], 12)
    series = {
        "season": 20 + 0.3 * np.arange(40) + season[:40] + rng.normal(size=40),
        "walk": 50 + np.cumsum(rng.normal(size=31)),
        "short": [4.0, 6.0, 5.0, 9.0, 8.0],
        "three": [1.0, 2.0, 4.0], "two": [5.0, 9.0], "one": [7.0], "flat": [3.0] * 20,
    }
    got = forecast_smoothed(points(spark, series), PLAN).orderBy("unique_id", "date").toPandas()
    for name, values in series.items():
        want = plain(list(values), 4, PLAN.horizon)
        mine = got[got.unique_id == name]
        assert np.allclose(mine.value, want[:, 0]), name
        assert np.allclose((mine.high - mine.low) / 2, want[:, 1]), name


def test_intervals_widen(spark):
    rng = np.random.default_rng(7)
    series = {"a": 10 + 0.2 * np.arange(60) + np.tile([2.0, 0.0, -2.0, 1.0], 15) + rng.normal(size=60)}
    for method in ("trend", "seasonal", "smoothed"):
        got = METHODS[method](points(spark, series), PLAN).orderBy("date").toPandas()
        width = (got.high - got.low).to_numpy()
        assert (np.diff(width) > 0).all() if method == "trend" else width[-1] > width[0]
        assert (width[4:] >= width[:-4]).all() and set(got.method) == {method}


def test_seasonal_interval_is_that_of_the_regression(spark):
    """Prediction variance of the least-squares fit with one level per position and a slope."""
    rng = np.random.default_rng(8)
    y = 5 + 0.1 * np.arange(30) + np.tile([1.0, 2.0, 3.0, 4.0], 8)[:30] + rng.normal(size=30)
    t = np.arange(30)
    design = np.column_stack([t % 4 == k for k in range(4)] + [t]).astype(float)
    fit, squares, *_ = np.linalg.lstsq(design, y, rcond=None)
    later = np.arange(30, 30 + PLAN.horizon)
    ahead = np.column_stack([later % 4 == k for k in range(4)] + [later]).astype(float)
    inverse = np.linalg.inv(design.T @ design)
    spread = np.sqrt(squares[0] / (30 - 5) * (1 + np.einsum("ij,jk,ik->i", ahead, inverse, ahead)))
    got = forecast_seasonal(points(spark, {"a": y}), PLAN).orderBy("date").toPandas()
    assert np.allclose(got.value, ahead @ fit)
    assert np.allclose((got.high - got.low) / 2, WIDTH * spread)


def test_method_is_chosen_per_series(spark):
    rng = np.random.default_rng(9)
    n, season = 60, np.tile([8.0, -3.0, 1.0, -6.0], 15)
    series = {
        "trend": 10 + 0.5 * np.arange(n) + rng.normal(size=n),
        "seasonal": 10 + 0.5 * np.arange(n) + season + rng.normal(size=n),
        "smoothed": 100 + season + 60 * np.sin(np.arange(n) / 12) + rng.normal(size=n),
        "one": [3.0], "two": [3.0, 4.0], "flat": [2.0] * 30,
    }
    table = forecast_auto(points(spark, series), PLAN)
    chosen = {r["unique_id"]: r["method"] for r in table.select("unique_id", "method").distinct().collect()}
    assert chosen == {n: n for n in ("trend", "seasonal", "smoothed")} | {
        "one": "trend", "two": "trend", "flat": "trend"
    }
    for name, method in chosen.items():
        alone = METHODS[method](points(spark, {name: series[name]}), PLAN)
        assert sorted(alone.collect()) == sorted(table.filter(table.unique_id == name).collect())


def test_points_are_shuffled_once_for_all_methods(spark, tmp_path):
    path = str(tmp_path / "points")
    points(spark, {"a": range(40), "b": range(30)}).write.parquet(path)
    table = forecast_auto(spark.read.parquet(path), PLAN)
    table.collect()
    plan = table._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("REPARTITION_BY_NUM") == 1 + plan.count("ReusedExchange"), plan
    assert "Python" not in plan and "ArrowEval" not in plan


@pytest.mark.parametrize("method", ["trend", "seasonal", "smoothed", "auto"])
def test_no_points(spark, method):
    empty = points(spark, {"a": [1.0]}).filter("false")
    assert METHODS[method](empty, PLAN).count() == 0
