import os
import subprocess
import sys
from dataclasses import replace
from datetime import date
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from balance_spark.operators import seasonal_arma as ar
from balance_spark.operators.forecast import (
    clip_nonnegative,
    forecast_auto,
    forecast_category,
    forecast_seasonal,
    forecast_state,
    with_forecast,
)
from balance_spark.specs import (
    CONSUMPTION,
    CONSUMPTION_FORECAST,
    PRODUCTION,
    PRODUCTION_FORECAST,
    ForecastPlan,
)


def months(start_year, count):
    return [date(start_year + i // 12, i % 12 + 1, 1) for i in range(count)]


def production(spark, series, start=2015):
    data = [
        (key.split(";")[1], key.split(";")[0], day, float(value), key)
        for key, values in series.items()
        for day, value in zip(months(start, len(values)), values)
        if value is not None
    ]
    return spark.createDataFrame(
        data, "siec string, state string, date date, energy_prod double, unique_id string"
    )


def points(table):
    return table.select("unique_id", F.col("date").alias("ds"), F.col("energy_prod").alias("y"))


def wave(count, slope=0.0, noise=0.0, seed=1):
    t = np.arange(count)
    rng = np.random.default_rng(seed)
    return 100 + slope * t + 20 * np.sin(2 * np.pi * t / 12) + noise * rng.normal(size=count)


@pytest.mark.parametrize("method", ["auto", "seasonal"])
def test_contract(spark, method):
    table = production(
        spark,
        {
            "DE;TOTAL": wave(96, 0.5, 3.0),
            "FR;TOTAL": wave(60, -1.0, 8.0, 2),
            "IT;CF": [7.0] * 36,
            "ES;CF": [3.0, 4.0, 2.0],
            "PT;CF": [5.0],
            "NL;CF": [5.0, 9.0],
            "BE;CF": wave(30, -9.0, 1.0, 3),
        },
    )
    plan = replace(PRODUCTION_FORECAST, method=method)
    out = with_forecast(table, PRODUCTION, plan)
    ahead = out.filter("predicted").toPandas()
    assert out.filter("NOT predicted").count() == table.count()
    assert out.filter("NOT predicted AND (low IS NOT NULL OR high IS NOT NULL)").count() == 0
    assert set(ahead.groupby("unique_id").size()) == {48} and ahead.unique_id.nunique() == 7
    assert not ahead.isna().any().any()
    slack = 1e-6 * (1 + ahead.high.abs())
    assert (ahead.low <= ahead.energy_prod + slack).all()
    assert (ahead.energy_prod <= ahead.high + slack).all()
    assert (ahead[["low", "energy_prod", "high"]] >= 0).all().all()
    last = table.groupBy("unique_id").agg(F.max("date").alias("last")).toPandas()
    joined = ahead.merge(last, on="unique_id")
    assert (joined.date > joined["last"]).all()
    assert (ahead.groupby("unique_id").date.nunique() == 48).all()
    constant = ahead[ahead.unique_id == "IT;CF"]
    assert np.allclose(constant.energy_prod, 7.0) and np.allclose(constant.low, 7.0)


@pytest.mark.parametrize("method", [forecast_auto, forecast_seasonal])
def test_known_series_is_reproduced(spark, method):
    full = wave(144, 0.5)
    table = production(spark, {"DE;TOTAL": full[:96]})
    got = method(points(table), PRODUCTION_FORECAST).orderBy("date").toPandas()
    assert np.abs(got.value - full[96:]).max() < 0.5


def test_seasonal_is_exact_for_trend_plus_season(spark):
    season = np.tile([5, -1, 0, 2, -6, 3, 1, -2, 4, -4, -3, 1.0], 12)
    full = 50 + 2.0 * np.arange(144) + season
    table = production(spark, {"DE;TOTAL": full[:90]})
    got = forecast_seasonal(points(table), PRODUCTION_FORECAST).orderBy("date").toPandas()
    assert np.allclose(got.value, full[90:138], atol=1e-6)
    assert np.allclose(got.high - got.low, 0, atol=1e-4)


def test_missing_months_keep_the_season(spark):
    full = wave(144)
    seen = [None if i % 17 == 5 else v for i, v in enumerate(full[:96])]
    table = production(spark, {"DE;TOTAL": seen})
    got = forecast_auto(points(table), PRODUCTION_FORECAST).orderBy("date").toPandas()
    assert list(got.date) == months(2015, 144)[96:]
    assert np.corrcoef(got.value, full[96:])[0, 1] > 0.95


def test_repeated_rows_do_not_lengthen_a_series(spark):
    table = production(spark, {"DE;TOTAL": wave(60, 0.2, 2.0)})
    once = with_forecast(table, PRODUCTION, PRODUCTION_FORECAST)
    thrice = with_forecast(table.union(table).union(table), PRODUCTION, PRODUCTION_FORECAST)
    columns = ["date", "energy_prod", "low", "high"]
    a, b = (
        t.filter("predicted").select(columns).orderBy("date").toPandas() for t in (once, thrice)
    )
    assert np.allclose(a[columns[1:]], b[columns[1:]])


def brute_force(y, season, horizon):
    """The same choice written out for one series, model by model and step by step."""
    mean, scale = y.mean(), y.std()
    z = (y - mean) / scale
    n, deep = len(z), 2 * season + 2
    value_lags, shock_lags = [1, 2, season, season + 1], [1, season, season + 1]
    best = None
    for d, seasonal_d in ar.DIFFERENCES:
        w = z.copy()
        for lag in [1] * d + [season] * seasonal_d:
            w = np.concatenate([np.full(lag, np.nan), w[lag:] - w[:-lag]])
        target = w[deep:]
        past = [w[deep - lag : n - lag] for lag in value_lags]
        design = np.stack([np.ones(n - deep), *past], axis=1)
        e = np.zeros(n)
        e[deep:] = target - design @ np.linalg.lstsq(design, target, rcond=None)[0]
        available = past + [e[deep - lag : n - lag] for lag in shock_lags]
        for model in ar.MODELS:
            intercept = d + seasonal_d < 2
            x = [np.ones(n - deep)] * intercept + [available[p - 2] for p in model]
            if x:
                design = np.stack(x, axis=1)
                beta = np.linalg.lstsq(design, target, rcond=None)[0]
                rest = target - design @ beta
            else:
                beta, rest = np.zeros(0), target
            slopes = dict(zip(model, beta[int(intercept) :]))
            phi = {value_lags[p - 2]: b for p, b in slopes.items() if p < 6}
            theta = {shock_lags[p - 6]: b for p, b in slopes.items() if p >= 6}

            def dies_out(terms, sign):
                poly = np.zeros(max(terms, default=0) + 1)
                poly[0] = 1
                for lag, b in terms.items():
                    poly[lag] = sign * b
                return np.abs(np.roots(poly)).max(initial=0) < 0.999

            if not (dies_out(phi, -1) and dies_out(theta, 1)):
                continue
            size, k = len(target), len(x)
            aicc = size * np.log((rest**2).mean()) + 2 * (k + 1) * size / (size - k - 2)
            if best is None or aicc < best[0]:
                constant = beta[0] if intercept else 0.0
                best = (aicc, d, seasonal_d, phi, theta, constant, (rest**2).sum() / (size - k))
    _, d, seasonal_d, phi, theta, constant, sigma2 = best

    def run(start, first, constant, last_shock):
        """Rebuild the innovations from ``first`` on, then go on without any."""
        path, e = list(start), [0.0] * len(start)
        if last_shock is not None:
            e[-1] = last_shock

        def older(s):
            """What the differences take off z[s]."""
            out = 0.0
            if d:
                out += path[s - 1]
            if seasonal_d:
                out += path[s - season]
            if d and seasonal_d:
                out -= path[s - season - 1]
            return out

        def expected(t):
            value = constant + older(t)
            value += sum(b * (path[t - lag] - older(t - lag)) for lag, b in phi.items())
            return value + sum(b * e[t - lag] for lag, b in theta.items())

        for t in range(first, len(start)):
            e[t] = path[t] - expected(t)
        for _ in range(horizon):
            path.append(expected(len(path)))
            e.append(0.0)
        return np.array(path[len(start) :])

    value = run(z, deep, constant, None)
    # The response to one unit shock: a history of zeros that ends in it.
    psi = np.concatenate([[1.0], run([0.0] * (deep + 4) + [1.0], deep + 5, 0.0, 1.0)])[:horizon]
    return mean + scale * value, scale * np.sqrt(sigma2 * np.cumsum(psi**2))


@pytest.mark.parametrize("season,horizon", [(12, 48), (6, 24)])
def test_batch_equals_brute_force(season, horizon):
    rng = np.random.default_rng(7)
    series = []
    for i in range(40):
        count = int(rng.integers(ar.deepest_lag(season) + ar.MIN_SAMPLE, 160))
        t = np.arange(count)
        shocks = rng.normal(size=count)
        drift = np.cumsum(shocks) if i % 3 == 0 else np.convolve(shocks, [1, 0.6, 0.3])[:count]
        series.append(1000 + i * t + (i % 4) * 30 * np.sin(2 * np.pi * t / season) + 10 * drift)
    value, error = ar.continue_batch(series, season, horizon)
    for row, one in enumerate(series):
        expected, spread = brute_force(one, season, horizon)
        assert np.allclose(value[row], expected, rtol=1e-4, atol=1e-3), row
        assert np.allclose(error[row], spread, rtol=1e-4, atol=1e-3), row


def test_batch_does_not_depend_on_its_neighbours(monkeypatch):
    rng = np.random.default_rng(3)
    series = [50 + rng.normal(size=size).cumsum() for size in (3, 20, 45, 80, 45, 200)]
    together = ar.continue_batch(series, 12, 48)[0]
    alone = np.concatenate([ar.continue_batch([one], 12, 48)[0] for one in series])
    assert np.allclose(together, alone)
    monkeypatch.setattr(ar, "CHUNK_VALUES", 100)
    assert np.allclose(ar.continue_batch(series, 12, 48)[0], alone)


def test_yearly_series(spark):
    data = [
        ("FC", "DE", date(2000 + i, 1, 1), 100.0 + 3 * i + (i % 3), "DE;FC") for i in range(20)
    ]
    table = spark.createDataFrame(
        data, "nrg_bal string, state string, date date, energy_cons double, unique_id string"
    )
    out = with_forecast(table, CONSUMPTION, CONSUMPTION_FORECAST)
    ahead = out.filter("predicted").orderBy("date").toPandas()
    assert len(ahead) == 24
    assert ahead.date.iloc[0] == date(2019, 3, 1) and ahead.date.iloc[-1] == date(2023, 1, 1)
    later = with_forecast(table, CONSUMPTION, CONSUMPTION_FORECAST, from_next_year=True)
    assert later.filter("predicted").agg(F.min("date")).first()[0] == date(2020, 1, 1)


def test_choice_of_series(spark):
    table = production(spark, {"DE;TOTAL": wave(40), "DE;CF": wave(40), "FR;TOTAL": wave(40)})
    plan = ForecastPlan(season=12, step_months=1, horizon=3)

    def forecasted(out):
        return sorted(r[0] for r in out.filter("predicted").select("unique_id").distinct().collect())

    assert forecasted(forecast_category(table, PRODUCTION, plan, "TOTAL")) == ["DE;TOTAL", "FR;TOTAL"]
    assert forecasted(forecast_category(table, PRODUCTION, plan, "TOTAL", "FR")) == ["FR;TOTAL"]
    assert forecasted(forecast_state(table, PRODUCTION, plan, "DE")) == ["DE;CF", "DE;TOTAL"]


def test_clip(spark, rows):
    table = spark.createDataFrame([(-1.0, -2.0), (1.0, None)], "value double, low double")
    assert rows(clip_nonnegative(table, "value", "low")) == [(0.0, 0.0), (1.0, None)]


def test_workers_do_not_need_the_package(spark, tmp_path):
    """Run from another folder, with the package on the driver's path only."""
    repo = Path(__file__).resolve().parents[1]
    script = tmp_path / "job.py"
    script.write_text(
        f"""
import sys
sys.path.insert(0, {str(repo)!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", "2").getOrCreate())
import __spark_entry__ as driver
print("rows", driver.queries()["forecast_upsampled"](spark, "/root/testdata/sf0.001").count())
"""
    )
    environment = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run(
        [sys.executable, str(script)], cwd=tmp_path, env=environment,
        capture_output=True, text=True, timeout=300,
    )
    assert "rows" in done.stdout, done.stderr[-3000:]
