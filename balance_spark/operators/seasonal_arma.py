"""Choosing a seasonal ARMA model on differences per series, and rolling it forward.

Models are fitted by two-step least squares: a long autoregression gives the innovations,
whose lags are then regressors like those of the values.

Spark brings every series to one short row (``forecast.py``); these helpers fit and
continue all series of an Arrow batch at once, so that there is no Python loop over
series or values.
"""

from __future__ import annotations

import itertools

import numpy as np

#: Ordinary and seasonal differences that compete.
DIFFERENCES = ((0, 0), (1, 0), (0, 1), (1, 1))
#: The lag vector: 1, w[t], then the possible regressors: values w and innovations e at
#: these lags, s being the season.
VALUE_LAGS = ("1", "2", "s", "s+1")
INNOVATION_LAGS = ("1", "s", "s+1")
#: Regressors of the competing models, as positions in the lag vector.
MODELS = (
    (), (2,), (2, 3), (4,), (2, 4), (2, 3, 4), (2, 4, 5),
    (6,), (7,), (6, 7), (6, 7, 8), (2, 6), (2, 6, 7),
)
#: Observations left for the fit; shorter series are smoothed instead.
MIN_SAMPLE = 16
#: Values worked on together, to bound the memory of the lag matrices.
CHUNK_VALUES = 1 << 18


def deepest_lag(season: int) -> int:
    return 2 * season + 2


def lags_of(season: int, names: tuple[str, ...]) -> list[int]:
    return [{"1": 1, "2": 2, "s": season, "s+1": season + 1}[name] for name in names]


def difference(series: np.ndarray, lag: int) -> np.ndarray:
    """``x[t] - x[t-lag]``, the first ``lag`` columns unknown."""
    out = np.full_like(series, np.nan)
    out[:, lag:] = series[:, lag:] - series[:, :-lag]
    return out


def sample_of(counts: np.ndarray, width: int, season: int) -> np.ndarray:
    """Which columns of right-aligned series have the deepest lag of any model behind them."""
    return np.arange(width) >= (width - counts + deepest_lag(season))[:, None]


def lagged(series: np.ndarray, lags, usable: np.ndarray) -> list[np.ndarray]:
    columns = []
    for lag in lags:
        shifted = np.zeros_like(series)
        shifted[:, lag:] = series[:, : series.shape[1] - lag]
        columns.append(np.where(usable, shifted, 0.0))
    return columns


def least_squares(products: np.ndarray, regressors) -> np.ndarray:
    """Coefficients of position 1 on the regressors, from the cross-products."""
    if not regressors:
        return np.zeros((len(products), 0))
    left = products[:, regressors][:, :, regressors] + 1e-9 * np.eye(len(regressors))
    return np.linalg.solve(left, products[:, regressors, 1][..., None])[..., 0]


def lag_products(series, counts, season, d, seasonal_d) -> np.ndarray:
    """Cross-products of the lag vector per series under some differences.

    Innovations are the residuals of the regression on all value lags, zero before the
    sample begins.
    """
    for lag in [1] * d + [season] * seasonal_d:
        series = difference(series, lag)
    usable = sample_of(counts, series.shape[1], season)
    columns = [usable.astype(float), *lagged(series, [0], usable)]
    columns += lagged(series, lags_of(season, VALUE_LAGS), usable)
    stacked = np.stack(columns, axis=1)
    long = [0, *range(2, len(columns))]
    beta = least_squares(stacked @ stacked.transpose(0, 2, 1), long)
    innovations = stacked[:, 1] - (beta[..., None] * stacked[:, long]).sum(axis=1)
    columns += lagged(innovations, lags_of(season, INNOVATION_LAGS), usable)
    stacked = np.stack(columns, axis=1)
    return stacked @ stacked.transpose(0, 2, 1)


def settles(weights: np.ndarray) -> np.ndarray:
    """Whether a recursion with these weights of the last values dies out.

    Weights that add up to clearly less than one always do; only the others need their
    eigenvalues.
    """
    done = np.abs(weights).sum(axis=1) < 0.98
    doubtful = np.flatnonzero(~done)
    if not len(doubtful):
        return done
    order = np.flatnonzero(weights[doubtful].any(axis=0)).max() + 1
    companion = np.zeros((len(doubtful), order, order))
    companion[:, 0, :] = weights[doubtful, :order]
    companion[:, np.arange(1, order), np.arange(order - 1)] = 1.0
    done[doubtful] = np.abs(np.linalg.eigvals(companion)).max(axis=1) < 0.999
    return done


def recursion_of(model, coefficients, season, d, seasonal_d):
    """A fit as z[t] = constant + values @ z[t-1…] + shocks @ e[t-1…] + e[t].

    Also tells for which series it is stationary and invertible.
    """
    batch = len(coefficients)
    positions = dict(enumerate(lags_of(season, VALUE_LAGS), start=2))
    shock_positions = dict(enumerate(lags_of(season, INNOVATION_LAGS), start=6))
    phi, shocks = np.zeros((batch, season + 1)), np.zeros((batch, season + 1))
    for column, position in enumerate(model):
        target = phi if position in positions else shocks
        lag = positions.get(position) or shock_positions[position]
        target[:, lag - 1] = coefficients[:, column]
    good = settles(phi) & settles(-shocks)
    poly = np.zeros((batch, deepest_lag(season) + 1))
    poly[:, 0] = 1.0
    poly[:, 1 : season + 2] = -phi
    for lag in [1] * d + [season] * seasonal_d:
        shifted = np.zeros_like(poly)
        shifted[:, lag:] = poly[:, :-lag]
        poly = poly - shifted
    return -poly[:, 1:], shocks, good


def choose(series: np.ndarray, counts: np.ndarray, season: int):
    """Best model per series by AICc: value weights, shock weights, constant, variance.

    All models predict the same values from the same sample, so their AICc can be
    compared across differences.
    """
    batch = len(series)
    sample = (counts - deepest_lag(season)).astype(float)
    best = np.full(batch, np.inf)
    values = np.zeros((batch, deepest_lag(season)))
    shocks = np.zeros((batch, season + 1))
    constant, variance = np.zeros(batch), np.zeros(batch)
    for d, seasonal_d in DIFFERENCES:
        products = lag_products(series, counts, season, d, seasonal_d)
        for model in MODELS:
            # A constant under two differences would be a quadratic trend.
            first = 1 if d + seasonal_d < 2 else 0
            regressors = [0] * first + list(model)
            k = len(regressors)
            solution = least_squares(products, regressors)
            rest = products[:, 1, 1] - (solution * products[:, regressors, 1]).sum(axis=1)
            sigma2 = np.maximum(rest, 1e-12 * sample) / sample
            aicc = sample * np.log(sigma2) + 2 * (k + 1) * sample / (sample - k - 2)
            better = np.flatnonzero(aicc < best)
            value, shock, good = recursion_of(
                model, solution[better, first:], season, d, seasonal_d
            )
            take = better[good]
            best[take] = aicc[take]
            values[take], shocks[take] = value[good], shock[good]
            constant[take] = solution[take, 0] if first else 0.0
            variance[take] = sigma2[take] * sample[take] / np.maximum(sample[take] - k, 1)
    return values, shocks, constant, variance


def roll_forward(series, counts, fit, horizon):
    """The next ``horizon`` values and their standard errors.

    The innovations of the chosen model are rebuilt over the sample first, since the last
    ones carry into the forecast; later ones are expected to be zero.
    """
    values, shocks, constant, variance = fit
    batch, width = series.shape
    deep, memory = values.shape[1], shocks.shape[1]
    usable = sample_of(counts, width, memory - 1)
    path = np.concatenate([np.nan_to_num(series), np.zeros((batch, horizon))], axis=1)
    error = np.zeros((batch, width + horizon))
    psi = np.zeros((batch, deep + horizon))
    psi[:, deep] = 1.0
    newest_first, shock_newest_first = values[:, ::-1], shocks[:, ::-1]
    for now in range(deep, width + horizon):
        expected = (
            constant
            + (newest_first * path[:, now - deep : now]).sum(axis=1)
            + (shock_newest_first * error[:, now - memory : now]).sum(axis=1)
        )
        if now < width:
            error[:, now] = np.where(usable[:, now], path[:, now] - expected, 0.0)
        else:
            path[:, now] = expected
    for step in range(1, horizon):
        now = deep + step
        psi[:, now] = (newest_first * psi[:, now - deep : now]).sum(axis=1)
        if step <= memory:
            psi[:, now] += shocks[:, step - 1]
    spread = np.cumsum(psi[:, deep:] ** 2, axis=1)
    return path[:, width:], np.sqrt(variance[:, None] * spread)


def smooth(history: np.ndarray, season: int, horizon: int):
    """Additive Holt-Winters for short series of equal length, best of a few rates.

    Without two full seasons there is no seasonal part, below three values no trend.
    """
    batch, length = history.shape
    period = season if length >= 2 * season else 1
    seasonal_rates = (0.1, 0.5) if period > 1 else (0.0,)
    trend_rates = (0.05, 0.3) if length >= 3 else (0.0,)
    best = np.full(batch, np.inf)
    value, error = np.zeros((batch, horizon)), np.zeros((batch, horizon))
    steps = np.arange(1, horizon + 1)
    for alpha, beta, gamma in itertools.product((0.2, 0.5, 0.8), trend_rates, seasonal_rates):
        if period > 1:
            level = history[:, :period].mean(axis=1)
            trend = (history[:, period : 2 * period].mean(axis=1) - level) / period
            cycle = history[:, :period] - level[:, None]
            start = period
        else:
            level = history[:, 0]
            trend = history[:, 1] - level if length >= 3 else np.zeros(batch)
            cycle = np.zeros((batch, 1))
            start = 1
        squares = np.zeros(batch)
        cycle = cycle.copy()
        for t in range(start, length):
            season_now = cycle[:, t % period].copy()
            miss = history[:, t] - level - trend - season_now
            level = level + trend + alpha * miss
            trend = trend + alpha * beta * miss
            cycle[:, t % period] = season_now + gamma * (1 - alpha) * miss
            squares += miss**2
        sigma2 = squares / max(length - start, 1)
        ahead = level[:, None] + trend[:, None] * steps + cycle[:, (length - 1 + steps) % period]
        growth = alpha * (1 + beta * steps) + gamma * (1 - alpha) * (
            (steps % period == 0) if period > 1 else 0
        )
        spread = 1 + np.concatenate([[0.0], np.cumsum(growth**2)[:-1]])
        take = squares < best
        best[take] = squares[take]
        value[take] = ahead[take]
        error[take] = np.sqrt(sigma2[:, None] * spread)[take]
    return value, error


def continue_batch(series: list[np.ndarray], season: int, horizon: int):
    """Values and standard errors of the next ``horizon`` steps, (batch, horizon) each.

    Series of similar length are padded to one width and worked on together.
    """
    value = np.zeros((len(series), horizon))
    error = np.zeros((len(series), horizon))
    order = np.argsort([len(one) for one in series], kind="stable")
    start = 0
    while start < len(order):
        end = start + 1
        while end < len(order) and (end + 1 - start) * len(series[order[end]]) <= CHUNK_VALUES:
            end += 1
        chunk = order[start:end]
        value[chunk], error[chunk] = _continue_chunk([series[i] for i in chunk], season, horizon)
        start = end
    return value, error


def _continue_chunk(series, season, horizon):
    counts = np.array([len(one) for one in series])
    width = counts.max()
    aligned = np.full((len(series), width), np.nan)
    for row, one in enumerate(series):
        aligned[row, width - len(one) :] = one
    mean = np.nanmean(aligned, axis=1, keepdims=True)
    scale = np.nanstd(aligned, axis=1, keepdims=True)
    scale[scale <= 1e-12 * np.abs(mean)] = 1.0
    scaled = (aligned - mean) / scale

    value = np.zeros((len(series), horizon))
    error = np.zeros((len(series), horizon))
    long = counts >= deepest_lag(season) + MIN_SAMPLE
    if long.any():
        fit = choose(scaled[long], counts[long], season)
        value[long], error[long] = roll_forward(scaled[long], counts[long], fit, horizon)
    for length in np.unique(counts[~long]):
        same = counts == length
        value[same], error[same] = smooth(scaled[same][:, width - length :], season, horizon)
    return mean + scale * value, scale * error
