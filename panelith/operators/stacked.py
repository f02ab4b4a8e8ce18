"""Sample paths of many series at once: those of one length are rows of one array, so that NumPy's calls are shared by hundreds of short series. The steps, draws and guards are those of kernel.sample_paths()."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np

from panelith.constants import EXPONENT_LIMIT, LEAST_PERIODS, LEAST_POSITIVE, MOST_PERIODS, NOISE_PERIODS, PENALTIES, SHAPE_PERIODS, TINY, TINY_BOXCOX, TINY_LOG, TINY_SHAPE, TINY_WEIGHT
from panelith.functions.calendar import period_of, periods_of
from panelith.operators.kernel import _COARSE, Series, _enough, cross_lags, drawn_places, mp_median

#: Numbers that the largest array of a stack may hold.
ROOM = 1 << 20
#: Values beyond this are left to a call of their own, where squares may overflow.
LARGE = 1e100


def stacks(series: Sequence[Series], horizon: int, freq: str, n_samples: int, seeds: Sequence[int], noise: str = "bootstrap", period: int | None = None) -> Iterator[tuple[list[int], np.ndarray]]:
    """(places in series, paths (series, n_samples, horizon)) of the series that can be stacked. What isn't among them (very short, without recent values, with exogenous columns, or odd in its values) takes sample_paths()."""
    alike: dict[tuple[int, int], list[int]] = {}
    for i, s in enumerate(series):
        if noise == "bootstrap" and not s.x.shape[1] and len(s.recent) and s.n >= LEAST_PERIODS:
            alike.setdefault((s.n, len(s.y)), []).append(i)
    for (n, rows), places in alike.items():
        most = max(1, ROOM // (max(len(_COARSE), len(PENALTIES)) * rows + n_samples * max(horizon, *periods_of(freq), period_of(freq), period or 1)))
        for lo in range(0, len(places), most):
            at = np.array(places[lo : lo + most])
            y = np.stack([series[i].y for i in at])
            plain = (y.min(1) >= 0.5) & (y.max(1) < LARGE)  # false for NaN
            at, y = at[plain], y[plain]
            if not len(at):
                continue
            try:
                for p, secondary, values, columns, own in _chosen(y, n, freq, period):
                    paths = _paths(y[own], [series[i] for i in at[own]], n, p, secondary, values, columns, horizon, freq, n_samples, [seeds[i] for i in at[own]])
                    if paths is not None:
                        yield at[own].tolist(), paths
            except (ValueError, ArithmeticError, np.linalg.LinAlgError):
                continue  # a call for each finds whose fault it is


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.einsum("...i,...i->...", a, b)


def _chosen(y: np.ndarray, n: int, freq: str, period: int | None) -> Iterator[tuple[int, tuple[int, ...], np.ndarray | None, int, np.ndarray]]:
    """choose_period() of rows: (period, secondary, spectra, columns, rows that chose it)."""
    primary, calendar = period_of(freq), periods_of(freq)
    fits = lambda p: p >= 2 and n // p >= LEAST_PERIODS
    every, width = np.arange(len(y)), y.shape[1]
    spectra = lambda x, p, nc: np.linalg.svd(x[:, x.shape[1] - nc * p :].reshape(len(x), nc, p), compute_uv=False)
    if period is not None:
        above, nc = tuple(p for p in calendar if p > period), min(n // period, MOST_PERIODS)
        yield (period, above, spectra(y, period, nc), nc, every) if fits(period) else (1, above if period == 1 else (), None, 0, every)
        return
    tried = [p for p in calendar if fits(p)] or [p for p in (primary,) if fits(p)]
    if not tried:
        yield 1, (), None, 0, every
        return
    y = y[:, width - min(n, MOST_PERIODS * min(tried)) :]
    best, score, found = np.ones(len(y), int), y.shape[1] * np.log(np.maximum(y.var(1), TINY_LOG)) + math.log(y.shape[1]), {}
    for p in tried:
        nc = y.shape[1] // p
        if nc < LEAST_PERIODS:
            continue
        values, t = spectra(y, p, nc), p * nc
        own = t * np.log(np.maximum(_dot(values[:, 1:], values[:, 1:]) / t, TINY_LOG)) + (p + nc - 1) * math.log(t)
        best, score = np.where(own < score, p, best), np.minimum(own, score)
        found[p] = values, nc
    for p in np.unique(best).tolist():
        own = np.flatnonzero(best == p)
        values, nc = found.get(p, (None, 0))
        yield p, tuple(c for c in calendar if c > p), None if values is None else values[own], nc, own


def _shrinkage(values: np.ndarray, p: int, nc: int) -> np.ndarray:
    out = np.ones(len(values))
    if values.shape[1] < 2 or min(p, nc) < 2:
        return out
    top, middle, beta = values[:, 0], np.median(values, axis=1), min(p, nc) / max(p, nc)
    noise = middle**2 / mp_median(round(beta, 4))
    a = top**2 - (1 + beta) * noise
    rest = a * a - 4 * beta * noise**2
    own = (top >= TINY) & (middle >= TINY) & (top > (1 + math.sqrt(beta)) * np.sqrt(noise)) & (rest > 0)
    out[own] = np.clip(np.sqrt((a[own] + np.sqrt(rest[own])) / 2) / top[own], TINY, 1.0)
    return out


def _factors(level: np.ndarray, cp: int) -> np.ndarray:
    n = level.shape[1]
    raw = np.zeros((len(level), cp))
    for lo in range(0, n, cp):
        part = level[:, lo : lo + cp]
        raw[:, : part.shape[1]] += part
    raw /= np.bincount(np.arange(n) % cp, minlength=cp)
    raw = raw / raw.mean(1, keepdims=True)
    wave = np.exp(2j * np.pi * np.arange(cp) / cp)
    turn = 2 * np.mean((raw - 1) * wave, axis=1, keepdims=True)
    harmonic = 1 + turn.real * wave.real + turn.imag * wave.imag
    cost = lambda e: cp * np.log(np.maximum(_dot(e, e) / cp, TINY_LOG))
    prior = np.where((cost(raw - harmonic) + 2 * math.log(cp) < cost(raw - 1))[:, None], harmonic, 1.0)
    share = (n // cp) / (n // cp + cp)
    mixed = np.maximum(share * raw + (1 - share) * prior, TINY_SHAPE)
    return mixed / mixed.mean(1, keepdims=True)


def _rising(logs: np.ndarray, power: np.ndarray) -> np.ndarray:
    p = np.where(power == 0, 1.0, power)[:, None]
    bent = p * logs
    z = np.expm1(bent) / p
    slope = (logs * np.exp(bent) - z) / p
    if not power.all():
        zero = (power == 0)[:, None]
        z, slope = np.where(zero, logs, z), np.where(zero, logs * logs / 2, slope)
    return _dot(z - z.mean(1, keepdims=True), slope) < 0


def _powers(x: np.ndarray) -> np.ndarray:
    """boxcox_power() of rows of positive values."""
    n, out = x.shape[1], np.ones(len(x))
    own = np.flatnonzero(x.max(1) != x.min(1))
    if n < LEAST_POSITIVE or not len(own):
        return out
    logs = np.log(x[own])
    p = _COARSE[:, None]
    z = logs[:, None, :] * p
    top = z.max(2)
    z = np.where(p == 0, logs[:, None, :], np.exp(z - top[:, :, None]))
    z -= z.mean(2, keepdims=True)
    flat = _COARSE == 0
    spread = _dot(z, z) / n / np.where(flat, 1.0, _COARSE) ** 2
    with np.errstate(divide="ignore"):
        likely = (_COARSE - 1) * logs.sum(1)[:, None] - n / 2 * (np.log(spread) + 2 * np.where(flat, 0.0, top))
    at = np.argmax(np.where(spread > 0, likely, -np.inf), axis=1)
    low, high = (np.clip(_COARSE[np.clip(i, 0, len(_COARSE) - 1)], 0.0, 1.0) for i in (at - 1, at + 1))
    logs = logs - logs.mean(1, keepdims=True)
    goes = (low < high) & _rising(logs, low)
    ends = goes & _rising(logs, high)
    out[own] = np.where(ends, high, low)
    rest = np.flatnonzero(goes & ~ends)
    if len(rest):
        logs, low, high = logs[rest], low[rest], high[rest]
        for _ in range(60):
            middle = (low + high) / 2
            up = _rising(logs, middle)
            low, high = np.where(up, middle, low), np.where(up, high, middle)
        out[own[rest]] = (low + high) / 2
    return out


def _ridge(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, ...]:
    """ridge() of x (series, rows, features): coefficients, left-out residuals, and right, values and filter for leverages."""
    left, values, right = np.linalg.svd(x, full_matrices=False)
    energy, target, hat = values**2, np.einsum("srf,sr->sf", left, y), left * left
    keep = energy[:, None, :] / (energy[:, None, :] + np.array(PENALTIES)[:, None])
    rest = y[:, None, :] - (keep * target[:, None, :]) @ left.transpose(0, 2, 1)
    score = np.mean((rest / np.maximum(1 - keep @ hat.transpose(0, 2, 1), TINY)) ** 2, axis=2)
    least = score.min(1, keepdims=True)
    weight = np.exp(-(score - least) / np.maximum(least, TINY))
    weight /= weight.sum(1, keepdims=True)
    weight[weight < TINY_WEIGHT] = 0
    mean = np.einsum("sk,skf->sf", weight, keep)
    coef = np.einsum("sfg,sf->sg", right, mean * target / np.maximum(values, TINY))
    own = np.einsum("srf,sf->sr", hat, mean)
    loo = (y - np.einsum("srf,sf->sr", x, coef)) / np.maximum(1 - own, TINY) / np.sqrt(np.maximum(1 + own, TINY))
    return coef, loo, right, np.maximum(values, TINY), mean


def _trends(z: np.ndarray, m: int) -> np.ndarray:
    n, d = z.shape[1], np.diff(z)
    phi = np.zeros(len(z))
    if d.shape[1] >= 5:
        d = d - d.mean(1, keepdims=True)
        power = _dot(d, d)
        own = power >= TINY
        phi[own] = np.maximum(_dot(d[own, :-1], d[own, 1:]) / power[own], 0.0)
    phi = np.minimum(phi, 1 - TINY)[:, None]
    return np.where(phi <= TINY, (n - 1) / n, (n - 1 + phi * (1 - phi ** np.arange(1.0, m + 1)) / (1 - phi)) / n)


def _paths(y: np.ndarray, series: list[Series], n: int, p: int, secondary: tuple[int, ...], values: np.ndarray | None, columns: int, horizon: int, freq: str, n_samples: int, seeds: list[int]) -> np.ndarray | None:
    """Sample paths of series with one length and one period; None if they are too short to be stacked."""
    if p > 1 and not _enough(n // p, secondary, p, period_of(freq), 0):
        p, secondary, values = 1, (), None
    nc = min(n // p, MOST_PERIODS)
    lags = cross_lags(secondary, p, period_of(freq), nc)
    lag = max(lags, default=0)
    if lag and nc - lag < LEAST_PERIODS:
        lag = 0
    rows = np.arange(max(1, lag), nc)
    if len(rows) < 4:
        return None
    cells = y[:, y.shape[1] - nc * p :].reshape(len(y), nc, p)
    raw = cells.sum(2)
    level = raw if values is None else raw * _shrinkage(values, p, columns or nc)[:, None]
    if level.min() <= TINY:
        raise ValueError("a level without mass")
    last = min(SHAPE_PERIODS, nc)
    shape = (cells[:, -last:] / raw[:, -last:, None]).mean(1)
    shape = shape / np.maximum(shape.sum(1, keepdims=True), TINY)
    m = -(-horizon // p)
    block, phase = np.divmod(np.arange(horizon), p)

    factors = _factors(level, lags[0]) if lags else None
    flat = level if factors is None else level / np.maximum(factors[:, np.arange(nc) % lags[0]], TINY)
    power = _powers(flat)[:, None]
    whole, safe = np.maximum(flat, TINY_BOXCOX), np.where(power == 0, 1.0, power)
    z = np.where(power == 0, np.log(whole), (whole**safe - 1) / safe)
    end = z[:, -1:]
    innov = z - end
    parts = [np.ones((len(y), len(rows))), np.broadcast_to(rows / nc, (len(y), len(rows))), -innov[:, rows - 1]] + ([innov[:, rows - lag]] if lag else [])
    coef, loo, right, size, kept = _ridge(np.stack(parts, axis=2), innov[:, rows] - innov[:, rows - 1])
    coef[:, 2] = 1 - coef[:, 2]
    trend, past = _trends(z, m), max(1, lag)

    def step(path: np.ndarray, j: int) -> np.ndarray:
        b = coef.reshape(len(coef), *[1] * (path.ndim - 2), -1)
        out = b[..., 0] + b[..., 1] * trend[:, j].reshape(b.shape[:-1]) + b[..., 2] * path[..., past + j - 1]
        return out + b[..., 3] * path[..., past + j - lag] if lag else out

    path, leverage = np.empty((len(y), past + m)), np.empty((len(y), m))
    path[:, :past] = innov[:, -past:]
    for j in range(m):
        x = np.stack([np.ones(len(y)), trend[:, j], -path[:, past + j - 1]] + ([path[:, past + j - lag]] if lag else []), axis=1)
        u = np.einsum("sfg,sg->sf", right, x) / size
        leverage[:, j] = _dot(u * u, kept)
        path[:, past + j] = step(path, j)
    leverage = np.clip(leverage, 0.0, 10.0)

    k = min(NOISE_PERIODS, nc)
    rng = np.random.RandomState(0)
    level_at, phase_at = np.empty((len(y), n_samples * m), int), np.empty((len(y), n_samples), int)
    for i, seed in enumerate(seeds):
        rng.seed(seed)
        level_at[i] = drawn_places(rng, len(rows), n_samples * m)
        phase_at[i] = drawn_places(rng, k, n_samples)
    unit = (loo - loo.mean(1, keepdims=True)) / np.maximum(loo.std(1, keepdims=True), TINY)
    noise = np.take_along_axis(unit, level_at, 1).reshape(len(y), n_samples, m) * np.sqrt(loo.var(1, keepdims=True) * (1 + leverage))[:, None, :]
    paths = np.empty((len(y), n_samples, past + m))
    paths[:, :, :past] = innov[:, None, -past:]
    for j in range(m):
        paths[:, :, past + j] = step(paths, j) + noise[:, :, j]
    v, power, safe = paths[:, :, past:] + end[:, :, None], power[:, :, None], safe[:, :, None]
    hat = np.clip(1 + power * v, TINY, np.exp(EXPONENT_LIMIT * power)) ** (1 / safe)
    if not power.all():
        hat = np.where(power == 0, np.exp(np.clip(v, -EXPONENT_LIMIT, EXPONENT_LIMIT)), hat)
    if factors is not None:
        hat = hat * factors[:, None, (nc + np.arange(m)) % lags[0]]

    fit = raw[:, -k:, None] * shape[:, None, :]
    if fit.min() <= TINY:
        raise ValueError("a phase without mass")
    floor = np.maximum(0.1 * np.median(fit.reshape(len(y), -1), axis=1), TINY_BOXCOX)
    residuals = (cells[:, -k:] - fit) / np.maximum(fit, floor[:, None, None])
    if k >= 4:
        mean, err = residuals.mean(1, keepdims=True), residuals.var(1, ddof=1, keepdims=True) / k
        residuals = residuals - mean * np.clip(err / (mean * mean + err + TINY), 0.0, 1.0)
    drawn = residuals[np.arange(len(y))[:, None], phase_at]
    spread = np.sqrt(1 + leverage)
    shift = np.array([s.shift for s in series])[:, None, None]
    out = hat[:, :, block] * shape[:, None, phase] * (1 + drawn[:, :, phase] / spread[:, None, block]) - shift

    low, top, least = (np.array(c)[:, None, None] for c in ([s.low for s in series], [s.recent.max() for s in series], [s.recent.min() for s in series]))
    out = np.clip(out, low, top + np.maximum(top - least, TINY_SHAPE))
    integers = np.array([s.whole for s in series])
    out[integers] = np.rint(out[integers])
    return np.nan_to_num(out, nan=0.0)
