"""Transforms of correlations and the tails of the t and F distributions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def fisher_z(r: Column, prune: float | None = None) -> Column:
    """Fisher transform; with `prune`, correlations at or beyond one are pulled back to it."""
    if prune is not None:
        r = F.when(F.abs(r) >= 1.0, F.signum(r) * F.lit(prune)).otherwise(r)
    return F.atanh(r)


def fisher_z_inv(z: Column) -> Column:
    """Back from Fisher z to a correlation."""
    return F.tanh(z)


def spearman_brown(r: Column, n: float = 2) -> Column:
    """Reliability of a measure made n times as long."""
    return r * F.lit(float(n)) / (r * F.lit(float(n - 1)) + F.lit(1.0))


def _log_gamma(x: np.ndarray) -> np.ndarray:
    return np.vectorize(math.lgamma, otypes=[float])(x)


def _continued_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function, evaluated forward for all rows at once."""
    tiny = 1e-300

    def guard(v: np.ndarray) -> np.ndarray:
        return np.where(np.abs(v) < tiny, tiny, v)

    c = np.ones_like(x)
    d = 1.0 / guard(1.0 - (a + b) * x / (a + 1.0))
    value = d.copy()
    for m in range(1, 2000):
        even = m * (b - m) * x / ((a + 2 * m - 1.0) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1.0))
        for step in (even, odd):
            d = 1.0 / guard(1.0 + step * d)
            c = guard(1.0 + step / c)
            change = d * c
            value = value * change
        if np.all(np.abs(change - 1.0) < 1e-15):
            break
    return value


def beta_upper(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function I_x(a, b)."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, dtype=float) for v in (a, b, x)))
    out = np.full(x.shape, np.nan)
    out[x <= 0.0] = 0.0
    out[x >= 1.0] = 1.0
    todo = (x > 0.0) & (x < 1.0) & (a > 0.0) & (b > 0.0)
    if todo.any():
        a, b, x = a[todo], b[todo], x[todo]
        swap = x > (a + 1.0) / (a + b + 2.0)
        p, q, y = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1.0 - x, x)
        front = np.exp(
            _log_gamma(p + q) - _log_gamma(p) - _log_gamma(q) + p * np.log(y) + q * np.log1p(-y)
        )
        part = front * _continued_fraction(p, q, y) / p
        out[todo] = np.where(swap, 1.0 - part, part)
    return out


@F.pandas_udf(DoubleType())
def f_tail(f: pd.Series, df1: pd.Series, df2: pd.Series) -> pd.Series:
    """P(F > f)."""
    f, df1, df2 = (v.to_numpy(dtype=float) for v in (f, df1, df2))
    with np.errstate(invalid="ignore", divide="ignore"):
        p = beta_upper(df2 / 2.0, df1 / 2.0, df2 / (df2 + df1 * np.maximum(f, 0.0)))
    return pd.Series(np.where(np.isfinite(f), p, np.nan)).astype("Float64")


def t_tail(t: Column, df: Column, tail: str = "two") -> Column:
    """Tail probability of t: `two`, `greater` or `less`."""
    both = F.nanvl(f_tail(t * t, F.lit(1.0), df.cast("double")), F.lit(None).cast("double"))
    if tail == "two":
        return both
    beyond = t > 0 if tail == "greater" else t < 0
    return F.when(t.isNotNull(), F.when(beyond, both / 2.0).otherwise(1.0 - both / 2.0))


def _erfc(x: np.ndarray) -> np.ndarray:
    return np.vectorize(math.erfc, otypes=[float])(x)


def _log_gamma_run(start: np.ndarray, count: int) -> np.ndarray:
    """log gamma of start, start + 1, ... in each row."""
    steps = np.log(start[:, None] + np.arange(count - 1))
    return _log_gamma(start)[:, None] + np.concatenate([np.zeros((len(start), 1)), np.cumsum(steps, axis=1)], axis=1)


def _beta_run(a: np.ndarray, b: np.ndarray, x: np.ndarray, count: int) -> np.ndarray:
    """I_x(a, b), I_x(a + 1, b), ... in each row: summed from the last one down, where all steps are positive."""
    up, x = a[:, None] + np.arange(count), np.maximum(x, 1e-300)[:, None]
    logs = up * np.log(x) + (b * np.log1p(-x[:, 0]) - _log_gamma(b))[:, None] - np.log(up)
    steps = np.exp(logs + _log_gamma_run(a + b, count) - _log_gamma_run(a, count))
    steps[:, -1] = beta_upper(up[:, -1], b, x[:, 0])
    return np.cumsum(steps[:, ::-1], axis=1)[:, ::-1]


def _poisson_run(mean: np.ndarray) -> tuple[np.ndarray, int]:
    """First place and number of places beyond which Poisson terms are below 1e-16."""
    half = 9.0 * np.sqrt(mean) + 60.0
    return np.maximum(0.0, np.floor(mean - half)), int(2 * half.max()) + 2


def _poisson(mean: np.ndarray, first: np.ndarray, count: int, shift: float) -> np.ndarray:
    """exp(-mean) mean^j / gamma(j + shift) for `count` places j from `first` on."""
    j, logs = first[:, None] + np.arange(count), np.log(np.maximum(mean, 1e-300))[:, None]
    return np.exp(-mean[:, None] + j * logs - _log_gamma_run(first + shift, count))


def noncentral_t_cdf(t: np.ndarray, df: np.ndarray, delta: np.ndarray) -> np.ndarray:
    """P(T <= t) of the t distribution with noncentrality delta, as a series of incomplete beta functions."""
    t, df, delta = (v.astype(float) for v in np.broadcast_arrays(t, df, delta))
    mirrored = t < 0
    t, delta = np.abs(t), np.where(mirrored, -delta, delta)
    x, mean = t * t / (df + t * t), delta * delta / 2.0
    first, count = _poisson_run(mean)
    even = _poisson(mean, first, count, 1.0) * _beta_run(first + 0.5, df / 2.0, x, count)
    odd = _poisson(mean, first, count, 1.5) * _beta_run(first + 1.0, df / 2.0, x, count)
    series = (even + (delta / math.sqrt(2.0))[:, None] * odd).sum(axis=1)
    cdf = np.clip(0.5 * _erfc(delta / math.sqrt(2.0)) + np.where(t > 0, 0.5 * series, 0.0), 0.0, 1.0)
    return np.where(mirrored, 1.0 - cdf, cdf)


def noncentral_f_cdf(f: np.ndarray, df1: np.ndarray, df2: np.ndarray, noncentrality: np.ndarray) -> np.ndarray:
    """P(F <= f) of the F distribution with a noncentrality, as a mixture of incomplete beta functions."""
    f, df1, df2, noncentrality = (v.astype(float) for v in np.broadcast_arrays(f, df1, df2, noncentrality))
    x, mean = df1 * f / (df1 * f + df2), noncentrality / 2.0
    first, count = _poisson_run(mean)
    mixture = _poisson(mean, first, count, 1.0) * _beta_run(first + df1 / 2.0, df2 / 2.0, x, count)
    return np.clip(np.where(f > 0, mixture.sum(axis=1), 0.0), 0.0, 1.0)


def _falls_to(cdf, goal: float, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Where a function that falls from row to row's `low` to its `high` has the value `goal`; brackets are halved."""
    for _ in range(70):
        middle = (low + high) / 2.0
        above = cdf(middle) > goal
        low, high = np.where(above, middle, low), np.where(above, high, middle)
        if np.all(high - low <= 1e-12 * np.maximum(1.0, np.abs(high))):
            break
    return (low + high) / 2.0


def _widened(cdf, goal: float, start: np.ndarray, step: np.ndarray) -> np.ndarray:
    """The start moved by doubling steps until the function is beyond `goal` there, upwards for positive steps."""
    place, step = start.copy(), step.astype(float)
    for _ in range(60):
        short = (cdf(place) > goal) if step[0] > 0 else (cdf(place) < goal)
        if not short.any():
            break
        place, step = np.where(short, place + step, place), step * 2.0
    return place


def t_noncentrality(t: np.ndarray, df: np.ndarray, level: float = 0.95) -> tuple[np.ndarray, np.ndarray]:
    """Limits of the noncentrality for which t lies within the middle `level` of its distribution."""
    t, df = (np.asarray(v, float) for v in (t, df))
    out = np.full((2, len(t)), np.nan)
    known = np.isfinite(t) & (df > 0)
    if known.any():
        t, df = t[known], df[known]
        width = 4.0 * np.sqrt(1.0 + t * t / (2.0 * df)) + 1.0
        for k, goal in enumerate(((1.0 + level) / 2.0, (1.0 - level) / 2.0)):
            cdf = lambda d: noncentral_t_cdf(t, df, d)
            out[k, known] = _falls_to(cdf, goal, _widened(cdf, goal, t - width, -width), _widened(cdf, goal, t + width, width))
    return out[0], out[1]


def f_noncentrality(f: np.ndarray, df1: np.ndarray, df2: np.ndarray, level: float = 0.9) -> tuple[np.ndarray, np.ndarray]:
    """Limits of the noncentrality for which F lies within the middle `level`; zero where even that is too large."""
    f, df1, df2 = (np.asarray(v, float) for v in (f, df1, df2))
    out = np.full((2, len(f)), np.nan)
    known = np.isfinite(f) & (df1 > 0) & (df2 > 0) & (f >= 0)
    if known.any():
        f, df1, df2 = f[known], df1[known], df2[known]
        for k, goal in enumerate(((1.0 + level) / 2.0, (1.0 - level) / 2.0)):
            cdf = lambda m: noncentral_f_cdf(f, df1, df2, m)
            zero = np.zeros(len(f))
            high = _widened(cdf, goal, f * df1 + 1.0, f * df1 + 10.0)
            out[k, known] = np.where(cdf(zero) > goal, _falls_to(cdf, goal, zero, high), 0.0)
    return out[0], out[1]


def d_interval(t: Column, df: Column, n: Column, level: float = 0.95) -> Column:
    """Struct of `low` and `high`: the interval of a mean in standard deviations, from its t against zero."""

    @F.pandas_udf("low double, high double")
    def limits(t: pd.Series, df: pd.Series, n: pd.Series) -> pd.DataFrame:
        low, high = t_noncentrality(t.to_numpy(float), df.to_numpy(float), level)
        root = np.sqrt(n.to_numpy(float))
        return pd.DataFrame({"low": pd.Series(low / root).astype("Float64"), "high": pd.Series(high / root).astype("Float64")})

    return limits(t, df.cast("double"), n.cast("double"))


def eta2_interval(f: np.ndarray, df1: np.ndarray, df2: np.ndarray, level: float = 0.9) -> tuple[np.ndarray, np.ndarray]:
    """Interval of a partial eta squared from its F."""
    return tuple(m / (m + df1 + df2 + 1.0) for m in f_noncentrality(f, df1, df2, level))
