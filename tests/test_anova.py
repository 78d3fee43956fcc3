"""ANOVA of any design against nested least-squares fits, and noncentral distributions against integrals."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialmill.functions import distributions as dist
from trialmill.operators import statistics as stats
from trialmill.operators.anova import anova

PHASE, SIDE = ("a", "b", "c"), ("l", "r")


@pytest.fixture(scope="module")
def design(spark):
    """Unequal groups of two factors between, three by two cells within; one subject lacks a cell, one a group."""
    rng = np.random.default_rng(5)
    data, table = [], {}
    sizes = {("p", "x"): 5, ("q", "x"): 3, ("p", "y"): 2, ("q", "y"): 6}
    s = 0
    for (g, h), size in sizes.items():
        for _ in range(size):
            own = rng.normal(0, 2)
            for phase, side in itertools.product(PHASE, SIDE):
                v = float(10 + own + (phase == "b") * (g == "p") + (h == "x") * (side == "l") * 2 + rng.normal(0, 1 + (phase == "c")))
                data += [(s, g, h, phase, side, v - 1), (s, g, h, phase, side, v + 1)]  # averaged
                table[s, g, h, phase, side] = v
            s += 1
    data += [(90, "p", "x", "a", "l", 500.0)] + [(91, None, "x", p, q, 7.0) for p in PHASE for q in SIDE]
    return table, spark.createDataFrame(data, "subject int, g string, h string, phase string, side string, y double")


def indicators(keys, places):
    names = sorted({tuple(k[p] for p in places) for k in keys})
    return np.array([[float(tuple(k[p] for p in places) == n) for n in names] for k in keys])


def residual(columns, y):
    x = np.hstack(columns)
    return float(((y - x @ np.linalg.lstsq(x, y, rcond=None)[0]) ** 2).sum())


def expected(table):
    """SS of every effect by nested fits of a subject's projected cells; places: 1 g, 2 h, 3 phase, 4 side."""
    keys = sorted(table)
    y = np.array([table[k] for k in keys])
    out = {}
    between = [(), (1,), (2,), (1, 2)]
    for w in [(), (3,), (4,), (3, 4)]:
        # the part of the data that belongs to this effect within subjects
        part = np.zeros_like(y)
        for size in range(len(w) + 1):
            for t in itertools.combinations(w, size):
                x = indicators(keys, (0, *t))
                part += (-1) ** (len(w) - len(t)) * (x @ (x.T @ y / x.sum(axis=0)))
        error = residual([indicators(keys, (1, 2, *w))], part)
        for b in between:
            free = [indicators(keys, (*t, *w)) for t in between if not set(b) <= set(t)] or [np.zeros((len(y), 1))]
            ss = residual(free, part) - residual([*free, indicators(keys, (*b, *w))], part)
            name = ":".join({1: "g", 2: "h", 3: "phase", 4: "side"}[p] for p in (*b, *w)) or "(Intercept)"
            out[name] = ss, error
    return out


def test_agrees_with_nested_fits(design):
    table, df = design
    out = {r.effect: r for r in anova(df, "y", "subject", {"phase": PHASE, "side": SIDE}, ["g", "h"]).collect()}
    want = expected(table)
    assert set(out) == set(want)
    errors = sum({k: e for k, (_, e) in want.items() if k in ("(Intercept)", "phase", "side", "phase:side")}.values())
    for name, (ss, error) in want.items():
        r = out[name]
        width = 2 if "phase" in name else 1
        assert (r.ss, r.ss_error, r.df1, r.df2) == (pytest.approx(ss, abs=1e-8), pytest.approx(error), width, 12 * width)
        assert r.f == pytest.approx(ss / width / (error / (12 * width)))
        assert (r.eta2, r.ges) == (pytest.approx(ss / (ss + error)), pytest.approx(ss / (ss + errors)))
        assert (r.gg is None) == (width == 1) and 0 <= r.eta2_low <= r.eta2_high <= 1


def test_epsilon_from_the_covariance(design):
    table, df = design
    out = {r.effect: r for r in anova(df, "y", "subject", {"phase": PHASE}, "g").collect()}
    means = {}
    for (s, g, _, phase, _), v in table.items():
        means.setdefault((g, s), {}).setdefault(phase, []).append(v)
    rows = {g: np.array([[np.mean(c[p]) for p in PHASE] for (h, _), c in sorted(means.items()) if h == g]) for g in "pq"}
    pooled = sum((x - x.mean(axis=0)).T @ (x - x.mean(axis=0)) for x in rows.values()) / 14
    # the textbook form with means of the covariance matrix
    k, mean = 3, pooled.mean()
    gg = k**2 * (np.diag(pooled).mean() - mean) ** 2 / ((k - 1) * ((pooled**2).sum() - 2 * k * (pooled.mean(axis=0) ** 2).sum() + k**2 * mean**2))
    hf = min(1.0, (15 * 2 * gg - 2) / (2 * (14 - 2 * gg)))
    for name in ("phase", "g:phase"):
        assert (out[name].gg, out[name].hf) == (pytest.approx(gg), pytest.approx(hf))
        assert out[name].p_gg == pytest.approx(float(dist.beta_upper(14 * gg, gg, 1 / (1 + out[name].f / 14))))


def test_agrees_with_contrasts(design):
    _, df = design
    two = df.where("phase <> 'c'")
    new = {r.effect: r for r in anova(two, "y", "subject", {"phase": ("a", "b"), "side": SIDE}, "g").collect()}
    for r in stats.anova_contrast(two.where("g IS NOT NULL"), "y", "subject", {"phase": ("a", "b"), "side": SIDE}, "g").collect():
        n = new[r.effect]
        assert (n.ss, n.ss_error, n.df1, n.df2, n.f, n.p) == tuple(pytest.approx(v) for v in (r.ss, r.ss_error, r.df1, r.df2, r.f, r.p))


def test_by_and_degenerate(spark, design):
    _, df = design
    by = anova(df.where("g IS NOT NULL"), "y", "subject", {"phase": PHASE}, by=["g"]).collect()
    one = {r.effect: r for r in anova(df.where("g = 'p'"), "y", "subject", {"phase": PHASE}).collect()}
    assert {(r.g, r.effect) for r in by} == {(g, e) for g in "pq" for e in ("(Intercept)", "phase")}
    assert all(r.ss == pytest.approx(one[r.effect].ss) for r in by if r.g == "p")
    single = spark.createDataFrame([(1, "a", 2.0), (1, "b", 3.0)], "subject int, phase string, y double")
    out = {r.effect: r for r in anova(single, "y", "subject", {"phase": ("a", "b")}).collect()}
    assert out["phase"].ss == pytest.approx(0.5) and (out["phase"].f, out["phase"].p, out["phase"].eta2_low) == (None, None, None)
    assert anova(single.limit(0), "y", "subject", {"phase": ("a", "b")}).count() == 0
    plain = {r.effect: r for r in anova(df, "y", "subject", between="g").collect()}
    assert set(plain) == {"(Intercept)", "g"} and plain["g"].df2 == 15  # nobody lacks a cell


def t_cdf(t, df, delta):
    """The chance by integration over the standard deviation."""
    s = np.linspace(1e-9, 6, 400_001)
    log = (df / 2) * math.log(df / 2) * 1.0 + math.log(2) - math.lgamma(df / 2) + (df - 1) * np.log(s) - df * s * s / 2
    normal = 0.5 * np.vectorize(math.erfc)(-(t * s - delta) / math.sqrt(2))
    y = np.exp(log) * normal
    return float(((y[1:] + y[:-1]) / 2).sum() * (s[1] - s[0]))


@pytest.mark.parametrize("t, df, delta", [(2.0, 10, 1.0), (-1.5, 5, 0.7), (0.0, 4, 0.3), (8.0, 30, 6.5), (3.0, 3, -1.0)])
def test_noncentral_t(t, df, delta):
    assert dist.noncentral_t_cdf(np.array([t]), np.array([df]), np.array([delta]))[0] == pytest.approx(t_cdf(t, df, delta), abs=1e-8)


@pytest.mark.parametrize("f, df2, m", [(3.0, 10, 2.0), (0.5, 20, 0.0), (12.0, 8, 30.0)])
def test_noncentral_f(f, df2, m):
    """One degree: the square of t; three: a shifted normal squared plus an exponential of mean two."""
    one = dist.noncentral_f_cdf(np.array([f]), np.array([1]), np.array([df2]), np.array([m]))[0]
    t = math.sqrt(f)
    assert one == pytest.approx(t_cdf(t, df2, math.sqrt(m)) - t_cdf(-t, df2, math.sqrt(m)), abs=1e-7)
    z = np.linspace(-12, 12, 4_001)
    v = np.linspace(1e-6, 8 * df2, 4_001)
    chi = np.exp((df2 / 2 - 1) * np.log(v) - v / 2 - (df2 / 2) * math.log(2) - math.lgamma(df2 / 2))
    left = np.maximum(f * 3 * v[:, None] / df2 - (z[None, :] + math.sqrt(m)) ** 2, 0)
    inside = (np.exp(-z * z / 2) / math.sqrt(2 * math.pi))[None, :] * -np.expm1(-left / 2)
    want = float((inside.sum(axis=1) * (z[1] - z[0]) * chi).sum() * (v[1] - v[0]))
    three = dist.noncentral_f_cdf(np.array([f]), np.array([3]), np.array([df2]), np.array([m]))[0]
    assert three == pytest.approx(want, abs=1e-5)


def test_intervals_hold_their_limits(spark):
    t, df = np.array([2.83, -0.4, 0.0, 25.0, 1.2, np.nan]), np.array([126.0, 7, 3, 60, 1, 5])
    low, high = dist.t_noncentrality(t, df)
    # fixed values: a printed example of the interval of a noncentrality
    assert (low[0], high[0]) == (pytest.approx(0.8337502, abs=1e-6), pytest.approx(4.815359, abs=1e-6))
    assert dist.noncentral_t_cdf(t[:5], df[:5], low[:5]) == pytest.approx([0.975] * 5, abs=1e-9)
    assert dist.noncentral_t_cdf(t[:5], df[:5], high[:5]) == pytest.approx([0.025] * 5, abs=1e-9)
    assert np.isnan(low[5]) and np.isnan(high[5])
    f, d1, d2 = np.array([5.0, 0.1, 40.0, 2.0]), np.array([5.0, 2, 1, 1.6]), np.array([100.0, 20, 60, 31.4])
    low, high = dist.f_noncentrality(f, d1, d2)
    for goal, m in ((0.95, low), (0.05, high)):
        got = dist.noncentral_f_cdf(f, d1, d2, m)
        assert all(g == pytest.approx(goal, abs=1e-9) or (x == 0 and g <= goal) for g, x in zip(got, m))
    data = spark.createDataFrame([(float(v),) for v in (1, 2, 4, 3, 5, 2, -1)], "v double")
    r = stats.effect_interval(stats.t_test_one(data, "v")).first()
    assert r.d_low < r.d < r.d_high and dist.noncentral_t_cdf(np.array([r.t]), np.array([6]), np.array([r.d_low * 7**0.5]))[0] == pytest.approx(0.975)
    flat = stats.effect_interval(stats.t_test_one(data.select(F.lit(2.0).alias("v")), "v")).first()
    assert (flat.d_low, flat.d_high) == (None, None)
