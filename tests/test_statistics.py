"""Group statistics against numpy."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialmill.operators import statistics as stats


@pytest.fixture(scope="module")
def design(spark):
    """Balanced groups, two within factors; one more subject lacks a cell."""
    rng = np.random.default_rng(11)
    data, table = [], {}
    for s in range(12):
        group = "p" if s < 6 else "q"
        for soa, side in itertools.product((100, 500), ("l", "r")):
            v = float(rng.normal(10 + (soa == 100) * 2 + (side == "l") * (group == "p") * 3, 2))
            data.append((s, group, soa, side, v))
            table[s, soa, side] = v
    data.append((99, "p", 100, "l", 500.0))
    return table, spark.createDataFrame(data, "subject int, grp string, soa int, side string, y double")


def residual(x, y):
    return float(((y - x @ np.linalg.lstsq(x, y, rcond=None)[0]) ** 2).sum())


def test_anova_matches_nested_fits(design):
    table, df = design
    out = {r.effect: r for r in stats.anova_contrast(df, "y", "subject", {"soa": (100, 500), "side": ("l", "r")}, "grp").collect()}
    keys = list(table)
    y = np.array([table[k] for k in keys])
    a = np.array([1.0 if k[1] == 100 else -1.0 for k in keys])
    b = np.array([1.0 if k[2] == "l" else -1.0 for k in keys])
    g = np.array([1.0 if k[0] < 6 else -1.0 for k in keys])
    person = np.array([[float(k[0] == s) for s in range(12)] for k in keys])
    for name, effect in {"soa": a, "side": b, "soa:side": a * b}.items():
        own = person * effect[:, None]
        whole = residual(np.column_stack([person, own]), y)
        both = np.column_stack([person, effect, effect * g])
        error = residual(both, y) - whole
        for label, column in {name: effect, f"grp:{name}": effect * g}.items():
            others = np.column_stack([person, effect * g if label == name else effect])
            ss = residual(others, y) - residual(both, y)
            r = out[label]
            assert (r.ss, r.ss_error) == (pytest.approx(ss), pytest.approx(error))
            assert r.f == pytest.approx(ss / (error / 10)) and (r.df1, r.df2) == (1, 10)
            assert r.eta2 == pytest.approx(ss / (ss + error))
    means = person.T @ y / 4
    size = 4 * ((means[:6].mean() - means[6:].mean()) ** 2) * 3
    rest = 4 * (means[:6].var() + means[6:].var()) * 6
    assert (out["grp"].ss, out["grp"].ss_error) == (pytest.approx(size), pytest.approx(rest))
    assert out["(Intercept)"].ss == pytest.approx(48 * y.mean() ** 2)


def test_anova_without_groups(design):
    table, df = design
    out = stats.anova_contrast(df, "y", "subject", {"soa": (100, 500)}).where("effect = 'soa'").first()
    d = np.array([np.mean([table[s, 100, k] - table[s, 500, k] for k in "lr"]) for s in range(12)])
    t = d.mean() / (d.std(ddof=1) / np.sqrt(12))
    assert (out.f, out.df2) == (pytest.approx(t * t), 11)
    paired = df.groupBy("subject").agg(
        F.avg(F.when(F.col("soa") == 100, F.col("y"))).alias("a"), F.avg(F.when(F.col("soa") == 500, F.col("y"))).alias("b")
    )
    one = stats.t_test_paired(paired, "a", "b").first()
    assert (one.t, one.n, one.p) == (pytest.approx(t), 12, pytest.approx(out.p))


def test_correlation(spark):
    x, y = np.array([1.0, 2, 3, 4, 5, 6]), np.array([2.0, 1, 4, 3, 7, 5])
    data = [(float(a), float(b)) for a, b in zip(x, y)] + [(None, 1.0)]
    df = spark.createDataFrame(data, "x double, y double")
    r = stats.correlation(df, "x", "y").first()
    want = np.corrcoef(x, y)[0, 1]
    assert (r.r, r.n, r.df) == (pytest.approx(want), 6, 4)
    assert r.t == pytest.approx(want * np.sqrt(4 / (1 - want**2)))
    assert (r.low, r.high) == tuple(pytest.approx(np.tanh(np.arctanh(want) + s * 1.959964 / np.sqrt(3))) for s in (-1, 1))
    greater = stats.correlation(df, "x", "y", tail="greater").first()
    assert (greater.high, greater.p) == (1.0, pytest.approx(r.p / 2))
    assert stats.correlation(df, "x", "y", strict=True).first().r is None
    half = stats.split_half(df, "x", "y").first()
    assert half.rel_sb == pytest.approx(2 * want / (1 + want))


def test_degenerate_groups(spark):
    df = spark.createDataFrame([(1, 2.0)], "g int, v double")
    r = stats.t_test_one(df, "v", ["g"]).first()
    assert (r.n, r.sd, r.t, r.p) == (1, None, None, None)
    flat = spark.createDataFrame([(2.0,), (2.0,)], "v double")
    assert stats.t_test_one(flat, "v").first().t is None
