"""Outlier rejection against plain loops, for groups trimmed whole and in rounds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialmill.operators import outliers

from conftest import rows


def by_hand_points(x, y, z=None, radius=None, stop=3):
    """Drop the farthest point while it stands out."""
    kept = [i for i in range(len(x)) if x[i] is not None and y[i] is not None]
    while len(kept) > stop:
        cx, cy = np.mean([x[i] for i in kept]), np.mean([y[i] for i in kept])
        far = {i: np.hypot(x[i] - cx, y[i] - cy) for i in kept}
        worst = max(kept, key=lambda i: (far[i], -i))
        others = [far[i] for i in kept if i != worst]
        limit = radius if radius is not None else np.mean(others) + z * np.std(others, ddof=1)
        if far[worst] <= limit:
            break
        kept.remove(worst)
    return set(kept)


def by_hand_values(x, mode, limit):
    kept = [i for i in range(len(x)) if x[i] is not None]
    value = lambda i: x[i]
    while len(kept) > {"z": 3, "abs": 2, "spread": 1}[mode]:
        low = min(kept, key=lambda i: (x[i], i))
        high = min(kept, key=lambda i: (-x[i], i))
        if mode == "spread":
            if x[high] - x[low] <= limit:
                break
            mean = np.mean([x[i] for i in kept])
            kept.remove(min(kept, key=lambda i: (-abs(x[i] - mean), i)))
            continue
        rest = [value(i) for i in kept if i not in (low, high)]
        width = limit * np.std(rest, ddof=1) if mode == "z" else limit
        out = {i for i in (low, high) if abs(x[i] - np.mean(rest)) > width}
        if not out:
            break
        kept = [i for i in kept if i not in out]
    return set(kept)


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(4)
    data = []
    for g in range(3):
        n = [60, 40, 4][g]
        xy = rng.normal(0, 10, (n, 2))
        xy[rng.random(n) < 0.2] *= 9
        for i, (a, b) in enumerate(xy):
            gone = rng.random() < 0.05
            data.append((f"s{g}", 1, i, None if gone else float(a), float(b)))
    return data, spark.createDataFrame(data, "subject string, block int, trial int, x double, y double")


def want(data, fn):
    out = set()
    for s in sorted({d[0] for d in data}):
        group = [d for d in data if d[0] == s]
        out |= {(s, group[i][2]) for i in fn([d[3] for d in group], [d[4] for d in group])}
    return out


def got(df, name="ok"):
    return {(r.subject, r.trial) for r in df.where(F.col(name)).collect()}


@pytest.mark.parametrize("group_rows,candidates", [(1000, 10), (5, 3), (5, 500)])
def test_points(points, group_rows, candidates):
    data, df = points
    sizes = {"group_rows": group_rows, "candidates": candidates}
    z = outliers.reject_outlier_points(df, "x", "y", z=2.0, **sizes)
    assert got(z) == want(data, lambda x, y: by_hand_points(x, y, z=2.0))
    spread = outliers.reject_spread_points(df, "x", "y", spread=40.0, within=None, **sizes)
    assert got(spread) == want(data, lambda x, y: by_hand_points(x, y, radius=20.0, stop=2))
    assert z.count() == len(data)


@pytest.mark.parametrize("group_rows,candidates", [(1000, 10), (5, 3)])
@pytest.mark.parametrize("mode,limit", [("z", 2.0), ("spread", 40.0), ("abs", 30.0)])
def test_values(points, group_rows, candidates, mode, limit):
    data, df = points
    out = outliers.reject_outlier_values(
        df, "x", mode=mode, limit=limit, group_rows=group_rows, candidates=candidates
    )
    assert got(out) == want(data, lambda x, y: by_hand_values(x, mode, limit))


def test_spread_starts_from_the_flag(spark):
    df = spark.createDataFrame(
        [("s", 1, i, float(v), 0.0, v < 900) for i, v in enumerate([0, 10, 75, 1000])],
        "subject string, block int, trial int, x double, y double, ok boolean",
    )
    out = outliers.reject_spread_points(df, "x", "y", spread=150.0)
    assert rows(out.where("ok").select("trial")) == [(0,), (1,), (2,)]


@pytest.mark.parametrize("mode", ["z", "spread", "abs"])
def test_equal_values_in_a_large_group(spark, mode):
    df = spark.range(20).selectExpr("'s' AS subject", "1 AS block", "id AS trial", "0.1D AS x")
    out = outliers.reject_outlier_values(df, "x", mode=mode, limit=1.0, group_rows=5, candidates=3)
    assert out.where("ok").count() == 20
