import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from trialmill.llm import vp_centroids

SCHEMA = "vec_id long, embedding array<double>, cluster string, distance string"


def brute(rows, k, rounds, size):
    """Plain loops with Python's integers."""
    kept = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if v is not None and len(v) == size and None not in v and np.isfinite(v).all()]
    named = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centroids = [v for _, v in named[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        of = {}
        for _, v in kept:
            of.setdefault(nearest(v)[1], []).append(v)
        for n, members in of.items():
            centroids[n] = [sum(x) // len(members) for x in zip(*members)]
    found = [(i, *nearest(v)[::-1]) for i, v in kept]
    total = sum(d for _, _, d in found)
    return sorted(
        [(i, n, d, sum(e for _, m, e in found if m == n), total, hashlib.sha256(",".join(map(str, centroids[n])).encode()).hexdigest()) for i, n, d in found], key=str
    )


def got(spark, rows, **options):
    table = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], SCHEMA)
    return sorted(map(tuple, vp_centroids.cluster(table, **options).collect()), key=str)


def test_agrees_with_plain_loops(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=4).round(2).tolist()) for i in range(300)]
    rows += [(1_000 + i, rows[0][1]) for i in range(40)]  # a hot vector
    rows += [(5, rows[5][1]), (5, rows[6][1]), (None, rows[7][1])]  # repeated ids and one without
    rows += [(2_000, None), (2_001, []), (2_002, [1.0, None, 1.0, 1.0]), (2_003, [float("nan")] * 4), (2_004, [float("inf")] * 4), (2_005, [1.0] * 3)]
    for k in (1, 2, 7, 25):
        assert got(spark, rows, k=k, rounds=3, size=4) == brute(rows, k, 3, 4)


def test_ties_and_few_vectors(spark):
    rows = [(i, [float(i % 2), 0.0]) for i in range(12)]  # equal centroids: all but the first of each stay empty
    assert got(spark, rows, k=9, rounds=2, size=2) == brute(rows, 9, 2, 2)
    assert got(spark, rows[:3], k=40, rounds=2, size=2) == brute(rows[:3], 40, 2, 2)
    assert got(spark, [], k=3, size=2) == [] and got(spark, [(None, [1.0, 2.0])], size=2) == []


def test_large_components(spark):
    rows = [(i, [float(2**30 * (i % 3)), float(i), -1e300 if i == 4 else 0.0]) for i in range(9)]
    out = got(spark, rows, k=3, rounds=2, size=3)
    assert len(out) == 9 and max(r[2] for r in out) <= 2**63 - 1
    cut = [(i, n, *(min(x, 2**63 - 1) for x in (d, c, t)), h) for i, n, d, c, t, h in brute(rows[:4], 2, 2, 3)]
    assert got(spark, rows[:4], k=2, rounds=2, size=3) == cut


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 30), st.integers(1, 5), st.integers(1, 6), st.integers(0, 10**6))
def test_tree_finds_the_nearest(k, size, spread, seed):
    rng = np.random.default_rng(seed)
    centroids, points = rng.integers(-spread, spread + 1, (k, size)), rng.integers(-spread, spread + 1, (40, size))
    number, squared, _ = vp_centroids.nearest(points, centroids, vp_centroids.build(centroids))
    for p, n, d in zip(points, number, squared):
        assert (d, n) == min((int(((p - c) ** 2).sum()), i) for i, c in enumerate(centroids))


def test_tree_leaves_centroids_out():
    rng = np.random.default_rng(1)
    centroids = rng.integers(-5_000, 5_000, (40, 3))
    points = centroids[rng.integers(0, 40, 500)] + rng.integers(-50, 50, (500, 3))
    _, _, computed = vp_centroids.nearest(points, centroids, vp_centroids.build(centroids))
    assert computed < 500 * 20


def test_given_vectors(spark, data):
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()]
    table = spark.read.parquet(f"{data}/embeddings.parquet").repartition(3)
    assert sorted(map(tuple, vp_centroids.cluster(table).collect()), key=str) == brute(rows, 40, 5, 64)


@pytest.mark.parametrize("n", [0, 1, 4, 5])
def test_small_trees(n):
    centroids = np.arange(n * 2).reshape(n, 2)
    members = sorted(m for node in vp_centroids.build(centroids) for m in node.members)
    assert members == list(range(n))
