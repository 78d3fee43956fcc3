import duckdb
import numpy as np
import pytest

from trialmill.llm import pivot_table, queries, vectors, vp_trees

SCHEMA = "vec_id long, embedding array<float>, score string, rank string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "s", "r") for i, v in rows], SCHEMA)


def brute(rows, k, measure):
    out = {}
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all()]
    for i, v in good:
        if i % 50 == 0:
            scored = sorted((-measure(v, w), j) for j, w in good if j != i and len(w) == len(v))
            out[i] = [(j, -s) for s, j in scored[:k]]
    return {i: v for i, v in out.items() if v}


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def product(a, b):
    return int(np.floor(256 * a) @ np.floor(256 * b))


def cosine(a, b):
    return round(float(a @ b / np.sqrt(a @ a) / np.sqrt(b @ b)), 12)


@pytest.fixture
def rows():
    rng = np.random.default_rng(9)
    out = [(i, rng.normal(size=6).round(2).astype(float).tolist()) for i in range(400)]
    copies = [(1_000 + i, out[50][1]) for i in range(12)]  # ties
    hard = [(2_000, None), (2_001, []), (2_050, [1.0, None] * 3), (2_100, [float("nan")] * 6), (2_150, [float("inf")] * 6), (None, [1.0] * 6), (2_200, [1.0, 2.0]), (2_201, [2.0, 1.0])]
    return out + copies + hard


def test_pivots_are_exact(spark, rows, monkeypatch):
    monkeypatch.setattr(vectors, "SHARD_ROWS", 64)
    monkeypatch.setattr(vectors, "BLOCK_QUERIES", 4)
    rows = [*rows, (2_250, [0.0] * 6)]
    assert found(pivot_table.search(frame(spark, rows))) == brute(rows, 5, product)
    assert pivot_table.search(frame(spark, [])).count() == 0


def test_pivots_leave_rows_out():
    rng = np.random.default_rng(1)
    points = np.floor(256 * (rng.normal(size=(40, 8)) * 4)[rng.integers(0, 40, 3_000)] + rng.normal(size=(3_000, 8)))
    pivots = points[pivot_table.choose_pivots(points)]
    table, q = pivot_table._distances(points, pivots), points[0]
    lower = np.abs(pivot_table._distances(q[None], pivots) - table).max(axis=1)
    bounds = ((q @ q) + (points * points).sum(axis=1) - lower**2) / 2 + 1e-3
    names, scores, seen = pivot_table.top_k(points, np.arange(3_000), bounds, 0, q, 5)
    exact = points @ q
    order = sorted(range(1, 3_000), key=lambda j: (-exact[j], j))[:5]
    assert names.tolist() == order and scores.tolist() == [int(exact[j]) for j in order] and seen < 3_000


def test_large_integers_stay_exact():
    big = np.array([[2.0**40, 3.0], [2.0**40, 4.0], [1e200, 0.0]])
    assert pivot_table.exact_products(big, np.array([2.0**20, 5.0])).tolist() == [2**60 + 15, 2**60 + 20, 2**63 - 1]


def test_factor_one_is_exact(spark, rows, monkeypatch):
    monkeypatch.setattr(vectors, "SHARD_ROWS", 128)
    rows = [*rows, (2_250, [0.0] * 6)]
    # the table holds floats: what is expected comes from the stored values
    stored = [(r.vec_id, r.embedding) for r in frame(spark, rows).collect()]
    want = brute([r for r in stored if r[0] != 2_250], 5, cosine)
    got = found(vp_trees.search(frame(spark, rows), factor=1.0))
    assert {q: [j for j, _ in v] for q, v in got.items()} == {q: [j for j, _ in v] for q, v in want.items()}
    assert all(abs(a[1] - b[1]) < 1e-9 for q in want for a, b in zip(got[q], want[q]))
    assert vp_trees.search(frame(spark, [])).count() == 0


def test_recall(spark, data):
    data = data.replace("sf0.001", "sf0.1")
    given = duckdb.sql(f"SELECT vec_id, embedding FROM '{data}/embeddings.parquet'").fetchall()
    ids, x = np.array([i for i, _ in given]), np.array([v for _, v in given], float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    got, hits = found(queries.op8_vp_trees(spark, data)), 0
    for q in np.flatnonzero(ids % 50 == 0):
        s = x @ x[q]
        s[q] = -2
        hits += len({int(i) for i in ids[np.argsort(-s)[:5]]} & {i for i, _ in got[int(ids[q])]})
    assert hits / (5 * len(got)) >= 0.9
