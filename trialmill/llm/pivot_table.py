"""Exact top-k by inner product with a pivot table.

A shard keeps the distances from all of its vectors to a few pivots. For a query, the largest difference between
its own distance to a pivot and a vector's is a lower bound of their distance, and so an upper bound of their
inner product: (|q|^2 + |x|^2 - bound^2) / 2. Vectors are evaluated in the order of their bounds until the next
bound is below the k-th score found; the rest can't be among the k best.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from . import vectors

#: Pivots per shard; vectors that are evaluated at first, doubling from step to step; queries at a time.
PIVOTS, FIRST, TOGETHER = 24, 64, 256


def integers(v: np.ndarray) -> np.ndarray:
    """floor(256 * x) of every component, as doubles that hold integers."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(256 * v), -1.7e308, 1.7e308)


def choose_pivots(points: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """Rows that lie far from each other: each is the farthest from those before it."""
    rows = [int(np.argmax((points * points).sum(axis=1)))]
    nearest = np.sqrt(((points - points[rows[0]]) ** 2).sum(axis=1))
    while len(rows) < min(n, len(points)):
        rows.append(int(np.argmax(nearest)))
        nearest = np.minimum(nearest, np.sqrt(((points - points[rows[-1]]) ** 2).sum(axis=1)))
    return np.array(rows)


def exact_products(points: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Integer inner products of a query with rows; beyond 64 bits cut to their range."""
    largest = np.abs(points).max(initial=0.0) * np.abs(query).max(initial=0.0) * len(query)
    if largest < 2**53:
        return (points @ query).astype(np.int64)
    low, high = -(2**63), 2**63 - 1
    ints = [int(x) for x in query]
    return np.array([min(high, max(low, sum(int(a) * b for a, b in zip(row, ints)))) for row in points], np.int64)


def top_k(points: np.ndarray, ids: np.ndarray, bounds: np.ndarray, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Ids and scores of the k best, ties to the smaller id, and how many rows were evaluated."""
    order = np.argsort(-bounds, kind="stable")
    order = order[ids[order] != query_id]
    names, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
    at, step = 0, FIRST
    while at < len(order):
        rows = order[at : at + step]
        names = np.concatenate([names, ids[rows]])
        scores = np.concatenate([scores, exact_products(points[rows], query)])
        # ~x is -x - 1, which has no overflow
        pick = np.lexsort((names, ~scores))[:k]
        names, scores = names[pick], scores[pick]
        at, step = at + len(rows), step * 2
        if at < len(order) and len(scores) == k and bounds[order[at]] < scores[-1]:
            break
    return names, scores, at


def search(rows: DataFrame, every: int = 50, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """The k highest integer inner products of each row whose id `every` divides: query_id, rank, vec_id, score.

    Components x count as floor(256 * x). A query's own row is no candidate; ties go to the smaller id; with
    fewer candidates all are returned. Vectors that are null or empty or hold null or non-finite components take
    no part, nor does a null id; zero vectors do. Repeated rows are candidates of their own. Scores beyond 64
    bits are cut to their range. Extra columns are ignored; an empty table gives no rows. See `vectors.search`
    for how work is dealt.
    """

    def index(there: pd.DataFrame) -> dict:
        points = integers(vectors.matrix(there.v))
        # bounds are about a scaled copy, whose squares don't overflow
        scale = max(1.0, float(np.abs(points).max(initial=0.0)))
        scaled = points / scale
        pivots = scaled[choose_pivots(scaled)]
        table = _distances(scaled, pivots)
        return {"ids": there.id.to_numpy(), "points": points, "scale": scale, "pivots": pivots, "table": table, "squares": (scaled * scaled).sum(axis=1)}

    def look(made: dict, query_ids: np.ndarray, asked: np.ndarray, k: int) -> dict:
        asked = integers(asked)
        out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        for start in range(0, len(asked), TOGETHER):
            part = slice(start, start + TOGETHER)
            scaled = asked[part] / made["scale"]
            to_pivots = _distances(scaled, made["pivots"])
            lower = np.zeros((len(scaled), len(made["points"])))
            for p in range(len(made["pivots"])):
                np.maximum(lower, np.abs(to_pivots[:, p, None] - made["table"][None, :, p]), out=lower)
            squares = (scaled * scaled).sum(axis=1)
            total = squares[:, None] + made["squares"][None, :]
            # what rounding may take off the bounds goes on top
            slack = 1e-9 * (total + 1) * made["scale"] ** 2
            bounds = (total - lower * lower) / 2 * made["scale"] ** 2 + slack
            for i in range(len(scaled)):
                q = start + i
                bound = bounds[i] if np.isfinite(bounds[i]).all() else np.full(len(bounds[i]), np.inf)
                names, scores, _ = top_k(made["points"], made["ids"], bound, query_ids[q], asked[q], k)
                out["query_id"].append(np.full(len(names), query_ids[q]))
                out["vec_id"].append(names)
                out["score"].append(scores)
        return {c: np.concatenate(v) for c, v in out.items()}

    return vectors.search(vectors.usable(rows, vec_id, embedding), every, k, index, look, "long")


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances between rows, computed from differences."""
    return np.stack([np.sqrt(((a - x) ** 2).sum(axis=1)) for x in b], axis=1) if len(b) else np.zeros((len(a), 0))
