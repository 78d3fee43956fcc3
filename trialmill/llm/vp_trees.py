"""Approximate nearest neighbours with vantage-point trees.

Every shard of the vectors gets a tree. An inner node holds a vantage point and splits its vectors at the median
distance from it; both children remember the range of these distances. The triangle inequality bounds the
distance from a query to anything in a child from below. A leaf is passed over when its bound exceeds `factor`
times the query's k-th distance so far: factor one gives exact results, smaller ones look at fewer leaves.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from . import vectors

#: Vectors in a leaf, and the factor of the bound.
LEAF, FACTOR = 64, 0.6


def build(points: np.ndarray, leaf: int = LEAF) -> list[tuple[np.ndarray, list[tuple[int, float, float]]]]:
    """Leaves of the tree over unit vectors: rows, and (vantage row, least, most distance) for each ancestor."""
    leaves, todo = [], [(np.arange(len(points)), [])]
    while todo:
        rows, path = todo.pop()
        if len(rows) <= leaf:
            leaves.append((rows, path))
            continue
        # of a few candidates, the one whose distances spread most
        tried = rows[:: max(1, len(rows) // 4)][:4]
        spread = [np.std(_distances(points[[v]], points[rows])[0]) for v in tried]
        vantage = int(tried[int(np.argmax(spread))])
        d = _distances(points[[vantage]], points[rows])[0]
        order = np.argsort(d, kind="stable")
        half = len(rows) // 2
        for part in (order[:half], order[half:]):
            todo.append((rows[part], [*path, (vantage, float(d[part].min()), float(d[part].max()))]))
    return leaves


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of unit vectors."""
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


def _bounds(points: np.ndarray, leaves, asked: np.ndarray) -> np.ndarray:
    """Lower bounds of the distances from each query to each leaf."""
    vantages = sorted({v for _, path in leaves for v, _, _ in path})
    at = {v: i for i, v in enumerate(vantages)}
    d = _distances(asked, points[vantages]) if vantages else None
    out = np.zeros((len(asked), len(leaves)))
    for j, (_, path) in enumerate(leaves):
        for v, least, most in path:
            np.maximum(out[:, j], np.maximum(least - d[:, at[v]], d[:, at[v]] - most), out=out[:, j])
    return out


def look_up(points: np.ndarray, ids: np.ndarray, leaves, query_ids: np.ndarray, asked: np.ndarray, k: int, factor: float):
    """Rows of the leaves that may hold one of a query's k nearest: for each query its candidates' rows."""
    n = len(asked)
    bounds = _bounds(points, leaves, asked)
    order = np.argsort(bounds, axis=1, kind="stable")
    best = np.full((n, k), np.inf)  # distances so far
    kept = np.full((n, k), -1)
    active = np.arange(n)
    for step in range(len(leaves)):
        leaf_of = order[active, step]
        near = bounds[active, leaf_of] <= factor * best[active, -1] + 1e-9
        active, leaf_of = active[near], leaf_of[near]
        if not len(active):
            break
        for leaf in np.unique(leaf_of):
            mine, rows = active[leaf_of == leaf], leaves[leaf][0]
            d = _distances(asked[mine], points[rows])
            d[query_ids[mine][:, None] == ids[rows][None, :]] = np.inf
            both = np.concatenate([best[mine], d], axis=1)
            who = np.concatenate([kept[mine], np.broadcast_to(rows, d.shape)], axis=1)
            # nearest first, ties to the smaller id
            named = np.where(who >= 0, ids[who], np.iinfo(np.int64).max)
            pick = np.lexsort((named, np.round(both, 12)), axis=1)[:, :k]
            best[mine] = np.take_along_axis(both, pick, 1)
            kept[mine] = np.where(np.isfinite(best[mine]), np.take_along_axis(who, pick, 1), -1)
    return kept


def search(rows: DataFrame, every: int = 50, k: int = 5, factor: float = FACTOR, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """The k nearest by cosine of each row whose id `every` divides: query_id, rank, vec_id, score.

    A query's own row is no candidate; ties go to the smaller id; with fewer candidates all are returned. Scores
    are cosines of the original vectors in double precision. Vectors that are null, empty or zero, or that hold
    null or non-finite components, take no part; a null id takes no part. Repeated rows are candidates of their
    own. Extra columns are ignored; an empty table gives no rows. See `vectors.search` for how work is dealt.
    """

    def index(there: pd.DataFrame) -> dict:
        original = vectors.matrix(there.v)
        # scaled by the largest component first, so that squares neither overflow nor vanish
        original = original / np.abs(original).max(axis=1, keepdims=True)
        norms = np.sqrt((original * original).sum(axis=1))
        points = original / norms[:, None]
        return {"ids": there.id.to_numpy(), "original": original, "norms": norms, "points": points, "leaves": build(points)}

    def look(made: dict, query_ids: np.ndarray, asked: np.ndarray, k: int) -> dict:
        asked = asked / np.abs(asked).max(axis=1, keepdims=True)
        norms = np.sqrt((asked * asked).sum(axis=1))
        kept = look_up(made["points"], made["ids"], made["leaves"], query_ids, asked / norms[:, None], k, factor)
        q, at = np.nonzero(kept >= 0)
        found = kept[q, at]
        # row by row, so that equal vectors get equal scores
        dots = (asked[q] * made["original"][found]).sum(axis=1)
        return {"query_id": query_ids[q], "vec_id": made["ids"][found], "score": dots / (norms[q] * made["norms"][found])}

    usable = vectors.usable(rows, vec_id, embedding)
    some = usable.where("exists(v, x -> x != 0)")
    return vectors.search(some, every, k, index, look, "double")
