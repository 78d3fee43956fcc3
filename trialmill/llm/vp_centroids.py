"""Centroid clustering of integer vectors with a vantage-point tree over the centroids.

Each round builds a tree over the centroids and broadcasts it. A node holds one centroid, the vantage point; the
others go to a near and a far child, for which the least and the largest distance to the vantage point are kept.
By the triangle inequality a vector whose distance to the vantage point is t is at least t - largest and least - t
away from all centroids of a child. Each vector opens its nodes in the order of these bounds, until the next bound
is above the distance of the best centroid found; a bound equal to it is still opened, so that ties are seen.
Distances are sums of squares of integers and exact; only the bounds are floating point, and are widened by more
than rounding can amount to.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import slices, stage

#: Centroids of a leaf, and vectors that a worker looks up at a time.
LEAF, TOGETHER = 3, 2_048
#: Components up to this size have distances below 2^63 with up to 64 components; others are computed as Python's.
SMALL = 2**27
#: Larger components count as this: their distances exceed 64 bits in any case.
LARGEST = 2**50
#: The widening of the bounds, relative to the distances they come from.
SLACK = 1e-9


@dataclass
class Node:
    """A vantage point, or the centroids of a leaf; children with their least and largest distance to the point."""

    members: list[int]
    children: list[tuple[int, float, float]]


def distances(points: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Squared distances between rows and one point, exact."""
    return ((points - to) ** 2).sum(axis=1)


def build(centroids: np.ndarray) -> list[Node]:
    """The nodes of the tree, the root first."""
    nodes: list[Node] = []

    def grow(members: list[int]) -> int:
        at = len(nodes)
        nodes.append(Node(members, []))
        if len(members) <= LEAF:
            return at
        # the vantage point is the member farthest from the first, so that distances to it differ
        far = distances(centroids[members], centroids[members[0]])
        point = members[max(range(len(members)), key=lambda i: far[i])]
        rest = [m for m in members if m != point]
        away = np.sqrt(distances(centroids[rest], centroids[point]).astype(float))
        order = np.argsort(away, kind="stable")
        half = len(rest) // 2
        nodes[at].members = [point]
        for part in (order[:half], order[half:]):
            if len(part):
                child = grow(sorted(rest[i] for i in part))
                nodes[at].children.append((child, float(away[part].min()), float(away[part].max())))
        return at

    if len(centroids):
        grow(list(range(len(centroids))))
    return nodes


def nearest(points: np.ndarray, centroids: np.ndarray, nodes: list[Node]) -> tuple[np.ndarray, np.ndarray, int]:
    """Number of and squared distance to the nearest centroid of each row, ties to the smaller number; distances computed."""
    n = len(points)
    bound = np.full((n, len(nodes)), np.inf)
    bound[:, 0] = 0.0
    number = np.full(n, len(centroids))
    best = np.full(n, np.iinfo(np.int64).max).astype(points.dtype)
    reach = np.full(n, np.inf)
    rows, computed = np.arange(n), 0
    while len(rows):
        turn = bound[rows].argmin(axis=1)
        low = bound[rows, turn]
        going = np.isfinite(low) & (low <= reach[rows])
        rows, turn = rows[going], turn[going]
        for at in np.unique(turn):
            here, node = rows[turn == at], nodes[at]
            opened = bound[here, at]
            bound[here, at] = np.inf
            for m in node.members:
                squared = distances(points[here], centroids[m])
                computed += len(here)
                better = (number[here] == len(centroids)) | (squared < best[here]) | ((squared == best[here]) & (m < number[here]))
                best[here[better]], number[here[better]] = squared[better], m
            away = np.sqrt(squared.astype(float))
            close = np.sqrt(best[here].astype(float))
            reach[here] = close + SLACK * (1 + close)
            for child, least, largest in node.children:
                slack = SLACK * (1 + away + largest)
                bound[here, child] = np.maximum(opened, np.maximum(away - largest, least - away) - slack)
    return number, best, computed


def integers(x: Column) -> Column:
    """floor(256 * x), cut to ±LARGEST."""
    scaled = F.least(F.greatest(256 * x.cast("double"), F.lit(float(-LARGEST))), F.lit(float(LARGEST)))
    return F.floor(scaled).cast("long")


def usable(rows: DataFrame, size: int, vec_id: str, embedding: str) -> DataFrame:
    """vec_id and v, as integers, of the vectors with `size` components, none null or non-finite."""
    v = F.col(f"`{embedding}`").cast("array<double>")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    found = rows.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), v.alias("v"))
    kept = found.where(F.col("v").isNotNull() & (F.size("v") == size) & F.forall("v", finite))
    return kept.select("vec_id", F.transform("v", integers).alias("v"))


def _matrix(column: pa.ListArray, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def _typed(points: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit integers where squared distances fit them, else Python's."""
    largest = max(np.abs(points).max(initial=0), np.abs(centroids).max(initial=0))
    return (points, centroids) if largest <= SMALL and points.shape[1] <= 64 else (points.astype(object), centroids.astype(object))


class _Assign:
    """Rows of a partition with their nearest centroid, a slice at a time."""

    def __init__(self, rows: DataFrame, centroids: np.ndarray):
        self.size = centroids.shape[1]
        self.shared = rows.sparkSession.sparkContext.broadcast((centroids, build(centroids)))

    def found(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
        centroids, nodes = self.shared.value
        for part in slices(batches, TOGETHER):
            points, there = _typed(_matrix(part.column(part.schema.names.index("v")), self.size), centroids)
            number, squared, _ = nearest(points, there, nodes)
            yield part, points, number, squared


class _Sums(_Assign):
    """Count and sums of components per cluster of a partition."""

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for _, points, number, _ in self.found(batches):
            for c in np.unique(number):
                mine = points[number == c]
                # slices are short enough for sums in 64 bits
                before = sums.setdefault(int(c), [0, np.zeros(self.size, object)])
                before[0] += len(mine)
                before[1] = before[1] + mine.sum(axis=0).astype(object)
        kept = sorted(sums.items())
        flat = [int(x) for _, (_, total) in kept for x in total]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([c for c, _ in kept for _ in range(self.size)], pa.int32()),
                pa.array([p for _ in kept for p in range(self.size)], pa.int32()),
                pa.array([n for _, (n, _) in kept for _ in range(self.size)], pa.int64()),
                pa.array(flat, pa.decimal128(38, 0)),
            ],
            ["cluster", "place", "n", "total"],
        )


class _Numbers(_Assign):
    """Each row's cluster and squared distance."""

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, number, squared in self.found(batches):
            cut = np.array([min(int(d), 2**63 - 1) for d in squared], np.int64)
            yield pa.RecordBatch.from_arrays(
                [part.column(part.schema.names.index("vec_id")), pa.array(number, pa.int32()), pa.array(cut)], ["vec_id", "cluster", "distance"]
            )


def starts(kept: DataFrame, k: int, seed: str) -> np.ndarray:
    """The vectors whose `seed:id` has the smallest digests, in their order."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = kept.where(F.col("vec_id").isNotNull()).select(digest.alias("digest"), "v").orderBy("digest", "v").limit(k).collect()
    return np.array([r.v for r in first], np.int64)


def cluster(
    rows: DataFrame, k: int = 40, rounds: int = 5, size: int = 64, seed: str = "2", vec_id: str = "vec_id", embedding: str = "embedding"
) -> DataFrame:
    """Per vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Vectors with exactly `size` components, none null or non-finite, take part, each component x as floor(256 * x);
    others have no row. The k vectors whose `seed:id` has the smallest SHA-256 are the first centroids (of equal
    ids, the smaller vectors; with fewer vectors, all); a null id starts none, and if no vector has an id there is
    no row. A round assigns each vector to the nearest centroid, ties to the smaller number, and replaces each
    centroid that has vectors by floor(sum / count); sums and distances are exact. Repeated rows count as often as
    they occur. Components beyond 2^50 count as that; distances and their sums end at the largest long. Extra
    columns are ignored; an empty table gives no rows.

    The driver holds k centroids. Sums are combined per partition before they are shuffled, so k * size rows a
    task leave a round and no cluster is a hot group. Vectors are stored once and read by every round.
    """
    kept = stage(usable(rows, size, vec_id, embedding), "vectors")
    centroids = starts(kept, k, seed)
    if not len(centroids):
        empty = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        return rows.sparkSession.createDataFrame([], empty)
    for _ in range(rounds):
        sums = kept.mapInArrow(_Sums(kept, centroids), "cluster int, place int, n long, total decimal(38,0)")
        for r in sums.groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():
            centroids[r.cluster, r.place] = int(r.total) // r.n
    found = stage(kept.mapInArrow(_Numbers(kept, centroids), "vec_id long, cluster int, distance long"), "clusters")
    exact = F.sum(F.col("distance").cast("decimal(38,0)"))
    cut = lambda c: F.least(c, F.lit(2**63 - 1)).cast("long")
    per_cluster = found.groupBy("cluster").agg(exact.alias("cluster_inertia"))
    whole = found.agg(exact.alias("inertia"))
    told = [(c, hashlib.sha256(",".join(map(str, v.tolist())).encode()).hexdigest()) for c, v in enumerate(centroids)]
    digests = rows.sparkSession.createDataFrame(told, "cluster int, centroid_sha256 string")
    # k rows at most
    facts = F.broadcast(per_cluster.join(digests, "cluster").crossJoin(whole))
    return found.join(facts, "cluster").select(
        "vec_id", "cluster", "distance", cut(F.col("cluster_inertia")).alias("cluster_inertia"), cut(F.col("inertia")).alias("inertia"), "centroid_sha256"
    )


def reference_sql(table: str = "embeddings", k: int = 40, rounds: int = 5, size: int = 64, seed: str = "2") -> str:
    """The same in SQL: every vector against every centroid, round by round."""
    assign = (
        "SELECT vec_id, r, v, cluster, distance FROM (SELECT x.vec_id, x.r, x.v, c.cluster, CAST(list_sum(list_transform("
        "list_zip(x.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS distance FROM kept x, c{n} c) "
        "QUALIFY row_number() OVER (PARTITION BY r ORDER BY distance, cluster) = 1"
    )
    steps = [
        "kept AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) "
        f"AS BIGINT)) AS v FROM {table} WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {size})",
        f"c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), v) - 1 AS INTEGER) AS cluster, v FROM kept "
        f"WHERE vec_id IS NOT NULL ORDER BY sha256('{seed}:' || vec_id), v LIMIT {k})",
    ]
    for n in range(rounds):
        steps.append(f"a{n} AS MATERIALIZED ({assign.format(n=n)})")
        steps.append(
            f"m{n} AS (SELECT cluster, list(m ORDER BY place) AS v FROM (SELECT cluster, place, CAST(floor_div AS BIGINT) AS m FROM ("
            f"SELECT cluster, place, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS floor_div FROM ("
            f"SELECT cluster, unnest(v) AS x, unnest(range({size})) AS place FROM a{n}) GROUP BY cluster, place)) GROUP BY cluster)"
        )
        steps.append(f"c{n + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(m.v, c.v) AS v FROM c{n} c LEFT JOIN m{n} m USING (cluster))")
    steps.append(f"last AS MATERIALIZED ({assign.format(n=rounds)})")
    return (
        f"WITH {', '.join(steps)} SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, "
        "CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256 "
        f"FROM last JOIN c{rounds} c USING (cluster)"
    )
