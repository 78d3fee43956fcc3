"""Vectors in shards and queries in blocks: what both searches share."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors per shard and queries per block, which bound what a task holds.
SHARD_ROWS, BLOCK_QUERIES = 8_192, 4_096


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """id, v and dim of the vectors that are not null, not empty and have finite components only."""
    v = F.col(f"`{embedding}`").cast("array<double>")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("id"), v.alias("v"))
    return rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", finite)).withColumn("dim", F.size("v"))


def matrix(column: pd.Series) -> np.ndarray:
    """Lists of equal length as rows."""
    return np.stack([np.asarray(v, float) for v in column]) if len(column) else np.zeros((0, 0))


def search(rows: DataFrame, every: int, k: int, build: Callable[[pd.DataFrame], dict], look: Callable, score_type: str) -> DataFrame:
    """The k best of each query over all shards: query_id, rank, vec_id, score.

    Rows (id, v, dim) are dealt to shards by a hash of their id. Queries are the rows whose id `every` divides,
    in blocks. A task gets one shard and one block, both of bounded size, builds the index of the shard and looks
    the block up. The k best of each shard meet per query; only k rows per query and shard are shuffled. Vectors
    are compared with those of their own dimension. Rows with equal ids are candidates of their own, except for
    the query with that id, which is asked once (with the smallest of their vectors).
    """
    rows = rows.withColumn("dim", F.size("v"))
    n = rows.count()
    shards, blocks = max(1, -(-n // SHARD_ROWS)), max(1, -(-n // every // BLOCK_QUERIES))
    # each shard meets every block: queries are repeated once per shard, shards once per block
    candidates = rows.select(
        "dim", F.pmod(F.xxhash64("id"), F.lit(shards)).alias("shard"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), "id", "v", F.lit(False).alias("asks"),
    )
    asking = rows.where(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v"))
    queries = asking.select(
        F.size("v").alias("dim"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"),
        F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).alias("block"), "id", "v", F.lit(True).alias("asks"),
    )

    def task(group: pd.DataFrame) -> pd.DataFrame:
        asked, there = group[group.asks].sort_values("id"), group[~group.asks].sort_values("id")
        empty = {"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)}
        if not len(asked) or not len(there):
            return pd.DataFrame(empty)
        return pd.DataFrame(look(build(there), asked.id.to_numpy(), matrix(asked.v), k))

    found = candidates.unionByName(queries).groupBy("dim", "shard", "block").applyInPandas(task, f"query_id long, vec_id long, score {score_type}")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
