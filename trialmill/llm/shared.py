"""What the operators of this package have in common: Arrow batches, stored stages, connected components."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import new_path

#: Rows that a Python worker turns into Python objects at a time.
SLICE_ROWS = 512


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most `rows` rows, so that a worker holds few texts at a time.

    After the last one the worker, which waits for its next task beside others, hands back the memory it has freed.
    """
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
    batch = None
    give_back()


def give_back() -> None:
    """Memory that this process has freed but kept goes back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


_held: list[tuple[Any, Any]] = []


def held(key: Any, make: Callable[[], Any]) -> Any:
    """What `make` builds, kept in this worker until something else is asked for.

    A worker serves many tasks of a stage and may serve later stages too: it keeps one such object at most.
    """
    if not _held or _held[0][0] != key:
        let_go()
        _held.append((key, make()))
    return _held[0][1]


def let_go() -> None:
    """Drop what the worker keeps for an earlier operator; tasks that hold nothing themselves begin with it."""
    if _held:
        _held.clear()
        give_back()


def with_column(df: DataFrame, source: str, into: str, kind: T.DataType, turn: Callable[[pa.Array], pa.Array], rows: int = 256) -> DataFrame:
    """`df` with `into`, made in Python from `source`, a slice at a time; a column of that name is replaced."""
    keep = [c for c in df.columns if c != into]
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(into, kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, rows):
            names = part.schema.names
            columns = [part.column(names.index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*columns, turn(part.column(names.index(source)))], [*keep, into])

    return df.mapInArrow(run, schema)


def packed_lists(rows: list[bytes]) -> pa.Array:
    """Rows of packed 32-bit integers as an Arrow list column."""
    ends = np.cumsum([0, *map(len, rows)]) // 4
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(rows), np.int32)))


def table(spark, sf_dir: str, name: str) -> DataFrame:
    """A given table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage(df: DataFrame, label: str = "stage") -> DataFrame:
    """The rows as a table written below the shared folder and read again.

    It cuts the lineage, so a lost executor costs no earlier work, takes less room than a checkpoint of rows and
    gives the planner true sizes.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _smallest(pairs: DataFrame) -> DataFrame:
    """Each node `u` with the smallest of itself and its neighbours `v`."""
    return pairs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the edges (`a`, `b` long): each node with the smallest node it reaches.

    Alternating rounds of large and small stars: every round hangs neighbours to a smaller node. Rounds end
    when the edges form stars; each is written, so a lost executor costs no earlier round. Minima are
    combined before the shuffle, so a node with very many neighbours is no hot key. Returns `node` and
    `component`; nodes without an edge to another node are left out.
    """
    now = (
        edges.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    now = stage(now)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (
            both.join(_smallest(both), "u")
            .where(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .distinct()
        )
        joined = large.join(_smallest(large), "u")
        small = joined.select(
            F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")
        ).select("e.u", "e.v")
        after = stage(small.where(F.col("u") != F.col("v")).distinct())
        # stars: every node hangs to one node, and that node hangs to none
        several = after.groupBy("u").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
        chained = after.join(after.select(F.col("u").alias("v")), "v", "left_semi")
        now = after
        if several.select("u").unionByName(chained.select("u")).isEmpty():
            break
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def bit_words(rows: DataFrame, column: str, bits: int) -> DataFrame:
    """A filter of fixed size: words of 64 bits (`word`, `bits`) with the bit of each value set."""
    place = F.pmod(F.xxhash64(column), F.lit(bits))
    ones = F.expr("bit_or(shiftleft(1L, CAST(place % 64 AS INT)))")
    return rows.select(place.alias("place")).groupBy(F.shiftright("place", 6).alias("word")).agg(ones.alias("bits"))


def maybe_in(rows: DataFrame, column: str, words: DataFrame, bits: int) -> DataFrame:
    """Rows whose value may be among those of a filter; a filter that is full lets all rows through.

    The filter has at most bits / 64 rows, whatever the data, so it is broadcast.
    """
    place = F.pmod(F.xxhash64(column), F.lit(bits))
    found = rows.withColumn("_place", place).join(F.broadcast(words), F.shiftright("_place", 6) == F.col("word"))
    hit = F.expr("shiftright(bits, CAST(_place % 64 AS INT)) & 1 = 1")
    return found.where(hit).select(*rows.columns)
