"""Fixations and saccades by dispersion in recordings of any length.

The scan is greedy: where a stretch may begin depends on where the last one ended. But from a given sample the next
place to look at is fixed, whatever came before, so every sample has a pointer to it. A recording is cut into chunks
of equal numbers of samples, and the scan becomes

1. per chunk: how far a narrow stretch reaches from every sample. What reaches the end of the chunk is left open,
   told by the extent of its samples; the other way round, the extents of the chunk's beginnings are told.
2. per recording, on these few extents: how far the open stretches reach, and where a scan may enter a chunk.
3. per chunk: the pointers, composed by doubling, take each entry to the place where the scan leaves the chunk.
4. per recording, one row per entry: the entries that the scan from the first sample does take.
5. per chunk: the stretches from the entry that is taken; parts of a stretch in several chunks are added up.

Stretches that lie near each other join as long as no blink parts them, so they are gone through by the blinks before
them. Only the rows of steps 2 and 4 are gathered by recording: a few extents and entries per chunk.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import reliable_checkpoint
from .ordered import Lead, RowNumber, RunningSum, with_ordered

#: Samples in a chunk.
CHUNK_SAMPLES = 65_536

Box = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _joined(a: Box, b: Box) -> Box:
    """The extents of two stretches together: lowest and highest x, lowest and highest y."""
    return np.minimum(a[0], b[0]), np.maximum(a[1], b[1]), np.minimum(a[2], b[2]), np.maximum(a[3], b[3])


def _is_narrow(box: Box, widest: float) -> np.ndarray:
    return (box[1] - box[0]) + (box[3] - box[2]) < widest


def _at(box: Box, index) -> Box:
    return box[0][index], box[1][index], box[2][index], box[3][index]


def _samples(table: pa.Table) -> tuple[pa.Table, Box]:
    """The samples of a chunk in order, with their extents; a blink is wider than any limit."""
    table = table.sort_by("_i")
    x, y = (np.nan_to_num(table.column(c).to_numpy().astype(float)) for c in ("x", "y"))
    blink = table.column("blink").to_numpy().astype(bool)
    return table, (x, np.where(blink, np.inf, x), y, y)


def reach(box: Box, widest: float) -> np.ndarray:
    """For each sample the first one that a narrow stretch from it can't hold; the number of samples if none."""
    n = len(box[0])
    # extents of all stretches of 1, 2, 4, ... samples, as long as some are narrow
    levels = [box]
    while (width := 1 << (len(levels) - 1)) * 2 <= n and _is_narrow(levels[-1], widest).any():
        levels.append(_joined(_at(levels[-1], slice(None, -width)), _at(levels[-1], slice(width, None))))
    ends = np.arange(n)
    so_far: Box = (np.full(n, np.inf), np.full(n, -np.inf), np.full(n, np.inf), np.full(n, -np.inf))
    for k in reversed(range(len(levels))):
        fits = np.flatnonzero(ends + (1 << k) <= n)
        longer = _joined(_at(so_far, fits), _at(levels[k], ends[fits]))
        narrow = _is_narrow(longer, widest)
        taken = fits[narrow]
        for held, new in zip(so_far, longer):
            held[taken] = new[narrow]
        ends[taken] += 1 << k
    return ends


def _changes(box: Box) -> np.ndarray:
    """Where the extents differ from those before, the first place included."""
    differs = reduce(np.logical_or, [b[1:] != b[:-1] for b in box])
    return np.flatnonzero(np.concatenate([[True], differs]))


def _running(box: Box) -> Box:
    return (
        np.minimum.accumulate(box[0]),
        np.maximum.accumulate(box[1]),
        np.minimum.accumulate(box[2]),
        np.maximum.accumulate(box[3]),
    )


def extents(box: Box, start: int, widest: float) -> dict[str, list]:
    """What other chunks need: extents of the chunk's beginnings, and of the ends from which a stretch is open."""
    n, ends = len(box[0]), reach(box, widest)
    # beginnings up to the first that is too wide
    heads = _running(_at(box, slice(0, int(ends[0]) + 1)))
    at = _changes(heads)
    told = {"head_at": at + start} | {f"head_{k}": b[at] for k, b in enumerate(heads)}
    first = int(np.searchsorted(ends, n))
    tails = _at(_running(_at(_at(box, slice(first, None)), slice(None, None, -1))), slice(None, None, -1))
    froms = _changes(tails) if first < n else np.zeros(0, int)
    told |= {"tail_from": froms + first + start} | {f"tail_{k}": b[froms] for k, b in enumerate(tails)}
    return {name: values.tolist() for name, values in told.items()}


def resolve(chunks: list[dict], n: int, shortest: int, widest: float, size: int) -> list[dict]:
    """The reach of open stretches (of each `tail_from` up to the next), and the entries of every chunk."""
    heads = [(np.array(c["head_at"]), tuple(np.array(c[f"head_{k}"]) for k in range(4))) for c in chunks]
    entries: list[set[int]] = [{k * size} for k in range(len(chunks))]
    out = []
    for k, chunk in enumerate(chunks):
        ends = []
        for g, begin in enumerate(chunk["tail_from"]):
            box, end = tuple(np.float64(chunk[f"tail_{j}"][g]) for j in range(4)), n
            for at, head in heads[k + 1 :]:
                together = _joined(box, head)
                wide = ~_is_narrow(together, widest)
                if wide.any():
                    end = int(at[np.argmax(wide)])
                    break
                box = _at(together, -1)
            ends.append(end)
            if end >= begin + shortest < n - 1:
                landing = min(end, n - 2)
                entries[landing // size].add(landing)
        out.append({"_chunk": chunk["_chunk"], "tail_from": chunk["tail_from"], "tail_end": ends})
    return [row | {"entries": sorted(e)} for row, e in zip(out, entries)]


def pointers(box: Box, start: int, known: dict, n: int, shortest: int, widest: float) -> tuple[np.ndarray, np.ndarray]:
    """For each sample of a chunk the next one to look at (`n` ends the scan), and whether a stretch lies between."""
    m = len(box[0])
    ends = reach(box, widest) + start
    froms, tail_ends = np.array(known["tail_from"], dtype=int), np.array(known["tail_end"], dtype=int)
    if len(froms):
        first = int(froms[0]) - start
        group = np.searchsorted(froms, np.arange(first, m) + start, side="right") - 1
        ends[first:] = tail_ends[group]
    i = np.arange(m) + start
    over = i + shortest - 1 >= n - 2
    still = ~over & (ends >= i + shortest)
    return np.where(over, n, np.where(still, np.minimum(ends, n - 2), i + 1)), still


def leave(to: np.ndarray, start: int) -> np.ndarray:
    """The last sample of the chunk that a scan from each sample looks at, by doubling the pointers."""
    m = len(to)
    last = np.where(to < start + m, to - start, np.arange(m))
    while not np.array_equal(further := last[last], last):
        last = further
    return last


def taken(rows: list[dict], n: int, size: int, chunks: int) -> list[dict]:
    """The entry of each chunk in the scan from the first sample, and the stretch, if any, that covers what is before."""
    exits = {r["entry"]: r for r in rows}
    out, at, origin = [], 0, None
    for chunk in range(chunks):
        out.append({"_chunk": chunk, "entry": at, "origin": origin})
        if at < min((chunk + 1) * size, n):
            leaving = exits[at]
            at, origin = leaving["leave"], leaving["last"] if leaving["still"] else None
    return out


def parts(table: pa.Table, box: Box, to: np.ndarray, still: np.ndarray, start: int, entry: int, origin: int | None) -> list[tuple]:
    """Stretches of a chunk, or what of them lies in it: begin, last, samples, sums of x and y, first and last time, blinks."""
    m = len(to)
    spans = [(origin, 0, min(entry - start, m))] if origin is not None else []
    follow, kept, i = to.tolist(), still.tolist(), entry - start
    while i < m:
        if kept[i]:
            spans.append((i + start, i, min(follow[i] - start, m)))
        i = follow[i] - start
    time, shut = (table.column(c).to_numpy() for c in ("_time", "_shut"))
    return [
        (a, b - 1 + start, b - i, float(box[0][i:b].sum()), float(box[2][i:b].sum()), float(time[i]), float(time[b - 1]), int(shut[i]))
        for a, i, b in spans
        if b > i
    ]


def join_near(stretches: list[dict], amplitude: float) -> list[dict]:
    """Stretches without a blink between them, in order: one joins the last if it lies nearer than the amplitude."""
    out: list[dict] = []
    for now in stretches:
        if out and np.hypot(now["fx"] - out[-1]["fx"], now["fy"] - out[-1]["fy"]) < amplitude:
            prior = out[-1]
            weights = np.array([prior["b"] - prior["a"], now["b"] - now["a"]], dtype=float)
            mean = lambda c: float(np.dot([prior[c], now[c]], weights) / weights.sum())
            out[-1] = prior | {"b": now["b"], "u": now["u"], "fx": mean("fx"), "fy": mean("fy")}
        else:
            out.append(now)
    return [row | {"fx": round(row["fx"], 2), "fy": round(row["fy"], 2)} for row in out]


def detect_dispersion_recordings(
    samples: DataFrame,
    amplitude: float,
    min_ms: float = 80.0,
    max_disp: float = 50.0,
    keys: Sequence[str] = ("recording",),
    time: str = "time",
    chunk_samples: int = CHUNK_SAMPLES,
    task_rows: int | None = None,
) -> DataFrame:
    """Fixations and saccades by dispersion, as `gaze.detect_dispersion` finds them, with each recording in chunks.

    A missing position counts as zero, a missing blink as none. Recordings of one sample, or whose samples all have
    the same time, have no rate and give nothing. Results don't depend on `chunk_samples`, but for the last bits of
    means before they are rounded. `task_rows` is the limit above which groups are cut to number their samples.
    """
    keys = list(keys)
    key_fields = [samples.schema[k] for k in keys]
    size = chunk_samples

    def schema(fields: str) -> T.StructType:
        return T.StructType(key_fields + T.StructType.fromDDL(fields).fields)

    def rows_of(key: tuple, rows: list[dict], kind: T.StructType) -> pa.Table:
        own = {k: v.as_py() for k, v in zip(keys, key)}
        return pa.Table.from_pylist([own | r for r in rows], schema=to_arrow_schema(kind))

    blinks = F.coalesce(F.col("blink"), F.lit(False))
    placed = samples.select(
        *keys,
        F.col(time).cast("double").alias("_time"),
        F.coalesce(F.col("x").cast("double"), F.lit(0.0)).alias("x"),
        F.coalesce(F.col("y").cast("double"), F.lit(0.0)).alias("y"),
        blinks.alias("blink"),
    )
    specs = {"_n": RowNumber(), "_shut": RunningSum(F.col("blink").cast("int"))}
    numbered = with_ordered(placed, keys, ["_time"], specs, task_rows)
    numbered = numbered.withColumn("_i", F.col("_n") - 1).withColumn("_chunk", F.floor(F.col("_i") / size)).drop("_n")
    numbered = reliable_checkpoint(numbered)

    rate = 1000.0 / F.nullif((F.max("_time") - F.min("_time")) / F.nullif(F.count("*") - 1, F.lit(0)), F.lit(0.0))
    shortest = F.greatest(F.rint(F.lit(min_ms / 1000.0) * rate).cast("long"), F.lit(1).cast("long"))
    totals = numbered.groupBy(*keys).agg(F.count("*").alias("n"), F.when(rate.isNotNull(), shortest).alias("shortest"))
    totals = totals.where("shortest IS NOT NULL").select(*[F.col(k).alias(f"_of_{k}") for k in keys], "n", "shortest")

    def with_totals(rows: DataFrame) -> DataFrame:
        same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys])
        return rows.join(totals, same).drop(*[f"_of_{k}" for k in keys])

    boxes = "{0}_0 array<double>, {0}_1 array<double>, {0}_2 array<double>, {0}_3 array<double>"
    told = schema(f"_chunk long, head_at array<long>, {boxes.format('head')}, tail_from array<long>, {boxes.format('tail')}")

    def tell(key: tuple, table: pa.Table) -> pa.Table:
        table, box = _samples(table)
        chunk = key[-1].as_py()
        return rows_of(key, [{"_chunk": chunk, **extents(box, chunk * size, max_disp)}], told)

    chunk_fields = "_chunk long, tail_from array<long>, tail_end array<long>, n long, shortest long"
    resolved = schema(f"{chunk_fields}, entries array<long>")

    def settle(key: tuple, table: pa.Table) -> pa.Table:
        chunks = sorted(table.to_pylist(), key=lambda r: r["_chunk"])
        total = {c: chunks[0][c] for c in ("n", "shortest")}
        return rows_of(key, [r | total for r in resolve(chunks, *total.values(), max_disp, size)], resolved)

    summary = numbered.groupBy(*keys, "_chunk").applyInArrow(tell, told)
    settled = reliable_checkpoint(with_totals(summary).groupBy(*keys).applyInArrow(settle, resolved))

    def scanned(key: tuple, table: pa.Table, known: pa.Table):
        """The chunk's row and samples with their pointers; None in recordings without a rate."""
        if not known.num_rows:
            return None
        (row,) = known.to_pylist()
        table, box = _samples(table)
        start = key[-1].as_py() * size
        return row, table, box, start, *pointers(box, start, row, row["n"], row["shortest"], max_disp)

    exits = schema("entry long, last long, still boolean, leave long, n long")

    def pass_through(key: tuple, table: pa.Table, known: pa.Table) -> pa.Table:
        rows = []
        if (found := scanned(key, table, known)) is not None:
            row, _, _, start, to, still = found
            last = leave(to, start)
            for entry in row["entries"]:
                end = int(last[entry - start])
                rows.append({"entry": entry, "last": end + start, "still": bool(still[end]), "leave": int(to[end]), "n": row["n"]})
        return rows_of(key, rows, exits)

    walked = schema("_chunk long, entry long, origin long")

    def walk(key: tuple, table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        n = rows[0]["n"]
        return rows_of(key, taken(rows, n, size, -(-n // size)), walked)

    chunked = numbered.groupBy(*keys, "_chunk")
    passed = chunked.cogroup(settled.groupBy(*keys, "_chunk")).applyInArrow(pass_through, exits)
    entered = passed.groupBy(*keys).applyInArrow(walk, walked)
    entered = entered.select(*[F.col(k).alias(f"_of_{k}") for k in [*keys, "_chunk"]], "entry", "origin")
    on = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in [*keys, "_chunk"]])
    known = settled.drop("entries").join(entered, on).drop(*[f"_of_{k}" for k in [*keys, "_chunk"]])

    part = schema("a long, b long, k long, sx double, sy double, t double, u double, shut long")

    def stretch(key: tuple, table: pa.Table, known: pa.Table) -> pa.Table:
        rows = []
        if (found := scanned(key, table, known)) is not None:
            row, table, box, start, to, still = found
            rows = parts(table, box, to, still, start, row["entry"], row["origin"])
        return rows_of(key, [dict(zip(part.fieldNames()[len(keys) :], r)) for r in rows], part)

    found = chunked.cogroup(known.groupBy(*keys, "_chunk")).applyInArrow(stretch, part)
    count = F.sum("k")
    stretches = found.groupBy(*keys, "a").agg(
        F.max("b").alias("b"),
        (F.sum("sx") / count).alias("fx"),
        (F.sum("sy") / count).alias("fy"),
        F.min("t").alias("t"),
        F.max("u").alias("u"),
        F.max("shut").alias("shut"),
    )
    joined = schema("a long, b long, fx double, fy double, t double, u double, shut long")

    def join(key: tuple, table: pa.Table) -> pa.Table:
        return rows_of(key, join_near(table.sort_by("a").to_pylist(), amplitude), joined)

    fixations = reliable_checkpoint(stretches.groupBy(*keys, "shut").applyInArrow(join, joined))
    following = with_ordered(fixations, keys, ["a"], {"_next": Lead(F.struct("t", "fx", "fy", "shut"))}, task_rows)
    none = F.lit(None).cast("double")
    fixed = fixations.select(
        *keys, F.lit("fixation").alias("kind"), F.col("t").alias("start"), F.col("u").alias("end"),
        F.col("fx").alias("x"), F.col("fy").alias("y"), none.alias("end_x"), none.alias("end_y"), F.lit(None).cast("boolean").alias("blink"),
    )
    moved = following.where(F.col("_next").isNotNull()).select(
        *keys, F.lit("saccade").alias("kind"), F.col("u").alias("start"), F.col("_next.t").alias("end"),
        F.col("fx").alias("x"), F.col("fy").alias("y"), F.col("_next.fx").alias("end_x"), F.col("_next.fy").alias("end_y"),
        (F.col("_next.shut") > F.col("shut")).alias("blink"),
    )
    return fixed.unionByName(moved)
