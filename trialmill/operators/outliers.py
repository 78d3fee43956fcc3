"""Iterative rejection of outlying points and values.

Each step depends on the rows kept so far. A group that fits a task is trimmed by one grouped-map call.
A larger group is trimmed in rounds: Spark finds the farthest rows of the group and the sums over all its
rows, a small task decides from those how many of the farthest rows must go, and the next round starts
from what is left. A row is only dropped, and a group only finished, when the sums prove the decision, so
both ways give the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import reliable_checkpoint

GROUP_ROWS = 200_000
CANDIDATES = 5_000


@dataclass(frozen=True)
class Outside:
    """Sums over all kept rows of a large group, taken before any candidate is dropped.

    `x`, `y` are sums of coordinates; `d`, `d2` are sums of distances (squared) from the centre at the
    start of the round. No row that is not a candidate lies farther from that centre than `reach`.
    """

    n: int
    x: float
    y: float
    d: float
    d2: float
    reach: float


Decision = tuple[np.ndarray, bool]


def trim_points(
    x: np.ndarray, y: np.ndarray, stop: int, z: float | None, radius: float | None, outside: Outside | None = None
) -> Decision:
    """Drop the point farthest from the centre of the kept ones, again and again.

    With `z`, while its distance exceeds mean + z·sd of the others' distances; with `radius`, while it
    exceeds the radius; never below `stop` points. Returns the points kept, and whether that is final.
    """
    kept = np.ones(len(x), dtype=bool)
    n = outside.n if outside else len(x)
    total = np.array([outside.x, outside.y]) if outside else np.array([x.sum(), y.sum()])
    start = total / max(n, 1)
    first = np.hypot(x - start[0], y - start[1])
    d_sum, d2_sum = (outside.d, outside.d2) if outside else (0.0, 0.0)
    while n > stop:
        if not kept.any():
            return kept, False
        centre = total / n if outside else np.array([x[kept].mean(), y[kept].mean()])
        shift = float(np.hypot(*(centre - start)))
        d = np.where(kept, np.hypot(x - centre[0], y - centre[1]), 0.0)
        far = int(np.argmax(d))
        if outside and shift > 0 and d[far] < outside.reach + shift:
            return kept, False
        slack = 0.0
        if radius is not None:
            limit = radius
        elif outside is None:
            others = kept.copy()
            others[far] = False
            limit = d[others].mean() + z * d[others].std(ddof=1)
        else:
            # distances moved by at most the shift of the centre, and so did their mean and spread
            m = n - 1
            s, q = d_sum - first[far], d2_sum - first[far] ** 2
            limit = s / m + z * np.sqrt(max(q - s * s / m, 0.0) / (m - 1))
            slack = shift * (1 + z * np.sqrt(m / (m - 1)))
        if d[far] <= limit - slack:
            return kept, True
        if d[far] <= limit + slack:
            if slack > 0:
                return kept, False
            return kept, True
        kept[far] = False
        n -= 1
        total = total - (x[far], y[far])
        d_sum, d2_sum = d_sum - first[far], d2_sum - first[far] ** 2
    return kept, True


def trim_values(
    x: np.ndarray, stop: int, mode: str, limit: float, outside: Outside | None = None
) -> Decision:
    """Drop extreme values, again and again.

    `z`: the lowest and the highest value beyond z sd of the mean of all others; `abs`: beyond a fixed
    distance of that mean; `spread`: the value farthest from the mean until the range is small enough.
    In a large group the candidates are its lowest and highest values.
    """
    kept = np.ones(len(x), dtype=bool)
    n = outside.n if outside else len(x)
    # sums around a fixed centre lose no digits
    centre = (outside.x / outside.n) if outside else (x.mean() if len(x) else 0.0)
    shifted = x - centre
    s, q = (0.0, outside.d2) if outside else (shifted.sum(), (shifted**2).sum())
    low_side = shifted <= 0 if outside else np.ones(len(x), dtype=bool)
    high_side = ~low_side if outside else low_side
    while n > stop:
        lows, highs = kept & low_side, kept & high_side
        if not lows.any() or not highs.any():
            # with nothing dropped yet, one empty side means that all values are equal
            return kept, bool(kept.all())
        lo = int(np.flatnonzero(lows)[np.argmin(shifted[lows])])
        hi = int(np.flatnonzero(highs)[np.argmax(shifted[highs])])
        if mode == "spread":
            if shifted[hi] - shifted[lo] <= limit:
                return kept, True
            mean = s / n
            near, far = (lo, hi) if shifted[hi] - mean > mean - shifted[lo] else (hi, lo)
            tie = shifted[hi] - mean == mean - shifted[lo]
            drop = [min(lo, hi) if tie else far]
        else:
            ends = {lo, hi}
            m = n - len(ends)
            mean = (s - sum(shifted[i] for i in ends)) / m
            if mode == "z":
                rest = q - sum(shifted[i] ** 2 for i in ends)
                width = limit * np.sqrt(max(rest - m * mean * mean, 0.0) / (m - 1))
            else:
                width = limit
            drop = [i for i in ends if shifted[i] < mean - width or shifted[i] > mean + width]
            if not drop:
                return kept, True
        for i in drop:
            kept[i] = False
            n -= 1
            s -= shifted[i]
            q -= shifted[i] ** 2
    return kept, True


Trimmer = Callable[[np.ndarray, np.ndarray, Outside | None], Decision]


def _trim(
    df: DataFrame,
    x: str,
    y: str,
    by: Sequence[str],
    order: Sequence[str],
    within: str | None,
    name: str,
    trimmer: Trimmer,
    both_ends: bool,
    group_rows: int,
    candidates: int,
) -> DataFrame:
    keys, rows = list(by), list(order)
    target = name if name not in df.columns else f"_{name}"
    usable = F.col(x).isNotNull() & F.col(y).isNotNull()
    if within:
        usable = usable & F.coalesce(F.col(within), F.lit(False))
    # the steps below read the rows several times
    start = reliable_checkpoint(df.withColumn("_in", usable))
    sizes = start.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    large = sizes.where(F.col("_size") > group_rows).select(*keys)

    schema = T.StructType([*start.drop("_in").schema.fields, T.StructField(target, T.BooleanType())])

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(rows)
        inside = pdf.pop("_in").to_numpy(dtype=bool)
        xs, ys = (pdf[c].to_numpy(dtype=float)[inside] for c in (x, y))
        kept = inside.copy()
        kept[inside] = trimmer(xs, ys, None)[0]
        return pdf.assign(**{target: kept})

    small = start.join(large, keys, "left_anti")
    out = small.groupBy(*keys).applyInPandas(whole, schema)
    if not large.isEmpty():
        rest = start.join(large, keys, "left_semi")
        rest = _trim_large(rest, x, y, keys, rows, trimmer, both_ends, candidates)
        out = out.unionByName(rest.withColumnRenamed("_in", target))
    if target != name:
        out = out.drop(name).withColumnRenamed(target, name)
    return out


def _trim_large(
    df: DataFrame, x: str, y: str, keys: list[str], rows: list[str], trimmer: Trimmer, both_ends: bool, k: int
) -> DataFrame:
    """Rounds over groups too large for one task; `_in` ends as the flag of the rows kept."""
    open_groups = reliable_checkpoint(df.select(*keys).distinct())
    decision = T.StructType(
        [df.schema[c] for c in dict.fromkeys([*keys, *rows])] + [T.StructField("_drop", T.BooleanType()), T.StructField("_final", T.BooleanType())]
    )

    def decide(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(rows)
        head = pdf.iloc[0]
        outside = Outside(int(head["_n"]), head["_x"], head["_y"], head["_d"], head["_d2"], head["_reach"])
        kept, final = trimmer(pdf[x].to_numpy(dtype=float), pdf[y].to_numpy(dtype=float), outside)
        out = pdf[list(dict.fromkeys([*keys, *rows]))].assign(_drop=~kept, _final=final)
        return out[out["_drop"] | (out.index == pdf.index[0])]

    while not open_groups.isEmpty():
        active = df.where("_in").join(open_groups, keys, "left_semi")
        centres = active.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("_n"), F.sum(x).alias("_x"), F.sum(y).alias("_y")
        )
        placed = active.join(centres, keys)
        dx, dy = F.col(x) - F.col("_x") / F.col("_n"), F.col(y) - F.col("_y") / F.col("_n")
        if both_ends:
            placed = placed.withColumn("_far", F.abs(dx)).withColumn("_side", dx > 0)
        else:
            placed = placed.withColumn("_far", F.sqrt(dx * dx + dy * dy)).withColumn("_side", F.lit(True))
        sums = placed.groupBy(*keys).agg(
            F.sum("_far").alias("_d"), F.sum(F.col("_far") * F.col("_far")).alias("_d2")
        )
        # Spark keeps the first k rows of each group before it moves them
        place = F.row_number().over(
            Window.partitionBy(*keys, "_side").orderBy(F.col("_far").desc(), *rows)
        )
        farthest = placed.withColumn("_place", place).where(F.col("_place") <= k)
        reach = farthest.groupBy(*keys).agg(F.min("_far").alias("_reach"))
        ready = farthest.join(sums, keys).join(reach, keys)
        verdict = reliable_checkpoint(ready.groupBy(*keys).applyInPandas(decide, decision))
        dropped = verdict.where("_drop").select(*dict.fromkeys([*keys, *rows])).withColumn("_gone", F.lit(True))
        df = reliable_checkpoint(
            df.join(dropped, list(dict.fromkeys([*keys, *rows])), "left")
            .withColumn("_in", F.col("_in") & F.col("_gone").isNull())
            .drop("_gone")
        )
        open_groups = reliable_checkpoint(verdict.where(~F.col("_final")).select(*keys).distinct())
    return df


BLOCK = ("subject", "block")


def reject_outlier_points(
    df: DataFrame,
    x: str,
    y: str,
    by: Sequence[str] = BLOCK,
    z: float = 3.0,
    order: Sequence[str] = ("trial",),
    within: str | None = None,
    name: str = "ok",
    group_rows: int = GROUP_ROWS,
    candidates: int = CANDIDATES,
) -> DataFrame:
    """Flag the points kept when far points are dropped one by one until none stands out.

    Missing points are not kept. `order` must identify a row within its group.
    """
    trimmer = lambda a, b, outside: trim_points(a, b, 3, z, None, outside)
    return _trim(df, x, y, by, order, within, name, trimmer, False, group_rows, candidates)


def reject_spread_points(
    df: DataFrame,
    x: str,
    y: str,
    by: Sequence[str] = BLOCK,
    spread: float = 150.0,
    order: Sequence[str] = ("trial",),
    within: str | None = "ok",
    name: str = "ok",
    group_rows: int = GROUP_ROWS,
    candidates: int = CANDIDATES,
) -> DataFrame:
    """Flag the points kept when far points are dropped until all lie within a circle of that diameter.

    Starts from the points flagged by `within`.
    """
    trimmer = lambda a, b, outside: trim_points(a, b, 2, None, spread / 2, outside)
    return _trim(df, x, y, by, order, within, name, trimmer, False, group_rows, candidates)


def reject_outlier_values(
    df: DataFrame,
    x: str,
    by: Sequence[str] = BLOCK,
    mode: str = "z",
    limit: float = 3.0,
    order: Sequence[str] = ("trial",),
    within: str | None = None,
    name: str = "ok",
    group_rows: int = GROUP_ROWS,
    candidates: int = CANDIDATES,
) -> DataFrame:
    """The same along one axis, by standard deviations (`z`), range (`spread`) or distance (`abs`)."""
    stop = {"z": 3, "spread": 1, "abs": 2}[mode]
    trimmer = lambda a, _, outside: trim_values(a, stop, mode, limit, outside)
    return _trim(df, x, x, by, order, within, name, trimmer, True, group_rows, candidates)
