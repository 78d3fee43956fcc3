"""Selecting, filtering, recoding, reshaping and combining tables."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.conditional import if_null_safe


def select_cols(
    df: DataFrame,
    keep: Sequence[str] = (),
    rename: Mapping[str, str] | None = None,
    prefixes: Sequence[str] = (),
    containing: Sequence[str] = (),
    drop: Sequence[str] = (),
    first: Sequence[str] = (),
    lower: bool = False,
) -> DataFrame:
    """Choose columns by name, prefix or part of the name; rename, lower-case, reorder or drop them.

    Without any choice all columns stay.
    """
    everything = not (keep or prefixes or containing)
    chosen = [c for c in keep if c in df.columns]
    for c in df.columns:
        hit = everything or c.startswith(tuple(prefixes)) or any(part in c for part in containing)
        if hit and c not in chosen:
            chosen.append(c)
    chosen = [c for c in chosen if c not in drop]
    chosen = [c for c in first if c in chosen] + [c for c in chosen if c not in first]
    names = {c: (rename or {}).get(c, c) for c in chosen}
    return df.select(*[F.col(c).alias(n.lower() if lower else n) for c, n in names.items()])


def split_cols(df: DataFrame, col: str, into: Sequence[str | None], sep: str) -> DataFrame:
    """Split a text column at a regex into named parts; parts named None are discarded."""
    parts = F.split(F.col(col), sep)
    named = [F.get(parts, F.lit(i)).alias(name) for i, name in enumerate(into) if name]
    return df.select(*[c for c in df.columns if c != col], *named)


def across(df: DataFrame, cols: Iterable[str], fn: Callable[[Column], Column]) -> DataFrame:
    """The same expression over several columns."""
    return df.withColumns({c: fn(F.col(c)) for c in cols})


def filter_rows(df: DataFrame, condition: Column) -> DataFrame:
    """Rows whose condition is true; false and missing both drop the row."""
    return df.where(condition)


def clamp_interval(
    df: DataFrame, start: str, end: str, low: object, high: object, duration: str = "dur"
) -> DataFrame:
    """Clip an interval to a window, recompute its duration and drop what has none left.

    A bound may be a number, a column or None for no bound. A missing bound makes the duration missing,
    which drops the row.
    """
    bounds = {}
    if low is not None:
        bounds[start] = if_null_safe(F.col(start) < low, low, F.col(start))
    if high is not None:
        bounds[end] = if_null_safe(F.col(end) > high, high, F.col(end))
    clipped = df.withColumns(bounds)
    return clipped.withColumn(duration, F.col(end) - F.col(start)).where(F.col(duration) > 0)


def sort_rows(df: DataFrame, *cols: str | Column) -> DataFrame:
    """Order the rows; `-name` sorts descending."""
    return df.orderBy(
        *[F.desc(c[1:]) if isinstance(c, str) and c.startswith("-") else c for c in cols]
    )


def top_row(df: DataFrame, by: Sequence[str], rank: str, order: Sequence[str], lowest: bool = False) -> DataFrame:
    """The row with the highest (or lowest) rank of each group; the first in order on ties."""
    others = [c for c in df.columns if c not in by]
    value = F.col(rank)
    best = F.min_by if lowest else F.max_by
    top = (F.min if lowest else F.max)(value)
    if not order:
        return df.groupBy(*by).agg(best(F.struct(*others), value).alias("_row")).select(*by, "_row.*")
    # ties: among the rows at the extreme, the one that comes first
    peaks = df.groupBy(*by).agg(top.alias("_peak"))
    at_peak = df.join(peaks, list(by)).where(value == F.col("_peak"))
    picked = at_peak.groupBy(*by).agg(F.min_by(F.struct(*others), F.struct(*order)).alias("_row"))
    return picked.select(*by, "_row.*")


def union_frames(*frames: DataFrame) -> DataFrame:
    """Stack tables by column name; columns a table lacks are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def distinct_rows(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Unique combinations of the columns."""
    return df.select(*cols).distinct()


def semi_anti(df: DataFrame, ids: DataFrame, on: Sequence[str], anti: bool = False) -> DataFrame:
    """Rows whose keys appear (or do not appear) in another table."""
    return df.join(ids.select(*on), list(on), "left_anti" if anti else "left_semi")


def id_difference(a: DataFrame, b: DataFrame, on: Sequence[str], symmetric: bool = False) -> DataFrame:
    """Keys in one table only: of the first table, or of either when symmetric."""
    left, right = a.select(*on).distinct(), b.select(*on).distinct()
    only = left.join(right, list(on), "left_anti")
    return only.unionByName(right.join(left, list(on), "left_anti")) if symmetric else only


def melt(df: DataFrame, ids: Sequence[str], cols: Sequence[str], name: str = "name", value: str = "value") -> DataFrame:
    """Columns to rows."""
    return df.unpivot(list(ids), list(cols), name, value)


def pivot_events(
    events: DataFrame, keys: Sequence[str], kind: str, kinds: Sequence[str], values: Sequence[str], order: Sequence[str]
) -> DataFrame:
    """The events of a trial side by side: `<value>_<kind>`; the first event of a kind wins."""
    rank = F.struct(*order)
    return events.groupBy(*keys).agg(
        *[
            F.min_by(F.col(v), F.when(F.col(kind) == k, rank)).alias(f"{v}_{k}")
            for v in values
            for k in kinds
        ]
    )


def pivot_factor(
    df: DataFrame,
    ids: Sequence[str],
    levels: Mapping[str, Sequence],
    value: str,
    prefix: str = "",
) -> DataFrame:
    """Factor levels to columns, over one or more name columns. Duplicate cells are averaged."""
    cells: list[tuple[str, Column]] = [("", F.lit(True))]
    for column, names in levels.items():
        cells = [
            (f"{label}_{level}" if label else str(level), condition & (F.col(column) == F.lit(level)))
            for label, condition in cells
            for level in names
        ]
    return df.groupBy(*ids).agg(
        *[F.avg(F.when(condition, F.col(value))).alias(prefix + label) for label, condition in cells]
    )
