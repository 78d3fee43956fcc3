"""Running values over ordered rows in groups of any size.

A plain window puts a whole group into one task, which fails when one group holds a large part of the
data. So the sizes of the groups are counted first. Where none has more than `TASK_ROWS` rows, a plain
window over one shuffle does the work. Otherwise the large groups are cut into chunks along their order.
Each chunk is a window partition of its own, and what a chunk needs from the chunks around it (a running
total, the last rows before it, the first rows after it) comes from a table with one row per chunk.

The count is an action: it reads the keys once, while the plan stays as small as that of a plain window.
Both helper tables are written to the shared folder and joined without hints. Results don't depend on the cut,
but for the last bits of sums of fractions, which are plain floating-point sums: NaN and infinity carry through.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from math import ceil
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from ..session import new_path, reliable_checkpoint

TASK_ROWS = 4_000_000

CHUNK, PLACE = "_chunk", "_place"


@dataclass(frozen=True)
class RunningSum:
    """Sum of the values up to and including the row; missing values count as zero.

    Fractions are added as they are, in the order of the rows; NaN and infinity carry through. Where a group is
    cut, chunks are summed on their own first, so the last bits may differ from those of the uncut sum.
    """

    value: Column


@dataclass(frozen=True)
class RowNumber:
    """Position in the group, from one."""


@dataclass(frozen=True)
class LastValue:
    """Last value that is not missing, up to and including the row (strict: before the row)."""

    value: Column
    strict: bool = False


@dataclass(frozen=True)
class NextValue:
    """First value that is not missing, after the row."""

    value: Column


@dataclass(frozen=True)
class Lag:
    """Value of the row `offset` rows before."""

    value: Column
    offset: int = 1


@dataclass(frozen=True)
class Lead:
    """Value of the row `offset` rows after."""

    value: Column
    offset: int = 1


Spec = RunningSum | RowNumber | LastValue | NextValue | Lag | Lead


def _position(df: DataFrame, column: str) -> Column | None:
    """The column as a number that grows with it; None where it has none."""
    kind = dict(df.dtypes)[column]
    if kind in ("timestamp", "timestamp_ntz"):
        return F.unix_micros(F.col(column).cast("timestamp")).cast("double")
    if kind == "date":
        return F.unix_date(F.col(column)).cast("double")
    if kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal"):
        return F.col(column).cast("double")
    return None


def _positions(df: DataFrame, order: Sequence[str]) -> list[Column]:
    """Finite positions along the order columns, up to the first that has none.

    Each column gives two: one that ranks missing, infinite and other values and NaN, one for the value itself.
    """
    out = []
    for column in order:
        if (position := _position(df, column)) is None:
            break
        infinite = F.lit(float("inf"))
        rank = (
            F.when(position.isNull(), 0)
            .when(F.isnan(position), 4)
            .when(position == infinite, 3)
            .when(position == -infinite, 1)
            .otherwise(2)
        )
        out += [rank.cast("double"), F.when(rank == 2, position).otherwise(0.0)]
    return out


def large_groups(
    df: DataFrame, by: Sequence[str], order: Sequence[str], task_rows: int
) -> DataFrame | None:
    """Groups with more rows than a task should hold, with the width of their chunks; None without any.

    A group is cut along the first order column whose values differ in it, into chunks of equal width. Rows that agree in all order columns can't be told apart and stay together.
    """
    positions = _positions(df, order)
    counted = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.struct(F.min(p).alias("low"), F.max(p).alias("high")).alias(f"_end{i}") for i, p in enumerate(positions)],
    )
    ends = [F.col(f"_end{i}") for i in range(len(positions))]

    def first_that_differs(values: Sequence[Column]) -> Column:
        return F.coalesce(*[F.when(e["high"] > e["low"], v) for e, v in zip(ends, values)], F.lit(None))

    spans = first_that_differs([e["high"] - e["low"] for e in ends])
    large = counted.where(F.col("_n") > task_rows).select(
        *[F.col(k).alias(f"_large_{k}") for k in by],
        first_that_differs([F.lit(i) for i in range(len(ends))]).alias("_axis"),
        first_that_differs([e["low"] for e in ends]).alias("_low"),
        (spans / F.ceil(F.col("_n") / F.lit(task_rows))).alias("_width"),
    ).where(F.col("_axis").isNotNull())
    found = reliable_checkpoint(large)
    return None if found.isEmpty() else found


def cut_large_groups(
    df: DataFrame, by: Sequence[str], order: Sequence[str], large: DataFrame, task_rows: int
) -> DataFrame:
    """Add `_chunk`: NULL in groups that fit a task, else the place of the row's slice along the order.

    Positions may be uneven, so slices that are still too large are cut again, and the place gets one
    number more. Places sort like the rows in them.
    """
    positions = _positions(df, order)
    along = F.coalesce(*[F.when(F.col("_axis") == i, p) for i, p in enumerate(positions)])
    place = F.floor((along - F.col("_low")) / F.col("_width")).cast("long")
    helpers = ["_axis", "_low", "_width"]

    def narrowed(rows: DataFrame, over: DataFrame, keys: Sequence[str], chunk: Column) -> DataFrame:
        if keys:
            # null-safe, since a missing key is a group like any other
            match = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_large_{k}")) for k in keys])
            joined = rows.join(over, match, "left")
        else:
            bounds = over.first()
            joined = rows.withColumns({c: F.lit(bounds[c]) for c in helpers})
        return joined.withColumn(CHUNK, chunk).drop(*helpers, *[f"_large_{k}" for k in keys])

    cut = narrowed(df, large, by, F.when(F.col("_width").isNotNull(), F.array(place)))
    keys = [*by, CHUNK]
    while (over := large_groups(cut.where(F.col(CHUNK).isNotNull()), keys, order, task_rows)) is not None:
        cut = narrowed(cut, over, keys, F.when(F.col("_width").isNotNull(), F.array_append(CHUNK, place)).otherwise(F.col(CHUNK)))
    return cut


def with_ordered(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    specs: Mapping[str, Spec],
    task_rows: int | None = None,
    bounded: bool = False,
) -> DataFrame:
    """Add one column per spec, computed over the rows of each group in a total order.

    `order` must rank the rows of a group without ties. Large groups are cut along its columns up to the first
    that is no number, date or timestamp. `task_rows` defaults to `TASK_ROWS`; with `bounded` the groups are
    known to be small and are not counted.
    """
    keys = list(by)
    task_rows = task_rows or TASK_ROWS
    large = None if bounded else large_groups(df, keys, order, task_rows)
    if large is None:
        return _plain(df, keys, order, specs)

    columns = df.columns
    inputs = {
        f"_in_{name}": spec.value for name, spec in specs.items() if not isinstance(spec, RowNumber)
    }
    cut = cut_large_groups(df.withColumns(inputs) if inputs else df, keys, order, large, task_rows)
    chunked = cut.repartition(*keys, CHUNK)
    window = Window.partitionBy(*keys, CHUNK).orderBy(*order)
    backward = Window.partitionBy(*keys, CHUNK).orderBy(*[F.col(c).desc() for c in order])
    local = {f"_local_{n}": _over(s, F.col(f"_in_{n}"), window, backward, boxed=True) for n, s in specs.items()}
    if any(isinstance(s, (Lag, Lead)) and s.offset > 1 for s in specs.values()):
        local["_rank"] = F.row_number().over(window)
        local["_size"] = F.count(F.lit(1)).over(Window.partitionBy(*keys, CHUNK))

    carried = reliable_checkpoint(_carry(cut, keys, list(order), specs))
    joined = chunked.withColumns(local).join(
        carried,
        [F.col(k).eqNullSafe(F.col(f"_carry_{k}")) for k in keys] + [F.col(CHUNK) == F.col("_carry_chunk")],
        "left",
    )
    return joined.select(*columns, *[_combine(n, s).alias(n) for n, s in specs.items()])


def place_in_order(df: DataFrame, by: Sequence[str], order: Sequence[str], task_rows: int) -> DataFrame | None:
    """The rows with `_place`, their place from zero among all rows along `by` and `order`, stored in that order.

    None when no group has more rows than a task should hold. The rows are sorted by ranges, so no group has to fit a
    task; the table of ranges, one row for each, is broadcast.
    """
    rows = df.groupBy(*by).count().agg(F.max("count").alias("most"), F.sum("count").alias("all")).first()
    if (rows.most or 0) <= task_rows:
        return None
    spark, path = df.sparkSession, new_path(df.sparkSession, "ordered")
    ranges = df.repartitionByRange(ceil(rows.all / task_rows), *by, *order).sortWithinPartitions(*by, *order)
    ranges.withColumn("_id", F.monotonically_increasing_id()).write.parquet(path)
    stored = spark.read.parquet(path)
    # the number of a row holds its range and its place in it
    part = F.shiftright("_id", 33)
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = stored.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    shift = F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.shiftleft("_part", 33)
    placed = stored.join(F.broadcast(sizes.select("_part", shift.alias("_shift"))), part == F.col("_part"))
    return placed.select(*df.columns, (F.col("_id") + F.col("_shift")).alias(PLACE))


def chunks_with_reach(placed: DataFrame, task_rows: int, before: int, after: int) -> DataFrame:
    """Placed rows in chunks of `task_rows` (`_chunk`), each with copies of the rows around that its rows look at.

    Windows over a chunk and its groups give right values for the rows that `at_home` keeps.
    """
    place = F.col(PLACE)
    chunks = F.sequence(F.floor((place - after) / task_rows), F.floor((place + before) / task_rows))
    return placed.withColumn(CHUNK, F.explode(chunks))


def at_home(chunks: DataFrame, task_rows: int) -> DataFrame:
    """The rows of the chunks without the copies around."""
    return chunks.where(F.col(CHUNK) == F.floor(F.col(PLACE) / task_rows)).drop(PLACE)


def with_ordered_chunks(chunks: DataFrame, by: Sequence[str], order: Sequence[str], specs: Mapping[str, Spec]) -> DataFrame:
    """As `with_ordered`, over stored rows whose `_chunk` grows along the order; the column stays.

    What chunks hand over concerns groups of several chunks alone, at most two rows a chunk, and is broadcast.
    """
    keys, columns = list(by), chunks.columns
    inputs = {f"_in_{n}": s.value for n, s in specs.items() if not isinstance(s, RowNumber)}
    cut = chunks.withColumns(inputs) if inputs else chunks
    window = Window.partitionBy(*keys, CHUNK).orderBy(*order)
    backward = Window.partitionBy(*keys, CHUNK).orderBy(*[F.col(c).desc() for c in order])
    local = {f"_local_{n}": _over(s, F.col(f"_in_{n}"), window, backward, boxed=True) for n, s in specs.items()}
    carried = _carry(cut, keys, list(order), specs)
    among = Window.partitionBy(*[f"_carry_{k}" for k in keys])
    carried = carried.withColumn("_several", F.count(F.lit(1)).over(among)).where("_several > 1").drop("_several")
    joined = cut.withColumns(local).join(
        F.broadcast(reliable_checkpoint(carried)),
        [F.col(k).eqNullSafe(F.col(f"_carry_{k}")) for k in keys] + [F.col(CHUNK) == F.col("_carry_chunk")],
        "left",
    )
    return joined.select(*columns, *[_combine(n, s).alias(n) for n, s in specs.items()])


def _over(spec: Spec, value: Column, window: WindowSpec, backward: WindowSpec, boxed: bool = False) -> Column:
    """The spec as a window function. Boxed neighbours tell a missing value from a missing row."""
    box = F.struct if boxed else lambda c: c
    match spec:
        case RunningSum():
            upto = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
            return F.sum(F.coalesce(value, F.lit(0))).over(upto)
        case RowNumber():
            return F.row_number().over(window).cast("long")
        case LastValue(strict=strict):
            until = -1 if strict else Window.currentRow
            return F.last(value, ignorenulls=True).over(
                window.rowsBetween(Window.unboundedPreceding, until)
            )
        case NextValue():
            # a frame that ends at the row is filled as rows come; one that begins there is read anew for each row
            return F.last(value, ignorenulls=True).over(backward.rowsBetween(Window.unboundedPreceding, -1))
        case Lag(offset=k):
            return F.lag(box(value), k).over(window)
        case Lead(offset=k):
            return F.lead(box(value), k).over(window)


def _plain(df: DataFrame, keys: list[str], order: Sequence[str], specs: Mapping[str, Spec]) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(*order)
    backward = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    values = {n: F.lit(1) if isinstance(s, RowNumber) else s.value for n, s in specs.items()}
    return df.select("*", *[_over(s, values[n], window, backward).alias(n) for n, s in specs.items()])


def _combine(name: str, spec: Spec) -> Column:
    own, carry = F.col(f"_local_{name}"), F.col(f"_carry_{name}")
    match spec:
        case RunningSum() | RowNumber():
            return own + F.coalesce(carry, F.lit(0))
        case LastValue() | NextValue():
            return F.coalesce(own, carry)
        case Lag(offset=k):
            # the carried list ends with the row just before the chunk
            back = F.lit(1) if k == 1 else F.lit(k) - F.col("_rank") + 1
            return F.coalesce(own, F.get(carry, F.size(carry) - back))[f"_in_{name}"]
        case Lead(offset=k):
            ahead = F.lit(0) if k == 1 else F.lit(k) - (F.col("_size") - F.col("_rank")) - 1
            return F.coalesce(own, F.get(carry, ahead))[f"_in_{name}"]


def _carry(cut: DataFrame, keys: list[str], order: list[str], specs: Mapping[str, Spec]) -> DataFrame:
    """One row per chunk of a large group with what the chunks around it hand over."""
    rows = cut.where(F.col(CHUNK).isNotNull())
    rank = F.struct(*order)
    reach = max([s.offset for s in specs.values() if isinstance(s, (Lag, Lead))], default=1)
    if reach > 1:
        edge = Window.partitionBy(*keys, CHUNK)
        rows = rows.withColumns(
            {
                "_from_start": F.row_number().over(edge.orderBy(*order)),
                "_from_end": F.row_number().over(edge.orderBy(*[F.col(c).desc() for c in order])),
            }
        )
    partial: list[Column] = []
    for name, spec in specs.items():
        value = F.lit(1) if isinstance(spec, RowNumber) else F.col(f"_in_{name}")
        match spec:
            case RunningSum() | RowNumber():
                part = F.sum(value)
            case LastValue():
                part = F.max_by(value, F.when(value.isNotNull(), rank))
            case NextValue():
                part = F.min_by(value, F.when(value.isNotNull(), rank))
            case Lag(offset=k) | Lead(offset=k):
                lag = isinstance(spec, Lag)
                boxed = F.struct(value.alias(f"_in_{name}"))
                if reach == 1:
                    pick = [F.max_by(boxed, rank) if lag else F.min_by(boxed, rank)]
                else:
                    place = F.col("_from_end" if lag else "_from_start")
                    steps = range(k, 0, -1) if lag else range(1, k + 1)
                    pick = [F.max(F.when(place == i, boxed)) for i in steps]
                part = F.filter(F.array(*pick), lambda item: item.isNotNull())
        partial.append(part.alias(f"_part_{name}"))
    chunks = rows.groupBy(*keys, CHUNK).agg(*partial)

    along = Window.partitionBy(*keys).orderBy(CHUNK)
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*keys).orderBy(F.col(CHUNK).desc()).rowsBetween(Window.unboundedPreceding, -1)
    carried = []
    for name, spec in specs.items():
        part = F.col(f"_part_{name}")
        match spec:
            case RunningSum() | RowNumber():
                value = F.sum(part).over(before)
            case LastValue():
                value = F.last(part, ignorenulls=True).over(before)
            case NextValue():
                value = F.last(part, ignorenulls=True).over(after)
            case Lag(offset=k):
                # every chunk holds a row, so the last k chunks hold the last k rows
                value = F.flatten(F.collect_list(part).over(along.rowsBetween(-k, -1)))
            case Lead(offset=k):
                value = F.flatten(F.collect_list(part).over(along.rowsBetween(1, k)))
        carried.append(value.alias(f"_carry_{name}"))
    return chunks.select(
        *[F.col(k).alias(f"_carry_{k}") for k in keys], F.col(CHUNK).alias("_carry_chunk"), *carried
    )
