"""Gaze samples: alignment, repair, blinks, and fixation and saccade detection.

Windows here are over one trial. The window join bounds a trial to a second and a half of samples, so a
subject with many trials spreads over many tasks. Whole recordings have no such bound: with `task_rows` the groups
of `keys` are counted, and where one is above it all are sorted and cut along the time, with equal results: chunks
hold the few samples around them that detection looks at, and hand over the flagged times and numbers of runs.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import new_path
from .ordered import (
    CHUNK, Lag, LastValue, Lead, NextValue, RunningSum, Spec, at_home, chunks_with_reach, place_in_order, with_ordered,
    with_ordered_chunks,
)

TRIAL = ("subject", "block", "trial")

#: Samples of a recording that a task should hold: their rows are wide.
CHUNK_SAMPLES = 50_000

# Measured fields of a gaze sample.
FIELDS = (
    "pupil_l_x",
    "pupil_l_y",
    "pupil_l_mm",
    "pupil_r_x",
    "pupil_r_y",
    "pupil_r_mm",
    "pos_l_x",
    "pos_l_y",
    "pos_r_x",
    "pos_r_y",
)


def _along(samples: DataFrame, keys: Sequence[str], time: str, specs: Mapping[str, Spec], task_rows: int | None) -> DataFrame:
    """Ordered columns over trials, or with `task_rows` over recordings of any length."""
    return with_ordered(samples, keys, [time], specs, task_rows, bounded=task_rows is None)


def align_trial(windowed: DataFrame, keys: Sequence[str] = TRIAL) -> DataFrame:
    """Sample times in ms from the first sample of the trial window, to 0.1 ms."""
    first = F.min("time").over(Window.partitionBy(*keys))
    return windowed.withColumn("t", F.bround((F.col("time") - first) / 1000.0, 1))


def message_onsets(windowed: DataFrame, messages: DataFrame, keys: Sequence[str] = TRIAL) -> DataFrame:
    """Messages with their onset in the trial window; NULL for trials without samples."""
    first = windowed.groupBy(*keys).agg(F.min("time").alias("_first"))
    return (
        messages.join(first, list(keys), "left")
        .withColumn("onset", F.bround((F.col("time") - F.col("_first")) / 1000.0, 1))
        .drop("_first")
    )


def interpolate_gaps(
    samples: DataFrame,
    fields: Sequence[str] = FIELDS,
    keys: Sequence[str] = TRIAL,
    time: str = "time",
    task_rows: int | None = None,
) -> DataFrame:
    """A single empty sample becomes the mean of its neighbours; the first and last one stay."""
    now = F.struct(*fields)
    around = _along(samples, keys, time, {"_before": Lag(now), "_after": Lead(now)}, task_rows)
    total = F.col(fields[0])
    for f in fields[1:]:
        total = total + F.col(f)
    probe = F.col(fields[0])
    empty = (
        F.col("_before").isNotNull()
        & F.col("_after").isNotNull()
        & (total == 0)
        & (probe != F.col("_before")[fields[0]])
        & (probe != F.col("_after")[fields[0]])
    )
    return around.withColumns(
        {f: F.when(empty, (F.col("_before")[f] + F.col("_after")[f]) / 2).otherwise(F.col(f)) for f in fields}
    ).drop("_before", "_after")


def merge_eyes(samples: DataFrame) -> DataFrame:
    """Mean position of both eyes; an eye at zero leaves the axis to the other."""

    def merged(left: Column, right: Column) -> Column:
        return F.when(right == 0, left).when(left == 0, right).otherwise((left + right) / 2)

    return samples.withColumns(
        {a: merged(F.col(f"pos_l_{a}"), F.col(f"pos_r_{a}")) for a in ("x", "y")}
    )


def mask_blinks(
    samples: DataFrame,
    offsets: Sequence[int] = (-2, 0, 2),
    keys: Sequence[str] = TRIAL,
    time: str = "time",
    task_rows: int | None = None,
) -> DataFrame:
    """Blink flag, spread to the given neighbours; the position in a blink is NULL."""
    closed = (F.col("pupil_l_mm") == 0) | (F.col("pupil_r_mm") == 0)
    flagged = samples.withColumn("_closed", F.coalesce(closed, F.lit(False)))
    near = {f"_near{n}": (Lag if k < 0 else Lead)(F.col("_closed"), abs(k)) for n, k in enumerate(offsets) if k}
    around = _along(flagged, keys, time, near, task_rows) if near else flagged
    spread = F.col("_closed") if 0 in offsets else F.lit(False)
    for c in near:
        spread = spread | F.coalesce(c, F.lit(False))
    return (
        around.withColumn("blink", spread)
        .withColumns({a: F.when(~F.col("blink"), F.col(a)) for a in ("x", "y")})
        .drop("_closed", *near)
    )


def clean_recordings(raw: DataFrame, keys: Sequence[str], time: str = "time", task_rows: int = CHUNK_SAMPLES) -> DataFrame:
    """Gaps filled, eyes merged and blinks masked in recordings of any length, which are sorted and cut once for all."""

    def clean(samples: DataFrame, by: Sequence[str]) -> DataFrame:
        return mask_blinks(merge_eyes(interpolate_gaps(samples, keys=by, time=time)), keys=by, time=time)

    placed = place_in_order(raw, keys, [time], task_rows)
    if placed is None:
        return clean(raw, keys)
    # a blink reaches two samples, a filled gap one more
    chunks = chunks_with_reach(placed, task_rows, 3, 3)
    return at_home(clean(chunks, [*keys, CHUNK]), task_rows).drop(CHUNK)


def gaze_runs(
    samples: DataFrame,
    px_per_degree: float,
    velocity: float = 30.0,
    acceleration: float = 8000.0,
    refractory: float = 50.0,
    keys: Sequence[str] = TRIAL,
    time: str = "time",
    task_rows: int | None = None,
) -> DataFrame:
    """Alternating runs of saccade and fixation samples in each trial.

    Fast or accelerating samples and blinks are flagged. Flagged samples less than `refractory` ms apart
    form one saccade together with what lies between; the rest are fixations. A sample between two flagged
    ones belongs to the saccade exactly when these two are that close, so the last flagged time before and
    the next one after decide, and no interval has to be joined back.
    """
    t, here = F.col(time), F.struct(F.col(time).alias("t"), "x", "y")
    placed = samples.select(
        *keys, time, F.coalesce("x", F.lit(0.0)).alias("x"), F.coalesce("y", F.lit(0.0)).alias("y"), "blink"
    )
    specs = {"_before": Lag(here), "_earlier": Lag(here, 2), "_after": Lead(F.struct("x", "y"))}
    in_order = None if task_rows is None else place_in_order(placed, keys, [time], task_rows)
    if in_order is None:
        moved = _along(placed, keys, time, specs, None)
    else:
        moved = _along(chunks_with_reach(in_order, task_rows, 2, 1), [*keys, CHUNK], time, specs, None)

    def seconds(now: Column, then: Column) -> Column:
        return (now["t"] - then["t"]) / 1000.0

    def speed(now: Column, then: Column) -> Column:
        dx, dy = ((now[a] - then[a]) / px_per_degree for a in ("x", "y"))
        return F.when(then.isNull(), 0.0).otherwise(F.sqrt(dx * dx + dy * dy) / seconds(now, then))

    before, fast = F.col("_before"), speed(here, F.col("_before"))
    gain = F.coalesce((fast - speed(before, F.col("_earlier"))) / seconds(here, before), F.lit(0.0))
    flag = (fast > velocity) | (gain > acceleration) | F.col("blink")
    flagged = moved.withColumn("_flagged_at", F.when(flag, t)).drop("_earlier")
    near = {"_last": LastValue(F.col("_flagged_at"), strict=True), "_next": NextValue(F.col("_flagged_at"))}
    if in_order is None:
        along = lambda rows, columns: _along(rows, keys, time, columns, None)
    else:
        along = lambda rows, columns: with_ordered_chunks(rows, keys, [time], columns)
        spark, path = samples.sparkSession, new_path(samples.sparkSession, "moved")
        at_home(flagged, task_rows).write.parquet(path)
        flagged = spark.read.parquet(path)
    dated = along(flagged, near)
    starts = F.col("_flagged_at").isNotNull() & (
        F.col("_last").isNull() | (t - F.col("_last") >= refractory)
    )
    numbered = along(dated, {"run": RunningSum(starts.cast("int"))})
    saccade = F.col("_flagged_at").isNotNull() | F.coalesce(
        F.col("_next") - F.col("_last") < refractory, F.lit(False)
    )
    edge = F.max((F.col("_before").isNull() | F.col("_after").isNull()))
    return (
        numbered.withColumn("saccade", saccade)
        .groupBy(*keys, "run", "saccade")
        .agg(
            F.min(t).alias("start"),
            F.max(t).alias("end"),
            # without the last bits, which depend on the order of rows
            F.round(F.avg("x"), 9).alias("x"),
            F.round(F.avg("y"), 9).alias("y"),
            F.min_by("_before", t).alias("_from"),
            F.max_by("_after", t).alias("_to"),
            F.max("blink").alias("blink"),
            edge.alias("at_edge"),
            F.count(F.lit(1)).alias("samples"),
        )
    )


def detect_saccades(samples: DataFrame, px_per_degree: float, **options) -> DataFrame:
    """Saccades with the positions before and after them; those at either end of the trial are left out."""
    runs = gaze_runs(samples, px_per_degree, **options)
    keys = options.get("keys", TRIAL)
    return runs.where(F.col("saccade") & ~F.col("at_edge")).select(
        *keys,
        "start",
        "end",
        F.bround("_from.x", 2).alias("start_x"),
        F.bround("_from.y", 2).alias("start_y"),
        F.bround("_to.x", 2).alias("end_x"),
        F.bround("_to.y", 2).alias("end_y"),
        "blink",
    )


def detect_fixations(samples: DataFrame, px_per_degree: float, **options) -> DataFrame:
    """What lies between, before and after the saccades, at its mean position.

    Saccades at the ends of a trial bound fixations too. Two saccades without a sample between them have
    no fixation between them.
    """
    runs = gaze_runs(samples, px_per_degree, **options)
    keys = options.get("keys", TRIAL)
    return runs.where(~F.col("saccade")).select(
        *keys, "start", "end", F.bround("x", 2).alias("x"), F.bround("y", 2).alias("y")
    )


# --- dispersion -------------------------------------------------------------------------------------


def dispersion_windows(
    x: np.ndarray, y: np.ndarray, blink: np.ndarray, shortest: int, widest: float
) -> Iterator[tuple[int, int]]:
    """Greedy stretches (first, last sample) of narrow gaze without a blink."""
    n, first = len(x), 0

    def narrow(a: int, b: int) -> bool:
        part = slice(a, b + 1)
        return not blink[part].any() and np.ptp(x[part]) + np.ptp(y[part]) < widest

    # the last sample that may be looked at is the one before the last but one
    while (last := first + shortest - 1) < n - 2:
        if not narrow(first, last):
            first += 1
            continue
        grown = last
        while grown < n - 2 and narrow(first, grown):
            grown += 1
        yield first, grown - 1
        first = grown


def dispersion_events(
    time: np.ndarray,
    x: np.ndarray,
    y: np.ndarray,
    blink: np.ndarray,
    amplitude: float,
    min_ms: float = 80.0,
    max_disp: float = 50.0,
) -> list[tuple]:
    """Fixations and saccades of a trial by dispersion: (kind, start, end, x, y, x_end, y_end, blink)."""
    if len(time) < 2:
        return []
    rate = 1000.0 / np.mean(np.diff(time))
    shortest = max(int(np.rint(min_ms / 1000.0 * rate)), 1)
    stretches = [
        (a, b, x[a : b + 1].mean(), y[a : b + 1].mean())
        for a, b in dispersion_windows(x, y, blink, shortest, max_disp)
    ]
    fixations: list[tuple] = []
    for now in stretches:
        if fixations:
            prior = fixations[-1]
            near = np.hypot(now[2] - prior[2], now[3] - prior[3]) < amplitude
            if near and not blink[prior[1] : now[0] + 1].any():
                weights = np.array([prior[1] - prior[0], now[1] - now[0]], dtype=float)
                mean = lambda k: float(np.dot([prior[k], now[k]], weights) / weights.sum())
                fixations[-1] = (prior[0], now[1], mean(2), mean(3))
                continue
        fixations.append(now)
    out = [
        ("fixation", time[a], time[b], round(fx, 2), round(fy, 2), None, None, None)
        for a, b, fx, fy in fixations
    ]
    for one, two in zip(fixations, fixations[1:]):
        positions = [round(float(v), 2) for v in (one[2], one[3], two[2], two[3])]
        closed = bool(blink[one[1] : two[0] + 1].any())
        out.append(("saccade", time[one[1]], time[two[0]], *positions, closed))
    return out


def detect_dispersion(
    samples: DataFrame,
    amplitude: float,
    min_ms: float = 80.0,
    max_disp: float = 50.0,
    keys: Sequence[str] = TRIAL,
    time: str = "time",
) -> DataFrame:
    """Fixations and saccades by dispersion. Each step depends on where the last one ended, so a trial
    (a second and a half of samples) is scanned in order by one grouped-map call."""
    names = ("kind", "start", "end", "x", "y", "end_x", "end_y", "blink")
    schema = T.StructType(
        [samples.schema[k] for k in keys]
        + [T.StructField("kind", T.StringType())]
        + [T.StructField(n, T.DoubleType()) for n in names[1:7]]
        + [T.StructField("blink", T.BooleanType())]
    )
    arrow = to_arrow_schema(schema)

    def scan(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by(time)
        column = lambda c: table.column(c).to_numpy()
        found = dispersion_events(
            column(time).astype(float),
            np.nan_to_num(column("x").astype(float)),
            np.nan_to_num(column("y").astype(float)),
            column("blink").astype(bool),
            amplitude,
            min_ms,
            max_disp,
        )
        own = {k: [v.as_py()] * len(found) for k, v in zip(keys, key)}
        events = dict(zip(names, zip(*found) if found else [()] * len(names)))
        return pa.table({**own, **events}, schema=arrow)

    return samples.select(*keys, time, "x", "y", "blink").groupBy(*keys).applyInArrow(scan, schema)
