"""Dwell times in picture regions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import NOMINAL, Screen
from .fixations import TRIAL, path_angle
from .joins import roi_lookup


def correct_baseline(
    fixations: DataFrame, baselines: DataFrame, keys: Sequence[str] = TRIAL, subject_keys: Sequence[str] = ("subject", "block")
) -> DataFrame:
    """Fixation positions relative to the baseline of the trial.

    Trials without a valid baseline take the mean of the valid ones. Baselines are rounded to 0.1 pixel.
    """
    ok = F.coalesce(F.col("ok"), F.lit(False))
    # rounded first, so that the order of rows in the mean cannot tip the rounding below
    mean = lambda c: F.round(F.avg(F.when(ok, F.col(c))), 9)
    means = baselines.groupBy(*subject_keys).agg(mean("x").alias("_mean_x"), mean("y").alias("_mean_y"))
    own = baselines.where(ok).select(*keys, F.col("x").alias("_own_x"), F.col("y").alias("_own_y"))
    joined = fixations.join(own, list(keys), "left").join(means, list(subject_keys), "left")
    return joined.withColumns(
        {
            f"{a}_cent": F.col(a) - F.bround(F.coalesce(f"_own_{a}", f"_mean_{a}"), 1)
            for a in ("x", "y")
        }
    ).drop("_own_x", "_own_y", "_mean_x", "_mean_y")


def mask_cell(fixations: DataFrame, rows: int, cols: int) -> DataFrame:
    """Mask row and column of a centred position; rows count downwards from one."""
    return fixations.withColumns(
        {
            "col": F.bround(F.col("x_cent") + 1.0 + cols / 2, 0).cast("int"),
            "row": F.bround(F.lit(1.0 + rows / 2) - F.col("y_cent"), 0).cast("int"),
        }
    )


def _share(part: Column, whole: Column) -> Column:
    """Part of a total; zero when nothing is in the part."""
    return F.when(F.coalesce(part, F.lit(0.0)) == 0, 0.0).otherwise(part / whole)


def _bin_shares(inside: Column, either: Column, low: float, high: float, edges: tuple[float, float]) -> list[Column]:
    """Dwell shares of one time bin, from fixations that touch it."""
    start, end = F.col("start"), F.col("end")
    first = F.greatest(start, F.lit(min(edges)))
    last = F.least(end, F.lit(max(edges)))
    counted = (end > min(edges)) & (start < max(edges)) & (last > first)
    touching = counted & (last >= low) & (first <= high)
    dur = F.when(touching, F.least(last, F.lit(high)) - F.greatest(first, F.lit(low)))
    total = lambda cond: F.sum(F.when(cond, dur))
    return [_share(total(inside), F.sum(dur)), _share(total(either[0]), total(either[1]))]


def roi_dwell(
    fixations: DataFrame,
    baselines: DataFrame,
    masks: DataFrame,
    bins: Sequence[float],
    end_ms: float,
    mask_rows: int,
    mask_cols: int,
    screen: Screen = NOMINAL,
    keys: Sequence[str] = TRIAL,
) -> DataFrame:
    """Dwell in the diagnostic and non-diagnostic region of each trial's picture.

    Expects `roi_id` and `onset` next to each fixation. Only fixations that start after onset count; a
    trial without one keeps its row with NULL.
    """
    timed = fixations.withColumns({c: F.col(c) - F.col("onset") for c in ("start", "end")})
    placed = mask_cell(correct_baseline(timed, baselines, keys), mask_rows, mask_cols)
    found = roi_lookup(placed, masks, ["diagnostic", "non_diagnostic"]).withColumnsRenamed(
        {"in_diagnostic": "in_roi", "in_non_diagnostic": "in_non"}
    )
    trials = found.select(*keys).distinct()
    region = (
        F.when(F.col("in_roi"), "diagnostic").when(F.col("in_non"), "non-diagnostic").otherwise("no ROI")
    )
    shown = found.withColumn("roi", region).where((F.col("start") > 0) & (F.col("end") > 0))

    # the time bins may reach beyond the end of the exposure, so they get unclipped fixations
    roi, non = F.col("in_roi"), F.col("in_non")
    edges = (float(min(bins)), float(max(bins)))
    binned: list[Column] = []
    for i, (low, high) in enumerate(zip(bins, bins[1:]), start=1):
        shares = _bin_shares(roi, (non, roi | non), float(low), float(high), edges)
        binned += [shares[0].alias(f"dwell_bin{i}"), shares[1].alias(f"dwell_non_bin{i}")]

    # a fixation of no duration still is where the next saccade comes from
    in_time = shown.withColumn("_in_time", F.col("start") < end_ms)
    angled = path_angle(in_time, "x_cent", "y_cent", screen, [*keys, "_in_time"]).withColumn(
        "_used", F.col("_in_time") & (F.col("end") > F.col("start"))
    )
    by_start = Window.partitionBy(*keys, "_used", "_in_any").orderBy("start")
    switched = angled.withColumn("_in_any", F.col("roi") != "no ROI").withColumn(
        "_switch", F.col("_in_any") & (F.col("roi") != F.lag("roi").over(by_start))
    )
    dur = F.least(F.col("end"), F.lit(float(end_ms))) - F.col("start")
    of = lambda c: F.when(F.col("_used"), c)
    total = lambda cond: F.sum(F.when(F.col("_used") & cond, dur))
    first = lambda cond: F.coalesce(F.min(F.when(F.col("_used") & cond, F.col("start"))), F.lit(float(end_ms)))
    out = switched.groupBy(*keys).agg(
        _share(total(roi), F.sum(of(dur))).alias("dwell"),
        _share(total(non), total(roi | non)).alias("dwell_non"),
        first(roi).alias("ms"),
        first(non).alias("ms_non"),
        F.sum(of(F.lit(1))).alias("fix_n"),
        F.avg(of(dur)).alias("fix_mean"),
        F.coalesce(F.sum(of(F.col("_switch").cast("long"))), F.lit(0)).alias("roi_switch"),
        F.sum(of(F.col("angle"))).alias("scan_path"),
        *binned,
    )
    results = [c for c in out.columns if c not in keys]
    kept = out.select(*keys, *[F.when(F.col("fix_n") > 0, F.col(c)).alias(c) for c in results])
    return trials.join(kept, list(keys), "left").withColumn(
        "diagnostic_first", F.col("ms") < F.col("ms_non")
    )
