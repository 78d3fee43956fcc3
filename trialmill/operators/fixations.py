"""Fixations of trials: conditions from messages, valid time, baselines, regions and first dwell."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.conditional import case_when, clamp, if_null_safe, null_if
from ..functions.distributions import fisher_z, fisher_z_inv, t_tail
from ..functions.geometry import NOMINAL, Screen, vector_angle, viewing_distance
from .shaping import clamp_interval, semi_anti
from .summaries import first_non_null

TRIAL = ("subject", "block", "trial")


def session_trial(df: DataFrame, per_block: int = 288, session: str = "session", trial: str = "trial") -> DataFrame:
    """Subject and block from the session label, and trial numbers that run on in the second block."""
    parts = F.split(F.col(session), "_")
    block = F.get(parts, F.lit(1)).try_cast("int")
    number = F.regexp_replace(F.col(trial), "Trial: ", "").try_cast("int")
    return df.withColumns(
        {
            "subject": F.get(parts, F.lit(0)),
            "block": block,
            trial: number + (block - 1) * per_block,
        }
    ).drop(session)


def flip_y(fixations: DataFrame, screen: Screen = NOMINAL) -> DataFrame:
    """Vertical positions counted from the bottom of the screen instead of the top."""
    return fixations.withColumn("y", F.lit(float(screen.height_px)) - F.col("y"))


def message_conditions(messages: DataFrame, text: str = "text") -> DataFrame:
    """Pictures, targets and sides from the message text.

    Halves are parted by a bar, picture and target by a blank. Dual-probe trials have no target side.
    """
    halves = F.split(F.col(text), r" \| ")
    piece = lambda half, i: F.get(F.split(F.get(halves, F.lit(half)), " "), F.lit(i))
    left, right = null_if(piece(0, 1), "NA"), null_if(piece(1, 1), "NA")
    side = case_when(
        (F.col("subject").startswith("b"), F.lit(None).cast("string")),
        (left.isNull(), F.lit("right")),
        (right.isNull(), F.lit("left")),
        default=F.lit("error"),
    )
    angry = if_null_safe(piece(0, 0).contains("category1"), F.lit("left"), F.lit("right"))
    return messages.withColumns(
        {
            "distract_left": piece(0, 0),
            "target_left": left,
            "distract_right": piece(1, 0),
            "target_right": right,
            "angry": angry,
            "target_side": side,
            "target_kind": case_when((side == "left", left), (side == "right", right)),
            "congruency": if_null_safe(angry == side, F.lit("congruent"), F.lit("incongruent")),
        }
    )


def exposure_fixations(fixations: DataFrame) -> DataFrame:
    """Fixations from message onset, clipped to the time the distractors were shown."""
    moved = fixations.withColumns({c: F.col(c) - F.col("onset") for c in ("start", "end")})
    return clamp_interval(moved, "start", "end", F.lit(0.0), F.col("soa"))


def valid_time(fixations: DataFrame, by: Sequence[str] = (*TRIAL, "soa")) -> DataFrame:
    """Share of the exposure spent in fixations, and their number."""
    return fixations.groupBy(*by).agg(
        F.sum("dur").alias("_dur"), F.count(F.lit(1)).alias("n")
    ).withColumn("valid", F.col("_dur") / F.col("soa")).drop("_dur")


def trial_baseline(
    fixations: DataFrame,
    messages: DataFrame,
    low: float = -300.0,
    high: float = 0.0,
    keys: Sequence[str] = TRIAL,
) -> DataFrame:
    """Mean position before onset, weighted by duration; one row per trial with a fixation."""
    at = F.col("onset")
    start, end = F.col("start") - at, F.col("end") - at
    timed = fixations.drop("onset").join(messages.select(*keys, "onset"), list(keys))
    inside = (end > low) & (start < high)
    weight = F.when(inside, clamp(end, F.lit(low), F.lit(high)) - clamp(start, F.lit(low), F.lit(high)))
    total = F.sum(weight)
    # the order of rows decides the last bits of a sum; rounded, it cannot tip a later rounding
    mean = lambda c: F.round(F.when(total != 0, F.sum(F.col(c) * weight) / total), 9)
    return timed.groupBy(*keys).agg(mean("x").alias("x"), mean("y").alias("y"))


def baseline_summary(
    baselines: DataFrame,
    messages: DataFrame,
    max_invalid: float = 0.5,
    max_spread: float = 150.0,
) -> DataFrame:
    """Validity of the baselines per subject and block. Expects the flag `ok`.

    Shares are of the largest span of trial numbers any subject has in the block.
    """
    spans = messages.groupBy("subject", "block").agg((F.max("trial") - F.min("trial") + 1).alias("_span"))
    trials = spans.groupBy("block").agg(F.max("_span").alias("n_trials"))
    ok = F.col("ok")
    of = lambda c: F.when(ok, F.col(c))
    counted = baselines.groupBy("subject", "block").agg(
        F.sum(ok.cast("long")).alias("n_valid"),
        F.count("x").alias("_present"),
        F.stddev_samp(of("x")).alias("sd_x"),
        F.stddev_samp(of("y")).alias("sd_y"),
        (F.max(of("x")) - F.min(of("x"))).alias("range_x"),
        (F.max(of("y")) - F.min(of("y"))).alias("range_y"),
    )
    out = counted.join(trials, ["block"]).withColumns(
        {
            "invalid": 1 - F.col("n_valid") / F.col("n_trials"),
            "missing": (F.col("n_trials") - F.col("_present")) / F.col("n_trials"),
        }
    )
    included = (
        (F.col("invalid") <= max_invalid)
        & (F.col("range_x") <= max_spread)
        & (F.col("range_y") <= max_spread)
    )
    return out.withColumn("included", included).drop("_present")


def roi_side(fixations: DataFrame, zone: float = 100.0, screen: Screen = NOMINAL) -> DataFrame:
    """Side of the screen a fixation is on, and whether that is the side of the angry face.

    Fixations near the centre have no side.
    """
    middle = screen.width_px / 2
    side = case_when(
        (F.col("x") <= middle - zone, F.lit("left")), (F.col("x") >= middle + zone, F.lit("right"))
    )
    return fixations.withColumns(
        {"roi_side": side, "roi": if_null_safe(side == F.col("angry"), F.lit("angry"), F.lit("neutral"))}
    )


def first_dwell(
    fixations: DataFrame,
    align: bool = False,
    by: Sequence[str] = ("subject", "paradigm", "soa", "angry"),
    trial: str = "trial",
) -> DataFrame:
    """Share of trials whose first fixation on a face is on the angry one.

    Fixations that start with the sample window are left out; with `align`, those before onset are.
    """
    start = F.col("start") - F.col("onset") if align else F.col("start")
    later = fixations.withColumn("_start", start).where(F.col("_start") > 0)
    firsts = first_non_null(later, "roi", ["_start"], [*by, trial], "_first")
    return firsts.groupBy(*by).agg(
        F.avg((F.col("_first") == "angry").cast("double")).alias("first_dwell_angry")
    )


def roi_switches(fixations: DataFrame, keys: Sequence[str] = TRIAL, roi: str = "roi", outside: str = "no ROI") -> DataFrame:
    """Changes between consecutive regions, fixations outside any region left out."""
    regions = fixations.where(F.col(roi) != outside)
    before = F.lag(roi).over(Window.partitionBy(*keys).orderBy("start"))
    return (
        regions.withColumn("_changed", (F.col(roi) != before).cast("int"))
        .groupBy(*keys)
        .agg(F.coalesce(F.sum("_changed"), F.lit(0)).cast("long").alias("roi_switch"))
    )


def path_angle(
    fixations: DataFrame,
    x: str,
    y: str,
    screen: Screen = NOMINAL,
    keys: Sequence[str] = TRIAL,
    name: str = "angle",
) -> DataFrame:
    """Angle of gaze from the previous fixation; the first one starts from the screen centre.

    Coordinates are pixels from the centre.
    """
    order = Window.partitionBy(*keys).orderBy("start")
    mm = F.lit(screen.px_mm)
    to = [F.coalesce(F.col(c) * mm, F.lit(0.0)) for c in (x, y)]
    back = [F.coalesce(F.lag(c).over(order) * mm, F.lit(0.0)) for c in (x, y)]
    far = lambda v: viewing_distance(v[0], v[1], screen.distance_mm)
    placed = fixations.withColumns({"_x0": back[0], "_y0": back[1], "_x1": to[0], "_y1": to[1]})
    one, two = [F.col("_x0"), F.col("_y0")], [F.col("_x1"), F.col("_y1")]
    return placed.withColumn(name, vector_angle((*one, far(one)), (*two, far(two)))).drop(
        "_x0", "_y0", "_x1", "_y1"
    )


def scan_path(fixations: DataFrame, x: str, y: str, screen: Screen = NOMINAL, keys: Sequence[str] = TRIAL) -> DataFrame:
    """Total angle of gaze travelled in a trial."""
    return path_angle(fixations, x, y, screen, keys).groupBy(*keys).agg(F.sum("angle").alias("scan_path"))


def valid_decline(
    valid: DataFrame, min_n: int = 4, exclude: Sequence[str] = (), per_block: int = 288
) -> DataFrame:
    """Correlation of valid time with the trial number in each block.

    Subjects with fewer than `min_n` trials in any block are left out whole.
    """
    sizes = valid.groupBy("subject", "block").agg(F.count(F.lit(1)).alias("_n"))
    sparse = sizes.where(F.col("_n") < min_n).select("subject").distinct()
    kept = semi_anti(valid, sparse, ["subject"], anti=True)
    if exclude:
        kept = kept.where(~F.col("subject").isin(*exclude))
    number = (F.col("trial") - (F.col("block") - 1) * per_block).cast("double")
    r, n = F.col("r"), F.col("n")
    out = kept.groupBy("subject", "block").agg(
        F.corr(number, "valid").alias("r"), F.regr_count(F.col("valid"), number).alias("n")
    )
    t = F.when(F.abs(r) < 1, r * F.sqrt((n - 2) / (1 - r * r)))
    return out.withColumn("t", t).withColumn("p", t_tail(F.col("t"), n - 2))


def fisher_summary(correlations: DataFrame, r: str = "r", prune: float = 0.999, by: Sequence[str] = ()) -> DataFrame:
    """Mean and spread of correlations, taken in Fisher z."""
    z = fisher_z(F.col(r), prune)
    return correlations.groupBy(*by).agg(
        fisher_z_inv(F.avg(z)).alias("r_m"), fisher_z_inv(F.stddev_samp(z)).alias("r_sd")
    )

