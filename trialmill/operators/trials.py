"""Event logs to trials: numbering, pivoting, scoring and validity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.conditional import case_when, if_null_safe, null_if
from ..functions.strings import digits, file_code, paradigm_of
from .ordered import Lag, LastValue, RowNumber, RunningSum, with_ordered
from .shaping import pivot_events
from .summaries import winsorize_z

ORDER = ("line",)
DOT, DUAL = "Dot Probe", "Dual Probe"


def is_distractor(code: str = "code") -> Column:
    """Does the row show the distractors, which starts a trial?"""
    return F.col(code).contains("distractors")


def relevant_events(log: DataFrame) -> DataFrame:
    """Trial events only: distractors, targets and responses other than the space bar."""
    response = (F.col("event") == "Response") & (F.col("code") != "1")
    return log.where(response | (F.col("code") == "targets") | is_distractor()).withColumn(
        "paradigm", paradigm_of(F.col("subject"))
    )


def number_trials(events: DataFrame, by: Sequence[str] = ("subject",), order: Sequence[str] = ORDER) -> DataFrame:
    """Trial number on the rows that start one, running on across blocks."""
    start = is_distractor()
    counted = with_ordered(events, by, order, {"_count": RunningSum(start.cast("int"))})
    return counted.withColumn("trial", F.when(start, F.col("_count"))).drop("_count")


def fill_down(df: DataFrame, col: str, by: Sequence[str] = ("subject", "block"), order: Sequence[str] = ORDER) -> DataFrame:
    """Repeat the last value on the rows after it; rows before the first one drop."""
    filled = with_ordered(df, by, order, {"_filled": LastValue(F.col(col))})
    return filled.withColumn(col, F.col("_filled")).drop("_filled").where(F.col(col).isNotNull())


def first_response(events: DataFrame, by: Sequence[str] = ("subject", "block"), order: Sequence[str] = ORDER) -> DataFrame:
    """Without the responses that directly follow a response."""
    seen = with_ordered(events, by, order, {"_before": Lag(F.col("event"))})
    repeated = (F.col("event") == "Response") & F.coalesce(F.col("_before") == "Response", F.lit(False))
    return seen.where(~repeated).drop("_before")


def trial_events(log: DataFrame, order: Sequence[str] = ORDER) -> DataFrame:
    """Numbered events of all trials, with one response each.

    The same as `first_response(fill_down(number_trials(...)))`: a block restarts the count, and the
    trials of earlier blocks are added from a small table, so that one shuffle serves all three steps.
    """
    events = relevant_events(log)
    start = is_distractor().cast("int")
    counted = with_ordered(
        events,
        ["subject", "block"],
        order,
        {"_in_block": RunningSum(start), "_before": Lag(F.col("event"))},
    )
    blocks = events.groupBy("subject", "block").agg(F.sum(start).alias("_trials"))
    # a subject has a handful of blocks
    earlier = with_ordered(
        blocks, ["subject"], ["block"], {"_upto": RunningSum(F.col("_trials"))}, bounded=True
    ).select("subject", "block", (F.col("_upto") - F.col("_trials")).alias("_earlier"))
    repeated = (F.col("event") == "Response") & F.coalesce(F.col("_before") == "Response", F.lit(False))
    return (
        counted.where((F.col("_in_block") > 0) & ~repeated)
        .join(earlier, ["subject", "block"])
        .withColumn("trial", F.col("_in_block") + F.col("_earlier"))
        .drop("_in_block", "_before", "_earlier")
    )


def event_kind(events: DataFrame) -> DataFrame:
    """Name of the event: target, distractors or response."""
    kind = case_when(
        (F.col("code") == "targets", F.lit("target")),
        (F.col("event") == "Picture", F.lit("distractors")),
        default=F.lower("event"),
    )
    return events.withColumn("kind", kind)


def parse_codes(trials: DataFrame, code: str = "code") -> DataFrame:
    """Pictures, targets and the side of the angry face from the distractor text.

    The text has five parts at blanks: left picture, left target, a bar, right picture, right target.
    """
    parts = F.split(F.regexp_replace(F.col(code), "distractors/", ""), " ")
    part = lambda i: F.get(parts, F.lit(i))
    picture = lambda i: F.regexp_replace(F.regexp_replace(part(i), r"category\d+/", ""), ".jpg", "")
    angry = case_when(
        (part(0).contains("category1"), F.lit("left")), (part(3).contains("category1"), F.lit("right"))
    )
    return trials.withColumns(
        {
            "angry": angry,
            "distractor_left": picture(0),
            "distractor_right": picture(3),
            "target_left": null_if(part(1), "NA"),
            "target_right": null_if(part(4), "NA"),
        }
    ).drop(code)


def trial_table(log: DataFrame, order: Sequence[str] = ORDER) -> DataFrame:
    """One row per trial with the distractors, the response and the time of each event."""
    events = event_kind(trial_events(log, order))
    wide = pivot_events(
        events,
        ["subject", "block", "paradigm", "trial"],
        "kind",
        ["distractors", "target", "response"],
        ["code", "time"],
        order,
    )
    named = wide.drop("code_target").withColumnsRenamed({"code_distractors": "code", "code_response": "response"})
    return parse_codes(named)


def map_response(trials: DataFrame) -> DataFrame:
    """Key codes to response numbers; the dual-probe pad has no key 5."""
    key = F.col("response").try_cast("int")
    shifted = case_when((F.col("paradigm") == DOT, key - 1), (F.col("paradigm") == DUAL, key - 3))
    return trials.withColumn("response", F.when(shifted >= 5, shifted + 1).otherwise(shifted))


def score_dot_probe(trials: DataFrame) -> DataFrame:
    """Target side and kind, congruency with the angry face and correctness of the key.

    The key map depends on the parity of the subject number. Expects mapped responses.
    """
    left, right = F.col("target_left"), F.col("target_right")
    side = case_when((right.isNull(), F.lit("left")), (left.isNull(), F.lit("right")))
    kind = case_when((right.isNull(), left), (left.isNull(), right))
    odd = digits(F.col("subject")) % 2 == 1
    one, two = F.lit(":"), F.lit("..")
    first = F.col("response") == 1
    meant = case_when(
        (odd, if_null_safe(first, one, two)), default=if_null_safe(first, two, one)
    )
    return trials.withColumns(
        {
            "target_dotprobe": side,
            "congruency_dotprobe": if_null_safe(F.col("angry") == side, F.lit("angry"), F.lit("neutral")),
            "target_kind_dotprobe": kind,
            "key_assign": F.when(
                F.col("paradigm") != DUAL, case_when((odd, F.lit(1)), default=F.lit(2))
            ),
            "response_dotprobe": F.when(F.col("paradigm") != DUAL, meant == kind),
        }
    )


def score_dual_probe(trials: DataFrame) -> DataFrame:
    """Side of the target that was named, and whether the angry face was on it. Expects mapped responses."""
    dual = F.col("paradigm") != DOT
    digit = lambda c: F.when(dual, F.col(c).try_cast("int"))
    answer = F.col("response")
    side = F.when(
        dual & answer.isNotNull(),
        case_when(
            (answer == digit("target_left"), F.lit("left")),
            (answer == digit("target_right"), F.lit("right")),
            default=F.lit("incorrect"),
        ),
    )
    return trials.withColumns(
        {
            "response_dual": side,
            "congruency_dual": if_null_safe(side == F.col("angry"), F.lit("angry"), F.lit("neutral")),
        }
    )


def trial_times(trials: DataFrame) -> DataFrame:
    """Response and exposure time in ms from ticks of 0.1 ms, and the SOA guessed from the exposure."""
    exposure = (F.col("time_target") - F.col("time_distractors")) / 10
    return trials.withColumns(
        {
            "rt": (F.col("time_response") - F.col("time_target")) / 10,
            "exposure": exposure,
            "soa": if_null_safe(exposure < 500, F.lit(100), F.lit(500)),
        }
    )


def scored_trials(log: DataFrame, order: Sequence[str] = ORDER) -> DataFrame:
    """Trials with responses, conditions and times; the congruency is that of the paradigm."""
    scored = score_dual_probe(score_dot_probe(map_response(trial_table(log, order))))
    congruency = if_null_safe(
        F.col("paradigm") == DOT, F.col("congruency_dotprobe"), F.col("congruency_dual")
    )
    dual = F.col("paradigm") != DOT
    digit = lambda c: F.when(dual, F.col(c).try_cast("int"))
    return (
        trial_times(scored.withColumn("congruency", congruency))
        .withColumns({"target_left": digit("target_left"), "target_right": digit("target_right")})
        .drop("congruency_dotprobe", "congruency_dual")
    )


def number_sequences(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Trial number of each planned trial, running on across the blocks of a subject."""
    return with_ordered(rows, ["subject"], order, {"trial": RowNumber()})


def sequence_conditions(sequences: DataFrame) -> DataFrame:
    """Condition codes as sent to the amplifier, and the side of the angry face from the picture names."""
    left, right = file_code(F.col("distractor_left")), file_code(F.col("distractor_right"))
    paradigm = paradigm_of(F.col("subject"))
    shifted = if_null_safe(
        (paradigm == DOT) & (F.col("soa") == 100), F.col("condition") + 5, F.col("condition")
    )
    angry = case_when(
        (left.contains("AN") & right.contains("NE"), F.lit("left")),
        (left.contains("NE") & right.contains("AN"), F.lit("right")),
    )
    return sequences.withColumns(
        {
            "paradigm": paradigm,
            "condition": shifted,
            "angry": angry,
            "distractor_left": left,
            "distractor_right": right,
        }
    )


def unusable() -> Column:
    """No response, premature response, or a wrong one."""
    paradigm = F.col("paradigm")
    return (
        F.col("response").isNull()
        | F.col("exposure").isNull()
        | ((paradigm == DOT) & (F.col("response_dotprobe") == F.lit(False)))
        | ((paradigm == DUAL) & (F.col("response_dual") == "incorrect"))
    )


def valid_trials(trials: DataFrame, z: tuple[float, float] | None = (-2.0, 2.0)) -> DataFrame:
    """Trials with a correct response after target onset, their times winsorized within subject."""
    correct = F.col("response_dotprobe") | (F.col("response_dual") != "incorrect")
    kept = trials.where(F.col("response").isNotNull() & F.col("exposure").isNotNull() & correct)
    return winsorize_z(kept, "rt", ["subject"], z) if z else kept


def trial_within_cell(trials: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Number of the trial within its cell, and the odd or even half it falls in."""
    numbered = with_ordered(trials, by, order, {"trial_within": RowNumber()})
    return numbered.withColumn("split", F.when(F.col("trial_within") % 2 == 0, "even").otherwise("odd"))


def rt_bias(means: DataFrame, by: Sequence[str], value: str = "rt", factor: str = "congruency") -> DataFrame:
    """Angry minus neutral, per subject and the other cells of the design."""
    level = lambda name: F.avg(F.when(F.col(factor) == name, F.col(value)))
    wide = means.groupBy(*by).agg(level("angry").alias("angry"), level("neutral").alias("neutral"))
    return wide.withColumn("bias", F.col("angry") - F.col("neutral"))


def response_bias(trials: DataFrame, by: Sequence[str] = ("subject", "soa")) -> DataFrame:
    """Share of choices on the angry side, minus one half. A missing congruency makes it missing."""
    hit = (F.col("congruency") == "angry").cast("double")
    complete = F.count(F.lit(1)) == F.count(hit)
    return trials.groupBy(*by).agg((F.when(complete, F.avg(hit)) - 0.5).alias("response_angry"))
