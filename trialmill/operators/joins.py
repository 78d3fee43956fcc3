"""Joins between streams: by trial, by time window, by overlap and by mask cell."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import RunningSum, with_ordered

TRIAL = ("subject", "block", "trial")


def attach_sequence(trials: DataFrame, sequences: DataFrame, keys: Sequence[str] = TRIAL) -> DataFrame:
    """Scheduled SOA and inter-trial interval in place of the measured SOA."""
    plan = sequences.select(*keys, "soa", "iti")
    return trials.drop("soa", "iti").join(plan, list(keys), "left")


def attach_onset(events: DataFrame, messages: DataFrame, keys: Sequence[str] = TRIAL) -> DataFrame:
    """Message time of the trial as `onset`."""
    return events.join(messages.select(*keys, F.col("time").alias("onset")), list(keys), "left")


def attach_conditions(events: DataFrame, trials: DataFrame, keys: Sequence[str] = TRIAL) -> DataFrame:
    """All trial columns next to each event of the trial."""
    return events.join(trials, list(keys), "left")


def attach_trial_numbers(
    df: DataFrame, is_start: Column, by: Sequence[str], order: Sequence[str], name: str = "trial"
) -> DataFrame:
    """Number of the trial for the rows that start one, NULL for the others."""
    counted = with_ordered(df, by, order, {"_count": RunningSum(F.when(is_start, 1).otherwise(0))})
    return counted.withColumn(name, F.when(is_start, F.col("_count"))).drop("_count")


def subject_left_join(a: DataFrame, b: DataFrame, on: Sequence[str] = ("subject",)) -> DataFrame:
    """Summary columns of a second table next to the first."""
    return a.join(b, list(on), "left")


def trial_window_join(
    samples: DataFrame,
    messages: DataFrame,
    pre: int,
    post: int,
    keys: Sequence[str] = ("subject", "block"),
    time: str = "time",
) -> DataFrame:
    """Samples within [message - pre, message + post], for every message; windows may overlap.

    Time is cut into buckets as wide as a window. A window reaches into two buckets, rarely three, and
    is repeated for each of them, so that bucket and key make an equality join: no sample meets a window
    outside its bucket, and a subject with many samples spreads over many tasks.
    """
    width = max(pre + post, 1)
    bucket = lambda t: F.floor(t / F.lit(width))
    at = F.col("message_time")
    windows = messages.withColumnRenamed(time, "message_time").withColumn(
        "_bucket", F.explode(F.sequence(bucket(at - F.lit(pre)), bucket(at + F.lit(post))))
    )
    keyed = samples.withColumn("_bucket", bucket(F.col(time)))
    return (
        keyed.join(windows, [*keys, "_bucket"])
        .where(F.col(time).between(at - F.lit(pre), at + F.lit(post)))
        .drop("_bucket")
    )


def _halved(n: Column, times: Column, up: bool = False) -> Column:
    """Whole quotient by a power of two, towards minus or plus infinity."""
    return -F.call_function("shiftright", -n, times) if up else F.call_function("shiftright", n, times)


def dyadic_nodes(first: Column, last: Column, top: Column) -> Column:
    """The buckets first ... last as few nodes (level, place) of a binary tree with levels up to `top`.

    A level below the top gives at most two nodes; the top level takes what is left.
    """
    lo = lambda k: _halved(first, k, up=True)
    hi = lambda k: _halved(last + 1, k)
    node = lambda k, place: F.struct(k.cast("int").alias("level"), place.cast("long").alias("place"))
    odd = lambda n: n.bitwiseAND(F.lit(1).cast("long")) == 1
    ends = lambda k: F.array(
        F.when((lo(k) < hi(k)) & odd(lo(k)), node(k, lo(k))), F.when((lo(k) < hi(k)) & odd(hi(k)), node(k, hi(k) - 1))
    )
    below = F.flatten(F.transform(F.slice(F.sequence(F.lit(0), top), F.lit(1), top), ends))
    rest = F.when(lo(top) < hi(top), F.transform(F.sequence(lo(top), hi(top) - 1), lambda i: node(top, i)))
    return F.concat(F.filter(below, lambda n: n.isNotNull()), F.coalesce(rest, F.array().cast("array<struct<level:int,place:bigint>>")))


def interval_overlap_join(
    events: DataFrame,
    windows: DataFrame,
    keys: Sequence[str],
    width: float,
    start: str = "start",
    end: str = "end",
    low: str = "low",
    high: str = "high",
    longest: float | None = None,
) -> DataFrame:
    """Pairs of intervals that touch, whatever their lengths.

    Time is cut into buckets of the given width, the leaves of a binary tree. Two intervals touch if one of them
    begins within the other. So each interval is repeated for the few nodes that make it up, a number that grows
    with the logarithm of its length, and for the nodes above its first bucket; both meet in one equality join,
    and a pair meets exactly once. `longest` bounds the usual length and so the levels; an interval beyond it is
    only repeated more often. Without it the longest of both sides is looked up first. An interval with a missing
    limit, or one that ends before it starts, touches nothing.
    """
    bucket = lambda t: F.floor(t / F.lit(width)).cast("long")
    spans = lambda df, a, b: df.select((bucket(F.col(b)) - bucket(F.col(a)) + 1).alias("n"))
    if longest is None:
        lengths = spans(events, start, end).unionByName(spans(windows, low, high))
        top = lengths.agg(F.coalesce(F.ceil(F.log2(F.greatest(F.max("n"), F.lit(1)))), F.lit(0)).cast("int").alias("top")).scalar()
    else:
        top = F.lit(max(0, math.ceil(math.log2(max(longest / width, 1.0)))) + 1)

    def repeated(df: DataFrame, a: str, b: str, whole: int) -> DataFrame:
        known = df.where(F.col(a) <= F.col(b)).withColumns({"_first": bucket(F.col(a)), "_last": bucket(F.col(b)), "_top": top})
        above = F.transform(
            F.sequence(F.lit(0), F.col("_top")), lambda k: F.struct(k.alias("level"), _halved(F.col("_first"), k).alias("place"))
        )
        marked = lambda nodes, role: F.transform(
            nodes, lambda n: F.struct(F.lit(role).alias("_role"), n["level"].alias("_level"), n["place"].alias("_place"))
        )
        nodes = F.concat(marked(dyadic_nodes(F.col("_first"), F.col("_last"), F.col("_top")), whole), marked(above, 1 - whole))
        return known.select("*", F.inline(nodes)).drop("_last", "_top")

    left = repeated(events, start, end, 0).withColumnRenamed("_first", "_first_l")
    right = repeated(windows, low, high, 1).withColumnRenamed("_first", "_first_r")
    # role 0: the right one begins within the left one, in the same bucket at the earliest; role 1: the other way round
    return (
        left.join(right, [*keys, "_role", "_level", "_place"])
        .where((F.col(end) >= F.col(low)) & (F.col(start) <= F.col(high)))
        .where((F.col("_role") == 0) | (F.col("_first_l") > F.col("_first_r")))
        .drop("_role", "_level", "_place", "_first_l", "_first_r")
    )


def pack_masks(masks: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """Masks with one row per picture row: `roi_id`, `row`, and `words`, the bits of 64 columns by their place.

    `masks` is a table of set cells (`roi_id`, `row`, `col`, `kind`). Cells that repeat count once, cells without a
    column not at all.
    """
    bit = F.expr("shiftleft(1L, CAST(pmod(col, 64) AS INT))")
    words = (
        masks.where(F.col("col").isNotNull() & F.col("kind").isin(*kinds))
        .groupBy("roi_id", "row", F.floor(F.col("col") / 64).alias("place"))
        .agg(*[F.coalesce(F.bit_or(F.when(F.col("kind") == k, bit)), F.lit(0).cast("long")).alias(k) for k in kinds])
    )
    entry = F.struct("place", F.struct(*kinds))
    return words.groupBy("roi_id", "row").agg(F.map_from_entries(F.collect_list(entry)).alias("words"))


def roi_lookup(
    fixations: DataFrame, masks: DataFrame, kinds: Sequence[str], roi: str = "roi_id", row: str = "row", col: str = "col"
) -> DataFrame:
    """Is the cell of a fixation set in the mask of each kind? Cells outside every mask are not.

    `masks` are set cells or what `pack_masks` makes of them. A fixation meets one row of its picture for all kinds
    and reads its bit there, so the masks are a few hundred rows, which a plan hands to all tasks by their size.
    """
    packed = masks if "words" in masks.columns else pack_masks(masks, kinds)
    packed = packed.select(F.col("roi_id").alias(roi), F.col("row").alias(row), F.col("words").alias("_words"))
    found = fixations.join(packed, [roi, row], "left")
    word = F.try_element_at("_words", F.floor(F.col(col) / 64))
    place = F.pmod(F.col(col), F.lit(64)).cast("int")
    bits = {f"in_{k}": F.coalesce(F.call_function("shiftrightunsigned", word[k], place).bitwiseAND(1) == 1, F.lit(False)) for k in kinds}
    return found.withColumns(bits).drop("_words")


def global_extreme_filter(df: DataFrame, cols: Sequence[str], which: str = "both") -> DataFrame:
    """Rows that hold the overall minimum or maximum of any of the columns."""
    ends = {"min": F.min, "max": F.max}
    wanted = [(c, end) for c in cols for end in ends if which in ("both", end)]
    found = df.agg(F.struct(*[ends[end](c).alias(f"{end}_{c}") for c, end in wanted]).alias("ends"))
    # one pass for all extremes, handed over as a scalar
    known = df.withColumn("_ends", found.scalar())
    condition = F.lit(False)
    for c, end in wanted:
        condition = condition | (F.col(c) == F.col("_ends")[f"{end}_{c}"])
    return known.where(condition).drop("_ends")
