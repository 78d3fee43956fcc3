"""Grouped summaries. All of them aggregate on the map side before rows move."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import reliable_checkpoint


def strict_avg(col: Column) -> Column:
    """Mean that is missing as soon as one value is."""
    return F.when(F.count(F.lit(1)) == F.count(col), F.avg(col))


def cell_means(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Mean of the value in each cell."""
    return df.groupBy(*by).agg(F.avg(value).alias(value))


def mean_se(df: DataFrame, value: str, by: Sequence[str] = (), na_rm: bool = True) -> DataFrame:
    """Mean and standard error; without `na_rm` one missing value makes both missing."""
    col = F.col(value)
    complete = F.lit(True) if na_rm else F.count(F.lit(1)) == F.count(col)
    return df.groupBy(*by).agg(
        F.when(complete, F.avg(col)).alias("mean"),
        F.when(complete, F.stddev_samp(col) / F.sqrt(F.count(col))).alias("se"),
        F.count(col).alias("n"),
    )


def describe_long(df: DataFrame, cols: Sequence[str], strict: bool = True) -> DataFrame:
    """Mean, standard deviation, minimum and maximum, one row per variable."""
    aggs = []
    for c in cols:
        col = F.col(c).cast("double")
        ok = F.count(F.lit(1)) == F.count(col) if strict else F.lit(True)
        stats = {"m": F.avg(col), "sd": F.stddev_samp(col), "min": F.min(col), "max": F.max(col)}
        aggs.append(
            F.struct(F.lit(c).alias("name"), *[F.when(ok, s).alias(n) for n, s in stats.items()]).alias(c)
        )
    return df.agg(*aggs).select(F.inline(F.array(*[F.col(c) for c in cols])))


def value_counts(
    df: DataFrame, col: str, denominator: str | float | None = None, levels: Sequence | None = None
) -> DataFrame:
    """Count and proportion of each value.

    The proportion is of all rows, of a number, or of the distinct values of a named column. Levels given
    in advance appear with a zero count.
    """
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    if levels is not None:
        known = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(v) for v in levels])).alias(col))
        counts = counts.join(known, [col], "full").withColumn("n", F.coalesce("n", F.lit(0)))
    if denominator is None:
        total = df.agg(F.count(F.lit(1)).alias("total")).scalar()
    elif isinstance(denominator, str):
        total = df.agg(F.countDistinct(denominator).alias("total")).scalar()
    else:
        total = F.lit(float(denominator))
    return counts.withColumn("p", F.col("n") / total)


def count_of_counts(df: DataFrame, col: str) -> DataFrame:
    """How many values occur how often."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("times")).groupBy("times").agg(
        F.count(F.lit(1)).alias("values")
    )


def count_check(df: DataFrame, by: Sequence[str], expected: int) -> DataFrame:
    """Groups whose number of rows is not the expected one."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") != expected)


def subject_rates(df: DataFrame, predicate: Column, by: Sequence[str], name: str, skip_missing: bool) -> DataFrame:
    """Number and share of rows that meet a predicate, per subject.

    A missing predicate is left out, or makes the group's rate missing.
    """
    hit = predicate.cast("double")
    ok = F.lit(True) if skip_missing else F.count(F.lit(1)) == F.count(hit)
    return df.groupBy(*by).agg(
        F.when(ok, F.coalesce(F.sum(hit), F.lit(0.0))).alias(f"{name}_n"),
        F.when(ok, F.avg(hit)).alias(f"{name}_p"),
    )


def conditional_rates(
    df: DataFrame,
    predicate: Column,
    name: str,
    by: Sequence[str] = ("subject", "paradigm"),
    outer_by: Sequence[str] = ("paradigm",),
    skip_missing: bool = False,
) -> DataFrame:
    """Mean and spread over subjects of the number and share of rows that meet a predicate."""
    rates = subject_rates(df, predicate, by, name, skip_missing)
    out = []
    for kind in ("n", "p"):
        c = F.col(f"{name}_{kind}")
        out += [strict_avg(c).alias(f"{name}_{kind}_m"), _strict_sd(c).alias(f"{name}_{kind}_sd")]
    return rates.groupBy(*outer_by).agg(*out)


def _strict_sd(col: Column) -> Column:
    return F.when(F.count(F.lit(1)) == F.count(col), F.stddev_samp(col))


def design_balance(df: DataFrame, predicates: Mapping[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """Share of rows that meet each predicate, missing ones left out."""
    return df.groupBy(*by).agg(*[F.avg(p.cast("double")).alias(n) for n, p in predicates.items()])


def full_join_summaries(
    df: DataFrame, value: str, keys: Sequence[str], splits: Mapping[str, Mapping[str, Column]]
) -> DataFrame:
    """Overall mean and the means of several splits of the rows, in one row per key.

    One pass of conditional averages stands for separate summaries joined on the key: every key has rows,
    so every summary would hold it. A missing value makes the means of its cells missing.
    """
    col = F.col(value)
    means = [strict_avg(col).alias(value)]
    for cells in splits.values():
        for label, condition in cells.items():
            inside = F.count(F.when(condition, F.lit(1)))
            valued = F.count(F.when(condition, col))
            means.append(
                F.when(inside == valued, F.avg(F.when(condition, col))).alias(f"{value}_{label}")
            )
    return df.groupBy(*keys).agg(*means)


def retention(
    valid: DataFrame,
    all_ids: DataFrame,
    trials: int = 576,
    trial_min: float = 0.5,
    subject_min: float = 0.5,
    subject: str = "subject",
) -> DataFrame:
    """Subjects with enough valid trials, those without, and the share kept.

    Subjects of `all_ids` that have no valid row at all count as excluded.
    """
    shares = valid.groupBy(subject).agg(
        (F.sum((F.col("valid") > trial_min).cast("long")) / F.lit(trials)).alias("share")
    )
    ids = all_ids.select(subject).distinct().join(shares, [subject], "left")
    kept = F.sum((F.col("share") > subject_min).cast("long"))
    lost = F.sum(F.when(F.col("share").isNull() | (F.col("share") <= subject_min), 1).otherwise(0))
    return ids.agg(F.coalesce(kept, F.lit(0)).alias("n"), lost.alias("n_ex")).withColumn(
        "retention", F.col("n") / (F.col("n") + F.col("n_ex"))
    )


#: Parts a range of values is cut into, and values of one part that a task may hold.
PARTS, PART_VALUES = 1024, 1_000_000


def _binade(v: Column) -> Column:
    """Sign and power of two of a number, in the order of the numbers; infinities lie outside, NaN last."""
    power = F.floor(F.log2(F.abs(v))) + 1100
    infinite = F.abs(v) == F.lit(float("inf"))
    return (
        F.when(F.isnan(v), 9999)
        .when(infinite, F.when(v > 0, 5000).otherwise(-5000))
        .when(v == 0, 0)
        .otherwise(F.when(v > 0, power).otherwise(-power))
        .cast("long")
    )


def quantiles(
    df: DataFrame, col: str, probs: Sequence[float], by: Sequence[str] = (), part_values: int = PART_VALUES
) -> DataFrame:
    """Exact quantiles per group, with linear interpolation between neighbouring ranks.

    Ranks are found in histograms: values are counted by sign and power of two, and only the parts that hold a
    wanted rank are cut further, into equal ranges, until a part has at most `part_values` values or a single
    one. A power of two has 2^52 numbers, so at most seven rounds are needed however the values lie, and no task
    sees more than one part. Missing values do not count; NaN is the largest. A group without values has no
    rows; without groups, the quantiles of nothing are missing.
    """
    group = F.struct(*[F.col(c) for c in by]) if by else F.struct(F.lit(0).alias("all"))
    number = F.col(col).cast("double") + F.lit(0.0)  # a negative zero is a zero
    rows = df.where(F.col(col).isNotNull()).select(group.alias("_g"), number.alias("_v"))
    if by:
        totals = rows.groupBy("_g").agg(F.count(F.lit(1)).alias("_total"))
    else:
        totals = rows.agg(F.count(F.lit(1)).alias("_total")).withColumn("_g", group)
    each = totals.select("_g", "_total", F.posexplode(F.array(*[F.lit(float(p)) for p in probs])).alias("_i", "prob"))
    place = (F.col("_total") - 1) * F.col("prob")
    each = each.withColumn("_low", F.floor(place)).withColumn("_part", place - F.col("_low"))
    ranks = F.array(F.col("_low") + 1, F.least(F.col("_low") + 2, F.col("_total")))
    wanted = each.select("_g", "_i", F.posexplode(ranks).alias("_side", "_rank"), F.lit(0.0).alias("_at"))

    open_rows = rows.select("_g", "_v", F.lit(0.0).alias("_at"), _binade(F.col("_v")).alias("_bin"))
    found: list[DataFrame] = []
    while True:
        bins = open_rows.groupBy("_g", "_at", "_bin").agg(
            F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_from"), F.max("_v").alias("_to")
        )
        upto = F.sum("_n").over(Window.partitionBy("_g", "_at").orderBy("_bin"))
        rest = F.col("_rank") - F.col("_upto") + F.col("_n")
        hits = (
            wanted.join(bins.withColumn("_upto", upto), ["_g", "_at"])
            .where((F.col("_rank") <= F.col("_upto")) & (rest > 0))
            .select("_g", "_at", "_bin", "_i", "_side", rest.alias("_rank"), "_n", "_from", "_to")
        )
        # one row per wanted rank; plans of the rounds would repeat each other
        hits = reliable_checkpoint(hits)
        single = F.col("_from") == F.col("_to")
        found.append(hits.where(single).select("_g", "_i", "_side", F.col("_from").alias("_value")))
        few = hits.where(~single & (F.col("_n") <= part_values))
        found.append(_in_parts(open_rows, few))
        many = hits.where(~single & (F.col("_n") > part_values))
        if many.isEmpty():
            break
        ranges = many.select("_g", "_at", "_bin", "_from", "_to").distinct()
        v, start, stop = F.col("_v"), F.col("_from"), F.col("_to")
        share = F.least(F.floor((v - start) / (stop - start) * PARTS), F.lit(PARTS - 1))
        open_rows = open_rows.join(ranges, ["_g", "_at", "_bin"]).select(
            "_g", "_v", start.alias("_at"), share.cast("long").alias("_bin")
        )
        wanted = many.select("_g", "_i", "_side", "_rank", F.col("_from").alias("_at"))

    side = lambda k: F.max(F.when(F.col("_side") == k, F.col("_value")))
    values = reduce(DataFrame.unionByName, found).groupBy("_g", "_i").agg(side(0).alias("_a"), side(1).alias("_b"))
    return each.join(values, ["_g", "_i"], "left").select(
        *[F.col("_g").getField(c).alias(c) for c in by],
        "prob",
        F.when(F.col("_part") == 0, F.col("_a"))
        .otherwise(F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_part"))
        .alias("value"),
    )


def _in_parts(rows: DataFrame, ranks: DataFrame) -> DataFrame:
    """Values at ranks within parts, each of which fits a task; equal values are counted first."""
    part = ["_g", "_at", "_bin"]
    counts = rows.join(ranks.select(*part).distinct(), part).groupBy(*part, "_v").agg(F.count(F.lit(1)).alias("_c"))
    counts = counts.withColumn("_upto", F.sum("_c").over(Window.partitionBy(*part).orderBy("_v")))
    here = F.col("_rank").between(F.col("_upto") - F.col("_c") + 1, F.col("_upto"))
    return ranks.join(counts, part).where(here).select("_g", "_i", "_side", F.col("_v").alias("_value"))


def linear_fit(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Least-squares line of y on x per group."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    return df.groupBy(*by).agg(
        F.regr_slope(b, a).alias("slope"), F.regr_intercept(b, a).alias("intercept"), F.regr_count(b, a).alias("n")
    )


def first_non_null(df: DataFrame, value: str, order: Sequence[str], by: Sequence[str], name: str | None = None) -> DataFrame:
    """First value of a group that is not missing; groups without one stay, with NULL."""
    rank = F.when(F.col(value).isNotNull(), F.struct(*order))
    return df.groupBy(*by).agg(F.min_by(value, rank).alias(name or value))


def unit_squeeze(df: DataFrame, col: str, trial: str = "trial", block: str = "block", per_block: int = 288) -> DataFrame:
    """Pull shares off 0 and 1 by the overall number of rows, and restart trial numbers in each block."""
    n = df.agg(F.count(F.lit(1)).alias("total")).scalar()
    return df.withColumns(
        {
            col: (F.col(col) * (n - 1) + 0.5) / n,
            trial: F.col(trial) - (F.col(block) - 1) * per_block,
        }
    )


def winsorize_z(df: DataFrame, col: str, by: Sequence[str] = ("subject",), z: tuple[float, float] = (-2.0, 2.0), name: str | None = None) -> DataFrame:
    """Values beyond mean + z·sd of their group are set to that limit.

    The limits are aggregated first and joined back, so a large group is never gathered in one task.
    """
    limits = df.groupBy(*by).agg(F.avg(col).alias("_m"), F.stddev_samp(col).alias("_sd"))
    limits = limits.select(
        *by, (F.col("_m") + F.col("_sd") * min(z)).alias("_low"), (F.col("_m") + F.col("_sd") * max(z)).alias("_high")
    )
    value = F.col(col)
    clipped = F.when(value < F.col("_low"), F.col("_low")).when(value > F.col("_high"), F.col("_high")).otherwise(value)
    return df.join(limits, list(by), "left").withColumn(name or col, clipped).drop("_low", "_high")
