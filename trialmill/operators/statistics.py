"""Group statistics from sufficient statistics: t-tests, correlations, reliabilities and ANOVA."""

from __future__ import annotations

import itertools
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distributions import d_interval, f_tail, fisher_z, fisher_z_inv, spearman_brown, t_tail

# Normal quantiles of a two-sided and a one-sided 95 % interval.
Z_TWO_SIDED = 1.959963984540054
Z_ONE_SIDED = 1.6448536269514722


def t_test_one(df: DataFrame, col: str | Column, by: Sequence[str] = (), tail: str = "two") -> DataFrame:
    """Mean against zero, with the standardised effect and its standard error."""
    value = F.col(col) if isinstance(col, str) else col
    n, m, sd = F.col("n"), F.col("mean"), F.col("sd")
    stats = df.groupBy(*by).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd")
    )
    d = F.when(sd != 0, m / sd)
    return stats.withColumns({"t": d * F.sqrt(n), "df": n - 1, "d": d}).withColumns(
        {
            "d_se": F.sqrt(F.lit(1.0) / n + F.col("d") * F.col("d") / (n * 2)),
            "p": t_tail(F.col("t"), F.col("df"), tail),
        }
    )


def t_test_paired(df: DataFrame, a: str, b: str, by: Sequence[str] = (), tail: str = "two") -> DataFrame:
    """Difference of two columns against zero."""
    return t_test_one(df, F.col(a) - F.col(b), by, tail)


def effect_interval(tests: DataFrame, level: float = 0.95) -> DataFrame:
    """Rows of a t-test with `d_low` and `d_high`: the interval of the standardised effect from the noncentral t."""
    limits = d_interval(F.col("t"), F.col("df"), F.col("n"), level)
    known = tests.withColumn("_limits", limits)
    return known.withColumns({"d_low": F.col("_limits.low"), "d_high": F.col("_limits.high")}).drop("_limits")


def correlation(
    df: DataFrame,
    x: str | Column,
    y: str | Column,
    by: Sequence[str] = (),
    tail: str = "two",
    strict: bool = False,
) -> DataFrame:
    """Pearson correlation with its t-test and Fisher-z interval.

    Incomplete pairs are left out, or with `strict` make the result missing.
    """
    a, b = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    a, b = a.cast("double"), b.cast("double")
    whole = F.count(F.lit(1)) == F.regr_count(b, a) if strict else F.lit(True)
    stats = df.groupBy(*by).agg(
        F.when(whole, F.corr(a, b)).alias("r"), F.regr_count(b, a).alias("n")
    )
    r, n = F.col("r"), F.col("n")
    t = F.when(F.abs(r) < 1, r * F.sqrt((n - 2) / (1 - r * r)))
    margin = F.lit(Z_TWO_SIDED if tail == "two" else Z_ONE_SIDED) / F.sqrt(n - 3)
    known = (n > 3) & (F.abs(r) < 1)
    low = F.when(known, fisher_z_inv(fisher_z(r) - margin))
    high = F.when(known, fisher_z_inv(fisher_z(r) + margin))
    return stats.withColumns(
        {
            "t": t,
            "df": n - 2,
            "low": F.when(known, F.lit(-1.0)) if tail == "less" else low,
            "high": F.when(known, F.lit(1.0)) if tail == "greater" else high,
        }
    ).withColumn("p", t_tail(F.col("t"), F.col("df"), tail))


def split_half(df: DataFrame, odd: str | Column, even: str | Column, by: Sequence[str] = ()) -> DataFrame:
    """Correlation of the halves, and the reliability of the whole."""
    return correlation(df, odd, even, by).withColumn("rel_sb", spearman_brown(F.col("r")))


def anova_contrast(
    df: DataFrame,
    dv: str,
    subject: str,
    within: Mapping[str, tuple[object, object]],
    between: str | None = None,
) -> DataFrame:
    """ANOVA with two-level factors within subjects and an optional factor between them.

    Each effect is a contrast of the subject's cell means, so subjects shrink to one row and effects to
    sums over subjects. Subjects that lack a cell are left out.
    """
    factors = list(within)
    keys = [subject, *([between] if between else [])]
    signs = list(itertools.product((1, -1), repeat=len(factors)))
    cells = []
    for i, combo in enumerate(signs):
        condition = F.lit(True)
        for factor, sign in zip(factors, combo):
            condition = condition & (F.col(factor) == F.lit(within[factor][0 if sign == 1 else 1]))
        cells.append(F.avg(F.when(condition, F.col(dv))).alias(f"_cell{i}"))
    names = [f"_cell{i}" for i in range(len(signs))]
    subjects = df.groupBy(*keys).agg(*cells).dropna(subset=names)

    contrasts = []
    for size in range(len(factors) + 1):
        for chosen in itertools.combinations(range(len(factors)), size):
            total = F.lit(0.0)
            for name, combo in zip(names, signs):
                weight = 1
                for i in chosen:
                    weight *= combo[i]
                total = total + F.col(name) * weight
            label = ":".join(factors[i] for i in chosen)
            contrasts.append(F.struct(F.lit(label).alias("_effect"), total.alias("_value")))
    group = F.col(between) if between else F.lit("all")
    long = subjects.select(group.alias("_group"), F.inline(F.array(*contrasts)))

    k = float(len(signs))
    by_group = long.groupBy("_effect", "_group").agg(
        F.count(F.lit(1)).alias("_n"),
        F.avg("_value").alias("_m"),
        F.coalesce(F.var_samp("_value") * (F.count(F.lit(1)) - 1), F.lit(0.0)).alias("_rest"),
    )
    m, n = F.col("_m"), F.col("_n")
    effect = Window.partitionBy("_effect")
    grand = by_group.withColumn("_grand", F.sum(m * n).over(effect) / F.sum(n).over(effect))
    away = m - F.col("_grand")
    totals = grand.groupBy("_effect").agg(
        F.sum(n).alias("_all"),
        F.count(F.lit(1)).alias("_groups"),
        F.max("_grand").alias("_mean"),
        F.sum(n * away * away).alias("_spread"),
        F.sum("_rest").alias("_error"),
    )
    error_df = F.col("_all") - F.col("_groups")
    own = F.when(F.col("_effect") == "", F.lit("(Intercept)")).otherwise(F.col("_effect"))
    rows = [
        F.struct(
            own.alias("effect"),
            (F.col("_mean") * F.col("_mean") * F.col("_all") / k).alias("ss"),
            F.lit(1).cast("long").alias("df1"),
        )
    ]
    if between:
        crossed = F.when(F.col("_effect") == "", F.lit(between)).otherwise(
            F.concat(F.lit(f"{between}:"), F.col("_effect"))
        )
        rows.append(
            F.struct(
                crossed.alias("effect"),
                (F.col("_spread") / k).alias("ss"),
                (F.col("_groups") - 1).alias("df1"),
            )
        )
    table = totals.select((F.col("_error") / k).alias("ss_error"), error_df.alias("df2"), F.inline(F.array(*rows)))
    f = F.when(
        (F.col("ss_error") > 0) & (F.col("df2") > 0) & (F.col("df1") > 0),
        (F.col("ss") / F.col("df1")) / (F.col("ss_error") / F.col("df2")),
    )
    return (
        table.withColumn("f", f)
        .withColumn("eta2", F.when(F.col("ss") + F.col("ss_error") > 0, F.col("ss") / (F.col("ss") + F.col("ss_error"))))
        .withColumn(
            "p",
            F.nanvl(
                f_tail(F.col("f"), F.col("df1").cast("double"), F.col("df2").cast("double")),
                F.lit(None).cast("double"),
            ),
        )
        .select("effect", "ss", "ss_error", "df1", "df2", "f", "eta2", "p")
    )
