"""Questionnaire scales."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.conditional import recode

# Answer codes of the demographic items.
EDUCATION = {
    0: "kein Schulabschluss",
    1: "Hauptschulabschluss",
    2: "mittlere Reife",
    3: "Hochschulreife",
    4: "abgeschlossenes (Fach-)Hochschul-Studium",
}
WORK = {
    1: "arbeitssuchend",
    2: "Schüler:in",
    3: "in Ausbildung",
    4: "Student:in",
    5: "angestellt/selbstständig",
}
GENDER = {1: "male", 2: "female", 3: "non-binary"}
HAND = {1: "left-handed", 2: "right-handed", 3: "ambidextrous"}


def missing_share(df: DataFrame, prefix: str) -> Column:
    """Share of the items with a prefix that are missing in a row."""
    items = [F.col(c) for c in df.columns if c.startswith(prefix)]
    return sum((c.isNull().cast("int") for c in items[1:]), items[0].isNull().cast("int")) / F.lit(len(items))


def item_score(df: DataFrame, prefix: str, missing_max: float = 1.0) -> Column:
    """Sum score with missing items replaced by the row's mean; NULL when too many are missing."""
    items = [F.col(c).cast("double") for c in df.columns if c.startswith(prefix)]
    answered = F.filter(F.array(*items), lambda v: v.isNotNull())
    total = F.aggregate(answered, F.lit(0.0), lambda acc, v: acc + v)
    mean = F.when(F.size(answered) > 0, total / F.size(answered))
    return F.when(missing_share(df, prefix) <= F.lit(missing_max), mean * F.lit(len(items)))


def questionnaire_scores(items: DataFrame, missing_max: float = 0.2) -> DataFrame:
    """Scale scores and decoded demographics, one row per subject."""
    return items.select(
        "subject",
        item_score(items, "sias", missing_max).alias("sias"),
        item_score(items, "FB02_", missing_max).alias("stai"),
        (F.col("SD01") + 17).alias("age"),
        # code 5 is "no degree yet" and sorts first
        recode(recode(F.col("SD02"), {5: 0}, "keep"), EDUCATION).alias("edu"),
        recode(F.col("SD03"), WORK).alias("work"),
        recode(F.col("SD04"), GENDER).alias("gender"),
        recode(F.col("SD06"), HAND).alias("hand"),
        F.col("SD07_01").alias("comment"),
    )
