"""Mixing sources to target weights with hash-threshold histograms.

A document's hash of its id decides in which order the documents of a source are taken. Sums of words per source
and range of hashes give nested thresholds: whole rounds of a source first, then the documents below a threshold
once more. Only the range that holds a threshold is looked at more closely, twice; nothing is sorted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stage

#: Weights of the sources in order, repeating; how many times its own size a source may count.
WEIGHTS, MOST = (5, 2, 1), 3
#: Bits of the hash, and of it per level of the histogram.
BITS, STEP = 30, 10
#: Sources up to which their table of thresholds is broadcast; beyond, Spark joins as it sees fit.
SMALL_TABLE = 10_000


def word_count(text: Column) -> Column:
    """Runs of characters other than the ASCII white space; zero for null."""
    runs = F.trim(F.translate(text, "\t\n\x0b\x0c\r", "     "))
    squeezed = F.regexp_replace(runs, " {2,}", " ")
    n = F.length(squeezed) - F.length(F.replace(squeezed, F.lit(" "), F.lit(""))) + 1
    return F.when(F.coalesce(F.length(runs), F.lit(0)) == 0, F.lit(0)).otherwise(n).cast("long")


def place_of(doc_id: Column) -> Column:
    """The document's place: the first bits of the MD5 sum of its id as text (a null id counts as empty)."""
    digits = F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 8)
    return F.shiftright(F.conv(digits, 16, 10).cast("long"), 32 - BITS)


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Target of each source from rows (`source`, `source_size`): source, source_size, target.

    Shares follow the weights of the sources in order of code points (null last). A target stops at `most` times
    its source's size and the excess goes to the others by weight: with a common level L, the target is
    min(most * size, weight * L), and L is where all targets add up to all sizes. One row per source.
    """
    n = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.get(F.array(*[F.lit(w) for w in weights]), (n - 1) % len(weights))
    weighed = sizes.select("source", "source_size", weight.alias("weight"))
    cap = F.col("source_size") * most
    by_need = Window.orderBy(cap / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_need.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_need.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy()
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum(cap).over(before), F.lit(0))) / F.sum("weight").over(rest)
    levels = weighed.withColumn("level", level)
    # the first source that its cap doesn't bind fixes the common level
    holds = F.when(F.col("level") * F.col("weight") <= cap, F.col("level"))
    chosen = F.first(holds, ignorenulls=True).over(by_need.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return levels.withColumn("chosen", chosen).select(
        "source", "source_size", F.coalesce(F.least(cap.cast("double"), F.col("chosen") * F.col("weight")), cap.cast("double")).alias("target")
    )


def thresholds(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Per source: source_size, target, `rounds` (whole takes) and `below` (places taken once more).

    `sizes` has the columns source, size and place.
    """
    shift = BITS - STEP
    first = sizes.groupBy("source", F.shiftright("place", shift).alias("bucket")).agg(F.sum("size").alias("words"))
    first = stage(first)
    aims = targets(first.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most)
    rounds = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    state = aims.withColumn("rounds", rounds.cast("long")).select(
        "source", "source_size", "target", "rounds", F.lit(0).cast("long").alias("low"),
        (F.col("target") - F.col("rounds") * F.col("source_size")).alias("budget"),
    )
    state = stage(_refine(state, first, last=False))
    while shift > 0:
        shift -= STEP
        inside = sizes.join(_few(state.select(F.col("source").alias("of"), "low")), F.col("source").eqNullSafe(F.col("of"))).where(
            F.shiftright("place", shift + STEP) == F.col("low")
        )
        finer = inside.groupBy("source", F.shiftright("place", shift).alias("bucket")).agg(F.sum("size").alias("words"))
        scaled = state.withColumn("low", F.shiftleft("low", STEP))
        state = stage(_refine(scaled, finer, last=shift == 0))
    return state.select("source", "source_size", "target", "rounds", F.col("low").alias("below"))


def _refine(state: DataFrame, histogram: DataFrame, last: bool) -> DataFrame:
    """Move `low` to the bucket that the budget ends in and take the buckets before it off the budget.

    At the last level that bucket is taken if this comes nearer to the budget.
    """
    window = Window.partitionBy("source").orderBy("bucket")
    sums = histogram.withColumn("upto", F.sum("words").over(window)).select(F.col("source").alias("of"), "bucket", "words", "upto")
    joined = state.join(sums, F.col("source").eqNullSafe(F.col("of")), "left")
    full = F.col("upto") <= F.col("budget")
    spent = F.coalesce(F.max(F.when(full, F.col("upto"))), F.lit(0))
    over = F.min(F.when(~full, F.struct("bucket", "words")))
    keys = ["source", "source_size", "target", "rounds", "low", "budget"]
    met = joined.groupBy(*keys).agg(spent.alias("spent"), over.alias("over"), F.max("bucket").alias("end"))
    # without a bucket that goes beyond the budget all buckets are taken
    low = F.coalesce(F.col("over.bucket"), F.col("end") + 1, F.col("low"))
    left = F.col("budget") - F.col("spent")
    if last:
        low = low + F.when(F.coalesce(F.col("over.words"), F.lit(0)) < 2 * left, 1).otherwise(0)
    return met.select("source", "source_size", "target", "rounds", low.cast("long").alias("low"), left.alias("budget"))


def _few(small: DataFrame) -> DataFrame:
    """The table with a broadcast hint if it is known to be small."""
    return F.broadcast(small) if small.limit(SMALL_TABLE + 1).count() <= SMALL_TABLE else small


def sized(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, source, size and place of every document, as a stored stage: texts are read once."""
    return stage(
        docs.select(
            F.col(f"`{doc_id}`").alias("doc_id"),
            F.col(f"`{source}`").alias("source"),
            word_count(F.col(f"`{text}`")).alias("size"),
            place_of(F.col(f"`{doc_id}`")).alias("place"),
        )
    )


def times(place: Column) -> Column:
    """How often a document is taken, from its place and the thresholds of its source."""
    return F.col("rounds") + F.when(place < F.col("below"), 1).otherwise(0)


def plan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """The mix: doc_id, size, source_size, target and taken (words that the mix takes, repeats counted).

    Each source's taken words come as near to its target as half a document. A null text has size zero, a null
    source is one of its own and comes last; rows with equal ids go together, since ids alone decide. A source
    without words has target zero. Extra columns are ignored; an empty table gives an empty mix. `most` is the
    most that a document counts.
    """
    sizes = sized(docs, doc_id, text, source)
    cuts = _few(thresholds(sizes, weights, most).withColumnRenamed("source", "of"))
    joined = sizes.join(cuts, F.col("source").eqNullSafe(F.col("of")))
    return joined.select("doc_id", "size", "source_size", "target", (F.col("size") * times(F.col("place"))).alias("taken"))


def apply(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """The documents of the mix with all their columns, each as often as it is taken."""
    cuts = thresholds(sized(docs, doc_id, text, source), weights, most).select(F.col("source").alias("_of"), "rounds", "below")
    cuts = cuts.select("_of", F.col("rounds").alias("_rounds"), F.col("below").alias("_below"))
    joined = docs.join(_few(cuts), F.col(f"`{source}`").eqNullSafe(F.col("_of")))
    n = F.col("_rounds") + F.when(place_of(F.col(f"`{doc_id}`")) < F.col("_below"), 1).otherwise(0)
    taken = joined.withColumn("_n", n).where("_n > 0").withColumn("_turn", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))))
    return taken.select(*[F.col(f"`{c}`") for c in docs.columns])
