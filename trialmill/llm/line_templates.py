"""Line dedup by a tree of line templates of fixed depth.

A line walks down a tree: by its number of tokens, then by its first `depth` tokens. Tokens with a digit count as
variable fields. Each leaf has a template: at every place the token that most texts have there, or a variable
field where no token recurs. A line belongs to its leaf's template when it agrees with enough fixed tokens after
those that the tree has branched on, else to itself; so does a line too short for that. Templates that recur
across texts are boilerplate: every line of theirs but the first goes.

Everything is DataFrame operations. Equal lines are counted before tokens are taken apart, so a line that stands
in a third of all documents is one row where tokens are counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import bit_words, maybe_in, stage

#: Tokens that the tree branches on; distinct texts that a template must stand in; share of a line's further tokens
#: that must agree with its leaf's template; tokens below which a line belongs to itself alone.
DEPTH, MIN_TEXTS, AGREEMENT, MIN_TOKENS = 3, 3, 0.6, 5
#: Lines of so many tokens are no chance repetition: two texts are enough.
LONG_TOKENS, LONG_TEXTS = 50, 2
#: Parts that a template's lines are dealt to.
PARTS = 16
BLANKS = r"[\x20\x09-\x0D]+"
FIELD = "<*>"
#: Bits of the filter that keeps lines of leaves that don't recur out of a shuffle (fixed size, broadcast).
FILTER_BITS = 1 << 22


def masked(line: Column) -> Column:
    """The line with one space between tokens and variable fields for tokens that hold a digit."""
    even = F.translate(line, "\t\n\x0b\x0c\r", "     ")
    plain = F.trim(F.when(F.contains(even, F.lit("  ")), F.regexp_replace(even, " {2,}", " ")).otherwise(even))
    return F.when(plain.rlike("[0-9]"), F.regexp_replace(plain, "[^ ]*[0-9][^ ]*", FIELD)).otherwise(plain)


def _lines(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """All lines: where they stand, a key of the text they are from and one of their own."""
    return docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"),
        F.xxhash64(F.col(f"`{text}`")).alias("text_key"),
        F.posexplode(F.split(F.col(f"`{text}`"), "\n")).alias("line_no", "line"),
    )


def find(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    depth: int = DEPTH,
    min_texts: int = MIN_TEXTS,
    agreement: float = AGREEMENT,
) -> DataFrame:
    """Lines of recurring templates: `doc_id`, `line_no` (from zero), `template`, `keep` (first of its template).

    A template recurs when its lines come from at least `min_texts` distinct texts, two for lines of `LONG_TOKENS`
    tokens; exact copies of a text count once, since whole copies are a matter of document dedup. The first line
    is that with the smallest document and line number, a null id before all others.

    Texts are read twice. What is shuffled are keys of lines, and the lines of leaves that recur; a filter of
    fixed size keeps most other lines out of that.
    """
    every = _lines(docs, doc_id, text).withColumn("raw", F.xxhash64("line")).withColumn("line", masked(F.col("line")))
    n_tokens = F.length("line") - F.length(F.replace("line", F.lit(" "), F.lit(""))) + 1
    # filtered after it is written, so that lines are masked once
    lines = stage(
        every.select(
            "doc_id",
            "line_no",
            "text_key",
            "raw",
            n_tokens.alias("n_tokens"),
            (F.col("line") == "").alias("blank"),
            F.xxhash64(n_tokens, F.substring_index("line", " ", depth)).alias("leaf"),
            F.xxhash64("line").alias("k1"),
            F.xxhash64(F.lit(depth), "line").alias("k2"),
        )
    ).where(~F.col("blank"))
    key = ["leaf", "k1", "k2"]
    needed = F.when(F.col("n_tokens") >= LONG_TOKENS, F.least(F.lit(LONG_TEXTS), F.lit(min_texts))).otherwise(min_texts)
    distinct = (
        lines.groupBy(*key, "n_tokens", "text_key")
        .agg(F.min("raw").alias("raw"))
        .groupBy(*key, "n_tokens")
        .agg(F.count(F.lit(1)).alias("n"), F.min("raw").alias("raw"))
    )
    # a line that belongs to itself recurs or not on its own; of the others, leaves with enough lines go on
    short = F.col("n_tokens") < MIN_TOKENS
    leaves = (
        distinct.where(~short).groupBy("leaf", "n_tokens").agg(F.sum("n").alias("total")).where(F.col("total") >= needed).select("leaf")
    )
    alone = distinct.where(short & (F.col("n") >= needed)).select(*key, F.xxhash64(*key).alias("template"))
    distinct = distinct.where(~short)
    wanted = stage(distinct.join(leaves, "leaf", "left_semi"))
    # one line per content, for leaves that recur only
    raw = _lines(docs, doc_id, text).select(F.xxhash64("line").alias("raw"), "line")
    found = maybe_in(raw, "raw", bit_words(wanted, "raw", FILTER_BITS), FILTER_BITS)
    tokens = stage(
        found.groupBy("raw")
        .agg(F.first("line").alias("line"))
        .join(wanted, "raw")
        .select(*key, "n_tokens", "n", F.posexplode(F.split(masked(F.col("line")), " ")).alias("place", "token"))
    )
    further = tokens.where(F.col("place") >= depth)
    support = further.where(F.col("token") != FIELD).groupBy("leaf", "n_tokens", "place", "token").agg(F.sum("n").alias("support"))
    fixed = (
        support.where(F.col("support") >= needed)
        .groupBy("leaf", "place")
        .agg(F.min_by("token", F.struct(-F.col("support"), F.col("token"))).alias("fixed"))
    )
    agreed = (
        further.join(fixed, ["leaf", "place"], "left")
        .groupBy(*key, "n_tokens", "n")
        .agg(F.sum(F.when(F.col("token") == F.col("fixed"), 1).otherwise(0)).alias("same"), F.count(F.lit(1)).alias("all"))
    )
    member = F.col("same") >= F.col("all") * agreement
    grouped = agreed.select(*key, "n_tokens", "n", F.when(member, F.xxhash64("leaf")).otherwise(F.xxhash64(*key)).alias("template"))
    # at least as many lines as texts: what has too few is out before texts are counted
    likely = grouped.groupBy("template", "n_tokens").agg(F.sum("n").alias("total")).where(F.col("total") >= needed)
    chosen = stage(grouped.join(likely.select("template"), "template", "left_semi").select(*key, "template").unionByName(alone))
    found = stage(lines.join(chosen, key).select("doc_id", "line_no", "text_key", "n_tokens", "template"))
    first = (
        found.groupBy("template", "n_tokens", "text_key")
        .agg(F.min(F.struct("doc_id", "line_no")).alias("first"))
        .groupBy("template", "n_tokens")
        .agg(F.count(F.lit(1)).alias("texts"), F.min("first").alias("first"))
        .where(F.col("texts") >= needed)
        .select("template", "first", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"))
    )
    # a template that a third of all documents hold is met in several parts
    dealt = found.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)).cast("int"))
    here = F.struct("doc_id", "line_no")
    return dealt.join(first, ["template", "part"]).select("doc_id", "line_no", "template", here.eqNullSafe(F.col("first")).alias("keep")).distinct()


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Documents without the repeated lines: replaces `text`, adds `n_lines` and `n_dropped`.

    Lines are split at line breaks; blank lines stay. A line of fewer than `MIN_TOKENS` tokens is a repeat of equal
    lines only, tokens with a digit aside. A null text stays null and has no line; an empty one has one empty line.
    Very long lines are compared whole. Equal lines within one document also count as repeats once their template
    recurs. Repeated rows with one document id and text lose the same lines; a row without an id loses none, though
    its lines count and may be the first. Other columns pass unchanged; those with the names of the new ones are
    replaced.
    """
    dropped = (
        find(docs, doc_id, text, **options)
        .where(~F.col("keep"))
        .groupBy(F.col("doc_id").alias("_at"))
        .agg(F.collect_set("line_no").alias("_gone"))
    )
    # a fixed kind of join that can spill, so that plans are alike at every size
    match = F.col(f"`{doc_id}`") == F.col("_at")
    joined = docs.drop("n_lines", "n_dropped").join(dropped.hint("merge"), match, "left").drop("_at")
    all_lines = F.split(F.col(f"`{text}`"), "\n")
    # line by line in order, next to the sorted numbers of those that go
    gone = F.sort_array(F.col("_gone"))
    starts = F.concat(F.array(F.lit(0)), F.transform(gone, lambda i: i + 1))
    ends = F.concat(gone, F.array(F.size(all_lines)))
    runs = F.filter(F.zip_with(starts, ends, lambda a, b: F.slice(all_lines, a + 1, F.greatest(b - a, F.lit(0)))), lambda r: F.size(r) > 0)
    return joined.withColumns(
        {
            "n_lines": F.coalesce(F.size(all_lines), F.lit(0)),
            "n_dropped": F.coalesce(F.size("_gone"), F.lit(0)),
            text: F.when(F.col("_gone").isNull(), F.col(f"`{text}`")).otherwise(F.array_join(F.flatten(runs), "\n")),
        }
    ).drop("_gone")
