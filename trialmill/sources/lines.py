"""Text files as numbered lines, read in splits.

Files are never loaded whole: a large recording is read by many tasks. The position of a line is derived
from where its split starts and its place in the split. A line takes at least one byte, so positions grow
strictly through a file.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..functions.strings import file_code


#: Where Spark wrote a recording: a folder named after it, and in it parts whose names sort in its order.
PART = r"/[^/=]+=([^/]+)/(part-[^/]+)$"
#: Folders (`_packed=0`, `_packed=1`, ...) of recordings that follow one another in parts, one folder per run that wrote.
PACKED = "_packed"


def list_inputs(spark: SparkSession, path: str, include: str = "*", excludes: Sequence[str] = ()) -> DataFrame:
    """Lines of the files that match a glob, without files whose name matches one of the patterns.

    Folders that `write_lines` made count as one file each, named as their recording, and so does each recording
    among packed ones; the glob is not asked for them. Columns: text, file, and what `place_lines` needs.
    """
    lines = spark.read.option("pathGlobFilter", f"{{{include},part-*}}").text(path)
    at = F.col("_metadata.file_path")
    # rows of a split are consecutive, so are their numbers
    place = [F.col("_metadata.file_block_start").alias("_split"), F.monotonically_increasing_id().alias("_id")]
    if PACKED in lines.columns:
        raw = _unpacked(lines, at, place)
    else:
        part = F.regexp_extract(at, PART, 2)
        recording = F.regexp_extract(at, PART, 1)
        for _ in range(2):  # the name is escaped as a folder of a partition, and again as an address
            recording = F.url_decode(F.regexp_replace(recording, r"\+", "%2B"))
        file = F.when(part == "", at).otherwise(F.concat(F.regexp_replace(at, PART, "/"), recording))
        raw = lines.select(F.col("value").alias("text"), file.alias("file"), file.alias("_source"), part.alias("_part"), *place)
    name = F.substring_index(F.col("file"), "/", -1)
    for pattern in excludes:
        raw = raw.where(~name.rlike(pattern))
    return raw


def _unpacked(lines: DataFrame, at: Column, place: Sequence[Column]) -> DataFrame:
    """Lines of packed recordings; of a recording that several runs wrote, those of the last run."""

    def above(levels: int) -> Column:
        return F.substring(at, F.lit(1), F.length(at) - F.length(F.substring_index(at, "/", -levels)))

    name = F.substring_index("value", "\t", 1)
    name = F.when(name.contains("%") | name.contains("+"), F.url_decode(name)).otherwise(name)
    text = F.substring(F.col("value"), F.instr("value", "\t") + 1, F.length("value"))
    file = F.concat(above(2), name).alias("file")
    part = F.substring_index(at, "/", -1).alias("_part")
    raw = lines.select(text.alias("text"), file, above(1).alias("_source"), part, *place, F.col(PACKED).cast("int").alias(PACKED))
    if len(_runs(lines)) > 1:
        last = raw.groupBy(F.col("file").alias("_of")).agg(F.max(PACKED).alias("_last"))
        raw = raw.join(last, (F.col("file") == F.col("_of")) & (F.col(PACKED) == F.col("_last"))).drop("_of", "_last")
    return raw


def _runs(lines: DataFrame) -> set[int]:
    """The runs that wrote packed recordings; their files are as few as their bytes allow."""
    return {int(file.rsplit("/", 2)[1].partition("=")[2]) for file in lines.inputFiles()}


def _placed(raw: DataFrame, skip: int, keep: bool) -> DataFrame:
    """Lines with their positions, without the first `skip` ones of each recording, or with `keep` only those."""
    packed = PACKED in raw.columns
    splits = raw.groupBy(F.col("_source").alias("_of"), F.col("_part").alias("_piece"), F.col("_split").alias("_at")).agg(
        F.min("_id").alias("_first"), (F.max("_id") - F.min("_id") + 1).alias("_lines")
    )
    # parts follow each other, and so do the splits of a part
    before = Window.partitionBy("_of").orderBy("_piece", "_at").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("_lines").over(before), F.lit(0)) - F.col("_first")
    splits = splits.select("_of", "_piece", "_at", shift.alias("_shift"))
    placed = raw.join(
        # packed parts are filled to their size, so that they have few splits
        F.broadcast(splits) if packed else splits,
        (F.col("_source") == F.col("_of")) & (F.col("_part") == F.col("_piece")) & (F.col("_split") == F.col("_at")),
    ).withColumn("line", F.col("_id") + F.col("_shift"))
    if not packed:
        skipped = F.col("line") < skip
        return placed.where(skipped if keep else ~skipped)
    if skip or keep:
        # a packed recording begins anywhere
        begins = placed.groupBy(F.col("file").alias("_of")).agg(F.min("line").alias("_begin"))
        placed = placed.drop("_of").join(begins, F.col("file") == F.col("_of"))
        skipped = F.col("line") < F.col("_begin") + skip
        placed = placed.where(skipped if keep else ~skipped)
    return placed


def place_lines(raw: DataFrame, skip: int = 0, keep: bool = False) -> DataFrame:
    """Columns `file`, `code`, `line` (position, growing within the file) and `text`.

    The first `skip` lines of each file are left out, or with `keep` all but those; of a recording in parts, those
    of its first part. Lines that are not needed should be filtered before: the table of splits is small, but where
    it is too large to broadcast the lines are shuffled.
    """
    return _placed(raw, skip, keep).select(
        "file",
        file_code(F.col("file")).alias("code"),
        "line",
        F.regexp_replace("text", "\r$", "").alias("text"),
    )


def read_lines(
    spark: SparkSession, path: str, include: str = "*", excludes: Sequence[str] = (), skip: int = 0, keep: bool = False
) -> DataFrame:
    """Placed lines of the files that match, without the first `skip` lines of each, or with `keep` only those."""
    return place_lines(list_inputs(spark, path, include, excludes), skip, keep)


def field(parts: Column, i: int) -> Column:
    """Part of a split line; NULL when the line is too short or the part is empty."""
    value = F.get(parts, F.lit(i))
    return F.when(F.trim(value) != "", value)


def write_lines(
    lines: DataFrame,
    path: str,
    header: DataFrame | None = None,
    by: str = "code",
    mode: str = "errorifexists",
    packed: bool = False,
) -> None:
    """Write lines (`by`, `line`, `text`) as one folder of text files per recording, in the order of `line`.

    `header` has the same columns; its lines come first and stay together, so that readers can skip them. Ranges
    follow the order of lines, so a large recording is written by many tasks, and its parts in name order make up
    the file. `mode` may also be `replace`: recordings among the lines are replaced whole, all others stay.
    A recording of a header alone is written too; lines without a recording or a text are left out.

    A folder per recording takes longer than its lines where recordings are many and short. With `packed` they follow
    one another in common parts, each line behind its recording's name and a tab; `list_inputs` tells them apart.
    """
    rows = lines.select(by, F.lit(1).alias("_body"), F.col("line").alias("_at"), F.col("text").alias("value"))
    rows = rows.withColumn("_range", F.col("_at"))
    if header is not None:
        head = header.select(by, F.lit(0).alias("_body"), F.col("line").alias("_at"), F.col("text").alias("value"))
        # all of a header has one place in the ranges, the lowest
        rows = rows.unionByName(head.withColumn("_range", F.lit(None).cast(rows.schema["_range"].dataType)))
    ordered = (
        rows.where(F.col(by).isNotNull() & F.col("value").isNotNull())
        .repartitionByRange(by, "_body", "_range")
        .sortWithinPartitions(by, "_body", "_at")
    )
    if packed:
        _write_packed(ordered, path, by, mode)
        return
    writer = ordered.select(by, "value").write.partitionBy(by)
    if mode == "replace":
        writer = writer.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    else:
        writer = writer.mode(mode)
    writer.text(path)


def _write_packed(ordered: DataFrame, path: str, by: str, mode: str) -> None:
    run = 0
    if mode == "replace":
        mode = "append"  # to what a run that broke off may have left
        try:
            run = max(_runs(ordered.sparkSession.read.text(path)), default=-1) + 1
        except AnalysisException:
            pass  # nothing is there
    name = F.concat(F.url_encode(F.col(by).cast("string")), F.lit("\t"))
    # each line of a text with line breaks is one of the recording
    value = F.col("value")
    several = F.regexp_replace(value, F.lit(r"(\r\n|\n|\r(?!\z))"), F.concat(F.lit("$1"), name))
    text = F.when(value.contains("\n") | value.contains("\r"), several).otherwise(value)
    ordered.select(F.concat(name, text).alias("value")).write.mode(mode).text(f"{path.rstrip('/')}/{PACKED}={run}")
