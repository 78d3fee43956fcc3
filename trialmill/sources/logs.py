"""Parsers for behaviour logs, marker files, impedance blocks and gaze exports.

Each parser works on lines (`file`, `code`, `line`, `text`), so that it runs on files and on tables of
lines alike. The `scan_*` functions read files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.strings import file_code, paradigm_of
from ..operators.gaze import FIELDS
from ..operators.ordered import RowNumber, RunningSum, with_ordered
from .lines import field, list_inputs, place_lines, read_lines

# Files that hold no usable recording.
SKIP_LOGS = ("_0", "Pre.log")
SKIP_SEQUENCES = ("_0", "test", "calib")
SKIP_MARKERS = ("_2", "_original")


def parse_event_log(lines: DataFrame) -> DataFrame:
    """Tab-separated log lines: session, trial, event type, code, time. Subject and block are one field."""
    parts = F.split("text", "\t")
    session = F.split(field(parts, 0), "[^0-9A-Za-z]+")
    return lines.select(
        F.get(session, F.lit(0)).alias("subject"),
        F.get(session, F.lit(1)).try_cast("int").alias("block"),
        field(parts, 2).alias("event"),
        field(parts, 3).alias("code"),
        field(parts, 4).try_cast("long").alias("time"),
        "line",
    ).where(F.col("event").isNotNull())


def scan_event_log(spark: SparkSession, path: str) -> DataFrame:
    """Behaviour logs of all sessions, three header lines skipped."""
    lines = read_lines(spark, path, "*.log", SKIP_LOGS, skip=3)
    return parse_event_log(lines).where(F.col("event") != "Event Type")


def scan_sequences(spark: SparkSession, path: str) -> DataFrame:
    """Planned trials of all sessions, with the trial number over both blocks."""
    lines = read_lines(spark, path, "*.txt", SKIP_SEQUENCES, skip=1)
    return parse_sequences(lines)


def parse_sequences(lines: DataFrame) -> DataFrame:
    """Tab-separated lines: condition, soa, pictures, targets, iti."""
    parts = F.split("text", "\t")
    session = F.split("code", "[^0-9A-Za-z]+")
    rows = lines.where(F.trim("text") != "").select(
        F.get(session, F.lit(0)).alias("subject"),
        F.get(session, F.lit(1)).try_cast("int").alias("block"),
        field(parts, 0).try_cast("int").alias("condition"),
        field(parts, 1).try_cast("int").alias("soa"),
        field(parts, 2).alias("distractor_left"),
        field(parts, 3).alias("distractor_right"),
        field(parts, 4).alias("target_left"),
        field(parts, 5).alias("target_right"),
        field(parts, 6).try_cast("int").alias("iti"),
        "line",
    )
    in_block = with_ordered(rows, ["subject", "block"], ["line"], {"_row": RowNumber()})
    sizes = rows.groupBy("subject", "block").agg(F.count(F.lit(1)).alias("_size"))
    summed = with_ordered(sizes, ["subject"], ["block"], {"_upto": RunningSum(F.col("_size"))}, bounded=True)
    offsets = summed.select("subject", "block", (F.col("_upto") - F.col("_size")).alias("_offset"))
    return (
        in_block.join(offsets, ["subject", "block"])
        .withColumn("trial", F.col("_row") + F.col("_offset"))
        .drop("_row", "_offset", "line")
    )


def parse_markers(lines: DataFrame) -> DataFrame:
    """Comma-separated stimulus markers; the letter and blanks before the code are dropped."""
    parts = F.split("text", ",")
    return (
        lines.select(
            F.col("code").alias("subject"),
            field(parts, 0).alias("marker"),
            F.regexp_replace(field(parts, 1), r"S\s*", "").try_cast("int").alias("value"),
            F.trim(field(parts, 2)).try_cast("long").alias("sample"),
            F.trim(field(parts, 3)).try_cast("int").alias("size"),
            F.trim(field(parts, 4)).try_cast("int").alias("channel"),
            "line",
        )
        .where(F.col("marker").contains("Stimulus"))
        .withColumn("paradigm", paradigm_of(F.col("subject")))
    )


def scan_markers(spark: SparkSession, path: str, include: str = "*.vmrk") -> DataFrame:
    """Marker files of the first recording of each subject."""
    return parse_markers(read_lines(spark, path, include, SKIP_MARKERS, skip=11))


def parse_impedances(lines: DataFrame) -> DataFrame:
    """Impedance block of header files: from the last line that names the first electrode on.

    The first electrode may be named before, in the list of channels. A file `_2` was written after.
    """
    first = F.col("text").contains("Fp1")
    starts = lines.groupBy("code").agg(F.max(F.when(first, F.col("line"))).alias("_from"))
    parts = F.split(F.trim("text"), r"\s+")
    second = F.get(F.split("code", "_"), F.lit(1)).eqNullSafe("2")
    return (
        lines.join(starts, ["code"])
        .where(F.col("line") >= F.col("_from"))
        .select(
            F.regexp_replace("code", "_2", "").alias("subject"),
            F.col("code").alias("session"),
            F.when(second, "after").otherwise("before").alias("time"),
            F.regexp_replace(field(parts, 0), ":", "").alias("electrode"),
            field(parts, 1).try_cast("double").alias("impedance"),
        )
        .where(F.col("electrode").isNotNull())
    )


def scan_impedances(spark: SparkSession, path: str) -> DataFrame:
    """Electrode impedances of all recordings."""
    return parse_impedances(read_lines(spark, path, "*.vhdr"))


# Place of the read columns among the 46 of the export, from zero.
GAZE_COLUMNS = {
    "pupil_l_x": 7,
    "pupil_l_y": 8,
    "pupil_l_mm": 9,
    "pupil_r_x": 10,
    "pupil_r_y": 11,
    "pupil_r_mm": 12,
    "pos_l_x": 21,
    "pos_l_y": 22,
    "pos_r_x": 23,
    "pos_r_y": 24,
}


def _gaze_rows(lines: DataFrame, kind: str) -> DataFrame:
    """Rows of one kind, with the session and the time; header lines are of no kind."""
    session = F.split("code", "_")
    return (
        lines.withColumn("_tokens", F.split(F.trim("text"), r"\s+"))
        .where(F.get("_tokens", F.lit(1)) == kind)
        .withColumns(
            {
                "subject": F.get(session, F.lit(0)),
                "block": F.get(session, F.lit(1)).try_cast("int"),
                "time": F.get("_tokens", F.lit(0)).try_cast("long"),
            }
        )
    )


def parse_gaze(lines: DataFrame) -> DataFrame:
    """Sample rows of the gaze export; short rows are padded with NULL. Needs no line positions."""
    return _gaze_rows(lines, "SMP").select(
        "subject",
        "block",
        "time",
        *[F.get("_tokens", F.lit(GAZE_COLUMNS[f])).try_cast("double").alias(f) for f in FIELDS],
    )


def gaze_messages(lines: DataFrame) -> DataFrame:
    """Messages of the gaze export: tokens six to ten, numbered within the session."""
    rows = _gaze_rows(lines, "MSG").select(
        "subject",
        "block",
        "time",
        "line",
        F.concat_ws(" ", F.slice("_tokens", 6, 5)).alias("text"),
    )
    return with_ordered(rows, ["subject", "block"], ["line"], {"trial": RowNumber()}).drop("line")


def _session_code(lines: DataFrame) -> DataFrame:
    """The session is the file name up to its last blank."""
    return lines.withColumn("code", file_code(F.regexp_replace("file", "%20", " "), "/", " "))


def scan_gaze(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Samples and messages of all gaze exports.

    Samples, the bulk of the data, are told from the 38 header lines by their kind and ordered by their
    time, so they are read in one pass without a shuffle. Only messages get line positions.
    """
    raw = list_inputs(spark, path, "*.txt")
    messages = place_lines(raw.where(F.col("text").rlike(r"^\s*\S+\s+MSG(\s|$)")))
    return parse_gaze(_session_code(raw)), gaze_messages(_session_code(messages))
