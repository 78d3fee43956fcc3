"""Delimited tables with decimal commas, epoch tables, and everything that is written."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..functions.strings import decimal_comma, to_decimal_comma
from .lines import read_lines, write_lines

# Headings of the scored gaze tables.
MESSAGE_HEADINGS = {
    "RECORDING_SESSION_LABEL": "session",
    "TRIAL_LABEL": "trial",
    "CURRENT_MSG_TIME": "time",
    "CURRENT_MSG_TEXT": "text",
}
FIXATION_HEADINGS = {
    "RECORDING_SESSION_LABEL": "session",
    "TRIAL_LABEL": "trial",
    "CURRENT_FIX_START": "start",
    "CURRENT_FIX_END": "end",
    "CURRENT_FIX_X": "x",
    "CURRENT_FIX_Y": "y",
}
SACCADE_HEADINGS = {
    "RECORDING_SESSION_LABEL": "session",
    "TRIAL_LABEL": "trial",
    "CURRENT_SAC_START_TIME": "start",
    "CURRENT_SAC_END_TIME": "end",
    "CURRENT_SAC_START_X": "start_x",
    "CURRENT_SAC_END_X": "end_x",
    "CURRENT_SAC_START_Y": "start_y",
    "CURRENT_SAC_END_Y": "end_y",
    "CURRENT_SAC_CONTAINS_BLINK": "blink",
}

EPOCH_SCHEMA = "counter int, subjectNum int, paradigm int, angry int, trial int, P7 double, P8 double"


def parse_sr_table(raw: DataFrame, headings: Mapping[str, str], text: Sequence[str] = ("session", "trial", "text")) -> DataFrame:
    """Scored gaze table from text columns: `.` is missing, numbers have decimal commas."""
    out = []
    for column, name in headings.items():
        value = F.when(~F.col(column).isin(".", "NA"), F.col(column))
        if name == "blink":
            value = value.try_cast("boolean")
        elif name not in text:
            value = decimal_comma(value)
        out.append(value.alias(name))
    return raw.select(*out)


def scan_sr_table(spark: SparkSession, path: str, headings: Mapping[str, str]) -> DataFrame:
    """Scored gaze table by position of its columns."""
    schema = ", ".join(f"`{c}` string" for c in headings)
    raw = spark.read.csv(path, sep="\t", header=True, schema=schema, enforceSchema=True)
    return parse_sr_table(raw, headings)


def scan_csv2(spark: SparkSession, path: str, text: Sequence[str] = ("VP01s", "STARTED", "SD07_01")) -> DataFrame:
    """Questionnaire table: semicolons, decimal commas, the subject column renamed."""
    raw = spark.read.csv(path, sep=";", header=True)
    numbers = [c for c in raw.columns if c not in text]
    return raw.withColumns({c: decimal_comma(F.col(c)) for c in numbers}).withColumnRenamed("VP01s", "subject")


def scan_epochs(spark: SparkSession, path: str) -> DataFrame:
    """Epoch amplitudes, without the running subject counter."""
    return (
        spark.read.csv(path, header=True, schema=EPOCH_SCHEMA)
        .drop("counter")
        .withColumnRenamed("subjectNum", "subject_num")
    )


def sr_text(df: DataFrame, headings: Mapping[str, str]) -> DataFrame:
    """Table with the given headings and decimal commas, as text."""
    kinds = dict(df.dtypes)
    out = []
    for heading, name in headings.items():
        value = F.col(name)
        if kinds[name] in ("double", "float"):
            # whole numbers are written without a decimal part
            value = F.regexp_replace(to_decimal_comma(value), ",0$", "")
        elif kinds[name] == "boolean":
            value = F.upper(value.cast("string"))
        out.append(F.coalesce(value.cast("string"), F.lit("NA")).alias(heading))
    return df.select(*out)


def write_sr_tables(df: DataFrame, path: str, headings: Mapping[str, str], swapped: bool = False) -> None:
    """Write messages, fixations or saccades as tab-separated text with decimal commas.

    With `swapped`, the saccade columns END_X and START_Y hold each other's values, for programs that
    expect the old order.
    """
    table = sr_text(df, headings)
    if swapped:
        end_x, start_y = "CURRENT_SAC_END_X", "CURRENT_SAC_START_Y"
        table = table.withColumns({end_x: F.col(start_y), start_y: F.col(end_x)})
    table.write.csv(path, sep="\t", header=True, quote="", emptyValue="")


def corrected_markers(markers: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """Marker rows to write: inverted and all dual-probe subjects, without those that are done."""
    rows = markers.where(F.col("inverted") | F.col("subject").startswith("b"))
    return rows if done is None else rows.join(done.select("subject").distinct(), ["subject"], "left_anti")


def write_markers(
    spark: SparkSession, markers: DataFrame, originals: str, path: str, include: str = "*.vmrk", packed: bool = False
) -> None:
    """Corrected marker files, one folder per subject (or `packed`): 12 header lines as they were, then the markers.

    The originals stay untouched. Subjects count as done when `path/_done` names them, which is written last: a
    subject of a run that broke off is written whole by the next run, in place of what is there.
    """
    finished = f"{path.rstrip('/')}/_done"
    try:
        done = spark.read.schema("subject string").parquet(finished)
    except AnalysisException:
        done = None
    rows = corrected_markers(markers, done)
    subjects = rows.select("subject").distinct()
    body = rows.select("subject", F.col("marker_num").alias("line"), F.col("output").alias("text"))
    header = (
        read_lines(spark, originals, include, ("_2", "_original"), skip=12, keep=True)
        .withColumnRenamed("code", "subject")
        .join(subjects, ["subject"], "left_semi")
    )
    write_lines(body, path, header, by="subject", mode="replace", packed=packed)
    subjects.write.mode("append").parquet(finished)


def snapshot(df: DataFrame, path: str) -> DataFrame:
    """Store a stage table and go on from the stored rows."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)
