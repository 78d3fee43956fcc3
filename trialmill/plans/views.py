"""The measurement streams, derived from the given tables by fixed rules.

Keys grow with the data (subjects, not trials per subject), as in a growing study. `reference_sql` states
the same rules in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import MEASURED
from ..functions.strings import paradigm_of
from ..operators import epochs as epoch_ops
from ..operators import gaze, ordered, trials
from ..operators.ordered import RowNumber, with_ordered

DAY_US = 86_400_000_000
BINS = (0.0, 100.0, 250.0, 400.0)
MASK_ROWS, MASK_COLS = 41, 401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: Column) -> Column:
    """Microseconds of a local timestamp, whatever the session's time zone."""
    return F.unix_micros(F.from_utc_timestamp(ts.cast("timestamp"), F.current_timezone()))


def div(col: Column, n: int) -> Column:
    """Whole quotient of non-negative numbers."""
    return F.floor(col / F.lit(n)).cast("long")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    user = F.col("user_id")
    letter = F.when(div(user, 2) % 2 == 0, "a").otherwise("b")
    us = micros(F.col("ts"))
    return events.select(
        F.concat(letter, user.cast("string")).alias("subject"),
        F.when(us < 1_705_363_200_000_000, 1).otherwise(2).alias("block"),
        us.alias("line"),
        "event_id",
        "event_type",
        "value",
    )


def marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event log of both paradigms."""
    e = F.col("event_id")
    dot = F.col("subject").startswith("a")
    sign = F.when(div(e, 2) % 2 == 0, ":").otherwise("..")
    text = lambda c: c.cast("string")
    left = F.when(dot, F.when(e % 2 == 0, sign).otherwise("NA")).otherwise(text(e % 4 + 1))
    right = F.when(dot, F.when(e % 2 == 1, sign).otherwise("NA")).otherwise(text(e % 4 + 6))
    angry_left = div(e, 4) % 2 == 0
    category = lambda angry: F.when(angry, "category1/").otherwise("category2/")
    distractors = F.concat(
        F.lit("distractors/"), category(angry_left), F.lit("F"), text(e % 40), F.lit(".jpg "), left,
        F.lit(" | "), category(~angry_left), F.lit("M"), text(e % 37), F.lit(".jpg "), right,
    )
    key = F.when(e % 11 == 0, F.lit("1")).otherwise(
        F.when(dot, text(e % 3 + 1)).otherwise(text(e % 8 + 4))
    )
    kind = F.col("event_type")
    code = (
        F.when(kind == "view", distractors)
        .when(kind == "click", F.lit("targets"))
        .when(kind == "purchase", key)
        .otherwise(F.lit("pause"))
    )
    return (
        _events(spark, sf_dir)
        .select(
            "subject",
            "block",
            F.when(kind == "purchase", "Response").otherwise("Picture").alias("event"),
            code.alias("code"),
            div(F.col("line"), 100).alias("time"),
            "line",
        )
    )


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planned trials: one per event of a subject."""
    e = F.col("event_id")
    picture = lambda n, angry: F.concat(
        F.lit("stim/"), F.when(angry, "AN").otherwise("NE"), (e % n).cast("string"), F.lit(".jpg")
    )
    plain = _events(spark, sf_dir).select(
        "subject",
        "block",
        "line",
        (F.lit(11) + e % 2 + div(e, 2) % 2 * 10).alias("condition"),
        F.when(e % 2 == 0, 100).otherwise(500).alias("soa"),
        (e % 500 + 1000).alias("iti"),
        picture(40, e % 4 < 2).alias("distractor_left"),
        picture(37, (e % 4 >= 2) | (e % 10 == 0)).alias("distractor_right"),
        (e % 4 + 1).cast("string").alias("target_left"),
        (e % 4 + 6).cast("string").alias("target_right"),
    )
    return trials.number_sequences(plain, ["line"]).drop("line")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored trials with the scheduled SOA."""
    from ..operators.joins import attach_sequence

    return attach_sequence(trials.scored_trials(marks(spark, sf_dir)), sequences(spark, sf_dir))


def markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trigger markers: one per event."""
    return _events(spark, sf_dir).select(
        "subject",
        paradigm_of(F.col("subject")).alias("paradigm"),
        (F.col("event_id") % 255 + 1).alias("value"),
        div(F.col("line"), 2000).alias("sample"),
        F.lit(1).alias("size"),
        F.lit(0).alias("channel"),
        "line",
    )


# a subject has 66 or 67 events on average, so about half of them count as inverted
EXPECTED_MARKERS = 66


def window_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages: the signups of a subject, numbered."""
    rows = _events(spark, sf_dir).where(F.col("event_type") == "signup")
    numbered = with_ordered(rows.select("subject", "line"), ["subject"], ["line"], {"trial": RowNumber()})
    return numbered.select("subject", "trial", F.col("line").alias("time"))


def window_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples: all other events."""
    rows = _events(spark, sf_dir).where(F.col("event_type") != "signup")
    return rows.select("subject", F.col("line").alias("time"), "event_id", "value")


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trials with a response time in every cell of the design."""
    flag = F.col("l_returnflag")
    angry = (flag == "A") | ((flag == "N") & (F.col("l_linenumber") % 2 == 0))
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("subject"),
        F.when(F.col("l_suppkey") % 2 == 0, "Dot Probe").otherwise("Dual Probe").alias("paradigm"),
        F.when(F.col("l_linestatus") == "F", 100).otherwise(500).alias("soa"),
        F.when(angry, "angry").otherwise("neutral").alias("congruency"),
        (F.col("l_extendedprice") / 100).alias("rt"),
        F.col("l_orderkey").alias("o1"),
        F.col("l_linenumber").alias("o2"),
        F.col("l_partkey").alias("o3"),
        F.col("l_extendedprice").alias("o4"),
    )


RESPONSE_ORDER = ["o1", "o2", "o3", "o4"]
CELL = ["subject", "paradigm", "soa", "congruency"]


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One trial per vector: 40 trials make a subject, 20 a block."""
    v = F.col("vec_id")
    number = div(v, 40)
    letter = F.when(number % 2 == 0, "a").otherwise("b")
    return table(spark, sf_dir, "embeddings").select(
        "vec_id",
        F.concat(letter, number.cast("string")).alias("subject"),
        F.when(v % 40 < 20, 1).otherwise(2).alias("block"),
        (v % 40 + 1).alias("trial"),
        F.transform("embedding", lambda x: x.cast("double")).alias("e"),
    )


def gaze_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Onset and conditions of each gaze trial."""
    v = F.col("vec_id")
    return _vectors(spark, sf_dir).select(
        "subject",
        "block",
        "trial",
        (v % 11 * 10 + 250).cast("double").alias("onset"),
        F.when(v % 2 == 0, 100).otherwise(500).alias("soa"),
        F.when(div(v, 2) % 2 == 0, "left").otherwise("right").alias("angry"),
        paradigm_of(F.col("subject")).alias("paradigm"),
    )


def raw_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both eyes every 10 ms; gaze jumps between the sides every 160 ms."""
    i, v = F.col("i"), F.col("vec_id")
    long = _vectors(spark, sf_dir).select(
        "vec_id", "subject", "block", "trial", "e", F.posexplode("e").alias("i", "now")
    )
    now, mirrored = F.col("now"), F.get("e", F.lit(63) - i)
    lead = F.get("e", (F.floor(i / 16) * 16).cast("int"))
    x = F.lit(960.0) + F.when(lead >= 0, 150.0).otherwise(-150.0) + now * 30.0
    y = F.lit(600.0) + mirrored * 30.0
    lost = (v + i) % 29 == 7
    one_eye = (v * 7 + i) % 17 == 0
    open_mm = F.when(F.abs(now) < 0.001, 0.0).otherwise(3.0)
    values = {
        "pupil_l_x": now * 10.0 + 500.0,
        "pupil_l_y": mirrored * 10.0 + 400.0,
        "pupil_l_mm": open_mm,
        "pupil_r_x": now * 10.0 + 700.0,
        "pupil_r_y": mirrored * 10.0 + 400.0,
        "pupil_r_mm": open_mm,
        "pos_l_x": x - 2.0,
        "pos_l_y": y - 2.0,
        "pos_r_x": F.when(one_eye, 0.0).otherwise(x + 2.0),
        "pos_r_y": F.when(one_eye, 0.0).otherwise(y + 2.0),
    }
    return long.select(
        "subject",
        "block",
        "trial",
        (i * 10).cast("double").alias("time"),
        *[F.when(lost, 0.0).otherwise(c).alias(n) for n, c in values.items()],
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned gaze: gaps filled, eyes merged, blinks masked."""
    cleaned = gaze.mask_blinks(gaze.merge_eyes(gaze.interpolate_gaps(raw_samples(spark, sf_dir))))
    return cleaned.select("subject", "block", "trial", "time", "x", "y", "blink")


def raw_recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The samples of both eyes as two recordings without trials: the sessions of a group follow one another."""
    session = F.regexp_extract("subject", r"(\d+)$", 1).cast("long")
    place = (session - session % 2) * 20 + (F.col("block") - 1) * 20 + (F.col("trial") - 1) % 20
    return raw_samples(spark, sf_dir).select(
        F.substring("subject", 1, 1).alias("recording"), (place * 640 + F.col("time")).cast("double").alias("time"), *gaze.FIELDS
    )


RECORDING = ["recording"]


def recordings(spark: SparkSession, sf_dir: str, task_rows: int | None = None) -> DataFrame:
    """Cleaned gaze of the recordings."""
    rows = task_rows or min(ordered.TASK_ROWS, gaze.CHUNK_SAMPLES)
    cleaned = gaze.clean_recordings(raw_recordings(spark, sf_dir), RECORDING, task_rows=rows)
    return cleaned.select("recording", "time", "x", "y", "blink")


PPD = MEASURED.px_per_degree


def fixations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detected fixations with onset and conditions."""
    found = gaze.detect_fixations(samples(spark, sf_dir), PPD)
    return found.join(gaze_messages(spark, sf_dir), ["subject", "block", "trial"])


def masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two picture masks per set: the left half is diagnostic in one and the right half in the other."""
    side = spark.range(MASK_ROWS).select((F.col("id") + 1).cast("int").alias("row"))
    cell = side.select("row", F.explode(F.sequence(F.lit(1), F.lit(MASK_COLS))).alias("col"))
    left, right = F.col("col") <= 120, F.col("col") >= 281
    roi = cell.withColumn("roi_id", F.explode(F.array(F.lit(0), F.lit(1))))
    diagnostic = F.when(F.col("roi_id") == 0, left).otherwise(right)
    kind = F.when(diagnostic, "diagnostic").when(left | right, "non_diagnostic")
    return roi.withColumn("kind", kind).where(F.col("kind").isNotNull())


def epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Epoch amplitudes as exported."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").cast("int").alias("subject_num"),
        (F.col("l_suppkey") % 2 + 1).cast("int").alias("paradigm"),
        F.when(F.col("l_linestatus") == "F", 1).otherwise(2).alias("angry"),
        F.col("l_linenumber").alias("trial"),
        (F.col("l_extendedprice") / 10000).alias("P7"),
        F.col("l_quantity").alias("P8"),
    )


def differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lateral difference per epoch, contralateral minus ipsilateral."""
    return epoch_ops.lateral_difference(epochs(spark, sf_dir), left_label="AN")


def impedances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Electrode impedances before and after."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("subject"),
        F.concat(F.lit("E"), F.col("l_linenumber").cast("string")).alias("electrode"),
        F.when(F.col("l_linestatus") == "F", "before").otherwise("after").alias("time"),
        F.when(F.col("l_tax") != 0, F.col("l_discount")).alias("impedance"),
    )


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questionnaire answers."""
    e = lambda i: F.get("embedding", F.lit(i)).cast("double")
    answer = lambda i: F.when(F.abs(e(i)) >= 0.03, e(i))
    label = F.col("label")
    return table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("q"), F.col("vec_id").cast("string")).alias("subject"),
        *[answer(i).alias(f"sias_{i + 1:02d}") for i in range(40)],
        *[answer(i).alias(f"FB02_{i - 39:02d}") for i in range(40, 64)],
        label.alias("SD01"),
        (label % 6).alias("SD02"),
        (label % 6).alias("SD03"),
        (label % 4).alias("SD04"),
        (label % 4).alias("SD06"),
        F.when(label == 3, F.lit("none")).alias("SD07_01"),
    )
