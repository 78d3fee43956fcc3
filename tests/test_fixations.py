"""Fixation summaries, regions and scales on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from trialmill.operators import fixations, roi, scales, summaries

from conftest import rows

FIX = "subject string, block int, trial int, start double, end double, x double, y double"


def test_session_trial(spark):
    df = spark.createDataFrame([("a05_1", "Trial: 3"), ("a05_2", "Trial: 3")], "session string, trial string")
    assert rows(fixations.session_trial(df).select("subject", "block", "trial")) == [("a05", 1, 3), ("a05", 2, 291)]


def test_flip(spark):
    df = spark.createDataFrame([(1.0, 200.0)], "x double, y double")
    assert rows(fixations.flip_y(df)) == [(1.0, 1000.0)]


@pytest.mark.parametrize(
    "subject,text,side,kind,congruency",
    [
        ("a1", "category1/F.jpg : | category2/G.jpg NA", "left", ":", "congruent"),
        ("a1", "category1/F.jpg NA | category2/G.jpg ..", "right", "..", "incongruent"),
        ("a1", "category1/F.jpg : | category2/G.jpg ..", "error", None, "incongruent"),
        ("b1", "category2/F.jpg 3 | category1/G.jpg 8", None, None, None),
    ],
)
def test_messages(spark, subject, text, side, kind, congruency):
    df = spark.createDataFrame([(subject, text)], "subject string, text string")
    r = fixations.message_conditions(df).first()
    assert (r.target_side, r.target_kind, r.congruency) == (side, kind, congruency)
    assert r.angry == ("left" if text.startswith("category1") else "right")


def test_valid_time(spark):
    data = [("s", 1, 1, 0.0, 150.0, 0.0, 0.0), ("s", 1, 1, 160.0, 900.0, 0.0, 0.0), ("s", 1, 2, 0.0, 90.0, 0.0, 0.0)]
    df = spark.createDataFrame(data, FIX).withColumns({"onset": F.lit(100.0), "soa": F.lit(100)})
    out = fixations.valid_time(fixations.exposure_fixations(df))
    assert rows(out.select("trial", "valid", "n")) == [(1, 0.9, 2)]


def test_baseline(spark):
    data = [
        ("s", 1, 1, 0.0, 250.0, 10.0, 0.0),  # 50 ms inside
        ("s", 1, 1, 300.0, 450.0, 50.0, 8.0),  # 150 ms inside
        ("s", 1, 1, 600.0, 700.0, 999.0, 9.0),
        ("s", 1, 2, 600.0, 700.0, 999.0, 9.0),
    ]
    messages = spark.createDataFrame([("s", 1, 1, 500.0), ("s", 1, 2, 500.0)], "subject string, block int, trial int, onset double")
    out = fixations.trial_baseline(spark.createDataFrame(data, FIX), messages)
    assert rows(out.select("trial", "x", "y")) == [(1, 40.0, 6.0), (2, None, None)]


def test_baseline_summary_counts_the_longest_block(spark):
    data = [("s", 1, 1, 0.0, 0.0, True), ("s", 1, 2, 150.0, 5.0, True), ("s", 1, 3, None, None, False), ("t", 1, 1, 0.0, 0.0, True)]
    base = spark.createDataFrame(data, "subject string, block int, trial int, x double, y double, ok boolean")
    messages = spark.createDataFrame([("s", 1, 1), ("s", 1, 4), ("t", 1, 1)], "subject string, block int, trial int")
    out = {r.subject: r for r in fixations.baseline_summary(base, messages).collect()}
    s, t = out["s"], out["t"]
    assert (s.n_trials, s.n_valid, s.invalid, s.missing, s.range_x, s.included) == (4, 2, 0.5, 0.5, 150.0, True)
    assert (t.invalid, t.missing, t.sd_x, t.included) == (0.75, 0.75, None, False)


def test_first_dwell(spark):
    data = [
        ("s", 1, 1, 0.0, 50.0, 700.0, 0.0),  # starts with the window
        ("s", 1, 1, 60.0, 90.0, 960.0, 0.0),  # centre
        ("s", 1, 1, 95.0, 120.0, 1060.0, 0.0),  # right: neutral, before onset
        ("s", 1, 1, 150.0, 200.0, 860.0, 0.0),  # left: angry
        ("s", 1, 2, 150.0, 200.0, 960.0, 0.0),
    ]
    df = spark.createDataFrame(data, FIX).withColumns(
        {"onset": F.lit(100.0), "soa": F.lit(100), "angry": F.lit("left"), "paradigm": F.lit("p")}
    )
    sided = fixations.roi_side(df)
    assert [r.roi for r in sided.orderBy("trial", "start").collect()] == ["angry", None, "neutral", "angry", None]
    assert fixations.first_dwell(sided).first().first_dwell_angry == 0.0
    assert fixations.first_dwell(sided, align=True).first().first_dwell_angry == 1.0
    none = fixations.first_dwell(sided.where("trial = 2"))
    assert rows(none.select("first_dwell_angry")) == [(None,)]


def test_roi_dwell(spark):
    # masks of 3 x 5 cells: diagnostic left of the middle, non-diagnostic right of it
    cells = [(0, "diagnostic", r, c) for r in (1, 2, 3) for c in (1, 2)]
    cells += [(0, "non_diagnostic", r, c) for r in (1, 2, 3) for c in (4, 5)]
    masks = spark.createDataFrame(cells, "roi_id int, kind string, row int, col int")
    data = [
        ("s", 1, 1, 90.0, 140.0, 105.0, 50.0),  # before onset: left out
        ("s", 1, 1, 150.0, 200.0, 108.6, 50.0),  # two cells left
        ("s", 1, 1, 200.0, 300.0, 111.9, 50.0),  # two cells right
        ("s", 1, 1, 310.0, 900.0, 500.0, 50.0),  # off the mask
        ("s", 1, 2, 0.0, 90.0, 110.0, 50.0),
    ]
    df = spark.createDataFrame(data, FIX).withColumns({"onset": F.lit(100.0), "roi_id": F.lit(0)})
    base = spark.createDataFrame(
        [("s", 1, 1, 110.04, 50.0, True), ("s", 1, 2, 0.0, 0.0, False)],
        "subject string, block int, trial int, x double, y double, ok boolean",
    )
    out = {r.trial: r for r in roi.roi_dwell(df, base, masks, [0, 100, 300], 300.0, 3, 5).collect()}
    r = out[1]
    assert (r.fix_n, r.ms, r.ms_non, r.diagnostic_first, r.roi_switch) == (3, 50.0, 100.0, True, 1)
    assert (r.dwell, r.dwell_non) == (pytest.approx(50 / 240), pytest.approx(100 / 150))
    assert (r.dwell_bin1, r.dwell_bin2) == (1.0, 0.0)
    assert (r.dwell_non_bin1, r.dwell_non_bin2) == (0.0, 1.0)
    assert r.fix_mean == pytest.approx(80.0) and r.scan_path > 0
    assert (out[2].fix_n, out[2].dwell, out[2].diagnostic_first) == (None, None, None)


def test_decline_drops_whole_subjects(spark):
    data = [("s", 1, t, 1 - t / 10) for t in range(1, 5)] + [("t", 1, t, 0.1 * t) for t in range(1, 5)]
    data += [("t", 2, 289, 0.5), ("u", 1, 1, 0.5)]
    df = spark.createDataFrame(data, "subject string, block int, trial int, valid double")
    out = fixations.valid_decline(df)
    assert [(r.subject, round(r.r, 9), r.n) for r in out.collect()] == [("s", -1.0, 4)]
    assert fixations.valid_decline(df, exclude=["s"]).count() == 0
    assert fixations.fisher_summary(out).first().r_m == pytest.approx(-0.999)


def test_item_score(spark):
    items = [f"sias_{i}" for i in range(5)]
    schema = "subject string, " + ", ".join(f"{c} int" for c in items)
    df = spark.createDataFrame([("a", 1, 2, 3, 4, None), ("b", 1, 2, 3, None, None), ("c", *[None] * 5)], schema)
    out = df.select("subject", scales.item_score(df, "sias", 0.2).alias("score"))
    assert rows(out) == [("a", 12.5), ("b", None), ("c", None)]


def test_unit_squeeze(spark):
    df = spark.createDataFrame([("s", 2, 290, 1.0), ("s", 1, 1, 0.0)], "subject string, block int, trial int, valid double")
    assert rows(summaries.unit_squeeze(df, "valid").select("trial", "valid")) == [(1, 0.25), (2, 0.75)]
