"""Markers, impedances and epochs on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from trialmill.operators import epochs, markers, summaries
from trialmill.sources import tables

from conftest import rows

SCHEMA = "subject string, paradigm string, value int, sample long, size int, channel int, line long"


def frame(spark, *subjects):
    """Subjects as (code, values, samples)."""
    data = []
    for code, values, samples in subjects:
        paradigm = "Dot Probe" if code.startswith("a") else "Dual Probe"
        data += [(code, paradigm, v, s, 1, 0, i) for i, (v, s) in enumerate(zip(values, samples))]
    return spark.createDataFrame(data, SCHEMA)


def test_repair(spark):
    df = frame(spark, ("a1", [11, 99, 16, 99], range(4)), ("a2", [244, 255, 156, 255, 239], range(5)))
    out = markers.repair_markers(df, expected=4)
    assert rows(out.select("subject", "marker_num", "value", "inverted")) == [
        ("a1", 2, 11, False), ("a1", 3, 99, False), ("a1", 4, 16, False), ("a1", 5, 99, False),
        ("a2", 2, 11, True), ("a2", 3, 99, True), ("a2", 4, 16, True),
    ]


def test_dual_recoding(spark):
    # stimuli: 17 at the short SOA, 17 at the long one, 94 + 5, 112, 100
    df = markers.repair_markers(frame(spark, ("b1", [17, 88, 17, 99, 99, 88, 112, 99, 100, 88], range(10)), ("a1", [17, 99], range(2))))
    soa = [("b1", t, s) for t, s in [(1, 100), (2, 500), (3, 100), (4, 500), (5, 500)]] + [("a1", 1, 100)]
    plan = spark.createDataFrame(soa, "subject string, trial long, soa int")
    out = markers.recode_dual_markers(df, plan).where("subject = 'b1'").orderBy("marker_num").collect()
    assert [r.value for r in out] == [6, 88, 1, 99, 6, 88, 2, 99, 100, 88]
    assert [r.soa for r in out] == [100, None, 500, None, 100, None, 500, None, 500, None]
    assert out[0].output == "Mk2=Stimulus,S6,0,1,0"
    a = markers.recode_dual_markers(df, plan).where("subject = 'a1'")
    assert rows(a.select("value")) == [(17,), (99,)]
    assert rows(tables.corrected_markers(markers.recode_dual_markers(df, plan)).select("subject").distinct()) == [("b1",)]
    done = spark.createDataFrame([("b1",)], "subject string")
    assert tables.corrected_markers(markers.recode_dual_markers(df, plan), done).count() == 0


def test_codes(spark):
    df = frame(spark, ("a1", [11, 1, 99], range(3)), ("b1", [11, 1, 88], range(3)))
    assert rows(markers.check_marker_codes(df).select("subject", "value")) == [("a1", 1), ("b1", 11)]


@pytest.mark.parametrize("samples,expected", [([0, 10, 20, 4000, 4010], (1, 3, 5)), ([0, 10, 20], (0, None, 3)), ([0, 3000, 6000], (2, None, 3))])
def test_break(spark, samples, expected):
    out = markers.break_index(frame(spark, ("a1", [1] * len(samples), samples)))
    assert rows(out) == [("a1", *expected)]


def test_latencies(spark):
    df = frame(spark, ("a1", [11, 99, 12, 96, 11], [0, 300, 1000, 1250, 3000]))
    trials = spark.createDataFrame([("a1", 1, 1), ("a1", 1, 2), ("a1", 2, 3)], "subject string, block int, trial long")
    plan = spark.createDataFrame([("a1", t, 100, 900) for t in (1, 2, 3)], "subject string, trial long, soa int, iti int")
    out = markers.marker_pairs(df, trials, plan).orderBy("trial").collect()
    assert [(r.value_stim, r.value_response) for r in out] == [(11, 99), (12, 96), (11, None)]
    assert [r.stim_to_resp for r in out] == [600.0, 500.0, None]
    assert [r.rt for r in out] == [500.0, 400.0, None]
    # the next trial counts within the block only
    assert [r.resp_to_next_stim for r in out] == [1400.0, None, None]
    assert [r.stim_to_next_resp for r in out] == [2500.0, None, None]


def test_impedances(spark):
    data = [("a1", "before", 5.0), ("a1", "before", None), ("a1", "after", 7.0), ("a2", "before", 5.0), ("a2", "after", 5.0), ("a3", "before", 1.0)]
    df = spark.createDataFrame(data, "subject string, time string, impedance double")
    assert rows(markers.impedance_change(df)) == [("a1", 5.0, 7.0)]


EPOCHS = [
    (5, 1, 1, 1, 1.0, 3.0),
    (5, 1, 1, 2, 2.0, 3.0),
    (5, 1, 2, 3, 1.0, 5.0),
    (5, 1, 2, 4, 1.0, 9.0),
    (12, 2, 1, 1, None, 3.0),
]
EPOCH_SCHEMA = "subject_num int, paradigm int, angry int, trial int, P7 double, P8 double"


def test_difference_labels(spark):
    df = spark.createDataFrame(EPOCHS, EPOCH_SCHEMA)
    asis = epochs.lateral_difference(df).select("subject", "angry", "odd_even", "n2pc")
    assert rows(asis) == [
        ("a05", "AN", "Even", -8.0), ("a05", "AN", "Odd", -4.0),
        ("a05", "NA", "Even", -1.0), ("a05", "NA", "Odd", -2.0), ("b12", "NA", "Odd", None),
    ]
    sided = epochs.lateral_difference(df, "AN").where("angry = 'AN'")
    assert rows(sided.select("n2pc")) == [(4.0,), (8.0,)]


def test_summary_weighs_sides_evenly(spark):
    df = epochs.lateral_difference(spark.createDataFrame(EPOCHS + [(5, 1, 2, 5, 0.0, 6.0)], EPOCH_SCHEMA))
    out = {r.subject: r for r in epochs.odd_even_summary(df).collect()}
    a = out["a05"]
    assert (a.n2pc_AN, a.n2pc_NA, a.n2pc) == (-6.0, -1.5, -3.75)
    assert (a.n2pc_Odd, a.n2pc_Even, a.n2pc_AN_Odd) == (-3.5, -4.5, -5.0)
    assert (out["b12"].n2pc_NA, out["b12"].n2pc, out["b12"].n2pc_NA_Even) == (None, None, None)


def test_counts(spark):
    df = frame(spark, ("a1", [1, 1, 2], range(3)))
    assert rows(summaries.count_of_counts(df, "value")) == [(1, 1), (2, 1)]
    assert rows(summaries.count_check(df, ["subject"], 4)) == [("a1", 3)]
    assert df.where(F.col("value") == 1).count() == 2
