"""Trial building and scoring on a hand-made log."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialmill.operators import joins, shaping, summaries, trials
from trialmill.plans import views

from conftest import rows

LOG = "subject string, block int, event string, code string, time long, line long"
SHOWN = "distractors/category1/F1.jpg : | category2/G1.jpg NA"
FLIPPED = "category2/F2.jpg NA | distractors/category1/G2.jpg .."
DIGITS = "distractors/category2/F3.jpg 3 | category1/G3.jpg 8"


def log(spark, subject, *events):
    """Events as (block, event, code, time)."""
    data = [(subject, b, e, c, t, i) for i, (b, e, c, t) in enumerate(events)]
    return spark.createDataFrame(data, LOG)


@pytest.fixture(scope="module")
def dot(spark):
    p, r = "Picture", "Response"
    return log(
        spark, "a05",
        (1, r, "2", 0),  # before the first trial
        (1, p, SHOWN, 1000), (1, p, "pause", 1100), (1, p, "targets", 2000), (1, r, "2", 5000), (1, r, "3", 5200),
        (1, p, FLIPPED, 9000), (1, r, "1", 9100), (1, r, "3", 9200), (1, p, "targets", 14000),
        (2, r, "3", 20000),  # block starts with a response
        (2, p, SHOWN, 21000), (2, p, "targets", 26000),
    )


def test_steps(dot):
    numbered = trials.number_trials(trials.relevant_events(dot))
    assert [r.trial for r in numbered.orderBy("line").collect()] == [None, 1, None, None, None, 2, None, None, None, 3, None]
    filled = trials.fill_down(numbered, "trial")
    assert [(r.line, r.trial) for r in filled.orderBy("line").collect()] == [
        (1, 1), (3, 1), (4, 1), (5, 1), (6, 2), (8, 2), (9, 2), (11, 3), (12, 3),
    ]
    kept = trials.first_response(filled)
    assert [r.line for r in kept.orderBy("line").collect()] == [1, 3, 4, 6, 8, 9, 11, 12]
    fused = trials.trial_events(dot)
    columns = ["line", "trial", "event", "code"]
    assert rows(fused.select(columns)) == rows(kept.select(columns))


def test_scored_dot_probe(dot):
    t = trials.scored_trials(dot).orderBy("trial").collect()
    assert [(r.block, r.angry, r.target_dotprobe, r.congruency) for r in t] == [
        (1, "left", "left", "angry"),
        (1, "right", "right", "angry"),
        (2, "left", "left", "angry"),
    ]
    # odd subject: key 1 means ":"
    assert [(r.response, r.response_dotprobe, r.response_dual) for r in t] == [(1, True, None), (2, True, None), (None, None, None)]
    assert [(r.rt, r.exposure, r.soa) for r in t] == [(300.0, 100.0, 100), (-480.0, 500.0, 500), (None, 500.0, 500)]
    assert (t[0].distractor_left, t[0].distractor_right, t[1].distractor_right) == ("F1", "G1", "G2")


def test_even_subjects_have_the_other_keys(spark):
    events = [(1, "Picture", SHOWN, 0), (1, "Picture", "targets", 10), (1, "Response", "2", 20)]
    assert trials.scored_trials(log(spark, "a06", *events)).first().response_dotprobe is False


@pytest.mark.parametrize(
    "key,answer,side,congruency",
    [("6", 3, "left", "neutral"), ("10", 8, "right", "angry"), ("8", 6, "incorrect", "neutral"), ("x", None, None, None)],
)
def test_dual_probe(spark, key, answer, side, congruency):
    events = [(1, "Picture", DIGITS, 0), (1, "Picture", "targets", 10), (1, "Response", key, 20)]
    r = trials.scored_trials(log(spark, "b02", *events)).first()
    assert (r.response, r.response_dual, r.congruency, r.response_dotprobe) == (answer, side, congruency, None)


def test_large_subject_is_cut(dot, monkeypatch):
    whole = rows(trials.trial_table(dot))
    monkeypatch.setattr("trialmill.operators.ordered.TASK_ROWS", 2)
    assert rows(trials.trial_table(dot)) == whole


def test_missing_target(spark):
    events = [(1, "Picture", SHOWN, 0), (1, "Response", "2", 20)]
    r = trials.scored_trials(log(spark, "a01", *events)).first()
    assert (r.rt, r.exposure, r.soa) == (None, None, None)


def test_valid_trials(spark):
    data = [
        ("a1", "x", 100.0, True, None, 1.0),
        ("a1", "x", 100.0, False, None, 2.0),
        ("a1", None, 100.0, True, None, 3.0),
        ("a1", "x", None, True, None, 4.0),
        ("b1", "x", 100.0, None, "left", 5.0),
        ("b1", "x", 100.0, None, "incorrect", 6.0),
    ]
    df = spark.createDataFrame(data, "subject string, response string, exposure double, response_dotprobe boolean, response_dual string, rt double")
    assert rows(trials.valid_trials(df).select("rt")) == [(1.0,), (5.0,)]


def test_winsorize(spark):
    values = [1.0] * 20 + [100.0]
    df = spark.createDataFrame([("s", v) for v in values], "subject string, rt double")
    m, sd = sum(values) / 21, (sum((v - sum(values) / 21) ** 2 for v in values) / 20) ** 0.5
    out = [r.rt for r in summaries.winsorize_z(df, "rt").collect()]
    assert max(out) == pytest.approx(m + 2 * sd) and min(out) == 1.0
    single = summaries.winsorize_z(spark.createDataFrame([("s", 3.0)], "subject string, rt double"), "rt")
    assert single.first().rt == 3.0


def test_sequence_conditions(spark):
    data = [
        ("a1", 1, 100, "p/AN1.jpg", "p/NE1.jpg"),
        ("a1", 1, 500, "p/NE1.jpg", "p/AN1.jpg"),
        ("b1", 1, 100, "p/NE1.jpg", "p/NE2.jpg"),
    ]
    df = spark.createDataFrame(data, "subject string, condition int, soa int, distractor_left string, distractor_right string")
    out = trials.sequence_conditions(df).select("condition", "angry", "distractor_left").collect()
    assert [tuple(r) for r in out] == [(6, "left", "AN1"), (1, "right", "NE1"), (1, None, "NE1")]


def test_rates_keep_missing_apart(spark):
    data = [("s1", "d", True), ("s1", "d", None), ("s2", "d", False), ("s3", "e", None)]
    df = spark.createDataFrame(data, "subject string, paradigm string, wrong boolean")
    skip = {r.paradigm: r for r in summaries.conditional_rates(df, F.col("wrong"), "w", skip_missing=True).collect()}
    assert (skip["d"].w_n_m, skip["d"].w_p_m, skip["e"].w_n_m, skip["e"].w_p_m) == (0.5, 0.5, 0.0, None)
    strict = {r.paradigm: r for r in summaries.conditional_rates(df, F.col("wrong"), "w").collect()}
    assert (strict["d"].w_n_m, strict["e"].w_p_m) == (None, None)


def test_summaries(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", None), ("b", 2.0)], "g string, v double")
    assert rows(summaries.mean_se(df, "v", ["g"], na_rm=False)) == [("a", 2.0, 1.0, 2), ("b", None, None, 1)]
    assert rows(summaries.mean_se(df, "v", ["g"])) == [("a", 2.0, 1.0, 2), ("b", 2.0, None, 1)]
    assert rows(summaries.describe_long(df, ["v"])) == [("v", None, None, None, None)]
    assert rows(summaries.describe_long(df, ["v"], strict=False)) == [("v", 2.0, 1.0, 1.0, 3.0)]
    assert rows(summaries.value_counts(df, "g", levels=["a", "b", "c"])) == [("a", 2, 0.5), ("b", 2, 0.5), ("c", 0, 0.0)]
    assert rows(summaries.value_counts(df, "v", denominator="g").where("v = 1")) == [(1.0, 1, 0.5)]
    assert rows(summaries.count_check(df, ["g"], 2)) == []


def test_quantiles(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 2, 2, 10, 20]] + [(None,)], "v double")
    out = {r.prob: r.value for r in summaries.quantiles(df, "v", [0.0, 0.25, 0.5, 0.9, 1.0]).collect()}
    assert out == {0.0: 1.0, 0.25: 2.0, 0.5: 2.0, 0.9: 15.0, 1.0: 20.0}


def test_retention_counts_subjects_without_rows(spark):
    valid = spark.createDataFrame([("a", 0.9)] * 3 + [("b", 0.9), ("b", 0.1)], "subject string, valid double")
    ids = spark.createDataFrame([("a",), ("b",), ("c",), ("c",)], "subject string")
    assert rows(summaries.retention(valid, ids, trials=4)) == [(1, 2, pytest.approx(1 / 3))]


def test_reshaping(spark):
    df = spark.createDataFrame([("s", 1, 9.0), ("s", 2, 9.0), ("s", 3, 1.0)], "k string, i int, v double")
    assert rows(shaping.top_row(df, ["k"], "v", ["i"])) == [("s", 1, 9.0)]
    assert rows(shaping.top_row(df, ["k"], "v", ["i"], lowest=True)) == [("s", 3, 1.0)]
    assert rows(shaping.pivot_factor(df, ["k"], {"i": [1, 4]}, "v", "v")) == [("s", 9.0, None)]
    assert shaping.sort_rows(df, "-i").first().i == 3
    windows = spark.createDataFrame([("s", 0.0, 5.0), ("s", 20.0, 30.0)], "k string, low double, high double")
    events = spark.createDataFrame([("s", -10.0, 0.0), ("s", 5.5, 19.9), ("s", -1.0, 40.0)], "k string, start double, end double")
    pairs = joins.interval_overlap_join(events, windows, ["k"], 4.0).select("start", "low")
    assert rows(pairs) == [(-10.0, 0.0), (-1.0, 0.0), (-1.0, 20.0)]


def test_long_intervals_take_few_rows(spark):
    rng = random.Random(4)
    make = lambda n: [(k, s, s + length) for k, s, length in (
        (rng.choice("xy"), rng.randrange(-400, 400) / 4, rng.choice([0.0, 0.5, 3.0, 7.75, 60.0, 500.0, 4_000.0])) for _ in range(n))]
    left, right = make(120) + [("x", 5.0, 4.0), ("x", None, 1.0), (None, 0.0, 1.0)], make(120) + [("y", 1.0, None), (None, 0.0, 1.0)]
    events = spark.createDataFrame(left, "k string, start double, end double")
    windows = spark.createDataFrame(right, "k string, low double, high double")
    whole = [(k, a, b) for k, a, b in left if None not in (k, a, b) and a <= b]
    want = sorted((k, a, b, c, d) for k, a, b in whole for m, c, d in right if k == m and d is not None and b >= c and a <= d)
    for longest in (None, 2.0, 8_000.0):
        out = joins.interval_overlap_join(events, windows, ["k"], 1.0, longest=longest)
        assert sorted(map(tuple, out.select("k", "start", "end", "low", "high").collect())) == want
    for first, n in ((0, 1_000_000), (-777_777, 1_000_000), (123, 1), (-1, 2)):
        nodes = spark.range(1).select(F.inline(joins.dyadic_nodes(F.lit(first).cast("long"), F.lit(first + n - 1).cast("long"), F.lit(20)))).collect()
        leaves = sorted(i for r in nodes for i in (r.place << r.level, ((r.place + 1) << r.level) - 1))
        assert len(nodes) <= 40 and sum(1 << r.level for r in nodes) == n and (leaves[0], leaves[-1]) == (first, first + n - 1)


def test_window_join_keeps_both_trials(spark):
    samples = spark.createDataFrame([("s", 1, t) for t in (0, 999, 1000, 2400, 2500, 2501)], "subject string, block int, time long")
    messages = spark.createDataFrame([("s", 1, 1, 2000), ("s", 1, 2, 3400)], "subject string, block int, trial int, time long")
    out = joins.trial_window_join(samples, messages, pre=1000, post=500)
    assert rows(out.select("trial", "time")) == [(1, 1000), (1, 2400), (1, 2500), (2, 2400), (2, 2500), (2, 2501)]


def test_clamp_drops_rows_without_bound(spark):
    data = [(-50.0, 60.0, 100), (90.0, 300.0, 100), (120.0, 140.0, 100), (0.0, 50.0, None)]
    df = spark.createDataFrame(data, "start double, end double, soa int")
    out = shaping.clamp_interval(df, "start", "end", F.lit(0.0), F.col("soa"))
    assert rows(out.select("start", "end", "dur")) == [(0.0, 60.0, 60.0), (90.0, 100.0, 10.0)]


@pytest.mark.parametrize("part_values", [1, 7, 1_000_000])
def test_quantiles_by_group(spark, part_values):
    draw = np.random.default_rng(3)
    groups = {
        "even": draw.normal(0, 1, 400),
        "close": 1.0 + draw.integers(0, 60, 300) * 2.0**-52,
        "wide": np.concatenate([10.0 ** draw.uniform(-300, 300, 150), -(10.0 ** draw.uniform(-300, 300, 150)), [5e-324, -0.0, 0.0]]),
        "equal": np.full(50, 2.5),
        "one": np.array([7.0]),
        None: np.array([1.0, 2.0, 4.0]),
    }
    data = [(g, float(v)) for g, values in groups.items() for v in values] + [("even", None), ("none", None)]
    df = spark.createDataFrame(data, "g string, v double").repartition(5)
    probs = [0.0, 0.013, 0.5, 0.77, 1.0]
    out = {(r.g, r.prob): r.value for r in summaries.quantiles(df, "v", probs, ["g"], part_values).collect()}
    assert set(out) == {(g, p) for g in groups for p in probs}
    for g, values in groups.items():
        ordered = sorted(values)
        for p in probs:
            place = (len(ordered) - 1) * p
            low, high = ordered[math.floor(place)], ordered[min(math.floor(place) + 1, len(ordered) - 1)]
            assert out[g, p] == low + (high - low) * (place - math.floor(place))


def test_quantiles_of_nothing_and_of_extremes(spark):
    none = summaries.quantiles(spark.createDataFrame([], "v double"), "v", [0.0, 0.5]).collect()
    assert sorted(tuple(r) for r in none) == [(0.0, None), (0.5, None)]
    assert summaries.quantiles(spark.createDataFrame([], "g int, v double"), "v", [0.5], ["g"]).count() == 0
    values = [(float(v),) for v in ("-inf", "-1", "2", "inf", "nan")]
    df = spark.createDataFrame(values, "v double")
    out = {r.prob: r.value for r in summaries.quantiles(df, "v", [0.25, 0.5], part_values=1).collect()}
    assert out == {0.25: -1.0, 0.5: 2.0}
    assert math.isnan(summaries.quantiles(df, "v", [1.0]).first().value)


def test_packed_masks_answer_like_cells(spark):
    rng = np.random.default_rng(3)
    cells = [(int(p), int(r), int(c), k) for k in ("in", "out") for p, r, c in rng.integers((0, -3, -130), (3, 5, 400), (900, 3))]
    schema = "roi_id int, row int, col int, kind string"
    masks = spark.createDataFrame([*cells, *cells[:50], (0, 0, None, "in"), (None, 0, 0, "in"), (1, 1, 1, "other")], schema)
    looked = [(int(p), int(r), int(c)) for p, r, c in rng.integers((0, -4, -200), (4, 6, 460), (4000, 3))]
    looked += [(p, r, c) for p, r, c, _ in cells] + [(0, 0, None), (None, 0, 0), (0, None, 5)]
    df = spark.createDataFrame([(*at, "x") for at in looked], "roi_id int, row int, col int, kind string")
    want = sorted((str(at), *[(*at, k) in cells and None not in at for k in ("in", "out")]) for at in looked)
    packed = joins.pack_masks(masks, ["in", "out"])
    for table in (masks, packed):
        found = joins.roi_lookup(df, table, ["in", "out"]).collect()
        assert sorted((str((r.roi_id, r.row, r.col)), r.in_in, r.in_out) for r in found) == want


def test_masks_shrink_fiftyfold(spark):
    masks = views.masks(spark, "")
    assert joins.pack_masks(masks, ["diagnostic", "non_diagnostic"]).count() * 50 <= masks.count()
