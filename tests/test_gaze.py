"""Gaze repair and event detection on hand-made samples and against a plain loop."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialmill.operators import gaze
from trialmill.operators.ordered import chunks_with_reach, place_in_order

from conftest import rows

FIELDS = gaze.FIELDS
PPD = 40.0


def sample_frame(spark, trials):
    """Trials as lists of (time, x, y, blink)."""
    data = [
        ("s", 1, n, float(t), None if x is None else float(x), None if y is None else float(y), bool(b))
        for n, trial in enumerate(trials)
        for t, x, y, b in trial
    ]
    return spark.createDataFrame(
        data, "subject string, block int, trial int, time double, x double, y double, blink boolean"
    )


def by_hand(trial, vth=30.0, ath=8000.0, refrac=50.0):
    """Fixations (start, end, x, y) and saccades (start, end, blink) of one trial."""
    t = [s[0] for s in trial]
    x, y = ([0.0 if s[k] is None else s[k] for s in trial] for k in (1, 2))
    speed = [0.0] + [
        np.hypot((x[i] - x[i - 1]) / PPD, (y[i] - y[i - 1]) / PPD) / ((t[i] - t[i - 1]) / 1000) for i in range(1, len(t))
    ]
    gain = [0.0] + [(speed[i] - speed[i - 1]) / ((t[i] - t[i - 1]) / 1000) for i in range(1, len(t))]
    flag = [speed[i] > vth or gain[i] > ath or trial[i][3] for i in range(len(t))]
    marked = [i for i, f in enumerate(flag) if f]
    inside = list(flag)
    groups = []
    for i in marked:
        if groups and t[i] - t[groups[-1][1]] < refrac:
            groups[-1][1] = i
        else:
            groups.append([i, i])
    for a, b in groups:
        inside[a : b + 1] = [True] * (b - a + 1)
    saccades = [
        (t[a], t[b], any(trial[i][3] for i in range(a, b + 1))) for a, b in groups if a > 0 and b < len(t) - 1
    ]
    fixations, run = [], []
    edges = [0, *[e for g in groups for e in (g[0], g[1] + 1)], len(t)]
    for a, b in zip(edges[::2], edges[1::2]):
        if b > a:
            run = range(a, b)
            fixations.append(
                (t[a], t[b - 1], float(np.mean([x[i] for i in run])), float(np.mean([y[i] for i in run])))
            )
    return fixations, saccades


def test_detection_matches_a_plain_loop(spark):
    rng = np.random.default_rng(8)
    trials = []
    for _ in range(25):
        n = int(rng.integers(1, 80))
        x = np.repeat(rng.normal(900, 200, n), 9)[:n] + rng.normal(0, 3, n)
        y = np.repeat(rng.normal(600, 80, n), 9)[:n] + rng.normal(0, 3, n)
        blink = rng.random(n) < 0.03
        trials.append([(10.0 * i, None if b else a, None if b else c, b) for i, (a, c, b) in enumerate(zip(x, y, blink))])
    df = sample_frame(spark, trials)
    fix = gaze.detect_fixations(df, PPD).collect()
    sac = gaze.detect_saccades(df, PPD).collect()
    for n, trial in enumerate(trials):
        fixations, saccades = by_hand(trial)
        have = sorted((r.start, r.end, r.x, r.y) for r in fix if r.trial == n)
        assert [h[:2] for h in have] == [f[:2] for f in fixations]
        assert np.allclose([h[2:] for h in have], [f[2:] for f in fixations], atol=0.0051)
        assert sorted((r.start, r.end, r.blink) for r in sac if r.trial == n) == saccades


def still(n, step=1.0):
    return [[step * i, 100.0, 100.0, False] for i in range(n)]


def test_gap_of_fifty_parts_saccades(spark):
    near, far = still(200), still(200)
    for trial, second in ((near, 99), (far, 100)):
        trial[50][3] = trial[second][3] = True
    runs = rows(gaze.detect_saccades(sample_frame(spark, [near, far]), PPD).select("trial", "start", "end", "blink"))
    assert runs == [(0, 50.0, 99.0, True), (1, 50.0, 50.0, True), (1, 100.0, 100.0, True)]


def test_ends_and_empty_trials(spark):
    first, last, none, closed = still(100), still(100), still(100), still(100)
    first[0][3] = last[99][3] = True
    for s in closed:
        s[3] = True
    df = sample_frame(spark, [first, last, none, closed])
    assert rows(gaze.detect_saccades(df, PPD)) == []
    assert rows(gaze.detect_fixations(df, PPD).select("trial", "start", "end")) == [
        (0, 1.0, 99.0),
        (1, 0.0, 98.0),
        (2, 0.0, 99.0),
    ]


def test_saccade_positions_are_the_samples_around(spark):
    trial = [[4.0 * i, 100.0 if i < 30 else 200.0, 50.0, False] for i in range(60)]
    (one,) = gaze.detect_saccades(sample_frame(spark, [trial]), PPD).collect()
    assert (one.start, one.end, one.start_x, one.end_x) == (120.0, 120.0, 100.0, 200.0)


def eye_frame(spark, pupils, zero):
    """Samples with the left pupil position given; rows in `zero` are empty."""
    data = []
    for i, p in enumerate(pupils):
        values = [0.0] * 10 if i in zero else [float(p)] * 2 + [3.0] + [float(p)] * 2 + [3.0] + [float(p)] * 4
        data.append(("s", 1, 1, float(i), *values))
    schema = "subject string, block int, trial int, time double, " + ", ".join(f"{f} double" for f in FIELDS)
    return spark.createDataFrame(data, schema)


def test_only_single_gaps_inside_are_filled(spark):
    out = gaze.interpolate_gaps(eye_frame(spark, range(10, 20), {0, 3, 6, 7, 9})).orderBy("time").collect()
    assert [r.pos_l_x for r in out] == [0.0, 11.0, 12.0, 13.0, 14.0, 15.0, 0.0, 0.0, 18.0, 0.0]


def test_one_eye_stands_in(spark):
    data = [(2.0, 4.0, 2.0, 0.0), (0.0, 4.0, 0.0, 0.0)]
    df = spark.createDataFrame(data, "pos_l_x double, pos_r_x double, pos_l_y double, pos_r_y double")
    assert rows(gaze.merge_eyes(df).select("x", "y")) == [(3.0, 2.0), (4.0, 0.0)]


@pytest.mark.parametrize("offsets,flags", [((-2, 0, 2), {2, 4, 6}), ((-2, -1, 0, 1, 2), {2, 3, 4, 5, 6})])
def test_blinks_spread(spark, offsets, flags):
    df = gaze.merge_eyes(eye_frame(spark, range(10, 18), set()))
    df = df.withColumn("pupil_r_mm", F.when(F.col("time") == 4, 0.0).otherwise(3.0))
    out = gaze.mask_blinks(df, offsets).orderBy("time").collect()
    assert {i for i, r in enumerate(out) if r.blink} == flags
    assert all((r.x is None) == r.blink for r in out)


def test_alignment(spark):
    samples = spark.createDataFrame([("s", 1, 1, t) for t in (1000, 1250, 5000)], "subject string, block int, trial int, time long")
    messages = spark.createDataFrame([("s", 1, 1, 4250), ("s", 1, 2, 9000)], "subject string, block int, trial int, time long")
    assert [r.t for r in gaze.align_trial(samples).orderBy("time").collect()] == [0.0, 0.2, 4.0]
    onsets = {r.trial: r.onset for r in gaze.message_onsets(samples, messages).collect()}
    assert onsets == {1: 3.2, 2: None}


def test_dispersion(spark):
    # two still stretches with a jump between them, a third one close to the second
    x = [100.0] * 30 + [400.0] * 30 + [470.0] * 30
    trial = [(10.0 * i, v, 50.0, False) for i, v in enumerate(x)]
    df = sample_frame(spark, [trial])
    out = gaze.detect_dispersion(df, amplitude=10.0)
    fix = sorted((r.start, r.end, r.x) for r in out.collect() if r.kind == "fixation")
    assert fix == [(0.0, 290.0, 100.0), (300.0, 590.0, 400.0), (600.0, 870.0, 470.0)]
    merged = sorted((r.start, r.end) for r in gaze.detect_dispersion(df, amplitude=100.0).collect() if r.kind == "fixation")
    assert merged == [(0.0, 290.0), (300.0, 870.0)]
    blinked = [(*s[:3], i == 60) for i, s in enumerate(trial)]
    kept = gaze.detect_dispersion(sample_frame(spark, [blinked]), amplitude=100.0).collect()
    assert sorted((r.start, r.end, r.blink) for r in kept if r.kind == "saccade") == [
        (290.0, 300.0, False),
        (590.0, 610.0, True),
    ]


def recording(seed, n):
    """A recording of `n` samples: still stretches of any length, noise, blinks and a long stay at one place."""
    rng = np.random.default_rng(seed)
    stays = rng.choice([3, 9, 40, 200], n)
    x = np.repeat(rng.normal(900, 200, n), stays)[:n] + rng.normal(0, 3, n)
    y = np.repeat(rng.normal(600, 80, n), stays)[:n] + rng.normal(0, 3, n)
    x[n // 3 : n // 2], y[n // 3 : n // 2] = 500.0, 400.0
    blink = rng.random(n) < 0.01
    blink[n // 3 + 5 : n // 2 - 5] = False
    return [(4.0 * i, None if b else a, None if b else c, bool(b)) for i, (a, c, b) in enumerate(zip(x, y, blink))]


@pytest.mark.parametrize("task_rows", [11, 100])
def test_recordings_are_cut_without_a_trace(spark, task_rows):
    df = sample_frame(spark, [recording(1, 400), recording(2, 90), recording(3, 9)])
    for detect in (gaze.detect_fixations, gaze.detect_saccades):
        assert rows(detect(df, PPD, task_rows=task_rows)) == rows(detect(df, PPD))


def test_cleaning_is_cut_without_a_trace(spark):
    pupils = [0 if i % 7 == 3 else i for i in range(60)]
    df = eye_frame(spark, pupils, {0, 3, 6, 7, 20, 59}).withColumn("pupil_r_mm", F.when(F.col("time") % 13 == 4, 0.0).otherwise(3.0))
    clean = lambda **cut: gaze.mask_blinks(gaze.merge_eyes(gaze.interpolate_gaps(df, **cut)), **cut)
    assert rows(clean(task_rows=5)) == rows(clean())


@pytest.mark.parametrize("task_rows", [2, 7])
def test_recordings_are_cleaned_without_a_trace(spark, task_rows):
    pupils = [0 if i % 7 == 3 else i for i in range(60)]
    df = eye_frame(spark, pupils, {0, 3, 6, 7, 20, 59}).withColumn("pupil_r_mm", F.when(F.col("time") % 13 == 4, 0.0).otherwise(3.0))
    df = df.unionByName(df.where("time < 9").withColumn("subject", F.lit(None).cast("string"))).repartition(5)
    want = gaze.mask_blinks(gaze.merge_eyes(gaze.interpolate_gaps(df)))
    have = gaze.clean_recordings(df, gaze.TRIAL, task_rows=task_rows)
    key = lambda r: tuple(map(repr, r))
    assert sorted(have.select(want.columns).collect(), key=key) == sorted(want.collect(), key=key)
    # no chunk is larger than asked for, whatever the recording
    placed = place_in_order(df, gaze.TRIAL, ["time"], task_rows)
    chunks = chunks_with_reach(placed, task_rows, 3, 3).groupBy("_chunk").count()
    assert chunks.agg(F.max("count")).first()[0] == task_rows + 6
