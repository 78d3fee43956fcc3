"""Dispersion in chunks against the plain scan of a whole recording."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialmill.operators import dispersion, gaze

from conftest import rows
from test_gaze import recording, sample_frame

WIDEST = 50.0


def scanned_in_chunks(x, y, blink, shortest, size):
    """The steps of the operator in a plain loop over the chunks."""
    n = len(x)
    box = (x, np.where(blink, np.inf, x), y, y)
    starts = range(0, n, size)
    parts = [dispersion._at(box, slice(s, s + size)) for s in starts]
    told = [{"_chunk": k} | dispersion.extents(b, s, WIDEST) for k, (s, b) in enumerate(zip(starts, parts))]
    settled = dispersion.resolve(told, n, shortest, WIDEST, size)
    exits, ways = [], []
    for start, b, row in zip(starts, parts, settled):
        to, still = dispersion.pointers(b, start, row, n, shortest, WIDEST)
        ways.append((to, still))
        last = dispersion.leave(to, start)
        for entry in row["entries"]:
            end = last[entry - start]
            exits.append({"entry": entry, "last": end + start, "still": still[end], "leave": to[end]})
    found = {}
    for start, b, (to, still), row in zip(starts, parts, ways, dispersion.taken(exits, n, size, len(parts))):
        table = {"_time": np.arange(start, start + len(to)), "_shut": np.zeros(len(to), int)}
        column = type("T", (), {"column": lambda self, c: type("C", (), {"to_numpy": lambda _: table[c]})()})()
        for a, last, count, *_ in dispersion.parts(column, b, to, still, start, row["entry"], row["origin"]):
            found[a] = found.get(a, 0) + count
            assert a + found[a] - 1 == last
    return [(a, a + k - 1) for a, k in sorted(found.items())]


def test_reach_against_a_loop():
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 17, 64, 200):
        x, y, blink = rng.normal(0, 15, n).round(), rng.normal(0, 5, n).round(), rng.random(n) < 0.05
        want = []
        for i in range(n):
            j = i
            while j < n and not blink[i : j + 1].any() and np.ptp(x[i : j + 1]) + np.ptp(y[i : j + 1]) < WIDEST:
                j += 1
            want.append(j)
        assert dispersion.reach((x, np.where(blink, np.inf, x), y, y), WIDEST).tolist() == want


@pytest.mark.parametrize("shortest", [1, 2, 5, 20])
def test_chunks_of_any_size_give_the_plain_scan(shortest):
    rng = np.random.default_rng(shortest)
    for case in range(150):
        n = int(rng.integers(1, 160))
        stay = int(rng.choice([1, 4, 12, 60, 200]))
        x = np.repeat(rng.normal(0, 60, n), stay)[:n] + rng.normal(0, 6, n)
        y = np.repeat(rng.normal(0, 20, n), stay)[:n]
        blink = rng.random(n) < rng.choice([0.0, 0.01, 0.2])
        want = list(gaze.dispersion_windows(x, y, blink, shortest, WIDEST))
        for size in (1, 2, 3, 7, 32, 1000):
            assert scanned_in_chunks(x, y, blink, shortest, size) == want, (case, size)


@pytest.mark.parametrize("size", [7, 64, 10_000])
def test_recordings_agree_with_the_scan_of_a_trial(spark, size):
    keys = gaze.TRIAL
    df = sample_frame(spark, [recording(4, 900), recording(5, 130), recording(6, 2), recording(7, 1)])
    df = df.withColumn("subject", F.when(F.col("trial") != 1, F.col("subject")))  # a missing key is a key like any other
    df = df.withColumn("label", F.lit("extra"))
    want = gaze.detect_dispersion(df, amplitude=30.0)
    have = dispersion.detect_dispersion_recordings(df, amplitude=30.0, keys=keys, chunk_samples=size)
    assert have.columns == want.columns
    assert rows(have) == rows(want)
    assert want.where("kind = 'saccade'").count() > 10


def test_recordings_without_rate_give_nothing(spark):
    df = sample_frame(spark, [[(0.0, 1.0, 1.0, False)] * 40, [(0.0, 1.0, 1.0, False)]])
    find = lambda frame: dispersion.detect_dispersion_recordings(frame, amplitude=30.0, keys=gaze.TRIAL)
    assert rows(find(df)) == [] == rows(find(df.limit(0)))
