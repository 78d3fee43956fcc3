"""Chunked running values agree with plain windows, whatever the chunk size."""

import math
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from trialmill.operators.ordered import (
    Lag,
    LastValue,
    Lead,
    RowNumber,
    RunningSum,
    cut_large_groups,
    large_groups,
    with_ordered,
)


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(3)
    data = []
    for i in range(400):
        key = rng.choice(["hot"] * 6 + ["x", "y", "z"])
        data.append((key, rng.randrange(0, 60), i, rng.choice([None, 1, 2, 3]), rng.choice([0, 1])))
    data += [("one", 5, 1000, None, 1)]
    return spark.createDataFrame(data, "k string, t long, i long, v int, flag int").cache()


def plain(table):
    w = Window.partitionBy("k").orderBy("t", "i")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    return table.withColumns(
        {
            "rn": F.row_number().over(w).cast("long"),
            "total": F.coalesce(F.sum("v").over(upto), F.lit(0)),
            "seen": F.last("v", ignorenulls=True).over(upto),
            "seen_before": F.last("v", ignorenulls=True).over(before),
            "lag1": F.lag("v").over(w),
            "lead1": F.lead("v").over(w),
            "lag2": F.lag("v", 2).over(w),
            "lead3": F.lead("v", 3).over(w),
        }
    )


def all_specs():
    return {
        "rn": RowNumber(),
        "total": RunningSum(F.col("v")),
        "seen": LastValue(F.col("v")),
        "seen_before": LastValue(F.col("v"), strict=True),
        "lag1": Lag(F.col("v")),
        "lead1": Lead(F.col("v")),
        "lag2": Lag(F.col("v"), 2),
        "lead3": Lead(F.col("v"), 3),
    }


@pytest.mark.parametrize("task_rows", [7, 50, 10_000])
def test_matches_plain_windows(table, task_rows):
    got = with_ordered(table, ["k"], ["t", "i"], all_specs(), task_rows=task_rows)
    assert sorted(map(str, got.collect())) == sorted(map(str, plain(table).collect()))


@pytest.mark.parametrize("task_rows", [5, 10_000])
def test_single_step_specs(table, task_rows):
    specs = {n: all_specs()[n] for n in ("rn", "total", "seen", "lag1", "lead1")}
    got = with_ordered(table, ["k"], ["t", "i"], specs, task_rows=task_rows)
    want = plain(table).select(got.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_without_groups(table):
    got = with_ordered(table, [], ["t", "i"], {"rn": RowNumber()}, task_rows=40)
    assert [r.rn for r in got.orderBy("t", "i").collect()] == list(range(1, 402))


def test_uneven_positions_are_cut_again(spark):
    rng = random.Random(5)
    data = [("k", float(round(10 ** rng.uniform(0, 9))), i) for i in range(300)]
    df = spark.createDataFrame(data, "k string, t double, i long")
    large = large_groups(df, ["k"], ["t", "i"], 20)
    cut = cut_large_groups(df, ["k"], ["t", "i"], large, 20).cache()
    sizes = cut.groupBy("_chunk").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("a"), F.max("t").alias("b"))
    found = sizes.orderBy("_chunk").collect()
    assert max(r.n for r in found) <= 20
    assert all(x.b < y.a for x, y in zip(found, found[1:]))
    got = with_ordered(df, ["k"], ["t", "i"], {"rn": RowNumber()}, task_rows=20)
    assert [r.rn for r in got.orderBy("t", "i").collect()] == list(range(1, 301))


def check_row_numbers(df, keys, order, task_rows):
    got = with_ordered(df, keys, order, {"rn": RowNumber(), "lag1": Lag(F.col("i"))}, task_rows=task_rows)
    w = Window.partitionBy(*keys).orderBy(*order)
    want = df.withColumns({"rn": F.row_number().over(w).cast("long"), "lag1": F.lag("i").over(w)})
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_a_hot_group_of_equal_first_positions_is_cut(spark):
    df = spark.createDataFrame([("k", 5, i) for i in range(200)] + [("x", 1, 1)], "k string, t long, i long")
    large = large_groups(df, ["k"], ["t", "i"], 20)
    cut = cut_large_groups(df, ["k"], ["t", "i"], large, 20)
    assert max(r["count"] for r in cut.groupBy("k", "_chunk").count().collect()) <= 20
    check_row_numbers(df, ["k"], ["t", "i"], 20)


def test_a_missing_key_is_a_group_that_is_cut(spark):
    df = spark.createDataFrame([(None, i % 7, i) for i in range(150)] + [("x", 1, 1)], "k string, t long, i long")
    large = large_groups(df, ["k"], ["t", "i"], 20)
    cut = cut_large_groups(df, ["k"], ["t", "i"], large, 20)
    assert max(r["count"] for r in cut.groupBy("k", "_chunk").count().collect()) <= 25
    check_row_numbers(df, ["k"], ["t", "i"], 20)


def test_missing_and_infinite_positions(spark):
    odd = [None, float("-inf"), float("inf"), float("nan"), 1.5]
    df = spark.createDataFrame([("k", odd[i % 5], i) for i in range(100)], "k string, t double, i long")
    check_row_numbers(df, ["k"], ["t", "i"], 7)


def test_sums_of_fractions(spark):
    rng = random.Random(8)
    values = [rng.uniform(-1, 1) * 10 ** rng.randrange(6) for _ in range(300)]
    df = spark.createDataFrame([("k", i, v) for i, v in enumerate(values)], "k string, i long, v double")
    for n in (9, 60, 10_000):
        out = with_ordered(df, ["k"], ["i"], {"s": RunningSum(F.col("v"))}, task_rows=n).orderBy("i").collect()
        assert all(abs(r.s - math.fsum(values[: r.i + 1])) < 1e-9 for r in out)


def test_sums_of_extreme_fractions(spark):
    cases = {"small": [1e-13] * 8, "large": [1e15, 2e15, 1e300, 0.5] * 2, "nan": [1.5] * 4 + [math.nan] + [1.0] * 3, "inf": [1.5] * 3 + [math.inf] + [1.0] * 4}
    df = spark.createDataFrame([(k, i, v) for k, vs in cases.items() for i, v in enumerate(vs)], "k string, i long, v double")
    for n in (2, 10_000):
        out = with_ordered(df, ["k"], ["i"], {"s": RunningSum(F.col("v"))}, task_rows=n).collect()
        for r in out:
            want = sum(cases[r.k][: r.i + 1])
            assert (math.isnan(r.s) and math.isnan(want)) or r.s == want or abs(r.s - want) <= 1e-12 * abs(want)
