"""Column expressions on hand-made values."""

import math

import pytest
from pyspark.sql import functions as F

from trialmill.functions import conditional as cond
from trialmill.functions import distributions as dist
from trialmill.functions import geometry as geo
from trialmill.functions import strings as text



def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


def test_missing_conditions(spark):
    none, yes = F.lit(None).cast("boolean"), F.lit(True)
    assert one(
        spark,
        cond.if_null_safe(none, F.lit("a"), F.lit("b")),
        cond.case_when((none, F.lit("a")), default=F.lit("b")),
        cond.case_when((none, F.lit("a")), (yes, F.lit("c"))),
    ) == (None, "b", "c")


def test_recode(spark):
    v = F.lit(5)
    assert one(
        spark,
        cond.recode(v, {5: 0}, cond.KEEP),
        cond.recode(v, {4: 0}, cond.KEEP),
        cond.recode(v, {4: "x"}),
        cond.recode(v, {4: "x"}, "other"),
        cond.null_if(F.lit("NA"), "NA"),
    ) == (0, 5, None, "other", None)


@pytest.mark.parametrize(
    "path,sep,ext,code",
    [
        ("C:/Data/log/a05_1-x.log", "/", ".", "a05_1-x"),
        ("a05.log", "/", ".", "a05"),
        ("dir/a05", "/", ".", "a05"),
        ("dir/a05_1 Samples.txt", "/", " ", "a05_1"),
        ("v1.2/a05", "/", ".", ""),
        (".hidden", "/", ".", ".hidden"),
        ("a-original.vmrk", "/", "-original", "a"),
    ],
)
def test_file_code(spark, path, sep, ext, code):
    assert one(spark, text.file_code(F.lit(path), sep, ext)) == (code,)


def test_text(spark):
    assert one(
        spark,
        text.paradigm_of(F.lit("a05")),
        text.paradigm_of(F.lit("b05")),
        text.paradigm_of(F.lit("x")),
        text.digits(F.lit("vp-07b")),
        text.digits(F.lit("none")),
        text.pad_number(F.lit(7)),
        text.pad_number(F.lit(123)),
        text.decimal_comma(F.lit("892,10")),
        text.decimal_comma(F.lit(".")),
        text.to_decimal_comma(F.lit(1.5)),
    ) == ("Dot Probe", "Dual Probe", None, 7, None, "07", "123", 892.1, None, "1,5")


def test_rounding_is_half_even(spark):
    assert one(spark, F.bround(F.lit(0.125), 2), F.bround(F.lit(0.375), 2)) == (0.12, 0.38)


def test_geometry(spark):
    back = geo.cm_to_deg(geo.deg_to_cm(F.lit(12.5), 650), 650)
    flat = geo.vector_angle((F.lit(0.0), F.lit(0.0), F.lit(2.0)), (F.lit(2.0), F.lit(0.0), F.lit(2.0)))
    same = geo.vector_angle((F.lit(0.1), F.lit(0.2), F.lit(0.3)), (F.lit(0.1), F.lit(0.2), F.lit(0.3)))
    deg, far, angle, none, px = one(
        spark,
        back,
        geo.point_distance(F.lit(0.0), F.lit(0.0), F.lit(3.0), F.lit(4.0)),
        flat,
        same,
        geo.deg_to_px(F.lit(1.0), 650, 1920, 518.4),
    )
    assert (deg, far, angle) == (pytest.approx(12.5), 5.0, pytest.approx(45.0))
    assert none == pytest.approx(0.0, abs=1e-5)
    assert px == pytest.approx(geo.MEASURED.px_per_degree) == pytest.approx(42.02, abs=0.01)


def test_bounds(spark):
    at = lambda x, y: geo.in_bounds(F.lit(x).cast("double"), F.lit(y).cast("double"), (10, 0), (0, 5))
    assert one(spark, at(10, 5), at(10.1, 5), at(None, 5)) == (True, False, False)


def test_fisher(spark):
    r = F.lit(0.5)
    z, back, pruned, sb = one(
        spark,
        dist.fisher_z(r),
        dist.fisher_z_inv(dist.fisher_z(r)),
        dist.fisher_z_inv(dist.fisher_z(F.lit(-1.0), 0.999)),
        dist.spearman_brown(r),
    )
    assert z == pytest.approx(0.5 * math.log(3)) and back == pytest.approx(0.5)
    assert pruned == pytest.approx(-0.999) and sb == pytest.approx(2 / 3)


# Points of printed t and F tables.
T_TABLE = [(12.706, 1, 0.05), (2.228, 10, 0.05), (2.750, 30, 0.01), (1.984, 100, 0.05), (1.960, 10**7, 0.05)]
F_TABLE = [(4.96, 1, 10, 0.05), (4.10, 2, 10, 0.05), (2.53, 5, 30, 0.05), (3.32, 2, 30, 0.05)]


def test_tails(spark):
    t = spark.createDataFrame(T_TABLE, "t double, df long, p double")
    for r in t.select("p", dist.t_tail(F.col("t"), F.col("df")).alias("q")).collect():
        assert r.q == pytest.approx(r.p, abs=2e-4)
    f = spark.createDataFrame(F_TABLE, "f double, a long, b long, p double")
    for r in f.select("p", dist.f_tail(F.col("f"), F.col("a").cast("double"), F.col("b").cast("double")).alias("q")).collect():
        assert r.q == pytest.approx(r.p, abs=3e-4)
    two, more, less, none = one(
        spark,
        dist.t_tail(F.lit(-2.228), F.lit(10)),
        dist.t_tail(F.lit(-2.228), F.lit(10), "greater"),
        dist.t_tail(F.lit(-2.228), F.lit(10), "less"),
        dist.t_tail(F.lit(None).cast("double"), F.lit(10)),
    )
    assert (two, more, less, none) == (
        pytest.approx(0.05, abs=1e-4),
        pytest.approx(0.975, abs=1e-4),
        pytest.approx(0.025, abs=1e-4),
        None,
    )


