import math

import pytest
from pyspark.sql import functions as F

from fieldloom.functions import scalars
from fieldloom.functions.regions import REGIONS, in_box, region_table
from fieldloom.functions.student import t_two_sided
from reference import two_sided_p

DEGREES = [0.0, 360.0, 378.0, 60.0, -30.0, -810.0]


def column(spark, values, expr):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, lon double").select("i", expr.alias("x")).orderBy("i").collect()
    return [r.x for r in rows]


@pytest.mark.parametrize("start, expected", [(0.0, [0, 0, 18, 60, 330, 270]), (-180.0, [0, 0, 18, 60, -30, -90])])
def test_adjust_lon_degrees(spark, start, expected):
    assert column(spark, DEGREES, scalars.adjust_lon("lon", start)) == expected


@pytest.mark.parametrize(
    "start, expected", [(0.0, [0, 0, 0.1, 1 / 3, 11 / 6, 1.5]), (-math.pi, [0, 0, 0.1, 1 / 3, -1 / 6, -0.5])]
)
def test_adjust_lon_radians(spark, start, expected):
    values = [0.0, 2 * math.pi, 2.1 * math.pi, math.pi / 3, -math.pi / 6, -4.5 * math.pi]
    got = column(spark, values, scalars.adjust_lon("lon", start, radians=True))
    assert got == pytest.approx([e * math.pi for e in expected], abs=1e-9)


def test_dates(spark):
    texts = ["2001-02-03", "2001-02-03T04:05:06", "2001/02/03", "20010203", "3 Feb 2001", "nonsense"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.d for r in df.select("i", scalars.standard_date("t").alias("d")).orderBy("i").collect()]
    assert got == ["2001-02-03"] * 5 + [None]


def test_clamp_and_sign_class(spark):
    assert column(spark, [-5.0, 0.5, 9.0], scalars.clamp("lon", 0, 1)) == [0, 0.5, 1]
    assert column(spark, [-5.0, 0.0, 9.0], scalars.sign_class("lon", 1, ["b", "s", "f"])) == ["b", "s", "f"]


def test_unknown_climatology_key():
    with pytest.raises(ValueError):
        scalars.climatology_key("time", "hourly")


def test_regions(spark):
    assert len(REGIONS) == 32 and region_table(spark).count() == 32
    df = spark.createDataFrame([(-30.0, 10.0), (-30.0, 100.0), (-30.0, 350.0)], "lat double, lon double")
    assert df.where(in_box("sh-psa")).count() == 2
    assert df.where(in_box("sh-psa", wrap=True)).count() == 3
    assert df.where(in_box((-40, -20, -20, 20), wrap=True)).count() == 2
    assert df.where(F.lit(True) & in_box((-30, -30, 10, 10))).count() == 1


def test_student_probabilities(spark):
    # Two-sided tail probabilities from standard tables.
    cases = [(2.228139, 10, 0.05), (1.812461, 10, 0.10), (12.706205, 1, 0.05), (1.959964, 1e7, 0.05), (0.0, 5, 1.0)]
    exact = [(3.0, 2.0, 1 - 3 / math.sqrt(11)), (-1.0, 1.0, 0.5), (math.inf, 4.0, 0.0), (1e-9, 3.0, 1.0), (math.sqrt(3), 1.0, 1 / 3)]
    near = [(t, n) for t in (0.01, 0.7, 2.0, -5.0, 40.0) for n in (0.4, 1.5, 7.0, 33.3, 800.0)]
    table = spark.createDataFrame([(float(t), float(n)) for t, n, *_ in cases + exact + near], "t double, n double")
    got = {(r.t, r.n): r.p for r in table.select("t", "n", t_two_sided("t", "n").alias("p")).collect()}
    for t, n, p in cases:
        assert got[t, n] == pytest.approx(p, abs=2e-7)
    for t, n, p in exact:
        assert got[t, n] == pytest.approx(p, rel=1e-11, abs=1e-8 if t == 1e-9 else 1e-14)
    for t, n in near:
        if n >= 1.5:
            assert got[t, n] == pytest.approx(float(two_sided_p(t, n)[0]), rel=1e-6, abs=1e-9)
    none = spark.createDataFrame([(None, 3.0), (1.0, None), (1.0, 0.0), (float("nan"), 3.0), (1.0, -2.0)], "t double, n double")
    assert [r.p for r in none.select(t_two_sided("t", "n").alias("p")).collect()] == [None] * 5
