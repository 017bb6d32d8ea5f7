"""Fitted values, Student's t and confidence bands."""

import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rosterlens.operators import fit_grid, linear_fit
from rosterlens.operators.stats import student_t

SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])

# published table of the two-sided 95 % quantile (fixed values)
T_95 = {1: 12.7062, 2: 4.3027, 3: 3.1824, 4: 2.7764, 5: 2.5706, 7: 2.3646, 10: 2.2281, 20: 2.0860, 33: 2.0345, 60: 2.0003, 120: 1.9799}


def chance(t: float, df: int) -> float:
    """P(|T| <= t) by the midpoint rule on cos(u)^(df - 1)."""
    def area(top, n=40_000):
        return sum(math.cos(top * (i + 0.5) / n) ** (df - 1) for i in range(n)) * top / n

    return area(math.atan(t / math.sqrt(df))) / area(min(math.pi / 2, 14 / math.sqrt(df)))


def test_student_t(spark):
    degrees = [*T_95, 0, -1, 8, 199, 200, 201, 1000, 10**9]
    got = {r.df: r.t for r in spark.createDataFrame([(d,) for d in degrees], "df long").select("df", student_t(F.col("df")).alias("t")).collect()}
    assert got[0] is None and got[-1] is None
    for df, t in T_95.items():
        assert round(got[df], 4) == t
    for df in (3, 8, 33, 199, 201, 1000):
        assert chance(got[df], df) == pytest.approx(0.95, abs=1e-8)
    assert got[10**9] == pytest.approx(1.959964, abs=1e-6)
    other = spark.range(1).select(student_t(F.lit(6), 0.99).alias("t")).first().t
    assert round(other, 4) == 3.7074


def test_a_value_half_way_stays_there(spark):
    """10331 / 160 = 64.56875: not a digit below it, however the points lie."""
    points = [(1990, 10331), (1998, 10331), (1990, 0), (1998, 0)]          # mean 10331 / 2
    df = spark.createDataFrame([("a", x, y) for x, y in points], "k string, year int, age int")
    fit = linear_fit(df, "year", "age", ["k"])
    row = fit_grid(fit, ["k"], F.lit(1994), F.lit(1994), "year").first()
    assert row.fit == 10331 / 2
    # slope 10331/160 from the origin on: the line crosses half-way values at every year
    steep = spark.createDataFrame([("a", 0, 0), ("a", 160, 10331), ("a", 320, 20662)], "k string, year int, age int")
    got = {r.year: r.fit for r in fit_grid(linear_fit(steep, "year", "age", ["k"]), ["k"], F.lit(0), F.lit(400), "year").collect()}
    assert got[1] == 64.56875 and all(v == 10331 * x / 160 for x, v in got.items())
    shown = spark.createDataFrame([(got[1],)], "x double").select(F.round("x", 4).alias("x")).first().x
    assert shown == 64.5688


def test_three_points_and_two(spark):
    rows = [("a", 1, 1), ("a", 2, 3), ("a", 3, 2), ("b", 1, 5), ("b", 2, 7), ("c", 4, 4)]
    df = spark.createDataFrame(rows, "k string, year int, age int")
    got = {(r.k, r.year): r for r in fit_grid(linear_fit(df, "year", "age", ["k"]), ["k"], F.lit(1), F.lit(3), "year").collect()}
    assert {k for k, _ in got} == {"a", "b"}                              # one point has no line
    mid = got["a", 2]
    se = math.sqrt(1.5 / 1) * math.sqrt(1 / 3)
    assert mid.fit == 2.0 and mid.se_fit == pytest.approx(se)
    assert mid.band_high == pytest.approx(2 + 12.706204736 * se) and mid.band_low == pytest.approx(2 - 12.706204736 * se)
    assert got["b", 2].fit == 7.0 and got["b", 2].se_fit is None and got["b", 2].band_low is None


def test_real_valued_columns_have_a_band_too(spark):
    rows = [("a", float(x), 2.0 * x + (-1) ** x) for x in range(10)]
    df = spark.createDataFrame(rows, "k string, x double, y double")
    got = fit_grid(linear_fit(df, "x", "y", ["k"]), ["k"], F.lit(4), F.lit(5)).collect()
    for r in got:
        assert r.band_low < r.fit < r.band_high and r.band_high - r.fit == pytest.approx(2.306004 * r.se_fit, rel=1e-5)


@SETTINGS
@given(st.lists(st.tuples(st.integers(1950, 2020), st.integers(0, 99)), min_size=3, max_size=40))
def test_fitted_values_are_the_nearest_doubles(spark, points):
    from fractions import Fraction

    df = spark.createDataFrame([("a", x, y) for x, y in points], "k string, year int, age int")
    got = fit_grid(linear_fit(df, "year", "age", ["k"]), ["k"], F.lit(1980), F.lit(1985), "year").collect()
    n, sx, sy = len(points), sum(x for x, _ in points), sum(y for _, y in points)
    sxx = n * sum(x * x for x, _ in points) - sx * sx
    sxy = n * sum(x * y for x, y in points) - sx * sy
    assert len(got) == (6 if sxx else 0)
    for r in got:
        assert r.fit == float(Fraction(sy * sxx + sxy * (n * r.year - sx), n * sxx))
