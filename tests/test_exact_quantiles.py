"""Exact quantiles by selection, and the shared tables of group means."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import SF_SMALL
from rosterlens import constants as K
from rosterlens.operators import exact_quantiles, group_mean
from rosterlens.plans import ANALYSES, Workforce
from rosterlens.sources import panel_from_tables

SETTINGS = settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
PS = (0.0, 0.01, 0.1, 0.5, 0.8, 0.9, 0.99, 1.0)


@SETTINGS
@given(
    st.lists(st.one_of(st.none(), st.integers(-5, 5).map(float), st.floats(-1e9, 1e9)), min_size=1, max_size=80),
    st.sampled_from([2, 5, 10_000]),
)
def test_equal_to_percentile(spark, values, accuracy):
    """Also with a sketch far too coarse for the data, where the bracket is wide."""
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = exact_quantiles(df, "v", PS, accuracy).first().q
    want = df.select(F.percentile("v", list(PS)).alias("q")).first().q
    assert got == (want if want is not None else [None] * len(PS))


def test_no_values(spark):
    empty = spark.createDataFrame([], "v double")
    assert exact_quantiles(empty, "v", (0.5,)).first().q == [None]
    assert exact_quantiles(spark.createDataFrame([(None,)], "v int"), "v", (0.1, 0.9)).first().q == [None, None]


def test_ten_million_distinct_means(spark):
    """One value a group, ten million groups: the aggregate gathers a few thousand of them."""
    n = 10_000_000
    df = spark.range(n, numPartitions=8).select((F.col("id") * 7919 % n / 3.0).alias("v"))
    got = exact_quantiles(df, "v", (0.1, 0.9)).first().q
    assert got == pytest.approx([0.1 * (n - 1) / 3, 0.9 * (n - 1) / 3], rel=1e-12)
    near = df.select(F.percentile_approx("v", [0.1 - 2e-4, 0.1 + 2e-4], 10_000).alias("e")).first().e
    assert df.where(F.col("v").between(*near)).count() < 10 * n / 10_000


def test_heavy_ties(spark):
    """Nine tenths of the values are equal: they are counted, not gathered."""
    n = 200_000
    df = spark.range(n).select(F.when(F.col("id") % 10 > 0, F.lit(1.0)).otherwise(F.col("id").cast("double")).alias("v"))
    values = np.array([1.0 if i % 10 else float(i) for i in range(n)])
    got = exact_quantiles(df, "v", (0.05, 0.5, 0.9, 0.95)).first().q
    assert got == pytest.approx(np.quantile(values, [0.05, 0.5, 0.9, 0.95]).tolist())


def test_best_and_worst_share_one_table(spark):
    w = Workforce(panel_from_tables(spark, SF_SMALL))
    try:
        best, worst = ANALYSES["q5_7_mean_city_best"](w), ANALYSES["q5_7_mean_city_worst"](w)
        assert len(w._mean_tables) == len(w._mean_cut_tables) == 1
        means = {r.city_name: r.service for r in group_mean(w.terminated, K.SERVICE, [K.CITY]).collect()}
        hi, lo = np.quantile(list(means.values()), [0.9, 0.1])
        assert {r.city_name for r in best.collect()} == {c for c, v in means.items() if v >= hi}
        assert {r.city_name for r in worst.collect()} == {c for c, v in means.items() if v <= lo}
    finally:
        w.release()


def test_rows_numbered_as_they_come(spark):
    """A plan with a number by row place (as of a CSV panel) is not deterministic, and its quantiles are all the same."""
    df = spark.range(101).withColumn("place", F.monotonically_increasing_id()).select(F.when(F.col("place") >= 0, F.col("id")).alias("v"))
    assert exact_quantiles(df, "v", (0.1, 0.5)).first().q == [10.0, 50.0]
    assert df.where(F.col("v") >= exact_quantiles(df, "v", (0.9,)).select(F.col("q")[0]).scalar()).count() == 11
