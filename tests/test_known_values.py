"""Values of the derived panel at sf0.01 listed in FIXTURES.md §4."""

import pytest
from pyspark.sql import functions as F

from conftest import SF_MID
from rosterlens.plans import registered_queries


@pytest.fixture(scope="module")
def q():
    return registered_queries()


def test_id_gap(spark, q):
    assert q["q0_id_gap"](spark, SF_MID).first().id_gap == 249
    assert q["q0_unknown_period"](spark, SF_MID).first().unknown_period == 8
    assert q["q0_average_term"](spark, SF_MID).first().average_term == 31.125


def test_flow(spark, q):
    got = [tuple(r) for r in q["q1_1_flow"](spark, SF_MID).collect()]
    assert got[0] == (1986, 7, 0, 7) and len(got) == 17
    assert got[-6:] == [
        (1997, 7, 4, 1478), (1998, 2, 7, 1473), (1999, 0, 36, 1437), (2000, 0, 137, 1300), (2001, 0, 311, 989),
        (None, 16, 0, 1005),
    ]


def test_terminated_long_service_by_gender(spark, q):
    got = {r.gender_short: r.n for r in q["q5_2_gender_long"](spark, SF_MID).collect()}
    assert got == {"F": 21, "M": 16}


def test_terminated_best_city_means(spark, q):
    got = [(r.city_name, round(r.service, 6)) for r in q["q5_7_mean_city_best"](spark, SF_MID).collect()]
    assert got == [("NATION_16", 10.857143), ("NATION_19", 10.272727), ("NATION_5", 10.0)]


def test_reason_by_gender(spark, q):
    got = {(r.termreason_desc, r.gender_short): r.n for r in q["q3_1_reason_gender"](spark, SF_MID).collect()}
    assert got == {
        ("Layoff", "F"): 80, ("Layoff", "M"): 77, ("Layoff", "X"): 3, ("Layoff", None): 4,
        ("Resignation", "F"): 78, ("Resignation", "M"): 80, ("Resignation", "X"): 4, ("Resignation", None): 4,
        ("Retirement", "F"): 79, ("Retirement", "M"): 79, ("Retirement", "X"): 4, ("Retirement", None): 4,
    }


def test_terminated_by_band(spark, q):
    from rosterlens.functions import age_band

    base = q["q5_term_service"](spark, SF_MID)
    got = {r.b: r.n for r in base.groupBy(age_band("age").alias("b")).agg(F.count("*").alias("n")).collect()}
    assert got == {"<20": 3, "20-29": 31, "30-39": 34, "40-49": 35, "50-59": 29, "60-69": 35,
                   "70-79": 36, "80-89": 36, None: 37}
    assert q["q5_18_under20"](spark, SF_MID).count() == 3


def test_terminated_rows_vs_base(spark, q):
    from rosterlens.plans import workforce

    panel = workforce(spark, SF_MID).panel
    assert panel.where(F.col("STATUS") == "TERMINATED").count() == 500
    assert q["q5_term_service"](spark, SF_MID).count() == 276
