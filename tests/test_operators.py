"""Operator tests on hand-made inputs (FIXTURES.md §5 edge cases)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from rosterlens import constants as K
from rosterlens.operators import (
    at_or_above,
    at_or_below,
    best_group_means,
    box_stats,
    count_by,
    earliest_snapshot,
    extreme_member_per,
    flow_by,
    group_mean,
    id_gap,
    latest_snapshot,
    linear_fit,
    outer_merge,
    pivot_wide,
    running_total,
    share_of_total,
    six_number,
    terms_by,
    to_long,
    top_groups,
    unobserved_years,
)
from rosterlens.sources.derived import PANEL_COLUMNS

D = dt.date
NOT_TERM = D(1900, 1, 1)

PANEL_DDL = (
    "snapshot_id long, EmployeeID long, recorddate_key date, birthdate_key date, orighiredate_key date, "
    "terminationdate_key date, age int, length_of_service int, city_name string, department_name string, "
    "job_title string, store_name int, gender_short string, gender_full string, termreason_desc string, "
    "termtype_desc string, STATUS_YEAR int, STATUS string, BUSINESS_UNIT string"
)


def row(sid, emp, rec, hire, term=NOT_TERM, age=30, los=0, city="C1", dept="D1", job="J1", store=1,
        gender="F", reason=K.NO_REASON, status=K.STATUS_ACTIVE, bu="STORES", birth=D(1970, 1, 1)):
    return (sid, emp, rec, birth, hire, term, age, los, city, dept, job, store, gender,
            {"F": "Female", "M": "Male"}.get(gender), reason, K.NO_REASON,
            rec.year if rec else None, status, bu)


def panel(spark, rows):
    df = spark.createDataFrame(rows, PANEL_DDL)
    assert df.columns == PANEL_COLUMNS
    return df


def test_outer_merge_matches_null_keys(spark):
    a = spark.createDataFrame([(None, 1), (2000, 2)], "year int, hired long")
    b = spark.createDataFrame([(None, 5), (2001, 6)], "year int, termed long")
    got = sorted(outer_merge(a, b, ["year"], fill=0).collect(), key=lambda r: (r.year is None, r.year or 0))
    assert [tuple(r) for r in got] == [(2000, 2, 0), (2001, 0, 6), (None, 1, 5)]


def test_flow_null_hire_year_and_null_term(spark):
    rows = [
        row(1, 10, D(2005, 1, 1), None, term=None),
        row(2, 11, D(2005, 1, 1), None, term=D(2006, 5, 1)),
        row(3, 12, D(2005, 1, 1), D(2004, 1, 1)),
    ]
    flow = flow_by(panel(spark, rows))
    got = {r.year: (r.hired, r.termed) for r in flow.collect()}
    assert got == {None: (2, 0), 2004: (1, 0), 2006: (0, 1)}
    # the NULL termination date is dropped like the sentinel year
    assert {r.year for r in terms_by(panel(spark, rows)).collect()} == {2006}


def test_running_total_and_long_form(spark):
    flow = spark.createDataFrame([(2001, 3, 1), (2000, 5, 0), (None, 1, 0)], "year int, hired long, termed long")
    tot = running_total(flow, F.col("hired") - F.col("termed"))
    got = {r.year: r.total for r in tot.collect()}
    assert got == {2000: 5, 2001: 7, None: 8}  # NULL year last
    long = to_long(tot)
    assert long.count() == 6 and set(long.columns) == {"year", "total", "action", "amount"}


def test_latest_pick_first_row_wins_tie(spark):
    rows = [
        row(1, 10, D(2000, 1, 1), D(2000, 1, 1), los=0),
        row(2, 10, D(2003, 1, 1), D(2000, 1, 1), los=3, status=K.STATUS_ACTIVE),
        row(3, 10, D(2003, 6, 1), D(2000, 1, 1), los=3, status=K.STATUS_TERMINATED),
        row(4, 11, D(2001, 1, 1), D(2001, 1, 1), los=None),
        row(5, 11, D(2002, 1, 1), D(2001, 1, 1), los=None),
    ]
    got = latest_snapshot(panel(spark, rows)).collect()
    assert [(r.EmployeeID, r.snapshot_id, r.STATUS) for r in got] == [(10, 2, K.STATUS_ACTIVE)]
    first = earliest_snapshot(panel(spark, rows)).collect()
    assert [(r.EmployeeID, r.snapshot_id) for r in first] == [(10, 1)]


def test_extreme_member_ties_go_to_first_member(spark):
    counts = spark.createDataFrame(
        [("Layoff", "DB", 5), ("Layoff", "DA", 5), ("Layoff", "DC", 1), ("Retirement", "DC", 2), ("Retirement", None, 2)],
        "termreason_desc string, department_name string, n long",
    )
    top = {r.termreason_desc: r.department_name for r in extreme_member_per(counts, K.REASON, K.DEPT).collect()}
    least = {r.termreason_desc: r.department_name for r in extreme_member_per(counts, K.REASON, K.DEPT, largest=False).collect()}
    assert top == {"Layoff": "DA", "Retirement": "DC"}
    assert least == {"Layoff": "DC", "Retirement": "DC"}


def test_threshold_filters_keep_ties(spark):
    df = spark.createDataFrame([(v,) for v in [1, 2, 3, 4, 5, 5, 5, 5, 5, 5]], "service int")
    # P90 of the values is 5, so every 5 stays: 6 rows, not 1
    assert at_or_above(df, "service", 0.9).count() == 6
    # P10 = 1 + 0.9 * (2 - 1) = 1.9 -> only the 1
    assert [r.service for r in at_or_below(df, "service", 0.1).collect()] == [1]


def test_group_mean_drops_null_value_and_key(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), (None, 5), ("b", 4)], "agegroup string, service int")
    got = {r.agegroup: r.service for r in group_mean(df, "service", ["agegroup"]).collect()}
    assert got == {"a": 1.0, "b": 4.0}
    # counts keep the NULL group
    assert {r.agegroup for r in count_by(df, ["agegroup"]).collect()} == {"a", "b", None}


def test_best_group_means(spark):
    df = spark.createDataFrame([(c, float(v)) for c, v in [("x", 1), ("y", 2), ("z", 3), ("w", 4)]], "city_name string, service double")
    got = [r.city_name for r in best_group_means(df, "service", ["city_name"], 0.9).collect()]
    assert got == ["w"]


def test_box_stats_outlier_and_single_row(spark):
    vals = [("g", v) for v in [20, 21, 22, 23, 24, 25, 26, 95]] + [("one", 40)]
    df = spark.createDataFrame(vals, "k string, age int")
    got = {r.k: r for r in box_stats(df, "age", ["k"], with_range=True).collect()}
    g = got["g"]
    assert (g.q1, g.median, g.q3) == (21.75, 23.5, 25.25)
    assert g.n_out == 1 and g.hi == 26.0 and g.lo == 20.0 and g.max == 95
    one = got["one"]
    assert one.q1 == one.median == one.q3 == 40.0 and one.n_out == 0 and one.lo == one.hi == 40.0


def test_linear_fit_degenerate_is_null(spark):
    df = spark.createDataFrame([("a", 2000, 30), ("a", 2001, 32), ("a", 2002, 34), ("b", 2000, 50)], "k string, year int, age int")
    got = {r.k: r for r in linear_fit(df, "year", "age", ["k"]).collect()}
    assert got["a"].slope == pytest.approx(2.0) and got["a"].r2 == pytest.approx(1.0) and got["a"].n == 3
    assert got["b"].slope is None and got["b"].intercept is None


def test_pivot_fills_missing_gender(spark):
    counts = spark.createDataFrame([("F", "J1", 3), ("M", "J1", 1), ("F", "J2", 2)], "gender_short string, job_title string, n long")
    wide = pivot_wide(counts, [K.JOB], K.GENDER, K.GENDER_COLUMNS, "n")
    assert {tuple(r) for r in wide.collect()} == {("J1", 3, 1), ("J2", 2, 0)}


def test_top_groups_and_share(spark):
    counts = spark.createDataFrame([(c, n) for c, n in [("a", 1), ("b", 2), ("c", 3), ("d", 4), ("e", 10)]], "k string, n long")
    assert [r.k for r in top_groups(counts, "n", 0.8, ["k"]).collect()] == ["e"]
    shares = {r.k: r.share for r in share_of_total(counts, "n").collect()}
    assert shares["e"] == pytest.approx(0.5)


def test_six_number(spark):
    df = spark.createDataFrame([(v,) for v in [1, 2, 3, 4, None]], "age int")
    r = six_number(df, "age").first()
    assert (r.age_min, r.age_q1, r.age_median, r.age_mean, r.age_q3, r.age_max, r.age_nas) == (1, 1.75, 2.5, 2.5, 3.25, 4, 1)


def test_id_gap_and_unobserved_years(spark):
    rows = [row(1, 1318, D(2006, 1, 1), D(2000, 1, 1)), row(2, 1320, D(2006, 1, 1), D(1990, 6, 1)),
            row(3, 1325, D(2007, 1, 1), D(1995, 1, 1))]
    p = panel(spark, rows)
    assert id_gap(p).first().id_gap == 5
    assert unobserved_years(p).first().unknown_period == 15


@pytest.mark.parametrize("dims", [[], [K.BU], [K.GENDER], [K.DEPT]])
def test_one_pass_flow_equals_outer_merge_of_counts(spark, dims):
    from conftest import SF_SMALL
    from rosterlens.operators import hires_by
    from rosterlens.sources import panel_from_tables

    p = panel_from_tables(spark, SF_SMALL)
    merged = outer_merge(hires_by(p, dims, n="hired"), terms_by(p, dims, n="termed"), ["year", *dims], fill=0)
    one_pass = flow_by(p, dims)
    assert merged.columns == one_pass.columns
    assert sorted(map(repr, merged.collect())) == sorted(map(repr, one_pass.collect()))


def test_age_95_band_is_counted_but_not_averaged(spark):
    """FIXTURES §5: the NULL band of an age >= 90 stays in band counts and leaves band means."""
    from rosterlens.plans import ANALYSES, Workforce

    rows = [
        row(1, 10, D(2001, 1, 1), D(1995, 1, 1), term=D(2001, 1, 1), age=95, los=6,
            reason="Retirement", status=K.STATUS_TERMINATED),
        row(2, 11, D(2001, 1, 1), D(1999, 1, 1), term=D(2001, 1, 1), age=45, los=2,
            reason="Layoff", status=K.STATUS_TERMINATED),
        row(3, 12, D(2001, 1, 1), D(2000, 1, 1), term=D(2001, 1, 1), age=19, los=1,
            reason="Layoff", status=K.STATUS_TERMINATED),
    ]
    w = Workforce(panel(spark, rows), storage="none")
    counts = {r.agegroup: r.n for r in ANALYSES["q5_16_agegroup_long"](w).collect()}
    means = {r.agegroup: r.service for r in ANALYSES["q5_17_mean_agegroup"](w).collect()}
    assert None in counts                      # P90 of service (5.2) keeps only the 95-year-old
    assert None not in means and means == {"40-49": 2.0, "<20": 1.0}
    assert [r.termreason_desc for r in ANALYSES["q5_18_under20"](w).collect()] == ["Layoff"]


def test_fit_grid_two_points_has_fit_but_no_standard_error(spark):
    from rosterlens.operators import fit_grid

    df = spark.createDataFrame([("a", 2000, 30), ("a", 2001, 32), ("b", 2000, 40), ("b", 2001, 41), ("b", 2002, 45)],
                               "k string, year int, age int")
    grid = fit_grid(linear_fit(df, "year", "age", ["k"]), ["k"], F.lit(2000), F.lit(2002), "year")
    got = {(r.k, r.year): (r.fit, r.se_fit) for r in grid.collect()}
    assert got[("a", 2002)] == (pytest.approx(34.0), None)          # two points: line, no error band
    assert got[("b", 2001)][0] == pytest.approx(42.0) and got[("b", 2001)][1] == pytest.approx(0.5 ** 0.5)
