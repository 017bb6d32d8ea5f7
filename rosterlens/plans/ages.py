"""Q2: age at hire and at termination — trends, fits, box statistics, bands."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlens import constants as K
from rosterlens.functions import age_band, pair_label, years_between
from rosterlens.operators import box_outliers, box_stats, count_by, fit_grid, linear_fit, share_of_total
from rosterlens.plans.context import Workforce

SLOPE_DIGITS, INTERCEPT_DIGITS, FIT_DIGITS = 6, 4, 4


def q2_1_hired_age(w: Workforce) -> DataFrame:
    return w.hire_ages


def q2_2_termed_age(w: Workforce) -> DataFrame:
    return w.term_ages


def q2_age_union(w: Workforce) -> DataFrame:
    return w.event_ages


def q2_3_mean_age_trend(w: Workforce) -> DataFrame:
    """Mean event age per (action, unit, year)."""
    means = w.event_ages.groupBy("action", K.BU, "year").agg(F.avg(K.AGE).alias("mean_age"))
    return means.withColumn("BU_action", pair_label("action", K.BU))


def _fit_input(w: Workforce) -> DataFrame:
    return w.event_ages.select(pair_label("action", K.BU).alias("BU_action"), "year", K.AGE)


def q2_3_age_fit(w: Workforce) -> DataFrame:
    """Least-squares ``age ~ year`` per "action unit" panel."""
    fit = linear_fit(_fit_input(w), "year", K.AGE, ["BU_action"])
    return fit.select(
        "BU_action",
        F.round("slope", SLOPE_DIGITS).alias("slope"),
        F.round("intercept", INTERCEPT_DIGITS).alias("intercept"),
        F.round("r2", SLOPE_DIGITS).alias("r2"),
        "n",
    )


def q2_3_age_fit_grid(w: Workforce) -> DataFrame:
    """Fitted age, standard error and 95 % band per panel at every year of the full year range."""
    rows = _fit_input(w)
    fit = linear_fit(rows, "year", K.AGE, ["BU_action"])
    lo = rows.select(F.min("year")).scalar()
    hi = rows.select(F.max("year")).scalar()
    grid = fit_grid(fit, ["BU_action"], lo, hi, x_name="year")
    return grid.select(
        "BU_action",
        "year",
        F.round("fit", FIT_DIGITS).alias("fit"),
        F.round("se_fit", FIT_DIGITS).alias("se_fit"),
        F.round("band_low", FIT_DIGITS).alias("band_low"),
        F.round("band_high", FIT_DIGITS).alias("band_high"),
        "n",
    )


def q2_3_term_mean_age(w: Workforce) -> DataFrame:
    """Mean record age per (termination year, reason, "gender unit"), real reasons only."""
    rows = w.reasoned.select(
        F.year(K.TERM_DATE).alias("year"),
        K.REASON,
        pair_label(K.GENDER, K.BU).alias("BU_gender"),
        K.AGE,
    )
    return rows.groupBy("year", K.REASON, "BU_gender").agg(F.avg(K.AGE).alias("mean_age"))


def q2_3_hire_mean_age(w: Workforce) -> DataFrame:
    """Mean of each employee's lowest age at hire, per (hire year, unit, gender)."""
    keys = ["year", K.BU, K.GENDER_FULL]
    per_employee = (
        w.panel.select(
            F.year(K.HIRE_DATE).alias("year"),
            K.BU,
            K.GENDER_FULL,
            K.ID,
            years_between(K.HIRE_DATE, K.BIRTH_DATE).alias("hired_age"),
        )
        .groupBy(*keys, K.ID)
        .agg(F.min("hired_age").alias("hired_age"))
    )
    return per_employee.groupBy(*keys).agg(F.avg("hired_age").alias("mean_hired"))


def q2_4_age_box(w: Workforce) -> DataFrame:
    rows = w.event_ages.select(pair_label(K.BU, "action").alias("BU_action"), K.AGE)
    return box_stats(rows, K.AGE, ["BU_action"])


def q2_4_age_outliers(w: Workforce) -> DataFrame:
    """Ages beyond the whiskers of each box of ``q2_4_age_box``, with their counts."""
    rows = w.event_ages.select(pair_label(K.BU, "action").alias("BU_action"), K.AGE)
    return box_outliers(rows, K.AGE, ["BU_action"])


def _band_shares(events: DataFrame) -> DataFrame:
    counts = count_by(events.select(age_band(K.AGE).alias("agegroup")), ["agegroup"])
    return share_of_total(counts, "n")


def q2_4_hired_agegroup(w: Workforce) -> DataFrame:
    return _band_shares(w.hire_ages)


def q2_4_termed_agegroup(w: Workforce) -> DataFrame:
    return _band_shares(w.term_ages)


QUERIES = {
    "q2_1_hired_age": q2_1_hired_age,
    "q2_2_termed_age": q2_2_termed_age,
    "q2_age_union": q2_age_union,
    "q2_3_mean_age_trend": q2_3_mean_age_trend,
    "q2_3_age_fit": q2_3_age_fit,
    "q2_3_age_fit_grid": q2_3_age_fit_grid,
    "q2_3_term_mean_age": q2_3_term_mean_age,
    "q2_3_hire_mean_age": q2_3_hire_mean_age,
    "q2_4_age_box": q2_4_age_box,
    "q2_4_age_outliers": q2_4_age_outliers,
    "q2_4_hired_agegroup": q2_4_hired_agegroup,
    "q2_4_termed_agegroup": q2_4_termed_agegroup,
}
