"""Q0: id gap, unobserved period, average missing terminations; unit listings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlens import constants as K
from rosterlens.operators import id_gap, unobserved_years
from rosterlens.plans.context import Workforce


def q0_id_gap(w: Workforce) -> DataFrame:
    return id_gap(w.panel)


def q0_unknown_period(w: Workforce) -> DataFrame:
    return unobserved_years(w.panel)


def q0_average_term(w: Workforce) -> DataFrame:
    """Missing ids per unobserved year; NULL when the period is zero years."""
    p = w.panel
    gap = F.max(K.ID) - F.min(K.ID) + 1 - F.count_distinct(K.ID)
    years = F.floor(F.date_diff(F.min(K.RECORD_DATE), F.min(K.HIRE_DATE)) / F.lit(K.DAYS_PER_YEAR))
    both = p.agg(gap.cast("double").alias("gap"), years.cast("double").alias("years"))
    return both.select(F.when(F.col("years") != 0, F.col("gap") / F.col("years")).alias("average_term"))


def qx_bu_jobs(w: Workforce) -> DataFrame:
    """Distinct job titles per business unit."""
    return w.panel.select(K.BU, K.JOB).distinct()


def qx_bu_depts(w: Workforce) -> DataFrame:
    """Distinct departments per business unit."""
    return w.panel.select(K.BU, K.DEPT).distinct()


QUERIES = {
    "q0_id_gap": q0_id_gap,
    "q0_unknown_period": q0_unknown_period,
    "q0_average_term": q0_average_term,
    "qx_bu_jobs": qx_bu_jobs,
    "qx_bu_depts": qx_bu_depts,
}
