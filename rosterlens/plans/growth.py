"""Q1: company growth — hires, terminations, running totals, reasons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlens import constants as K
from rosterlens.functions import cross_label, pair_label
from rosterlens.operators import flow_by, hires_by, outer_merge, running_total, share_of_total, terms_by, to_long
from rosterlens.plans.context import Workforce


def q1_1_hires_by_year(w: Workforce) -> DataFrame:
    return hires_by(w.panel)


def q1_1_terms_by_year(w: Workforce) -> DataFrame:
    return terms_by(w.panel)


def _net_flow(w: Workforce) -> DataFrame:
    return running_total(flow_by(w.panel), F.col("hired") - F.col("termed"))


def q1_1_flow(w: Workforce) -> DataFrame:
    """year, hired, termed, total (running net flow)."""
    return _net_flow(w).orderBy(F.col("year").asc_nulls_last())


def q1_1_flow_long(w: Workforce) -> DataFrame:
    return to_long(_net_flow(w))


def q1_2_flow_by_bu(w: Workforce) -> DataFrame:
    """The two counts merged by a NULL-matching full outer join, gaps filled with 0."""
    keys = ["year", K.BU]
    return outer_merge(hires_by(w.panel, [K.BU], "hired"), terms_by(w.panel, [K.BU], "termed"), keys, fill=0)


def q1_2_flow_by_bu_long(w: Workforce) -> DataFrame:
    """The same table in one pass over the panel, in long form."""
    return to_long(flow_by(w.panel, [K.BU]))


def q1_2_total_by_year(w: Workforce) -> DataFrame:
    """Hired + termed per year over the business-unit flows (NULL year dropped)."""
    long = q1_2_flow_by_bu_long(w)
    return long.where(F.col("year").isNotNull()).groupBy("year").agg(F.sum("amount").alias("amount"))


def q1_2_bu_action(w: Workforce) -> DataFrame:
    long = q1_2_flow_by_bu_long(w)
    return long.select("year", cross_label(K.BU, "action").alias("BU_action"), "amount")


def _by_gender(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed(K.GENDER, "gender")


def q1_3_hires_by_gender(w: Workforce) -> DataFrame:
    return _by_gender(hires_by(w.panel, [K.GENDER]))


def q1_3_terms_by_gender(w: Workforce) -> DataFrame:
    return _by_gender(terms_by(w.panel, [K.GENDER]))


def q1_3_flow_by_gender(w: Workforce) -> DataFrame:
    return _by_gender(flow_by(w.panel, [K.GENDER]))


def q1_3_flow_by_gender_long(w: Workforce) -> DataFrame:
    return to_long(q1_3_flow_by_gender(w))


def q1_3_gender_action_total(w: Workforce) -> DataFrame:
    """Total per (gender, action) over all years, with its share of the whole."""
    totals = (
        q1_3_flow_by_gender_long(w)
        .groupBy("gender", "action")
        .agg(F.sum("amount").alias("total"))
        .select(pair_label("gender", "action").alias("gender_action"), "total")
    )
    return share_of_total(totals, "total")


def q1_4_reason_type_levels(w: Workforce) -> DataFrame:
    """Sorted distinct "reason type" labels."""
    return w.panel.select(pair_label(K.REASON, K.TERM_TYPE).alias("label")).distinct().orderBy("label")


def q1_4_reason_by_year(w: Workforce) -> DataFrame:
    """Rows per (reason, status year), real reasons only."""
    rows = w.reasoned
    counts = rows.groupBy(K.REASON, F.col(K.STATUS_YEAR).alias("year")).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.col("year").asc_nulls_last(), F.col(K.REASON).asc_nulls_last())


def q1_5_flow_by_dept(w: Workforce) -> DataFrame:
    return flow_by(w.panel, [K.DEPT]).withColumnRenamed(K.DEPT, "dept")


def q1_5_flow_by_dept_long(w: Workforce) -> DataFrame:
    return to_long(q1_5_flow_by_dept(w), value="number")


QUERIES = {
    "q1_1_hires_by_year": q1_1_hires_by_year,
    "q1_1_terms_by_year": q1_1_terms_by_year,
    "q1_1_flow": q1_1_flow,
    "q1_1_flow_long": q1_1_flow_long,
    "q1_2_flow_by_bu": q1_2_flow_by_bu,
    "q1_2_flow_by_bu_long": q1_2_flow_by_bu_long,
    "q1_2_total_by_year": q1_2_total_by_year,
    "q1_2_bu_action": q1_2_bu_action,
    "q1_3_hires_by_gender": q1_3_hires_by_gender,
    "q1_3_terms_by_gender": q1_3_terms_by_gender,
    "q1_3_flow_by_gender": q1_3_flow_by_gender,
    "q1_3_flow_by_gender_long": q1_3_flow_by_gender_long,
    "q1_3_gender_action_total": q1_3_gender_action_total,
    "q1_4_reason_type_levels": q1_4_reason_type_levels,
    "q1_4_reason_by_year": q1_4_reason_by_year,
    "q1_5_flow_by_dept": q1_5_flow_by_dept,
    "q1_5_flow_by_dept_long": q1_5_flow_by_dept_long,
}
