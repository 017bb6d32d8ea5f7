"""Q3: terminations by reason — gender split, ages, units, top and least members."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlens import constants as K
from rosterlens.functions import count_label
from rosterlens.operators import box_outliers, box_stats, count_by, extreme_member_per, share_of_total
from rosterlens.plans.context import Workforce


def _with_reason(w: Workforce) -> DataFrame:
    return w.reasoned


def q3_1_reason_gender(w: Workforce) -> DataFrame:
    counts = share_of_total(count_by(_with_reason(w), [K.REASON, K.GENDER]), "n")
    return counts.withColumn("label", count_label(K.REASON, K.GENDER, "n"))


def q3_2_reason_ages(w: Workforce) -> DataFrame:
    return _with_reason(w).select(K.REASON, K.AGE)


def q3_2_reason_mean_age(w: Workforce) -> DataFrame:
    return _with_reason(w).groupBy(K.REASON).agg(F.avg(K.AGE).alias("mean_age"))


def q3_2_reason_age_box(w: Workforce) -> DataFrame:
    return box_stats(_with_reason(w), K.AGE, [K.REASON], with_range=True)


def q3_2_reason_age_outliers(w: Workforce) -> DataFrame:
    """Ages beyond the whiskers of each box of ``q3_2_reason_age_box``, with their counts."""
    return box_outliers(_with_reason(w), K.AGE, [K.REASON])


def q3_3_reason_bu(w: Workforce) -> DataFrame:
    return count_by(_with_reason(w), [K.REASON, K.BU])


def _member(dim: str, largest: bool):
    def build(w: Workforce) -> DataFrame:
        counts = count_by(_with_reason(w), [K.REASON, dim])
        return extreme_member_per(counts, K.REASON, dim, "n", largest=largest)

    return build


QUERIES = {
    "q3_1_reason_gender": q3_1_reason_gender,
    "q3_2_reason_ages": q3_2_reason_ages,
    "q3_2_reason_mean_age": q3_2_reason_mean_age,
    "q3_2_reason_age_box": q3_2_reason_age_box,
    "q3_2_reason_age_outliers": q3_2_reason_age_outliers,
    "q3_3_reason_bu": q3_3_reason_bu,
    "q3_4_top_dept": _member(K.DEPT, True),
    "q3_4_least_dept": _member(K.DEPT, False),
    "q3_5_top_city": _member(K.CITY, True),
    "q3_5_least_city": _member(K.CITY, False),
    "q3_6_top_job": _member(K.JOB, True),
    "q3_6_least_job": _member(K.JOB, False),
}
