"""Q4: where hiring concentrates — the top 20% of titles, departments, cities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlens import constants as K
from rosterlens.operators import count_by, earliest_snapshot, pivot_wide, top_groups
from rosterlens.plans.context import Workforce

TOP_SHARE = 0.8


def _employees_by(dim: str):
    """Employees ever seen with each ``dim`` value, top 20% of values.

    Picking each (employee, value) group's first row and counting rows per
    value equals counting distinct employees per value among rows with a
    known service, so no per-group pick is materialised.
    """

    def build(w: Workforce) -> DataFrame:
        rows = w.panel.where(F.col(K.SERVICE_YEARS).isNotNull())
        counts = rows.groupBy(dim).agg(F.count_distinct(K.ID).alias("n"))
        return top_groups(counts, "n", TOP_SHARE, [dim])

    return build


def q4_4_top20_job_gender(w: Workforce) -> DataFrame:
    """Hires per title split by gender (Female, Male, Other) at each employee's first snapshot, top 20% by total."""
    first = earliest_snapshot(w.panel)
    known = F.col(K.GENDER).isin([code for code, _ in K.GENDER_COLUMNS])
    code = F.when(known, F.col(K.GENDER)).otherwise(K.OTHER_GENDER)      # any other code, or none
    counts = count_by(first.select(K.JOB, code.alias(K.GENDER)), [K.GENDER, K.JOB])
    columns = [*K.GENDER_COLUMNS, (K.OTHER_GENDER, K.OTHER_GENDER)]
    wide = pivot_wide(counts, [K.JOB], K.GENDER, columns, "n").withColumnRenamed(K.JOB, "job")
    wide = wide.withColumn("total", sum((F.col(name) for _, name in columns), F.lit(0)))
    return top_groups(wide, "total", TOP_SHARE, ["job"])


QUERIES = {
    "q4_1_top20_job": _employees_by(K.JOB),
    "q4_2_top20_dept": _employees_by(K.DEPT),
    "q4_3_top20_city": _employees_by(K.CITY),
    "q4_4_top20_job_gender": q4_4_top20_job_gender,
}
