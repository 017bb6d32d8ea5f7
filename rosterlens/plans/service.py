"""Q5 / Q6: length of service of terminated and of active employees.

Both questions run the same report over a different base (the latest
snapshot per employee, filtered to TERMINATED or ACTIVE), so the report is
declared once as data (``_TERMINATED``, ``_ACTIVE``) and expanded into query
keys. The SQL oracle has a report table of its own.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlens import constants as K
from rosterlens.functions import age_band
from rosterlens.operators import (
    at_or_above,
    at_or_below,
    bottom_share_by,
    order_desc,
    six_number,
    top_share_by,
)
from rosterlens.plans.context import Workforce

AGEGROUP = K.AGE_BAND


@dataclass(frozen=True)
class Report:
    key: str            # query key without the _long/_short/_best/_worst suffix
    kind: str           # summary | share | mean | extreme_mean | under20
    dim: str | None = None
    high: float | None = None   # quantile for the "long service" side
    low: float | None = None    # quantile for the "short service" side


def _reports(q: str, rows: list[tuple]) -> list[Report]:
    return [Report(f"{q}_{r[0]}", *r[1:]) for r in rows]


# --- fixed values: report layout and quantiles of the studied analysis --------
_TERMINATED = _reports("q5", [
    ("1_age_summary", "summary", K.AGE, 0.9, 0.1),
    ("2_gender", "share", K.GENDER, 0.9, 0.1),
    ("3_mean_gender", "mean", K.GENDER),
    ("4_bu", "share", K.BU, 0.9, 0.1),
    ("5_mean_bu", "mean", K.BU),
    ("6_city", "share", K.CITY, 0.99, 0.01),
    ("7_mean_city", "extreme_mean", K.CITY, 0.9, 0.1),
    ("8_job", "share", K.JOB, 0.99, 0.01),
    ("9_mean_job", "extreme_mean", K.JOB, 0.9, 0.1),
    ("10_dept", "share", K.DEPT, 0.99, 0.01),
    ("11_mean_dept", "extreme_mean", K.DEPT, 0.9, 0.1),
    ("12_store", "share", K.STORE, 0.99, 0.01),
    ("13_mean_store", "extreme_mean", K.STORE, 0.9, 0.1),
    ("14_reason", "share", K.REASON, 0.9, 0.1),
    ("15_mean_reason", "mean", K.REASON),
    ("16_agegroup", "share", AGEGROUP, 0.9, 0.1),
    ("17_mean_agegroup", "mean", AGEGROUP),
    ("18_under20", "under20", AGEGROUP),
])
_ACTIVE = _reports("q6", [
    ("1_age_summary", "summary", K.AGE, 0.9, 0.1),
    ("2_gender", "share", K.GENDER, 0.9, 0.1),
    ("3_mean_gender", "mean", K.GENDER),
    ("4_bu", "share", K.BU, 0.9, 0.1),
    ("5_mean_bu", "mean", K.BU),
    ("6_city", "share", K.CITY, 0.99, 0.01),
    ("7_mean_city", "extreme_mean", K.CITY, 0.9, 0.1),
    ("8_job", "share", K.JOB, 0.99, 0.01),
    ("9_mean_job", "extreme_mean", K.JOB, 0.9, 0.1),
    ("10_dept", "share", K.DEPT, 0.99, 0.01),
    ("11_mean_dept", "extreme_mean", K.DEPT, 0.9, 0.1),
    ("12_store", "share", K.STORE, 0.99, 0.01),
    ("13_mean_store", "extreme_mean", K.STORE, 0.9, 0.1),
    ("14_mean_reason", "mean", K.REASON),
    ("15_agegroup", "share", AGEGROUP, 0.9, 0.1),
    ("16_mean_agegroup", "mean", AGEGROUP),
])
UNDER20_BAND = "<20"
# -------------------------------------------------------------------------------

# (base name, key of the base listing, report rows)
BASES = [
    ("terminated", "q5_term_service", _TERMINATED),
    ("active", "q6_active_service", _ACTIVE),
]


def expand(report: Report) -> list[tuple[str, str]]:
    """(query key, variant) pairs of one report row."""
    if report.kind in ("summary", "share"):
        return [(f"{report.key}_long", "high"), (f"{report.key}_short", "low")]
    if report.kind == "extreme_mean":
        return [(f"{report.key}_best", "high"), (f"{report.key}_worst", "low")]
    return [(report.key, "")]


def _base(w: Workforce, name: str, dim: str | None) -> DataFrame:
    base = w.terminated if name == "terminated" else w.active
    return base.withColumn(AGEGROUP, age_band(K.AGE)) if dim == AGEGROUP else base


def _builder(base_name: str, r: Report, variant: str) -> Callable[[Workforce], DataFrame]:
    def build(w: Workforce) -> DataFrame:
        b = _base(w, base_name, r.dim)
        if r.kind == "summary":
            if variant == "high":
                rows = at_or_above(b, K.SERVICE, r.high, cut=w.service_cut(base_name, r.high))
            else:
                rows = at_or_below(b, K.SERVICE, r.low, cut=w.service_cut(base_name, r.low))
            return six_number(rows, K.AGE)
        if r.kind == "share":
            if variant == "high":
                return top_share_by(b, r.high, [r.dim], cut=w.service_cut(base_name, r.high))
            return bottom_share_by(b, r.low, [r.dim], cut=w.service_cut(base_name, r.low))
        if r.kind == "mean":
            return order_desc(w.group_means(base_name, r.dim), K.SERVICE, [r.dim])
        if r.kind == "extreme_mean":
            means = w.group_means(base_name, r.dim)
            keep, p = (at_or_above, r.high) if variant == "high" else (at_or_below, r.low)
            rows = keep(means, K.SERVICE, p, cut=w.mean_cut(base_name, r.dim, p))
            return order_desc(rows, K.SERVICE, [r.dim])
        if r.kind == "under20":
            # the base is still grouped by employee at this point of the studied
            # analysis, so its column selection keeps EmployeeID as well
            return b.where(F.col(AGEGROUP) == UNDER20_BAND).select(K.ID, K.REASON, K.CITY, K.JOB, K.TERM_DATE)
        raise ValueError(r.kind)

    return build


def _queries() -> dict[str, Callable[[Workforce], DataFrame]]:
    out: dict[str, Callable[[Workforce], DataFrame]] = {"q5_service_latest": lambda w: w.latest}
    for base_name, listing_key, reports in BASES:
        out[listing_key] = (lambda n: (lambda w: w.terminated if n == "terminated" else w.active))(base_name)
        for r in reports:
            for key, variant in expand(r):
                out[key] = _builder(base_name, r, variant)
    return out


QUERIES = _queries()
