"""Scalar column expressions.

All of these are built-in Catalyst expressions, so they stay inside
whole-stage codegen and are evaluated next to the scan.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from rosterlens.constants import AGE_BANDS, DAYS_PER_YEAR, NOT_TERMINATED_YEAR, RAW_DATE_FORMAT

ColumnOrName = Column | str


def _col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_mdy_date(text: ColumnOrName) -> Column:
    """Parse ``m/d/yyyy`` text; trailing text is ignored, bad input gives NULL.

    ``12/31/2006 0:00`` and ``1/5/2006`` parse; ``13/40/2006`` and ``""`` give NULL.
    """
    head = F.regexp_extract(_col(text), r"^\s*(\d{1,2}/\d{1,2}/\d{4})", 1)
    return F.try_to_date(head, RAW_DATE_FORMAT)


def years_between(later: ColumnOrName, earlier: ColumnOrName, calendar: bool = False) -> Column:
    """Whole years between two dates, unsigned.

    Default: floor(|days| / 365.25), the average-year rule of the studied
    analysis (2000-03-01 -> 2001-03-01 gives 0). ``calendar=True`` counts
    completed calendar years instead (that example gives 1).
    """
    if calendar:
        months = F.abs(F.months_between(_col(later), _col(earlier), roundOff=False))
        return F.floor(months / F.lit(12)).cast("int")
    days = F.abs(F.date_diff(_col(later), _col(earlier)))
    return F.floor(days / F.lit(DAYS_PER_YEAR)).cast("int")


def not_sentinel_date(date: ColumnOrName, sentinel_year: int = NOT_TERMINATED_YEAR) -> Column:
    """``year(date) != sentinel_year`` written as a date range.

    The range form is pushed to the Parquet reader as two comparisons,
    while ``year(d) <> 1900`` is not. NULL dates are dropped, as in the
    year comparison.
    """
    d = _col(date)
    lo = F.lit(_dt.date(sentinel_year, 1, 1))
    hi = F.lit(_dt.date(sentinel_year + 1, 1, 1))
    return (d < lo) | (d >= hi)


def age_band(age: ColumnOrName) -> Column:
    """Ten-year age band label; NULL for ages of 90 and over or NULL age."""
    a = _col(age)
    expr = None
    for upper, label in AGE_BANDS:
        expr = F.when(a < upper, F.lit(label)) if expr is None else expr.when(a < upper, F.lit(label))
    return expr


def _text(c: ColumnOrName) -> Column:
    return F.coalesce(_col(c).cast("string"), F.lit("NA"))


def pair_label(first: ColumnOrName, second: ColumnOrName) -> Column:
    """``"first second"``; a missing part is written ``NA``."""
    return F.concat_ws(" ", _text(first), _text(second))


def count_label(name: ColumnOrName, group: ColumnOrName, n: ColumnOrName) -> Column:
    """``"name (group): n"``; a missing part is written ``NA``."""
    return F.concat(_text(name), F.lit(" ("), _text(group), F.lit("): "), _text(n))


def cross_label(first: ColumnOrName, second: ColumnOrName) -> Column:
    """``first.second`` with the first dot turned into a line break.

    NULL if either part is NULL.
    """
    joined = F.concat(_col(first).cast("string"), F.lit("."), _col(second).cast("string"))
    return F.regexp_replace(joined, r"^([^.]*)\.", "$1\n")


def round_up_to(x: ColumnOrName, step: int) -> Column:
    """Smallest multiple of ``step`` that is >= x."""
    return F.ceil(_col(x) / F.lit(step)) * F.lit(step)


def round_half_even(x: ColumnOrName, digits: int = 1) -> Column:
    """Round to ``digits`` decimals, ties to even (2.25 -> 2.2)."""
    return F.bround(_col(x), digits)
