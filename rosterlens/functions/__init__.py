"""Column expressions (no UDFs): dates, labels, bands, rounding."""

from rosterlens.functions.columns import (
    age_band,
    count_label,
    cross_label,
    not_sentinel_date,
    pair_label,
    parse_mdy_date,
    round_half_even,
    round_up_to,
    years_between,
)

__all__ = [
    "age_band",
    "count_label",
    "cross_label",
    "not_sentinel_date",
    "pair_label",
    "parse_mdy_date",
    "round_half_even",
    "round_up_to",
    "years_between",
]
