"""Table operators: flows, picks, thresholds, statistics, reshape."""

from rosterlens.operators.joins import broadcast_if_small, sampled_hot_keys, split_by_keys
from rosterlens.operators.flows import (
    flow_by,
    flow_events,
    flow_from_events,
    hires_by,
    outer_merge,
    running_total,
    terms_by,
    to_long,
)
from rosterlens.operators.picks import earliest_snapshot, extreme_member_per, first_row_per, latest_snapshot
from rosterlens.operators.reshape import pivot_wide
from rosterlens.operators.stats import (
    box_outliers,
    box_stats,
    fit_grid,
    id_gap,
    linear_fit,
    share_of_total,
    six_number,
    student_t,
    unobserved_years,
)
from rosterlens.operators.thresholds import (
    at_or_above,
    at_or_below,
    best_group_means,
    bottom_share_by,
    count_by,
    exact_quantiles,
    group_mean,
    mean_report,
    order_desc,
    quantile_value,
    top_groups,
    top_share_by,
    worst_group_means,
)

__all__ = [
    "at_or_above",
    "at_or_below",
    "best_group_means",
    "broadcast_if_small",
    "bottom_share_by",
    "box_outliers",
    "box_stats",
    "count_by",
    "earliest_snapshot",
    "exact_quantiles",
    "extreme_member_per",
    "first_row_per",
    "fit_grid",
    "flow_by",
    "flow_events",
    "flow_from_events",
    "group_mean",
    "hires_by",
    "id_gap",
    "latest_snapshot",
    "linear_fit",
    "mean_report",
    "order_desc",
    "outer_merge",
    "pivot_wide",
    "quantile_value",
    "running_total",
    "sampled_hot_keys",
    "share_of_total",
    "six_number",
    "split_by_keys",
    "student_t",
    "terms_by",
    "to_long",
    "top_groups",
    "top_share_by",
    "unobserved_years",
    "worst_group_means",
]
