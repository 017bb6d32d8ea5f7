"""Long -> wide with fixed output columns (R2).

The pivot values are given explicitly, so Spark skips the extra job that
would otherwise collect the distinct values, and the schema is fixed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pivot_wide(
    df: DataFrame,
    keys: list[str],
    pivot_col: str,
    columns: list[tuple[str, str]],
    measure: str,
    fill: int = 0,
) -> DataFrame:
    """One row per ``keys``; one column per (pivot value, output name); gaps = ``fill``."""
    values = [v for v, _ in columns]
    wide = df.groupBy(*keys).pivot(pivot_col, values).agg(F.sum(measure))
    return wide.select(*keys, *[F.coalesce(F.col(v), F.lit(fill)).alias(name) for v, name in columns])
