"""Hire / termination flows (A1-A4, J1-J3, W1, R1).

Counts are of distinct employees per event year (and dimension). Spark
plans distinct counting as a partial de-duplication on (keys, id) before
the first shuffle and a partial count before the second, so no group —
however hot — is gathered in one task.

``flow_by`` computes hires and terminations in one pass: every row yields
its hire event and, when real, its termination event (``flow_events``);
one distinct over (year, dims, employee, action) and one grouped
conditional count follow (``flow_from_events``).
That equals merging the two separate counts with a NULL-matching full
outer join and filling gaps with 0 (``outer_merge``), without the second
scan and the join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterlens import constants as K
from rosterlens.functions import not_sentinel_date


def hires_by(
    panel: DataFrame,
    dims: list[str] | tuple[str, ...] = (),
    n: str = "n",
    hire_col: str = K.HIRE_DATE,
    id_col: str = K.ID,
) -> DataFrame:
    """Distinct employees per hire year (and dims). NULL year is its own group."""
    return (
        panel.select(F.year(hire_col).alias("year"), *dims, id_col)
        .groupBy("year", *dims)
        .agg(F.count_distinct(id_col).alias(n))
    )


def terms_by(
    panel: DataFrame,
    dims: list[str] | tuple[str, ...] = (),
    n: str = "n",
    term_col: str = K.TERM_DATE,
    id_col: str = K.ID,
) -> DataFrame:
    """Distinct employees per termination year (and dims), sentinel year removed."""
    return (
        panel.where(not_sentinel_date(term_col))
        .select(F.year(term_col).alias("year"), *dims, id_col)
        .groupBy("year", *dims)
        .agg(F.count_distinct(id_col).alias(n))
    )


def outer_merge(left: DataFrame, right: DataFrame, keys: list[str], fill: int | None = None) -> DataFrame:
    """Full outer equi-join where NULL keys match each other; keys coalesced.

    Non-key columns of both sides follow the keys; with ``fill`` their gaps
    (rows present on one side only) become that value.
    """
    l, r = left.alias("_l"), right.alias("_r")
    cond = reduce(lambda a, b: a & b, [F.col(f"_l.{k}").eqNullSafe(F.col(f"_r.{k}")) for k in keys])
    joined = l.join(r, cond, "full_outer")

    def value(side: str, c: str) -> Column:
        v = F.col(f"{side}.{c}")
        return (F.coalesce(v, F.lit(fill)) if fill is not None else v).alias(c)

    return joined.select(
        *[F.coalesce(F.col(f"_l.{k}"), F.col(f"_r.{k}")).alias(k) for k in keys],
        *[value("_l", c) for c in left.columns if c not in keys],
        *[value("_r", c) for c in right.columns if c not in keys],
    )


def flow_events(
    panel: DataFrame,
    dims: list[str] | tuple[str, ...] = (),
    hire_col: str = K.HIRE_DATE,
    term_col: str = K.TERM_DATE,
    id_col: str = K.ID,
) -> DataFrame:
    """Distinct (year, action, employee, *dims) events: each row's hire and, when real, its termination."""
    events = F.inline(
        F.array(
            F.struct(F.lit(K.ACTION_HIRED).alias("action"), F.year(hire_col).alias("year")),
            F.struct(
                F.lit(K.ACTION_TERMED).alias("action"),
                F.when(not_sentinel_date(term_col), F.year(term_col)).alias("year"),
            ),
        )
    )
    rows = panel.select(*dims, id_col, events).where((F.col("action") == K.ACTION_HIRED) | F.col("year").isNotNull())
    return rows.select("year", "action", id_col, *dims).distinct()


def flow_from_events(
    events: DataFrame, dims: list[str] | tuple[str, ...] = (), id_col: str = K.ID
) -> DataFrame:
    """year, *dims, hired, termed from a :func:`flow_events` table (which may carry more dims)."""
    hired = F.col("action") == K.ACTION_HIRED
    known = F.col(id_col).isNotNull()          # a missing id is no employee, as in hires_by and terms_by
    return (
        events.select("year", "action", id_col, *dims)
        .distinct()
        .groupBy("year", *dims)
        .agg(F.count_if(hired & known).alias("hired"), F.count_if(~hired & known).alias("termed"))
    )


def flow_by(panel: DataFrame, dims: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """year, *dims, hired, termed: distinct employees hired / terminated per year (0 when none)."""
    return flow_from_events(flow_events(panel, dims), dims)


def running_total(df: DataFrame, delta: Column, order: str = "year", out: str = "total") -> DataFrame:
    """Cumulative sum of ``delta`` in ``order`` (NULL last).

    Meant for aggregated input (one row per year): the window has no
    partition key, so its input goes to one task.
    """
    w = Window.orderBy(F.col(order).asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(out, F.sum(delta).over(w))


def to_long(
    df: DataFrame,
    values: list[str] = (K.ACTION_HIRED, K.ACTION_TERMED),
    name: str = "action",
    value: str = "amount",
) -> DataFrame:
    """Wide -> long: one row per (other columns, value column). No shuffle."""
    values = list(values)
    ids = [c for c in df.columns if c not in values]
    return df.unpivot(ids, values, name, value)
