"""Quantile threshold filters and the reports built on them (F6, F7, A10, O4-O7).

A threshold is an exact, linearly interpolated quantile (``percentile``,
the same rule as R's default type 7 and DuckDB's ``quantile_cont``), taken as a
scalar subquery over row-level and per-group tables alike: an aggregate with a
partial step per task (a value -> count map), then a filter that runs on
every partition. No rows are gathered in one task. A per-group table's own
shuffle is the same in the subquery and in the filter's input, so Spark reuses
its exchange and does not aggregate twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlens import constants as K

ACCURACY = 10_000        # of the sketch that brackets a quantile: relative rank error 1 / ACCURACY


def quantile_value(df: DataFrame, col: str, p: float) -> Column:
    """Scalar subquery: the type-7 quantile ``p`` of ``col`` over ``df`` (NULLs skipped)."""
    return df.select(F.percentile(F.col(col), F.lit(float(p))).cast("double").alias("_q")).scalar()


def exact_quantiles(df: DataFrame, col: str, ps: tuple[float, ...], accuracy: int = ACCURACY) -> DataFrame:
    """One row ``q``: the type-7 quantiles ``ps`` of ``col``, by selection in bounded memory.

    A quantile sketch (:func:`percentile_approx`) brackets each rank; one more
    aggregate counts the values up to the bracket and gathers only those strictly
    inside it, at most about 6 / ``accuracy`` of all, however many are distinct or
    equal. The result is exact: a rank outside its bracket fails the query.
    NULLs are skipped; without values ``q`` holds NULLs.
    """
    v, margin = F.col(col).cast("double"), 2 / accuracy
    ends = [max(0.0, min(1.0, x)) for p in ps for x in (p - margin, p + margin)]
    # joined, not a scalar subquery: in an aggregate that may not be one over rows numbered as they come
    near = F.broadcast(df.select(F.percentile_approx(v, ends, accuracy).alias("near")))
    df, v, near = df.select(v.alias("v")).crossJoin(near), F.col("v"), F.col("near")
    aggregates = [F.count(v).alias("n")]
    for i in range(len(ps)):
        lo, hi = near[2 * i], near[2 * i + 1]
        aggregates.append(
            F.struct(
                F.max(lo).alias("lo"),
                F.max(hi).alias("hi"),
                F.count_if(v < lo).alias("below"),
                F.count_if(v == lo).alias("at_lo"),
                F.sort_array(F.collect_list(F.when((v > lo) & (v < hi), v))).alias("inside"),
                F.count_if((v == hi) & (hi > lo)).alias("at_hi"),
                # the neighbours of the bracket: with few values a rank may lie just beside it
                F.max(F.when(v < lo, v)).alias("under"),
                F.min(F.when(v > hi, v)).alias("over"),
            ).alias(f"b{i}")
        )
    bracketed = df.agg(*aggregates)

    def value_at(b: Column, rank: Column) -> Column:
        """The value of a rank (from 0) in a bracket."""
        at = rank - b["below"]
        inner = at - b["at_lo"]
        top = inner - F.size(b["inside"])
        return (
            F.when(at == -1, b["under"])
            .when((at >= 0) & (inner < 0), b["lo"])
            .when((inner >= 0) & (top < 0), F.get(b["inside"], inner.cast("int")))
            .when((top >= 0) & (top < b["at_hi"]), b["hi"])
            .when(top == b["at_hi"], b["over"])
            .otherwise(F.raise_error(F.lit("a quantile lies outside its bracket")).cast("double"))
        )

    def quantile(i: int, p: float) -> Column:
        b, place = F.col(f"b{i}"), F.lit(float(p)) * (F.col("n") - 1)
        rank = F.floor(place)
        low = value_at(b, rank)
        # the last rank has no next one, and needs none
        high = F.when(place > rank, value_at(b, rank + 1)).otherwise(low)
        between = (rank + 1 - place) * low + (place - rank) * high
        return F.when(F.col("n") > 0, F.when(low == high, low).otherwise(between))

    return bracketed.select(F.array(*[quantile(i, p) for i, p in enumerate(ps)]).alias("q"))


def at_or_above(df: DataFrame, col: str, p: float, cut: Column | None = None) -> DataFrame:
    """Rows whose ``col`` is >= its own quantile ``p``.

    ``cut`` is the quantile already computed (e.g. a scalar subquery over a
    persisted one-row table of cut-offs); otherwise it is computed here.
    """
    return df.where(F.col(col) >= (cut if cut is not None else quantile_value(df, col, p)))


def at_or_below(df: DataFrame, col: str, p: float, cut: Column | None = None) -> DataFrame:
    """Rows whose ``col`` is <= its own quantile ``p`` (``cut`` as in :func:`at_or_above`)."""
    return df.where(F.col(col) <= (cut if cut is not None else quantile_value(df, col, p)))


def count_by(df: DataFrame, by: list[str], n: str = "n") -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias(n))


def order_desc(df: DataFrame, col: str, ties: list[str] = ()) -> DataFrame:
    """Sort by ``col`` descending (NULL last), then ``ties`` ascending; for small results."""
    return df.orderBy(F.col(col).desc_nulls_last(), *[F.col(t).asc_nulls_last() for t in ties])


def top_share_by(
    df: DataFrame, p: float, by: list[str], value: str = K.SERVICE, n: str = "n", cut: Column | None = None
) -> DataFrame:
    """Rows with ``value`` >= quantile ``p``, counted by ``by``, largest count first."""
    return order_desc(count_by(at_or_above(df, value, p, cut=cut), by, n), n, by)


def bottom_share_by(
    df: DataFrame, p: float, by: list[str], value: str = K.SERVICE, n: str = "n", cut: Column | None = None
) -> DataFrame:
    """Rows with ``value`` <= quantile ``p``, counted by ``by``, largest count first."""
    return order_desc(count_by(at_or_below(df, value, p, cut=cut), by, n), n, by)


def group_mean(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Mean of ``value`` per group; rows with a NULL value or NULL key are dropped first."""
    keep = F.col(value).isNotNull()
    for b in by:
        keep = keep & F.col(b).isNotNull()
    return df.where(keep).groupBy(*by).agg(F.avg(value).alias(value))


def mean_report(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Group means, largest first."""
    return order_desc(group_mean(df, value, by), value, by)


def best_group_means(df: DataFrame, value: str, by: list[str], p: float = 0.9) -> DataFrame:
    """Groups whose mean is >= the quantile ``p`` of all group means."""
    means = group_mean(df, value, by)
    cut = exact_quantiles(means, value, (p,)).select(F.col("q")[0]).scalar()
    return order_desc(at_or_above(means, value, p, cut=cut), value, by)


def worst_group_means(df: DataFrame, value: str, by: list[str], p: float = 0.1) -> DataFrame:
    """Groups whose mean is <= the quantile ``p`` of all group means."""
    means = group_mean(df, value, by)
    cut = exact_quantiles(means, value, (p,)).select(F.col("q")[0]).scalar()
    return order_desc(at_or_below(means, value, p, cut=cut), value, by)


def top_groups(counts: DataFrame, value: str = "n", p: float = 0.8, ties: list[str] = ()) -> DataFrame:
    """Rows of a per-group count table whose count is >= its quantile ``p`` (the "top 20%")."""
    return order_desc(at_or_above(counts, value, p), value, ties)
