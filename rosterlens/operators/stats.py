"""Summary statistics (A13-A21): six-number summary, box statistics,
per-group linear fit, share of total, id gap, unobserved period.

Every statistic is a grouped aggregate with a map-side partial step.
Box statistics first fold the rows into a (group, value) -> count
histogram, so the second pass (whiskers, outliers) joins the per-group
quartiles to the histogram, not to the raw rows.
"""

from __future__ import annotations

import math
from functools import reduce
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rosterlens import constants as K
from rosterlens.functions import round_half_even

QUARTILES = [0.25, 0.5, 0.75]
DIGITS = 6


def _r(c: Column, digits: int = DIGITS) -> Column:
    return F.round(c, digits)


def six_number(df: DataFrame, value: str, prefix: str | None = None) -> DataFrame:
    """min, q1, median, mean, q3, max and the NULL count of ``value`` (one row)."""
    p = f"{prefix or value}_"
    q = F.percentile(F.col(value), QUARTILES)
    return df.agg(
        F.min(value).alias(p + "min"),
        _r(q[0]).alias(p + "q1"),
        _r(q[1]).alias(p + "median"),
        F.avg(value).alias(p + "mean"),
        _r(q[2]).alias(p + "q3"),
        F.max(value).alias(p + "max"),
        F.count_if(F.col(value).isNull()).alias(p + "nas"),
    )


def _join_on_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on ``keys`` where NULL keys match (right-side keys dropped)."""
    r = right.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    return left.join(r, cond).drop(*[f"_k_{k}" for k in keys])


def box_stats(
    df: DataFrame, value: str, by: list[str], coef: float = K.WHISKER_COEF, with_range: bool = False
) -> DataFrame:
    """Box-plot statistics per group.

    q1/median/q3 are type-7 quartiles; ``lo``/``hi`` are the whisker ends
    (extreme values within ``coef`` inter-quartile ranges of the box, never
    inside the box); ``n_out`` counts values beyond them; ``mean`` is the
    group mean. ``with_range`` adds the plain ``min``/``max``. The shown
    statistics also come as labels with one digit, ties to even.
    """
    j, inside = _fenced(df, value, by, coef)
    v = F.col(value).cast("double")
    # q1 ... max are the group's own statistics, equal on every row of the group
    out = j.groupBy(*by).agg(
        _r(F.max("q1")).alias("q1"),
        _r(F.max("median")).alias("median"),
        _r(F.max("q3")).alias("q3"),
        _r(F.least(F.max("q1"), F.min(F.when(inside, v)))).alias("lo"),
        _r(F.greatest(F.max("q3"), F.max(F.when(inside, v)))).alias("hi"),
        F.sum(F.when(inside, F.lit(0)).otherwise(F.col("_c"))).alias("n_out"),
        _r(F.max("mean")).alias("mean"),
        F.max("min").alias("min"),
        F.max("max").alias("max"),
        *[round_half_even(F.max(c).cast("double")).alias(f"{c}_label") for c in ("mean", "min", "max")],
    )
    return out if with_range else out.drop("min", "max", "min_label", "max_label")


def box_outliers(df: DataFrame, value: str, by: list[str], coef: float = K.WHISKER_COEF) -> DataFrame:
    """The values beyond the whiskers: one row per (group, value) with its number of rows ``n``."""
    j, inside = _fenced(df, value, by, coef)
    return j.where(~inside).select(*by, value, F.col("_c").alias("n"))


def _fenced(df: DataFrame, value: str, by: list[str], coef: float) -> tuple[DataFrame, Column]:
    """(group, value) histogram with the group's statistics, and whether a value is within the whiskers."""
    hist = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c"))
    q = F.percentile(F.col(value), QUARTILES, F.col("_c"))
    stats = hist.groupBy(*by).agg(
        q[0].alias("q1"),
        q[1].alias("median"),
        q[2].alias("q3"),
        (F.sum(F.col(value) * F.col("_c")) / F.sum("_c")).alias("mean"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )
    j = _join_on_keys(hist, stats, by)
    iqr = F.col("q3") - F.col("q1")
    low_fence = F.col("q1") - F.lit(coef) * iqr
    high_fence = F.col("q3") + F.lit(coef) * iqr
    return j, (F.col(value) >= low_fence) & (F.col(value) <= high_fence)


_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def linear_fit(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """Least-squares line ``y ~ x`` per group.

    slope/intercept/r2 are NULL when the fit is undefined (fewer than two
    points or a constant ``x``). ``sxx``/``syy``/``sxy`` (sums of centred
    squares and products) and ``avgx``/``avgy`` are kept for standard errors.

    For integer columns the fit comes from exact sums (n, Σx, Σy, Σx², Σy²,
    Σxy as 38-digit decimals), followed by a few double operations in a
    fixed order. Any engine that follows the same steps gets the same
    bits, whatever its partitioning or summation order; the sums (``sums``) stay with
    the fit, so fitted values are exact up to one division. Other column
    types use the ``regr_*`` aggregates.
    """
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    types = dict((f.name, f.dataType) for f in df.schema.fields)
    if not (isinstance(types[x], _INTEGRAL) and isinstance(types[y], _INTEGRAL)):
        return rows.groupBy(*by).agg(
            F.regr_count(y, x).alias("n"),
            F.regr_slope(y, x).alias("slope"),
            F.regr_intercept(y, x).alias("intercept"),
            F.regr_r2(y, x).alias("r2"),
            F.regr_sxx(y, x).alias("sxx"),
            F.regr_syy(y, x).alias("syy"),
            F.regr_sxy(y, x).alias("sxy"),
            F.regr_avgx(y, x).alias("avgx"),
            F.regr_avgy(y, x).alias("avgy"),
        )
    dec = T.DecimalType(38, 0)
    xs, ys = F.col(x).cast(dec), F.col(y).cast(dec)
    sums = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(xs).alias("_sx"),
        F.sum(ys).alias("_sy"),
        F.sum(xs * xs).alias("_sxx"),
        F.sum(ys * ys).alias("_syy"),
        F.sum(xs * ys).alias("_sxy"),
    )
    n = F.col("n").cast(dec)
    exact = sums.withColumns(
        {
            "sums": F.struct(
                F.col("_sx").alias("x"),
                F.col("_sy").alias("y"),
                (n * F.col("_sxx") - F.col("_sx") * F.col("_sx")).alias("xx"),
                (n * F.col("_sxy") - F.col("_sx") * F.col("_sy")).alias("xy"),
            ),
            "_Syy": (n * F.col("_syy") - F.col("_sy") * F.col("_sy")).cast("double"),
        }
    )
    centred = exact.select(
        *by,
        "n",
        "sums",
        F.col("sums.xx").cast("double").alias("_Sxx"),
        "_Syy",
        F.col("sums.xy").cast("double").alias("_Sxy"),
        (F.col("_sx").cast("double") / F.col("n")).alias("avgx"),
        (F.col("_sy").cast("double") / F.col("n")).alias("avgy"),
    )
    defined = (F.col("n") > 1) & (F.col("_Sxx") > 0)
    slope = F.col("_Sxy") / F.col("_Sxx")
    r2 = F.when(F.col("_Syy") == 0, F.lit(1.0)).otherwise(F.col("_Sxy") * F.col("_Sxy") / (F.col("_Sxx") * F.col("_Syy")))
    return centred.select(
        *by,
        "n",
        F.when(defined, slope).alias("slope"),
        F.when(defined, _fitted(F.lit(0), slope)).alias("intercept"),
        F.when(defined, r2).alias("r2"),
        (F.col("_Sxx") / F.col("n")).alias("sxx"),
        (F.col("_Syy") / F.col("n")).alias("syy"),
        (F.col("_Sxy") / F.col("n")).alias("sxy"),
        "avgx",
        "avgy",
        "sums",
    )


def _fitted(x: Column, slope: Column) -> Column:
    """Value of the fitted line at integer ``x``: one division of exact integers.

    (Σy · Sxx + Sxy · (n·x − Σx)) / (n · Sxx); a value half-way between two
    rounded ones stays there. Beyond 38 digits it is mean(y) + slope · (x − mean(x)).
    """
    dec = T.DecimalType(38, 0)
    n, s = F.col("n").cast(dec), F.col("sums")
    above = F.try_add(F.try_multiply(s["y"], s["xx"]), F.try_multiply(s["xy"], F.try_subtract(F.try_multiply(n, x.cast(dec)), s["x"])))
    below = F.try_multiply(n, s["xx"])
    exact = F.try_divide(above.cast("double"), below.cast("double"))
    return F.coalesce(exact, F.col("avgy") + slope * (x - F.col("avgx")))


def fit_grid(
    fit: DataFrame, by: list[str], x_from: Column, x_to: Column, x_name: str = "x", level: float = K.BAND_LEVEL
) -> DataFrame:
    """Fitted value, its standard error and its confidence band at every integer ``x`` in [x_from, x_to].

    ``x_from``/``x_to`` are usually scalar subqueries over the fitted data
    (the full range shared by all groups). ``fit`` comes from :func:`linear_fit`.
    The band is fit ± t · se, t the quantile of Student's distribution with
    n − 2 degrees of freedom that leaves ``level`` in the middle; with two points
    there is a line but neither error nor band.
    """
    sse = F.col("syy") - F.col("sxy") * F.col("sxy") / F.col("sxx")
    sigma = F.sqrt(F.try_divide(F.greatest(sse, F.lit(0.0)), (F.col("n") - 2).cast("double")))
    # one error and one multiplier per group, then the grid
    lines = fit.where(F.col("slope").isNotNull()).select(
        "*", F.when(F.col("n") > 2, sigma).alias("_sigma"), student_t(F.col("n") - 2, level).alias("_t")
    )
    grid = lines.select("*", F.explode(F.sequence(x_from.cast("int"), x_to.cast("int"))).alias(x_name))
    x = F.col(x_name)
    dx = x - F.col("avgx")
    if "sums" in fit.columns:
        value = _fitted(x, F.col("slope"))
    else:
        value = F.col("avgy") + F.col("slope") * dx
    se = F.col("_sigma") * F.sqrt(1.0 / F.col("n") + dx * dx / F.col("sxx"))
    rows = grid.select(*by, x_name, value.alias("fit"), se.alias("se_fit"), "_t", "n")
    half = F.col("_t") * F.col("se_fit")
    return rows.select(
        *by, x_name, "fit", "se_fit", (F.col("fit") - half).alias("band_low"), (F.col("fit") + half).alias("band_high"), "n"
    )


_SERIES = 200      # degrees of freedom up to which Student's distribution is summed; beyond, its expansion is exact


def _middle(theta: Column, df: Column) -> tuple[Column, Column]:
    """P(|T| <= sqrt(df) * tan(theta)) for whole ``df``, and its derivative by theta.

    The finite series in cos(theta): its terms depend on whether df is odd.
    """
    odd, cos = df % 2, F.cos(theta)
    start = F.struct(
        F.lit(0.0).alias("total"), F.when(odd == 1, cos).otherwise(F.lit(1.0)).alias("term"),
        F.when(odd == 1, F.lit(2 / math.pi)).otherwise(F.lit(1.0)).alias("scale"),
    )

    def step(a: Column, j: Column) -> Column:
        even_scale = F.when(j > 1, (2 * j - 1) / (2.0 * j - 2)).otherwise(F.lit(1.0))
        return F.struct(
            (a["total"] + a["term"]).alias("total"),
            (a["term"] * cos * cos * (2 * j - 1 + odd) / (2.0 * j + odd)).alias("term"),
            (a["scale"] * F.when(odd == 1, 2.0 * j / (2 * j - 1)).otherwise(even_scale)).alias("scale"),
        )

    # df = 1 has no terms: an empty list, not the two steps of a sequence that counts down
    steps = F.when(df >= 2, F.sequence(F.lit(1), (df / 2).cast("int"))).otherwise(F.array().cast("array<int>"))
    sums = F.aggregate(steps, start, step)
    inside = F.sin(theta) * sums["total"]
    chance = F.when(odd == 1, (theta + inside) * (2 / math.pi)).otherwise(inside)
    return chance, sums["scale"] * F.pow(cos, df - 1)


def student_t(df: Column, level: float = K.BAND_LEVEL) -> Column:
    """The t with P(-t <= T <= t) = ``level`` under Student's distribution; NULL below one degree of freedom.

    Start: the expansion around the normal quantile in powers of 1/df, whose error
    is below 1e-11 from 200 degrees of freedom on. Below, Newton steps on the finite series.
    """
    z = NormalDist().inv_cdf((1 + level) / 2)
    terms = (
        z,
        (z**3 + z) / 4,
        (5 * z**5 + 16 * z**3 + 3 * z) / 96,
        (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384,
        (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160,
    )
    d = df.cast("double")
    near = reduce(lambda a, b: a + b, [F.lit(c) / F.pow(d, F.lit(float(k))) for k, c in enumerate(terms)])
    whole = df.cast("int")
    start = F.when(whole == 1, F.lit(level * math.pi / 2)).otherwise(F.atan(near / F.sqrt(d)))

    def closer(theta: Column, _: Column) -> Column:
        chance, slope = _middle(theta, whole)
        return theta - (chance - level) / slope

    theta = F.aggregate(F.array(*[F.lit(i) for i in range(6)]), start, closer)
    return F.when(df > _SERIES, near).when(df >= 1, F.sqrt(d) * F.tan(theta))


def share_of_total(df: DataFrame, value: str, out: str = "share") -> DataFrame:
    """``value / sum(value)`` over a per-group table (one row per slice).

    The total is a scalar subquery with a partial sum per task; the aggregate
    below it is one shuffle that both uses share. A zero total gives NULL shares.
    """
    total = df.select(F.sum(value).alias("_total")).scalar()
    return df.withColumn(out, F.try_divide(F.col(value).cast("double"), total.cast("double")))


def id_gap(df: DataFrame, id_col: str = K.ID) -> DataFrame:
    """Ids missing from the dense range [min, max]: max - min + 1 - distinct ids."""
    return df.agg((F.max(id_col) - F.min(id_col) + 1 - F.count_distinct(id_col)).cast("long").alias("id_gap"))


def unobserved_years(df: DataFrame, first_record: str = K.RECORD_DATE, first_hire: str = K.HIRE_DATE) -> DataFrame:
    """Whole years between the first hire and the first record."""
    days = F.date_diff(F.min(first_record), F.min(first_hire))
    return df.agg(F.floor(days / F.lit(K.DAYS_PER_YEAR)).cast("long").alias("unknown_period"))
