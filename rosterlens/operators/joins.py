"""Join helpers with explicit size bounds.

* ``broadcast_if_small`` broadcasts a side only after checking, with a
  bounded read, that it has at most ``max_rows`` rows.
* ``sampled_hot_keys`` finds the keys that own very many rows of a large
  table from a Bernoulli sample. A key is hot when its sampled count
  reaches ``max(fraction * hot_min_rows, sampled_rows / max_hot_keys)``,
  so there are at most ``max_hot_keys`` hot keys whatever the sample: the
  list is safe to broadcast. The hot set only decides which route rows
  take, never what the result is, so an estimate is enough.
* ``split_by_keys`` splits a table into the rows of a (broadcast) key set
  and the rest, with map-side semi/anti joins: no shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_MIN_ROWS = 1_000_000
MAX_HOT_KEYS = 100_000
SAMPLE_FRACTION = 0.001
HOT_KEY = "_hot_key"


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """``broadcast(df)`` if it has at most ``max_rows`` rows, else ``df`` unchanged.

    The check reads at most ``max_rows + 1`` rows.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def sampled_hot_keys(
    df: DataFrame,
    key: str,
    fraction: float = SAMPLE_FRACTION,
    hot_min_rows: int = HOT_MIN_ROWS,
    max_hot_keys: int = MAX_HOT_KEYS,
    seed: int = 17,
) -> DataFrame:
    """Keys (column ``_hot_key``) estimated to own at least ``hot_min_rows`` rows; at most ``max_hot_keys``."""
    sample = df.select(F.col(key).alias(HOT_KEY)).where(F.col(HOT_KEY).isNotNull()).sample(fraction=fraction, seed=seed)
    counts = sample.groupBy(HOT_KEY).agg(F.count(F.lit(1)).alias("_n"))
    sampled_rows = counts.select(F.sum("_n").alias("_t")).scalar()
    limit = F.greatest(F.lit(fraction * hot_min_rows), sampled_rows / F.lit(max_hot_keys))
    return counts.where(F.col("_n") >= limit).select(HOT_KEY)


def split_by_keys(df: DataFrame, key: str, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose ``key`` is in ``keys``, all other rows); ``keys`` is broadcast."""
    k = F.broadcast(keys)
    on = F.col(key) == F.col(HOT_KEY)
    return df.join(k, on, "left_semi"), df.join(k, on, "left_anti")
