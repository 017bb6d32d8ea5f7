"""Exact uniform shuffle into shards: a hypergeometric communication matrix.

Rows sit in ``parts`` logical source partitions (a hash of the id, so a
retried task sees the same ones). A uniformly random split of all rows into
shards of fixed sizes sends to shard s from partition p a number of rows that
follows the multivariate hypergeometric law; that matrix of counts is drawn
first, exactly. Then

1. *permute locally*: the rows of each source partition are ranked by a
   seeded random key;
2. *exchange*: the rank's place in the partition's row of the matrix decides
   the shard, so every shard gets exactly its size;
3. *permute again*: inside a shard the rows are ranked by a second random
   key. A shard is far too large for one task, so it is cut into random
   buckets first; a row's slot is its rank in its bucket plus the rows of the
   buckets before.

Only counts per partition and per (shard, bucket) leave the rows; they
depend on the number of partitions, which is a parameter, not on the rows.
"""

from __future__ import annotations

import json
import math
import random
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_PART = 20_000
MAX_PARTS = 16_384       # the matrix has at most so many rows; beyond, a window's sort spills


def _log_choose(n: int, k: int) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def hypergeometric(rng: random.Random, marked: int, others: int, draws: int) -> int:
    """How many of ``marked`` items are among ``draws`` taken from marked + others.

    Inversion that walks outwards from the mode, so the cost is of the order of
    the standard deviation, and no table is kept.
    """
    low, high = max(0, draws - others), min(draws, marked)
    if low >= high:
        return low
    mode = min(high, max(low, ((draws + 1) * (marked + 1)) // (marked + others + 2)))
    p_mode = math.exp(_log_choose(marked, mode) + _log_choose(others, draws - mode) - _log_choose(marked + others, draws))
    u = rng.random() - p_mode
    down, up, p_down, p_up = mode, mode, p_mode, p_mode
    while u > 0 and (down > low or up < high):
        if up < high:
            p_up *= (marked - up) * (draws - up) / ((up + 1) * (others - draws + up + 1))
            up += 1
            u -= p_up
            if u <= 0:
                return up
        if down > low:
            p_down *= down * (others - draws + down) / ((marked - down + 1) * (draws - down + 1))
            down -= 1
            u -= p_down
            if u <= 0:
                return down
        if p_up < 1e-300 and p_down < 1e-300:   # rounding has left a crumb of u
            return mode
    return mode


def communication_matrix(rows: list[int], sizes: list[int], seed: int) -> list[list[int]]:
    """counts[p][s] of a uniform split: row sums ``rows``, column sums ``sizes``."""
    rng, left, out = random.Random(seed), list(sizes), []
    for n in rows:
        todo, rest, counts = n, sum(left), []
        for s in left:
            rest -= s
            counts.append(hypergeometric(rng, s, rest, todo))
            todo -= counts[-1]
        left = [a - b for a, b in zip(left, counts, strict=True)]
        out.append(counts)
    return out


def uniform_shards(
    rows: DataFrame, key: str, shards: int, seed: int = 17, parts: int | None = None, buckets: int | None = None
) -> DataFrame:
    """``rows`` with ``shard`` (int) and ``slot`` (long, gapless from 0 in each shard).

    Every split of the rows into shards whose sizes differ by at most one is
    equally likely (over the seed). ``key`` orders rows whose random keys tie;
    a null or repeated key is fine: equal rows are exchangeable. ``parts`` and
    ``buckets`` bound a task's rows; by default they grow with the input. An
    empty table stays empty. Columns named like the two new ones are replaced;
    helper columns start with ``__`` and are dropped.
    """
    spark = rows.sparkSession
    rows = rows.drop("shard", "slot")
    if parts is None or buckets is None:
        total = rows.count()
        parts = parts or min(MAX_PARTS, max(1, math.ceil(total / ROWS_PER_PART)))
        buckets = buckets or max(1, math.ceil(total / shards / ROWS_PER_PART))
    shown = [F.col(f"`{c}`") for c in rows.columns if not isinstance(rows.schema[c].dataType, _unhashed())]

    def draw(salt: int) -> Column:   # a random key of the row's content under the seed
        return F.xxhash64(F.lit(seed * 1000 + salt), *shown)

    spread = rows.withColumn("__part", F.pmod(draw(1), F.lit(parts)).cast("int"))
    ranked = spread.withColumn(
        "__rank", F.row_number().over(Window.partitionBy("__part").orderBy(draw(2), F.col(f"`{key}`"))) - 1
    )
    found = {r["__part"]: r["n"] for r in spread.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).collect()}
    counts = [found.get(p, 0) for p in range(parts)]
    total = sum(counts)
    sizes = [total // shards + (s < total % shards) for s in range(shards)]
    matrix = communication_matrix(counts, sizes, seed)
    if not total:
        return rows.withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("long")}).limit(0)
    # place in a partition -> shard: at most MAX_PARTS x shards numbers, whatever the input
    ends = [{"__part": p, "__ends": list(accumulate(row))} for p, row in enumerate(matrix)]
    bounds = spark.range(1).select(
        F.inline(F.from_json(F.lit(json.dumps(ends)), "array<struct<__part int, __ends array<long>>>"))
    )
    sent = ranked.join(F.broadcast(bounds), "__part").withColumn(
        "shard", F.size(F.filter("__ends", lambda e: e <= F.col("__rank"))).cast("int")
    )
    # the second permutation, cut into buckets of a shard
    sent = sent.withColumn("__bucket", F.pmod(draw(3), F.lit(buckets)).cast("int")).drop("__part", "__rank", "__ends")
    before = Window.partitionBy("shard").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        sent.groupBy("shard", "__bucket")
        .agg(F.count(F.lit(1)).alias("__n"))
        .withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
        .drop("__n")
    )
    inside = F.row_number().over(Window.partitionBy("shard", "__bucket").orderBy(draw(4), F.col(f"`{key}`"))) - 1
    slots = sent.withColumn("__inside", inside).join(offsets, ["shard", "__bucket"])
    return slots.withColumn("slot", (F.col("__before") + F.col("__inside")).cast("long")).drop(
        "__bucket", "__inside", "__before"
    )


def _unhashed():
    from pyspark.sql import types as T

    return (T.MapType, T.VariantType)
