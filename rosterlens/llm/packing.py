"""Best-fit packing by a grouping genetic algorithm on islands.

Documents become pieces of at most ``capacity`` tokens; pieces are spread over
shards of about ``SHARD`` pieces by hash, so one shard's problem has a fixed
size whatever the corpus. Each shard is solved by ``ISLANDS`` islands, each
with its own seed and population, which it keeps from epoch to epoch. A solution
is a list of bins. Crossover injects whole well-filled bins of one parent into
another one, drops the bins that then hold a document twice, and best-fits the
displaced documents, longest first, after exchanging some for shorter ones of bins
that are not full. After every epoch an island's elite migrates
to the next island of its shard; the best of all islands is the shard's
result. An island whose best solution needs no more bins than the tokens fill is done: it
breeds no further. What the shards leave in badly filled bins is packed once
more, together.
"""

from __future__ import annotations

import bisect
import math
import random
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rosterlens.llm.common import give_back_memory, slices, stored
from rosterlens.llm.tokens import SLICE, encoder

SHARD = 4_000
ISLANDS, EPOCHS, POPULATION, CHILDREN = 3, 3, 6, 24     # children an island breeds in one epoch, if it must
EXCHANGES = 200         # bins that a crossover tries to fill better
LOOSE = 0.97            # bins of the shards filled less than this are packed again
PIECE = "struct<doc_id: bigint, piece: int, start: bigint, length: bigint, ids_crc32: bigint>"


class Bins:
    """Open bins by free space: an int's bits say which amounts of space exist."""

    def __init__(self, capacity: int):
        self.capacity, self.mask, self.by_free = capacity, 0, {}

    def add(self, bin_: list[int], free: int) -> None:
        self.by_free.setdefault(free, []).append(bin_)
        self.mask |= 1 << free

    def place(self, i: int, length: int) -> None:
        """Into the fullest bin that has room, else into a new one."""
        fits = self.mask >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            bins = self.by_free[free]
            bin_ = bins.pop()
            if not bins:
                self.mask &= ~(1 << free)
        else:
            bin_, free = [], self.capacity
        bin_.append(i)
        self.add(bin_, free - length)

    def all(self) -> list[list[int]]:
        return [b for bins in self.by_free.values() for b in bins]


def best_fit(lengths: list[int], todo: list[int], capacity: int, bins: list[list[int]] = ()) -> list[list[int]]:
    open_ = Bins(capacity)
    for b in bins:
        open_.add(list(b), capacity - sum(lengths[i] for i in b))
    for i in todo:
        open_.place(i, lengths[i])
    return open_.all()


def fitness(lengths: list[int], bins: list[list[int]], capacity: int) -> tuple[int, float]:
    """Fewer bins first; then uneven filling, which leaves room to empty one."""
    return -len(bins), sum((sum(lengths[i] for i in b) / capacity) ** 2 for b in bins)


def crossover(rng: random.Random, lengths: list[int], one: list[list[int]], two: list[list[int]], capacity: int) -> list[list[int]]:
    ranked = sorted(two, key=lambda b: -sum(lengths[i] for i in b))
    injected = ranked[: rng.randint(1, max(1, len(ranked) // 2))]
    taken = {i for b in injected for i in b}
    kept, displaced = [], []
    for b in one:
        if taken.isdisjoint(b):
            kept.append(b)
        else:
            displaced += [i for i in b if i not in taken]
    # a few of the worst-filled bins are opened as well, so that the search can lower their number
    kept.sort(key=lambda b: sum(lengths[i] for i in b))
    for _ in range(min(rng.randint(0, 4), len(kept))):
        displaced += kept.pop(0)
    kept = [list(b) for b in kept]
    displaced = exchanged(rng, lengths, kept, displaced, capacity)
    displaced.sort(key=lambda i: -lengths[i])
    return best_fit(lengths, displaced, capacity, [*injected, *kept])


def exchanged(rng: random.Random, lengths: list[int], bins: list[list[int]], displaced: list[int], capacity: int) -> list[int]:
    """Displaced documents after exchanges that fill bins better: one or two of a bin against a longer one.

    What comes out is shorter, so it is easier to place. Looks at ``EXCHANGES`` bins.
    """
    displaced = sorted(displaced, key=lambda i: lengths[i])
    for b in rng.sample(bins, min(EXCHANGES, len(bins))):
        free = capacity - sum(lengths[i] for i in b)
        if not free or not displaced:
            continue
        sizes = [lengths[i] for i in displaced]
        best, gain = None, 0
        for out in [(i,) for i in b] + [(i, j) for k, i in enumerate(b) for j in b[k + 1 :]]:
            size = sum(lengths[i] for i in out)
            at = bisect.bisect_right(sizes, size + free) - 1         # the longest that fits in their place
            if at >= 0 and sizes[at] - size > gain:
                best, gain = (out, at), sizes[at] - size
        if best:
            out, at = best
            b[:] = [i for i in b if i not in out] + [displaced.pop(at)]
            for i in out:
                bisect.insort(displaced, i, key=lambda i: lengths[i])
    return displaced


def least_bins(lengths: list[int], capacity: int) -> int:
    """No solution has fewer bins."""
    return -(-sum(lengths) // capacity)


def evolve(rng: random.Random, lengths: list[int], population: list, capacity: int, children: int) -> list:
    """The population, best first, after ``children`` crossovers of two different parents, or fewer if the bound is met."""
    score = lambda p: fitness(lengths, p, capacity)
    bound = least_bins(lengths, capacity)
    ranked = sorted(((score(p), [list(b) for b in p]) for p in population), key=lambda x: x[0], reverse=True)
    for _ in range(children):
        if -ranked[0][0][0] <= bound or len(ranked) < 2:
            break
        (_, one), (_, two) = rng.sample(ranked, 2)
        child = crossover(rng, lengths, one, two, capacity)
        told = score(child)
        if all(told != s for s, _ in ranked):                # a twin would only crowd the others out
            ranked = sorted([*ranked[: POPULATION - 1], (told, child)], key=lambda x: x[0], reverse=True)
    return [p for _, p in ranked]


def seeds(rng: random.Random, lengths: list[int], capacity: int, size: int) -> list:
    """First solutions: best fit of the longest first, with growing noise."""
    out = []
    for k in range(size):
        noise = {i: lengths[i] * (1 + 0.1 * k * rng.random()) for i in range(len(lengths))}
        out.append(best_fit(lengths, sorted(range(len(lengths)), key=lambda i: -noise[i]), capacity))
    return out


def _flat(solution: list[list[int]], n: int) -> list[int]:
    place = [0] * n
    for b, bin_ in enumerate(solution):
        for i in bin_:
            place[i] = b
    return place


def _bins(place: list[int]) -> list[list[int]]:
    out: dict[int, list[int]] = {}
    for i, b in enumerate(place):
        out.setdefault(b, []).append(i)
    return list(out.values())


_STATE = pa.schema(
    [("shard", pa.int64()), ("island", pa.int32()), ("bins", pa.int64()), ("fill", pa.float64()),
     ("population", pa.list_(pa.list_(pa.int32())))]
)


def _epoch(capacity: int):
    """(shard, island, epoch, lengths, population, migrant) -> the island's population, best first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lengths = row["lengths"]
                rng = random.Random(row["shard"] * 1009 + row["island"] * 31 + row["epoch"])
                if row["population"] is None:
                    # one plain best fit; more only where it misses the bound
                    population = seeds(rng, lengths, capacity, 1)
                    if len(population[0]) > least_bins(lengths, capacity):
                        population += seeds(rng, lengths, capacity, POPULATION)[1:]
                else:
                    population = [_bins(p) for p in row["population"]]
                    if row["migrant"] is not None:
                        population = [*population[: POPULATION - 1], _bins(row["migrant"])]
                population = evolve(rng, lengths, population, capacity, CHILDREN)
                told = fitness(lengths, population[0], capacity)
                if -told[0] <= least_bins(lengths, capacity):
                    population = population[:1]
                flat = [_flat(p, len(lengths)) for p in population]
                yield pa.RecordBatch.from_pylist(
                    [{"shard": row["shard"], "island": row["island"], "bins": -told[0], "fill": told[1], "population": flat}], _STATE
                )

    return run


def pieces_of(ids: np.ndarray, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; the first takes what the others leave."""
    if len(ids) == 0:
        return []
    first = len(ids) % capacity or capacity
    starts = [0, *range(first, len(ids), capacity)]
    return [(a, b - a) for a, b in zip(starts, [*starts[1:], len(ids)], strict=True)]


def _tokenized(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            for lo, hi in slices(batch["text"], SLICE):
                rows = batch.slice(lo, hi - lo)
                every, places = encode.encode(rows["text"])
                out: list[tuple] = []
                for doc, a, b in zip(rows["doc_id"].to_pylist(), places[:-1], places[1:], strict=True):
                    ids = np.append(every[a:b], end_id).astype("<u4")
                    out += [
                        (doc, k, start, n, zlib.crc32(ids[start : start + n].tobytes()))
                        for k, (start, n) in enumerate(pieces_of(ids, capacity))
                    ]
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(types)], names)
            give_back_memory(encoders=True)

    return run


def _pack_shards(pieces: DataFrame, capacity: int, shards: int, tag: str) -> DataFrame:
    """``pieces`` plus ``shard``, ``bin`` and ``offset``: every shard's best island."""
    salt = F.xxhash64("doc_id", "piece", F.monotonically_increasing_id())    # repeated rows spread too
    dealt = pieces.withColumn("shard", F.pmod(salt, F.lit(shards)))
    packed = F.struct("doc_id", "piece", "start", "length", "ids_crc32")
    dealt = stored(dealt.groupBy("shard").agg(F.array_sort(F.collect_list(packed)).alias("pieces")), f"{tag}-shards")
    lengths = F.transform("pieces", lambda p: p["length"].cast("int")).alias("lengths")
    islands = F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island")
    told = "shard long, island int, bins long, fill double, population array<array<int>>"
    state = None
    spread = max(1, shards * ISLANDS)
    bound = F.ceil(F.aggregate("lengths", F.lit(0).cast("long"), lambda total, n: total + n) / capacity)
    for epoch in range(EPOCHS):
        rows = dealt.select("shard", lengths, islands)
        if state is None:
            rows = rows.withColumns({"population": F.lit(None).cast("array<array<int>>"), "migrant": F.lit(None).cast("array<int>")})
        else:
            # shards that met the bound are done
            missed = dealt.select("shard", lengths).select("shard", bound.alias("least")).join(
                state.groupBy("shard").agg(F.min("bins").alias("now")), "shard"
            ).where("now > least").select("shard")
            own = state.select("shard", "island", "population")
            moved = state.select("shard", ((F.col("island") + 1) % ISLANDS).alias("island"), F.col("population")[0].alias("migrant"))
            rows = rows.join(missed, "shard").join(own, ["shard", "island"]).join(moved, ["shard", "island"])
        rows = rows.withColumn("epoch", F.lit(epoch)).repartition(spread, "shard", "island")
        new = stored(rows.mapInArrow(_epoch(capacity), told), f"{tag}-islands")
        if state is not None:
            new_shards = new.select("shard").distinct()
            new = stored(state.join(new_shards, "shard", "left_anti").unionByName(new), f"{tag}-islands")
        state = new
    state = state.withColumn("best", F.col("population")[0])
    best = state.groupBy("shard").agg(F.max(F.struct(-F.col("bins"), "fill", "island", "best"))["best"].alias("best"))
    each = dealt.join(best, "shard").select("shard", F.inline(F.arrays_zip("pieces", F.col("best").alias("bin"))))
    each = each.select("shard", F.col("bin").cast("long").alias("bin"), "pieces.*")
    inside = Window.partitionBy("shard", "bin").orderBy("doc_id", "piece", "start")
    before = F.sum("length").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    filled = F.sum("length").over(Window.partitionBy("shard", "bin"))
    return each.withColumns({"offset": F.coalesce(before, F.lit(0)), "filled": filled})


def pack(
    docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its whole text's ids and ``end_id`` (a null text: only that);
    one longer than ``capacity`` is cut into full pieces, the first of which may
    be shorter. A sequence holds at most ``capacity`` tokens, its pieces without
    gaps from offset 0. Repeated rows and null ids are packed like any other.
    An empty table gives no rows. Other columns are ignored.
    """
    docs = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    pieces = stored(docs.mapInArrow(_tokenized(path, capacity, end_id), schema), "pieces")
    open_ = pieces.where(F.col("length") < capacity)
    full = pieces.where(F.col("length") == capacity).select(
        "*", F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    n = open_.count()
    first = stored(_pack_shards(open_, capacity, max(1, math.ceil(n / SHARD)), "first"), "packed")
    tight = first.where(F.col("filled") >= LOOSE * capacity)
    loose = first.where(F.col("filled") < LOOSE * capacity)
    again = _pack_shards(loose.select(*pieces.columns), capacity, max(1, math.ceil(loose.count() / SHARD)), "again")
    # full pieces take numbers from 0 on; the two rounds have their own ranges below zero
    number = lambda base: -(F.lit(base).cast("long") + F.col("shard") * (1 << 20) + F.col("bin")) - 1
    columns = [*pieces.columns, "sequence_id", "offset"]
    return (
        full.select(*columns)
        .unionAll(tight.withColumn("sequence_id", number(0)).select(*columns))
        .unionAll(again.withColumn("sequence_id", number(1 << 62)).select(*columns))
    )
