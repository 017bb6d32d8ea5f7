"""Embedding near-dedup with binary codes of randomly rotated vectors.

Index, written once: a unit vector u is rotated by a fixed random rotation; the
signs of the result y are its code s, packed to bits, and f = <s, y> / sqrt(D),
the cosine between vector and code, is its correction factor. y itself is kept in
bytes, with its scale and the sum of what the rounding left. Everything after the
index reads these columns; nothing is rotated or encoded again.

A pair is judged in three steps, each on what the one before left:

1. Bits in which the codes differ. Two vectors at an angle a differ in a bit with
   probability a / pi; a pair over the count that a pair at the threshold exceeds
   with probability ``MISS`` is out. This is one exclusive or and a bit count a word.
2. <s, z> / (sqrt(D) f) estimates <u, v> without bias for the other rotated vector
   z, and its error stays within ``CONFIDENCE * sqrt((1 - f^2) / f^2 / (D - 1))``
   but for a tiny chance; z is read from its bytes, and the bound is widened by the
   most that their rounding can make. The upper bounds from both codes must reach
   the threshold.
3. The inner product in double precision decides.

Candidates: ``tables`` groups of ``bits`` code bits each; two vectors meet if all
bits of some group agree. ``bits`` grows with the logarithm of the largest
label, so that an ordinary bucket keeps its size, and ``tables`` so that a pair
at the threshold meets with probability ``RECALL`` or more. A bucket over
``BLOCK`` vectors is cut into blocks, and every pair of blocks is its own task
group: a hot bucket is spread, none of its pairs is left out and no group is
larger than two blocks. A pair that met in an earlier table is not counted
again. Each group returns a count per vector and a spanning forest of its
links, not the links. Equal vectors are one class that counts its copies.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlens.llm.common import ceil_log2, components, stored

BLOCK = 1024
RECALL = 0.99
CONFIDENCE = 4.0
MISS = 1e-6
PAIRS_AT_ONCE = 1 << 16
ROTATION_SEED = 20_240


def rotation(dims: int) -> np.ndarray:
    """A random orthogonal matrix, the same on every executor."""
    q, r = np.linalg.qr(np.random.default_rng(ROTATION_SEED + dims).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def encode(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rotated unit vectors, codes as +-1, correction factors)."""
    unit = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    y = unit @ rotation(vectors.shape[1]).T
    s = np.where(y >= 0, 1.0, -1.0)
    return y, s, (s * y).sum(axis=1) / math.sqrt(vectors.shape[1])


def upper_bounds(code: np.ndarray, factor: np.ndarray, other: np.ndarray, confidence: float = CONFIDENCE) -> np.ndarray:
    """Upper confidence bounds of the inner products of coded vectors (rows) with rotated ones."""
    d = code.shape[1]
    estimate = (code @ other.T) / (math.sqrt(d) * factor[:, None])
    error = confidence * np.sqrt(np.maximum(0.0, 1 - factor**2) / factor**2 / max(1, d - 1))
    return estimate + error[:, None]


def pack(code: np.ndarray) -> np.ndarray:
    """Codes of +-1 as rows of 64-bit words (the last one filled with zeros)."""
    words = -(-code.shape[1] // 64)
    bits = np.zeros((len(code), words * 64), bool)
    bits[:, : code.shape[1]] = code > 0
    return np.packbits(bits, axis=1).view(np.uint64)


def signs(words: np.ndarray, dims: int) -> np.ndarray:
    """The codes that :func:`pack` packed, as +-1."""
    return np.unpackbits(np.ascontiguousarray(words).view(np.uint8), axis=1, count=dims).astype(np.float64) * 2 - 1


def in_bytes(y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(y rounded to bytes, its scale, sum of what the rounding left) of each row."""
    scale = np.abs(y).max(axis=1) / 127
    small = np.rint(y / scale[:, None]).astype(np.int8)
    return small, scale, np.abs(y - small * scale[:, None]).sum(axis=1)


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Numbers of bits in which the packed codes ``a`` (rows) and ``b`` (columns) differ."""
    n = np.zeros((len(a), len(b)), np.int32)
    for w in range(a.shape[1]):
        n += np.bitwise_count(a[:, w, None] ^ b[None, :, w])
    return n


def most_differing(dims: int, threshold: float, miss: float = MISS) -> int:
    """The least count of differing bits that a pair at ``threshold`` exceeds with probability ``miss`` or less."""
    p = math.acos(min(1.0, max(-1.0, threshold))) / math.pi
    if not 0 < p < 1:
        return dims
    above, k = 0.0, dims
    while k > 0:
        choose = math.lgamma(dims + 1) - math.lgamma(k + 1) - math.lgamma(dims - k + 1)
        above += math.exp(choose + k * math.log(p) + (dims - k) * math.log1p(-p))
        if above > miss:
            return k
        k -= 1
    return 0


def exact_products(unit: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of the pairs of rows (p, q) in double precision."""
    return np.einsum("ij,ij->i", unit[p], unit[q])


def plan_tables(largest: int, threshold: float) -> tuple[int, int]:
    """(tables, bits per table) for the size of the largest label."""
    bits = ceil_log2(largest / BLOCK)
    if bits == 0:
        return 1, 0
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return max(1, math.ceil(math.log(1 - RECALL) / math.log(1 - agree))), bits


def _matrix(column: pa.Array, kind=np.float64) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def _bucket_keys(code: np.ndarray, tables: int, bits: int) -> np.ndarray:
    """keys[i, t]: the chosen code bits of vector i in table t, as one number."""
    rng = np.random.default_rng(ROTATION_SEED)
    out = np.zeros((len(code), tables), np.int64)
    for t in range(tables):
        chosen = rng.choice(code.shape[1], min(bits, code.shape[1]), replace=False)
        for c in chosen:
            out[:, t] = out[:, t] * 2 + (code[:, c] > 0)
    return out


CODED = "id long, label string, dims int, vector binary, code binary, turned binary, factor double, scale double, lost double, keys array<long>"
CODE_COLUMNS = ["code", "turned", "factor", "scale", "lost", "keys"]


def _index(tables: int, bits: int):
    def run(batches):
        for batch in batches:
            dims = batch["dims"].to_numpy(zero_copy_only=False)
            for d in np.unique(dims):
                rows = batch.filter(pa.array(dims == d))
                flat = rows["vector"].flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), d)
                y, code, factor = encode(flat)
                small, scale, lost = in_bytes(y)
                keys = _bucket_keys(code, tables, bits)
                ends = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * tables)
                yield pa.RecordBatch.from_arrays(
                    [
                        rows["id"], rows["label"], rows["dims"],
                        *(pa.array([v.tobytes() for v in part], pa.binary()) for part in (flat, pack(code), small)),
                        pa.array(factor), pa.array(scale), pa.array(lost),
                        pa.ListArray.from_arrays(ends, pa.array(keys.ravel())),
                    ],
                    ["id", "label", "dims", "vector", *CODE_COLUMNS],
                )

    return run


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes the smallest node it is connected with over the links a - b."""
    low = np.arange(n)
    while True:
        before = low.copy()
        least = np.minimum(low[a], low[b])
        np.minimum.at(low, a, least)
        np.minimum.at(low, b, least)
        low = low[low]
        if (low == before).all():
            return low


def _reaching(codes: dict[str, np.ndarray], p: np.ndarray, q: np.ndarray, threshold: float) -> np.ndarray:
    """Whether the upper bound of <row p, row q>, from the code of p and the bytes of q, reaches ``threshold``."""
    d = codes["turned"].shape[1]
    f, scale = codes["factor"][p], codes["scale"][q]
    product = np.einsum("ij,ij->i", signs(codes["code"][p], d), codes["turned"][q].astype(np.float64)) * scale
    error = CONFIDENCE * np.sqrt(np.maximum(0.0, 1 - f**2) / f**2 / max(1, d - 1))
    return (product + codes["lost"][q]) / (math.sqrt(d) * f) + error >= threshold


def _compare(threshold: float):
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("id").combine_chunks()
        ids = group["id"].to_numpy()
        x = _matrix(group["vector"].combine_chunks())
        unit = x / np.abs(x).max(axis=1, keepdims=True)
        unit /= np.linalg.norm(unit, axis=1, keepdims=True)
        codes = {
            "code": _matrix(group["code"].combine_chunks(), np.uint64),
            "turned": _matrix(group["turned"].combine_chunks(), np.int8),
            **{c: group[c].to_numpy() for c in ("factor", "scale", "lost")},
        }
        most = most_differing(x.shape[1], threshold)
        keys = np.array(group["keys"].to_pylist())
        block, lo, hi = group["block"].to_numpy(), group["lo"][0].as_py(), group["hi"][0].as_py()
        table = group["table"][0].as_py()
        links_a, links_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        left, right = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
        for i in range(0, len(left), 256):
            at = left[i : i + 256]
            near_p, near_q = np.nonzero(differing(codes["code"][at], codes["code"][right]) <= most)
            near_p, near_q = at[near_p], right[near_q]
            if lo == hi:
                once = near_p < near_q
                near_p, near_q = near_p[once], near_q[once]
            for j in range(0, len(near_p), PAIRS_AT_ONCE):
                p, q = near_p[j : j + PAIRS_AT_ONCE], near_q[j : j + PAIRS_AT_ONCE]
                new = ~(keys[p, :table] == keys[q, :table]).any(axis=1)
                p, q = p[new], q[new]
                both = _reaching(codes, p, q, threshold) & _reaching(codes, q, p, threshold)
                p, q = p[both], q[both]
                linked = exact_products(unit, p, q) >= threshold
                links_a.append(p[linked])
                links_b.append(q[linked])
        a, b = np.concatenate(links_a), np.concatenate(links_b)
        m = group["m"].to_numpy()
        n = np.bincount(a, m[b], len(ids)) + np.bincount(b, m[a], len(ids))
        root = _forest(a, b, len(ids))
        hit = n > 0
        return pa.table({"id": ids[hit], "n": n[hit].astype(np.int64), "root": ids[root[hit]]})

    return run


def near_vectors(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = 0.93
) -> DataFrame:
    """One row per vector: ``vec_id``, ``n_links``, ``component_id`` and ``kept``.

    Vectors of one length and one non-null label link when their cosine is at
    least ``threshold``; a vector that is null, empty, zero or holds null or
    non-finite numbers, and one with a null id, links with nothing. Rows that
    repeat id, label and vector are one vector (each gets its result); rows
    that share only the id share one result. Other columns are ignored.
    """
    v = F.col("vector")
    rows = vectors.select(
        F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{label}`").cast("string").alias("label"),
        F.col(f"`{vector}`").cast("array<double>").alias("vector"),
    )
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0))
    usable = usable.withColumn("dims", F.size(v)).dropDuplicates(["id", "label", "vector"])
    largest = usable.groupBy("label", "dims").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    tables, bits = plan_tables(largest, threshold)
    index = stored(
        usable.select("id", "label", "dims", "vector").mapInArrow(_index(tables, bits), CODED), "codes"
    )
    same = ["label", "dims", "vector"]
    # one row's codes stand for its class: they come from one vector, rotated once
    one = F.first(F.struct(*CODE_COLUMNS)).alias("one")
    classes = stored(
        index.groupBy(*same).agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("m"), one).select(*same, "rep", "m", "one.*"), "classes"
    )
    met = ["label", "dims", "table", "bucket"]
    placed = classes.select("label", "dims", F.posexplode("keys").alias("table", "bucket"))
    sizes = stored(placed.groupBy(*met).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets")
    spread = (
        classes.select("*", F.posexplode("keys").alias("table", "bucket"))
        .join(sizes, met)
        .withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
        .withColumn("block", F.pmod(F.xxhash64("rep", "vector"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")})
        .select(F.col("rep").alias("id"), "m", "vector", *CODE_COLUMNS, "block", "lo", "hi", *met)
    )
    found = stored(
        spread.groupBy(*met, "lo", "hi").applyInArrow(_compare(threshold), "id long, n long, root long"), "found"
    )
    counts = found.groupBy("id").agg(F.sum("n").alias("others")).withColumnRenamed("id", "rep")
    reached = components(found.select(F.col("id").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "rep")
    per_class = classes.join(counts, "rep", "left").join(reached, "rep", "left").select(
        *same, (F.coalesce("others", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component")
    )
    per_id = index.select("id", *same).join(stored(per_class, "class-links"), same).groupBy("id").agg(
        F.max("n_links").alias("n_links"), F.min("component").alias("component")
    )
    out = rows.select("id").join(per_id, "id", "left")
    component = F.coalesce("component", "id")
    return out.select(
        F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
    )
