"""Helpers shared by the corpus operators: tables, shared-folder storage, word hashing.

Word hashing works on the raw UTF-8 bytes of many texts at once. Texts are
cut into slices of at most ``SLICE_BYTES`` bytes (one longer text makes its
own slice), so the numpy temporaries of a task stay bounded however large an
Arrow batch is.
"""

from __future__ import annotations

import atexit
import ctypes
import gc
import math
import sys
import threading
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlens.session import checkpoint_root

SLICE_BYTES = 1 << 20
BATCH_ROWS = 2_000             # rows of an Arrow batch
_STORED: list[tuple[SparkSession, str]] = []
_TABLES: dict[str, str] = {}     # name of the bucketed table in a folder
_OPEN = threading.local()       # blocks of this thread: operators may run side by side


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of texts or vectors. Batches to Python workers are kept small: a row may be a long text or a large set."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def work_folder(spark: SparkSession, tag: str) -> str:
    """A new folder name under the session's shared checkpoint folder."""
    if not _STORED:
        atexit.register(clear_stored)
    path = f"{checkpoint_root(spark)}/llm-{tag}-{uuid.uuid4().hex[:12]}"
    _STORED.append((spark, path))
    for block in getattr(_OPEN, "blocks", [])[-1:]:
        block.paths.append((spark, path))
    return path


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage: an executor lost later costs a re-read, not a recompute.
    """
    path = work_folder(df.sparkSession, tag)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def stored_by(df: DataFrame, column: str, tag: str) -> DataFrame:
    """Like :func:`stored`, as a table bucketed by ``column``: joins and counts on it move none of its rows.

    ``df`` should come out of ``repartition(shuffle_partitions(spark), column)``, so each task writes one file.
    """
    spark, path = df.sparkSession, work_folder(df.sparkSession, tag)
    name = path.rsplit("/", 1)[1].replace("-", "_")
    df.write.format("parquet").bucketBy(shuffle_partitions(spark), column).option("path", path).saveAsTable(name)
    _TABLES[path] = name
    out = spark.table(name)
    out.stored_at = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    if path in _TABLES:
        spark.sql(f"DROP TABLE IF EXISTS {_TABLES.pop(path)}")
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """The tables that :func:`stored` writes in a ``with`` block are deleted at its end, but those kept."""

    def __enter__(self) -> Scratch:
        self.paths, self.kept = [], set()
        _OPEN.blocks = [*getattr(_OPEN, "blocks", []), self]
        return self

    def keep(self, df: DataFrame) -> DataFrame:
        self.kept.add(df.stored_at)
        return df

    def __exit__(self, kind, *_) -> None:
        _OPEN.blocks.remove(self)
        for spark, path in self.paths:
            if path not in self.kept and (spark, path) in _STORED:
                _delete(spark, path)
                _STORED.remove((spark, path))


def discard(df: DataFrame) -> None:
    """Delete a table that :func:`stored` wrote, before its block ends."""
    entry = df.sparkSession, df.stored_at
    if entry in _STORED:
        _STORED.remove(entry)
        _delete(*entry)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of DataFrames that nothing refers to any more.

    Spark does so when the driver's objects are collected, which on a large
    heap may be long after the files have filled the disks. The scheduler holds
    on to its last job, so a job without a shuffle comes first.
    """
    gc.collect()
    spark.range(1, numPartitions=1).collect()
    spark.sparkContext._jvm.System.gc()
    give_back_driver_memory(spark)


def give_back_driver_memory(spark: SparkSession) -> None:
    """Return what the driver's JVM has freed outside its heap to the system, by the JVM's own command for it.

    Some hundred plans leave over 200 MB in the C library's arenas, which it keeps.
    """
    jvm, new_array = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
    try:
        invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        told = new_array(jvm.java.lang.Object, 4)
        told[0] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        told[1] = "systemTrimNativeHeap"
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), told)
    except Py4JError:                        # an older JVM, or one with another C library, has no such command
        pass


def clear_stored() -> None:
    """Delete the intermediate tables that are left (also runs at exit)."""
    while _STORED:
        try:
            _delete(*_STORED.pop())
        except Exception:  # the session has ended; nothing left to ask
            return


def give_back_memory(encoders: bool = False) -> None:
    """Return what a Python worker has freed to the system: workers live on, and stages add up otherwise.

    A task that encodes no tokens (``encoders``) also lets go of the encoders that earlier stages left.
    """
    if not encoders:
        for kept in ("_corpus_encoders", "_corpus_prefix_encoders"):
            sys.__dict__.pop(kept, None)
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):        # another C library keeps its own counsel
        pass


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def numbered(df: DataFrame, order: list, name: str) -> DataFrame:
    """``df`` plus ``name``: 1, 2, 3 ... in the given order, written.

    Rows are range-partitioned and sorted; the sizes of the partitions (one
    number each) give every partition its offset. No task sees more than a range.
    """
    spark = df.sparkSession
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    placed = stored(placed, "numbered")
    part = F.shiftright("__at", 33)
    sizes = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect()
    before, offsets = 0, []
    for r in sizes:
        offsets.append((r.part, before))
        before += r.n
    starts = spark.createDataFrame(offsets, "__part long, __before long")
    inside = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    out = placed.join(F.broadcast(starts), part == F.col("__part")).withColumn(name, F.col("__before") + inside + 1)
    out = out.drop("__at", "__part", "__before")
    out.stored_at = placed.stored_at
    return out


# --- hashing of words -----------------------------------------------------------
_MASK = (1 << 64) - 1
_ROOT = 0x9E3779B97F4A7C15          # odd, so it has an inverse modulo 2^64
_ROOT_INVERSE = pow(_ROOT, -1, 1 << 64)
_STEP = 0xD6E8FEB86659FD93          # odd multiplier of word sequences
_STEP_INVERSE = pow(_STEP, -1, 1 << 64)
KEPT_POWERS = 1 << 18
_POWERS: dict[int, np.ndarray] = {}


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective scrambling of 64-bit values (two multiply-xorshift rounds)."""
    x = x + np.uint64((salt * 2 + 1) * 0xA0761D6478BD642F & _MASK)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xE9846AF9B1A615D5)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x9FB21C651E98DF25)
    x ^= x >> np.uint64(32)
    return x


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
        np.multiply.accumulate(out, out=out)
    return out


def kept_powers(base: int, n: int) -> np.ndarray:
    """:func:`powers`, not to be changed; short ones are made once per worker."""
    if n > KEPT_POWERS:
        return powers(base, n)
    if base not in _POWERS:
        _POWERS[base] = powers(base, KEPT_POWERS)
    return _POWERS[base][:n]


def slices(batch_texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes of text each."""
    if len(batch_texts) == 0:
        return
    ends = np.cumsum(text_bytes(batch_texts))
    lo = 0
    while lo < len(ends):
        base = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield lo, hi
        lo = hi


def text_bytes(texts: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of some texts, as hashes in one flat array.

    ``hashes[first[i]:first[i + 1]]`` are the 64-bit word hashes of text i;
    ``start``/``end`` are byte places in ``data``. A null text has no words.
    """

    def __init__(self, texts: pa.Array, lower: bool):
        import pyarrow.compute as pc

        texts = pc.fill_null(texts, "").cast(pa.large_string())
        n = len(texts)
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        self.original = data
        if lower:
            fold = np.arange(256, dtype=np.uint8)
            fold[65:91] += 32
            data = fold[data]
        self.data = data
        inside = np.zeros(len(data) + 1, bool)
        blank = np.zeros(256, bool)
        blank[[32, 9, 10, 11, 12, 13]] = True
        inside[:-1] = ~blank[data]
        before = np.zeros(len(data) + 1, bool)
        before[1:] = inside[:-1]
        cut = np.zeros(len(data) + 1, bool)
        cut[offsets] = True
        # a text's end also ends its last word
        self.start = np.flatnonzero(inside & (~before | cut))
        self.end = np.flatnonzero(before & (~inside | cut))
        self.first = np.searchsorted(self.start, offsets)
        up, down = kept_powers(_ROOT, len(data) + 1), kept_powers(_ROOT_INVERSE, len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
        self.hashes = mix((sums[self.end] - sums[self.start]) * down[self.start])

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def sequences(self, length: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of every run of ``length`` words that stays inside one text, and its first word's index."""
        n = len(self.hashes)
        if n < length:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        up, down = kept_powers(_STEP, n), kept_powers(_STEP_INVERSE, n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(mix(self.hashes, salt) * up, out=sums[1:])
        at = np.arange(n - length + 1)
        last = np.repeat(self.first[1:], self.counts)[: len(at)]   # end of the text each word is in
        at = at[at + length <= last]
        return mix((sums[at + length] - sums[at]) * down[at], salt + length), at


# --- connected components ---------------------------------------------------------
def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable over the undirected ``links``.

    Alternating star contraction: every round hangs each node's larger
    neighbours, then its smaller ones, below its smallest neighbour, and writes
    the edges to the shared folder, until a round changes nothing. Only counts and one checksum reach the
    driver. Nodes without links are not listed.
    """
    both = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    edges, seen = stored(both, "edges"), None
    while True:
        # a node's larger neighbours hang below its smallest one
        near = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        hung = near.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # then its smaller ones, and the node itself
        least = hung.groupBy("u").agg(F.min("v").alias("m"))
        again = hung.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        edges, old = stored(again.unionAll(least.select("u", F.col("m").alias("v"))).distinct(), "edges"), edges
        discard(old)
        now = edges.agg(F.count("u"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(
                edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        seen = now


def ceil_log2(x: float) -> int:
    return max(0, math.ceil(math.log2(x))) if x > 1 else 0
