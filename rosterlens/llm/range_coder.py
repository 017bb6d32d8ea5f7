"""Token-id files: an adaptive context-mixing range coder over independent blocks.

An id is coded as one of three events: it is what the order-2 context predicts,
it is what the order-1 context predicts, or neither, in which case it is coded by
its order-0 frequency (a table per page, sent once). Every context predicts the
id that followed it last, with a confidence; the order-2 contexts that end in one
id lie beside its order-1 context. Three models state the chances of
the events, from the order-2 evidence (its confidence, and whether both
orders agree), the order-1 evidence and order 0 alone; a Bayesian mixture
weighs them by how well each has predicted so far. The mixed chances drive a
range coder with 48-bit state and carry propagation.

A block holds ``BLOCK_IDS`` ids. All its adaptive state starts afresh, so any block
of a page decodes alone, and a checksum covers its ids. numpy works on all blocks of
a page in step, one id of each at a time. Chances are made by element-wise IEEE
arithmetic only, so both sides compute the same numbers.

Page layout (little-endian): magic, version, blocks, length of the packed
order-0 table; the table; per block ids, 16-bit words and crc32; all words.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rosterlens.llm.common import work_folder

MAGIC, VERSION = b"CMRC", 2
BLOCK_IDS = 1024
GROUPS, SLOTS = 256, 4        # hashed order-1 contexts of a block; its prediction and those of the order-2 contexts that end in it
PAGE_IDS = 8 << 20           # a page is cut at so many ids once half as many follow, so a task holds 3/2 of it at a time
_HEAD = "<4sHIIQ"
_TOTAL, _EVENTS = 20, 15     # bits of the order-0 and of the event frequencies
_PLACE = 21                  # bits of an order-0 frequency beside what lies below it
_LEARN = 0.06


class ChecksumError(ValueError):
    """A block's ids do not match its checksum, or the page is not one of these."""


def order0(counts: np.ndarray) -> np.ndarray:
    """Frequencies (sum 2^20, at least 1 for an id that occurs) from counts."""
    total = 1 << _TOTAL
    seen = counts > 0
    room = total - int(seen.sum())
    if room < 0:
        raise ValueError("more distinct ids than frequencies")
    freq = np.where(seen, 1 + (counts * room) // max(1, int(counts.sum())), 0)
    if seen.any():
        freq[np.argmax(counts)] += total - int(freq.sum())
    return freq


class _Mixer:
    """The adaptive state of all blocks (lanes) of a page.

    Work on all lanes is arithmetic on whole arrays, stacked by order or by model: choices by mask are several
    times as slow. Both predictions of a context lie side by side, so one fetch from memory brings both.
    """

    def __init__(self, lanes: int):
        n = self.lanes = lanes
        self.table = np.zeros(n * GROUPS * SLOTS, np.int32)      # id << 2 | confidence; of each group the order-1 slot first
        lane = np.arange(n)
        self.base, self.by8, self.by4 = lane * (GROUPS * SLOTS), lane * 8, lane * 4
        # chances of an order-2 and of an order-1 hit, by order-2 evidence, by order-1 evidence, by order 0
        pair = np.array([0.15, 0.1], np.float32).view(np.int64)[0]       # side by side, moved as one
        self.by2, self.by1, self.by0 = np.full(n * 8, pair), np.full(n * 4, pair), np.full(n, pair)
        self.weight = np.full((3, n), 1 / 3, np.float32)
        # 16 bits hold an id, and all that is used of its hash
        self.last = np.zeros(n, np.uint16)
        self.slot = np.ones(n, np.int64)                         # of the id before, in the group

    def predict(self, n: int):
        """Ids that are expected (by order 2, by order 1) and event frequencies of the first n lanes; keeps what update() needs."""
        group = self.last[:n] * np.uint16(40503) >> np.uint16(8)
        i1 = self.base[:n] + (group << np.uint16(2))
        i2 = i1 + self.slot[:n]
        e = np.empty((2, n), np.int32)
        self.table.take(i1, out=e[1], mode="clip")
        self.table.take(i2, out=e[0], mode="clip")
        ids, sure = e >> 2, e & 3
        j8 = self.by8[:n] + sure[0]
        j8 += (ids[0] == ids[1]).view(np.int8).astype(np.int64) << 2
        j4 = self.by4[:n] + sure[1]
        pairs = np.empty((3, n), np.int64)
        self.by2.take(j8, out=pairs[0], mode="clip")
        self.by1.take(j4, out=pairs[1], mode="clip")
        pairs[2] = self.by0[:n]
        both = pairs.view(np.float32).reshape(3, n, 2)
        two, one = np.ascontiguousarray(both[:, :, 0]), np.ascontiguousarray(both[:, :, 1])
        w = self.weight[:, :n]
        scale = np.float32((1 << _EVENTS) - 3)
        m2, m1 = w * two, w * one
        f2 = ((m2[0] + m2[1] + m2[2]) * scale).astype(np.int32) + 1
        f1 = ((m1[0] + m1[1] + m1[2]) * scale).astype(np.int32) + 1
        self.kept = (n, i1, i2, e, ids, sure, j8, j4, pairs, two, one)
        return ids[0], ids[1], f2, f1

    def update(self, x: np.ndarray, hit2: np.ndarray, hit1: np.ndarray) -> None:
        """Learn the ids (int32) and events (1 or 0, int32) of the lanes that predict() was asked for."""
        n, i1, i2, e, ids, sure, j8, j4, pairs, two, one = self.kept
        w = self.weight[:, :n]
        is2, is1 = hit2.astype(np.float32), hit1.astype(np.float32)
        likely = 1 - two
        likely -= one
        likely *= 1 - is2 - is1
        likely += two * is2
        likely += one * is1
        likely *= w
        likely *= np.float32(0.96) / (likely[0] + likely[1] + likely[2])
        np.add(likely, np.float32(0.04 / 3), out=w)
        both = pairs.view(np.float32).reshape(3, n, 2)
        for k, (chances, hit) in enumerate(((two, is2), (one, is1))):
            chances *= np.float32(1 - _LEARN)
            np.add(chances, hit * np.float32(0.9 * _LEARN) + np.float32(0.002 * _LEARN), out=both[:, :, k])
        self.by2[j8], self.by1[j4], self.by0[:n] = pairs
        # right: more sure, up to 3; wrong: less sure, or the new id
        right = -(ids == x).view(np.int8).astype(np.int32)
        some = -sure >> 31
        fresh = x << 2
        wrong = ((e - 1) ^ fresh) & some
        wrong ^= fresh
        new = np.minimum(e + 1, e | 3)
        new ^= wrong
        new &= right
        new ^= wrong
        self.table[i1] = new[1]
        self.table[i2] = new[0]
        self.slot[:n] = np.maximum(self.last[:n] * np.uint16(60493) >> np.uint16(14), np.uint16(1))
        self.last[:n] = x


def _turned(rows: np.ndarray) -> np.ndarray:
    """The transpose, made of strips that fit a core's cache."""
    out = np.empty(rows.shape[::-1], rows.dtype)
    for i in range(0, max(rows.shape), 32):
        if len(rows) < len(out):
            out[i : i + 32] = rows[:, i : i + 32].T
        else:
            out[:, i : i + 32] = rows[i : i + 32].T
    return out


def _blocks(n: int) -> np.ndarray:
    sizes = np.full(-(-n // BLOCK_IDS), BLOCK_IDS, np.int64)
    if n % BLOCK_IDS:
        sizes[-1] = n % BLOCK_IDS
    return sizes


class _Writer:
    """Range coder of all lanes. A carry waits in ``low``, above its 48 bits, until the lane's next word goes out."""

    def __init__(self, lanes: int):
        self.lanes, self.low, self.range = lanes, np.zeros(lanes, np.uint64), np.full(lanes, (1 << 48) - 1, np.uint64)
        # lanes side by side: they are about as far, so their next words lie close together
        self.out, self.at = np.zeros((2 * BLOCK_IDS + 8) * lanes, np.uint16), np.arange(lanes)

    def _word(self, rows: np.ndarray, low: np.ndarray) -> None:
        """The top word of each row's ``low`` goes out."""
        top = low >> np.uint64(32)
        at = self.at[rows]
        over = np.flatnonzero(top > np.uint64(0xFFFF))
        if len(over):
            back = at[over] - self.lanes
            while len(back):                                   # carry into the words already out
                self.out[back] += np.uint16(1)
                back = back[self.out[back] == 0] - self.lanes
        self.out[at] = top.astype(np.uint16)
        self.at[rows] = at + self.lanes

    def put(self, lane: np.ndarray | slice, below: np.ndarray, freq: np.ndarray, bits: int) -> None:
        r = self.range[lane] >> np.uint64(bits)
        low = self.low[lane] + r * below.astype(np.uint64)
        r *= freq.astype(np.uint64)
        small = np.flatnonzero(r < np.uint64(1 << 32))
        while len(small):
            left = low[small]
            self._word(small if isinstance(lane, slice) else lane[small], left)
            low[small] = (left & np.uint64((1 << 32) - 1)) << np.uint64(16)
            wide = r[small] << np.uint64(16)
            r[small] = wide
            small = small[wide < np.uint64(1 << 32)]
        self.low[lane], self.range[lane] = low, r

    def close(self) -> tuple[np.ndarray, np.ndarray]:
        """(words of all lanes, lane by lane; how many of each)."""
        every = np.arange(self.lanes)
        for _ in range(3):
            self._word(every, self.low)
            self.low = (self.low & np.uint64((1 << 32) - 1)) << np.uint64(16)
        counts = self.at // max(1, self.lanes)
        most = int(counts.max(initial=0))
        out = _turned(self.out[: most * self.lanes].reshape(most, self.lanes))
        return out[np.arange(most) < counts[:, None]], counts


class _Reader:
    def __init__(self, words: np.ndarray, starts: np.ndarray):
        self.words, self.at = np.r_[words, np.zeros(8, np.uint16)], starts + 3
        w = [self.words[starts + i].astype(np.uint64) for i in range(3)]
        self.code = (w[0] << np.uint64(32)) | (w[1] << np.uint64(16)) | w[2]
        self.range = np.full(len(starts), (1 << 48) - 1, np.uint64)

    def event(self, n: int, f2: np.ndarray, f1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(order-2 hit, order-1 hit) of the first n lanes, 1 or 0."""
        r, code = self.range[:n] >> np.uint64(_EVENTS), self.code[:n]
        to2, to1 = r * f2.astype(np.uint64), r * f1.astype(np.uint64)
        to1 += to2
        not2, missed = (code >= to2).view(np.uint8).astype(np.uint64), (code >= to1).view(np.uint8).astype(np.uint64)
        begin = not2 * to2 + missed * (to1 - to2)
        end = to2 + not2 * (to1 - to2) + missed * ((r << np.uint64(_EVENTS)) - to1)
        self._shift(slice(0, n), code - begin, end - begin)
        return (1 - not2.astype(np.int32)), (not2 - missed).astype(np.int32)

    def symbols(self, lane: np.ndarray, symbol: np.ndarray, places: np.ndarray) -> np.ndarray:
        """The ids of the lanes (numbers) by order 0."""
        r, code = self.range[lane] >> np.uint64(_TOTAL), self.code[lane]
        ids = symbol.take((code // r).astype(np.int64), mode="clip")
        place = places[ids]
        code -= r * (place >> _PLACE).astype(np.uint64)
        r *= (place & ((1 << _PLACE) - 1)).astype(np.uint64)
        self._shift(lane, code, r)
        return ids

    def _shift(self, lane: np.ndarray | slice, code: np.ndarray, r: np.ndarray) -> None:
        small = np.flatnonzero(r < np.uint64(1 << 32))
        while len(small):
            rows = small if isinstance(lane, slice) else lane[small]
            at = self.at[rows]
            code[small] = (code[small] << np.uint64(16)) | self.words.take(at, mode="clip")
            self.at[rows] = at + 1
            wide = r[small] << np.uint64(16)
            r[small] = wide
            small = small[wide < np.uint64(1 << 32)]
        self.code[lane], self.range[lane] = code, r


def encode_page(ids: np.ndarray) -> bytes:
    """One page from any number of ids below 2^16."""
    ids = np.asarray(ids)
    sizes = _blocks(len(ids))
    counts = np.zeros(1 << 16, np.int64)
    for i in range(0, len(ids), 1 << 18):
        counts += np.bincount(ids[i : i + (1 << 18)], minlength=1 << 16)
    freq = order0(counts)
    table = zlib.compress(freq.astype("<u4").tobytes(), 1)
    places = (np.cumsum(freq) - freq) << _PLACE | freq
    lanes = len(sizes)
    steps = np.zeros((lanes, BLOCK_IDS), np.uint16)
    steps.reshape(-1)[: len(ids)] = ids
    steps = _turned(steps)
    mixer, writer = _Mixer(lanes), _Writer(lanes)
    for t in range(int(sizes.max(initial=0))):
        n = lanes if t < sizes[-1] else lanes - 1
        x = steps[t, :n].astype(np.int32)
        p2, p1, f2, f1 = mixer.predict(n)
        hit2 = (x == p2).view(np.int8).astype(np.int32)
        hit1 = (x == p1).view(np.int8) * (1 - hit2)
        miss = 1 - hit2 - hit1
        writer.put(
            slice(0, n), (f2 + f1 * miss) * (1 - hit2), f2 * hit2 + f1 * hit1 + ((1 << _EVENTS) - f2 - f1) * miss, _EVENTS
        )
        missed = np.flatnonzero(miss)
        place = places[x[missed]]
        writer.put(missed, place >> _PLACE, place & ((1 << _PLACE) - 1), _TOTAL)
        mixer.update(x, hit2, hit1)
    del mixer, steps
    raw, cuts = ids.astype("<u4"), np.r_[0, np.cumsum(sizes)]
    info = np.zeros((lanes, 3), "<u4")
    words, info[:, 1] = writer.close()
    info[:, 0] = sizes
    info[:, 2] = [zlib.crc32(raw[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return struct.pack(_HEAD, MAGIC, VERSION, lanes, len(table), len(ids)) + table + info.tobytes() + words.astype("<u2").tobytes()


def decode_page(page: bytes, blocks: slice | None = None) -> np.ndarray:
    """The ids of a page, or of some of its blocks; every block's checksum is verified."""
    if len(page) < struct.calcsize(_HEAD) or page[:4] != MAGIC:
        raise ChecksumError("not a page of ids")
    _, version, lanes, packed, _ = struct.unpack_from(_HEAD, page)
    if version != VERSION:
        raise ChecksumError(f"page version {version}")
    at = struct.calcsize(_HEAD)
    try:
        freq = np.frombuffer(zlib.decompress(page[at : at + packed]), "<u4").astype(np.int64)
    except zlib.error as e:
        raise ChecksumError(str(e)) from e
    at += packed
    info = np.frombuffer(page, "<u4", lanes * 3, at).reshape(lanes, 3).astype(np.int64)
    words = np.frombuffer(page, "<u2", offset=at + lanes * 12)
    starts = np.cumsum(info[:, 1]) - info[:, 1]
    if blocks is not None:
        info, starts = info[blocks], starts[blocks]
    sizes, lanes = info[:, 0], len(info)
    if not lanes:
        return np.zeros(0, np.uint32)
    places = (np.cumsum(freq) - freq) << _PLACE | freq
    symbol = np.repeat(np.arange(len(freq)).astype(np.uint16), freq)
    mixer, reader = _Mixer(lanes), _Reader(words, starts)
    out = np.zeros((BLOCK_IDS, lanes), np.uint16)
    for t in range(int(sizes.max())):
        n = lanes if t < sizes[-1] else lanes - 1
        p2, p1, f2, f1 = mixer.predict(n)
        hit2, hit1 = reader.event(n, f2, f1)
        x = p2 * hit2 + p1 * (1 - hit2)
        missed = np.flatnonzero(hit2 + hit1 == 0)
        x[missed] = reader.symbols(missed, symbol, places)
        mixer.update(x, hit2, hit1)
        out[t, :n] = x
    del mixer
    cuts = np.r_[0, np.cumsum(sizes)]
    ids = _turned(out).reshape(-1)[: cuts[-1]].astype("<u4")      # all blocks but the last are full
    for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        if zlib.crc32(ids[a:b]) != info[i, 2]:
            raise ChecksumError(f"block {i} is damaged")
    return ids


# --- files -----------------------------------------------------------------------------
_PAGE = pa.schema(
    [("part", pa.int32()), ("page", pa.int32()), ("n_ids", pa.int64()), ("docs", pa.list_(pa.int64())),
     ("sizes", pa.list_(pa.int64())), ("payload", pa.binary())]
)


def _pages(path: str, end_id: int):
    """Sorted texts of one partition -> its pages.

    The coder works on a page's blocks side by side, so a page of few blocks costs
    as much time as one of many: a short rest goes into the page before it, and only
    a partition that is small itself makes a page under half of ``PAGE_IDS``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from rosterlens.llm.common import slices
        from rosterlens.llm.tokens import SLICE, encoder

        encode, part, page = encoder(path), TaskContext.get().partitionId(), 0
        docs, sizes, held = [], [], []
        cut, docs_cut, total, after = 0, 0, 0, 0       # slices and documents of the page that is full, ids in all and behind it

        def closed(slices_in, docs_in):
            ids = np.concatenate(held[:slices_in])
            row = {
                "part": part, "page": page, "n_ids": len(ids), "docs": docs[:docs_in], "sizes": sizes[:docs_in],
                "payload": encode_page(ids),
            }
            return pa.RecordBatch.from_pylist([row], _PAGE)

        for batch in batches:
            for lo, hi in slices(batch["text"], SLICE):
                rows = batch.slice(lo, hi - lo)
                ids, places = encode.encode(rows["text"])
                docs += rows["doc_id"].to_pylist()
                sizes += (np.diff(places) + 1).tolist()
                held.append(np.insert(ids, places[1:], end_id))
                total += len(held[-1])
                if cut:
                    after += len(held[-1])
                elif total >= PAGE_IDS:
                    cut, docs_cut = len(held), len(docs)
                if 2 * after >= PAGE_IDS:
                    yield closed(cut, docs_cut)
                    page, docs, sizes, held = page + 1, docs[docs_cut:], sizes[docs_cut:], held[cut:]
                    total, after = after, 0
                    cut, docs_cut = (len(held), len(docs)) if total >= PAGE_IDS else (0, 0)
        if docs:
            yield closed(len(held), len(docs))

    return run


def write_ids(
    docs: DataFrame, vocabulary_path: str, folder: str, end_id: int = 2, key: str = "doc_id", text: str = "text",
    partitions: int | None = None,
) -> str:
    """Write the ids of every whole text, each followed by ``end_id``, in ascending ``key`` order.

    The texts are range-partitioned and sorted by key (a null key first; rows with
    one key by text), so file order is key order and no task holds more than its
    range. Each row of the Parquet files is one page (see above) with its documents'
    ids and sizes. A null text is empty. Returns ``folder``.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(partitions, "doc_id").sortWithinPartitions("doc_id", "text")
    schema = "part int, page int, n_ids long, docs array<long>, sizes array<long>, payload binary"
    rows.mapInArrow(_pages(vocabulary_path, end_id), schema).write.parquet(folder)
    return folder


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, page, docs, sizes, payload in zip(
            *(batch[c] for c in ("part", "page", "docs", "sizes", "payload")), strict=True
        ):
            ids = decode_page(payload.as_py())
            n = sizes.values.to_numpy(zero_copy_only=False)
            ends = np.cumsum(n)
            raw = memoryview(ids.tobytes())
            crc = [zlib.crc32(raw[4 * (b - k) : 4 * b]) for b, k in zip(ends.tolist(), n.tolist(), strict=True)]
            k = len(n)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([part.as_py()] * k, pa.int32()), pa.array([page.as_py()] * k, pa.int32()), docs.values,
                    pa.array(ends - n), pa.array(n), pa.array(crc, pa.int64()),
                ],
                ["part", "page", "doc_id", "place", "n_tokens", "ids_crc32"],
            )


def read_documents(spark, folder: str) -> DataFrame:
    """One row per document of the files: doc_id, start (ids of all documents before), n_tokens, ids_crc32.

    Decodes every page; a damaged block raises. The offsets come from the pages'
    sizes: a prefix sum inside each file, and one over the files.
    """
    pages = spark.read.parquet(folder)
    sizes = pages.select("part", "page", "n_ids")
    inside = Window.partitionBy("part").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))          # one row per file
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("of_files"))
    offsets = sizes.select("part", "page", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("of_pages")).join(parts, "part")
    found = pages.mapInArrow(_documents, "part int, page int, doc_id long, place long, n_tokens long, ids_crc32 long")
    return found.join(offsets, ["part", "page"]).select(
        "doc_id", (F.col("of_files") + F.col("of_pages") + F.col("place")).alias("start"), "n_tokens", "ids_crc32"
    )


def id_files(docs: DataFrame, vocabulary_path: str, end_id: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the files into a new shared folder and read them back."""
    folder = write_ids(docs, vocabulary_path, work_folder(docs.sparkSession, "ids"), end_id, key, text)
    return read_documents(docs.sparkSession, folder)
