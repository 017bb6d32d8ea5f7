"""Target-distribution importance resampling over hashed word n-grams.

An untrained Regex ``Split`` of the tokenizers library cuts the ASCII-lowered
text into words with offsets. Windows over those offset pairs are the features:
runs of 1 to ``most`` words joined by one space. A feature's bucket is the crc32
of its UTF-8 bytes modulo ``buckets``; a run's crc32 follows from those of its
words (crc32 is linear, so a shorter run is shifted by the next word's length
and the word's own crc32 is added), so no joined string is made.

1. Every text becomes its buckets, written once to the shared folder.
2. Two histograms of all features, of the documents and of the target texts,
   give each bucket a gain, the scaled log ratio of its smoothed shares.
3. A document's weight is the floored mean of its gains; a Gumbel value from a
   hash of seed and id is added, so the highest scores are a draw without
   replacement in proportion to the weights' exponentials.
4. Ranks come from a range-partitioned sort with one offset per partition.

Texts are split in chunks that end at a separator, so memory stays bounded
however long a text is. Histograms are counted in each task before they are
shuffled; only one number per bucket reaches the driver.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlens.llm.common import Scratch, give_back_memory, numbered, slices, stored

# --- fixed values ---------------------------------------------------------------
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SCALE = 1000                 # gains and Gumbel values are in thousandths
# --------------------------------------------------------------------------------
CHUNK = 1 << 14              # characters split at a time
STORE_WORDS = 500_000        # known words of a worker; then it starts afresh
TABLED = 64                  # words of more bytes get their runs' crc32 one by one
_SEPARATOR = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]")
_ONES = np.uint32(0xFFFFFFFF)


def lowered(text: str) -> str:
    """``text`` with A-Z (and nothing else) in lower case."""
    return text.encode().lower().decode()


def splitter():
    from tokenizers import Regex, pre_tokenizers

    return pre_tokenizers.Split(Regex(WORD), "removed", invert=True)


def chunks(text: str) -> Iterator[tuple[int, str]]:
    """(place, part) of the text in parts of about ``CHUNK`` characters that end before a separator."""
    lo = 0
    while len(text) - lo > CHUNK:
        cut = _SEPARATOR.search(text, lo + CHUNK)
        if cut is None:
            break
        yield lo, text[lo : cut.start()]
        lo = cut.start()
    if lo < len(text):
        yield lo, text[lo:]


def words_with_offsets(text: str | None, split=None) -> list[tuple[str, tuple[int, int]]]:
    """The words of the ASCII-lowered text and their (start, end) in code points."""
    split = split or splitter()
    return [
        (word, (lo + a, lo + b)) for lo, part in chunks(lowered(text or "")) for word, (a, b) in split.pre_tokenize_str(part)
    ]


def _crc_step(crc: np.ndarray, byte: int) -> np.ndarray:
    """crc32 register after one more byte (without the final complement)."""
    return (crc >> np.uint32(8)) ^ _CRC_BYTES[(crc ^ np.uint32(byte)) & np.uint32(255)]


_CRC_BYTES = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC_BYTES = np.where(_CRC_BYTES & 1, (_CRC_BYTES >> 1) ^ np.uint32(0xEDB88320), _CRC_BYTES >> 1).astype(np.uint32)


def _shift_tables(most: int) -> np.ndarray:
    """tables[n, k, b]: byte k of a crc32 with value b, shifted by n zero bytes."""
    now = np.arange(256, dtype=np.uint32) << (np.arange(4, dtype=np.uint32) * 8)[:, None]
    out = [now]
    for _ in range(most):
        now = _crc_step(now, 0)
        out.append(now)
    return np.stack(out).astype(np.uint32)


class _Known(dict):
    """word -> its number; new words get their crc32 and length noted."""

    def __init__(self):
        super().__init__()
        self.crc, self.size, self.raw = array("I"), array("q"), []

    def __missing__(self, word: str) -> int:
        raw = word.encode()
        self[word] = n = len(self.raw)
        self.crc.append(zlib.crc32(raw))
        self.size.append(len(raw))
        self.raw.append(raw)
        return n


class Buckets:
    """The feature buckets of texts."""

    def __init__(self, most: int, buckets: int):
        self.most, self.buckets = most, buckets
        self.dtype = np.dtype("<u2" if buckets <= 1 << 16 else "<u4")
        self.split, self.known, self.tables = splitter(), _Known(), _shift_tables(TABLED)

    def _joined(self, crc: np.ndarray, word: np.ndarray, crcs: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """crc32 of runs followed by one space and a word, from the runs' crc32."""
        spaced = _crc_step(crc ^ _ONES, 32) ^ _ONES
        size = sizes[word]
        at = np.minimum(size, TABLED)
        out = crcs[word].copy()
        for k in range(4):
            out ^= self.tables[at, k, (spaced >> np.uint32(8 * k)) & np.uint32(255)]
        for i in np.flatnonzero(size > TABLED).tolist():
            out[i] = zlib.crc32(self.known.raw[word[i]], int(spaced[i]))
        return out

    def of(self, texts: list[str | None]) -> list[tuple[int, np.ndarray]]:
        """(words, buckets of all features) of each text; null and empty have none."""
        if len(self.known) > STORE_WORDS:
            self.known = _Known()
        numbers, first = [], [0]
        for text in texts:
            for _, part in chunks(lowered(text)) if text else ():
                numbers += [self.known[word] for word, _ in self.split.pre_tokenize_str(part)]
            first.append(len(numbers))
        word = np.array(numbers, np.int64)
        crcs, sizes = np.array(self.known.crc, np.uint32), np.array(self.known.size, np.int64)
        crc = crcs[word] if len(word) else np.zeros(0, np.uint32)
        runs = [(crc % np.uint32(self.buckets)).astype(self.dtype)]
        # end of the text that each word is in: a window may not reach beyond it
        end = np.repeat(first[1:], np.diff(first))
        at = np.arange(len(word))
        inside = [np.ones(len(word), bool)]
        for k in range(1, self.most):
            keep = at + k < end[at]                 # the windows one word shorter that have a next word
            at = at[keep]
            crc = self._joined(crc[keep], word[at + k], crcs, sizes)
            runs.append(np.zeros(len(word), self.dtype))
            runs[k][at] = crc % np.uint32(self.buckets)
            inside.append(np.zeros(len(word), bool))
            inside[k][at] = True
        every, held = np.stack(runs, axis=1), np.stack(inside, axis=1)
        return [(b - a, every[a:b][held[a:b]]) for a, b in zip(first[:-1], first[1:], strict=True)]


def _bucketed(most: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Buckets(most, buckets)
        for batch in batches:
            for lo, hi in slices(batch["text"]):
                rows = batch.slice(lo, hi - lo)
                found = made.of(rows["text"].to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [
                        rows["doc_id"], pa.array([n for n, _ in found], pa.int64()), pa.array([len(f) for _, f in found], pa.int64()),
                        pa.array([f.tobytes() for _, f in found], pa.binary()),
                    ],
                    ["doc_id", "n_words", "n_features", "buckets"],
                )
            give_back_memory()

    return run


def _flat(column: pa.Array, dtype: np.dtype) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype)


def _counted(buckets: int):
    dtype = np.dtype("<u2" if buckets <= 1 << 16 else "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(_flat(batch["buckets"], dtype), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    return run


def feature_table(docs: DataFrame, most: int, buckets: int, key: str, text: str, tag: str) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_features`` and packed ``buckets`` of every text, written."""
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return stored(rows.mapInArrow(_bucketed(most, buckets), "doc_id long, n_words long, n_features long, buckets binary"), tag)


def histogram(features: DataFrame, buckets: int, name: str) -> DataFrame:
    """(bucket, ``name``): all features counted, in each task first."""
    each = features.select("buckets").mapInArrow(_counted(buckets), "bucket long, n long")
    return each.groupBy("bucket").agg(F.sum("n").alias(name))


def bucket_gains(documents: DataFrame, target: DataFrame, buckets: int) -> list[int]:
    """The gain of every bucket: one number each, so its size is that of the parameter."""
    counts = documents.join(target, "bucket", "full").na.fill(0).select("bucket", "s", "t")
    counts = documents.sparkSession.range(buckets).withColumnRenamed("id", "bucket").join(counts, "bucket", "left").na.fill(0)
    rows = counts.collect()
    all_s, all_t = sum(r.s for r in rows), sum(r.t for r in rows)
    gains = np.zeros(buckets, np.int64)
    for r in rows:
        share = ((r.t + 1.0) * (all_s + float(buckets))) / ((r.s + 1.0) * (all_t + float(buckets)))
        gains[r.bucket] = np.floor(SCALE * np.log(share))
    return gains


def _weighted(gains: np.ndarray, buckets: int):
    dtype = np.dtype("<u2" if buckets <= 1 << 16 else "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch["n_features"].to_numpy()
            sums = np.concatenate([[0], np.cumsum(gains[_flat(batch["buckets"], dtype)])])
            ends = np.cumsum(n)
            weight = np.where(n > 0, (sums[ends] - sums[ends - n]) // np.maximum(n, 1), 0)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["n_words"], batch["n_features"], pa.array(weight.astype(np.int64))],
                ["doc_id", "n_words", "n_features", "weight"],
            )

    return run


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, most: int = 2, buckets: int = 10_000,
    seed: int = 7, key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """One row per document: ``doc_id``, ``n_words``, ``n_features``, ``weight``, ``score`` and ``rank``.

    Of the documents with at least ``least_words`` words, floor(``percent`` % of
    them) with the highest scores are drawn, ties to the smaller id; ``rank`` is
    1, 2, 3 ... in that order and null for all others. Null and empty texts
    have no features and weight 0. Rows that repeat an id are documents of
    their own with one Gumbel value; among equal scores and ids the row with fewer
    features is first. A null id has a null score, is not counted and never
    drawn. Without features in either table all gains are 0 (or follow from
    the smoothing). Other columns are ignored.
    """
    with Scratch() as scratch:
        features = feature_table(docs, most, buckets, key, text, "features")
        wanted = feature_table(target.select(F.lit(0).alias("doc_id"), F.col(f"`{text}`").alias("text")), most, buckets, "doc_id", "text", "target")
        gains = bucket_gains(histogram(features, buckets, "s"), histogram(wanted, buckets, "t"), buckets)
        weighed = features.mapInArrow(_weighted(gains, buckets), "doc_id long, n_words long, n_features long, weight long")
        h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("long")
        gumbel = F.floor(-SCALE * F.log(-F.log((h + 0.5) / 4294967296.0)))
        scored = stored(
            weighed.withColumns({"score": F.col("weight") + gumbel, "salt": F.monotonically_increasing_id()}), "scored"
        )
        enters = (F.col("n_words") >= least_words) & F.col("doc_id").isNotNull()
        drawn = scored.where(enters).count() * percent // 100
        order = [F.col("score").desc(), "doc_id", "n_features", "weight", "salt"]     # the salt only tells equal rows apart
        ranked = numbered(scored.where(enters), order, "rank")
        scratch.keep(scored)
        scratch.keep(ranked)
    columns = ["doc_id", "n_words", "n_features", "weight", "score"]
    first = ranked.select(*columns, F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank"))
    return first.unionAll(scored.where(~enters).select(*columns, F.lit(None).cast("long").alias("rank")))
