"""Substring dedup by recompression: equal word passages get equal interior symbols.

Each round renames a text's symbols: first every run of one symbol, then
every pair (left symbol, right symbol), where a bit of the symbol's name and
the round puts each symbol on one side. A name is a 64-bit function of what it
stands for, so a run or pair has the same name in every text, task and
retry, and a round needs no dictionary to be joined.

Two occurrences of one passage can differ only at the rims. In a passage that
holds no long run itself (three words or more of one word, or two or more equal
symbols of a later round that follow from the passage) a rim loses, per round,
at most one run and one symbol that pairs outwards: 2 + 2 words, then 4 + 4; how
far that run goes on outside the passage does not matter. So the symbols inside
50 words less ``RIM`` = 12 on both sides follow from the passage alone. The high-level symbols that Spark compares stand
for ``JOINED`` neighbours; of every ``CHOICES`` of them in a row the one with the
smallest scrambled name is an anchor. A window is a candidate if every row
inside its rims shows an anchor that another text has too, or if it touches a
run whose symbol has a long run in another text. A window that is certain to
hold a long run wherever it occurs needs the latter and is not judged by its
rows; one that a run merely reaches into is. A window without a whole row is a
candidate if another text has such a window (``BARE``). Spark counts
the anchors of all texts and so reveals the candidates; only these are hashed (two
independent 64-bit hashes), and the smallest document of every window
decides. Copies of a whole text are one class with one representative before
any of this.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlens.llm.common import Scratch, Words, mix, slices, stored

ROUNDS = 2
RIM = 12
JOINED, CHOICES = 4, 6
BARE = np.uint64(0x5AD0_BA4E)
LAST_ID = 2**63 - 1
NEVER = 1 << 40


def symbols(words: Words, rounds: int = ROUNDS) -> tuple[tuple, tuple]:
    """Long runs and rows of some texts, each as (text, name, first word, words).

    Runs have one more number: a window holds a long run for certain if it has
    so many words of this one, counted from either end of the run. A row is CHOICES high-level symbols one after the other, under the name of
    the one chosen among them.
    """
    sym = mix(words.hashes, 101)
    text = np.repeat(np.arange(len(words.counts)), words.counts)
    at, size = np.arange(len(sym)), np.ones(len(sym), np.int64)
    runs = []
    for r in range(rounds):
        same = (sym[1:] == sym[:-1]) & (text[1:] == text[:-1])
        if same.any():
            head = np.flatnonzero(np.r_[True, ~same])
            times = np.diff(np.r_[head, len(sym)])
            sym, text, at, size = sym[head], text[head], at[head], size[head] * times
            run = times > 1
            long = run & ((times > 2) | (r > 0))
            # two symbols (words: three) beyond what a rim has lost before; a symbol over 2^(r+1) words holds a run of words itself
            unit = size // times
            sure = np.where(unit <= 2 << r, 4 * ((1 << r) - 1) + (2 * unit if r else 3), NEVER)
            runs.append((text[long], mix(sym[long], 7), at[long], size[long], sure[long]))
            sym = np.where(run, mix(sym + times.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F), 9), sym)
        right = (mix(sym, 1000 + r) & np.uint64(1)).astype(bool)
        left = np.flatnonzero(~right[:-1] & right[1:] & (text[1:] == text[:-1]))
        sym, size = sym.copy(), size.copy()
        sym[left] = mix(mix(sym[left], 11 + r) + sym[left + 1], 31 + r)
        size[left] += size[left + 1]
        keep = np.ones(len(sym), bool)
        keep[left + 1] = False
        sym, text, at, size = sym[keep], text[keep], at[keep], size[keep]
    none = np.zeros(0, np.int64)
    runs = tuple(np.concatenate(x) for x in zip(*runs, strict=True)) if runs else (none, none.astype(np.uint64), none, none, none)
    span = JOINED + CHOICES - 1
    if len(sym) < span:
        return runs, (none, none.astype(np.uint64), none, none)
    name = np.zeros(len(sym) - JOINED + 1, np.uint64)
    for k in range(JOINED):
        name = mix(name + sym[k : len(name) + k], 50 + k)
    row = np.flatnonzero(text[: len(sym) - span + 1] == text[span - 1 :])
    order = np.lib.stride_tricks.sliding_window_view(mix(name, 5), CHOICES)[row]
    chosen = row + np.argmin(order, axis=1)
    last = row + span - 1
    return runs, (text[row], name[chosen], at[row], at[last] + size[last] - at[row])


class Anchors:
    """Anchors of some texts and what they say about each window (known by its first word)."""

    def __init__(self, words: Words, window: int):
        self.words, self.window = words, window
        self.runs, self.rows = symbols(words)
        text, name, at, size, sure = self.runs
        self.holds_run = self.starts(*self.range_of(text, at + sure - window, at + size - sure))
        text, name, at, size = self.rows
        inside = self.starts(*self.range_of(text, at + size + RIM - window, at - RIM))
        owner = np.repeat(np.arange(len(words.counts)), words.counts)
        last = words.first[1:][owner] - window
        bare = (np.arange(len(owner)) <= last) & ~inside & ~self.holds_run
        self.bare = bare
        some = np.unique(owner[bare])
        self.text = np.r_[self.runs[0], text, some]
        self.name = np.r_[self.runs[1], name, np.full(len(some), BARE, np.uint64)]

    def range_of(self, text, lowest, highest):
        first = self.words.first
        return np.maximum(first[text], lowest), np.minimum(first[text + 1] - self.window, highest)

    def starts(self, lowest, highest) -> np.ndarray:
        """Which words lie in any of the ranges."""
        n, good = len(self.words.hashes), lowest <= highest
        marks = np.bincount(lowest[good], minlength=n + 1) - np.bincount(highest[good] + 1, minlength=n + 1)
        return np.cumsum(marks)[:n] > 0

    def candidates(self, shared: np.ndarray) -> np.ndarray:
        """Windows that may start elsewhere, given which of the anchors another text has."""
        (rt, _, ra, rs, _), (t, _, a, size) = self.runs, self.rows
        of_run, of_row, of_bare = np.split(shared, [len(rt), len(rt) + len(t)])
        by_run = self.starts(*(x[of_run] for x in self.range_of(rt, ra - self.window + 1, ra + rs - 1)))
        inner = self.range_of(t, a + size + RIM - self.window, a - RIM)
        by_row = self.starts(*(x[of_row] for x in inner)) & ~self.starts(*(x[~of_row] for x in inner))
        bare = self.bare & np.isin(np.repeat(np.arange(len(self.words.counts)), self.words.counts), self.text[len(rt) + len(t) :][of_bare])
        return by_run | (by_row & ~self.holds_run) | bare


def _anchors_of(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(batch["text"]):
                rows = batch.slice(lo, hi - lo)
                words = Words(rows["text"], lower=False)
                found = Anchors(words, window)
                long_enough = words.counts[found.text] >= window       # shorter texts have no window
                pairs = np.unique(np.stack([found.text[long_enough].astype(np.uint64), found.name[long_enough]]), axis=1)
                ends = np.searchsorted(pairs[0], np.arange(len(rows) + 1, dtype=np.uint64)).astype(np.int32)
                names = pa.ListArray.from_arrays(pa.array(ends), pa.array(pairs[1].view(np.int64)))
                yield pa.RecordBatch.from_arrays([rows["o"], rows["h"], rows["k"], names], ["o", "h", "k", "anchors"])

    return run


def _candidate_windows(window: int):
    """Hashes of the candidate windows of texts that have shared anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(batch["text"]):
                rows = batch.slice(lo, hi - lo)
                words = Words(rows["text"], lower=False)
                lists = rows["anchors"]
                owner = np.repeat(np.arange(len(rows)), lists.value_lengths().to_numpy(zero_copy_only=False))
                wanted = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                told = lambda t, n: mix(n ^ mix(t.astype(np.uint64), 3), 4)
                found = Anchors(words, window)
                wanted_start = found.candidates(np.isin(told(found.text, found.name), told(owner, wanted)))
                one, start = words.sequences(window, 1)
                two, _ = words.sequences(window, 2)
                pick = wanted_start[start]
                one, two, start = one[pick], two[pick], start[pick]
                owner = np.searchsorted(words.first, start, "right") - 1
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(one.view(np.int64)),
                        pa.array(two.view(np.int64)),
                        rows["o"].take(pa.array(owner)),
                        rows["h"].take(pa.array(owner)),
                        pa.array((start - words.first[owner]).astype(np.int32)),
                    ],
                    ["w1", "w2", "o", "h", "pos"],
                )

    return run


def _cut(window: int, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, copy, starts in zip(batch["text"], batch["__copy"], batch["__starts"], strict=True):
                words = (text.as_py() or "").encode().split()
                gone = np.zeros(len(words) + 1, np.int64)
                if copy.as_py() and len(words) >= window:
                    gone[0] = 1
                elif starts.is_valid:
                    at = starts.values.to_numpy(zero_copy_only=False)
                    np.add.at(gone, at, 1)
                    np.add.at(gone, at + window, -1)
                gone = np.cumsum(gone)[:-1] > 0
                n = int(gone.sum())
                kept = words if not n else [w for w, g in zip(words, gone, strict=True) if not g]
                out.append((len(words), n, b" ".join(kept).decode()))
            new = [pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch[c] for c in columns] + new, [*columns, "n_words", "n_removed", "kept"])

    return run


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = 50) -> DataFrame:
    """``docs`` plus ``n_words``, ``n_removed`` and ``kept`` (the kept words, joined by a space).

    A word goes if a window of ``window`` words over it also starts in a
    document with a smaller ``key``; windows are those of the input. Words are
    ``[^\\x20\\x09-\\x0D]+``. A null or empty text has no words; a null key
    counts as larger than all others; rows that repeat a key do not count
    as smaller than each other. Needs ``window`` >= 50 (the bound above).
    Other columns pass through; columns named like the new ones are replaced.
    """
    if window < 50:
        raise ValueError("the anchors are only certain for windows of 50 words or more")
    passed = [c for c in docs.columns if c not in ("n_words", "n_removed", "kept")]
    columns = ["text" if c == text else f"in_{i}" for i, c in enumerate(passed)]
    docs = docs.select(
        *[F.col(f"`{c}`").alias(n) for c, n in zip(passed, columns, strict=True)],
        F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(LAST_ID)).alias("o"), F.xxhash64(F.col(f"`{text}`")).alias("h"),
    )
    hashed = docs.select("o", "h", F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("k"), "text")
    with Scratch() as scratch:
        parsed = stored(hashed.mapInArrow(_anchors_of(window), "o long, h long, k binary, anchors array<long>"), "parsed")
        classes = stored(parsed.groupBy("k").agg(F.min("o").alias("rep")), "classes")
        classed = parsed.join(classes, "k")
        copies = classed.groupBy("o", "h").agg(F.max(F.col("o") > F.col("rep")).alias("__copy"))
        copies = scratch.keep(stored(copies, "copies"))
        firsts = stored(classed.where("o = rep").select("o", "h", F.explode("anchors").alias("anchor")), "anchors")
        shared = firsts.groupBy("anchor").agg(F.min("o").alias("lo"), F.max("o").alias("hi")).where("lo < hi").select("anchor")
        todo = firsts.join(stored(shared, "shared"), "anchor").groupBy("o", "h").agg(F.collect_set("anchor").alias("anchors"))
        todo = scratch.keep(stored(todo, "todo"))
    # the two joins below shuffle the texts the same way, so Spark moves them once and reuses the exchange
    windows = docs.join(todo, ["o", "h"]).mapInArrow(
        _candidate_windows(window), "w1 long, w2 long, o long, h long, pos int"
    )
    least = windows.groupBy("w1", "w2").agg(F.min("o").alias("lo"), F.max("o").alias("hi")).where("lo < hi").select("w1", "w2", "lo")
    # dealt anew, so that both sides of the join are plain shuffles and adaptive execution can split a window that many texts share
    gone = windows.join(least.repartition("lo"), ["w1", "w2"]).where("o > lo").groupBy("o", "h").agg(F.collect_set("pos").alias("__starts"))
    told = docs.join(copies.join(gone, ["o", "h"], "left"), ["o", "h"])
    schema = ", ".join(f"{c} {told.schema[c].dataType.simpleString()}" for c in columns)
    out = told.mapInArrow(_cut(window, columns), f"{schema}, n_words long, n_removed long, kept string")
    return out.select(*[F.col(n).alias(c) for c, n in zip(passed, columns, strict=True)], "n_words", "n_removed", "kept")
