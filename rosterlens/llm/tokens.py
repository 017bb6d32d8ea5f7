"""Token ids of whole texts with the tokenizers library, each distinct word encoded once per worker.

The byte-level pattern never matches across a single space, or a single line
end, between two non-spaces, so a text may be cut there and its ids are those
of the pieces in order. Texts repeat their words: pieces are found by two
64-bit hashes in a bounded store, and a new piece is encoded by the library (a
plain word by its model alone, which is what the pre-tokenizer would hand it).
Tests compare the ids with the library's for whole texts.
"""

from __future__ import annotations

import math
import os
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from rosterlens.llm.common import mix, powers

STORE_PIECES = 1_000_000     # once a worker knows more, it starts anew
FULL = 0.75                  # share of the store's rows that may be taken
SIZE_BITS = 28               # of a piece's number of ids; the rest is its place
SLICE = 1 << 20              # bytes of text to encode at a time,
HASH_BYTES = 1 << 16         # and to hash at a time
_PUNCTUATION = frozenset("!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")     # a token of its own after letters
_ROOTS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_INVERSES = tuple(pow(r, -1, 1 << 64) for r in _ROOTS)


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Path of a public vocabulary file (the same on every machine that has the package)."""
    import public_tokenizers

    return public_tokenizers.path(name)


def cut_places(data: np.ndarray) -> np.ndarray:
    """Places in UTF-8 ``data`` before which a text may be cut.

    Before a lone space or line end, and after a lone line end. Bytes that could
    belong to other white space count as white space, so a cut is never wrong.
    """
    n = len(data)
    blank = np.ones(n + 6, bool)
    blank[3:-3] = data <= 32
    lead = np.zeros(n + 6, np.uint8)
    lead[3:-3] = data
    wide = (lead >= 0xE1) & (lead <= 0xE3)
    # could the character that ends / begins here be a space of two or three bytes
    ends = blank[2:-4] | (lead[1:-5] == 0xC2) | wide[:-6]
    begins = blank[4:-2] | (lead[4:-2] == 0xC2) | wide[4:-2]
    alone = ~ends & ~begins
    cut = np.zeros(n + 1, bool)
    line = (data == 10) & alone
    cut[:-1] = line | ((data == 32) & alone)
    cut[1:] |= line
    return cut


class _Store:
    """Known pieces in an open hash table of keys; by its rows also 32 bits of a second hash, place and size.

    At most ``FULL`` of the rows are taken. The key 0 marks a free row.
    """

    def __init__(self, rows: int = 1 << 16):
        self.n, self.keys, self.checks, self.places = 0, np.zeros(rows, np.uint64), np.zeros(rows, np.uint32), np.zeros(rows, np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key; a free row where the key is not known."""
        rows = len(self.keys)
        at = (keys % np.uint64(rows)).astype(np.int64)
        there = self.keys[at]
        todo = np.flatnonzero((there != keys) & (there != 0))
        while len(todo):
            next_ = (at[todo] + 1) % rows
            at[todo] = next_
            there = self.keys[next_]
            todo = todo[(there != keys[todo]) & (there != 0)]
        return at

    def add(self, keys: np.ndarray, checks: np.ndarray, places: np.ndarray) -> None:
        """Distinct keys that are not there yet."""
        if self.n + len(keys) > FULL * len(self.keys):
            old, taken = (self.keys, self.checks, self.places), np.flatnonzero(self.keys)
            self.__init__(math.ceil(1.25 * (self.n + len(keys)) / FULL))
            self.add(*[x[taken] for x in old])
            del old, taken
        self.n += len(keys)
        todo = np.arange(len(keys))
        while len(todo):
            at = self.find(keys[todo])
            self.keys[at], self.checks[at], self.places[at] = keys[todo], checks[todo], places[todo]
            todo = todo[self.keys[at] != keys[todo]]             # of two keys for one free row the later stays


class Encoder:
    """Ids of texts (16-bit, or 32-bit for larger vocabularies)."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True       # their strings in a text are ordinary text
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        # the byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on
        shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
        hidden = iter(range(256, 512))
        self.letters = {b: chr(b) if b in shown else chr(next(hidden)) for b in range(256)}
        self.space = self.letters[32]
        self.spelled: list[bytes] | None = None
        self.tails = {c: [t.id for t in self.library.model.tokenize(c)] for c in _PUNCTUATION}
        self.powers = [(powers(r, 2 * HASH_BYTES), powers(v, 2 * HASH_BYTES)) for r, v in zip(_ROOTS, _INVERSES, strict=True)]
        self._forget()

    def _forget(self) -> None:
        self.known = self.flat = None
        self.known = _Store(math.ceil(1.05 * STORE_PIECES / FULL))      # whole at once: a larger copy would stand beside it
        self.flat, self.used = np.zeros(1 << 16, self.dtype), 0

    def _new(self, raw: bytes) -> list[int]:
        piece = raw.decode()
        word = piece[1:] if piece[0] == " " else piece
        tail = word[-1:] if word[-1:] in _PUNCTUATION else ""
        if (word[:-1] if tail else word).isalpha():
            if raw.isascii():                                  # letters stand for themselves, a space has its own sign
                spelled = piece if word is piece else self.space + word
            else:
                spelled = raw.decode("latin-1").translate(self.letters)
            tokenize = self.library.model.tokenize
            if tail:
                return [t.id for t in tokenize(spelled[:-1])] + self.tails[tail]
            return [t.id for t in tokenize(spelled)]
        return self.library.encode(piece, add_special_tokens=False).ids

    def _each(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[list[int]]:
        """Ids of pieces in the order of ``data``; words of ASCII letters alone go to the model as they are."""
        whole, tokenize, new, space, tails = data.tobytes(), self.library.model.tokenize, self._new, self.space, self.tails
        text = whole.decode("latin-1")                         # a character a byte
        wide = np.maximum.reduceat(np.append(data, np.uint8(0)), np.stack([start, end], axis=1).ravel())[::2] > 127
        for a, b, led, other in zip(start.tolist(), end.tolist(), (data[start] == 32).tolist(), wide.tolist(), strict=True):
            if not other:
                word = text[a + led : b]
                if word.isalpha():
                    yield [t.id for t in tokenize(space + word if led else word)]
                    continue
                if word[:-1].isalpha() and word[-1] in tails:
                    yield [t.id for t in tokenize(space + word[:-1] if led else word[:-1])] + tails[word[-1]]
                    continue
            yield new(whole[a:b])

    def _many(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[list[int], np.ndarray]:
        """(ids of all pieces in a row, number of ids of each)."""
        ids, ends = [], []
        for piece in self._each(data, start, end):
            ids += piece
            ends.append(len(ids))
        return ids, np.diff(np.array(ends, np.int64), prepend=0)

    def _learn(self, keys: np.ndarray, checks: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        ids, size = self._many(data, start, end)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(ids)] = ids
        place = self.used + np.cumsum(size) - size
        self.known.add(keys, checks, place << SIZE_BITS | size)
        self.used += len(ids)

    def _hashes(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of every piece, made in steps whose arrays fit a core's cache."""
        out = np.zeros((2, len(start)), np.uint64)
        steps = np.unique(np.r_[np.searchsorted(start, np.arange(0, len(data), HASH_BYTES)), len(start)])
        for i, j in zip(steps[:-1], steps[1:], strict=True):
            lo, hi = start[i], end[j - 1]
            n = int(hi - lo)
            if n > len(self.powers[0][0]):                      # one long piece
                self.powers = [(powers(r, n), powers(v, n)) for r, v in zip(_ROOTS, _INVERSES, strict=True)]
            a, b = start[i:j] - lo, end[i:j] - lo
            bytes_ = data[lo:hi].astype(np.uint64) + np.uint64(1)
            sums = np.zeros(n + 1, np.uint64)
            for row, (up, down) in zip(out, self.powers, strict=True):
                np.cumsum(bytes_ * up[:n], out=sums[1:])
                row[i:j] = mix((sums[b] - sums[a]) * down[a])
        return out[0], out[1]

    def _library_ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, places where each text begins and the last ends); null is empty."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        n = len(texts)
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        if not len(data):
            return np.zeros(0, self.dtype), np.zeros(n + 1, np.int64)
        cut = cut_places(data)
        cut[offsets] = True
        start = np.flatnonzero(cut)
        start, end = start[:-1], start[1:]
        keys, checks = self._hashes(data, start, end)
        keys, checks = np.maximum(keys, np.uint64(1)), checks.astype(np.uint32)
        if self.known.n > STORE_PIECES:
            self._forget()
        row = self.known.find(keys)
        new = np.flatnonzero(self.known.keys[row] == 0)
        if len(new):
            _, first = np.unique(keys[new], return_index=True)
            first = np.sort(new[first])
            self._learn(keys[first], checks[first], data, start[first], end[first])
            row = self.known.find(keys)
        if not np.array_equal(self.known.checks[row], checks):           # two pieces under one key: ask the library
            ids = self._library_ids(texts.to_pylist())
            return np.array([i for x in ids for i in x], self.dtype), np.cumsum([0, *map(len, ids)])
        at = self.known.places[row]
        at, size = at >> SIZE_BITS, at & ((1 << SIZE_BITS) - 1)
        before = np.cumsum(size) - size
        ids = self.flat[np.repeat(at - before, size) + np.arange(int(size.sum()))]
        places = np.r_[before, size.sum()][np.searchsorted(start, offsets)]
        return ids, places

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids of this vocabulary that hold whole characters."""
        if self.spelled is None:
            back = {name: b for b, name in self.letters.items()}
            by_id = {i: bytes(back.get(c, 0) for c in t) for t, i in self.library.get_vocab(with_added_tokens=False).items()}
            self.spelled = [by_id.get(i, b"") for i in range(max(by_id) + 1)]
        return b"".join([self.spelled[i] for i in ids.tolist()]).decode()


def encoder(path: str) -> Encoder:
    """One encoder per worker process and vocabulary (kept for the worker's next tasks)."""
    kept = sys.__dict__.setdefault("_corpus_encoders", {})
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]
