"""BPE ids by dynamic programming over prefixes.

For every prefix of a piece exactly one token can be the last of its encoding.
A token t that ends a prefix is that last token if, and only if, it does not
merge across the cut with the last token of the prefix before t. So one pass
suffices: a suffix automaton over the vocabulary gives the tokens that end at
each byte, a pair test picks the one that is compatible, and the ids are read
off along the back-pointers.

The pair test needs no encoding. A token is built by one chain of merges; the
tokens along its edge at the cut each exist from their own merge to the next
one up the chain. Two tokens are incompatible if some pair of edge tokens has a
merge that comes while both exist (of equal merges the leftmost is first).

Pieces are those of the vocabulary's own byte-level pre-tokeniser. Words repeat,
so each distinct one is encoded once per worker (see ``tokens.Encoder``).
"""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlens.llm.common import give_back_memory, slices
from rosterlens.llm.tokens import SLICE, Encoder

STORE_PAIRS = 1_000_000      # pair tests a worker remembers; then it starts afresh
NEVER = 1 << 60


class SuffixAutomaton:
    """All substrings of some byte strings; every inserted string is the longest of its state."""

    def __init__(self, strings: dict[bytes, int]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.token = [-1], [0], [-1]
        for string, token in strings.items():
            last = 0
            for byte in string:
                last = self._extended(last, byte)
            self.token[last] = token
        # the nearest state up the links that is a token (0: none)
        self.up = [0] * len(self.link)
        for v in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            over = self.link[v]
            self.up[v] = over if self.token[over] >= 0 else self.up[over]

    def _state(self, next_: dict[int, int], length: int, link: int) -> int:
        self.next.append(next_)
        self.length.append(length)
        self.link.append(link)
        self.token.append(-1)
        return len(self.next) - 1

    def _split(self, p: int, byte: int, q: int) -> int:
        """A copy of state q that holds only its strings reached from p; links and edges moved to it."""
        copy = self._state(dict(self.next[q]), self.length[p] + 1, self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(byte) == q:
            self.next[p][byte] = copy
            p = self.link[p]
        return copy

    def _extended(self, last: int, byte: int) -> int:
        q = self.next[last].get(byte)
        if q is not None:                                  # the string so far is known
            return q if self.length[q] == self.length[last] + 1 else self._split(last, byte, q)
        made = self._state({}, self.length[last] + 1, 0)
        p = last
        while p >= 0 and byte not in self.next[p]:
            self.next[p][byte] = made
            p = self.link[p]
        if p >= 0:
            q = self.next[p][byte]
            self.link[made] = q if self.length[q] == self.length[p] + 1 else self._split(p, byte, q)
        return made

    def ends(self, raw: bytes) -> Iterator[list[tuple[int, int]]]:
        """For every prefix the (token, length) that end it, longest first."""
        next_, link, length, token, up = self.next, self.link, self.length, self.token, self.up
        state = matched = 0
        for byte in raw:
            to = next_[state].get(byte)
            while to is None and state:
                state = link[state]
                matched = length[state]
                to = next_[state].get(byte)
            if to is None:                                 # a byte outside the vocabulary
                state = matched = 0
                yield []
                continue
            state, matched = to, matched + 1
            v = state if token[state] >= 0 and length[state] <= matched else up[state]
            found = []
            while v:
                found.append((token[v], length[v]))
                v = up[v]
            yield found


class PrefixBpe:
    """Encoding of single pieces with a byte-level BPE vocabulary."""

    def __init__(self, vocabulary: dict[bytes, int], merges: list[tuple[bytes, bytes]]):
        self.merge: dict[tuple[int, int], int] = {}
        self.rank, self.parts = {i: -1 for i in vocabulary.values()}, {}
        for r, (a, b) in enumerate(merges):
            made = vocabulary[a + b]
            if made in self.parts:
                raise ValueError(f"two merges make the token {a + b!r}")
            self.parts[made] = vocabulary[a], vocabulary[b]
            self.rank[made] = r
            self.merge[vocabulary[a], vocabulary[b]] = r
        if any(self.rank[x] > self.rank[t] for t, pair in self.parts.items() for x in pair):
            raise ValueError("a merge comes before those of its parts")
        sound, whole = {}, set()
        for s, i in sorted(vocabulary.items(), key=lambda x: self.rank[x[1]]):      # parts come before what they make
            if len(s) == 1 or whole.issuperset(self.parts.get(i, ())) and self._whole(i):
                sound[s] = i
                whole.add(i)
        self.automaton = SuffixAutomaton(sound)
        self.known: dict[tuple[int, int], bool] = {}

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """(token, merge that ends it) along one edge, the whole token first; side 0 is the left edge."""
        out, ends = [(token, NEVER)], self.rank[token]
        while token in self.parts:
            token = self.parts[token][side]
            out.append((token, ends))
            ends = self.rank[token]
        return out

    def _crosses(self, one: int, two: int, but: tuple[int, int] | None = None) -> bool:
        merge = self.merge
        right = self._edge(one, 1)
        for y, y_ends in self._edge(two, 0):
            for x, x_ends in right:
                r = merge.get((x, y))
                if r is not None and r < x_ends and r <= y_ends and (x, y) != but:
                    return True
        return False

    def _whole(self, token: int) -> bool:
        """Whether the token's own string is encoded as the token (some vocabularies hold others)."""
        if token not in self.parts:
            return False
        pair = self.parts[token]
        # its halves must meet as they are: an earlier merge across the cut would break them
        return not self._crosses(*pair, but=pair)

    def compatible(self, one: int, two: int) -> bool:
        """Whether the encoding of both strings in a row is these two tokens."""
        pair = one, two
        out = self.known.get(pair)
        if out is None:
            if len(self.known) >= STORE_PAIRS:
                self.known.clear()
            out = self.known[pair] = not self._crosses(one, two)
        return out

    def encode(self, raw: bytes) -> list[int]:
        last = [-1] * (len(raw) + 1)           # the last token of each prefix
        size = [0] * (len(raw) + 1)
        compatible = self.compatible
        for i, found in enumerate(self.automaton.ends(raw), 1):
            for token, length in found:
                if length == i or compatible(last[i - length], token):
                    last[i], size[i] = token, length
                    break
            else:
                raise ValueError(f"the vocabulary cannot spell byte {raw[i - 1]}")
        out, i = [], len(raw)
        while i:
            out.append(last[i])
            i -= size[i]
        return out[::-1]


class PrefixEncoder(Encoder):
    """Ids of whole texts: the pre-tokeniser's pieces, each by :class:`PrefixBpe`."""

    def __init__(self, path: str):
        super().__init__(path)
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        if told["model"]["type"] != "BPE" or (told["pre_tokenizer"] or {}).get("type") != "ByteLevel" or told["normalizer"]:
            raise ValueError("not a byte-level BPE vocabulary")
        self.bytes_of = {c: b for b, c in self.letters.items()}
        spelled = lambda token: bytes(self.bytes_of[c] for c in token)
        special = {t["content"]: t["id"] for t in told["added_tokens"]}
        vocabulary = {spelled(t): i for t, i in told["model"]["vocab"].items() if t not in special}
        merges = [tuple(m if isinstance(m, list) else m.split(" ")) for m in told["model"]["merges"]]
        self.model = PrefixBpe(vocabulary, [(spelled(a), spelled(b)) for a, b in merges])
        self.strings = {i: s for s, i in vocabulary.items()} | {i: s.encode() for s, i in special.items()}
        self.special = special
        self.special_pattern = re.compile("|".join(re.escape(s) for s in sorted(special, key=len, reverse=True))) if special else None
        sizes = np.zeros(max(self.strings) + 1, np.int64)
        for i, s in self.strings.items():
            sizes[i] = len(s)
        self.sizes, self.starts = sizes, np.cumsum(sizes) - sizes
        self.bytes = np.frombuffer(b"".join(self.strings.get(i, b"") for i in range(len(sizes))), np.uint8)

    def _new(self, raw: bytes) -> list[int]:
        if raw.isalpha() or (raw[:1] == b" " and raw[1:].isalpha()):        # ASCII letters: one piece
            return self.model.encode(raw)
        pieces = self.library.pre_tokenizer.pre_tokenize_str(raw.decode())
        return [i for piece, _ in pieces for i in self.model.encode(bytes(self.bytes_of[c] for c in piece))]

    def _each(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[list[int]]:
        whole = data.tobytes()
        return (self._new(whole[a:b]) for a, b in zip(start.tolist(), end.tolist(), strict=True))

    def _library_ids(self, texts: list[str]) -> list[list[int]]:
        """Ids of the texts without the store (two strings met under one key)."""
        return [self._new(t.encode()) if t else [] for t in texts]

    def of(self, text: str) -> np.ndarray:
        """Ids of one text; strings of special tokens in it become those tokens, as in the library."""
        out, at = [], 0
        for m in self.special_pattern.finditer(text) if self.special_pattern else ():
            out += [self.encode(pa.array([text[at : m.start()]], pa.string()))[0], np.array([self.special[m[0]]], self.dtype)]
            at = m.end()
        return np.concatenate([*out, self.encode(pa.array([text[at:]], pa.string()))[0]])

    def read(self, ids: np.ndarray) -> bytes:
        """The bytes that ids stand for."""
        ids = ids.astype(np.int64)
        size = self.sizes[ids]
        before = np.cumsum(size) - size
        return self.bytes[np.repeat(self.starts[ids] - before, size) + np.arange(int(size.sum()))].tobytes()


def prefix_encoder(path: str) -> PrefixEncoder:
    """One encoder per worker process and vocabulary."""
    kept = sys.__dict__.setdefault("_corpus_prefix_encoders", {})
    if path not in kept:
        kept[path] = PrefixEncoder(path)
    return kept[path]


def _encoded(path: str, decoded: bool, special: bool):
    names = ["doc_id", "ids", "decoded"][: 2 + decoded]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = prefix_encoder(path)
        for batch in batches:
            for lo, hi in slices(batch["text"], SLICE):
                rows = batch.slice(lo, hi - lo)
                ids, places = encoder.encode(rows["text"])
                if special and encoder.special_pattern:
                    texts = rows["text"].to_pylist()
                    odd = {i: encoder.of(t) for i, t in enumerate(texts) if t and encoder.special_pattern.search(t)}
                    if odd:
                        each = [odd.get(i, ids[a:b]) for i, (a, b) in enumerate(zip(places[:-1], places[1:], strict=True))]
                        ids, places = np.concatenate(each), np.cumsum([0, *map(len, each)])
                ends = pa.array(places.astype(np.int32))
                out = [rows["doc_id"], pa.ListArray.from_arrays(ends, pa.array(ids.astype(np.int32)))]
                if decoded:
                    said = [encoder.read(ids[a:b]).decode(errors="replace") for a, b in zip(places[:-1], places[1:], strict=True)]
                    out.append(pa.array(said, pa.string()))
                yield pa.RecordBatch.from_arrays(out, names)
            give_back_memory(encoders=True)

    return run


def encode_documents(
    docs: DataFrame, path: str, decoded: bool = False, special: bool = True, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per document: ``doc_id`` and ``ids`` (array), with ``decoded`` also the text read back from the ids.

    Ids are those of the whole text. With ``special`` the strings of special
    tokens become those tokens, as in the library by default; else they are ordinary text.
    A null text is empty and has no ids. Repeated rows and null ids pass
    like any other; no shuffle. Other columns are ignored.
    """
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(_encoded(path, decoded, special), "doc_id long, ids array<int>" + ", decoded string" * decoded)


def _decoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = prefix_encoder(path)
        for batch in batches:
            for i in range(len(batch)):
                ids = np.array(batch["ids"][i].as_py() or [], np.int64)
                text = encoder.read(ids).decode(errors="replace")
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(i, 1), pa.array([text], pa.string())], ["doc_id", "text"])

    return run


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids); broken characters become U+FFFD, a null list is empty."""
    return encoded.select("doc_id", F.col("ids").cast("array<int>").alias("ids")).mapInArrow(_decoded(path), "doc_id long, text string")
