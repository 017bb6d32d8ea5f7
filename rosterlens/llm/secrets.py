"""Secret scan: fixed patterns, plus sliding-window entropy over candidate strings.

Candidates are the maximal runs of token characters of ``MIN_CANDIDATE``
bytes or more. A window of ``window`` characters slides over a candidate; its
Shannon entropy is kept up to date from the character counts (one leaves, one
enters), so a step costs the same whatever the window. The threshold is per
character class: hexadecimal strings can reach 4 bits, mixed ones 6. Spans of
hot windows are merged; an allow-list suppresses harmless candidates (UUIDs,
words, paths, numbers) and the windows that overlap a placeholder or sequence.
What a pattern has found is cut out of a span, and the rest of it stays.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlens.llm.common import give_back_memory, slices

# --- fixed values: the base patterns, on bytes with A-Z lowered where letters match in either case ---
ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([a-z0-9+/_.=-]+)")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
ASSIGN_VALUE, ACCESS_LENGTH, HEX_LENGTH = 8, 16, 32
KINDS = ("assign", "access", "hex", "entropy")
# ------------------------------------------------------------------------------------------------------
MIN_CANDIDATE = 20
#: class -> (its characters, window, bits): the first class that holds all of a candidate's characters
CLASSES = {
    "hex": (re.compile(rb"[0-9a-fA-F]+"), 20, 3.0),
    "mixed": (re.compile(rb"[A-Za-z0-9+/_=-]+"), 20, 3.7),
}
#: harmless candidates. Every byte has one way to match, so a match takes one pass. A run of letters
#: over LONGEST_WORD is no word: it is judged by its entropy like any other string
LONGEST_WORD = 30
ALLOWED = (
    re.compile(rb"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"),                              # UUID
    re.compile(rb"[A-Z]?[a-z]{1,%d}(?:[_/=+-][A-Z]?[a-z]{0,%d})*" % (LONGEST_WORD, LONGEST_WORD)),                   # words, snake or path
    re.compile(rb"[A-Z]{1,%d}(?:[_/=+-][A-Z]{0,%d})*" % (LONGEST_WORD, LONGEST_WORD)),                               # capitals
    re.compile(rb"[0-9]+(?:[_/=+-][0-9]*)*"),                                                                        # numbers, dates
)
#: no secret holds one of these; what stands beside it is judged without it
PLACEHOLDERS = re.compile(rb"(?i)example|placeholder|changeme|your[_-]?(key|token|secret)|x{6,}|0123456789|abcdefgh")
_N_LOG_N = [0.0] + [n * log2(n) for n in range(1, 4097)]


def hot_windows(candidate: bytes, window: int, bits: float) -> list[tuple[int, int]]:
    """Merged spans of the windows whose entropy is at least ``bits``."""
    window = min(window, len(candidate))
    count = [0] * 256
    total = 0.0           # sum of n * log2(n) over the characters of the window
    out: list[tuple[int, int]] = []
    limit = (log2(window) - bits) * window + 1e-9
    for i, c in enumerate(candidate):
        n = count[c]
        total += _N_LOG_N[n + 1] - _N_LOG_N[n]
        count[c] = n + 1
        if i >= window:
            c = candidate[i - window]
            n = count[c]
            total += _N_LOG_N[n - 1] - _N_LOG_N[n]
            count[c] = n - 1
        if i >= window - 1 and total <= limit:
            lo = i - window + 1
            if out and lo <= out[-1][1]:
                out[-1] = (out[-1][0], i + 1)
            else:
                out.append((lo, i + 1))
    return out


def outside(lo: int, hi: int, taken: list[tuple[int, int]], least: int) -> list[tuple[int, int]]:
    """The parts of lo to hi, of ``least`` bytes or more, that no span in ``taken`` overlaps."""
    out, at = [], lo
    for s, e in [*sorted(x for x in taken if x[0] < hi and lo < x[1]), (hi, hi)]:
        if s - at >= least:
            out.append((at, s))
        at = max(at, e)
    return out


def entropy_spans(candidate: bytes, classes=None, allowed=ALLOWED) -> list[tuple[int, int]]:
    if any(a.fullmatch(candidate) for a in allowed):
        return []
    for characters, window, bits in (classes or CLASSES).values():
        if characters.fullmatch(candidate):
            fillers = [m.span() for m in PLACEHOLDERS.finditer(candidate)]
            parts = outside(0, len(candidate), fillers, min(window, len(candidate)))
            return [(p + lo, p + hi) for p, q in parts for lo, hi in hot_windows(candidate[p:q], window, bits)]
    return []


def _table(characters: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[np.frombuffer(characters, np.uint8)] = True
    return out


_DIGITS = b"0123456789"
_LETTERS = b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _runs(data: np.ndarray, member: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """(text, start, end) of the maximal runs of member bytes inside one text, of ``least`` bytes or more."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = member[data]
    edge = np.diff(inside)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    # a run over a text's end is cut there
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    cuts = np.unique(cuts[(inside[cuts] == 1) & (inside[cuts + 1] == 1)])
    start, end = np.sort(np.r_[start, cuts]), np.sort(np.r_[end, cuts])
    long = end - start >= least
    start, end = start[long], end[long]
    return np.searchsorted(offsets, start, "right") - 1, start, end


def scan_text(raw: bytes, hexes=(), candidates=()) -> list[tuple[str, int, int]]:
    """Sorted spans (kind, start, end) in bytes; ``hexes`` and ``candidates`` are runs in ``raw``."""
    low = raw.lower()                                  # bytes: A-Z only
    spans = [("assign", *m.span()) for m in ASSIGN.finditer(low) if m.end(2) - m.start(2) >= ASSIGN_VALUE]
    if b"AKIA" in raw:
        spans += [("access", *m.span()) for m in ACCESS.finditer(raw) if m.end() - m.start() >= ACCESS_LENGTH]
    spans += [("hex", a, b) for a, b in hexes]
    base = [x[1:] for x in spans]
    for a, b in candidates:
        for lo, hi in entropy_spans(raw[a:b]):
            for s, e in outside(a + lo, a + hi, base, MIN_CANDIDATE):     # what a pattern has found is not told twice
                part = raw[s:e].strip(b"_/=+-")
                if (s, e) == (a + lo, a + hi) or not any(x.fullmatch(part) for x in ALLOWED):
                    spans.append(("entropy", s, e))
    return sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def _scan(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[pa.RecordBatch]:
    hex_bytes = _table(_DIGITS + b"abcdef")
    token_bytes = _table(_DIGITS + _LETTERS + b"+/_=-")
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    for batch in batches:
        for lo, hi in slices(batch["text"]):
            rows = batch.slice(lo, hi - lo)
            texts = [t.encode() if t else b"" for t in rows["text"].to_pylist()]
            offsets = np.cumsum([0, *map(len, texts)])
            data = np.frombuffer(b"".join(texts), np.uint8)
            found: dict[int, list] = {}
            for kind, member, least in (("hex", hex_bytes, HEX_LENGTH), ("any", token_bytes, MIN_CANDIDATE)):
                for t, a, b in zip(*(x.tolist() for x in _runs(data, member, offsets, least)), strict=True):
                    found.setdefault(t, []).append((kind, a - int(offsets[t]), b - int(offsets[t])))
            out = []
            for i, raw in enumerate(texts):
                runs = found.get(i, ())
                spans = scan_text(raw, [x[1:] for x in runs if x[0] == "hex"], [x[1:] for x in runs if x[0] == "any"])
                if spans and not raw.isascii():                # bytes to code points
                    place = np.cumsum((np.frombuffer(raw + b" ", np.uint8) & 0xC0) != 0x80) - 1
                    spans = [(k, int(place[a]), int(place[b])) for k, a, b in spans]
                out.append([{"kind": k, "start": a, "end": b} for k, a, b in spans])
            yield pa.RecordBatch.from_arrays([rows[c] for c in columns] + [pa.array(out, pa.list_(span))], [*columns, "secrets"])
        give_back_memory()


def find_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` plus ``secrets``: sorted spans (kind, start, end) in code points of every whole text.

    Kinds: ``assign``, ``access``, ``hex`` (leftmost, non-overlapping matches
    of the fixed patterns) and ``entropy``. Null and empty texts have none. No
    shuffle; a row costs its own text only. Other columns pass through; one
    named ``secrets`` is replaced.
    """
    passed = [c for c in docs.columns if c != "secrets"]      # the text itself may have that name
    named = docs.select(*[F.col(f"`{c}`").alias(f"in_{i}") for i, c in enumerate(passed)], F.col(f"`{text}`").alias("text"))
    columns = named.columns[:-1]
    schema = ", ".join(f"{c} {named.schema[c].dataType.simpleString()}" for c in columns)
    out = named.mapInArrow(
        lambda batches: _scan(batches, columns), f"{schema}, secrets array<struct<kind string, start long, end long>>"
    )
    return out.select(*[F.col(f"in_{i}").alias(c) for i, c in enumerate(passed)], "secrets")


def redact(text: str | None, spans: list) -> str | None:
    """``text`` with every span (merged where they overlap) replaced by ``[KIND]`` of its first span."""
    if not text or not spans:
        return text
    merged: list[list] = []
    for s in sorted(spans, key=lambda s: (s["start"], KINDS.index(s["kind"]))):
        if merged and s["start"] < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], s["end"])
        else:
            merged.append([s["start"], s["end"], s["kind"]])
    out, at = [], 0
    for lo, hi, kind in merged:
        out += [text[at:lo], f"[{kind.upper()}]"]
        at = hi
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by its kind in brackets; other columns unchanged."""
    columns = docs.columns
    named = docs.select(*[F.col(f"`{c}`").alias(f"in_{i}") for i, c in enumerate(columns)], F.col(f"`{text}`").alias("text"))
    ins, at = [f"in_{i}" for i in range(len(columns))], columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # scan and replacement in one pass: one worker a task
        for batch in _scan(batches, [*ins, "text"]):
            new = [
                redact(t, s) if s else t
                for t, s in zip(batch["text"].to_pylist(), batch["secrets"].to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([batch[c] if i != at else pa.array(new, pa.string()) for i, c in enumerate(ins)], ins)

    schema = ", ".join(f"{c} {named.schema[c].dataType.simpleString()}" for c in ins)
    return named.mapInArrow(run, schema).select(*[F.col(f"in_{i}").alias(c) for i, c in enumerate(columns)])
