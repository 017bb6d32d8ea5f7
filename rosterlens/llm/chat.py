"""Chat formatting by token-level assembly.

Every turn is formatted alone: role and text are encoded as separate segments
and reserved ids, which no text can produce, are spliced around them:

    TURN role SAYS text END

In the text form these ids show as control strings; control strings that
occur inside a role or text are escaped first, reversibly, so that neither
form can be forged. Marks of +1 and -1 at the borders of assistant texts and
their prefix sums give the loss mask. A turn's place in its conversation is the
prefix sum of the lengths of the turns before it. The output has one row per turn,
so a conversation of any length is never one row or one task's memory.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rosterlens.llm.common import slices, stored
from rosterlens.llm.tokens import encoder

# --- fixed values of the template ------------------------------------------------
TURN, SAYS, END = "<|turn|>", "<|says|>", "</s>"
#: strings that a model or another template reads as control; escaped inside texts
CONTROL = (TURN, SAYS, END, "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
LOSS_ROLE = "assistant"
# ----------------------------------------------------------------------------------
_PLAIN = re.compile("|".join(re.escape(c[0]) + r"(\\*)" + "(?=" + re.escape(c[1:]) + ")" for c in CONTROL))
_ESCAPED = re.compile("|".join(re.escape(c[0]) + r"(\\+)" + "(?=" + re.escape(c[1:]) + ")" for c in CONTROL))


def escape(text: str) -> str:
    """A control string gets one more backslash after its first character."""
    return _PLAIN.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[0][:-1], text)


def reserved(path: str) -> dict[str, int]:
    """Ids of the template's control strings: the first ones above the vocabulary."""
    first = encoder(path).library.get_vocab_size()
    return {name: first + i for i, name in enumerate((TURN, SAYS, END))}


def _splice(path: str):
    """Rows (conv_id, turn, role, text) -> ids and loss mask of each turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, control = encoder(path), reserved(path)
        for batch in batches:
            for lo, hi in slices(batch["text"]):
                rows = batch.slice(lo, hi - lo)
                roles = [r or "" for r in rows["role"].to_pylist()]
                texts = [escape(t or "") for t in rows["text"].to_pylist()]
                r_ids, r_at = encode.encode(pa.array([escape(r) for r in roles], pa.string()))
                t_ids, t_at = encode.encode(pa.array(texts, pa.string()))
                n_role, n_text = np.diff(r_at), np.diff(t_at)
                size = n_role + n_text + 3
                end = np.cumsum(size)
                start = end - size
                says = start + 1 + n_role
                ids = np.zeros(int(end[-1]), np.int32)
                ids[start], ids[says], ids[end - 1] = control[TURN], control[SAYS], control[END]
                for values, begin, count, at in ((r_ids, start + 1, n_role, r_at), (t_ids, says + 1, n_text, t_at)):
                    ids[np.repeat(begin - at[:-1], count) + np.arange(len(values))] = values
                learned = np.array([r == LOSS_ROLE for r in roles])
                marks = np.zeros(len(ids) + 1, np.int32)
                marks[says[learned] + 1] += 1
                marks[end[learned] - 1] -= 1
                mask = np.cumsum(marks[:-1]) > 0
                places = pa.array(np.r_[0, end].astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [rows["conv_id"], rows["turn"], pa.ListArray.from_arrays(places, pa.array(ids)),
                     pa.ListArray.from_arrays(places, pa.array(mask))],
                    ["conv_id", "turn", "ids", "loss"],
                )

    return run


def format_chats(
    turns: DataFrame, path: str, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """One row per turn: conv_id, turn, place, ids, loss.

    ``ids`` go to ``place`` (from 0, gapless) of the conversation's token sequence;
    ``loss`` marks the tokens of assistant texts. Turns go by ``turn``, equal
    ones by their ids; null turns come first; a null text or role is empty;
    rows without a conversation id form one conversation. Other columns are
    ignored; an empty table gives no rows.
    """
    rows = turns.select(
        F.col(f"`{key}`").cast("long").alias("conv_id"), F.col(f"`{turn}`").cast("long").alias("turn"),
        F.col(f"`{role}`").alias("role"), F.col(f"`{text}`").alias("text"),
    )
    parts = rows.mapInArrow(_splice(path), "conv_id long, turn long, ids array<int>, loss array<boolean>")
    before = Window.partitionBy("conv_id").orderBy("turn", "ids").rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("place", F.coalesce(F.sum(F.size("ids")).over(before), F.lit(0)).cast("long"))


class _Reader:
    """Reads one conversation's tokens in order; keeps digests and the turn that is open."""

    def __init__(self, path: str):
        self.encode = encoder(path)
        self.control = {i: name for name, i in reserved(path).items()}
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0
        self.role, self.place = "", 0

    def read(self, place: int, ids: np.ndarray, loss: np.ndarray) -> None:
        if place != self.place:
            raise ValueError(f"token {self.place} is missing")
        self.place += len(ids)
        at = np.flatnonzero(ids >= min(self.control))
        names = [self.control[i] for i in ids[at].tolist()]
        if names != [TURN, SAYS, END] or at[0] != 0 or at[-1] != len(ids) - 1:
            raise ValueError("not a turn of this template")
        role, text = (self.encode.decode(ids[a + 1 : b]) for a, b in zip(at[:-1], at[1:], strict=True))
        self.chars += sum(map(len, names)) + len(role) + len(text)
        self.n_turns += 1
        self.turns.update(f"{unescape(role)}\n{unescape(text)}\n".encode())
        if loss.any():
            learned = unescape(self.encode.decode(ids[loss]))
            self.loss_chars += len(learned)
            self.loss.update(learned.encode())

    def told(self, key) -> tuple:
        return key, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def _read(path: str):
    def told(rows):
        types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, reader, rows = None, None, []
        for batch in batches:
            ids, loss = batch["ids"], batch["loss"]
            for i, (k, place) in enumerate(zip(batch["conv_id"].to_pylist(), batch["place"].to_pylist(), strict=True)):
                if reader is None or k != key:
                    if reader is not None:
                        rows.append(reader.told(key))
                    key, reader = k, _Reader(path)
                reader.read(place, ids[i].values.to_numpy(zero_copy_only=False), loss[i].values.to_numpy(zero_copy_only=False))
            if len(rows) > 10_000:
                yield told(rows)
                rows = []
        if reader is not None:
            rows.append(reader.told(key))
        yield told(rows)

    return run


def read_chats(formatted: DataFrame, path: str) -> DataFrame:
    """What the formatted tokens say, per conversation: turns, digests, loss text, characters.

    Conversations are hash-partitioned and sorted by place; a task streams through
    its turns and holds one of them (a digest of a whole conversation can only
    be made in order).
    """
    rows = formatted.select("conv_id", "place", "ids", "loss").repartition("conv_id").sortWithinPartitions("conv_id", "place")
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return rows.mapInArrow(_read(path), schema)


def formatted_text(formatted: DataFrame, path: str) -> DataFrame:
    """The text form of every turn: conv_id, turn, place, text."""
    def run(batches):
        encode = encoder(path)
        names = {i: name for name, i in reserved(path).items()}
        for batch in batches:
            out = []
            for ids in batch["ids"]:
                ids = ids.values.to_numpy(zero_copy_only=False)
                at = np.flatnonzero(ids >= min(names)).tolist()
                ends = [*at[1:], len(ids)]
                out.append("".join(names[int(ids[a])] + encode.decode(ids[a + 1 : b]) for a, b in zip(at, ends, strict=True)))
            yield pa.RecordBatch.from_arrays(
                [batch["conv_id"], batch["turn"], batch["place"], pa.array(out, pa.string())], ["conv_id", "turn", "place", "text"]
            )

    return formatted.select("conv_id", "turn", "place", "ids").mapInArrow(run, "conv_id long, turn long, place long, text string")


def chat_digests(turns: DataFrame, path: str) -> DataFrame:
    """Format ``turns``, write the result to the shared folder and read it back."""
    return read_chats(stored(format_chats(turns, path), "chats"), path)
