"""Toxicity by weak supervision: voters, a generative label model, a linear classifier.

1. *Voters.* Words and word beginnings that are far commoner in toxic than in
   clean documents of a bounded labelled sample are the candidates. They are taken
   one by one, each time the one in the most toxic documents that have fewer than
   ``COVER`` voters yet, until no document gains: every kind of toxic
   document that any candidate tells gets voters, rare kinds and languages too. A few
   pattern voters look at numbers of distinct hits, at density, shouting
   and address. A voter says "toxic" or abstains.
2. *Label model.* The votes of the sample, without its labels, are explained by
   a latent class: EM estimates every voter's firing rate in either class.
   Voters that agree more often within a class than independence allows are
   correlated (a word and its beginning always are); their votes are weighted
   by 1 / (1 + sum of their correlations), so that one sign is not counted
   many times. The result is a posterior label per document.
3. *Classifier.* A logistic regression on the voters' strengths (log counts
   and density) is trained on the posteriors and scores every whole text. Its
   intercept is set so that 0.5 best separates the sample's labels.

Labels, language, source and id are never inputs of a score.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlens.llm.common import give_back_memory, stored

MAX_LABELLED = 16_000        # expected size of the labelled sample, half of it toxic where there are so many
COVER = 12                   # voters that every toxic document of the sample gets, where there are so many
LEAST_DOCUMENTS = 4          # different toxic documents a lexicon entry must be in
LEAST_ODDS = 3.5             # log odds of an entry
BEGINNINGS = (4, 5, 6)
_WORD = re.compile(r"[^\W\d_]+")
_YOU = re.compile(r"\b(you|your|du|ihr|tu|vous|usted)\b")
PATTERNS = ("two_hits", "three_hits", "dense_hits", "capitals", "exclamations", "addressed")


def entries_of(text: str) -> set[str]:
    """Distinct lexicon candidates of a text: words, and beginnings (with a star) of longer words."""
    words = set(_WORD.findall(text.lower()))
    return words | {w[:n] + "*" for w in words for n in BEGINNINGS if len(w) > n}


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial (entry, toxic documents, clean documents) of a task's rows, flushed when large."""

    def told(counts):
        names = list(counts[1].keys() | counts[0].keys())
        return pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), *[pa.array([counts[y][x] for x in names], pa.int64()) for y in (1, 0)]],
            ["entry", "toxic", "clean"],
        )

    counts = (Counter(), Counter())
    for batch in batches:
        for text, y in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist(), strict=True):
            counts[y].update(entries_of(text or ""))
            if len(counts[0]) + len(counts[1]) > 300_000:
                yield told(counts)
                counts = (Counter(), Counter())
    yield told(counts)


def _document_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(entry, document) of a task's rows."""
    for batch in batches:
        for text, i in zip(batch["text"].to_pylist(), batch["__id"].to_pylist(), strict=True):
            names = sorted(entries_of(text or ""))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([i] * len(names), pa.int64())], ["entry", "document"])


def covering(documents: dict[str, set[int]], cover: int) -> list[str]:
    """Entries, best first, so that every document has ``cover`` of them or all it is in.

    Always the entry in the most documents that still lack some; ties by name. An
    entry found in the very documents of another one tells nothing new and is left out.
    """
    lacking = {d: cover for ds in documents.values() for d in ds}
    heap = [(-len(ds), entry) for entry, ds in documents.items()]
    heapq.heapify(heap)
    out, seen = [], set()
    while heap:
        told, entry = heapq.heappop(heap)
        gain = sum(1 for d in documents[entry] if lacking[d])
        if not gain:
            continue
        if heap and (-gain, entry) > heap[0]:                # others may gain more by now
            heapq.heappush(heap, (-gain, entry))
            continue
        same = frozenset(documents[entry])
        if same in seen:
            continue
        seen.add(same)
        out.append(entry)
        for d in same:
            lacking[d] = max(0, lacking[d] - 1)
    return out


class Voters:
    """Votes and strengths of the lexicon and pattern voters."""

    def __init__(self, lexicon: list[str]):
        self.lexicon = lexicon
        self.place = {x: i for i, x in enumerate(lexicon)}
        self.heads = {x[:4] for x in lexicon if x.endswith("*")}
        self.size = len(lexicon) + len(PATTERNS)

    def strengths(self, text: str) -> np.ndarray:
        """Row of strengths: log(1 + count) per entry, then the patterns; 0 is an abstention."""
        out = np.zeros(self.size)
        if not text:
            return out
        words = _WORD.findall(text.lower())
        hits = 0
        for w in words:
            i = self.place.get(w)
            if i is not None:
                out[i] += 1
            hit = i is not None
            if w[:4] in self.heads:
                for n in BEGINNINGS:
                    i = self.place.get(w[:n] + "*") if len(w) > n else None
                    if i is not None:
                        out[i] += 1
                        hit = True
            hits += hit
        n = len(self.lexicon)
        distinct = int((out[:n] > 0).sum())
        out[:n] = np.log1p(out[:n])
        capitals = sum(map(str.isupper, text)) / len(text)
        patterns = (
            distinct >= 2, distinct >= 3, hits / (len(words) + 20) > 0.01 and hits / (len(words) + 20),
            capitals > 0.3 and capitals, "!!" in text, hits > 0 and bool(_YOU.search(text.lower())),
        )
        out[n:] = [float(p) for p in patterns]
        return out


def label_model(votes: np.ndarray, prior: float, rounds: int = 30) -> tuple[np.ndarray, dict]:
    """Posterior P(toxic) of every row of a 0/1 vote matrix; accuracies, correlations and weights.

    EM over two classes. Voters start as better than chance; each round
    re-estimates the firing rates, the excess agreement of pairs within a class
    and from it the voters' weights.
    """
    n, m = votes.shape
    any_vote = votes.sum(axis=1)
    q = np.clip(np.where(any_vote > 0, 0.5 + 0.4 * np.minimum(any_vote, 3) / 3, prior / 2), 0.01, 0.99)
    weights = np.ones(m)
    for _ in range(rounds):
        fire = [(votes.T @ r + 0.05) / (r.sum() + 1) for r in (1 - q, q)]
        fire[1] = np.maximum(fire[1], fire[0])                       # a voter is not worse than chance
        correlation = np.zeros((m, m))
        for r, f in zip((1 - q, q), fire, strict=True):
            centred = (votes - f) * np.sqrt(r / max(r.sum(), 1e-9))[:, None]
            spread = np.sqrt(np.maximum((centred**2).sum(axis=0), 1e-9))
            correlation = np.maximum(correlation, (centred.T @ centred) / spread[:, None] / spread[None, :])
        np.fill_diagonal(correlation, 0)
        weights = 1 / (1 + np.where(correlation > 0.2, correlation, 0).sum(axis=1))
        odds = np.log(prior / (1 - prior))
        odds = odds + votes @ (weights * np.log(fire[1] / fire[0]))
        odds += (1 - votes) @ (weights * np.log((1 - fire[1]) / (1 - fire[0])))
        new = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        if np.abs(new - q).max() < 1e-6:
            break
        q = new
    return q, {"fire_clean": fire[0], "fire_toxic": fire[1], "correlation": correlation, "weights": weights}


def train_linear(x: np.ndarray, q: np.ndarray, rounds: int = 300, decay: float = 1e-3) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels: full-batch gradient steps with momentum."""
    scale = np.maximum(np.sqrt((x**2).mean(axis=0)), 1e-3)
    z, w, b = x / scale, np.zeros(x.shape[1]), 0.0
    vw, vb = np.zeros_like(w), 0.0
    balance = np.where(q > 0.5, 0.5 / max(q.mean(), 1e-3), 0.5 / max(1 - q.mean(), 1e-3))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w + b, -30, 30)))
        g = balance * (p - q) / len(q)
        vw = 0.9 * vw - 0.5 * (z.T @ g + decay * w)
        vb = 0.9 * vb - 0.5 * g.sum()
        w, b = w + vw, b + vb
    return w / scale, b


def best_intercept(margin: np.ndarray, y: np.ndarray) -> float:
    """The cut of the margins with the best F1 on the labels, in the middle of its gap."""
    order = np.argsort(-margin, kind="stable")
    hits = np.cumsum(y[order])
    taken = np.arange(1, len(y) + 1)
    ends = np.r_[margin[order][1:] < margin[order][:-1], True]         # equal margins stay together
    f1 = np.where(ends, 2 * hits / (taken + y.sum()), -1)
    k = int(np.argmax(f1))
    lower = margin[order][k + 1] if k + 1 < len(y) else margin[order][k] - 1
    return -(margin[order][k] + lower) / 2


def held_out(key: str = "doc_id") -> Column:
    """True for the fold whose labels are never read: crc32 of the id as text, modulo 5, is 0."""
    return F.crc32(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", max_labelled: int = MAX_LABELLED) -> dict:
    """Model of ``docs`` (key, text) with ``labels`` (key, toxic): lexicon, weights, intercept.

    Only rows outside the held-out fold are read. The sample is bounded by
    ``max_labelled`` rows (by a hash of the id, at most half of it per class);
    only the toxic documents of its lexicon candidates and its votes reach the
    driver. Without both classes the model is a constant.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col(f"`{key}`").isNotNull() & ~held_out(key))
    known = known.groupBy(F.col(f"`{key}`").alias("__id")).agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return {"lexicon": [], "weights": [], "intercept": 2.0 if sizes.get(1) else -2.0}
    share = F.when(F.col("toxic") == 1, max_labelled / 2 / sizes[1]).otherwise(max_labelled / 2 / sizes[0])
    chance = F.pmod(F.xxhash64("__id", F.lit(5)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    sample = known.where(chance < share)
    texts = docs.select(F.col(f"`{key}`").alias("__id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    # the sample has a bounded number of ids, so the texts need no shuffle
    sample = texts.join(F.broadcast(sample), "__id").select("__id", "text", "toxic").withColumn("__t", F.xxhash64("text"))
    sample = stored(sample.dropDuplicates(["__t"]).drop("__t"), "labelled")     # copies would vouch for their words
    drawn = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(drawn) < 2:
        return {"lexicon": [], "weights": [], "intercept": -2.0}
    counted = sample.select("text", "toxic").mapInArrow(_document_counts, "entry string, toxic long, clean long")
    totals = counted.groupBy("entry").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c")).where(F.col("t") >= LEAST_DOCUMENTS)
    odds = F.log((F.col("t") + 0.5) / (drawn[1] + 1.0)) - F.log((F.col("c") + 0.5) / (drawn[0] + 1.0))
    useful = stored(totals.withColumn("odds", odds).where(F.col("odds") >= LEAST_ODDS).select("entry"), "lexicon")
    told = sample.where("toxic = 1").mapInArrow(_document_entries, "entry string, document long").join(useful, "entry")
    documents: dict[str, set[int]] = {}
    for r in told.toLocalIterator():
        documents.setdefault(r["entry"], set()).add(r["document"])
    lexicon = covering(documents, COVER)
    voters = Voters(sorted(lexicon))
    rows = sample.mapInArrow(_strengths(voters.lexicon, ["toxic", "__id"]), "toxic int, __id long, x array<double>").toArrow().sort_by("__id")
    y = rows["toxic"].to_numpy()
    x = rows["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(rows), voters.size)
    q, _ = label_model((x > 0).astype(float), float(y.mean()))
    weights, intercept = train_linear(x, q)
    shift = best_intercept(x @ weights, y)
    return {"lexicon": voters.lexicon, "weights": weights.tolist(), "intercept": float(shift)}


def _strengths(lexicon: list[str], columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voters = Voters(lexicon)
        for batch in batches:
            x = [voters.strengths(t).tolist() for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch[c] for c in columns] + [pa.array(x, pa.list_(pa.float64()))], [*columns, "x"])
            give_back_memory()

    return run


def score(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """``docs`` plus ``score`` (0 to 1) of every whole text; null and empty texts get the intercept's.

    One narrow pass. Other columns pass through; one named ``score`` is replaced.
    """
    passed = [c for c in docs.columns if c != "score"]
    named = docs.select(*[F.col(f"`{c}`").alias(f"in_{i}") for i, c in enumerate(passed)], F.col(f"`{text}`").alias("text"))
    columns = named.columns[:-1]
    lexicon, weights, intercept = model["lexicon"], np.array(model["weights"]), model["intercept"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voters = Voters(lexicon)
        for batch in batches:
            out = []
            for t in batch["text"].to_pylist():
                margin = intercept + (float(voters.strengths(t or "") @ weights) if lexicon else 0.0)
                out.append(1 / (1 + np.exp(-np.clip(margin, -30, 30))))
            yield pa.RecordBatch.from_arrays([batch[c] for c in columns] + [pa.array(out, pa.float64())], [*columns, "score"])
            give_back_memory()

    schema = ", ".join(f"{c} {named.schema[c].dataType.simpleString()}" for c in columns)
    scored = named.mapInArrow(run, f"{schema}, score double")
    return scored.select(*[F.col(f"in_{i}").alias(c) for i, c in enumerate(passed)], "score")
