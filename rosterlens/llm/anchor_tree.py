"""Hard-negative mining with bounds along a spanning tree of the anchors.

Components become integers, so scores (inner products) are exact. The anchors
are put in order of label and id and cut into trees of at most ``TREE``; every tree is a
minimum spanning tree of its anchors. A candidate x whose score at a parent
anchor p lies in [lo, hi] scores at the child c within
[lo - |c - p| * |x|, hi + |c - p| * |x|]. Only where that range meets the window
that still counts is the score computed, and the range shrinks to it.

Rows are never moved: a task holds the trees of one pass (``TREES`` of them, sent
once) and walks down each with its rows in blocks of ``ROWS``. The first pass
finds the positives (window: from the k-th best so far upwards), the second the
negatives (the windows that the positives allow, closed from below once k are
found). Each task returns its own best few per anchor, and those are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterlens.llm.common import Scratch, numbered, stored

TREE = 1024                  # anchors in one spanning tree,
TREES = 16                   # trees in one pass over the rows,
ROWS = 1024                  # and rows compared with a tree at a time
LARGEST = 1 << 56            # no sum of squares of a row may pass this, so that 100 * score fits a long


def spanning_tree(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, parent, edge) of a minimum spanning tree: parents come before their children.

    ``parent`` is a place in ``order`` (-1 for the first); ``edge`` is never below the distance.
    """
    n = len(points)
    x = points.astype(np.float64)
    squares = (x * x).sum(axis=1)
    near, via = np.full(n, np.inf), np.zeros(n, np.int64)
    order, place, parent = np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, -1, np.int64)
    left = np.ones(n, bool)
    at = 0
    for k in range(n):
        order[k], place[at], left[at] = at, k, False
        if k:
            parent[k] = place[via[at]]
        distance = squares + squares[at] - 2 * (x @ x[at])
        closer = left & (distance < near)
        near[closer], via[closer] = distance[closer], at
        at = int(np.argmin(np.where(left, near, np.inf)))
    apart = x[order] - x[order[np.maximum(parent, 0)]]
    return order, parent, np.sqrt((apart * apart).sum(axis=1)) * (1 + 1e-12)


class Tree:
    """One tree: its anchors in walking order, and what each still looks for."""

    def __init__(self, rows: dict):
        order = np.argsort(rows["step"])
        take = lambda name: [rows[name][i] for i in order]
        self.at, self.ids, self.labels = np.array(take("at")), np.array(take("id")), take("label")
        self.parent, self.edge = np.array(take("parent")), np.array(take("edge"))
        self.q = np.array(take("q"), np.int64).reshape(len(order), rows["dims"][0])
        self.exact = self.q.astype(np.float64)
        self.scored = 0          # scores computed by walk(), for tests and figures

    def walk(self, rows: np.ndarray, wanted) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(anchor, chosen rows, their scores) for all rows whose range meets ``wanted(anchor)`` = (mask, lo, hi)."""
        fast = np.abs(rows).max(initial=0) * 1.0 * np.abs(self.q).max(initial=0) * max(1, self.q.shape[1]) < 1 << 53
        x = rows.astype(np.float64)
        norm = np.sqrt((x * x).sum(axis=1)) * (1 + 1e-12)
        lo, hi = np.zeros((len(self.q), len(rows))), np.zeros((len(self.q), len(rows)))
        for c, (p, edge) in enumerate(zip(self.parent.tolist(), self.edge.tolist(), strict=True)):
            mask, least, most = wanted(c)
            if p < 0:
                lo[c], hi[c] = -np.inf, np.inf
                chosen = np.arange(len(rows))
            else:
                reach = edge * norm + 1e-6 * (1 + np.abs(lo[p]))      # more than rounding can be off
                np.subtract(lo[p], reach, out=lo[c])
                np.add(hi[p], reach, out=hi[c])
                chosen = np.flatnonzero(mask & (hi[c] >= least) & (lo[c] <= most))
            if not len(chosen):
                continue
            score = (x[chosen] @ self.exact[c]).astype(np.int64) if fast else rows[chosen] @ self.q[c]
            lo[c, chosen] = hi[c, chosen] = score
            self.scored += len(chosen)
            if p < 0:
                keep = mask & (score >= least) & (score <= most)
                chosen, score = chosen[keep], score[keep]
            yield c, chosen, score


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties by smaller id."""
    return np.lexsort((ids, -scores))[:k]


class _Top:
    """The best k (score, id) so far."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.r_[self.scores, scores], np.r_[self.ids, ids]
        at = best(scores, ids, self.k)
        self.scores, self.ids = scores[at], ids[at]

    @property
    def least(self) -> float:
        """A lower score can no longer enter."""
        return float(self.scores[-1]) if len(self.scores) == self.k else -np.inf


def _blocks(batches: Iterator[pa.RecordBatch], labels: list) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(dims, ids, label numbers, integer rows) in blocks; a label no anchor has is -1."""
    known = pa.array(labels, pa.string())
    for batch in batches:
        dims = batch["dims"].to_numpy()
        numbers = pc.fill_null(pc.index_in(batch["label"], value_set=known), -1).to_numpy(zero_copy_only=False)
        for d in np.unique(dims).tolist():
            at = np.flatnonzero(dims == d)
            for i in range(0, len(at), ROWS):
                some = at[i : i + ROWS]
                q = batch["q"].take(pa.array(some)).flatten().to_numpy(zero_copy_only=False)
                yield d, batch["id"].to_numpy()[some], numbers[some], q.astype(np.int64).reshape(len(some), d)


def _numbered_labels(trees: list[Tree]) -> list:
    return sorted({label for t in trees for label in t.labels})


def _positives(rows: list[dict], k: int):
    """Rows -> each task's best k same-label rows of every anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [Tree(r) for r in rows]
        labels = _numbered_labels(trees)
        number = {x: i for i, x in enumerate(labels)}
        top = [[_Top(k) for _ in t.ids] for t in trees]
        for dims, ids, label, q in _blocks(batches, labels):
            for t, tree in enumerate(trees):
                if tree.q.shape[1] != dims:
                    continue
                same = {n: label == n for n in {number[x] for x in tree.labels}}

                def wanted(c, tree=tree, t=t, same=same):
                    return same[number[tree.labels[c]]], top[t][c].least, np.inf

                for c, chosen, score in tree.walk(q, wanted):
                    other = ids[chosen] != tree.ids[c]
                    top[t][c].add(score[other], ids[chosen][other])
        for t, tree in enumerate(trees):
            sizes = [len(x.ids) for x in top[t]]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(tree.at, sizes)), pa.array(np.concatenate([x.ids for x in top[t]])),
                    pa.array(np.concatenate([x.scores for x in top[t]])),
                ],
                ["at", "id", "score"],
            )

    return run


def _negatives(rows: list[dict], positives: dict[int, list[int]], k: int, window: tuple[int, int]):
    """Rows -> each task's best k other-label rows of every anchor and positive score, inside the window."""
    low, high = window

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [Tree(r) for r in rows]
        labels = _numbered_labels(trees)
        number = {x: i for i, x in enumerate(labels)}
        top = [[{p: _Top(k) for p in positives.get(int(a), ())} for a in t.at] for t in trees]
        for dims, ids, label, q in _blocks(batches, labels):
            for t, tree in enumerate(trees):
                if tree.q.shape[1] != dims:
                    continue
                other = {n: label != n for n in {number[x] for x in tree.labels}}
                nothing = np.zeros(len(ids), bool)

                def wanted(c, tree=tree, t=t, other=other, nothing=nothing):
                    if not top[t][c]:
                        return nothing, 0.0, 0.0
                    least = min(max(low * p / 100, best_.least) for p, best_ in top[t][c].items())
                    # rounding must not close a window
                    return other[number[tree.labels[c]]], least - 1, max(high * p / 100 for p in top[t][c]) + 1

                for c, chosen, score in tree.walk(q, wanted):
                    hit = other[number[tree.labels[c]]][chosen]
                    for p, best_ in top[t][c].items():
                        inside = hit & (low * p <= 100 * score) & (100 * score <= high * p) & (score >= best_.least)
                        if inside.any():
                            best_.add(score[inside], ids[chosen][inside])
        out = [(int(a), p, b) for t, tree in enumerate(trees) for a, tops in zip(tree.at, top[t], strict=True) for p, b in tops.items()]
        sizes = [len(b.ids) for *_, b in out]
        joined = lambda parts: np.concatenate([np.zeros(0, np.int64), *parts])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(np.array([a for a, *_ in out], np.int64), sizes)),
                pa.array(np.repeat(np.array([p for _, p, _ in out], np.int64), sizes)),
                pa.array(joined([b.ids for *_, b in out])), pa.array(joined([b.scores for *_, b in out])),
            ],
            ["at", "positive_score", "id", "score"],
        )

    return run


def _planted(group: pa.Table) -> pa.Table:
    """One tree's anchors -> with their step, parent step and edge."""
    group = group.sort_by("at").combine_chunks()
    dims = group["dims"][0].as_py()
    q = group["q"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(group), dims)
    order, parent, edge = spanning_tree(q)
    group = group.take(pa.array(order))
    return (
        group.append_column("step", pa.array(np.arange(len(order))))
        .append_column("parent", pa.array(parent))
        .append_column("edge", pa.array(edge))
        .select(["tree", "dims", "step", "parent", "edge", "at", "id", "label", "q"])
    )


def integer_rows(vectors: DataFrame, key: str, vector: str, label: Column) -> DataFrame:
    """(id, label, dims, q): the rows that take part, one per id."""
    v = F.col("vector")
    rows = vectors.select(
        F.col(f"`{key}`").cast("long").alias("id"), label.cast("string").alias("label"),
        F.col(f"`{vector}`").cast("array<double>").alias("vector"),
    ).where("id is not null and label is not null and vector is not null")
    whole = F.transform(v, lambda x: F.floor(256 * x).cast("int"))
    squares = F.aggregate(v, F.lit(0.0), lambda total, x: total + F.pow(F.floor(256 * x).cast("double"), F.lit(2.0)))
    usable = F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < 1 << 22)) & (squares < float(LARGEST))
    return rows.where(usable).select("id", "label", F.size(v).alias("dims"), whole.alias("q"))


def hard_negatives(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: Column | None = None, every: int = 100,
    positives: int = 5, negatives: int = 10, window: tuple[int, int] = (30, 90),
) -> DataFrame:
    """Per anchor and positive the best negatives: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose id is divisible by ``every``. An anchor's
    positives are its best ``positives`` other rows of the same label; of each,
    the best ``negatives`` rows of other labels with window[0] * positive_score
    <= 100 * negative_score <= window[1] * positive_score are returned (all,
    if there are fewer). Higher scores come first, ties by smaller id.
    ``label`` is the label as an expression (default: the column ``label``).

    Rows with a null id, label or vector, with a null or non-finite component,
    with a component of 2^22 or more in size or whose integer components'
    squares sum to over 2^56 (scores would not fit) take no part. Vectors of
    different lengths have no score. Rows that repeat an id count once, by
    the smallest label and vector. Empty tables give no rows. Other columns
    are ignored.
    """
    spark = vectors.sparkSession
    with Scratch() as scratch:
        rows = stored(integer_rows(vectors, key, vector, F.col("label") if label is None else label), "integers")
        if not rows.groupBy("id").count().where("count > 1").isEmpty():
            least = F.min(F.struct("label", "q", "dims")).alias("r")
            rows = stored(rows.groupBy("id").agg(least).select("id", "r.label", "r.dims", "r.q"), "integers-once")
        anchors = numbered(rows.where(F.col("id") % every == 0), ["dims", "label", "id"], "at")
        anchors = anchors.withColumn("tree", F.floor((F.col("at") - 1) / TREE))
        schema = "tree long, dims int, step long, parent long, edge double, at long, id long, label string, q array<int>"
        planted = stored(anchors.select("tree", "dims", "at", "id", "label", "q").groupBy("tree", "dims").applyInArrow(_planted, schema), "trees")
        last = planted.agg(F.max("tree")).first()[0]
        parts = []
        for lo in range(0, 0 if last is None else last + 1, TREES):
            # at most TREE * TREES anchors at a time reach the driver and the tasks
            held: dict[tuple, dict] = {}
            for r in planted.where(F.col("tree").between(lo, lo + TREES - 1)).toLocalIterator():
                one = held.setdefault((r.tree, r.dims), {c: [] for c in planted.columns})
                for c in planted.columns:
                    one[c].append(r[c])
            trees = list(held.values())
            names = planted.where(F.col("tree").between(lo, lo + TREES - 1)).select("at", F.col("id").alias("anchor_id"))
            near = Window.partitionBy("at").orderBy(F.col("score").desc(), "id")
            found = rows.mapInArrow(_positives(trees, positives), "at long, id long, score long")
            found = found.withColumn("place", F.row_number().over(near)).where(F.col("place") <= positives)
            found = stored(found.select("at", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
            scores: dict[int, list[int]] = {}
            for r in found.select("at", "positive_score").distinct().toLocalIterator():
                scores.setdefault(r["at"], []).append(r.positive_score)
            near = Window.partitionBy("at", "positive_score").orderBy(F.col("score").desc(), "id")
            mined = rows.mapInArrow(
                _negatives(trees, scores, negatives, window), "at long, positive_score long, id long, score long"
            )
            mined = mined.withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= negatives)
            part = found.join(mined, ["at", "positive_score"]).join(names, "at")
            parts.append(scratch.keep(stored(part.select(
                "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
            ), "mined")))
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    out = spark.createDataFrame([], schema)
    for part in parts:
        out = out.unionAll(part)
    return out
