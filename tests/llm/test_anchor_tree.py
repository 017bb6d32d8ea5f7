"""op12: hard negatives by spanning-tree bounds against brute force."""

import math

import numpy as np
import pytest

import rosterlens.llm.anchor_tree as anchor_tree
from rosterlens.llm.anchor_tree import Tree, hard_negatives, spanning_tree

SCHEMA = "vec_id long, embedding array<float>, label int, anchor_id string, rank string"


def usable(rows):
    out = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) or abs(x) >= 1 << 22 for x in v):
            continue
        q = [math.floor(256 * float(np.float32(x))) for x in v]
        if sum(x * x for x in q) >= 1 << 56:
            continue
        if i not in out or (str(label), q, len(q)) < out[i]:
            out[i] = str(label), q, len(q)
    return out


def brute(rows, every, positives=5, negatives=10):
    rows = usable(rows)
    out = []
    for a, (label, q, _) in rows.items():
        if a % every:
            continue
        score = {i: sum(x * y for x, y in zip(q, r[1])) for i, r in rows.items() if i != a and r[2] == len(q)}
        near = lambda ids: sorted(ids, key=lambda i: (-score[i], i))
        for p in near([i for i in score if rows[i][0] == label])[:positives]:
            s = score[p]
            found = near([i for i in score if rows[i][0] != label and 30 * s <= 100 * score[i] <= 90 * s])[:negatives]
            out += [(a, p, k, i, s, score[i]) for k, i in enumerate(found, 1)]
    return sorted(out)


def clusters(seed, n, dims=8, spread=0.25):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((6, dims))
    pick = rng.integers(0, 6, n)
    v = centres[pick] + spread * rng.standard_normal((n, dims))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    return [(int(i), [float(x) for x in np.float32(row)], int(p % 3)) for i, (row, p) in enumerate(zip(v, pick))]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, "mine", "mine") for i, v, label in rows], SCHEMA)


def got(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("tree,trees", [(1024, 16), (5, 2), (1, 1)])
def test_against_brute_force(spark, monkeypatch, tree, trees):
    monkeypatch.setattr(anchor_tree, "TREE", tree)
    monkeypatch.setattr(anchor_tree, "TREES", trees)
    monkeypatch.setattr(anchor_tree, "ROWS", 64)
    rows = clusters(1, 260)
    rows += [(1000 + i, v, label) for i, (_, v, label) in enumerate(rows[:40])]                # ties: the same vectors again
    assert got(hard_negatives(frame(spark, rows).repartition(3), every=10)) == brute(rows, 10) != []


def test_odd_rows(spark):
    good = clusters(2, 60)
    one = good[0][1]
    odd = [
        (None, one, 1), (200, None, 1), (210, [], 1), (211, [], 2), (212, [], 1), (220, one[:3], 1), (221, one[:3], 2), (222, one[:3], 1),
        (230, [None, *one[1:]], 1), (240, [float("nan"), *one[1:]], 1), (250, [float("inf"), *one[1:]], 2), (260, one, None),
        (270, [0.0] * 8, 1), (271, [0.0] * 8, 2), (280, [3.0e38, *one[1:]], 1), (290, [3.0e5] * 8, 1), (291, [3.0e5] * 8, 1),
        (292, [2.0e5] * 8, 2), (293, [2.7e5 + i for i in range(8)], 2), (300, [4.0e6] * 8, 1),
        (-300, one, 0), (-310, one, 0), *[(5, one, 2)] * 3, (5, good[7][1], 1),                      # one id with several rows
    ]
    assert got(hard_negatives(frame(spark, good + odd), every=10)) == brute(good + odd, 10)


def test_empty_and_single(spark):
    empty = frame(spark, [])
    assert got(hard_negatives(empty)) == []
    assert got(hard_negatives(frame(spark, [(0, [1.0, 0.0], 1)]))) == []
    assert got(hard_negatives(frame(spark, [(1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1)]))) == []             # no anchor
    assert [f.name for f in hard_negatives(empty).schema] == [
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    ]


def test_hot_label(spark):
    rows = clusters(3, 300)
    rows = [(i, v, 0 if i % 3 else label) for i, v, label in rows] + [(600 + i, rows[0][1], 1) for i in range(150)]
    assert got(hard_negatives(frame(spark, rows), every=20)) == brute(rows, 20)


def test_tree_is_minimal_and_in_order():
    points = np.random.default_rng(5).integers(-99, 99, (40, 4))
    order, parent, edge = spanning_tree(points)
    assert sorted(order) == list(range(40)) and parent[0] == -1 and all(0 <= parent[k] < k for k in range(1, 40))
    true = np.array([np.linalg.norm(points[order[k]] - points[order[parent[k]]]) for k in range(1, 40)])
    assert (edge[1:] >= true).all() and np.allclose(edge[1:], true)
    joined, total, apart = {0}, 0.0, np.linalg.norm(points[:, None] - points[None], axis=2)          # Prim, by hand
    while len(joined) < 40:
        d, j = min((apart[i, j], j) for i in joined for j in range(40) if j not in joined)
        joined.add(j)
        total += d
    assert math.isclose(total, true.sum())


def test_bounds_save_scores():
    """Anchors close to their parent: most rows lie outside the window by their bounds alone."""
    rng = np.random.default_rng(6)
    centre = rng.standard_normal(16)
    anchors = np.floor(256 * (centre + 0.01 * rng.standard_normal((50, 16)))).astype(np.int64)
    order, parent, edge = spanning_tree(anchors)
    told = {
        "step": list(range(50)), "parent": parent.tolist(), "edge": edge.tolist(), "at": order.tolist(), "id": order.tolist(),
        "label": ["x"] * 50, "q": anchors[order].tolist(), "dims": [16] * 50,
    }
    tree = Tree(told)
    rows = np.floor(256 * rng.standard_normal((2000, 16))).astype(np.int64)
    least = 0.6 * float(anchors[0] @ anchors[0])
    everyone = np.ones(len(rows), bool)
    for c, chosen, score in tree.walk(rows, lambda c: (everyone, least, np.inf)):
        exact = rows @ tree.q[c]
        assert (exact[chosen] == score).all() and set(np.flatnonzero(exact >= least)) <= set(chosen)
    assert tree.scored < 0.2 * 50 * 2000
