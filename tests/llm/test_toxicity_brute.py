"""op8: the lexicon, the label model and the scores against plain recomputations."""

import math
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rosterlens.llm import toxicity
from rosterlens.llm.toxicity import COVER, LEAST_DOCUMENTS, LEAST_ODDS, covering, label_model


def plain_entries(text):
    words = set(re.findall(r"[^\W\d_]+", text.lower()))
    return words | {w[:n] + "*" for w in words for n in (4, 5, 6) if len(w) > n}


def texts():
    """Clean prose, and three kinds of toxic documents, one of them rare; each kind has words of its own."""
    rng = random.Random(4)
    clean = [" ".join(f"word{rng.randint(0, 300)}x" for _ in range(30)) for _ in range(260)]
    clean = [re.sub(r"\d", lambda m: "abcdefghij"[int(m[0])], t) for t in clean]
    kinds = {"vile": 120, "rotten": 90, "merde": 24}
    toxic = [f"{rng.choice(clean)} you {kind}{rng.choice(['', 'er', 'ish'])} {kind} thing" for kind, n in kinds.items() for _ in range(n)]
    rows = [(i, t, 0) for i, t in enumerate(clean)] + [(1000 + i, t, 1) for i, t in enumerate(toxic)]
    return rows


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.text("abc", min_size=1, max_size=3), st.sets(st.integers(0, 12), min_size=1), max_size=20), st.integers(1, 4))
def test_cover(documents, cover):
    """Every document has ``cover`` different entries, or all it is in (entries of equal documents count once)."""
    chosen = covering(documents, cover)
    assert len(chosen) == len(set(chosen)) and set(chosen) <= set(documents)
    distinct = {frozenset(ds) for ds in documents.values()}
    assert len({frozenset(documents[e]) for e in chosen}) == len(chosen)
    for d in set().union(*documents.values()) if documents else ():
        assert sum(d in documents[e] for e in chosen) >= min(cover, sum(d in ds for ds in distinct))
    gains = []                                                       # each choice gains most at its time
    lacking = {d: cover for ds in documents.values() for d in ds}
    left = dict(documents)
    for e in chosen:
        gain = {x: sum(lacking[d] > 0 for d in ds) for x, ds in left.items()}
        assert gain[e] == max(g for x, g in gain.items() if frozenset(left[x]) not in gains)
        gains.append(frozenset(left[e]))
        for d in left.pop(e):
            lacking[d] = max(0, lacking[d] - 1)


@pytest.fixture(scope="module")
def fitted(spark):
    rows = texts()
    docs = spark.createDataFrame([(i, t, "mine") for i, t, _ in rows], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    return rows, docs, labels, toxicity.fit(docs, labels)


def test_lexicon_is_that_of_a_recount(spark, fitted):
    import zlib

    rows, docs, labels, model = fitted
    seen = {t: y for i, t, y in rows if zlib.crc32(str(i).encode()) % 5}       # the fold, one row a text
    toxic = {t for t, y in seen.items() if y}
    counts = {}
    for t, y in seen.items():
        for e in plain_entries(t):
            counts.setdefault(e, [0, 0])[y] += 1
    useful = {
        e for e, (c, t) in counts.items()
        if t >= LEAST_DOCUMENTS
        and math.log((t + 0.5) / (len(toxic) + 1)) - math.log((c + 0.5) / (len(seen) - len(toxic) + 1)) >= LEAST_ODDS
    }
    assert set(model["lexicon"]) <= useful
    for text in toxic:
        have = plain_entries(text)
        groups = {frozenset(t for t in toxic if e in plain_entries(t)) for e in have & useful}
        assert len(have & set(model["lexicon"])) >= min(COVER, len(groups))
    assert any(e.startswith("merd") for e in model["lexicon"])                 # the rare kind has voters


def test_scores_are_those_of_a_recomputation(spark, fitted):
    rows, docs, _, model = fitted
    place = {e: k for k, e in enumerate(model["lexicon"])}
    scored = toxicity.score(docs, model).collect()
    assert sorted(r.doc_id for r in scored) == sorted(i for i, *_ in rows) and scored[0].asDict().keys() == {"doc_id", "text", "score"}
    for r in scored[::7]:
        words = re.findall(r"[^\W\d_]+", r.text.lower())
        strength = np.zeros(len(place) + 6)
        hits = 0
        for w in words:
            mine = [w] + [w[:n] + "*" for n in (4, 5, 6) if len(w) > n]
            for e in mine:
                if e in place:
                    strength[place[e]] += 1
            hits += any(e in place for e in mine)
        distinct = (strength > 0).sum()
        strength = np.log1p(strength)
        dense, loud = hits / (len(words) + 20), sum(c.isupper() for c in r.text) / len(r.text)
        addressed = re.search(r"\b(you|your|du|ihr|tu|vous|usted)\b", r.text.lower())
        strength[len(place):] = [
            distinct >= 2, distinct >= 3, dense if dense > 0.01 else 0, loud if loud > 0.3 else 0, "!!" in r.text, hits > 0 and bool(addressed),
        ]
        margin = model["intercept"] + float(strength @ np.array(model["weights"]))
        assert r.score == pytest.approx(1 / (1 + math.exp(-margin)), rel=1e-9)
    truth = {i: y for i, _, y in rows}
    assert sum((r.score >= 0.5) == bool(truth[r.doc_id]) for r in scored) >= 0.98 * len(rows)


def test_posteriors_are_those_of_a_slow_em():
    """One round written out by hand, from the fixed start."""
    rng = np.random.default_rng(2)
    votes = (rng.random((40, 3)) < 0.4).astype(float)
    q, told = label_model(votes, 0.3, rounds=1)
    total = votes.sum(axis=1)
    start = np.clip(np.where(total > 0, 0.5 + 0.4 * np.minimum(total, 3) / 3, 0.15), 0.01, 0.99)
    fire = []
    for r in (1 - start, start):
        fire.append([(sum(r[i] * votes[i, k] for i in range(40)) + 0.05) / (sum(r) + 1) for k in range(3)])
    fire[1] = [max(a, b) for a, b in zip(*fire)]
    assert np.allclose(told["fire_clean"], fire[0]) and np.allclose(told["fire_toxic"], fire[1])
    for i in range(40):
        odds = math.log(0.3 / 0.7)
        for k in range(3):
            a, b = fire[1][k], fire[0][k]
            odds += told["weights"][k] * (math.log(a / b) if votes[i, k] else math.log((1 - a) / (1 - b)))
        assert q[i] == pytest.approx(1 / (1 + math.exp(-odds)))


def test_empty_and_odd_texts(spark, fitted):
    model = fitted[3]
    odd = [(1, None), (2, ""), (3, "vile " * 200_000), (None, "vile merde"), (4, "漢字" * 1000)]
    got = {(r.doc_id, r.text if r.text is None else r.text[:9]): r.score for r in toxicity.score(spark.createDataFrame(odd, "doc_id long, text string"), model).collect()}
    assert got[1, None] == got[2, ""] == got[4, "漢字漢字漢字漢字漢"] < 0.5 < got[None, "vile merd"] and got[3, "vile vile"] > 0.5
    assert toxicity.score(spark.createDataFrame([], "doc_id long, text string"), model).count() == 0
