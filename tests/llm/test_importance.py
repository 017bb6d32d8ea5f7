"""op13: importance resampling against a plain recomputation."""

import collections
import hashlib
import math
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import rosterlens.llm.importance as importance
from rosterlens.llm.importance import Buckets, resample, words_with_offsets

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(c.lower() if c.isascii() else c for c in text or "")


def features(text, most=2):
    w = WORD.findall(lower(text))
    return w, [" ".join(w[i : i + k]) for k in range(1, most + 1) for i in range(len(w) - k + 1)]


def brute(docs, target, percent=25, least=20, most=2, buckets=10_000, seed=7):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (collections.Counter(bucket(f) for _, text in rows for f in features(text, most)[1]) for rows in (docs, target))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log(((t[b] + 1.0) * (all_s + buckets)) / ((s[b] + 1.0) * (all_t + buckets))))
    rows = []
    for i, text in docs:
        w, f = features(text, most)
        weight = sum(gain(bucket(x)) for x in f) // len(f) if f else 0
        score = None
        if i is not None:
            h = int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([i, len(w), len(f), weight, score, None])
    entered = sorted((r for r in rows if r[1] >= least and r[0] is not None), key=lambda r: (-r[4], r[0], r[2], r[3]))
    for k, r in enumerate(entered[: len(entered) * percent // 100], 1):
        r[5] = k
    return sorted(map(tuple, rows), key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()), key=str)


def texts(n):
    vocabulary = ["Alpha", "beta", "ÉTÉ", "漢字", "x" * 90, "l0ng" * 30, "Z", "a1", "niño", "the", "of"]
    return [" ".join(vocabulary[(i * k * k + k) % len(vocabulary)] + "-,!"[k % 3] for k in range(i % 60)) for i in range(n)]


@pytest.mark.parametrize("most,buckets", [(2, 10_000), (1, 97), (3, 70_000)])
def test_against_brute_force(spark, most, buckets):
    docs = list(enumerate(texts(150)))
    odd = [(200, None), (201, ""), (202, " .,-"), (None, " ".join(["word"] * 30)), (None, None), *[(7, docs[59][1])] * 3, (7, "w " * 25), *[(300, docs[40][1])] * 60]
    target = [(1, "the of alpha beta " * 5), (2, None), (3, "")]
    frame = spark.createDataFrame([(i, t, "mine", -1, "mine") for i, t in docs + odd], "doc_id long, text string, score string, rank int, weight string")
    wanted = spark.createDataFrame(target, "item_id long, text string")
    assert got(resample(frame, wanted, most=most, buckets=buckets)) == brute(docs + odd, target, most=most, buckets=buckets)
    assert got(resample(frame, wanted, percent=100, least_words=1, seed=9)) == brute(docs + odd, target, 100, 1, seed=9)


def test_empty_tables(spark):
    docs = spark.createDataFrame(list(enumerate(texts(80))), "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert got(resample(docs, none)) == brute(list(enumerate(texts(80))), [])
    assert got(resample(docs.where("false"), none)) == []
    assert got(resample(docs.where("false"), none.unionAll(spark.createDataFrame([(1, "a b")], none.schema)))) == []


def test_hot_repeated_rows(spark):
    """A third of the rows is one row, a third has no id."""
    text = texts(60)[59]
    docs = list(enumerate(texts(60))) + [(5, text)] * 60 + [(None, text)] * 60
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    rows = got(resample(frame, spark.createDataFrame([(1, "alpha")], "item_id long, text string"), percent=50))
    assert rows == brute(docs, [(1, "alpha")], percent=50)
    assert len({r[5] for r in rows if r[5]}) == len([r for r in rows if r[5]])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("aZ9 -é漢\x00{`\n"), max_size=40), max_size=6), st.integers(1, 3), st.integers(1, 60))
def test_buckets_of_random_texts(texts, most, chunk):
    was, importance.CHUNK = importance.CHUNK, chunk
    try:
        found = Buckets(most, 5000).of(texts)
        for text, (n, buckets) in zip(texts, found, strict=True):
            w, f = features(text, most)
            assert n == len(w) and sorted(buckets.tolist()) == sorted(zlib.crc32(x.encode()) % 5000 for x in f)
            assert words_with_offsets(text) == [(m[0], m.span()) for m in WORD.finditer(lower(text))]
    finally:
        importance.CHUNK = was


def test_very_long_texts():
    long = ["word, " * 300_000, "é" * 1_200_000, "-" * 1_200_000, "a" * 600_000 + " " + "b" * 600_000]
    for text, (n, buckets) in zip(long, Buckets(2, 10_000).of(long), strict=True):
        w, f = features(text)
        want = collections.Counter(zlib.crc32(x.encode()) % 10_000 for x in f)
        assert n == len(w) and collections.Counter(buckets.tolist()) == want
