"""op11: ids by prefix dynamic programming against the tokenizers library."""

import hashlib
import json

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from rosterlens.llm.prefix_bpe import PrefixBpe, SuffixAutomaton, decode_documents, encode_documents, prefix_encoder
from rosterlens.llm.queries import op11_prefix_bpe
from rosterlens.llm.tokens import vocabulary

PATH = vocabulary()
LIBRARY = Tokenizer.from_file(PATH)
ODD = ["", None, " ", "\n\n  \t x", "a" * 5000, "-" * 3000, "ab" * 4000, "it's  we'll I'D 1234567", "漢字 é🙂 　x", "\x00\x01 \x7f",
       "x <|endoftext|> y<|endoftext|>", " ".join(["word"] * 3000)]


def slow_bpe(raw: bytes, vocabulary, merges):
    """Merge the leftmost pair of the lowest rank until none is left."""
    rank = {pair: r for r, pair in enumerate(merges)}
    parts = [bytes([b]) for b in raw]
    while True:
        known = [(rank[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in rank]
        if not known:
            return [vocabulary[p] for p in parts]
        _, i = min(known)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


@pytest.mark.parametrize("text", [t for t in ODD if t])
def test_ids_of_odd_texts(text):
    assert prefix_encoder(PATH).of(text).tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from("abcdetnshr '-_.=0123\n\t é漢🙂A"), max_size=60))
def test_ids_of_random_texts(text):
    ids = prefix_encoder(PATH).of(text)
    assert ids.tolist() == LIBRARY.encode(text, add_special_tokens=False).ids
    assert prefix_encoder(PATH).read(ids).decode() == LIBRARY.decode(ids.tolist(), skip_special_tokens=False) == text


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=14), st.lists(st.text("ab", max_size=25), max_size=5))
def test_any_vocabulary(picks, texts):
    """Random merge lists over two letters: equal letters make ties everywhere."""
    spelled, merges = [b"a", b"b"], []
    for i, j in picks:
        pair = spelled[i % len(spelled)], spelled[j % len(spelled)]
        if pair[0] + pair[1] not in spelled:
            merges.append(pair)
            spelled.append(pair[0] + pair[1])
    words = {s: i for i, s in enumerate(spelled)}
    bpe = PrefixBpe(words, merges)
    for text in texts:
        assert bpe.encode(text.encode()) == slow_bpe(text.encode(), words, merges)


def test_automaton_finds_every_token_end():
    rng = np.random.default_rng(3)
    strings = {bytes(rng.integers(97, 100, n).tolist()): i for i, n in enumerate(rng.integers(1, 7, 60))}
    raw = bytes(rng.integers(97, 101, 400).tolist())
    for i, found in enumerate(SuffixAutomaton(strings).ends(raw), 1):
        want = sorted(((t, len(s)) for s, t in strings.items() if raw[:i].endswith(s)), key=lambda x: -x[1])
        assert found == want


def test_refused_vocabularies():
    with pytest.raises(ValueError, match="two merges"):
        PrefixBpe({b"a": 0, b"aa": 1, b"aaa": 2}, [(b"a", b"a"), (b"a", b"aa"), (b"aa", b"a")])
    with pytest.raises(ValueError, match="before those"):
        PrefixBpe({b"a": 0, b"aa": 1, b"aaa": 2}, [(b"a", b"aa"), (b"a", b"a")])
    with pytest.raises(ValueError, match="cannot spell"):
        PrefixBpe({b"a": 0}, []).encode(b"ab")


def test_every_token_is_its_own_encoding():
    names = json.load(open(PATH, encoding="utf-8"))["model"]["vocab"]
    encoder = prefix_encoder(PATH)
    some = list(names.values())[::50]
    assert all(encoder.model.encode(encoder.strings[i]) == [i] for i in some if i not in encoder.special.values())


def test_documents(spark):
    rows = [(i, t, "mine", "mine") for i, t in enumerate(ODD)] + [(None, "a null id", None, None), (3, ODD[3], "x", "y"), (3, "another", "x", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, decoded string")
    got = encode_documents(docs, PATH, decoded=True).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.decoded) for r in got) == sorted((d is None, d or 0, t or "") for d, t, *_ in rows)
    want = sorted((d is None, d or 0, LIBRARY.encode(t or "", add_special_tokens=False).ids) for d, t, *_ in rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.ids) for r in got) == want
    back = decode_documents(encode_documents(docs, PATH), PATH).collect()
    assert sorted(r.text for r in back) == sorted(t or "" for _, t, *_ in rows)
    assert encode_documents(docs.where("false"), PATH).count() == 0
    plain = encode_documents(docs.where("doc_id = 10"), PATH, special=False).first().ids
    LIBRARY.encode_special_tokens = True
    try:
        assert plain == LIBRARY.encode(ODD[10], add_special_tokens=False).ids and 50256 not in plain
    finally:
        LIBRARY.encode_special_tokens = False


def test_one_very_long_text():
    text = "Ünbroken" * 150_000
    ids = prefix_encoder(PATH).of(text)
    assert prefix_encoder(PATH).read(ids).decode() == text
    assert ids.tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_two_pieces_under_one_key(monkeypatch):
    from rosterlens.llm.prefix_bpe import PrefixEncoder

    encoder = PrefixEncoder(PATH)
    monkeypatch.setattr(encoder, "_hashes", lambda data, start, end: (np.zeros(len(start), np.uint64), np.arange(len(start), dtype=np.uint64)))
    ids, places = encoder.encode(pa.array(["one two three", "four"]))
    assert ids.tolist() == LIBRARY.encode("one two three").ids + LIBRARY.encode("four").ids and places.tolist()[0] == 0


def test_query(spark):
    small = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = op11_prefix_bpe(spark, small).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in got:
        ids = LIBRARY.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), sha(",".join(map(str, ids))))
        assert r.decoded_sha256 == sha(LIBRARY.decode(ids, skip_special_tokens=False))


def test_token_of_a_part_that_no_text_is_encoded_to():
    """baa is never made (aa comes first), so neither is bbaa."""
    spelled = [b"a", b"b", b"aa", b"ba", b"ab", b"baa", b"bbaa"]
    words, merges = {s: i for i, s in enumerate(spelled)}, [(b"a", b"a"), (b"b", b"a"), (b"a", b"b"), (b"ba", b"a"), (b"b", b"baa")]
    for raw in (b"bbaa", b"bbaaa", b"baa"):
        assert PrefixBpe(words, merges).encode(raw) == slow_bpe(raw, words, merges)
