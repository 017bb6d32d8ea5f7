"""The registered corpus queries on the small tables: SQL twins, shapes, and the pipeline by brute force."""

import collections
import re

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from conftest import ROOT  # noqa: F401  (puts the repository on the path)
from oracle_check import compare, duck
from rosterlens.llm.oracles import ORACLES
from rosterlens.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


def test_all_are_registered():
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())
    assert sorted(int(re.match(r"op(\d+)_", q)[1]) for q in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_sql_twins(spark, key):
    ok, said = compare(spark, duck(SMALL), SMALL, key, QUERIES[key], ORACLES[key])
    assert ok, said


def test_pipeline_stages(spark, tmp_path):
    from rosterlens.llm import toxicity
    from test_corpus_operators import brute_base, brute_classes

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, before, SMALL).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        was = {r.doc_id: r.text for r in before.collect()}
        now = {r.doc_id: r for r in after.collect()}
        if name == "toxicity":
            model = toxicity.fit(before, spark.read.parquet(f"{SMALL}/labels.parquet"))
            assert set(now) == {r.doc_id for r in toxicity.score(before, model).where("score < 0.5").collect()}
        elif name == "near copies":
            ids = sorted(was)
            want = {ids[i] for i, (_, c) in brute_classes([was[d] for d in ids]).items() if i == c}
            assert set(now) == want and len(want) < len(was)
        elif name == "decontamination":
            word = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
            items = [word(r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
            windows = {tuple(w[i : i + 10]) for w in items for i in range(max(1, len(w) - 9)) if w}
            sizes = {len(w) for w in windows}
            dirty = {d for d, t in was.items() if any(tuple(w[i : i + n]) in windows for w in [word(t)] for n in sizes for i in range(len(w) - n + 1))}
            assert set(now) == set(was) - dirty
        elif name == "secrets":
            assert set(now) == set(was)
            for d, r in now.items():
                assert not brute_base(r.text) or brute_base(was[d])
                assert all(was[d][a:b] not in r.text or len(was[d][a:b]) < 9 for _, a, b in brute_base(was[d]))
                assert r.n_chars == len(r.text)
        else:
            assert {r.doc_id for r in after.select("doc_id").collect()} == set(was)
            fill = collections.Counter()
            for r in after.collect():
                fill[r.sequence_id] += r.length
            assert max(fill.values()) <= 2048 and len(fill) <= 1.03 * sum(fill.values()) / 2048 + 1
            break
        assert after.columns == columns
        before = after
    assert corpus_pipeline.run(spark, SMALL).select("doc_id").distinct().count() == len(was)
