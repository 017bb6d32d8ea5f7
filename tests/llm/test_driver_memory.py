"""What the driver has freed goes back to the system, and what a step has broadcast goes before the next one."""

from __future__ import annotations

from pathlib import Path

import pytest

from rosterlens.llm import phrase_index
from rosterlens.llm.common import give_back_driver_memory, release_shuffles


def test_freed_memory_of_the_driver_is_given_back(spark):
    jvm = spark.sparkContext._jvm
    statm = Path(f"/proc/{jvm.java.lang.ProcessHandle.current().pid()}/statm")
    if not statm.exists():
        pytest.skip("memory can't be read here")
    held = lambda: int(statm.read_text().split()[1]) * 4096 / 1e6
    release_shuffles(spark)                                          # what the first job takes is not counted
    packers = [jvm.java.util.zip.Deflater() for _ in range(1500)]    # their memory is outside the heap
    for _ in range(4):
        jvm.System.gc()
    for i, packer in enumerate(packers):
        if i % 20:                                                   # some stay, so that no arena is free to its end
            packer.end()
    before = held()
    give_back_driver_memory(spark)                                   # part of release_shuffles, without its collection
    after = held()
    for packer in packers:
        packer.end()
    assert before - after > 25


def test_phrase_matches_releases_each_step(spark, monkeypatch):
    steps = []
    stored, released = phrase_index.stored, release_shuffles
    monkeypatch.setattr(phrase_index, "stored", lambda df, tag: steps.append(tag) or stored(df, tag))
    monkeypatch.setattr(phrase_index, "release_shuffles", lambda s: steps.append("released") or released(s), raising=False)
    words = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(i, f"x{i} {words} y{i}") for i in range(6)] + [(7, None)], "doc_id long, text string")
    items = spark.createDataFrame([("a", words)], "item_id string, text string")
    found = phrase_index.phrase_matches(docs, items)
    assert found.where("size(hits) = 31").count() == 6
    kept = [x for x in steps if x != "released"]
    assert kept and steps == [y for x in kept for y in (x, "released")]
