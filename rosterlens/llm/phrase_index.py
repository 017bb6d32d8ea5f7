"""Benchmark decontamination by a distributed positional inverted index.

``build_index`` stores the postings (document, place, term) of the training
texts for every term that a test item uses; no other term can be looked up.
``phrase_matches`` intersects, per test window, offset-adjusted lists: the
window's rarest term in the corpus proposes starts, the next rarest terms
confirm them, and the words themselves decide. ``proximity_matches`` relaxes
the places by a slop.

Only built-in functions are used. Test windows come from the benchmark; they
are broadcast only while they have at most ``MAX_BROADCAST`` rows, else the
joins shuffle. Documents are keyed by two hashes of (id, text), so repeated
ids, null ids and repeated rows all work: every row gets its own text's result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterlens.llm.common import Scratch, release_shuffles, stored
from rosterlens.operators.joins import broadcast_if_small

NOT_IN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MAX_BROADCAST = 200_000
LISTS = 3                     # rarest terms whose lists are intersected before the words are compared


def words(text: Column) -> Column:
    """Words of a text, A-Z lowered; none for a null text."""
    text = F.coalesce(text, F.lit(""))
    # lower() folds A-Z only where all is ASCII; translate() does so everywhere, slower
    folded = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(folded, NOT_IN_WORDS), "")


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    k, t = F.col(f"`{key}`"), F.col(f"`{text}`")
    return docs.withColumns({"__a": F.xxhash64(k), "__b": F.xxhash64(t, k)})


def test_windows(items: DataFrame, key: str, text: str, length: int) -> DataFrame:
    """Distinct windows of the test items: ``wid``, ``w`` (words), ``items`` (ids as strings)."""
    w = items.select(F.col(f"`{key}`").cast("string").alias("item"), words(F.col(f"`{text}`")).alias("ws")).where("size(ws) > 0")
    last = F.greatest(F.size("ws") - length + 1, F.lit(1))
    cut = w.select("item", F.explode(F.transform(F.sequence(F.lit(1), last), lambda i: F.slice("ws", i, length))).alias("w"))
    return cut.groupBy("w").agg(F.collect_set("item").alias("items")).withColumn("wid", F.xxhash64("w"))


def build_index(docs: DataFrame, windows: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Stored postings ``__a, __b, pos, term`` of every test term in every whole text."""
    terms = windows.select(F.explode("w").alias("word")).distinct().select(F.xxhash64("word").alias("term"))
    every = _keyed(docs, key, text).select("__a", "__b", F.posexplode(words(F.col(f"`{text}`"))).alias("pos", "word"))
    postings = every.select("__a", "__b", "pos", F.xxhash64("word").alias("term"))
    return stored(postings.join(broadcast_if_small(terms, MAX_BROADCAST), "term"), "postings")


def _rarest_terms(index: DataFrame, windows: DataFrame, lists: int) -> DataFrame:
    """Per window its ``lists`` rarest (term, offset), rarest first; windows with an absent term go."""
    frequency = index.groupBy("term").agg(F.count(F.lit(1)).alias("tf"))
    at = windows.select("wid", F.size("w").alias("n"), F.posexplode("w").alias("off", "word")).select(
        "wid", "n", "off", F.xxhash64("word").alias("term")
    )
    by_rarity = Window.partitionBy("wid").orderBy("tf", "off")
    whole = Window.partitionBy("wid")
    ranked = at.join(frequency, "term").withColumns(
        {"rank": F.row_number().over(by_rarity), "present": F.count(F.lit(1)).over(whole)}
    )
    return stored(ranked.where(f"rank <= {lists} and present = n").select("wid", "rank", "off", "term"), "rarest")


def _candidates(index: DataFrame, rarest: DataFrame, lists: int, slop: int = 0) -> DataFrame:
    """Starts (``__a, __b, wid, start``) at which the offset-adjusted lists of a window meet."""
    first = rarest.where("rank = 1").select("wid", "off", "term")
    found = index.join(broadcast_if_small(first, MAX_BROADCAST), "term").select(
        "__a", "__b", "wid", (F.col("pos") - F.col("off")).alias("start")
    )
    for rank in range(2, lists + 1):
        # windows shorter than this many words have no such list and pass
        step = rarest.where(f"rank = {rank}").select("wid", F.col("off").alias("o"), "term")
        here = found.join(broadcast_if_small(step, MAX_BROADCAST), "wid", "left")
        used = broadcast_if_small(step.select("term").distinct(), MAX_BROADCAST)
        other = index.join(used, "term", "left_semi").withColumnRenamed("pos", "p")
        if slop:
            met = here.where("term is not null").join(other, ["__a", "__b", "term"]).where(
                F.abs(F.col("p") - F.col("start") - F.col("o")) <= slop
            )
        else:
            met = here.where("term is not null").withColumn("p", F.col("start") + F.col("o")).join(
                other, ["__a", "__b", "term", "p"]
            )
        found = met.select("__a", "__b", "wid", "start").unionAll(
            here.where("term is null").select("__a", "__b", "wid", "start")
        )
    return found.distinct()


def phrase_matches(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text",
    item_key: str = "item_id", item_text: str = "text", length: int = 10,
) -> DataFrame:
    """``docs`` plus ``n_words`` (long), ``hits`` (array of start, n, items) of exact test phrases.

    A phrase is ``length`` consecutive item words (a shorter item is one
    phrase); every occurrence in every whole text is listed once. A null or
    empty text has no words and no hits; an empty benchmark hits nothing.
    Columns of ``docs`` named like the new ones are replaced.
    """
    spark = docs.sparkSession
    with Scratch() as scratch:
        # what a step has broadcast or shuffled goes before the next one
        windows = stored(test_windows(items, item_key, item_text, length), "windows")
        release_shuffles(spark)
        index = build_index(docs, windows, key, text)
        release_shuffles(spark)
        rarest = _rarest_terms(index, windows, LISTS)
        release_shuffles(spark)
        starts = _candidates(index, rarest, LISTS).where("start >= 0")
        told = starts.join(broadcast_if_small(windows, MAX_BROADCAST), "wid")
        per_text = told.groupBy("__a", "__b").agg(F.collect_list(F.struct("start", "w", "items")).alias("__c"))
        per_text = scratch.keep(stored(per_text, "candidates"))
        del starts, told
    release_shuffles(spark)
    joined = _keyed(docs.drop("n_words", "hits"), key, text).join(per_text, ["__a", "__b"], "left")
    joined = joined.withColumn("__w", words(F.col(f"`{text}`")))
    exact = F.filter(
        F.coalesce(F.col("__c"), F.array().cast(per_text.schema["__c"].dataType)),
        lambda c: F.slice("__w", c["start"] + 1, F.size(c["w"])) == c["w"],
    )
    hits = F.transform(exact, lambda c: F.struct(c["start"], F.size(c["w"]).alias("n"), c["items"]))
    return joined.withColumns({"n_words": F.size("__w").cast("long"), "hits": hits}).drop("__a", "__b", "__c", "__w")


def hit_words(hits: Column) -> Column:
    """Number of words inside any hit."""
    covered = F.transform(hits, lambda h: F.sequence(h["start"], h["start"] + h["n"] - 1))
    return F.size(F.array_distinct(F.flatten(covered))).cast("long")


def hit_items(hits: Column) -> Column:
    """Sorted distinct item ids (strings) with a hit."""
    return F.array_sort(F.array_distinct(F.flatten(F.transform(hits, lambda h: h["items"]))))


def proximity_matches(
    docs: DataFrame, items: DataFrame, slop: int, key: str = "doc_id", text: str = "text",
    item_key: str = "item_id", item_text: str = "text", length: int = 10, lists: int = LISTS,
) -> DataFrame:
    """Near phrases: (key, ``item``, ``start``) where the window's ``lists`` rarest terms lie
    within ``slop`` words of their places. Finds edited copies that no exact phrase shows."""
    windows = stored(test_windows(items, item_key, item_text, length), "windows")
    index = build_index(docs, windows, key, text)
    starts = _candidates(index, _rarest_terms(index, windows, lists), lists, slop).where("start >= 0")
    named = starts.join(windows.select("wid", F.explode("items").alias("item")), "wid")
    ids = _keyed(docs, key, text).select("__a", "__b", F.col(f"`{key}`")).distinct()
    return named.join(ids, ["__a", "__b"]).select(f"`{key}`", "item", "start").distinct()
