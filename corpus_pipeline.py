"""The corpus pipeline: five stages over ``documents``, each one operator of rosterlens.llm.

A stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next stage's ``docs``. All but the last return
the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlens.llm import toxicity
from rosterlens.llm.common import stored, table
from rosterlens.llm.packing import pack
from rosterlens.llm.parity_join import one_of_each
from rosterlens.llm.phrase_index import phrase_matches
from rosterlens.llm.secrets import redact_secrets
from rosterlens.llm.tokens import vocabulary


def _aside(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` under names that no operator adds, and those names."""
    names = {c: f"kept_{i}" for i, c in enumerate(docs.columns)}
    return docs.select(*[F.col(f"`{c}`").alias(kept) for c, kept in names.items()]), names


def _back(docs: DataFrame, names: dict[str, str]) -> DataFrame:
    return docs.select(*[F.col(kept).alias(c) for c, kept in names.items()])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.5 or more go; all columns stay as they are."""
    model = toxicity.fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    renamed, names = _aside(docs)
    return _back(toxicity.score(renamed, model, text=names["text"]).where("score < 0.5"), names)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays."""
    return one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with any ten-word phrase of the benchmark go; all columns stay as they are."""
    renamed, names = _aside(docs)
    named = renamed.withColumnsRenamed({names["doc_id"]: "doc_id", names["text"]: "text"})
    clean = phrase_matches(named, table(spark, sf_dir, "benchmark")).where("size(hits) = 0")
    return _back(clean.withColumnsRenamed({"doc_id": names["doc_id"], "text": names["text"]}), names)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret is replaced by its kind; all documents stay."""
    return redact_secrets(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens."""
    return pack(docs.select("doc_id", "text"), vocabulary())


STAGES = [
    ("toxicity", drop_toxic),
    ("near copies", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("secrets", redact),
    ("packing", pack_tokens),
]

#: SQL cannot express the classifier and the packing; tests compare with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
