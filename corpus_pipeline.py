"""The cleaning pipeline over ``documents``: each stage works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelspark.llm.exact_dedup import drop_exact_duplicates
from panelspark.llm.near_dedup import drop_near_duplicates
from panelspark.llm.packing import pack_documents
from panelspark.llm.shared import materialise, table
from panelspark.llm.suffix_repeats import drop_repeats
from panelspark.llm.toxicity import drop_toxic, fit_toxicity


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that score 0.5 or more; the model learns from ``labels``."""
    return drop_toxic(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id."""
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of five-word shingles and similarity 0.8 connect, the smallest doc_id."""
    return drop_near_duplicates(docs, words=5, percent=80)


def suffix_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages of 200 bytes or more that repeat."""
    return drop_repeats(docs, threshold=200)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens."""
    return pack_documents(docs, "word_bpe_49k.json", end_id=1, capacity=2048)


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("suffix_repeats", suffix_repeats),
    ("packing", packing),
]

#: A fitted model decides in the first stage, which SQL can't express; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents that the stages keep.

    A null text counts as an empty one, in every stage; empty documents are equal texts, so one of them stays,
    with a piece of the end id alone. A row without an id is a document like any other, but linked with no near
    duplicate. Rows that repeat are exact duplicates; an id with two texts is two documents up to
    near dedup, where one that links drop takes the other along. Other columns stay up to the last
    stage and clash with nothing. An empty table gives no pieces.
    """
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs, f"pipeline-{name}")
    return docs
