"""Cleaning and packing of a corpus: toxic documents, exact copies, near copies and benchmark leaks go; what is left is packed.

Each stage takes what the one before kept and returns the columns of ``documents``; the last returns packed pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracewright.llm import decontaminate, exact, jaccard, packing, toxicity
from tracewright.llm.common import materialise
from tracewright.llm.registry import table, vocabulary


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the machine trained on ``labels`` predicts toxic go; rows with a null or empty text are clean."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def remove_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows with equal normalised texts the one with the smallest doc_id stays; see ``exact.exact_groups`` for null ids."""
    return exact.drop_copies(docs)


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies (five words, 0.8) the rows of the smallest doc_id stay; rows without words all stay."""
    return jaccard.drop_similar(docs, n=5, threshold=0.8)


def remove_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a benchmark item with at most a sixteenth of its characters edited go."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of what is left, placed in sequences of 1,024 tokens; an empty table has no rows."""
    return packing.pack(docs, vocabulary(), end_id=2, capacity=1024)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", remove_toxic),
    ("exact_dedup", remove_copies),
    ("ngram_jaccard", remove_near_copies),
    ("decontamination", remove_leaks),
    ("packing", pack_sequences),
]

#: Toxicity is learnt and packing searched for; SQL has neither.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
