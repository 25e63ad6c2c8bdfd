"""A training-text pipeline: stages that each apply one operator to what the stage before it kept.

Each function takes (spark, docs, sf_dir) and returns a DataFrame, written as Parquet and read again as the next one's
docs. All but the last return the columns of `documents`. Null ids, null texts, repeated rows and empty tables are handled
as the operators state it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cadenza.llm import decontaminate, language, sentencepieces
from cadenza.llm.exact_dedup import one_per_text
from cadenza.llm.jaccard_join import one_per_group
from cadenza.llm.queries import pieces_path
from cadenza.llm.shared import staged, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: no text to tell it by, or none more likely than not."""
    return language.accepted(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    return one_per_text(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return one_per_group(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of what is left, and their decoding, as digests."""
    return sentencepieces.digests(docs, pieces_path())


STAGES = [
    ("language ID", language_id),
    ("exact dedup", exact_dedup),
    ("n-gram Jaccard join", jaccard_join),
    ("benchmark decontamination", decontamination),
    ("SentencePiece encoding and decoding", sentencepiece),
]

#: The fitted language table and the piece merges have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = staged(docs, "stage")
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
