"""Training corpus from documents: language, near duplicates, personal data, mix of sources, packed sequences.

Each stage is a function of (spark, docs, sf_dir) over all that its predecessor kept; the results between stages are
Parquet tables in the folder that all executors share.

For every stage: whole texts are read, however long; an empty table gives an empty one; columns beyond those of documents stay
as they are, whatever their names; a null doc_id is a document like others. Null and empty texts, ties and repeated rows are
said with each stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netprism.llm import language, mixing, packing, pii, shingles
from netprism.llm.common import reach, word_count, written


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a language learned from the labelled rows; rejected ones (no letters, or like none) go.

    Null and empty texts have no letter and go; ties between languages take the first by name; repeated rows share a decision.
    """
    reach(spark)
    return language.kept(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates: the one of the smallest doc_id.

    Documents are linked where their SimHash fingerprints differ by 2 bits or less (as in `op2`, all pairs), and where their
    five-word shingles have an exact Jaccard similarity of 0.8 or more: near copies of few words differ by more bits. Null, empty and blank
    texts are copies of each other; of rows that repeat the smallest doc_id one stays; a row without doc_id stays only where no
    row of its group has one.
    """
    reach(spark)
    return shingles.one_each(docs, prints=True)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind; all documents stay, repeated rows change alike, null and empty texts stay so."""
    reach(spark)
    return pii.masked(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes documents as often as the mix asks for, shuffled within shards.

    Sources are told apart by name, null last; rows of equal doc_id and text are taken alike; texts without words go with their block.
    """
    reach(spark)
    return mixing.mixed(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each part of each document is put; texts without words have no part, repeated rows have parts of their own."""
    reach(spark)
    return packing.pack(docs, "doc_id", word_count(F.col("text")))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", known_language),
    ("near_duplicates", one_of_each_group),
    ("personal_data", without_personal_data),
    ("mixing", mixed_sources),
    ("packing", packed_sequences),
]

#: Language models, components and random mixes can't be said in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs)
    return docs
