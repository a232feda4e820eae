"""A corpus from raw documents in five stages, each a table that the next one reads.

All stages: null ids are documents each, repeated rows are documents of their own until near_duplicates leaves one of
them, an empty table gives an empty one, whole texts count however long, and further columns keep their names and values,
whatever these are called. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphrec.llm import jaccard, langid, line_dedup, mixing, packing
from graphrec.llm.queries import vocabulary_path
from graphrec.llm.shared import table, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or without a language of half their words, go; so do null and empty texts."""
    return langid.confident(docs)


def line_frequency(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on too many pages of their source go (null is a source); no document goes. n_chars is counted anew."""
    cleaned = line_dedup.drop_boilerplate(docs)
    return line_dedup.recounted(cleaned)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: that with the smallest id, on ties any one of the rows under it.

    Documents without an id or a word stay.
    """
    return jaccard.one_of_each(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents, whole or in part, as often as the mix takes them, a row each time; null and wordless texts go."""
    return mixing.mixed_documents(docs)


def packing_plan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences of 1024: rows of packing.packed_documents."""
    return packing.packed_documents(docs, vocabulary_path())


STAGES = [
    ("language_id", language_id),
    ("line_frequency", line_frequency),
    ("near_duplicates", near_duplicates),
    ("source_mix", source_mix),
    ("packing", packing_plan),
]

#: Language ID and packing cannot be put in SQL; tests hold run() against a brute-force version of every stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces that all stages leave of the documents table of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
