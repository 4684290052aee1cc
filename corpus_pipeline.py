"""A corpus pipeline: quality, repeated lines, near duplicates, decontamination, token ids.

Each stage reads what the one before it kept, written as Parquet in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabletrust.llm import decontaminate, line_crf, line_dedup, ngram_join, pieces
from tabletrust.llm.text import table
from tabletrust.session import materialize


def quality(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the line model, fitted on the labelled ones, calls good."""
    model = line_crf.fit(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return line_crf.good_documents(docs, model)


def repeated_lines(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Lines found in ten documents or more stay in the first of them only."""
    return line_dedup.drop_lines(docs, keep_first=True)


def near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each component of near copies: the one with the smallest id."""
    return ngram_join.one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Benchmark passages cut out; documents that are mostly benchmark go."""
    return decontaminate.remove_spans(docs, table(spark, folder, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Token ids of every document left, with parity and round trip checked."""
    coded = pieces.encode(docs)
    return coded.select("doc_id", "n_ids", "ids", "parity", "round_trip")


STAGES = [
    ("quality", quality),
    ("line_dedup", repeated_lines),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminated),
    ("tokens", tokens),
]

#: The line model has no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, folder), f"pipeline-{name}")
    return docs


__all__ = ["ORACLE_SQL", "STAGES", "run"]
