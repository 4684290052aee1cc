"""The queries opN_<name>, each over its whole table, and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabletrust.llm import (
    chat_repair,
    decontaminate,
    hard_negatives,
    line_crf,
    line_dedup,
    line_rules,
    link_trust,
    ngram_join,
    pieces,
    simhash_trees,
    suffix_dedup,
    token_counts,
    tool_calls,
)
from tabletrust.llm import sql as texts
from tabletrust.llm.text import table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql.strip()
        return run

    return add


@query("op1_suffix_dedup", texts.SUFFIX_DEDUP)
def op1(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes of each document in 50-byte strings that an earlier document has."""
    return suffix_dedup.report(table(spark, folder, "documents"))


@query("op2_decontaminate", texts.DECONTAMINATE)
def op2(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark windows found in each document."""
    return decontaminate.report(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op3_url_trust")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    """Rules, and trust over host edges, for each page."""
    return link_trust.verdicts(table(spark, folder, "pages"))


@query("op4_tool_calls", texts.TOOL_CALLS)
def op4(spark: SparkSession, folder: str) -> DataFrame:
    """Calls and results read from the chat turns, linked, ordered, checked and serialised."""
    calls, results = tool_calls.calls_of_turns(table(spark, folder, "conversations"))
    return tool_calls.formatted(calls, results, tool_calls.CHAT_TOOLS)


@query("op5_pieces")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of each text as a digest, with parity and round trip."""
    coded = pieces.encode(table(spark, folder, "documents"))
    digest = F.sha2(F.array_join("ids", ","), 256)
    return coded.select(
        "doc_id", "n_ids", "n_bytes", digest.alias("ids_sha256"), "round_trip", "parity"
    )


@query("op6_line_rules", texts.LINE_RULES)
def op6(spark: SparkSession, folder: str) -> DataFrame:
    """Base counts of each document, and the verdict on lines its source has too often."""
    return line_rules.judge(table(spark, folder, "documents"))


@query("op7_token_counts")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    """Unigram tokens of each document."""
    return token_counts.token_counts(table(spark, folder, "documents"))


@query("op8_line_dedup", texts.LINE_DEDUP)
def op8(spark: SparkSession, folder: str) -> DataFrame:
    """Lines that ten documents share, dropped everywhere."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return line_dedup.with_kept(docs).select(
        F.col("doc.doc_id").alias("doc_id"), "n_lines", "n_dropped",
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query("op9_ngram_join", texts.NGRAM_JOIN)
def op9(spark: SparkSession, folder: str) -> DataFrame:
    """Component of each document under links of shingle sets."""
    return ngram_join.document_components(table(spark, folder, "documents"))


@query("op10_quality")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    """Quality score of each document by a model that never saw the held-out fold's labels."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = line_crf.fit(docs, table(spark, folder, "labels"))
    return line_crf.score(docs, model).select(
        F.col("doc.doc_id").alias("doc_id"),
        F.coalesce(line_crf.held_out(F.col("doc.doc_id")), F.lit(False)).alias("held_out"),
        "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


@query("op11_hard_negatives", texts.HARD_NEGATIVES)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    """The first negatives in the window of each anchor's first positives."""
    return hard_negatives.mine(table(spark, folder, "embeddings"))


@query("op12_simhash_trees")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint of each document, and its component under near fingerprints."""
    return simhash_trees.document_components(table(spark, folder, "documents"))


@query("op13_chat_repair", texts.CHAT_REPAIR)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    """Faults of each damaged conversation, and the digest of its cheapest repair."""
    return chat_repair.report(table(spark, folder, "conversations"))
