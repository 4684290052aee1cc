"""Quality rules: counts of words, symbols and repetition, and lines that many documents share.

Per document, in expressions only: words, their characters, symbols, repeated lines, and words in
8-word windows that occur twice. Across documents: each normalised line is hashed and its documents are
counted per host; lines above the limit count as removed; a document that loses too large a part
of its words is rejected as depleted.

Defined results: null and empty texts have no words and fail the base rules. A row is a document, so
repeated rows count as often as they occur; a null host is a host of its own. A document that
repeats a line counts once for it. Extra columns are ignored. Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabletrust.llm.line_dedup import line_key
from tabletrust.llm.text import BLANK_RUN, ascii_lower, lines_of, text_mark
from tabletrust.operators.skew import join_by_key
from tabletrust.session import materialize

WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED = 30
#: A line in more documents of one host than this counts as removed.
MOST_DOCUMENTS = 10
#: A document that loses more than this percentage of its words is depleted.
MOST_REMOVED = 50


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANK_RUN), lambda w: w != "")


def base_counts(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """d (doc_id), m (text mark), host, and the counts of each row."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.col("doc_id").alias("d"), text_mark(F.col("text")).alias("m"),
        F.col("source").alias("host"), text.alias("text"),
    )
    hashed = rows.select(
        "d", "m", "host",
        F.char_length(F.regexp_replace("text", BLANK_RUN, "")).cast("bigint").alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
        F.filter(lines_of(F.col("text")), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
        .alias("lines"),
        F.transform(words_of(F.col("text")), lambda w: F.xxhash64(w)).alias("words"),
    )
    windowed = hashed.select(
        "d", "m", "host", "word_chars", "n_symbols",
        F.size("words").cast("bigint").alias("n_words"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.when(
            F.size("words") > window,
            F.transform(
                F.sequence(F.lit(1), F.size("words") - (window - 1)),
                lambda i: F.xxhash64(F.slice("words", i, window)),
            ),
        ).otherwise(F.array().cast("array<bigint>")).alias("windows"),
    )
    twice = F.size(F.array_distinct("windows")) < F.size("windows")
    sortable = F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    placed = windowed.withColumn("placed", F.when(twice, F.array_sort(sortable))).drop("windows")
    same = lambda x, i: F.coalesce(F.get("placed", i)["h"] == x["h"], F.lit(False))
    starts = placed.withColumn(
        "starts",
        F.sort_array(
            F.transform(
                F.filter("placed", lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["i"]
            )
        ),
    ).drop("placed")
    steps = F.transform(
        "starts", lambda p, i: F.least(F.coalesce(F.get("starts", i + 1) - p, F.lit(window)), F.lit(window))
    )
    repeated = F.coalesce(F.aggregate(steps, F.lit(0), lambda n, x: n + x), F.lit(0))
    return starts.withColumn("n_repeat_words", repeated.cast("bigint")).drop("starts")


def host_lines(docs: DataFrame) -> DataFrame:
    """(d, m, host, h, w, first): normalised lines of each row, hashed with their host, and their words.

    Equal lines of one row are sorted together inside the row; `first` marks one of them.
    """
    line = lambda x: F.struct(F.xxhash64("host", x).alias("h"), F.size(words_of(x)).alias("w"))
    lines = F.transform(lines_of(ascii_lower(F.col("text"))), lambda x: line_key(x))
    rows = docs.select(
        F.col("doc_id").alias("d"), text_mark(F.col("text")).alias("m"),
        F.col("source").alias("host"), F.filter(lines, lambda x: x != "").alias("lines"),
    )
    in_order = F.sort_array(F.transform("lines", line)).alias("lines")
    sorted_lines = rows.select("d", "m", "host", in_order)
    return sorted_lines.select(
        "d", "m", "host",
        F.inline(
            F.transform(
                "lines",
                lambda x, i: F.struct(
                    x["h"].alias("h"), x["w"].alias("w"),
                    (~F.coalesce(F.get("lines", i - 1)["h"] == x["h"], F.lit(False))).alias("first"),
                ),
            )
        ),
    )


def removed_words(docs: DataFrame, most_documents: int = MOST_DOCUMENTS) -> DataFrame:
    """(d, m, host, n_removed): words of each row in lines that too many documents of its host have.

    Documents per line are counted with partial sums, and lines of very many documents meet their
    rows where they are, so no line's rows all go to one task. Rows that repeat whole under one host,
    of which each has one `first` line per hash, share one result.
    """
    lines = materialize(host_lines(docs), "host-lines")
    often = (
        lines.where("first").groupBy("h").agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > most_documents).select("h")
    )
    often = materialize(often, "frequent-lines")
    return (
        join_by_key(lines, often, "h")
        .groupBy("d", "m", "host", "h")
        .agg((F.sum("w") / F.sum(F.col("first").cast("int"))).alias("w"))
        .groupBy("d", "m", "host")
        .agg(F.sum("w").cast("bigint").alias("n_removed"))
    )


def judge(
    docs: DataFrame, most_documents: int = MOST_DOCUMENTS, most_removed: int = MOST_REMOVED
) -> DataFrame:
    """doc_id, the base counts, n_removed, base_failed and kept, of every row."""
    base = base_counts(docs)
    removed = removed_words(docs, most_documents)
    failed = (F.col("n_words") < LEAST_WORDS) | (
        F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED
    )
    joined = base.join(
        removed.toDF("rd", "rm", "rh", "n_removed"),
        F.col("d").eqNullSafe(F.col("rd")) & (F.col("m") == F.col("rm"))
        & F.col("host").eqNullSafe(F.col("rh")), "left",
    )
    n_removed = F.coalesce("n_removed", F.lit(0))
    return joined.select(
        F.col("d").cast("bigint").alias("doc_id"), "n_words", "word_chars", "n_symbols",
        "n_dup_lines", "n_repeat_words", n_removed.cast("bigint").alias("n_removed"),
        failed.alias("base_failed"),
        (~failed & (n_removed * 100 <= F.col("n_words") * most_removed)).alias("kept"),
    )
