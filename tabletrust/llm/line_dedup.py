"""Line dedup: range-partitioned line hashes, sorted by document and position, and keep bitmaps.

A line's key is the line without ASCII white space at both ends, A-Z lower-cased. Only 128 bits of
hash, the document and the position of each line travel. Hashes are dealt out by range and sorted by
(hash, document, position) within a range, so one pass over a range sees each key's first occurrence
and counts its documents. What comes back per document is a bitmap in 64-line words that holds only
the words with a dropped line. Keys with very many lines never meet in a range: a streaming sketch
names them, and they are reduced inside the tasks before anything moves.

Defined results: null or empty text is one empty line. Empty keys are never dropped. Rows with the
same doc_id and the same text are one document; rows with one doc_id and different texts are two.
Equal positions cannot occur; documents with equal ids are ordered by the hash of their text. A null
doc_id sorts first and is an id of its own. Extra columns are kept by `drop_lines`, whatever their
names. Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabletrust.llm.text import BLANKS, ascii_lower, lines_of, text_mark
from tabletrust.session import materialize

MIN_DOCUMENTS = 10
#: A key is reduced before the shuffle if the sketch gives it more than this share of all lines.
HOT_SHARE = 1 / 2000
_SKETCHED = 1000


def line_key(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANKS))


def hashed_lines(docs: DataFrame) -> DataFrame:
    """(d, m, pos, h, g): document, text mark, position and 128 bits of hash of each line with a key."""
    rows = docs.select(
        F.col("doc_id").alias("d"), text_mark(F.col("text")).alias("m"),
        F.posexplode(lines_of(ascii_lower(F.col("text")))).alias("pos", "line"),
    )
    key = line_key(F.col("line"))
    return rows.where(key != "").select(
        "d", "m", "pos", F.xxhash64(key).alias("h"), F.xxhash64(F.lit(1), key).alias("g")
    )


def hot_hashes(lines: DataFrame, share: float = HOT_SHARE) -> DataFrame:
    """At most a thousand hashes that may hold more than `share` of the lines.

    The sketch is only used to plan: a key it names or misses gets the same result either way.
    """
    found = lines.agg(
        F.expr(f"approx_top_k(h, {_SKETCHED}, {10 * _SKETCHED})").alias("top"),
        F.count(F.lit(1)).alias("n"),
    )
    return found.select("n", F.inline("top").alias("h", "count")).where(
        F.col("count") > F.greatest(F.col("n") * share, F.lit(1000))
    ).select("h")


def drop_bitmaps(
    docs: DataFrame, min_documents: int = MIN_DOCUMENTS, keep_first: bool = False
) -> DataFrame:
    """(d, m, words): for documents that lose lines, the 64-line words with their dropped bits.

    A key found in at least `min_documents` documents loses all its lines, or all but its first
    occurrence by (document, position) with `keep_first`.
    """
    lines = materialize(hashed_lines(docs), "line-hashes")
    hot = materialize(hot_hashes(lines), "hot-lines")
    by_key = Window.partitionBy("h", "g")
    in_order = by_key.orderBy("d", "m", "pos")
    doc = F.struct("d", "m")
    cold = (
        lines.join(F.broadcast(hot), "h", "left_anti")
        .repartitionByRange("h")
        .sortWithinPartitions("h", "g", "d", "m", "pos")
        .withColumn("new", (~F.lag(doc).over(in_order).eqNullSafe(doc)).cast("int"))
        .withColumn("first", F.row_number().over(in_order) == 1)
        .withColumn("n_docs", F.sum("new").over(by_key))
        .select("d", "m", "pos", "first", "n_docs")
    )
    hot_lines = lines.join(F.broadcast(hot), "h", "left_semi")
    decided = (
        hot_lines.groupBy("h", "g", "d", "m").agg(F.min("pos").alias("pos"))
        .groupBy("h", "g")
        .agg(F.count(F.lit(1)).alias("n_docs"), F.min(F.struct("d", "m", "pos")).alias("start"))
    )
    warm = hot_lines.join(F.broadcast(decided), ["h", "g"]).select(
        "d", "m", "pos", F.struct("d", "m", "pos").eqNullSafe(F.col("start")).alias("first"),
        "n_docs",
    )
    dropped = cold.unionByName(warm).where(F.col("n_docs") >= min_documents)
    if keep_first:
        dropped = dropped.where(~F.col("first"))
    bit = F.expr("shiftleft(1L, pos % 64)")
    return (
        dropped.repartition("d", "m")
        .groupBy("d", "m", F.expr("pos div 64").cast("int").alias("word"))
        .agg(F.bit_or(bit).alias("bits"))
        .groupBy("d", "m")
        .agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("words"))
    )


def with_kept(
    docs: DataFrame, min_documents: int = MIN_DOCUMENTS, keep_first: bool = False
) -> DataFrame:
    """(doc, n_lines, n_dropped, kept): the input row as a struct, and its text without dropped lines."""
    bitmaps = drop_bitmaps(docs, min_documents, keep_first)
    rows = docs.select(
        F.struct("*").alias("doc"), F.col("doc_id").alias("d"), text_mark(F.col("text")).alias("m")
    )
    b = bitmaps.select(F.col("d").alias("bd"), F.col("m").alias("bm"), "words")
    joined = rows.join(
        b.hint("shuffle_hash"), rows["d"].eqNullSafe(b["bd"]) & (rows["m"] == b["bm"]), "left"
    )
    known = F.map_from_entries("words")
    dense = F.transform(
        F.sequence(F.lit(0), F.element_at("words", -1)["word"]),
        lambda w: F.coalesce(F.try_element_at(known, w), F.lit(0).cast("bigint")),
    )
    text = F.coalesce(F.col("doc.text"), F.lit(""))
    stay = joined.withColumn("dense", F.when(F.col("words").isNotNull(), dense)).withColumn(
        "stay",
        F.when(
            F.col("words").isNotNull(),
            F.filter(
                lines_of(text),
                lambda line, i: F.coalesce(
                    F.getbit(F.get("dense", F.floor(i / 64).cast("int")), i % 64), F.lit(0)
                )
                == 0,
            ),
        ),
    )
    n_lines = (F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))) + 1
    n_dropped = F.aggregate(
        F.coalesce("dense", F.array().cast("array<bigint>")),
        F.lit(0),
        lambda n, bits: n + F.bit_count(bits),
    )
    return stay.select(
        "doc", n_lines.cast("bigint").alias("n_lines"), n_dropped.cast("bigint").alias("n_dropped"),
        F.when(F.col("words").isNull(), text).otherwise(F.array_join("stay", "\n")).alias("kept"),
    )


def drop_lines(
    docs: DataFrame, min_documents: int = MIN_DOCUMENTS, keep_first: bool = True
) -> DataFrame:
    """`docs` with repeated lines removed from `text`, and without rows that lost every line.

    Keeps all columns and brings `n_chars` up to date where there is one.
    """
    done = with_kept(docs, min_documents, keep_first)
    empty = (F.col("n_dropped") > 0) & (F.btrim("kept", F.lit(BLANKS)) == "")
    done = done.where(~empty)
    new = {"text": F.when(F.col("n_dropped") == 0, F.col("doc.text")).otherwise(F.col("kept"))}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        new["n_chars"] = F.when(F.col("n_dropped") == 0, F.col("doc.n_chars")).otherwise(
            F.char_length("kept").cast(kind)
        )
    return done.select(*(new.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns))
