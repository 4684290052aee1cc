"""N-gram Jaccard join: globally ordered 5-word shingle sets, prefix filtering, and a trie walk.

1. Chunks of documents and ranges of the shingle space exchange packed keys, so that every document
   learns which of its shingles other documents have, and in how many documents.
2. Sets are put in one global order, frequent shingles first. Two sets that link must share one of
   the rarest `n - ceil(0.75 n) + 1` shingles of each, so a document whose rarest ones are all its own
   has no partner and goes no further. Equal sets are one class from here on.
3. Classes that share a rare shingle meet at a pivot first, the most widely shared set: the links
   found this way join most classes into components. A round with other pivots follows, and at last all
   pairs that share a rare shingle, lie in different components and fit by length and position.
4. Pairs are verified per pivot: the sorted set sequences of its partners form a trie. The walk keeps
   the overlap of the path with the pivot, so a common beginning is counted once, and leaves a
   subtree when the overlap and the remaining length cannot reach the bound.

Links inside a component need no test, so a cluster of near copies costs its size and not its square.
Counts are exact integers; shingles are 64-bit hashes, equal sets are told by 128 bits.

Defined results: null and empty texts, and texts without words, have empty sets and no links. With
fewer than five words the whole sequence is the one shingle. Rows that share a doc_id are separate
documents under one name; a null doc_id keeps a null component unless linked to others. Extra columns
are ignored. Empty tables give empty tables.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabletrust.llm import chunks
from tabletrust.llm.chunks import distinct, short, sql_type, table_of, texts_of
from tabletrust.llm.text import gives_back, text_mark
from tabletrust.operators.skew import join_by_key
from tabletrust.session import materialize

WORDS = 5
#: Two sets link when PERCENT * union <= 100 * intersection.
PERCENT = 75
#: Rounds with one pivot per shingle before all remaining pairs are tried.
PIVOT_ROUNDS = 2
#: Partners of one pivot that are verified in one task.
PARTNERS = 1024
#: Tokens of the trie that are looked up at once.
STEP = 64

_ODD = np.array(
    [0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93,
     0xA0761D6478BD642F], np.uint64,
)


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes of a text."""
    parts = text.lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    one = np.fromiter(map(xxhash.xxh3_64_intdigest, parts), np.uint64, len(parts))
    size = min(words, len(parts))
    many = np.full(len(parts) - size + 1, size, np.uint64)
    for k in range(size):
        many += one[k : len(parts) - size + 1 + k] * _ODD[k % len(_ODD)] + np.uint64(k // len(_ODD))
    many ^= many >> np.uint64(29)
    many *= _ODD[1]
    many ^= many >> np.uint64(32)
    return distinct(many)


def _least_common(n: int, percent: int) -> int:
    """The smallest intersection with any set that a set of `n` needs for a link."""
    return -(-percent * n // 100)


_SETS = pa.schema(
    [("doc_id", pa.int64()), ("n", pa.int64()), ("key", pa.binary()), ("tokens", pa.binary()),
     ("own", pa.int64()), ("weight", pa.int64()), ("rare", pa.list_(pa.int64()))]
)
_MARK = pa.field("mark", pa.int64())


def _order(percent: int):
    """Chunk and shared keys to sets: global order, rare shingles, and the set's key."""

    def order(rows: pa.Table, shared: pa.Table) -> pa.Table:
        keys, counts = chunks.known_keys(shared)
        out, met = [], set()
        ids = rows.column("doc_id").to_pylist()
        for doc_id, text in zip(ids, texts_of(rows)):
            tokens = shingles(text)
            n = len(tokens)
            if not n or not len(keys):
                out.append((doc_id, n, *[None] * 5))
                continue
            counted = short(tokens)
            at = np.minimum(np.searchsorted(keys, counted), len(keys) - 1)
            seen = np.where(keys[at] == counted, counts[at], 1)
            sure = n - _least_common(n, percent) + 1
            own = int((seen == 1).sum())
            if own >= sure:
                out.append((doc_id, n, *[None] * 5))
                continue
            order = np.lexsort((tokens, seen))[::-1]
            tokens, seen = tokens[order], seen[order]
            key = xxhash.xxh3_128_digest(tokens.tobytes())
            if key in met:
                out.append((doc_id, n, key, *[None] * 4))
                continue
            met.add(key)
            weight = int(1000 * np.log2(seen).mean())
            shared = tokens[: n - own]
            rare = shared[n - sure :][::-1].view(np.int64)
            out.append((doc_id, n, key, shared.tobytes(), own, weight, rare))
        found = table_of(out, _SETS)
        if "mark" in rows.column_names:
            found = found.append_column(_MARK, rows.column("mark"))
        return found

    return order


def ordered_sets(docs: DataFrame, percent: int = PERCENT, marked: bool = False) -> DataFrame:
    """(doc_id, n, key, tokens, own, weight, rare) of every row; key is null without a partner.

    `tokens` are the shingles that other documents have too, in the global order, `own` is the number
    of the others, `weight` says how widely shared the set is, and `rare` are the rarest of
    `tokens`, the rarest first, at places `own` and on of the whole set. All four are there for one
    row of each key in a chunk. `marked` adds the text_mark of each row as `mark`.
    """
    total = chunks.text_bytes(docs)
    texts = chunks.chunked(docs, chunks.chunk_count(total))
    n_ranges = chunks.range_count(total)
    shared = chunks.shared_keys(texts, n_ranges, lambda found: map(shingles, found))
    if marked:
        texts = texts.withColumn("mark", text_mark(F.col("text")))
    both = texts.groupBy("chunk").cogroup(shared.groupBy("chunk"))
    schema = sql_type(_SETS.append(_MARK) if marked else _SETS)
    return both.applyInArrow(gives_back(_order(percent)), schema)


def trie_links(
    pivot: np.ndarray, n_pivot: int, partners: list[np.ndarray], sizes: list[int],
    percent: int = PERCENT,
) -> list[int]:
    """Which of `partners` link to `pivot`; shared shingles in global order, and whole set sizes.

    Partners in order of their sequences are the leaves of a trie from left to right. `overlap[d]` is
    the intersection of the pivot with the current path down to depth d; the next leaf keeps the part
    above its branching point.
    """
    inside = np.sort(pivot)
    sequences = [p.astype(">u8").tobytes() for p in partners]
    out, path, overlap, known = [], np.zeros(0, np.uint64), np.zeros(1, np.int64), 0
    for i in sorted(range(len(partners)), key=sequences.__getitem__):
        own = partners[i]
        n, total = len(own), sizes[i] + n_pivot
        need = -(-percent * total // (100 + percent))
        common = min(len(path), n, known)
        branch = np.flatnonzero(path[:common] != own[:common])
        depth = int(branch[0]) if len(branch) else common
        path, grown = own, np.zeros(n + 1, np.int64)
        grown[: depth + 1] = overlap[: depth + 1]
        while depth < n and grown[depth] + n - depth >= need:
            ahead = own[depth : depth + STEP]
            hits = np.cumsum(chunks.found_in(ahead, inside))
            grown[depth + 1 : depth + 1 + len(ahead)] = grown[depth] + hits
            depth += len(ahead)
        overlap, known = grown, depth
        if depth == n and 100 * grown[n] >= percent * (total - grown[n]):
            out.append(i)
    return out


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _verify(percent: int):
    def verify(pivots: pa.Table, partners: pa.Table) -> pa.Table:
        if not pivots.num_rows or not partners.num_rows:
            return _LINKS.empty_table()
        a, n = pivots.column("a")[0].as_py(), pivots.column("n")[0].as_py()
        pivot = np.frombuffer(pivots.column("tokens")[0].as_py(), np.uint64)
        names, sizes = partners.column("b").to_pylist(), partners.column("n").to_pylist()
        sets = [np.frombuffer(t, np.uint64) for t in partners.column("tokens").to_pylist()]
        return table_of([(a, names[i]) for i in trie_links(pivot, n, sets, sizes, percent)], _LINKS)

    return verify


def verified(pairs: DataFrame, classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) that link, found by one trie walk for each pivot and block of partners.

    `classes` has (id, n, tokens), also of classes that no pair names.
    """
    blocks = pairs.groupBy("a").agg((F.count(F.lit(1)) / PARTNERS).cast("int").alias("most"))
    named = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = materialize(classes.join(named, "id", "left_semi"), "paired-sets")
    pivots = (
        blocks.join(sets.withColumnRenamed("id", "a"), "a")
        .select("a", F.explode(F.sequence(F.lit(0), "most")).alias("block"), "n", "tokens")
        .toDF("a", "block", "n", "tokens")
    )
    partners = (
        pairs.join(blocks, "a")
        .select("a", "b", F.pmod(F.xxhash64("b"), F.col("most") + 1).cast("int").alias("block"))
        .join(sets.withColumnRenamed("id", "b"), "b")
        .toDF("b", "a", "block", "n", "tokens")
    )
    both = pivots.groupBy("a", "block").cogroup(partners.groupBy("a", "block"))
    return both.applyInArrow(_verify(percent), sql_type(_LINKS))


def components(links: DataFrame) -> DataFrame:
    """(id, label) of every linked id: the smallest id of its component.

    Each round takes the smallest label among neighbours and then the label's own label.
    """
    edges = materialize(
        links.select("a", "b").union(links.select("b", "a")).distinct().toDF("id", "to"), "links"
    )
    labels = materialize(
        edges.groupBy("id").agg(F.least(F.min("to"), F.col("id")).alias("label")), "labels"
    )
    while True:
        ahead = labels.toDF("to", "next")
        near = edges.join(ahead, "to").groupBy("id").agg(F.min("next").alias("near"))
        lower = labels.join(near, "id").select(
            "id", "label", F.least("label", "near").alias("lower")
        )
        jump = lower.select(F.col("id").alias("lower"), F.col("lower").alias("lowest"))
        new = materialize(
            lower.join(jump, "lower", "left").select(
                "id", F.col("label").alias("was"),
                F.least("lower", F.coalesce("lowest", "lower")).alias("label"),
            ),
            "labels",
        )
        if new.where("was <> label").isEmpty():
            return new.select("id", "label")
        labels = new.select("id", "label")


def class_labels(rare: DataFrame, classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(id, label) of the classes that link to others.

    `rare(id, n, weight, token, pos)` are the rare shingles of each class with their places in the
    whole set, `classes` as in `verified`. Each round keeps only shingles that still have classes of
    different components.
    """
    spark = classes.sparkSession
    links = spark.createDataFrame([], sql_type(_LINKS))
    tested, labels = links, spark.createDataFrame([], "id bigint, label bigint")
    rare = rare.withColumn("label", F.col("id"))
    for k in range(PIVOT_ROUNDS + 1):
        ends = rare.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high"))
        mixed = ends.where("low <> high").select("token")
        rare = materialize(rare.join(mixed, "token", "left_semi"), "mixed-shingles")
        if k < PIVOT_ROUNDS:
            first = F.col("weight") if k == 0 else F.xxhash64("id", F.lit(k))
            place = F.struct(first.alias("first"), "id", "label", "n", "pos")
            p = rare.groupBy("token").agg(F.max(place).alias("p")).select("token", "p.*").drop("first")
        else:
            p = rare.select("token", "id", "label", "n", "pos")
        p = p.toDF("token", "a", "a_label", "a_n", "a_pos")
        fits = (
            (F.col("label") != F.col("a_label"))
            & (F.least("n", "a_n") * 100 >= F.greatest("n", "a_n") * percent)
            & (
                F.least(F.col("n") - F.col("pos"), F.col("a_n") - F.col("a_pos")) * (100 + percent)
                >= (F.col("n") + F.col("a_n")) * percent
            )
        )
        pairs = (
            rare.join(p, "token").where(fits)
            .select(F.least("a", "id").alias("x"), F.greatest("a", "id").alias("y"), "a")
            .groupBy("x", "y").agg(F.min("a").alias("a"))
            .select("a", (F.col("x") + F.col("y") - F.col("a")).alias("b"))
        )
        done = tested.union(tested.select("b", "a"))
        pairs = materialize(pairs.join(done, ["a", "b"], "left_anti"), "pairs")
        if pairs.isEmpty():
            continue
        tested = tested.union(pairs)
        found = materialize(verified(pairs, classes, percent), "verified")
        if found.isEmpty():
            continue
        links = links.union(found)
        labels = components(links)
        if k < PIVOT_ROUNDS:
            new = labels.withColumnRenamed("label", "new")
            rare = rare.join(new, "id", "left").withColumn("label", F.coalesce("new", "id")).drop("new")
    return labels


def class_components(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """key, label and component_id of every class of equal sets; a label names one component."""
    keyed = sets.where("key is not null")
    classes = materialize(
        keyed.groupBy("key").agg(F.min("doc_id").alias("least"))
        .withColumn("id", F.monotonically_increasing_id()),
        "set-classes",
    )
    # A key has a row with its shingles in every chunk that has the set.
    whole = sets.where("tokens is not null").select("key", "n", "own", "weight", "rare", "tokens")
    named = whole.join(classes.select("key", "id"), "key")
    rare = materialize(
        named.select("id", "n", "own", "weight", F.posexplode("rare").alias("at", "token"))
        .select("id", "n", "weight", "token", (F.col("own") + F.col("at")).alias("pos"))
        .distinct(),
        "rare-shingles",
    )
    shared = named.select("id", "n", "tokens").dropDuplicates(["id"])
    labels = class_labels(rare, shared, percent)
    named = classes.join(labels, "id", "left").select(
        "key", "least", F.coalesce("label", "id").alias("label")
    )
    roots = named.groupBy("label").agg(F.min("least").alias("component_id"))
    return named.join(roots, "label").select("key", "label", "component_id")


def document_components(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    sets = materialize(ordered_sets(docs, percent), "ordered-sets")
    named = class_components(sets, percent).select("key", "component_id")
    named = materialize(named, "class-components")
    return join_by_key(sets.select("doc_id", "n", "key"), named, "key", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.coalesce("component_id", "doc_id").alias("component_id"),
    )


def one_of_each(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """`docs` with one row of each component; all columns as they are.

    It is the row with the smallest doc_id, a null one last, then with the smallest mark of its text;
    of rows equal in both, one. Texts without words have no component, and all stay.
    """
    sets = materialize(ordered_sets(docs, percent, marked=True), "ordered-sets")
    named = class_components(sets, percent).select("key", "label")
    named = materialize(named, "class-components")
    rows = materialize(
        join_by_key(sets.select("doc_id", "mark", "key"), named, "key")
        .groupBy("label", F.col("doc_id").alias("id"), "mark").agg(F.count("*").alias("times")),
        "component-rows",
    )
    place = F.struct(F.col("id").isNull().alias("no_id"), "id", "mark", "times")
    stays = materialize(
        rows.groupBy("label").agg(F.min(place).alias("row")).select(
            F.col("row.id").alias("as_id"), F.col("row.mark").alias("as_mark"), "row.times"
        ),
        "component-firsts",
    )
    same = F.col("id").eqNullSafe(F.col("as_id")) & (F.col("mark") == F.col("as_mark"))
    gone = rows.join(stays, same, "left_anti").select("id", "mark").toDF("as_id", "as_mark")
    gone = materialize(gone, "component-others")
    repeated = stays.where("times > 1").select("as_id", "as_mark")
    whole = docs.select(
        F.struct("*").alias("row"), F.col("doc_id").cast("bigint").alias("id"),
        text_mark(F.col("text")).alias("mark"),
    )
    if repeated.isEmpty():
        return whole.join(gone, same, "left_anti").select("row.*")
    nth = F.row_number().over(Window.partitionBy("id", "mark").orderBy(F.to_json("row")))
    first = whole.join(repeated, same, "left_semi").withColumn("nth", nth).where("nth = 1")
    others = whole.join(gone.union(repeated), same, "left_anti")
    return others.unionByName(first.drop("nth")).select("row.*")
