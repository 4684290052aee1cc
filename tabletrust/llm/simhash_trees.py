"""SimHash near-dedup: fingerprints of word shingles, linked through BK-trees.

1. Every whole text becomes a 64-bit fingerprint. Equal fingerprints are one class from here on.
2. Fingerprints that differ in at most `RADIUS` bits agree in at least one of `RADIUS + 1` parts of
   their bits. Each class is sent to one bucket per part, named by the part and its bits, so a
   bucket is a shard of all fingerprints that may lie within the radius of each other.
3. A bucket of more than `MOST_NODES` classes is cut again by the bits it has not used yet, which
   again lose no pair: bits run out before buckets stay large, however skewed the fingerprints are.
4. Every bucket becomes a BK-tree in the task that holds it: children are keyed by their Hamming
   distance to the parent, and a search follows only edges within the radius. A bucket answers with
   one link per class to the first class of its part of the bucket, never with all pairs.
5. Links of all buckets are joined into components by rounds of label joins.

Shard trees are not broadcast: a broadcast passes through the driver, and all trees together hold the
fingerprints of all documents. Fingerprints travel by shuffle to the shards that can answer instead.

Defined results: null and empty texts and texts without words have the fingerprint zero and link like
any other. Rows that share a doc_id are separate documents under one name; a null doc_id counts as
larger than any other, and a component of null ids alone has a null component_id. Extra columns are
ignored. Empty tables give empty tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabletrust.llm.ngram_join import components
from tabletrust.llm.text import as_bytes, small_batches
from tabletrust.operators.skew import join_by_key
from tabletrust.session import materialize

WORDS = 3
#: Seed of XXH64, and the most bits in which linked fingerprints differ.
SEED, RADIUS = 42, 3
BITS = 64
#: Classes in one BK-tree; larger buckets are cut further.
MOST_NODES = 1024
#: Shingles whose bits are counted at once.
BLOCK = 1 << 16


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """The bits set in over half of the shingle hashes; zero without words."""
    parts = text.lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(lengths + 1) - 1
    size = min(words, len(parts))
    n = len(parts) - size + 1
    first, last = (ends - lengths)[:n].tolist(), ends[size - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter([digest(joined[a:b], SEED) for a, b in zip(first, last)], np.uint64, n)
    counts = np.zeros(BITS, np.int64)
    for start in range(0, n, BLOCK):
        block = hashes[start : start + BLOCK]
        bits = np.unpackbits(block.view(np.uint8), bitorder="little").reshape(len(block), BITS)
        counts += bits.sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, print) of every row; the 64 bits are kept as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            found = [fingerprint(t, words) for t in as_bytes(batch.column("text"))]
            prints = pa.array(np.array(found, np.uint64).view(np.int64))
            yield pa.record_batch([batch.column("doc_id"), prints], ["doc_id", "print"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id bigint, print bigint")


def within(prints: list[int], radius: int = RADIUS) -> list[tuple[int, int]]:
    """(i, first) for each print that others link: the first print of its component in the list.

    The tree is grown print by print; each is searched for in the tree of those before it.
    """
    children: list[dict[int, int]] = [{}]
    root = list(range(len(prints)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for i in range(1, len(prints)):
        own, stack = prints[i], [0]
        while stack:
            node = stack.pop()
            distance = (own ^ prints[node]).bit_count()
            if distance <= radius:
                a, b = find(i), find(node)
                root[max(a, b)] = min(a, b)
            for edge, child in children[node].items():
                if -radius <= edge - distance <= radius:
                    stack.append(child)
        node = 0
        while True:
            distance = (own ^ prints[node]).bit_count()
            below = children[node].get(distance)
            if below is None:
                children[node][distance] = i
                children.append({})
                break
            node = below
    return [(i, first) for i in range(len(prints)) if (first := find(i)) != i]


def part_masks(used: int, parts: int) -> list[int]:
    """The bits outside `used` dealt into `parts` runs of nearly equal length, as masks."""
    free = [1 << b for b in range(BITS) if not used >> b & 1]
    edges = [len(free) * k // parts for k in range(parts + 1)]
    return [sum(free[a:b]) for a, b in zip(edges, edges[1:])]


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def _bucketed(rows: DataFrame, used: list[int], radius: int) -> tuple[DataFrame, list[int]]:
    """Each row once per part of its unused bits: (path, bits, print), and the masks by path.

    `used` has the bits behind each path so far; the masks follow from the number of rounds alone.
    """
    finer = [(k, mask | part) for k, mask in enumerate(used) for part in part_masks(mask, radius + 1)]
    masks = [(k, to, _signed(mask)) for to, (k, mask) in enumerate(finer)]
    if len(used) == 1:
        each = F.array(*(F.struct(F.lit(to).alias("next"), F.lit(m).alias("mask")) for _, to, m in masks))
        rows = rows.select("print", F.inline(each))
    else:
        known = rows.sparkSession.createDataFrame(masks, "path int, next int, mask bigint")
        rows = rows.join(F.broadcast(known), "path")
    bits = F.col("print").bitwiseAND(F.col("mask"))
    return rows.select(F.col("next").alias("path"), bits.alias("bits"), "print"), [m for _, m in finer]


def _search(radius: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One tree per run of equal (path, bits); a run may go on in the next batch."""
        key, held, out = None, [], []

        def close() -> None:
            if len(held) > 1:
                out.extend((held[i], held[k]) for i, k in within(held, radius))

        for batch in batches:
            paths, bits = (batch.column(c).to_numpy() for c in ("path", "bits"))
            prints = batch.column("print").to_numpy().view(np.uint64).tolist()
            changes = np.flatnonzero((paths[1:] != paths[:-1]) | (bits[1:] != bits[:-1])) + 1
            for a, b in zip([0, *changes.tolist()], [*changes.tolist(), len(prints)]):
                if a == b:
                    continue
                if (now := (paths[a], bits[a])) != key:
                    close()
                    key, held = now, []
                held.extend(prints[a:b])
            if out:
                yield _links(out)
                out.clear()
        close()
        if out:
            yield _links(out)

    return search


def _links(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    ends = np.array(pairs, np.uint64).view(np.int64).reshape(-1, 2)
    return pa.record_batch([pa.array(ends[:, 0]), pa.array(ends[:, 1])], ["a", "b"])


def print_links(classes: DataFrame, radius: int = RADIUS, most_nodes: int = MOST_NODES) -> DataFrame:
    """(a, b): links that join every two classes within `radius` into one component.

    `most_nodes` is at least 2 ** radius, so that every larger bucket has a bit left for each part.
    """
    if most_nodes < 1 << radius:
        raise ValueError("a bucket of so few nodes may have no bits left to cut it by")
    links = classes.sparkSession.createDataFrame([], "a bigint, b bigint")
    rows, used = classes.select(F.lit(0).alias("path"), "print"), [0]
    while True:
        rows, used = _bucketed(rows, used, radius)
        counts = rows.groupBy("path", "bits").agg(F.count(F.lit(1)).alias("n"))
        large = materialize(counts.where(F.col("n") > most_nodes).drop("n"), "large-buckets")
        done = large.isEmpty()
        small = rows if done else rows.join(large, ["path", "bits"], "left_anti")
        small = small.repartition("path", "bits").sortWithinPartitions("path", "bits")
        links = links.union(
            materialize(small.mapInArrow(_search(radius), "a bigint, b bigint"), "print-links")
        )
        if done:
            return links
        rows = rows.join(large, ["path", "bits"], "left_semi").select("path", "print")
        rows = materialize(rows, "rows-of-large-buckets")


def document_components(
    docs: DataFrame, words: int = WORDS, radius: int = RADIUS, most_nodes: int = MOST_NODES
) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row."""
    prints = materialize(fingerprints(docs, words), "fingerprints")
    least = prints.groupBy("print").agg(F.min("doc_id").alias("least"))
    classes = materialize(least, "print-classes")
    labels = components(print_links(classes, radius, most_nodes)).withColumnRenamed("id", "print")
    named = materialize(
        classes.join(labels, "print", "left")
        .select("print", "least", F.coalesce("label", "print").alias("label")),
        "named-classes",
    )
    roots = named.groupBy("label").agg(F.min("least").alias("component_id"))
    found = named.join(roots, "label").select("print", "component_id")
    return join_by_key(prints, materialize(found, "class-components"), "print").select(
        "doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id"
    )
