"""Benchmark decontamination: a broadcast set of test n-grams, and a scan of training windows.

The test items are cut into windows of ten normalised words. Their vocabulary and the set of window
hashes go to every task. A document's words are looked up in that vocabulary, so only stretches made
of test words alone are hashed; a hash that is in the set is compared word by word.

Defined results: a null or empty text, or one without words, has no words and no hits. An item
without words is never found; one of fewer than ten words is a single shorter window. Items that
repeat under one id count once; a null item id is written as an empty string. Every input row gives
one result row, also when rows repeat. Extra columns are ignored by `scan`.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabletrust.llm.text import LOWER, UPPER, as_bytes, small_batches

WINDOW = 10
#: The test items go to the tasks in slices of about so many bytes of text.
SLICE_BYTES = 32 << 20

_WORD_BYTES = frozenset(b"0123456789" + LOWER.encode() + UPPER.encode()) | set(range(0x80, 0x100))
#: Every byte outside words becomes a blank, and A-Z become a-z.
_TO_WORDS = bytes(
    ord(chr(b).lower()) if b < 0x80 and b in _WORD_BYTES else b if b in _WORD_BYTES else 0x20
    for b in range(256)
)
_WORD = re.compile(rb"[^ ]+")
_STEP = np.uint64(0x9E3779B97F4A7C15)
FOUND = "array<struct<start:bigint,length:bigint>>"
#: Hit stretches of earlier slices, beside the columns of a table whose names are not known.
_RUNS = "__hit_runs"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TO_WORDS).split()


class ItemIndex:
    """Windows of one slice of test items: word numbers, window hashes, and the items of each window."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW) -> None:
        self.vocabulary: dict[bytes, int] = {}
        self.windows: dict[int, dict[bytes, set[str]]] = {}
        for item, text in items:
            words = words_of(text)
            ids = np.array(
                [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], np.int64
            )
            size = min(window, len(ids))
            for i in range(len(ids) - size + 1 if size else 0):
                known = self.windows.setdefault(size, {})
                known.setdefault(ids[i : i + size].tobytes(), set()).add(item)
        self.powers = np.cumprod(np.full(window, _STEP))
        self.hashes = {
            size: np.unique([self._hash(np.frombuffer(k, np.int64)[None])[0] for k in known])
            for size, known in self.windows.items()
        }

    def _hash(self, ids: np.ndarray) -> np.ndarray:
        return (ids.astype(np.uint64) * self.powers[: ids.shape[1]]).sum(axis=1, dtype=np.uint64)

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """(start, length) of the maximal hit stretches in words, and the items found."""
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.int64, len(words))
        hit, items = np.zeros(len(ids) + 1, np.int64), set()
        known_before = np.concatenate(([0], np.cumsum(ids > 0)))
        for size, known in self.windows.items():
            if len(ids) < size:
                continue
            at = np.flatnonzero(known_before[size:] - known_before[:-size] == size)
            for part in np.array_split(at, len(at) // 100_000 + 1):
                hashes = self._hash(ids[part[:, None] + np.arange(size)])
                for i in part[np.isin(hashes, self.hashes[size])].tolist():
                    if found := known.get(ids[i : i + size].tobytes()):
                        items |= found
                        hit[i] += 1
                        hit[i + size] -= 1
        inside = np.concatenate(([0], np.cumsum(hit[:-1]) > 0, [0])).astype(np.int8)
        edges = np.flatnonzero(np.diff(inside))
        return list(zip(edges[::2].tolist(), (edges[1::2] - edges[::2]).tolist())), items


def _slices(items: DataFrame, slice_bytes: int) -> Iterator[tuple[list[tuple[str, bytes]], bool]]:
    """The items in driver-sized slices, so that what is broadcast is bounded; and which is the last."""
    rows = items.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(total / slice_bytes))
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
        yield [(r.item, r.text.encode()) for r in part.toLocalIterator()], k == n - 1


def scan(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, slice_bytes: int = SLICE_BYTES
) -> DataFrame:
    """doc_id, text, n_words, `runs` (hit stretches, counted in words) and `items` of each row.

    One pass per slice of the test items, in the same stage; a benchmark of ordinary size is one.
    """
    sc = docs.sparkSession.sparkContext
    schema = f"doc_id bigint, text string, n_words bigint, runs {FOUND}, items array<string>"
    out = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), "text",
        F.lit(0).cast("bigint").alias("n_words"),
        F.array().cast(FOUND).alias("runs"), F.array().cast("array<string>").alias("items"),
    )
    for part, _ in _slices(items, slice_bytes):
        index = sc.broadcast(ItemIndex(part, window))

        def find(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in small_batches(batches, "text"):
                counts, runs, items = [], [], []
                for text, had, with_items in zip(
                    as_bytes(batch.column("text")),
                    batch.column("runs").to_pylist(),
                    batch.column("items").to_pylist(),
                ):
                    words = words_of(text)
                    found, these = index.value.find(words)
                    counts.append(len(words))
                    had_runs = [(r["start"], r["length"]) for r in had]
                    runs.append(merge(had_runs + found) if had_runs else found)
                    items.append(sorted(these.union(with_items)))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"), batch.column("text"), pa.array(counts, pa.int64()),
                        pa.array(
                            [[{"start": s, "length": n} for s, n in r] for r in runs],
                            batch.schema.field("runs").type,
                        ),
                        pa.array(items, batch.schema.field("items").type),
                    ],
                    schema=batch.schema,
                )

        out = out.mapInArrow(find, schema)
    return out


def merge(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and touching stretches made one."""
    out: list[tuple[int, int]] = []
    for start, length in sorted(runs):
        if out and start <= sum(out[-1]):
            out[-1] = (out[-1][0], max(sum(out[-1]), start + length) - out[-1][0])
        else:
            out.append((start, length))
    return out


def report(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    n_hit = F.aggregate("runs", F.lit(0).cast("bigint"), lambda n, r: n + r["length"])
    return scan(docs, items, window).select(
        "doc_id", "n_words", n_hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.sort_array("items"), ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def remove_spans(
    docs: DataFrame, items: DataFrame, most: float = 0.5, slice_bytes: int = SLICE_BYTES
) -> DataFrame:
    """`docs` with hit stretches cut out of `text`; rows with more than `most` of their words hit go.

    Keeps all columns and brings `n_chars` up to date where there is one. A stretch is cut from its
    first word's first byte to its last word's last byte. Every slice of the test items looks at the
    whole text; the pass of the last one judges and cuts by the stretches of all.
    """
    sc = docs.sparkSession.sparkContext
    plain = docs.schema
    docs = docs.withColumn(_RUNS, F.array().cast(FOUND))
    for part, last in _slices(items, slice_bytes):
        index = sc.broadcast(ItemIndex(part))

        def cut(
            batches: Iterator[pa.RecordBatch], index=index, last=last
        ) -> Iterator[pa.RecordBatch]:
            for batch in small_batches(batches, "text"):
                place, at_runs = (batch.schema.get_field_index(c) for c in ("text", _RUNS))
                texts, keep, all_runs = [], [], []
                for text, null, had in zip(
                    as_bytes(batch.column(place)), batch.column(place).is_null(),
                    batch.column(at_runs).to_pylist(),
                ):
                    words = words_of(text)
                    runs, _ = index.value.find(words)
                    if had:
                        runs = merge([(r["start"], r["length"]) for r in had] + runs)
                    if not last:
                        all_runs.append([{"start": s, "length": n} for s, n in runs])
                        continue
                    keep.append(sum(n for _, n in runs) <= most * len(words))
                    if runs and keep[-1]:
                        spans = [m.span() for m in _WORD.finditer(text.translate(_TO_WORDS))]
                        at, left = 0, []
                        for start, n in runs:
                            left.append(text[at : spans[start][0]])
                            at = spans[start + n - 1][1]
                        text = b"".join([*left, text[at:]])
                    texts.append(None if null.as_py() else text.decode())
                if not last:
                    field = batch.schema.field(at_runs)
                    yield batch.set_column(at_runs, field, pa.array(all_runs, field.type))
                    continue
                field = batch.schema.field(place)
                done = batch.set_column(place, field, pa.array(texts, field.type))
                yield done.drop_columns([_RUNS]).filter(pa.array(keep, pa.bool_()))

        docs = docs.mapInArrow(cut, plain if last else docs.schema)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        docs = docs.withColumn("n_chars", F.coalesce(F.char_length("text"), F.lit(0)).cast(kind))
    return docs
