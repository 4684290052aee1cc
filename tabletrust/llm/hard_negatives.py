"""Hard-negative mining: pair scores in packed keys, a secondary-sort shuffle, and a streaming reader.

A pair of an anchor and another row is one key of `KEY_BYTES`: (anchor, descending score, kind, id),
positives before negatives of the same score. Keys are dealt by anchor and sorted inside the partitions
(`repartitionAndSortWithinPartitions`, which spills); a reader then meets the pairs of an anchor from
the best score down, opens a window at each positive, and emits negatives while a window is open. It
holds the open windows and nothing else of an anchor.

Only pairs that can matter are sent. Blocks of rows are scored against the anchors, which are
broadcast in slices of at most `SLICE_BYTES`; each block sends its own first positives of an anchor,
and a first shuffle finds the anchor's. With those known, each block sends the first negatives of each
window. What is first among all rows is first in its block too, so the result is that of all pairs,
while an anchor receives a bounded number of keys from a block, whatever the labels or ties.

Defined results: rows with a null label, a null vector, or a component that is null, or not finite
after it is scaled, take no part. Rows with a null id take part, last among equal scores. Rows under
the anchor's own id, and rows whose vector has another length, are no partners. Repeated rows are
separate partners; equal anchors are one, and unequal ones under one id are separate. Scores are exact;
beyond 2 ** 62 either way they count as that. Extra columns are ignored, empty tables give empty ones.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabletrust.session import materialize

#: Rows with an id divisible by this are anchors.
ANCHOR_EVERY = 100
POSITIVES, NEGATIVES = 5, 5
#: A negative's score is at least this percentage of the positive's, and at most all of it.
LEAST_PERCENT = 80
#: Components are multiplied by this and floored.
SCALE = 256
#: Anchor vectors in one broadcast, as doubles; vector components in one block of rows.
SLICE_BYTES, BLOCK_VALUES = 32 << 20, 1 << 20
#: Anchors scored at once, and pairs that one task scores.
TILE, TASK_PAIRS = 256, 2_000_000_000

MOST_SCORE = 1 << 62
_LOW = 1 << 63
#: Anchor id, anchor mark, descending score, kind (0 positive), whether the id is null, id.
_KEY = struct.Struct(">QQQBBQ")
_KEY_TYPE = np.dtype(
    [("a", ">u8"), ("mark", ">u8"), ("score", ">u8"), ("kind", "u1"), ("no_id", "u1"), ("id", ">u8")]
)
KEY_BYTES, ANCHOR_BYTES = _KEY.size, 16
_RESULT = (
    "anchor_id bigint, positive_id bigint, rank int, negative_id bigint,"
    " positive_score bigint, negative_score bigint"
)


def usable(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, vec) of the rows that take part, with the labels as they are judged."""
    vec = F.col("embedding").cast("array<double>")
    # One bad component spoils the sum: null, NaN or infinity times zero is not zero.
    clean = F.forall(vec, lambda x: x.isNotNull() & (x * SCALE * 0.0 == 0.0))
    label, moved = F.col("label").cast("bigint"), F.col("vec_id") % 7 == 0
    return embeddings.where(F.col("label").isNotNull() & vec.isNotNull() & clean).select(
        F.col("vec_id").cast("bigint").alias("vec_id"),
        F.when(moved, (label + 1) % 10).otherwise(label).alias("label"), vec.alias("vec"),
    )


def _scaled(values: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * values)


def _products(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products of two tables of whole doubles."""
    if not anchors.shape[1]:
        return np.zeros((len(anchors), len(rows)), np.int64)
    most = np.abs(anchors).max() * np.abs(rows).max() * anchors.shape[1]
    if most < 1 << 53:
        return (anchors @ rows.T).astype(np.int64)
    whole = [[[int(x) for x in v] for v in part.tolist()] for part in (anchors, rows)]
    return np.array(
        [
            [max(-MOST_SCORE, min(MOST_SCORE, sum(x * y for x, y in zip(a, b)))) for b in whole[1]]
            for a in whole[0]
        ],
        np.int64,
    )


class Anchors:
    """One slice of anchors: by length of the vector, ids, marks, labels and scaled vectors."""

    def __init__(self, rows: list) -> None:
        self.ids = np.array([r.vec_id for r in rows], np.int64)
        self.marks = np.array([r.mark for r in rows], np.int64)
        self.labels = np.array([r.label for r in rows], np.int64)
        lengths = np.array([len(r.vec) for r in rows], np.int64)
        self.groups = {
            int(n): (at := np.flatnonzero(lengths == n), _scaled(np.array([rows[i].vec for i in at])))
            for n in np.unique(lengths)
        }
        #: Scores of each anchor's positives, once they are known.
        self.positives: dict[int, list[int]] = {}

    def learn(self, keys: list[bytes]) -> None:
        at = {(int(i), int(m)): k for k, (i, m) in enumerate(zip(self.ids, self.marks))}
        for key in keys:
            i, mark, score, *_ = _KEY.unpack(key)
            own = self.positives.setdefault(at[i - _LOW, mark - _LOW], [])
            own.append(MOST_SCORE - score)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """(ids, whether null, labels, scaled vectors) of rows with vectors of one length, in id order."""
    for batch in batches:
        lists = batch.column("vec")
        lengths = np.asarray(lists.value_lengths())
        ids = batch.column("vec_id")
        no_id, ids = np.asarray(ids.is_null()), np.asarray(ids.fill_null(0))
        labels = np.asarray(batch.column("label"))
        starts = np.concatenate(([0], np.cumsum(lengths)))
        values = np.asarray(lists.flatten())
        order = np.lexsort((ids, no_id))
        for n in np.unique(lengths).tolist():
            own = order[lengths[order] == n]
            step = max(1, BLOCK_VALUES // max(1, n))
            for k in range(0, len(own), step):
                at = own[k : k + step]
                vectors = values[starts[at][:, None] + np.arange(n)]
                yield ids[at], no_id[at], labels[at], _scaled(vectors)


def _keys(anchors: Anchors, a: np.ndarray, scores, kind: int, ids, no_id) -> pa.RecordBatch:
    packed = np.empty(len(a), _KEY_TYPE)
    biased = lambda x: x.astype(np.uint64) ^ np.uint64(_LOW)
    packed["a"], packed["mark"] = biased(anchors.ids[a]), biased(anchors.marks[a])
    packed["score"] = (MOST_SCORE - scores).astype(np.uint64)
    packed["kind"], packed["no_id"], packed["id"] = kind, no_id, biased(ids)
    fixed = pa.binary(KEY_BYTES)
    column = pa.FixedSizeBinaryArray.from_buffers(fixed, len(a), [None, pa.py_buffer(packed.tobytes())])
    return pa.record_batch([column.cast(pa.binary())], ["key"])


def _first_positives(scores: np.ndarray, partner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, row) of each anchor's best partners in the block; rows are in id order."""
    ranked = np.where(partner, -scores, np.iinfo(np.int64).max)
    best = np.argsort(ranked, axis=1, kind="stable")[:, :POSITIVES]
    a = np.repeat(np.arange(len(scores)), best.shape[1])
    rows = best.ravel()
    found = partner[a, rows]
    return a[found], rows[found]


def _window_firsts(scores: np.ndarray, rows: np.ndarray, positives: list[int]) -> np.ndarray:
    """Those of `rows`, in id order, that are among the first negatives of a positive's window."""
    order = np.argsort(-scores, kind="stable")
    down = -scores[order]
    taken = set()
    for score in positives:
        least = -(-LEAST_PERCENT * score // 100)
        start = int(np.searchsorted(down, -score, "left"))
        end = int(np.searchsorted(down, -least, "right"))
        taken.update(range(start, min(end, start + NEGATIVES)))
    return rows[order[sorted(taken)]] if taken else rows[:0]


def _send(shared, kind: int) -> Callable:
    """Keys of the pairs of one kind that a block sends, for `mapInArrow`."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors: Anchors = shared.value
        for ids, no_id, labels, vectors in _blocks(batches):
            group, values = anchors.groups.get(vectors.shape[1], (None, None))
            if group is None:
                continue
            for start in range(0, len(group), TILE):
                own = group[start : start + TILE]
                if kind:
                    known = np.array([int(i) in anchors.positives for i in own], bool)
                    own, part = own[known], values[start : start + TILE][known]
                    if not len(own):
                        continue
                else:
                    part = values[start : start + TILE]
                scores = _products(part, vectors)
                same = anchors.labels[own][:, None] == labels
                others = no_id | (anchors.ids[own][:, None] != ids)
                if kind:
                    pairs = []
                    for k, i in enumerate(own.tolist()):
                        wanted = [s for s in anchors.positives[i] if s >= 0]
                        if not wanted:
                            continue
                        least = -(-LEAST_PERCENT * min(wanted) // 100)
                        line = scores[k]
                        fits = ~same[k] & others[k] & (line >= least) & (line <= max(wanted))
                        rows = np.flatnonzero(fits)
                        if len(rows):
                            rows = _window_firsts(line[rows], rows, wanted)
                            pairs.append((np.full(len(rows), k), rows))
                    if not pairs:
                        continue
                    a, rows = (np.concatenate(x) for x in zip(*pairs))
                else:
                    a, rows = _first_positives(scores, same & others)
                if len(a):
                    yield _keys(anchors, own[a], scores[a, rows], kind, ids[rows], no_id[rows])

    return send


def _sorted_keys(keys: DataFrame):
    """The keys dealt by anchor and sorted inside the partitions."""
    n = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keys.rdd.map(lambda row: (bytes(row[0]), None)).repartitionAndSortWithinPartitions(
        n, lambda key: zlib.crc32(key[:ANCHOR_BYTES])
    )


def _firsts(pairs: Iterator[tuple[bytes, None]]) -> Iterator[tuple[bytes]]:
    """The first POSITIVES keys of each anchor."""
    anchor, n = None, 0
    for key, _ in pairs:
        if key[:ANCHOR_BYTES] != anchor:
            anchor, n = key[:ANCHOR_BYTES], 0
        n += 1
        if n <= POSITIVES:
            yield (key,)


def emit(pairs: Iterator[tuple[bytes, None]]) -> Iterator[tuple]:
    """Result rows of sorted keys; holds the open windows of one anchor."""
    anchor, windows = None, []
    for key, _ in pairs:
        a, _mark, down, kind, no_id, i = _KEY.unpack(key)
        if key[:ANCHOR_BYTES] != anchor:
            anchor, windows = key[:ANCHOR_BYTES], []
        score, name = MOST_SCORE - down, None if no_id else i - _LOW
        windows = [w for w in windows if w[2] < NEGATIVES and LEAST_PERCENT * w[1] <= 100 * score]
        if kind == 0:
            windows.append([name, score, 0])
            continue
        for w in windows:
            w[2] += 1
            yield a - _LOW, w[0], w[2], name, w[1], score


def mine(embeddings: DataFrame, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    spark = embeddings.sparkSession
    rows = usable(embeddings)
    mark = F.xxhash64("label", "vec")
    anchors = materialize(
        rows.where(F.col("vec_id") % ANCHOR_EVERY == 0).distinct().withColumn("mark", mark), "anchors"
    )
    size = F.sum(8 * F.size("vec") + 32)
    total, n_anchors = anchors.agg(size, F.count(F.lit(1))).first()
    slices = max(1, math.ceil((total or 0) / slice_bytes))
    tasks = math.ceil(rows.count() * n_anchors / slices / TASK_PAIRS)
    if tasks > spark.sparkContext.defaultParallelism:
        rows = materialize(rows.repartition(tasks), "spread-rows")
    keys = spark.createDataFrame([], "key binary")
    for k in range(slices):
        own = anchors.where(F.pmod(F.xxhash64("vec_id", "mark"), F.lit(slices)) == k)
        part = Anchors(own.collect())
        near = rows.mapInArrow(_send(spark.sparkContext.broadcast(part), 0), "key binary")
        firsts = _sorted_keys(near).mapPartitions(_firsts)
        firsts = materialize(spark.createDataFrame(firsts, "key binary", verifySchema=False), "positives")
        part.learn([bytes(r.key) for r in firsts.collect()])
        far = rows.mapInArrow(_send(spark.sparkContext.broadcast(part), 1), "key binary")
        keys = keys.union(materialize(firsts.union(far), "pair-keys"))
    found = _sorted_keys(keys).mapPartitions(emit)
    return spark.createDataFrame(found, _RESULT, verifySchema=False)
