"""Quality classifier: a linear-chain conditional random field over the lines of a document.

Every line is good or bad. A line's evidence are counts on the line itself and on its two neighbours;
the chain ties a line's label to the next one's. Forward-backward gives each line's chance of being
good, and the mean over lines, weighted by their lengths, passed through a fitted logistic curve, is
the document's score. Labels are known for documents, so in training each line takes its document's
label. Training runs on the driver over a bounded, hashed sample of labelled documents (`MOST_DOCS`,
`MOST_LINES`); scoring runs inside the tasks over whole texts, all documents of a batch side by side.

Defined results: null and empty texts are one empty line and get a score. Without labelled rows, or
with one class only, every score is that class's share, or 0.5. Labels that repeat for a document
count once, the smallest; null labels are left out. Every input row gives one result row, also when
rows repeat. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tabletrust.llm.text import as_bytes, small_batches
from tabletrust.session import materialize

#: The fit reads at most so many labelled documents, and uses at most so many of their lines.
MOST_DOCS, MOST_LINES = 6_000, 300_000
#: A document with a larger share of these lines is left out of the fit.
SHARE_OF_LINES = 0.05
ROUNDS, RATE, PENALTY = 200, 0.1, 1e-3
FOLDS, HELD_OUT = 3, 1

_CLASSES = (
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b"#*$%&<>^~=+_\\",
    b"!?", b"|", b".,;:", b"\"'()[]{}/-@", bytes(range(0x80, 0x100)),
)
_BLANK = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
#: Of the line itself: shares of the byte classes, lengths, word figures, repetition, first and last.
N_OWN = len(_CLASSES) + 8


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of all lines, bytes per line, lines per text).

    Byte classes are counted for the whole batch at once; words line by line.
    """
    joined = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    ends = np.flatnonzero(joined == 10)
    starts = np.concatenate(([0], ends[:-1] + 1))
    sizes = ends - starts
    counts = np.array([t.count(b"\n") + 1 for t in texts], np.int64)
    own = np.zeros((len(ends), N_OWN))
    length = np.maximum(sizes, 1)
    for k, members in enumerate(_CLASSES):
        inside = np.zeros(256, bool)
        inside[list(members)] = True
        own[:, k] = np.add.reduceat(inside[joined], starts, dtype=np.int64) / length
    row = 0
    for text, n in zip(texts, counts.tolist()):
        seen: set[bytes] = set()
        for i, line in enumerate(text.split(b"\n")):
            words = line.split()
            own[row, -8] = len(words)
            own[row, -7] = len(set(words)) / len(words) if words else 1.0
            own[row, -6] = line in seen
            own[row, -5] = line[-1:] in (b".", b"!", b"?")
            own[row, -4] = i == 0
            own[row, -3] = i == n - 1
            seen.add(line)
            row += 1
    words = np.maximum(own[:, -8], 1)
    own[:, -2] = sizes / words
    own[:, -1] = np.log1p(sizes)
    own[:, -8] = np.log1p(own[:, -8])
    first = np.concatenate(([0], np.cumsum(counts)[:-1]))
    before, after = np.roll(own, 1, axis=0), np.roll(own, -1, axis=0)
    before[first] = 0
    after[first + counts - 1] = 0
    return np.hstack([own, before, after]), sizes + 1, counts


@dataclass
class Crf:
    """Weights of the chain, the features' scale, and the curve from line to document scores."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    moves: np.ndarray
    curve: tuple[float, float]
    share: float | None = None

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if self.share is not None:
            return np.full(len(texts), self.share)
        features, sizes, counts = line_features(texts)
        evidence = ((features - self.mean) / self.scale) @ self.weights + self.bias
        good, _ = chances(evidence, counts, self.moves)
        return _sigmoid(self.curve[0] * _logit(_weighted(good, sizes, counts)) + self.curve[1])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def _weighted(values: np.ndarray, sizes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    first = np.concatenate(([0], np.cumsum(counts)[:-1]))
    return np.add.reduceat(values * sizes, first) / np.add.reduceat(sizes, first)


def chances(
    evidence: np.ndarray, counts: np.ndarray, moves: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Each line's chance of being good, and per line the chances of its 4 moves to the next line.

    `evidence` is the log-odds of good, `moves[a, b]` the score of label b after label a. Documents
    advance side by side, longest first, so step t handles those with more than t lines.
    """
    first = np.concatenate(([0], np.cumsum(counts)[:-1]))
    order = np.argsort(-counts, kind="stable")
    starts, lengths = first[order], counts[order]
    left, right = np.zeros((len(evidence), 2)), np.zeros((len(evidence), 2))
    left[starts, 1] = evidence[starts]
    longest = int(lengths[0])
    active = np.searchsorted(-lengths, -np.arange(longest + 1), side="left")
    for t in range(1, longest):
        at = starts[: active[t]] + t
        was = left[at - 1]
        left[at, 0] = np.logaddexp(was[:, 0] + moves[0, 0], was[:, 1] + moves[1, 0])
        left[at, 1] = np.logaddexp(was[:, 0] + moves[0, 1], was[:, 1] + moves[1, 1]) + evidence[at]
    for t in range(longest - 2, -1, -1):
        at = starts[: active[t + 1]] + t
        ahead = right[at + 1] + np.stack([np.zeros(len(at)), evidence[at + 1]], axis=1)
        right[at, 0] = np.logaddexp(ahead[:, 0] + moves[0, 0], ahead[:, 1] + moves[0, 1])
        right[at, 1] = np.logaddexp(ahead[:, 0] + moves[1, 0], ahead[:, 1] + moves[1, 1])
    both = left + right
    total = np.logaddexp(both[:, 0], both[:, 1])
    good = np.exp(both[:, 1] - total)
    pairs = np.zeros((len(evidence), 2, 2))
    inner = np.ones(len(evidence), bool)
    inner[first + counts - 1] = False
    at = np.flatnonzero(inner)
    for a in (0, 1):
        for b in (0, 1):
            step = left[at, a] + moves[a, b] + right[at + 1, b] + (evidence[at + 1] if b else 0)
            pairs[at, a, b] = np.exp(step - total[at])
    return good, pairs


def fit_arrays(
    features: np.ndarray, sizes: np.ndarray, counts: np.ndarray, labels: np.ndarray
) -> Crf:
    """Maximum likelihood with a quadratic penalty, by Adam over the whole sample."""
    mean, scale = features.mean(axis=0), features.std(axis=0)
    scale[scale < 1e-9] = 1.0
    x = (features - mean) / scale
    y = np.repeat(labels, counts).astype(float)
    weight = np.repeat(1 / np.sqrt(counts), counts)
    weight /= weight.sum()
    inner = np.ones(len(y), bool)
    inner[np.cumsum(counts) - 1] = False
    seen = np.zeros((2, 2))
    for c in (0, 1):
        seen[c, c] = weight[inner & (y == c)].sum()
    theta, width = np.zeros(x.shape[1] + 5), x.shape[1]
    slow, fast = np.zeros_like(theta), np.zeros_like(theta)
    for k in range(1, ROUNDS + 1):
        moves = theta[width + 1 :].reshape(2, 2)
        good, pairs = chances(x @ theta[:width] + theta[width], counts, moves)
        miss = (good - y) * weight
        turns = (pairs * weight[:, None, None]).sum(axis=0) - seen
        slope = np.concatenate([miss @ x, [miss.sum()], turns.ravel()]) + PENALTY * theta
        slow, fast = 0.9 * slow + 0.1 * slope, 0.999 * fast + 0.001 * slope**2
        theta -= RATE * (slow / (1 - 0.9**k)) / (np.sqrt(fast / (1 - 0.999**k)) + 1e-8)
    moves = theta[width + 1 :].reshape(2, 2)
    good, _ = chances(x @ theta[:width] + theta[width], counts, moves)
    odds, curve = _logit(_weighted(good, sizes, counts)), np.array([1.0, 0.0])
    for _ in range(50):
        p = _sigmoid(curve[0] * odds + curve[1])
        slope = np.array([((p - labels) * odds).mean(), (p - labels).mean()]) + 1e-3 * curve
        h = p * (1 - p)
        bend = np.array([[(h * odds**2).mean(), (h * odds).mean()], [(h * odds).mean(), h.mean()]])
        curve = curve - np.linalg.solve(bend + 1e-3 * np.eye(2), slope)
    return Crf(mean, scale, theta[:width], float(theta[width]), moves, tuple(curve.tolist()))


def fit(
    docs: DataFrame, labels: DataFrame, most_docs: int = MOST_DOCS, most_lines: int = MOST_LINES
) -> Crf:
    """Fit on at most `most_docs` labelled documents outside the held-out fold, by hash order.

    Their texts are read in the tasks; only line figures come to the driver. Documents are taken by
    hash, whatever their length, until `most_lines` lines are used; a document that alone would use
    more than `SHARE_OF_LINES` of them is left out, so that no few texts make up the fit.
    """
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
        .where(~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.min("quality").cast("int").alias("label"))
        .join(docs.select("doc_id"), "doc_id", "left_semi")
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_docs)
    )
    longest = int(most_lines * SHARE_OF_LINES)
    texts = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")

    def figures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            features, sizes, counts = line_features(as_bytes(batch.column("text")))
            cuts = np.cumsum(counts)[:-1]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id"), "label": batch.column("label"),
                    "n": pa.array(counts, pa.int64()),
                    "x": pa.array(
                        [a.astype(np.float32).tobytes() if len(a) <= longest else b""
                         for a in np.split(features, cuts)], pa.binary(),
                    ),
                    "sizes": pa.array(
                        [a.astype(np.int32).tobytes() if len(a) <= longest else b""
                         for a in np.split(sizes, cuts)], pa.binary(),
                    ),
                }
            )

    sample = texts.mapInArrow(
        figures, "doc_id bigint, label int, n bigint, x binary, sizes binary"
    )
    sample = materialize(sample.where(F.col("n") <= longest), "labelled-lines")
    rows, lines = [], 0
    for r in sample.orderBy(F.xxhash64("doc_id"), "doc_id", "label", "x").toLocalIterator():
        if lines + r.n > most_lines:
            break
        rows.append(r)
        lines += r.n
    marks = np.array([r.label for r in rows], float)
    if not rows or marks.min() == marks.max():
        share = float(marks.mean()) if rows else 0.5
        nothing = np.zeros(3 * N_OWN)
        return Crf(nothing, nothing + 1, nothing, 0.0, np.zeros((2, 2)), (1.0, 0.0), share)
    x = np.concatenate([np.frombuffer(r.x, np.float32) for r in rows]).reshape(-1, 3 * N_OWN)
    sizes = np.concatenate([np.frombuffer(r.sizes, np.int32) for r in rows])
    counts = np.array([r.n for r in rows], np.int64)
    return fit_arrays(x.astype(float), sizes, counts, marks)


def score(docs: DataFrame, model: Crf) -> DataFrame:
    """Every input row's columns in struct `doc`, and its `score`."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("doc").field("text")
            place = pa.RecordBatch.from_arrays([texts, pa.array(range(len(texts)))], ["text", "i"])
            found = np.zeros(len(texts))
            for part in small_batches(iter([place]), "text"):
                at = part.column("i").to_numpy()
                found[at] = sent.value.scores(as_bytes(part.column("text")))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), pa.array(found, pa.float64())], ["doc", "score"]
            )

    rows = docs.select(F.struct("*").alias("doc"))
    return rows.mapInArrow(
        scores, StructType([rows.schema["doc"], StructField("score", DoubleType())])
    )


def good_documents(docs: DataFrame, model: Crf, least: float = 0.5) -> DataFrame:
    """`docs` with a score of at least `least`; all columns as they are."""
    return score(docs, model).where(F.col("score") >= least).select("doc.*")
