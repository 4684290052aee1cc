"""Documents dealt into chunks of bounded size, and sorted keys exchanged between chunks and buckets.

Some operators must know which of billions of keys (word n-grams, byte windows) occur more than once,
and bring the answer back to the documents. One shuffled row per key would cost many times the text.
Here a chunk of documents sends each range of the key space one packed row with its distinct keys;
the range answers with packed rows to the chunks. Packing also combines a chunk's copies of a
frequent key into one, so a key that a third of all documents hold costs one entry per chunk.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabletrust.llm.text import as_bytes, gives_back, text_mark

#: Least and most text of a chunk, and text whose keys make one range of the key space. Packed rows
#: number chunks times ranges; a chunk grows with the square root of the input so that rows stay long.
#: A task needs some 20 times its chunk, so the most is a matter of executor memory.
CHUNK_BYTES, MOST_CHUNK_BYTES, BUCKET_BYTES = 4 << 20, 64 << 20, 8 << 20
#: Input whose chunks are of the least size.
LEAST_INPUT = 512 << 20
#: Keys are compared by their upper 48 bits when they are only counted.
KEY_BITS = 48


def text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def chunk_count(total: int, least: int = CHUNK_BYTES) -> int:
    """Chunks for `total` bytes of text."""
    size = min(MOST_CHUNK_BYTES, least * math.sqrt(max(1, total / LEAST_INPUT)))
    return max(1, math.ceil(total / size))


def chunked(docs: DataFrame, n: int) -> DataFrame:
    """(chunk, doc_id, text) in `n` partitions; a row's chunk depends on its id and text alone."""
    chunk = F.pmod(F.xxhash64("doc_id", text_mark(F.col("text"))), F.lit(n)).cast("int")
    rows = docs.select(chunk.alias("chunk"), F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.repartition(n, "chunk")


def range_count(total: int, size: int = BUCKET_BYTES) -> int:
    """Ranges of keys for `total` bytes of text."""
    return max(1, total // size)


def bucket_starts(keys: np.ndarray, n_buckets: int) -> np.ndarray:
    """Where each bucket's range begins in sorted 48-bit `keys`; one more entry for the end."""
    width = (1 << KEY_BITS) // n_buckets + 1
    edges = np.arange(n_buckets + 1, dtype=np.uint64) * np.uint64(width)
    return np.searchsorted(keys, edges)


def pack(keys: np.ndarray) -> bytes:
    """Sorted distinct keys as differences of four bytes, or as they are where one is too large."""
    steps = np.diff(keys)
    if len(keys) and (not len(steps) or steps.max() < 1 << 32):
        return b"\x04" + keys[:1].tobytes() + steps.astype(np.uint32).tobytes()
    return b"\x08" + keys.astype(np.uint64).tobytes()


def unpack(data: bytes) -> np.ndarray:
    if data[:1] == b"\x08":
        return np.frombuffer(data, np.uint64, offset=1)
    first = np.frombuffer(data, np.uint64, 1, 1)
    steps = np.frombuffer(data, np.uint32, offset=9).astype(np.uint64)
    return np.concatenate((first, steps)).cumsum(dtype=np.uint64)


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted, each value once."""
    values = np.sort(values)
    return values[starts_of(values)]


def starts_of(values: np.ndarray) -> np.ndarray:
    """Where a new value starts in sorted `values`, as a mask."""
    return np.concatenate((np.ones(min(1, len(values)), bool), values[1:] != values[:-1]))


def short(keys: np.ndarray) -> np.ndarray:
    """The bits of 64-bit keys that are counted."""
    return keys >> np.uint64(64 - KEY_BITS)


def table_of(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def sql_type(schema: pa.Schema) -> str:
    names = {
        pa.int32(): "int", pa.int64(): "bigint", pa.binary(): "binary",
        pa.list_(pa.int64()): "array<bigint>",
    }
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def texts_of(rows: pa.Table) -> list[bytes]:
    return [b for part in rows.column("text").chunks for b in as_bytes(part)]


_SENT = pa.schema(
    [("bucket", pa.int32()), ("chunk", pa.int32()), ("keys", pa.binary()), ("more", pa.binary()),
     ("times", pa.binary())]
)
_SHARED = pa.schema([("chunk", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])


def shared_keys(
    texts: DataFrame, n_buckets: int, keys_of: Callable[[list[bytes]], Iterable[np.ndarray]]
) -> DataFrame:
    """(chunk, keys, counts): of each chunk's keys those that at least two documents have.

    `keys_of` gives each document's distinct 64-bit keys. Counts are numbers of documents.
    """

    def send(rows: pa.Table) -> pa.Table:
        keys = np.sort(short(np.concatenate([*keys_of(texts_of(rows)), np.zeros(0, np.uint64)])))
        new = np.flatnonzero(starts_of(keys))
        times = np.diff(np.append(new, len(keys)))
        keys = keys[new]
        edges = bucket_starts(keys, n_buckets)
        chunk = rows.column("chunk")[0].as_py()
        out = []
        for b in np.flatnonzero(np.diff(edges)).tolist():
            own, many = keys[edges[b] : edges[b + 1]], times[edges[b] : edges[b + 1]]
            more = np.flatnonzero(many > 1).astype(np.uint32)
            out.append((b, chunk, pack(own), more.tobytes(), many[more].astype(np.uint32).tobytes()))
        return table_of(out, _SENT)

    sent = texts.groupBy("chunk").applyInArrow(gives_back(send), sql_type(_SENT))
    return sent.groupBy("bucket").applyInArrow(gives_back(_answer), sql_type(_SHARED))


def _answer(rows: pa.Table) -> pa.Table:
    """One range's keys of all chunks, sorted together; each chunk hears which of its keys are shared."""
    parts = []
    packed = (rows.column(c).to_pylist() for c in ("keys", "more", "times"))
    for i, (keys, more, many) in enumerate(zip(*packed)):
        own = unpack(keys)
        times = np.ones(len(own), np.int64)
        times[np.frombuffer(more, np.uint32)] = np.frombuffer(many, np.uint32)
        parts.append((own, times, np.full(len(own), i, np.uint32)))
    keys, times, owner = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(keys, kind="stable")
    keys, times, owner = keys[order], times[order], owner[order]
    new = np.flatnonzero(starts_of(keys))
    total = np.repeat(np.add.reduceat(times, new), np.diff(np.append(new, len(keys))))
    keys, owner, total = keys[total > 1], owner[total > 1], total[total > 1]
    order = np.argsort(owner, kind="stable")
    keys, owner, total = keys[order], owner[order], np.minimum(total[order], (1 << 32) - 1)
    edges = np.searchsorted(owner, np.arange(rows.num_rows + 1)).tolist()
    chunk = rows.column("chunk").to_pylist()
    out = [
        (chunk[i], pack(keys[a:b]), total[a:b].astype(np.uint32).tobytes())
        for i, (a, b) in enumerate(zip(edges, edges[1:]))
        if b > a
    ]
    return table_of(out, _SHARED)


def known_keys(shared: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """All shared keys of one chunk, sorted, with their counts."""
    parts = [
        (unpack(k), np.frombuffer(n, np.uint32))
        for k, n in zip(shared.column("keys").to_pylist(), shared.column("counts").to_pylist())
    ]
    parts.sort(key=lambda x: int(x[0][0]))
    keys = np.concatenate([np.zeros(0, np.uint64), *(k for k, _ in parts)])
    return keys, np.concatenate([np.zeros(0, np.uint32), *(n for _, n in parts)])


def found_in(values: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of `values` are among sorted `keys`."""
    if not len(keys):
        return np.zeros(len(values), bool)
    return keys[np.minimum(np.searchsorted(keys, values), len(keys) - 1)] == values
