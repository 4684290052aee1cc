"""Small helpers that the text operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: ASCII white space: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def lines_of(text: Column) -> Column:
    """The text split at line feeds; null is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def text_mark(text: Column) -> Column:
    """Tells rows of one doc_id with different texts apart; never null."""
    return F.xxhash64(text)


def small_batches(
    batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20
) -> Iterator[pa.RecordBatch]:
    """The batches cut into pieces of about `most` bytes of text; a longer text stands alone.

    After the last piece, what the task used goes back to the system.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = held = 0
        for i, size in enumerate(sizes):
            if i > start and held + size > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        yield batch.slice(start)
    give_back()


def give_back() -> None:
    """Hand freed memory to the system. Python workers outlive their tasks, and would keep the most
    that any of them used while the tasks of other stages need room beside them."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def gives_back(f: Callable) -> Callable:
    """`f`, a function of one or two tables of a group, with `give_back` after each group."""

    def done(out: pa.Table) -> pa.Table:
        give_back()
        return out

    if f.__code__.co_argcount == 1:
        return lambda rows: done(f(rows))
    return lambda rows, others: done(f(rows, others))


def as_bytes(texts: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    kind = pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary()
    return [x or b"" for x in texts.cast(kind).to_pylist()]


def as_texts(texts: pa.Array) -> list[str]:
    return [x or "" for x in texts.to_pylist()]
