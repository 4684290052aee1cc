"""CSV and TSV files: clean headers, NULL words, one type per column."""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabletrust.functions import rules
from tabletrust.functions.predicates import is_number_text
from tabletrust.session import materialize

# Narrowest first.
LADDER = ["boolean", "bigint", "float", "string"]
#: Lines with more quotes are judged by their number alone: odd ones open or close a cell.
MOST_QUOTES = 1_000
SPARK_NAMES = {"boolean": "boolean", "bigint": "bigint", "float": "double", "string": "string"}


def cell_text(c: Column) -> Column:
    """Trimmed text; the NULL words become NULL."""
    text = F.trim(c)
    return F.when(~F.lower(text).isin(rules.NULL_WORDS), text)


def _quote_patterns(separator: str) -> tuple[str, str]:
    """Lines that end inside a quoted cell: those that begin outside one, and those that begin in one."""
    s = re.escape(separator)
    text = r'[^"]*+(?:""[^"]*+)*+'  # of a quoted cell; a doubled quote is a quote
    cells = rf'(?:(?:"{text}"[^{s}]*+|[^"{s}][^{s}]*+|){s})*+'
    return rf'^{cells}"{text}\z', rf'^{text}(?:\z|"[^{s}]*+{s}{cells}"{text}\z)'


def _quoted_lines(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """(file, block, line, opens, stays): the lines of all files, and what they do to quotes.

    A file is named by the hash of its path, a block by where its split of the file begins; a
    split's lines come in order, in one task.

    `opens`: a line that begins outside of a quoted cell ends inside one; `stays`: one that begins
    inside ends inside.
    """
    quotes = F.char_length("value") - F.char_length(F.replace("value", F.lit('"'), F.lit("")))
    outside, inside = (F.col("value").rlike(p) for p in _quote_patterns(separator))
    odd = quotes % 2 == 1
    return spark.read.text(path).select(
        F.xxhash64("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line"),
        F.when(quotes == 0, False).when(quotes > MOST_QUOTES, odd).otherwise(outside).alias("opens"),
        F.when(quotes == 0, True).when(quotes > MOST_QUOTES, ~odd).otherwise(inside).alias("stays"),
    )


class OpenQuoteError(ValueError):
    """A quoted cell that its file does not close."""


def _after(opens: np.ndarray, stays: np.ndarray, inside: bool) -> np.ndarray:
    """Whether each line ends inside a quoted cell, if the first begins `inside` one.

    A line that sets the state whatever came before decides, turned by every line after it that swaps
    inside and outside.
    """
    at = np.arange(len(opens))
    swaps = np.cumsum(opens & ~stays)
    last = np.maximum.accumulate(np.where(opens == stays, at, -1))
    since = swaps - np.where(last >= 0, swaps[last], 0)
    return np.where(last >= 0, opens[last], inside) ^ (since % 2 == 1)


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[int, int], int, int]]:
    """((file, block), start, end) of a batch's lines."""
    files, blocks = (batch.column(c).to_numpy() for c in ("file", "block"))
    cuts = np.flatnonzero((files[1:] != files[:-1]) | (blocks[1:] != blocks[:-1])) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(files)]):
        if b > a:
            yield (int(files[a]), int(blocks[a])), a, b


_EFFECT = "file bigint, block bigint, after_out boolean, after_in boolean, begun_out bigint, begun_in bigint"


def _effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each block does to the state it is entered with, and how many records begin in it then."""
    found: dict[tuple[int, int], list] = {}
    for batch in batches:
        opens, stays = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("opens", "stays"))
        for key, a, b in _runs(batch):
            now = found.setdefault(key, [False, True, 0, 0])
            for k in range(2):
                after = _after(opens[a:b], stays[a:b], now[k])
                now[2 + k] += int((~np.append(now[k], after[:-1])).sum())
                now[k] = bool(after[-1])
    names = [f.split()[0] for f in _EFFECT.split(", ")]
    rows = [dict(zip(names, (*key, *now))) for key, now in found.items()]
    if rows:
        yield pa.RecordBatch.from_pylist(rows)


_PIECES = "file bigint, block bigint, record bigint, part bigint, text string, whole boolean"


def _pieces(entered: Broadcast):
    """Records of each block; those that cross its ends as parts, named by where they begin.

    `entered` has the blocks that begin inside a cell, with the block and number of its record.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, inside, record, held, out = None, False, 0, [], []

        def close(whole: bool) -> None:
            if held:
                owner = (key[1], record) if record else entered.value[key]
                out.append((key[0], *owner, key[1], "\n".join(held), whole and record > 0))
                held.clear()

        for batch in batches:
            opens, stays = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("opens", "stays"))
            lines = batch.column("line").to_pylist()
            for now, a, b in _runs(batch):
                if now != key:
                    close(not inside)
                    key, inside, record = now, now in entered.value, 0
                after = _after(opens[a:b], stays[a:b], inside)
                starts = np.flatnonzero(~np.append(inside, after[:-1])) + a
                edges = [a, *starts.tolist(), b]
                held.extend(lines[a : edges[1]])
                for start, end in zip(edges[1:], edges[2:]):
                    close(True)
                    record += 1
                    held.extend(lines[start:end])
                inside = bool(after[-1])
            if out:
                yield _piece_batch(out)
                out.clear()
        close(not inside)
        if out:
            yield _piece_batch(out)

    return cut


def _piece_batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [f.split()[0] for f in _PIECES.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names)


def _records(lines: DataFrame) -> DataFrame:
    """(file, block, record, text) of lines that quoted cells may join.

    Each block of a file first reports what it does to the state it is entered with; a prefix over the
    blocks, one row each, gives every block its state; then all blocks are cut into records in
    parallel, and only records that cross blocks are put together by a shuffle. The driver gets
    three numbers for each block that begins inside a cell.
    """
    spark = lines.sparkSession
    blocks = materialize(
        lines.select("file", "block", "opens", "stays").mapInArrow(_effects, _EFFECT), "quoted-blocks"
    )
    order = Window.partitionBy("file").orderBy("block")
    to_here = order.rowsBetween(Window.unboundedPreceding, 0)
    swaps = F.sum((F.col("after_out") & ~F.col("after_in")).cast("bigint")).over(to_here)
    fixed = F.when(F.col("after_out") == F.col("after_in"), F.struct("after_out", "swaps"))
    blocks = blocks.withColumn("swaps", swaps)
    blocks = blocks.withColumn("fixed", F.last(fixed, ignorenulls=True).over(to_here))
    turned = (F.col("swaps") - F.coalesce("fixed.swaps", F.lit(0))) % 2 == 1
    blocks = blocks.withColumn("leaves", F.coalesce("fixed.after_out", F.lit(False)) != turned)
    blocks = blocks.withColumn("enters", F.lag("leaves", 1, False).over(order))
    blocks = blocks.withColumn("begun", F.when(F.col("enters"), F.col("begun_in")).otherwise(F.col("begun_out")))
    begins = F.when(F.col("begun") > 0, F.struct("block", "begun"))
    owner = F.last(begins, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    last = F.lead("block").over(order).isNull()
    blocks = materialize(blocks.withColumn("owner", owner).withColumn("last", last), "quoted-blocks")
    unclosed = blocks.where("last AND leaves").select("file").first()
    if unclosed:
        raise OpenQuoteError("a file ends inside a quoted cell")
    entered = {
        (r.file, r.block): (r.owner.block, r.owner.begun)
        for r in blocks.where("enters").select("file", "block", "owner").toLocalIterator()
    }
    pieces = lines.mapInArrow(_pieces(spark.sparkContext.broadcast(entered)), _PIECES)
    pieces = materialize(pieces, "record-pieces")
    parts = F.sort_array(F.collect_list(F.struct("part", "text")))
    joined = pieces.where("NOT whole").groupBy("file", "block", "record").agg(parts.alias("parts"))
    return pieces.where("whole").select("file", "block", "record", "text").unionByName(
        joined.select("file", "block", "record", F.array_join("parts.text", "\n").alias("text"))
    )


def _header(record: str, separator: str) -> list[str]:
    """Column names of a header record; missing and repeated ones get their number, as Spark gives."""
    cells = next(csv.reader([record], delimiter=separator), [])
    low = [c.lower() for c in cells]
    return [
        f"_c{i}" if not c else f"{c}{i}" if low.count(c.lower()) > 1 else c for i, c in enumerate(cells)
    ]


def read_delimited(
    spark: SparkSession, path: str, separator: str | None = None, multi_line: bool = True
) -> DataFrame:
    """All cells as cleaned text. Header names are trimmed; blank rows are dropped.

    Quoted cells may hold line breaks, in files of any number of splits. Where no line opens a cell
    that it does not close, lines are read as records. Without `multi_line` such a line is an error.
    """
    separator = separator or ("\t" if path.lower().endswith(".tsv") else ",")
    lines = _quoted_lines(spark, path, separator)
    broken = lines.where("opens").select("file").limit(1).collect()
    if broken and not multi_line:
        raise OpenQuoteError(f"a line in {path} ends inside a quoted cell")
    if not broken:
        raw = spark.read.csv(path, header=True, sep=separator, quote='"', escape='"')
        names = raw.columns
    else:
        records = _records(lines)
        first = (F.col("block") == 0) & (F.col("record") == 1)
        # The header of the first file by its path, as of Spark's own reader.
        paths = spark.read.text(path).select(F.col("_metadata.file_path").alias("path")).distinct()
        heads = records.where(first).join(paths.withColumn("file", F.xxhash64("path")), "file")
        names = _header(heads.orderBy("path").select("text").first().text, separator)
        cells = ", ".join(f"c{i} string" for i in range(len(names)))
        options = {"sep": separator, "quote": '"', "escape": '"', "maxCharsPerColumn": "-1"}
        raw = records.where(~first).select(F.from_csv("text", cells, options).alias("cells")).select("cells.*")
    names = [c.lstrip("\ufeff").strip() for c in names]
    raw = raw.toDF(*names)
    filled = reduce(
        lambda a, b: a | b, [F.coalesce(F.trim(f"`{c}`") != "", F.lit(False)) for c in names]
    )
    return raw.where(filled).select(*[cell_text(F.col(f"`{c}`")).alias(c) for c in names])


def _fits(c: Column, rung: str) -> Column:
    if rung == "boolean":
        return F.lower(c).isin("true", "false")
    if rung == "bigint":
        return c.rlike(r"^[+-]?\d+$") & c.try_cast("bigint").isNotNull()
    if rung == "float":
        return is_number_text(c)
    return F.lit(True)


def column_types(df: DataFrame) -> DataFrame:
    """(column, canonical_type): the narrowest type every non-null cell fits, in one pass.

    An all-null column is a string.
    """
    flags = []
    for i, name in enumerate(df.columns):
        c = F.col(f"`{name}`")
        flags.append(F.count(c).alias(f"{i}:n"))
        flags += [F.count_if(_fits(c, rung)).alias(f"{i}:{rung}") for rung in LADDER[:-1]]
    cells = []
    for i, name in enumerate(df.columns):
        n = F.col(f"{i}:n")
        fitting = F.lit("string")
        for rung in reversed(LADDER[:-1]):
            fitting = F.when((n > 0) & (F.col(f"{i}:{rung}") == n), rung).otherwise(fitting)
        cells.append(F.struct(F.lit(name).alias("column"), fitting.alias("canonical_type")))
    return df.agg(*flags).select(F.inline(F.array(*cells)))


def typed(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Cast text columns to the types found by `column_types`."""
    return df.select(
        *[F.col(f"`{c}`").try_cast(SPARK_NAMES[types[c]]).alias(c) for c in df.columns]
    )
