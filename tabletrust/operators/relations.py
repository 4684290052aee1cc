"""How tables hang together: undeclared foreign keys, orphans, load order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabletrust.functions import rules
from tabletrust.functions.predicates import INTEGRAL
from tabletrust.operators import peeling
from tabletrust.session import materialize
from tabletrust.sources.catalog import Declared

CANDIDATE_SCHEMA = (
    "child int, table string, column string, parent int, ref_table string, ref_column string, "
    "name_match boolean"
)


#: The type in which the values of a class are counted, and bytes of rows that a task counts at once.
VALUE_TYPES, COUNTED_BYTES = {"integer": "bigint", "string": "string"}, 64 << 20
_COUNTED = pa.schema(
    [("child", pa.int32()), ("integer", pa.int64()), ("string", pa.string()), ("n", pa.int64())]
)


def _class(dtype: T.DataType) -> str | None:
    """Only values of one class can be equal: 1 and '1' are different."""
    if isinstance(dtype, INTEGRAL):
        return "integer"
    return "string" if isinstance(dtype, T.StringType) else None


def _stem(name: str) -> str:
    return name.lower().rstrip("s")


def reference_matches(
    tables: dict[str, DataFrame],
    declared: dict[str, Declared],
    suffixes: tuple[str, ...] = ("_id",),
) -> DataFrame:
    """Every (undeclared column, other table's key) pair with the share of rows that match.

    Column values are first reduced to (value, count), keys to (value, tables holding it); both
    meet on the value in one grouping. Each table is scanned once. A value that fills a third of a column is one row by
    then, and a group holds at most one entry per candidate column and per table. The rows of a column
    are summed for each set of tables that hold a value, and only these few sums are dealt out to the
    tables: columns of dense numbers meet many tables in every value, but in few different sets.
    """
    spark = next(iter(tables.values())).sparkSession
    parents, children = [], []
    for table, df in tables.items():
        says = declared.get(table, Declared())
        known = {fk[0] for fk in says.foreign_keys}
        for f in df.schema.fields:
            cls = _class(f.dataType)
            if cls is None:
                continue
            if says.key == (f.name,):
                parents.append((table, f.name, cls))
            if f.name.lower().endswith(suffixes) and f.name not in known:
                children.append((table, f.name, cls))

    held = spark.createDataFrame([], "cls string, value string, parent int")
    for j, (table, c, cls) in enumerate(parents):
        value = F.col(f"`{c}`").cast("string")
        own = tables[table].select(F.lit(cls).alias("cls"), value.alias("value"), F.lit(j).alias("parent"))
        held = held.unionAll(own.where("value IS NOT NULL"))
    used = spark.createDataFrame([], "cls string, value string, child int, n bigint")
    for table in dict.fromkeys(t for t, _, _ in children):
        own = [(i, c, cls) for i, (t, c, cls) in enumerate(children) if t == table]
        used = used.unionAll(value_counts(tables[table], own))
    nothing = F.lit(None).cast("int")
    met = (
        used.select("cls", "value", F.struct("child", "n").alias("use"), nothing.alias("parent"))
        .unionAll(
            held.select("cls", "value", F.lit(None).cast("struct<child:int,n:bigint>"), "parent")
        )
        .groupBy("cls", "value")
        .agg(
            F.collect_list("use").alias("uses"),
            F.sort_array(F.collect_set("parent")).alias("parents"),
        )
        .where(F.size("uses") > 0)
    )
    # Parent -1 stands for all rows of the column.
    sums = (
        met.select("parents", F.explode("uses").alias("use"))
        .groupBy("use.child", "parents")
        .agg(F.sum("use.n").alias("n"))
        .select("child", "n", F.explode(F.array_append("parents", -1)).alias("parent"))
        .groupBy("child", "parent")
        .agg(F.sum("n").alias("rows"))
        .groupBy("child")
        .agg(F.map_from_entries(F.collect_list(F.struct("parent", "rows"))).alias("rows_of"))
    )
    pairs = spark.createDataFrame(
        [
            (i, ct, cc, j, pt, pc, _stem(pt) == _stem(_without_suffix(cc, suffixes)))
            for i, (ct, cc, _) in enumerate(children)
            for j, (pt, pc, _) in enumerate(parents)
            if ct != pt
        ],
        CANDIDATE_SCHEMA,
    )
    return (
        pairs.join(sums, "child")
        .withColumn("rows", F.coalesce(F.try_element_at("rows_of", "parent"), F.lit(0)))
        .withColumn("total", F.element_at("rows_of", -1))
        .drop("rows_of")
        .withColumn("share", F.col("rows") / F.col("total"))
        .withColumn("match_pct", F.round(100.0 * F.col("rows") / F.col("total"), 1))
    )


def value_counts(df: DataFrame, columns: list[tuple[int, str, str]]) -> DataFrame:
    """(cls, value, child, n): the distinct values of columns (number, name, class), with their rows.

    Tasks count some rows of a column at once, before each value is a row of its own. Values keep
    their type until all are counted, so a number becomes text once and not in every row.
    """
    cells = [F.col(f"`{c}`").cast(VALUE_TYPES[cls]).alias(f"v{k}") for k, (_, c, cls) in enumerate(columns)]
    numbers, classes = [i for i, _, _ in columns], [cls for _, _, cls in columns]

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= COUNTED_BYTES:
                yield from counts(held)
                held, size = [], 0
        if held:
            yield from counts(held)

    def counts(held: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
        rows, parts = pa.Table.from_batches(held), []
        for child, cls, column in zip(numbers, classes, rows.columns):
            found = column.value_counts()
            values = {cls: found.field("values"), "n": found.field("counts")}
            child = pa.array([child], pa.int32()).take(pa.array(np.zeros(len(found), np.int32)))
            empty = pa.nulls(len(found))
            own = [values.get(f.name, empty).cast(f.type) for f in _COUNTED if f.name != "child"]
            parts.append(pa.table([child, *own], schema=_COUNTED))
        return pa.concat_tables(parts).combine_chunks().to_batches()

    counted = df.select(*cells).mapInArrow(tally, "child int, integer bigint, string string, n bigint")
    total = (
        counted.where("integer IS NOT NULL OR string IS NOT NULL")
        .groupBy("child", "integer", "string").agg(F.sum("n").alias("n"))
    )
    cls = F.when(F.col("integer").isNotNull(), "integer").otherwise("string")
    value = F.coalesce(F.col("integer").cast("string"), "string")
    return total.select(cls.alias("cls"), value.alias("value"), "child", "n")


def _without_suffix(name: str, suffixes: tuple[str, ...]) -> str:
    low = name.lower()
    return next((low[: -len(s)] for s in suffixes if low.endswith(s)), low)


def implicit_foreign_keys(
    tables: dict[str, DataFrame],
    declared: dict[str, Declared],
    suffixes: tuple[str, ...] = ("_id",),
) -> DataFrame:
    """The best undeclared reference of each column, where at least 95 % of its rows match."""
    return best_reference(
        reference_matches(tables, declared, suffixes).where(F.col("share") >= rules.MATCH_SHARE)
    )


def best_reference(candidates: DataFrame) -> DataFrame:
    """Walk the candidates in catalog order. One replaces the best so far when it has the name
    match the best lacks, or matches more. The rule depends on order, so it is a fold."""
    best = F.aggregate(
        F.array_sort(
            F.collect_list(F.struct("parent", "ref_table", "ref_column", "match_pct", "name_match"))
        ),
        F.lit(None).cast(
            "struct<parent:int,ref_table:string,ref_column:string,match_pct:double,"
            "name_match:boolean>"
        ),
        _better,
    )
    return (
        candidates.groupBy("table", "column")
        .agg(best.alias("best"))
        .select(
            "table",
            "column",
            F.concat("best.ref_table", F.lit("."), "best.ref_column").alias("likely_references"),
            "best.match_pct",
            "best.name_match",
        )
    )


def _better(best: Column, other: Column) -> Column:
    wins = (
        best.isNull()
        | (other["name_match"] & ~best["name_match"])
        | (other["match_pct"] > best["match_pct"])
    )
    return F.when(wins, other).otherwise(best)


def _comparable(a: T.DataType, b: T.DataType) -> bool:
    """Whether values of both types can be equal; text never equals a number or a time."""
    kinds = (T.NumericType, T.StringType, T.BooleanType, T.BinaryType, T.DatetimeType)
    return next((isinstance(b, k) for k in kinds if isinstance(a, k)), a == b)


def orphans(child: DataFrame, column: str, parent: DataFrame, ref_column: str) -> DataFrame:
    """(value, n): non-null values of `column` that `parent` does not hold, with their rows.

    The child is reduced to distinct values first. That grouping already has the
    distribution the join needs, so a hot value costs nothing and no shuffle is added. Where
    the types cannot be equal, every value is an orphan.
    """
    values = child.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value"))
    values = values.agg(F.count(F.lit(1)).alias("n"))
    if not _comparable(child.schema[column].dataType, parent.schema[ref_column].dataType):
        return values
    return values.join(parent.select(F.col(ref_column).alias("value")), "value", "left_anti")


def load_order(tables: DataFrame, foreign_keys: DataFrame) -> DataFrame:
    """Parents before children: level, position, and drop position of every table.

    `tables(table)`, `foreign_keys(table, ref_table)`. A table's level is the longest chain of
    references below it. Self references are ignored; tables on or below a cycle go last, with
    level -1 and `in_cycle`, and `on_cycle` marks those on one. Drop positions run the other way.
    """
    nodes = materialize(tables.select(F.col("table").alias("node")).distinct(), "tables")
    links = foreign_keys.select(F.col("table").alias("node"), F.col("ref_table").alias("to"))
    links = peeling.inside(links.where("node <> to").distinct(), nodes)
    links = materialize(links, "table-links")
    found = materialize(peeling.levels(nodes, links), "table-levels")
    on_cycle = peeling.on_cycles_of_stuck(found, links).withColumn("on_cycle", F.lit(True))
    rows = found.join(on_cycle, "node", "left").select(
        F.col("node").alias("table"), F.coalesce("level", F.lit(-1)).cast("int").alias("level"),
        F.col("level").isNull().alias("in_cycle"),
        F.coalesce("on_cycle", F.lit(False)).alias("on_cycle"),
    )
    placed = peeling.numbered(rows, ["in_cycle", "level", "table"], "load_position")
    last = F.lit(found.count()) + 1
    return placed.withColumn("drop_position", (last - F.col("load_position")).cast("int"))
