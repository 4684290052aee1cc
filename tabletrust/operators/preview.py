"""What a mapping would change, cell by cell, without touching any target."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabletrust.functions import conversions as C
from tabletrust.functions import predicates as P
from tabletrust.functions import rules
from tabletrust.operators.mapping import ColumnMap


def _shape(dtype: T.DataType) -> str:
    """How a value is compared: as a Boolean, a number, a nested value, or its text."""
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, P.INTEGRAL + P.FLOATING):
        return "number"
    return "nested" if isinstance(dtype, P.NESTED) else "text"


def _differs(before: Column, old: T.DataType, after: Column, new: T.DataType) -> Column:
    """1 and 1.0 are equal; 1 and true, and 1 and '1', are not. NULL stays NULL."""
    a, b = _shape(old), _shape(new)
    if a != b or a == "nested":
        return before.isNotNull() & after.isNotNull()
    if a == "text":
        return before.cast("string") != after.cast("string")
    if isinstance(old, P.INTEGRAL) and isinstance(new, P.INTEGRAL):
        return before != after
    return before.cast("double") != after.cast("double") if a == "number" else before != after


def change_preview(df: DataFrame, columns: list[ColumnMap], key: list[str]) -> DataFrame:
    """Per row: the key columns, `source`, `transformed`, and `changed_columns`.

    A value that does not convert is kept by the copy's rejects table, so it counts as
    unchanged here.
    """
    mapped = [m for m in columns if m.source in df.columns]
    types = {f.name: f.dataType for f in df.schema.fields}
    first = df.select(
        *[F.col(k).alias(f"k{i}") for i, k in enumerate(key)],
        *[F.col(f"`{m.source}`").alias(f"b{i}") for i, m in enumerate(mapped)],
        *[
            C.convert(F.col(f"`{m.source}`"), types[m.source], m.transformation).alias(f"m{i}")
            for i, m in enumerate(mapped)
        ],
    )
    mid = {f.name: f.dataType for f in first.schema.fields}
    second = first.select(
        "*",
        *[
            C.coerce_to_target(F.col(f"m{i}"), mid[f"m{i}"], m.target_type).alias(f"a{i}")
            for i, m in enumerate(mapped)
        ],
    )
    end = {f.name: f.dataType for f in second.schema.fields}
    changed = [
        F.when(_differs(F.col(f"b{i}"), end[f"b{i}"], F.col(f"a{i}"), end[f"a{i}"]), m.target)
        for i, m in enumerate(mapped)
    ]
    return second.select(
        *[F.col(f"k{i}").alias(k) for i, k in enumerate(key)],
        F.struct(*[F.col(f"b{i}").alias(m.source) for i, m in enumerate(mapped)]).alias("source"),
        F.struct(*[F.col(f"a{i}").alias(m.target) for i, m in enumerate(mapped)]).alias("transformed"),
        F.array_compact(F.array(*changed)).alias("changed_columns"),
    )


def preview_rows(preview: DataFrame, key: list[str], rows: int = rules.PREVIEW_ROWS) -> DataFrame:
    """The rows shown to a person; the totals come from `change_summary`, over all rows."""
    return preview.orderBy(*key).limit(rows)


def change_summary(preview: DataFrame) -> DataFrame:
    return preview.agg(
        F.count(F.lit(1)).alias("rows_simulated"),
        F.count_if(F.size("changed_columns") > 0).alias("rows_with_changes"),
    )


def changes_per_column(preview: DataFrame) -> DataFrame:
    return (
        preview.select(F.explode("changed_columns").alias("column"))
        .groupBy("column")
        .agg(F.count(F.lit(1)).alias("rows_changed"))
    )
