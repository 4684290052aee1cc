"""Row hashes that are equal when two rows hold the same values, also in different types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabletrust.functions.conversions import TEMPORAL, iso_text
from tabletrust.functions.predicates import FLOATING, INTEGRAL, NESTED


def canonical_text(c: Column, dtype: T.DataType) -> Column:
    """One spelling per value: true = 1, 86.20 = 86.2, 3.0 = 3, a timestamp = its ISO text."""
    if isinstance(dtype, T.BooleanType):
        return F.when(c, "1").otherwise("0")
    if isinstance(dtype, TEMPORAL):
        return iso_text(c, dtype)
    if isinstance(dtype, INTEGRAL):
        return c.cast("string")
    if isinstance(dtype, FLOATING + (T.DecimalType,)):
        value = c.cast("double")
        whole = (value == F.floor(value)) & (F.abs(value) < 1e15)
        return F.when(whole, value.try_cast("bigint").cast("string")).otherwise(
            value.cast("string")
        )
    if isinstance(dtype, NESTED):
        return F.to_json(c)
    return c.cast("string")


def row_hash(df: DataFrame, columns: list[str]) -> Column:
    """SHA-256 over the columns in order.

    Each part carries its length, and NULL has its own mark, so neighbouring values cannot
    run together and NULL differs from the empty string.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    parts = []
    for name in columns:
        c = F.col(f"`{name}`")
        text = canonical_text(c, types[name])
        sized = F.concat(F.length(text).cast("string"), F.lit(":"), text)
        parts.append(F.when(c.isNull(), "~").otherwise(sized))
    return F.sha2(F.concat_ws("|", *parts), 256)


def shared_types(left: DataFrame, right: DataFrame, columns: list[str]) -> set[str]:
    """Columns whose values can be hashed as they are, because both sides store one type."""
    a = {f.name: f.dataType for f in left.schema.fields}
    b = {f.name: f.dataType for f in right.schema.fields}
    return {c for c in columns if a[c] == b[c] and not isinstance(a[c], NESTED)}


def fingerprint(df: DataFrame, columns: list[str], as_is: set[str]) -> tuple[Column, Column]:
    """A 128-bit hash of a row as two bigints, for grouping rows by content inside Spark.

    Values of `as_is` columns are hashed in their own type, which avoids text altogether; the
    others by their canonical text. The NULL positions are part of the hash.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    parts = []
    for name in columns:
        c = F.col(f"`{name}`")
        parts.append(c.isNull())
        if name not in as_is:
            parts.append(F.when(c.isNotNull(), canonical_text(c, types[name])))
        elif isinstance(types[name], FLOATING):
            parts.append(c + F.lit(0.0))
        else:
            parts.append(c)
    return F.xxhash64(*parts), F.xxhash64(F.lit("second"), *parts)
