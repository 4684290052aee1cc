"""Value conversions: the closed list a mapping may name, and per-target adaptation.

A conversion never raises. Where a value does not convert, the column is NULL and
`conversion_failed` is true, so the original can be kept beside the row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabletrust.functions import rules
from tabletrust.functions.predicates import FLOATING, INTEGRAL, NESTED, NUMERIC, is_number_text

TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)
#: A whole date, with or without a time of day and an offset.
ISO_MOMENT = (
    r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?\s?(Z|[+-]\d{2}(:?\d{2})?)?)?$"
)
#: Target type names, by the Spark type a copy stores them in; names not listed are left alone.
STORED_AS = {
    "boolean": ("BOOLEAN", "BOOL", "BIT"),
    "bigint": ("INT", "INTEGER", "BIGINT", "SMALLINT", "INT64"),
    "double": ("DOUBLE PRECISION", "DOUBLE", "REAL", "FLOAT", "FLOAT64"),
    "decimal": ("DECIMAL", "NUMERIC", "BIGNUMERIC"),
    "date": ("DATE",),
    "timestamp": ("TIMESTAMP", "TIMESTAMPTZ", "DATETIME", "DATETIME2"),
    "string": ("TEXT", "VARCHAR", "CHAR", "NVARCHAR", "STRING", "UUID", "JSON", "JSONB", "TIME"),
}


def as_text(c: Column, dtype: T.DataType) -> Column:
    return F.to_json(c) if isinstance(dtype, NESTED) else c.cast("string")


def iso_text(c: Column, dtype: T.DataType) -> Column:
    """ISO-8601 with a `T`; a fraction is written only when there is one."""
    if isinstance(dtype, T.DateType):
        return F.date_format(c, "yyyy-MM-dd")
    whole = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(c, "SSSSSS")
    return F.when(micros == "000000", whole).otherwise(F.concat(whole, F.lit("."), micros))


def to_boolean(c: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.BooleanType):
        return c
    return F.lower(F.trim(as_text(c, dtype))).isin(rules.TRUE_WORDS)


def to_float(c: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, NUMERIC + (T.BooleanType,)):
        return c.cast("double")
    text = F.trim(as_text(c, dtype))
    return F.when(is_number_text(text), text.try_cast("double"))


def to_int(c: Column, dtype: T.DataType) -> Column:
    """Truncates toward zero. Whole numbers are not taken through floating point."""
    if isinstance(dtype, INTEGRAL + (T.BooleanType,)):
        return c.cast("bigint")
    rounded = to_float(c, dtype).try_cast("bigint")
    if isinstance(dtype, NUMERIC):
        return rounded
    text = F.trim(as_text(c, dtype))
    return F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("bigint")).otherwise(rounded)


def parse_datetime(c: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, TEMPORAL):
        return c.cast("timestamp")
    text = F.trim(as_text(c, dtype))
    return F.when(text.rlike(ISO_MOMENT), F.try_to_timestamp(text))


def convert(c: Column, dtype: T.DataType, op: str | None) -> Column:
    """Apply a conversion by name; an unknown name passes the value through.

    Nested values that no conversion has flattened become JSON text.
    """
    op = (op or "").lower()
    if "boolean" in op or op == "to_bool":
        return to_boolean(c, dtype)
    if op in ("to_int", "to_integer"):
        return to_int(c, dtype)
    if op == "to_float":
        return to_float(c, dtype)
    if op in ("to_string", "to_text"):
        return as_text(c, dtype)
    if "datetime" in op or op == "parse_date":
        return parse_datetime(c, dtype)
    if op == "json_stringify":
        return json_text(c, dtype)
    return F.to_json(c) if isinstance(dtype, NESTED) else c


def json_text(c: Column, dtype: T.DataType) -> Column:
    """A JSON document: nested values as they are, text quoted, other scalars as written."""
    if isinstance(dtype, NESTED):
        return F.to_json(c)
    wrapped = F.to_json(F.struct(c.alias("v")))
    return F.when(c.isNotNull(), F.regexp_extract(wrapped, r'^\{"v":(.*)\}$', 1))


def stored_type(target_type: str | None) -> str | None:
    """The Spark type that a copy gives a column of this target type; None: as it comes."""
    wanted = (target_type or "").upper().strip()
    if wanted.startswith("TINYINT(1)"):
        return "boolean"
    name, _, size = wanted.partition("(")
    found = next((kind for kind, names in STORED_AS.items() if name.strip() in names), None)
    if found != "decimal":
        return found
    return f"decimal({size[:-1]})" if size.endswith(")") else "decimal(38,10)"


def store(c: Column, dtype: T.DataType, kind: str) -> Column:
    """A value as Spark type `kind`, NULL where it does not fit."""
    if kind == dtype.simpleString():
        return c
    if kind == "string":
        return iso_text(c, dtype) if isinstance(dtype, TEMPORAL) else as_text(c, dtype)
    if kind == "boolean":
        return to_boolean(c, dtype)
    if kind in ("date", "timestamp"):
        moment = c if isinstance(dtype, TEMPORAL) else parse_datetime(c, dtype)
        same = kind == "timestamp" and isinstance(dtype, T.TimestampNTZType)
        return moment if same else moment.try_cast(kind)
    if kind == "bigint":
        whole = to_int(c, dtype)
        if isinstance(dtype, INTEGRAL + (T.BooleanType,)):
            return whole
        return F.when(whole == to_float(c, dtype), whole)
    if kind == "double" or not isinstance(dtype, (T.StringType, *NUMERIC)):
        return to_float(c, dtype).try_cast(kind)
    text = F.trim(c) if isinstance(dtype, T.StringType) else c.cast("string")
    return F.when(is_number_text(text), text.try_cast(kind))


def conversion_failed(c: Column, dtype: T.DataType, op: str | None) -> Column:
    return c.isNotNull() & convert(c, dtype, op).isNull()


def coerce_to_target(c: Column, dtype: T.DataType, target_type: str | None) -> Column:
    """What the target's column type does to a value on top of the named conversion."""
    wanted = (target_type or "").upper()
    if "BOOL" in wanted and not isinstance(dtype, T.BooleanType):
        return to_boolean(c, dtype)
    if ("DECIMAL" in wanted or "NUMERIC" in wanted) and isinstance(dtype, FLOATING):
        return F.round(c, 2)
    if "INT" in wanted and "POINT" not in wanted and isinstance(dtype, T.StringType):
        digits = F.trim(c)
        return F.when(digits.rlike(r"^-*\d+$"), digits.try_cast("bigint"))
    return c


def adapt(c: Column, dtype: T.DataType, family: str) -> Column:
    """The form a family's sink accepts for a value of this type."""
    if isinstance(dtype, NESTED):
        return c if family in ("mongodb", "dynamodb") else F.to_json(c)
    if isinstance(dtype, T.DecimalType) and family in ("sqlite", "mongodb", "bigquery", "neo4j"):
        return c.cast("double")
    if isinstance(dtype, FLOATING) and family == "dynamodb":
        return c.cast("string").try_cast("decimal(38,10)")
    if isinstance(dtype, TEMPORAL):
        if family == "mongodb":
            return c.cast("timestamp")
        if family in ("sqlite", "bigquery", "dynamodb", "neo4j"):
            return iso_text(c, dtype)
    if isinstance(dtype, T.BooleanType) and family == "sqlite":
        return c.cast("int")
    if isinstance(dtype, T.BinaryType) and family in ("bigquery", "neo4j"):
        return F.decode(c, "UTF-8")
    if isinstance(dtype, T.StringType) and family == "dynamodb":
        return F.when(c != "", c)
    return c
