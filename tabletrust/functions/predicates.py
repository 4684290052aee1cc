"""Tests a single value can pass, as Boolean column expressions."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabletrust.functions import rules

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOATING = (T.FloatType, T.DoubleType)
NUMERIC = INTEGRAL + FLOATING + (T.DecimalType,)
NESTED = (T.ArrayType, T.MapType, T.StructType, T.VariantType)


# Each pattern is behind a cheap test that every match passes, so that most values never
# reach the regular expression.


def starts_below_colon(c: Column) -> Column:
    """First byte is a digit, a sign, a bracket or white space."""
    return c < ":"


def starts_with_digit(c: Column) -> Column:
    return (c >= "0") & (c < ":")


def may_be_date(c: Column) -> Column:
    """Every date format starts with a digit and has at least ten characters."""
    return starts_with_digit(c) & (F.length(c) >= 10)


def is_email(c: Column) -> Column:
    return c.contains("@") & c.rlike(rules.EMAIL)


def is_uuid(c: Column) -> Column:
    return F.length(c).between(36, 37) & c.rlike(rules.UUID)


def is_url(c: Column) -> Column:
    return c.startswith("http") & c.rlike(rules.URL)


def is_iso_date(c: Column) -> Column:
    return may_be_date(c) & c.rlike(rules.ISO_DATE)


def is_phone(c: Column) -> Column:
    """Phone-shaped, at least seven digits, and not a plain number.

    Every test is a regular expression of its own, reached only through those before it. An
    expression that is used twice, as a count of digits was, is computed ahead of them for every value.
    """
    short = starts_below_colon(c) & (F.octet_length(c) <= rules.PHONE_BYTES)
    return short & c.rlike(rules.PHONE) & c.rlike(rules.SEVEN_DIGITS) & c.rlike(r"\D")


def is_digits_4_10(c: Column) -> Column:
    return starts_with_digit(c) & c.rlike(rules.DIGITS_4_10)


def opens_json(c: Column) -> Column:
    """Could be a JSON object or array: a cheap gate in front of the real parse."""
    return c.startswith("{") | c.startswith("[") | ((c < "!") & c.rlike(r"^\s+[\[{]"))


@F.pandas_udf(T.BooleanType())
def parses_as_json(values: pd.Series) -> pd.Series:
    """Whole-text JSON parse. The built-in parsers accept trailing text, so they cannot say."""

    def parses(text: str | None) -> bool:
        if text is None:
            return False
        try:
            json.loads(text.strip())
        except (ValueError, RecursionError):
            return False
        return True

    return values.map(parses).astype(bool)


def in_epoch_seconds(c: Column) -> Column:
    return c.between(*rules.EPOCH_SECONDS)


def in_epoch_millis(c: Column) -> Column:
    return c.between(*rules.EPOCH_MILLIS)


def is_finite(c: Column) -> Column:
    value = c.cast("double")
    return ~F.isnan(value) & (F.abs(value) != F.lit(float("inf")))


def has_two_decimals(c: Column) -> Column:
    """Finite, and equal to itself rounded to two decimals.

    Below 1e13 the nearest cent is found with plain double arithmetic, which gives the same
    answer as decimal rounding at a fraction of its cost.
    """
    value = c.cast("double")
    cents = F.rint(value * 100) / 100 == value
    return is_finite(c) & F.when(F.abs(value) < 1e13, cents).otherwise(F.round(value, 2) == value)


def is_number_text(text: Column) -> Column:
    """Decimal notation, with or without an exponent, or a name for no finite number."""
    named = F.lower(text).isin("nan", "inf", "-inf", "infinity", "-infinity")
    return text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$") | named


def is_zero_or_one(c: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.BooleanType):
        return F.lit(True)
    if isinstance(dtype, NUMERIC):
        return c.isin(0, 1)
    if isinstance(dtype, T.StringType):
        return c.isin("0", "1")
    return F.lit(False)


def date_format_of(c: Column) -> Column:
    """Label of the first matching date format, else NULL."""
    label = F.lit(None).cast("string")
    for pattern, name in reversed(rules.DATE_FORMATS):
        label = F.when(c.rlike(pattern), name).otherwise(label)
    return F.when(may_be_date(c), label)


def is_sentinel_date(c: Column) -> Column:
    text = c.cast("string")
    return F.substring(text, 1, 19).isin(rules.SENTINEL_DATES) | F.substring(text, 1, 10).isin(
        rules.SENTINEL_DATES
    )


# Predicates on column names. They work on a catalog column and on a literal.


def name_matches(name: Column, pattern: str) -> Column:
    return name.rlike(f"(?i){pattern}")


def is_personal_name(name: Column) -> Column:
    return name_matches(name, rules.PII_NAME)


def first_label(text: Column, rows: list, pick: int = 1) -> Column:
    """`rows[i][pick]` of the first row whose pattern `rows[i][0]` is found in `text`."""
    label = F.lit(None).cast("string")
    for row in reversed(rows):
        label = F.when(text.rlike(f"(?i){row[0]}"), row[pick]).otherwise(label)
    return label


def personal_category(name: Column, semantic: Column) -> Column:
    return F.coalesce(first_label(name, rules.PII_CATEGORIES), semantic, F.lit("other"))


def finding_confidence(rows: Column, distinct: Column | None = None) -> Column:
    """0–100, growing with the rows seen; an enum's also with how often its values repeat."""
    size = F.least(F.lit(0.99), F.lit(0.5) + rows / F.lit(2000.0))
    if distinct is not None:
        repeat = F.lit(1.0) - distinct / F.greatest(rows, F.lit(1))
        size = F.least(F.lit(0.99), size * (F.lit(0.6) + F.lit(0.4) * repeat))
    return F.when(rows <= 0, 0).otherwise(F.round(100 * size).cast("int"))
