"""Faults in a dataset: each finding is a row (severity, kind, table, column, hits, rows)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabletrust.functions import predicates as P
from tabletrust.functions import rules
from tabletrust.operators.relations import orphans
from tabletrust.session import materialize
from tabletrust.sources.catalog import Declared, row_counts

ISSUE_SCHEMA = (
    "severity string, kind string, table string, column string, value string, hits bigint, "
    "rows bigint, examples string"
)
EXAMPLES = 3
CHECKS_PER_PASS = 60


def _columns(df: DataFrame) -> list[tuple[str, T.DataType]]:
    return [(f.name, f.dataType) for f in df.schema.fields]


def value_faults(df: DataFrame, table: str, declared: Declared) -> DataFrame:
    """Empty strings in NOT NULL columns and frequent numeric sentinels.

    All checks are counters. Wide tables are counted in groups of columns, each of which reads
    its own columns only.
    """
    checks = []  # (severity, kind, column, value, condition, smallest share that counts)
    strict = set(declared.key) | set(declared.not_null)
    for name, dtype in _columns(df):
        c = F.col(f"`{name}`")
        if isinstance(dtype, T.StringType) and name in strict:
            checks.append(("medium", "empty_string_in_not_null", name, "", c == "", 0.0))
        if isinstance(dtype, P.INTEGRAL + P.FLOATING + (T.DecimalType,)):
            for number in rules.SENTINEL_NUMBERS:
                checks.append(
                    ("low", "numeric_sentinel", name, str(number), c == number, rules.SENTINEL_SHARE)
                )
    empty = df.sparkSession.createDataFrame([], ISSUE_SCHEMA)
    parts = [
        _count_checks(df, table, checks[i : i + CHECKS_PER_PASS])
        for i in range(0, len(checks), CHECKS_PER_PASS)
    ]
    return reduce(DataFrame.unionAll, parts) if parts else empty


def _count_checks(df: DataFrame, table: str, checks: list[tuple]) -> DataFrame:
    counted = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(check[4]).alias(f"hits_{i}") for i, check in enumerate(checks)],
    )
    rows = [
        F.struct(
            F.lit(severity).alias("severity"),
            F.lit(kind).alias("kind"),
            F.lit(column).alias("column"),
            F.lit(value).alias("value"),
            F.col(f"hits_{i}").alias("hits"),
            F.lit(share).alias("share"),
        )
        for i, (severity, kind, column, value, _, share) in enumerate(checks)
    ]
    return (
        counted.select("rows", F.inline(F.array(*rows)))
        .where((F.col("hits") > 0) & (F.col("hits") >= F.col("share") * F.col("rows")))
        .select(
            "severity", "kind", F.lit(table).alias("table"), "column", "value", "hits", "rows",
            F.lit("").alias("examples"),
        )
    )


# The checks below return hit groups: (severity, kind, table, column, value, n), one row per
# distinct bad value. `summarise` turns them into issues.


def sentinel_dates(df: DataFrame, table: str) -> DataFrame:
    """Placeholder dates in any text or temporal column."""
    cells, any_hit = [], F.lit(False)
    for name, dtype in _columns(df):
        if isinstance(dtype, (T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType)):
            text = F.col(f"`{name}`").cast("string")
            hit = P.is_sentinel_date(text)
            any_hit = any_hit | F.coalesce(hit, F.lit(False))
            cells.append(F.struct(F.lit(name).alias("column"), F.when(hit, text).alias("value")))
    if not cells:
        return _no_groups(df)
    # Only rows with a hit are taken apart into cells.
    return _groups(df.where(any_hit), cells, "medium", "sentinel_date", table)


def duplicate_uniques(df: DataFrame, table: str, declared: Declared) -> DataFrame:
    """Values that occur more than once in a single-column UNIQUE index."""
    found = [_no_groups(df)]
    for column in declared.unique:
        c = F.col(f"`{column}`")
        values = df.where(c.isNotNull()).groupBy(c.alias("value")).agg(F.count(F.lit(1)).alias("n"))
        found.append(
            values.where(F.col("n") > 1).select(
                F.lit("high").alias("severity"),
                F.lit("duplicate_in_unique").alias("kind"),
                F.lit(table).alias("table"),
                F.lit(column).alias("column"),
                F.col("value").cast("string").alias("value"),
                "n",
            )
        )
    return reduce(DataFrame.unionAll, found)


def orphaned_rows(tables: dict[str, DataFrame], table: str, declared: Declared) -> DataFrame:
    """Foreign key values without a parent. An empty parent is not checked."""
    df = tables[table]
    found = [_no_groups(df)]
    for column, ref_table, ref_column in declared.foreign_keys:
        parent = tables.get(ref_table)
        if parent is None or parent.isEmpty():
            continue
        found.append(
            orphans(df, column, parent, ref_column).select(
                F.lit("high").alias("severity"),
                F.lit("orphaned_rows").alias("kind"),
                F.lit(table).alias("table"),
                F.lit(column).alias("column"),
                F.col("value").cast("string").alias("value"),
                "n",
            )
        )
    return reduce(DataFrame.unionAll, found)


def _groups(df: DataFrame, cells: list, severity: str, kind: str, table: str) -> DataFrame:
    return (
        df.select(F.explode(F.array(*cells)).alias("cell"))
        .select("cell.column", "cell.value")
        .where(F.col("value").isNotNull())
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            F.lit(severity).alias("severity"),
            F.lit(kind).alias("kind"),
            F.lit(table).alias("table"),
            "column",
            "value",
            "n",
        )
    )


def _no_groups(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame(
        [], "severity string, kind string, table string, column string, value string, n bigint"
    )


def summarise(groups: DataFrame, counts: DataFrame) -> DataFrame:
    """Issues from hit groups: total hits and the three smallest values, as text.

    Hits are rows, but for repeated UNIQUE values they are values. `counts(table, rows)`. The
    groups are stored first, so the tables behind them are scanned once. The rank filter is
    applied inside each task, so no more than three rows per task and column move.
    """
    by = ["severity", "kind", "table", "column"]
    groups = materialize(groups, "quality-groups")
    counts = materialize(counts, "quality-counts")
    order = Window.partitionBy(*by).orderBy("value")
    top = (
        groups.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= EXAMPLES)
        .groupBy(*by)
        .agg(F.array_join(F.sort_array(F.collect_list("value")), ", ").alias("examples"))
    )
    total = groups.groupBy(*by).agg(F.count(F.lit(1)).alias("values"), F.sum("n").alias("n"))
    hits = F.when(F.col("kind") == "duplicate_in_unique", F.col("values")).otherwise(F.col("n"))
    return (
        total.join(top, by)
        .join(counts, "table")
        .select(
            "severity", "kind", "table", "column", F.lit("").alias("value"), hits.alias("hits"),
            "rows", "examples",
        )
    )


def quality_issues(tables: dict[str, DataFrame], declared: dict[str, Declared]) -> DataFrame:
    """All faults of all tables, with a sentence each."""
    faults, groups = [], []
    for table, df in tables.items():
        says = declared.get(table, Declared())
        faults.append(value_faults(df, table, says))
        groups += [
            sentinel_dates(df, table),
            duplicate_uniques(df, table, says),
            orphaned_rows(tables, table, says),
        ]
    found = summarise(reduce(DataFrame.unionAll, groups), row_counts(tables))
    return with_detail(materialize(reduce(DataFrame.unionAll, [*faults, found]), "quality-issues"))


def with_detail(issues: DataFrame) -> DataFrame:
    share = F.concat(F.col("hits").cast("string"), F.lit(" of "), F.col("rows").cast("string"))
    kind = F.col("kind")
    detail = (
        F.when(
            kind == "empty_string_in_not_null",
            F.concat(share, F.lit(" rows are empty in a NOT NULL column")),
        )
        .when(
            kind == "sentinel_date",
            F.concat(share, F.lit(" rows hold a placeholder date: "), "examples"),
        )
        .when(
            kind == "numeric_sentinel",
            F.concat(share, F.lit(" rows hold "), "value", F.lit(", which may mean missing")),
        )
        .when(
            kind == "duplicate_in_unique",
            F.concat(
                F.col("hits").cast("string"),
                F.lit(" values repeat in a UNIQUE column: "),
                "examples",
            ),
        )
        .otherwise(F.concat(share, F.lit(" rows point at nothing: "), "examples"))
    )
    return issues.withColumn("detail", detail)


def quality_score(issues: DataFrame, tables_checked: int) -> DataFrame:
    """One row: score out of 100 and the number of issues by severity."""
    weight = F.lit(0)
    for severity, points in rules.SEVERITY_WEIGHT.items():
        weight = F.when(F.col("severity") == severity, points).otherwise(weight)
    return issues.agg(
        F.greatest(F.lit(0), 100 - F.coalesce(F.sum(weight), F.lit(0))).cast("int").alias("quality_score"),
        *[
            F.count_if(F.col("severity") == s).alias(s) for s in rules.SEVERITY_WEIGHT
        ],
        F.count(F.lit(1)).alias("issues"),
        F.count_distinct("table").alias("tables_with_issues"),
    ).withColumn("tables_checked", F.lit(tables_checked))


def issues_per_table(issues: DataFrame) -> DataFrame:
    return issues.groupBy("table").agg(
        F.count(F.lit(1)).alias("issues"),
        *[F.count_if(F.col("severity") == s).alias(s) for s in rules.SEVERITY_WEIGHT],
    )
