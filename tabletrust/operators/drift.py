"""Schema drift: a baseline catalog against the current one, for any number of monitors.

Catalog frames here carry a `monitor` column: `columns(monitor, table, column, type, nullable,
default)` and `indexes(monitor, table, index, unique)`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabletrust.functions import predicates as P
from tabletrust.functions import rules
from tabletrust.session import materialize

EVENT_COLUMNS = [
    "monitor", "severity", "kind", "table", "column", "detail", "likely_type", "advice",
]


def structural(catalog_columns: DataFrame) -> DataFrame:
    """A catalog without the fields that change from day to day."""
    return catalog_columns.drop("rows", "row_count", "ordinal")


def is_narrowing(old: Column, new: Column) -> Column:
    """A type change that can lose data.

    Text to a longer declared length is not one, although its pattern says so.
    """
    narrow = F.lit(False)
    for wide, slim in rules.NARROWING:
        narrow = narrow | (old.rlike(f"(?i){wide}") & new.rlike(f"(?i){slim}"))
    size = r"(?i)^\s*(?:var)?char\((\d+)\)"
    before = F.regexp_extract(old, size, 1).try_cast("int")
    after = F.regexp_extract(new, size, 1).try_cast("int")
    return narrow & ~F.coalesce(after >= before, F.lit(False))


def hints(column: Column, declared: Column) -> tuple[Column, Column]:
    """(likely semantic type, advice) for a new column: its name decides before its type."""
    likely = F.coalesce(
        P.first_label(column, rules.NAME_HINTS, 1), P.first_label(declared, rules.TYPE_HINTS, 1)
    )
    advice = F.coalesce(
        P.first_label(column, rules.NAME_HINTS, 2), P.first_label(declared, rules.TYPE_HINTS, 2)
    )
    return likely, advice


def _sides(base: DataFrame, current: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Full outer join on the keys, with `old_`/`new_` fields and `in_base`/`in_current`."""
    old = base.select(*keys, *[F.col(f).alias(f"old_{f}") for f in fields], F.lit(True).alias("in_base"))
    new = current.select(*keys, *[F.col(f).alias(f"new_{f}") for f in fields], F.lit(True).alias("in_current"))
    return old.join(new, keys, "full_outer").fillna(False, ["in_base", "in_current"])


def diff_catalogs(
    base_columns: DataFrame,
    current_columns: DataFrame,
    base_indexes: DataFrame,
    current_indexes: DataFrame,
) -> DataFrame:
    """Drift events. Columns and indexes are compared only in tables both catalogs hold."""
    table_keys = ["monitor", "table"]
    nothing = F.lit(None).cast("string")

    tables = _sides(
        base_columns.select(*table_keys).distinct(),
        current_columns.select(*table_keys).distinct(),
        table_keys,
        [],
    )
    # Three comparisons leave these tables out, so they are worked out once.
    moved = materialize(tables.where(F.col("in_base") != F.col("in_current")), "moved-tables")
    table_events = moved.select(
        "monitor",
        F.when(F.col("in_base"), "critical").otherwise("info").alias("severity"),
        F.when(F.col("in_base"), "table_dropped").otherwise("table_added").alias("kind"),
        "table",
        nothing.alias("column"),
        F.when(F.col("in_base"), "table is gone").otherwise("new table").alias("detail"),
        nothing.alias("likely_type"),
        nothing.alias("advice"),
    )

    columns = _sides(
        base_columns, current_columns, [*table_keys, "column"], ["type", "nullable", "default"]
    ).join(moved.select(*table_keys), table_keys, "left_anti")
    column_events = columns.select(
        "monitor", "table", "column", F.inline(F.array_compact(_column_changes()))
    ).select(*EVENT_COLUMNS)

    indexes = _sides(
        base_indexes, current_indexes, [*table_keys, "index"], ["unique"]
    ).join(moved.select(*table_keys), table_keys, "left_anti")
    lost = F.concat(
        F.lit("index dropped: "),
        F.col("index"),
        F.when(F.col("old_unique"), ", uniqueness no longer enforced").otherwise(""),
    )
    index_events = indexes.where(F.col("in_base") != F.col("in_current")).select(
        "monitor",
        F.when(F.col("in_base"), "warning").otherwise("info").alias("severity"),
        F.when(F.col("in_base"), "index_dropped").otherwise("index_added").alias("kind"),
        "table",
        nothing.alias("column"),
        F.when(F.col("in_base"), lost).otherwise(F.concat(F.lit("new index: "), F.col("index"))).alias("detail"),
        nothing.alias("likely_type"),
        nothing.alias("advice"),
    )
    return reduce(DataFrame.unionByName, [table_events, column_events, index_events])


def _column_changes() -> Column:
    """Up to two events per column: its presence or type, and its nullability."""
    old_type = F.coalesce("old_type", F.lit(""))
    new_type = F.coalesce("new_type", F.lit(""))
    likely, advice = hints(F.col("column"), new_type)
    nullable = F.coalesce("new_nullable", F.lit(True))
    blocks = ~nullable & F.col("new_default").isNull()
    both = F.col("in_base") & F.col("in_current")
    narrow = is_narrowing(old_type, new_type)
    nothing = F.lit(None).cast("string")

    def event(severity, kind, detail, kind_likely=nothing, kind_advice=nothing) -> Column:
        return F.struct(
            (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"),
            F.lit(kind).alias("kind"),
            (F.lit(detail) if isinstance(detail, str) else detail).alias("detail"),
            kind_likely.alias("likely_type"),
            kind_advice.alias("advice"),
        )

    added = event(
        F.when(blocks, "warning").otherwise("info"),
        "column_added",
        F.concat(
            F.lit("new column "),
            new_type,
            F.when(blocks, ", NOT NULL without a default").otherwise(""),
        ),
        likely,
        advice,
    )
    retyped = event(
        F.when(narrow, "critical").otherwise("warning"),
        "type_changed",
        F.concat(
            old_type, F.lit(" to "), new_type, F.when(narrow, ", can lose data").otherwise("")
        ),
    )
    presence = (
        F.when(~F.col("in_current"), event("critical", "column_dropped", "column is gone"))
        .when(~F.col("in_base"), added)
        .when(both & (F.upper(old_type) != F.upper(new_type)), retyped)
    )
    nullability = F.when(
        both & ~F.col("old_nullable") & F.col("new_nullable"),
        event("critical", "not_null_dropped", "nulls can now enter"),
    ).when(
        both & F.col("old_nullable") & ~F.col("new_nullable"),
        event("warning", "not_null_added", "existing nulls would block this"),
    )
    return F.array(presence, nullability)


def severity_rank() -> Column:
    severity = F.col("severity")
    return F.when(severity == "critical", 0).when(severity == "warning", 1).otherwise(2)


def in_order(events: DataFrame) -> DataFrame:
    return events.orderBy(
        "monitor", severity_rank(), "table", F.coalesce("column", F.lit("")), "kind", "detail"
    )


def _weighed() -> Column:
    penalty = F.lit(0)
    for severity, points in rules.DRIFT_WEIGHT.items():
        penalty = penalty + points * F.col(severity)
    return F.greatest(F.lit(0), 100 - penalty).cast("int")


def check_results(monitors: DataFrame, events: DataFrame, checked_at: Column) -> DataFrame:
    """One row per monitor: counts by severity, health score. No events means 100."""
    counts = events.groupBy("monitor").agg(
        *[F.count_if(F.col("severity") == s).alias(s) for s in rules.DRIFT_WEIGHT]
    )
    return (
        monitors.select("monitor")
        .join(counts, "monitor", "left")
        .fillna(0, list(rules.DRIFT_WEIGHT))
        .select(
            "monitor",
            checked_at.alias("checked_at"),
            *rules.DRIFT_WEIGHT,
            (F.col("critical") + F.col("warning") + F.col("info") > 0).alias("has_drift"),
            _weighed().alias("health_score"),
        )
    )


def digest(events: DataFrame, limit: int = 15) -> DataFrame:
    """The first events of each monitor's alert, and how many more there are."""
    order = Window.partitionBy("monitor").orderBy(
        severity_rank(), "table", F.coalesce("column", F.lit("")), "kind", "detail"
    )
    shown = events.withColumn("position", F.row_number().over(order)).where(
        F.col("position") <= limit
    )
    totals = events.groupBy("monitor").agg(F.count(F.lit(1)).alias("events"))
    where = F.concat_ws(".", "table", "column")
    return shown.join(totals, "monitor").select(
        "monitor",
        "position",
        F.concat(
            F.lit("["), F.upper("severity"), F.lit("] "), where, F.lit(": "), "detail"
        ).alias("line"),
        F.greatest(F.lit(0), F.col("events") - limit).alias("more"),
    )


def health_rollup(checks: DataFrame) -> DataFrame:
    """Per monitor over its checks: runs, events, mean score, and whether action is needed."""
    events = F.col("critical") + F.col("warning") + F.col("info")
    return checks.groupBy("monitor").agg(
        F.count(F.lit(1)).alias("checks_run"),
        F.sum(events).alias("drift_events"),
        F.sum("critical").alias("critical_events"),
        F.sum("warning").alias("warning_events"),
        F.round(F.avg("health_score"), 1).alias("health_score"),
        F.when(
            F.sum("critical") > 0,
            F.concat(F.sum("critical").cast("string"), F.lit(" critical changes need attention")),
        )
        .otherwise("no action needed")
        .alias("recommendation"),
        F.format_string("mean health %.1f", F.round(F.avg("health_score"), 1))
        .alias("headline"),
    )


def new_semantic_issues(events: DataFrame) -> DataFrame:
    """Every new column that looks like another type, numbered within its monitor."""
    order = Window.partitionBy("monitor").orderBy("table", "column")
    return (
        events.where(F.col("likely_type").isNotNull())
        .withColumn("position", F.row_number().over(order))
        .select("monitor", "position", "table", "column", "likely_type", "advice")
    )


def issue_digest(issues: DataFrame, limit: int = 5) -> DataFrame:
    """One row per monitor: its first issues as lines, and how many more there are."""
    line = F.concat_ws(" ", F.concat("table", F.lit("."), "column"), F.lit("may be"), "likely_type")
    shown = F.when(F.col("position") <= limit, F.struct("position", line.alias("line")))
    return issues.groupBy("monitor").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(shown)), lambda x: x["line"]), "; ")
        .alias("lines"),
        F.greatest(F.lit(0), F.count(F.lit(1)) - limit).alias("more"),
    )


def timeline(checks: DataFrame, limit: int = 50) -> DataFrame:
    """The latest checks of each monitor, newest first; `latest` marks the newest."""
    order = Window.partitionBy("monitor").orderBy(
        F.desc("checked_at"), F.desc("critical"), F.desc("warning"), F.desc("info")
    )
    return (
        checks.withColumn("position", F.row_number().over(order))
        .where(F.col("position") <= limit)
        .withColumn("latest", F.col("position") == 1)
    )


def presence(base: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with `where`: only in the baseline, only in the current catalog, or in both."""
    both = _sides(base.select(*keys).distinct(), current.select(*keys).distinct(), keys, [])
    return both.select(
        *keys,
        F.when(F.col("in_base") & F.col("in_current"), "both")
        .when(F.col("in_base"), "baseline")
        .otherwise("current")
        .alias("where"),
    )
