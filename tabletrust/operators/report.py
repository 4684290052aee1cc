"""Reports over a profile and a catalog: what the schema says against what the data says."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabletrust.functions import predicates as P
from tabletrust.functions import rules


def column_facts(profile: DataFrame, columns: DataFrame) -> DataFrame:
    """The profile beside the declared nullability and key, with one flag per kind of finding.

    An implicit Boolean hides an enum on the same column; a declared Boolean is no finding.
    """
    says = columns.select("table", "column", "type", "nullable", "primary_key")
    declared = F.coalesce("declared_type", "type")
    is_boolean = (
        F.col("implicit_boolean")
        & (F.col("rows") > 0)
        & ~F.coalesce(declared.rlike("(?i)bool"), F.lit(False))
    )
    return (
        profile.join(says, ["table", "column"], "left")
        .withColumn("declared", declared)
        .withColumns(
            {
                "is_boolean": is_boolean,
                "is_enum": ~is_boolean & F.col("implicit_enum"),
                "never_null": F.coalesce("nullable", F.lit(False))
                & (F.col("rows") > 0)
                & (F.col("nulls") == 0),
                "is_semantic": F.col("semantic_type").isNotNull(),
                "is_dangerous": F.col("danger").isNotNull(),
                "pii_type": F.when(
                    F.col("pii_suspected"),
                    P.personal_category(F.col("column"), F.col("semantic_type")),
                ),
            }
        )
    )


FINDING_KINDS = [
    ("implicit_boolean", "is_boolean"),
    ("implicit_enum", "is_enum"),
    ("never_null_nullable", "never_null"),
    ("semantic", "is_semantic"),
    ("danger", "is_dangerous"),
    ("pii", "pii_suspected"),
]


def findings(facts: DataFrame) -> DataFrame:
    """(table, column, kind, detail, confidence): every finding, one row each."""
    rows, distinct = F.col("rows"), F.col("distinct_count")
    detail = {
        "implicit_boolean": (F.lit("BOOLEAN"), P.finding_confidence(rows)),
        "implicit_enum": (F.array_join("enum_values", ","), P.finding_confidence(rows, distinct)),
        "never_null_nullable": (F.lit("no null found"), P.finding_confidence(rows)),
        "semantic": (F.col("semantic_type"), F.round("confidence_pct").cast("int")),
        "danger": (F.col("danger"), F.round("confidence_pct").cast("int")),
        "pii": (F.col("pii_type"), P.finding_confidence(rows)),
    }
    cells = [
        F.when(
            F.col(flag),
            F.struct(
                F.lit(kind).alias("kind"),
                detail[kind][0].alias("detail"),
                detail[kind][1].alias("confidence"),
            ),
        )
        for kind, flag in FINDING_KINDS
    ]
    return facts.select("table", "column", F.inline(F.array_compact(F.array(*cells))))


def finding_counts(facts: DataFrame, implicit_fks: DataFrame) -> DataFrame:
    """(kind, findings): how many of each kind, implicit foreign keys included."""
    fks = implicit_fks.agg(F.count(F.lit(1)).alias("findings"))
    per_kind = facts.agg(*[F.count_if(F.col(flag)).alias(kind) for kind, flag in FINDING_KINDS])
    cells = [F.struct(F.lit(k).alias("kind"), F.col(k).alias("findings")) for k, _ in FINDING_KINDS]
    return per_kind.select(F.inline(F.array(*cells))).unionByName(
        fks.select(F.lit("implicit_fk").alias("kind"), "findings")
    )


def trust_score(facts: DataFrame, implicit_fks: DataFrame) -> DataFrame:
    """One row: how far the declared schema can be trusted, out of 100.

    A column counts once however many findings it has. Columns the data contradicts weigh 1,
    nullable columns that are never null 0.35.
    """
    hard = F.col("is_boolean") | F.col("is_enum") | F.col("is_semantic")
    fks = implicit_fks.agg(F.count(F.lit(1)).alias("n"))
    parts = facts.agg(
        F.count(F.lit(1)).alias("columns"),
        F.count_if(hard).alias("hard_columns"),
        F.count_if(F.col("never_null") & ~hard).alias("soft_columns"),
        F.count_if(F.col("is_dangerous")).alias("dangers"),
        F.count_if(F.col("pii_suspected")).alias("pii_columns"),
    ).withColumn("implicit_fks", fks.scalar())
    bad = F.col("hard_columns") + 0.35 * F.col("soft_columns")
    base = F.round(100 * (1 - F.least(F.lit(1.0), bad / F.col("columns"))))
    score = base - 5 * F.col("dangers") - 3 * F.col("implicit_fks") - F.col("pii_columns")
    return parts.withColumn(
        "schema_trust_score",
        F.when(F.col("columns") == 0, 0)
        .otherwise(F.greatest(F.lit(0), F.least(F.lit(100), score)))
        .cast("int"),
    )


def _advice(semantic: Column) -> Column:
    text = F.lit(None).cast("string")
    for name, advice in rules.ADVICE.items():
        text = F.when(semantic == name, advice).otherwise(text)
    return text


def preview_diff(facts: DataFrame, plan: DataFrame | None = None) -> DataFrame:
    """One row per column: declared against inferred, and what to do. Differing rows first."""
    enum_name = F.concat(F.lit("ENUM("), F.col("distinct_count").cast("string"), F.lit(" values)"))
    found = (
        F.when(F.col("is_boolean"), "BOOLEAN")
        .when(F.col("is_enum"), enum_name)
        .otherwise(F.upper("semantic_type"))
    )
    claimed = F.col("is_boolean") | F.col("is_enum")
    confidence = (
        F.when(F.col("is_boolean"), P.finding_confidence(F.col("rows")))
        .when(F.col("is_enum"), P.finding_confidence(F.col("rows"), F.col("distinct_count")))
        .when(F.col("is_semantic"), F.round("confidence_pct").cast("int"))
        .otherwise(P.finding_confidence(F.col("rows")))
    )
    listed = F.concat(
        F.lit("values: "),
        F.array_join(F.slice("enum_values", 1, 6), ", "),
        F.when(F.col("distinct_count") > 6, "…").otherwise(""),
    )
    notes = F.array_compact(
        F.array(
            F.when(F.col("is_boolean"), F.lit("only 0 and 1 occur"))
            .when(F.col("is_enum"), listed)
            .when(F.col("is_semantic"), F.col("evidence")),
            F.when(F.col("never_null"), F.lit("nullable, but no null found")),
            F.when(F.col("pii_type").isNotNull(), F.concat(F.lit("personal data: "), "pii_type")),
        )
    )
    out = facts
    planned = F.lit(None).cast("string")
    if plan is not None:
        out = facts.join(
            plan.select("table", F.col("source_column").alias("column"), F.col("target_type").alias("planned")),
            ["table", "column"],
            "left",
        )
        planned = F.col("planned")
    differs = F.col("found").isNotNull() | F.col("never_null")
    inferred = F.coalesce("found", "declared", F.lit("unknown"))
    return (
        out.withColumn("found", found)
        .select(
            "table",
            "column",
            F.col("declared").alias("declared_type"),
            "nullable",
            "primary_key",
            inferred.alias("inferred_type"),
            F.col("never_null").alias("not_null_in_practice"),
            "pii_type",
            F.array_join(notes, "; ").alias("notes"),
            F.coalesce(
                planned,
                F.when(~claimed, _advice(F.col("semantic_type"))),
                F.when(differs, F.concat(F.lit("migrate as "), inferred)),
                F.lit("keep as declared"),
            ).alias("recommendation"),
            differs.alias("differs"),
            confidence.alias("confidence"),
        )
        .orderBy(F.desc("differs"), "table", "column")
    )


def confidence_breakdown(
    tables: DataFrame, facts: DataFrame, threshold: int = rules.REVIEW_THRESHOLD
) -> DataFrame:
    """Confidence per column of every validated table, lowest first.

    `tables` is the output of `validate.score_tables`.
    """
    checked = tables.select(
        F.col("source_table").alias("table"),
        F.round(100 * F.col("score")).cast("int").alias("table_confidence"),
        "match_ratio",
    )
    hidden = F.col("is_boolean") | F.col("is_enum")
    lowered = (
        F.col("table_confidence")
        - F.when(hidden, 10).otherwise(0)
        - F.when(F.col("pii_suspected"), 5).otherwise(0)
    )
    reasons = F.array_compact(
        F.array(
            F.when(F.col("is_boolean"), "declared type hides a boolean").when(
                F.col("is_enum"), "declared free text is an enum"
            ),
            F.when(F.col("pii_suspected"), F.concat(F.lit("personal data: "), "pii_type")),
            F.when(
                F.col("match_ratio") < 1.0,
                F.concat(F.lit("row match "), F.format_string("%.3f", "match_ratio")),
            ),
        )
    )
    confidence = F.greatest(F.lit(0), F.least(F.lit(100), lowered))
    return (
        checked.join(facts, "table")
        .select(
            "table",
            "column",
            "table_confidence",
            confidence.alias("confidence"),
            (confidence < threshold).alias("needs_review"),
            F.array_join(reasons, "; ").alias("reasons"),
        )
        .orderBy("table_confidence", "table", "confidence", "column")
    )


def flags(
    tables: DataFrame,
    errors: DataFrame,
    plan: DataFrame,
    personal: DataFrame,
    global_warnings: DataFrame,
) -> DataFrame:
    """Everything a person should look at: (severity, table, title, detail).

    `errors(table, error)`, `plan(table, warning)`, `personal(table, column)`,
    `global_warnings(warning)`.
    """
    t = F.col("source_table")
    counts = tables.where(~F.col("row_count_ok")).select(
        F.lit("high").alias("severity"),
        t.alias("table"),
        F.lit("Row count mismatch").alias("title"),
        F.concat(
            F.col("source_rows").cast("string"),
            F.lit(" source rows, "),
            F.col("target_rows").cast("string"),
            F.lit(" target rows"),
        ).alias("detail"),
    )
    ratio = F.col("match_ratio")
    rows = tables.where(ratio < 1.0).select(
        F.when(ratio >= 0.9, "medium").otherwise("high").alias("severity"),
        t.alias("table"),
        F.lit("Rows differ").alias("title"),
        F.concat(F.format_string("%.3f", ratio), F.lit(" of rows match")).alias("detail"),
    )
    refs = tables.where(~F.col("fk_ok")).select(
        F.lit("high").alias("severity"),
        t.alias("table"),
        F.lit("Broken references").alias("title"),
        F.lit("some foreign keys find no parent").alias("detail"),
    )
    failed = errors.select(
        F.lit("high").alias("severity"), "table", F.lit("Execution error").alias("title"),
        F.col("error").alias("detail"),
    )
    warned = plan.where(F.col("warning").isNotNull()).select(
        F.lit("low").alias("severity"), "table", F.lit("Planner warning").alias("title"),
        F.col("warning").alias("detail"),
    )
    general = global_warnings.select(
        F.lit("low").alias("severity"), F.lit(None).cast("string").alias("table"),
        F.lit("Planner warning").alias("title"), F.col("warning").alias("detail"),
    )
    private = (
        personal.groupBy("table")
        .agg(F.array_join(F.sort_array(F.collect_list("column")), ", ").alias("detail"))
        .select(
            F.lit("low").alias("severity"), "table",
            F.lit("Personal data copied").alias("title"), "detail",
        )
    )
    parts = [counts, rows, refs, failed, warned, general, private]
    return reduce(DataFrame.unionByName, parts)


def public_summary(tables: DataFrame) -> DataFrame:
    """Per-table proof without names: tables are numbered in the given `position` order."""
    order = Window.orderBy("position")
    return tables.select(
        F.concat(F.lit("table_"), F.row_number().over(order).cast("string")).alias("table"),
        "source_rows",
        "target_rows",
        "row_count_ok",
    )


def run_totals(run_log: DataFrame) -> DataFrame:
    """One row over a run log (job, table, rows, rows_total, started, ended).

    Percent done, observed rows per second, hours the same work would take by hand, and the
    seconds left at the observed rate.
    """
    first = F.unix_timestamp(F.min("started").cast("timestamp"))
    last = F.unix_timestamp(F.max("ended").cast("timestamp"))
    span = F.greatest(F.lit(0), last - first)
    totals = run_log.groupBy("job").agg(
        F.count_distinct("table").alias("tables"),
        F.sum("rows").alias("rows_migrated"),
        F.max("rows_total").alias("rows_total"),
        span.alias("seconds"),
    )
    done, total = F.col("rows_migrated"), F.col("rows_total")
    rate = F.when(F.col("seconds") > 0, done / F.col("seconds"))
    return totals.select(
        "job",
        "tables",
        "rows_migrated",
        "rows_total",
        F.when(total > 0, F.floor(100 * done / total)).otherwise(100).cast("int").alias("percent"),
        "seconds",
        manual_hours(F.col("tables"), done).alias("manual_hours"),
        F.round((total - done) / rate, 1).alias("seconds_left"),
    )


def job_totals(jobs: DataFrame, active: list[str]) -> DataFrame:
    """One row over `jobs(status, rows)`: how many run, how many are done, and rows moved."""
    return jobs.agg(
        F.count_if(F.col("status").isin(active)).alias("running"),
        F.count_if(F.col("status") == "completed").alias("completed"),
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows_migrated"),
    )


def manual_hours(tables: Column, rows: Column) -> Column:
    return F.round(
        rules.HOURS_PER_TABLE * tables + rules.HOURS_PER_100K_ROWS * (rows / 100_000), 1
    )


def table_status(
    plan_tables: DataFrame, order: DataFrame, foreign_keys: DataFrame, run_log: DataFrame,
    validated: bool, skipped: tuple[str, ...] = (),
) -> DataFrame:
    """(table, load_position, status, rows_committed, depends_on) in load order.

    `plan_tables(table)`, `order` from `relations.load_order`, `run_log(table, rows, done)`.
    """
    progress = run_log.groupBy("table").agg(
        F.sum("rows").alias("rows_committed"), F.max("done").alias("done")
    )
    names = plan_tables.select(F.col("table").alias("ref_table"))
    needs = (
        foreign_keys.join(names, "ref_table", "left_semi")
        .groupBy("table")
        .agg(F.array_join(F.sort_array(F.collect_set("ref_table")), ",").alias("depends_on"))
    )
    done = F.coalesce("done", F.lit(False))
    committed = F.coalesce("rows_committed", F.lit(0))
    status = (
        F.when(F.col("table").isin(*skipped) if skipped else F.lit(False), "skipped")
        .when(done, "validated" if validated else "migrated")
        .when(committed > 0, "migrating")
        .otherwise("pending")
    )
    return (
        plan_tables.join(order, "table")
        .join(progress, "table", "left")
        .join(needs, "table", "left")
        .select(
            "table",
            "load_position",
            status.alias("status"),
            committed.alias("rows_committed"),
            F.coalesce("depends_on", F.lit("")).alias("depends_on"),
        )
        .orderBy("load_position")
    )
