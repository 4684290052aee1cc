"""A whole migration: profile, plan, copy, validate, report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabletrust.operators import report, validate
from tabletrust.operators.mapping import (
    TableMap,
    apply_mapping,
    failed_conversions,
    mapping_plan,
)
from tabletrust.operators.profile import personal_columns, profile_dataset
from tabletrust.operators.relations import implicit_foreign_keys, load_order
from tabletrust.session import materialize
from tabletrust.sources.catalog import Catalog, Declared, read_catalog
from tabletrust.sources.sinks import adapt_rows, replace_table


@dataclass
class Analysis:
    catalog: Catalog
    profile: DataFrame
    facts: DataFrame
    implicit_fks: DataFrame


def analyse(
    spark: SparkSession,
    tables: dict[str, DataFrame],
    declared: dict[str, Declared],
    suffixes: tuple[str, ...] = ("_id",),
    **options,
) -> Analysis:
    """Catalog, profile and undeclared references; every report starts from these."""
    catalog = read_catalog(spark, tables, declared)
    profile = profile_dataset(tables, declared, **options)
    fks = materialize(implicit_foreign_keys(tables, declared, suffixes), "implicit-fks")
    return Analysis(catalog, profile, report.column_facts(profile, catalog.columns), fks)


def plan(analysis: Analysis, source: str, target: str, **options) -> DataFrame:
    return mapping_plan(analysis.catalog.columns, analysis.profile, source, target, **options)


def order_of(analysis: Analysis) -> list[str]:
    tables = analysis.catalog.columns.select("table").distinct()
    ordered = load_order(tables, analysis.catalog.foreign_keys).orderBy("load_position")
    return [r["table"] for r in ordered.collect()]


def copy_tables(
    tables: dict[str, DataFrame],
    maps: dict[str, TableMap],
    folder: str,
    order: list[str] | None = None,
    family: str | None = None,
    declared: dict[str, Declared] | None = None,
) -> dict[str, DataFrame]:
    """Write every mapped table under `folder` in the plan's types, and read the copies back.

    Values that do not fit their column are NULL in it and kept beside the copy, in
    `<table>.rejects`, under the table's declared key or with the whole row.
    """
    spark = next(iter(tables.values())).sparkSession
    says = declared or {}
    out = {}
    for name in order or list(maps):
        if name not in maps:
            continue
        mapping = maps[name]
        path = f"{folder}/{mapping.target_table}"
        rows = apply_mapping(tables[name], mapping.columns, stored=True)
        replace_table(adapt_rows(rows, family) if family else rows, path)
        key = says.get(name, Declared()).key
        lost = failed_conversions(tables[name], mapping.columns, key, stored=True)
        replace_table(lost, f"{path}.rejects")
        out[mapping.target_table] = spark.read.parquet(path)
    return out


def validate_copy(
    source: dict[str, DataFrame],
    target: dict[str, DataFrame],
    maps: dict[str, TableMap],
    declared: dict[str, Declared],
) -> DataFrame:
    """Scores per table, stored once because several reports read them."""
    counts = validate.compare_counts(source, target, maps)
    hashes = [
        validate.compare_hashes(source[m.source_table], target[m.target_table], m)
        for m in maps.values()
        if m.target_table in target
    ]
    spark = counts.sparkSession
    all_hashes = spark.createDataFrame(
        [], "source_table string, checked bigint, matched bigint, match_ratio double"
    )
    for part in hashes:
        all_hashes = all_hashes.unionByName(part)
    faults = spark.createDataFrame([], "table string, orphans bigint")
    at_source = [r for r in validate.source_references(declared, source) if r[0] in maps]
    if at_source:
        faults = faults.unionByName(
            validate.reference_faults(source, at_source).select("table", "orphans")
        )
    at_target = validate.target_references(declared, maps)
    at_target = [r for r in at_target if r[0] in target and r[2] in target]
    if at_target:
        names = spark.createDataFrame(
            [(m.target_table, m.source_table) for m in maps.values()], "table string, source string"
        )
        faults = faults.unionByName(
            validate.reference_faults(target, at_target)
            .join(names, "table")
            .select(F.col("source").alias("table"), "orphans")
        )
    return materialize(validate.score_tables(counts, all_hashes, faults), "validation")


@dataclass
class Outcome:
    tables: DataFrame
    overall: DataFrame
    components: DataFrame
    flags: DataFrame
    columns: DataFrame


def final_report(analysis: Analysis, plan_rows: DataFrame, scores: DataFrame) -> Outcome:
    spark = scores.sparkSession
    return Outcome(
        scores,
        validate.overall_score(scores),
        validate.score_components(scores),
        report.flags(
            scores,
            spark.createDataFrame([], "table string, error string"),
            plan_rows,
            personal_columns(analysis.profile),
            spark.createDataFrame([], "warning string"),
        ),
        report.confidence_breakdown(scores, analysis.facts),
    )
