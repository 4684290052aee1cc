"""From a source schema to a target schema: types, plan, projection, rejects."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabletrust.functions import conversions as C
from tabletrust.functions import rules
from tabletrust.session import materialize


@dataclass(frozen=True)
class ColumnMap:
    source: str
    target: str
    target_type: str | None = None
    transformation: str | None = None
    source_type: str | None = None


@dataclass(frozen=True)
class TableMap:
    source_table: str
    target_table: str
    columns: tuple[ColumnMap, ...] = field(default=())

    def target_of(self, source_column: str) -> str | None:
        return next((m.target for m in self.columns if m.source == source_column), None)


# --- types ---------------------------------------------------------------------------------


def native_types(spark: SparkSession) -> DataFrame:
    """(family, native, canonical); a fixed table of some 170 rows."""
    return spark.createDataFrame(
        rules.NATIVE_TYPES, "family string, native string, canonical string"
    )


def target_types(spark: SparkSession) -> DataFrame:
    """(family, canonical, target_type); a fixed table of 120 rows."""
    return spark.createDataFrame(
        rules.TARGET_TYPES, "family string, canonical string, target_type string"
    )


def stack_types(spark: SparkSession, stack: str) -> DataFrame:
    """(native, target_type): a stack's own rules, a handful of rows, to pass as `overrides`."""
    rows = list(rules.STACK_TYPES[stack].items())
    return F.broadcast(spark.createDataFrame(rows, "native string, target_type string"))


def with_target_types(
    columns: DataFrame,
    source: str | Column,
    target: str | Column,
    type_column: str = "type",
    overrides: DataFrame | None = None,
) -> DataFrame:
    """Add `canonical` and `target_type` to rows that carry a native type name.

    `source` and `target` are families, as text or as a column. The two rule tables are fixed,
    so they are broadcast; the rows themselves are never shuffled. `overrides(native,
    target_type)` wins over the rules.
    """
    spark = columns.sparkSession
    source = F.lit(source) if isinstance(source, str) else source
    target = F.lit(target) if isinstance(target, str) else target
    full = F.lower(F.trim(F.coalesce(F.col(type_column), F.lit(""))))
    keyed = columns.withColumns(
        {
            "_source": source,
            "_target": target,
            "_full": full,
            "_base": F.trim(F.substring_index(full, "(", 1)),
        }
    )
    native = native_types(spark)
    exact = native.select(
        F.col("family").alias("_source"), F.col("native").alias("_full"), F.col("canonical").alias("_exact")
    )
    sized = native.select(
        F.col("family").alias("_source"), F.col("native").alias("_base"), F.col("canonical").alias("_sized")
    )
    wanted = target_types(spark).select(
        F.col("family").alias("_target"), "canonical", F.col("target_type").alias("_named")
    )
    mysql_flag = (F.col("_source") == "mysql") & F.col("_full").startswith("tinyint(1)")
    out = (
        keyed.join(F.broadcast(exact), ["_source", "_full"], "left")
        .join(F.broadcast(sized), ["_source", "_base"], "left")
        .withColumn(
            "canonical",
            F.coalesce(
                "_exact",
                F.when(mysql_flag, "boolean"),
                "_sized",
                F.lit(rules.FALLBACK_CANONICAL),
            ),
        )
        .join(F.broadcast(wanted), ["_target", "canonical"], "left")
    )
    named = F.coalesce("_named", F.lit(rules.FALLBACK_TARGET))
    if overrides is not None:
        special = overrides.select(
            F.lower("native").alias("_full"), F.col("target_type").alias("_override")
        )
        out = out.join(special, "_full", "left")
        named = F.coalesce("_override", named)
    return out.select(*columns.columns, "canonical", named.alias("target_type"))


# --- plan ----------------------------------------------------------------------------------


def mapping_plan(
    columns: DataFrame,
    profile: DataFrame,
    source: str,
    target: str,
    skip: tuple[str, ...] = (),
    only: tuple[str, ...] | None = None,
    overrides: DataFrame | None = None,
    foreign_keys: DataFrame | None = None,
) -> DataFrame:
    """One row per (table, column): target type, conversion, warning.

    `columns` is a catalog's columns frame; `profile` a profile of the same tables. With
    `foreign_keys(table, ref_table)` a `note` says which tables must be loaded before.
    """
    kept = columns.where(~F.col("table").isin(*skip)) if skip else columns
    if only is not None:
        kept = kept.where(F.col("table").isin(*only))
    typed = with_target_types(kept, source, target, overrides=overrides)
    facts = profile.select("table", "column", "rows", "implicit_boolean", "pii_suspected")
    flag = F.coalesce("implicit_boolean", F.lit(False)) & (F.col("canonical") != "boolean")
    planned = typed.join(facts, ["table", "column"], "left")
    noted = []
    if foreign_keys is not None:
        parents = foreign_keys.where("table <> ref_table").groupBy("table").agg(
            F.array_join(F.sort_array(F.collect_set("ref_table")), ", ").alias("_parents")
        )
        planned = planned.join(parents, "table", "left")
        noted = [F.concat(F.lit("load after "), "_parents").alias("note")]
    return planned.select(
        *noted,
        "table",
        "ordinal",
        F.col("column").alias("source_column"),
        F.col("column").alias("target_column"),
        F.col("type").alias("source_type"),
        "target_type",
        F.when(flag, "to_boolean").alias("transformation"),
        F.when(
            F.col("pii_suspected"), F.concat(F.lit("may hold personal data: "), "column")
        ).alias("warning"),
        F.col("rows").alias("estimated_rows"),
    )


def table_maps(plan: DataFrame) -> dict[str, TableMap]:
    """A plan as Python objects: what a `select` is built from. Size: one entry per column."""
    out: dict[str, list[ColumnMap]] = {}
    for r in plan.orderBy("table", "ordinal").collect():
        out.setdefault(r["table"], []).append(
            ColumnMap(
                r["source_column"],
                r["target_column"],
                r["target_type"],
                r["transformation"],
                r["source_type"],
            )
        )
    return {t: TableMap(t, t, tuple(columns)) for t, columns in out.items()}


# --- projection ----------------------------------------------------------------------------


def _source_types(df: DataFrame) -> dict[str, T.DataType]:
    return {f.name: f.dataType for f in df.schema.fields}


def apply_mapping(
    df: DataFrame, columns: tuple[ColumnMap, ...] | list[ColumnMap], stored: bool = False
) -> DataFrame:
    """Select and convert the mapped columns. A missing source column becomes NULL.

    With `stored`, values also take the Spark type of their target type.
    """
    types = _source_types(df)
    out = []
    for m in columns:
        if m.source in types:
            value = C.convert(F.col(f"`{m.source}`"), types[m.source], m.transformation)
        else:
            value = F.lit(None).cast("string")
        out.append(value.alias(m.target))
    converted = df.select(*out)
    if not stored:
        return converted
    kinds = _source_types(converted)
    return converted.select(
        *(_stored(F.col(f"`{m.target}`"), kinds[m.target], m).alias(m.target) for m in columns)
    )


def _stored(c: Column, dtype: T.DataType, m: ColumnMap) -> Column:
    kind = C.stored_type(m.target_type)
    return C.store(c, dtype, kind) if kind else c


def stored_like(df: DataFrame, target: DataFrame) -> DataFrame:
    """Columns whose types differ from those of `target`, in the types of `target`.

    Only numbers, booleans and times change; what a copy keeps as text is compared as text.
    """
    kinds = {f.name: f.dataType for f in target.schema.fields}
    out = []
    for f in df.schema.fields:
        c, kind = F.col(f"`{f.name}`"), kinds.get(f.name, f.dataType)
        if kind != f.dataType and kind.simpleString().partition("(")[0] in C.STORED_AS:
            if not isinstance(kind, T.StringType):
                c = C.store(c, f.dataType, kind.simpleString())
        out.append(c.alias(f.name))
    return df.select(*out)


def failed_conversions(
    df: DataFrame,
    columns: tuple[ColumnMap, ...] | list[ColumnMap],
    key: str | tuple[str, ...],
    stored: bool = False,
) -> DataFrame:
    """(key columns, column, transformation, original): values a target column cannot keep.

    Without a key, `row` holds the whole source row as JSON.
    """
    types = _source_types(df)
    names = (key,) if isinstance(key, str) else tuple(key)
    keys = [F.col(f"`{k}`") for k in names] or [F.to_json(F.struct("*")).alias("row")]
    after = _source_types(apply_mapping(df, columns)) if stored else {}
    cells = []
    for m in columns:
        kind = C.stored_type(m.target_type) if stored else None
        if m.source in types and (m.transformation or kind):
            c, dtype = F.col(f"`{m.source}`"), types[m.source]
            failed = C.conversion_failed(c, dtype, m.transformation)
            if kind:
                converted = C.convert(c, dtype, m.transformation)
                failed = c.isNotNull() & C.store(converted, after[m.target], kind).isNull()
            cells.append(
                F.when(
                    failed,
                    F.struct(
                        F.lit(m.target).alias("column"),
                        F.lit(m.transformation).alias("transformation"),
                        C.as_text(c, dtype).alias("original"),
                    ),
                )
            )
    if not cells:
        cells = [F.lit(None).cast("struct<column:string,transformation:string,original:string>")]
    return df.select(*keys, F.inline(F.array_compact(F.array(*cells))))


def split_rows(
    df: DataFrame, columns: tuple[ColumnMap, ...] | list[ColumnMap]
) -> tuple[DataFrame, DataFrame]:
    """(rows that convert completely, untouched rows with at least one value that does not)."""
    types = _source_types(df)
    bad = F.lit(False)
    for m in columns:
        if m.source in types and m.transformation:
            c = F.col(f"`{m.source}`")
            bad = bad | C.conversion_failed(c, types[m.source], m.transformation)
    return apply_mapping(df.where(~bad), columns), df.where(bad)


# --- uploads -------------------------------------------------------------------------------


def match_header(
    headers: DataFrame, columns: DataFrame, catalog: list[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Which table a file belongs to, by shared column names.

    `headers(upload, position, header)`. Returns (upload, table, matched, headers, accepted) and the
    headers (upload, position, header) that the accepted table lacks. A table is accepted when
    it shares at least half of the headers, rounded down, and at least one. The first in
    `catalog`, the tables in catalog order, wins a tie; without it the first by name.
    """
    place = F.array_position(F.lit(catalog), F.col("table")) if catalog else F.lit(0)
    heads = headers.withColumn("name", F.lower("header"))
    cols = columns.select("table", F.lower("column").alias("name")).distinct()
    size = headers.groupBy("upload").agg(F.count(F.lit(1)).alias("headers"))
    scored = heads.join(cols, "name").groupBy("upload", "table").agg(
        F.count_distinct("name").alias("matched")
    )
    order = Window.partitionBy("upload").orderBy(F.desc("matched"), place, "table")
    best = (
        size.join(
            scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == 1),
            "upload",
            "left",
        )
        .withColumn("matched", F.coalesce("matched", F.lit(0)).cast("bigint"))
        .withColumn(
            "accepted", F.col("matched") >= F.greatest(F.lit(1), F.floor(F.col("headers") / 2))
        )
        .select("upload", "table", "matched", "headers", "accepted")
    )
    best = materialize(best, "best-tables")
    chosen = best.where("accepted").select("upload", "table").join(cols, "table")
    left_over = heads.join(chosen, ["upload", "name"], "left_anti").join(
        best.where("accepted").select("upload"), "upload", "left_semi"
    )
    return best, left_over.select("upload", "position", "header")


def normal_header(header: Column, position: Column) -> Column:
    """Header to column name: runs of non-word characters become `_`."""
    name = F.regexp_replace(F.lower(F.trim(header)), r"\W+", "_")
    return F.when(name == "", F.concat(F.lit("col_"), position.cast("string"))).otherwise(name)
