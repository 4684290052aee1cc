"""Catalogs: what a dataset declares about itself, as four DataFrames.

Parquet carries no keys and marks every field nullable, so keys, foreign keys, unique indexes
and NOT NULL are declared beside the tables with `Declared`.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabletrust.functions import rules
from tabletrust.operators.skew import join_by_key
from tabletrust.session import materialize

COLUMNS_SCHEMA = (
    "table string, ordinal int, column string, type string, nullable boolean, "
    "default string, primary_key boolean"
)
KEYS_SCHEMA = "table string, columns array<string>"
FOREIGN_KEYS_SCHEMA = "table string, column string, ref_table string, ref_column string"
INDEXES_SCHEMA = "table string, index string, columns array<string>, unique boolean"


@dataclass(frozen=True)
class Declared:
    """Constraints of one table."""

    key: tuple[str, ...] = ()
    not_null: tuple[str, ...] = ()
    foreign_keys: tuple[tuple[str, str, str], ...] = ()  # (column, ref_table, ref_column)
    unique: tuple[str, ...] = ()
    types: dict[str, str] = field(default_factory=dict)  # native type names, where known


@dataclass
class Catalog:
    columns: DataFrame
    keys: DataFrame
    foreign_keys: DataFrame
    indexes: DataFrame
    declared: dict[str, Declared]


def type_name(dtype: T.DataType) -> str:
    return dtype.simpleString().upper()


def read_catalog(
    spark: SparkSession, tables: dict[str, DataFrame], declared: dict[str, Declared] | None = None
) -> Catalog:
    """Catalog of loaded tables: their schemas plus the declared constraints."""
    declared = declared or {}
    columns, keys, fks, indexes = [], [], [], []
    for table, df in tables.items():
        says = declared.get(table, Declared())
        for i, f in enumerate(df.schema.fields):
            in_key = f.name in says.key
            nullable = not (in_key or f.name in says.not_null)
            native = says.types.get(f.name, type_name(f.dataType))
            columns.append((table, i, f.name, native, nullable, None, in_key))
        keys.append((table, list(says.key)))
        fks += [(table, *fk) for fk in says.foreign_keys]
        indexes += [(table, f"{table}_{c}_key", [c], True) for c in says.unique]
    return Catalog(
        spark.createDataFrame(columns, COLUMNS_SCHEMA),
        spark.createDataFrame(keys, KEYS_SCHEMA),
        spark.createDataFrame(fks, FOREIGN_KEYS_SCHEMA),
        spark.createDataFrame(indexes, INDEXES_SCHEMA),
        declared,
    )


def catalog_from_information_schema(
    columns: DataFrame, constraints: DataFrame, usage: DataFrame, references: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(columns, keys, foreign keys) from four `information_schema` views read over JDBC.

    `columns`: table_name, column_name, ordinal_position, data_type, is_nullable,
    column_default. `constraints`: constraint_name, table_name, constraint_type. `usage`:
    constraint_name, table_name, column_name, ordinal_position. `references`:
    constraint_name, table_name (the referenced one), column_name. Keys of several columns are
    paired by position if `references` has ordinal_position, the place in the referenced key, and
    `usage` may name that place in position_in_unique_constraint.
    """
    paired = "ordinal_position" in references.columns
    place = "position_in_unique_constraint"
    place = place if place in usage.columns else "ordinal_position"
    key_parts = (
        constraints.where(F.col("constraint_type") == "PRIMARY KEY")
        .select("constraint_name", "table_name")
        .join(usage, ["constraint_name", "table_name"])
    )
    keys = key_parts.groupBy(F.col("table_name").alias("table")).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("ordinal_position", "column_name"))),
            lambda part: part["column_name"],
        ).alias("columns")
    )
    cols = columns.join(
        key_parts.select("table_name", "column_name", F.lit(True).alias("in_key")),
        ["table_name", "column_name"],
        "left",
    ).select(
        F.col("table_name").alias("table"),
        (F.col("ordinal_position") - 1).cast("int").alias("ordinal"),
        F.col("column_name").alias("column"),
        F.col("data_type").alias("type"),
        (F.col("is_nullable") == "YES").alias("nullable"),
        F.col("column_default").alias("default"),
        F.coalesce("in_key", F.lit(False)).alias("primary_key"),
    )
    fks = (
        constraints.where(F.col("constraint_type") == "FOREIGN KEY")
        .select("constraint_name", "table_name")
        .join(usage, ["constraint_name", "table_name"])
        .select(
            "constraint_name",
            F.col("table_name").alias("table"),
            F.col("column_name").alias("column"),
            F.col(place).alias("place"),
        )
        .join(
            references.select(
                "constraint_name",
                F.col("table_name").alias("ref_table"),
                F.col("column_name").alias("ref_column"),
                *([F.col("ordinal_position").alias("place")] if paired else []),
            ),
            ["constraint_name", "place"] if paired else ["constraint_name"],
        )
        .drop("constraint_name", "place")
    )
    return cols, keys, fks


def indexes_from_statistics(statistics: DataFrame) -> DataFrame:
    """Indexes as in Catalog.indexes, from one row per index and column read over JDBC.

    `statistics`: table_name, index_name, seq_in_index, column_name, non_unique (0 or 1). Index names
    need only be unique within a table.
    """
    part = F.struct("seq_in_index", "column_name")
    columns = F.transform(F.array_sort(F.collect_list(part)), lambda p: p["column_name"])
    return statistics.groupBy(
        F.col("table_name").alias("table"), F.col("index_name").alias("index")
    ).agg(columns.alias("columns"), (F.max("non_unique") == 0).alias("unique"))


def with_schema_names(view: DataFrame, home: str) -> DataFrame:
    """An `information_schema` view whose table names carry their schema, but for schema `home`.

    Tables of one name in two schemas stay apart. A constraint's name is only unique in its schema, so
    it gets the schema too.
    """
    away = F.col("table_schema") != home
    names = [c for c in ("table_name", "constraint_name") if c in view.columns]
    full = {n: F.when(away, F.concat("table_schema", F.lit("."), n)).otherwise(F.col(n)) for n in names}
    return view.withColumns(full).drop("table_schema")


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows of every table, one counting scan each (no column is read), in one job."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(t).alias("table"), "rows")
        for t, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts)


def schema_summary(catalog: Catalog, counts: DataFrame) -> DataFrame:
    """One row: tables, total rows, and which tables declare foreign keys."""
    linked = catalog.foreign_keys.select("table").distinct().withColumn("linked", F.lit(True))
    return (
        counts.join(linked, "table", "left")
        .agg(
            F.count(F.lit(1)).alias("table_count"),
            F.sum("rows").alias("total_rows"),
            F.array_join(
                F.sort_array(F.collect_list(F.when(F.col("linked"), F.col("table")))), ","
            ).alias("tables_with_fks"),
        )
    )


def document_census(
    docs: DataFrame, text_column: str, kinds: str = "mongodb", key_field: str = "_id"
) -> DataFrame:
    """Fields of JSON documents: how often present, dominant type, optional or not.

    Every document is read. Counts are kept per (field, type), so a field found in every
    document is combined inside each task and never lands whole in one group.
    """
    docs = docs.select(F.try_parse_json(F.col(text_column)).alias("doc_json"))
    parsed = docs.where(F.col("doc_json").isNotNull())
    fields = parsed.lateralJoin(
        docs.sparkSession.tvf.variant_explode_outer(F.col("doc_json").outer()).select(
            F.col("pos").alias("position"),
            F.col("key").alias("field"),
            F.col("value").alias("field_value"),
        )
    )
    # A document has one field at position 0, or one row without a position when it is empty,
    # so these rows count the documents in the same pass.
    kind = _kind(F.schema_of_variant("field_value"), kinds)
    per_type = materialize(
        fields.groupBy("field", kind.alias("kind")).agg(
            F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce("position", F.lit(0)) == 0).alias("firsts")
        ),
        "field-kinds",
    )
    per_field = per_type.where(F.col("field").isNotNull()).groupBy("field").agg(
        F.sum("n").alias("present"),
        F.max_by("kind", F.struct("n", "kind")).alias("type"),
        F.max((F.col("kind") == "null")).alias("nullable"),
        F.sum((F.col("kind") != "null").cast("int")).alias("kinds"),
    )
    total = per_type.agg(F.sum("firsts").alias("docs"))
    return (
        per_field.withColumn("docs", total.scalar())
        .select(
            "field",
            "type",
            "nullable",
            (F.col("field") == key_field).alias("primary_key"),
            "present",
            F.round(F.lit(100.0) * F.col("present") / F.col("docs"), 1).alias("presence_pct"),
            (F.col("present") / F.col("docs") < rules.OPTIONAL_FIELD_SHARE).alias("optional"),
            (F.col("kinds") > 1).alias("mixed_types"),
            F.when(F.col("kinds") > 1, "string").otherwise(F.col("type")).alias("target_kind"),
        )
    )


def path_census(docs: DataFrame, text_column: str, kinds: str = "mongodb") -> DataFrame:
    """Every path inside JSON documents: `$`, `$.field`, `$.list[]`, `$.list[].field` and so on.

    `present` counts the values at a path, `parents` the objects or lists around them, and `unparsed`
    the texts that are no JSON. The counts per (path, kind) are sums, so censuses of parts of a
    collection merge by addition. Each round opens the objects and lists of one depth; only these
    go on to the next.
    """
    spark = docs.sparkSession
    text = F.col(text_column)
    texts = docs.where(text.isNotNull()).select(F.try_parse_json(text).alias("value"))
    unparsed = texts.agg(F.count_if(F.col("value").isNull()).alias("n"))
    level = texts.where(F.col("value").isNotNull()).select(
        F.lit("$").alias("path"), F.lit(None).cast("string").alias("parent"), "value"
    )
    counts = spark.createDataFrame([], "path string, parent string, kind string, holds boolean, n bigint")
    while True:
        schema = F.schema_of_variant("value")
        holds = schema.startswith("OBJECT") | schema.startswith("ARRAY")
        level = level.withColumns({"kind": _kind(schema, kinds), "holds": holds})
        level = materialize(level, "paths")
        counts = counts.union(
            level.groupBy("path", "parent", "kind", "holds").agg(F.count(F.lit(1)).alias("n"))
        )
        opened = level.where("holds").lateralJoin(
            spark.tvf.variant_explode(F.col("value").outer()).select(
                F.col("key"), F.col("value").alias("inner")
            )
        )
        step = F.coalesce(F.concat(F.lit("."), "key"), F.lit("[]"))
        level = opened.select(
            F.concat("path", step).alias("path"), F.col("path").alias("parent"), F.col("inner").alias("value")
        )
        if level.isEmpty():
            break
    counts = materialize(counts, "path-kinds")
    around = counts.where("holds").groupBy(F.col("path").alias("parent")).agg(F.sum("n").alias("parents"))
    per_path = counts.groupBy("path", "parent").agg(
        F.sum("n").alias("present"), F.max_by("kind", F.struct("n", "kind")).alias("type"),
        F.bool_or(F.col("kind") == "null").alias("nullable"),
        F.sum((F.col("kind") != "null").cast("int")).alias("kinds"),
    )
    return per_path.join(around, "parent", "left").select(
        "path", "type", "nullable", "present", "parents", (F.col("kinds") > 1).alias("mixed_types"),
        F.when(F.col("kinds") > 1, "string").otherwise(F.col("type")).alias("target_kind"),
        unparsed.scalar().alias("unparsed"),
    )


# --- Fixed values: what each store calls a JSON value's type -------------------------------
KIND_NAMES = {
    "mongodb": ["null", "bool", "long", "double", "string", "object", "array"],
    "dynamodb": ["null", "bool", "number", "number", "string", "map", "list"],
    "neo4j": ["null", "boolean", "integer", "float", "string", "string", "list"],
}


def _kind(schema: Column, kinds: str) -> Column:
    names = KIND_NAMES[kinds]
    return (
        F.when(schema == "VOID", names[0])
        .when(schema == "BOOLEAN", names[1])
        .when(schema == "BIGINT", names[2])
        .when(schema.startswith("DECIMAL") | schema.isin("DOUBLE", "FLOAT"), names[3])
        .when(schema.startswith("OBJECT"), names[5])
        .when(schema.startswith("ARRAY"), names[6])
        .otherwise(names[4])
    )


def relationship_census(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct (source label, relationship, target label) of a property graph, FK-shaped.

    `nodes(id, label)` with each id once, `edges(src, rel, dst)`. A node may have any share of
    the edges: heavy nodes are looked up without moving their edges.
    """
    by_src = nodes.select(F.col("id").alias("src"), F.col("label").alias("table"))
    by_dst = nodes.select(F.col("id").alias("dst"), F.col("label").alias("ref_table"))
    half = join_by_key(edges, by_src, "src").select("table", "rel", "dst").distinct()
    # A target node is now listed once per source label and relationship, so it cannot be heavy.
    return (
        half.join(by_dst, "dst")
        .select(
            "table",
            F.concat(F.lit("-[:"), F.col("rel"), F.lit("]->")).alias("column"),
            "ref_table",
            F.lit("(node)").alias("ref_column"),
        )
        .distinct()
    )

