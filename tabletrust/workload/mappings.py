"""Type mapping, value conversion, change previews, uploads."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabletrust.functions import rules
from tabletrust.operators import mapping, preview
from tabletrust.operators.mapping import ColumnMap
from tabletrust.plans import upload
from tabletrust.session import fresh_path
from tabletrust.sources import delimited
from tabletrust.sources.catalog import read_catalog
from tabletrust.sources.sinks import adapt_rows, replace_table
from tabletrust.workload.profile_sql import quoted
from tabletrust.workload.registry import query
from tabletrust.workload.scenario import DECLARED, table, tables, with_views

# Each part stands for a declared column. Its number picks a native type of some family; its
# size decides how the name is spelled.
NATIVE = rules.NATIVE_TYPES
FAMILIES = list(dict.fromkeys(family for family, _, _ in NATIVE))
NATIVE_SQL = ", ".join(
    f"({i}, {quoted(f)}, {quoted(n)}, {quoted(c)})" for i, (f, n, c) in enumerate(NATIVE)
)
TARGET_SQL = ", ".join(
    f"({quoted(f)}, {quoted(c)}, {quoted(n)})" for f, c, n in rules.TARGET_TYPES
)
SPELLED_SQL = f"""
native(i, family, native, canonical) AS (VALUES {NATIVE_SQL}),
target(family, canonical, target_type) AS (VALUES {TARGET_SQL}),
families(j, family) AS (VALUES {", ".join(f"({j}, {quoted(f)})" for j, f in enumerate(FAMILIES))}),
declared AS (
  SELECT p_partkey, n.family AS source_family, f.family AS target_family, n.canonical AS known,
    CASE WHEN p_size > 48 THEN 'geometry' WHEN p_size > 35 THEN upper(native)
      WHEN p_size > 20 AND native NOT LIKE '%(%' THEN native || '(20)' ELSE ' ' || native END
      AS spelled
  FROM part JOIN native n ON n.i = p_partkey % {len(NATIVE)}
  JOIN families f ON f.j = p_size % {len(FAMILIES)})
"""


def _declared(spark, folder):
    natives = spark.createDataFrame(
        [(i, f, n) for i, (f, n, _) in enumerate(NATIVE)], "i bigint, source_family string, native string"
    )
    families = spark.createDataFrame(list(enumerate(FAMILIES)), "j int, target_family string")
    size, native = F.col("p_size"), F.col("native")
    spelled = (
        F.when(size > 48, "geometry")
        .when(size > 35, F.upper(native))
        .when((size > 20) & ~native.contains("("), F.concat(native, F.lit("(20)")))
        .otherwise(F.concat(F.lit(" "), native))
    )
    part = table(spark, folder, "part").withColumns(
        {"i": F.col("p_partkey") % len(NATIVE), "j": F.col("p_size") % len(FAMILIES)}
    )
    return (
        part.join(F.broadcast(natives), "i")
        .join(F.broadcast(families), "j")
        .select("p_partkey", "source_family", "target_family", spelled.alias("type"))
    )


@query(
    "type_map",
    f"""
    WITH {SPELLED_SQL.strip()}, named AS (
      SELECT *, CASE WHEN spelled = 'geometry' THEN 'text'
        WHEN source_family = 'mysql' AND lower(spelled) LIKE 'tinyint(1)%' THEN 'boolean'
        ELSE known END AS canonical FROM declared)
    SELECT p_partkey, source_family, d.target_family, spelled AS type, d.canonical,
      coalesce(t.target_type, 'TEXT') AS target_type
    FROM named d LEFT JOIN target t ON t.family = d.target_family AND t.canonical = d.canonical
    """,
)
def type_map(spark, folder):
    return mapping.with_target_types(
        _declared(spark, folder), F.col("source_family"), F.col("target_family")
    )


@query(
    "type_map_overrides",
    f"""
    WITH {SPELLED_SQL.strip()}
    SELECT target_type, count(*) AS columns FROM (
      SELECT CASE WHEN lower(trim(spelled)) = 'datetime' THEN 'TIMESTAMPTZ'
        WHEN lower(trim(spelled)) = 'double' THEN 'DECIMAL(12,2)'
        WHEN lower(trim(spelled)) = 'longtext' THEN 'TEXT'
        WHEN lower(trim(spelled)) = 'tinyint(1)' THEN 'BOOLEAN'
        ELSE coalesce(t.target_type, 'TEXT') END AS target_type
      FROM declared d LEFT JOIN target t ON t.family = 'postgres'
        AND t.canonical = CASE WHEN spelled = 'geometry' THEN 'text' ELSE known END)
    GROUP BY target_type
    """,
)
def type_map_overrides(spark, folder):
    """A stack's own rules win over the general ones."""
    special = mapping.stack_types(spark, "laravel-mysql-to-supabase-postgres")
    typed = mapping.with_target_types(
        _declared(spark, folder), F.col("source_family"), "postgres", overrides=special
    )
    return typed.groupBy("target_type").agg(F.count(F.lit(1)).alias("columns"))


# --- conversions ---------------------------------------------------------------------------

LOOSE = (
    ColumnMap("event_id", "id"),
    ColumnMap("flag", "flag", "BOOLEAN", "to_boolean"),
    ColumnMap("amount", "whole", "BIGINT", "to_int"),
    ColumnMap("amount", "amount", "DOUBLE PRECISION", "to_float"),
    ColumnMap("happened", "happened", "TIMESTAMPTZ", "parse_datetime"),
    ColumnMap("user_id", "user_name", "TEXT", "to_string"),
    ColumnMap("ok", "ok", "BOOLEAN", "to_bool"),
    ColumnMap("no_such_column", "blank", "TEXT"),
)


@query(
    "transform_events",
    with_views(
        """
        SELECT event_id AS id,
          CASE WHEN flag IS NOT NULL THEN lower(trim(flag)) IN ('1', 'true', 't', 'yes', 'y') END AS flag,
          CAST(trunc(TRY_CAST(amount AS DOUBLE)) AS BIGINT) AS whole,
          TRY_CAST(amount AS DOUBLE) AS amount,
          CASE WHEN happened = 'soon' THEN NULL ELSE substr(happened, 1, 10) || ' 10:20:30' END AS happened,
          CAST(user_id AS VARCHAR) AS user_name,
          ok = 1 AS ok,
          CAST(NULL AS VARCHAR) AS blank
        FROM loose_events
        """,
        "loose_events",
    ),
)
def transform_events(spark, folder):
    rows = mapping.apply_mapping(table(spark, folder, "loose_events"), LOOSE)
    return rows.withColumn("happened", F.col("happened").cast("string"))


@query(
    "transform_rejects",
    with_views(
        """
        SELECT event_id, 'whole' AS "column", 'to_int' AS transformation, amount AS original
          FROM loose_events WHERE amount = 'n/k'
        UNION ALL SELECT event_id, 'amount', 'to_float', amount FROM loose_events WHERE amount = 'n/k'
        UNION ALL SELECT event_id, 'happened', 'parse_datetime', happened
          FROM loose_events WHERE happened = 'soon'
        """,
        "loose_events",
    ),
)
def transform_rejects(spark, folder):
    return mapping.failed_conversions(table(spark, folder, "loose_events"), LOOSE, "event_id")


ODD = (
    ColumnMap("event_id", "id", "BIGINT"),
    ColumnMap("amount", "whole", "BIGINT", "to_int"),
    ColumnMap("amount", "amount", "DOUBLE PRECISION", "to_float"),
    ColumnMap("happened", "happened", "TIMESTAMPTZ", "parse_datetime"),
)


@query(
    "transform_strict",
    with_views(
        """
        SELECT event_id AS id,
          CASE amount WHEN ' -3.5e2 ' THEN -350 WHEN '9007199254740993' THEN 9007199254740993
            WHEN '1.' THEN 1 END::BIGINT AS whole,
          CASE amount WHEN ' -3.5e2 ' THEN -350.0 WHEN '9007199254740993' THEN 9007199254740992.0
            WHEN '1.' THEN 1.0 END::DOUBLE AS amount,
          CASE happened WHEN '2020-01-02' THEN '2020-01-02 00:00:00'
            WHEN '2020-01-02 03:04:05' THEN happened END AS happened
        FROM odd_events
        """,
        "odd_events",
    ),
)
def transform_strict(spark, folder):
    """Suffixes, hexadecimal floats, bare times and parts of dates are not converted."""
    rows = mapping.apply_mapping(table(spark, folder, "odd_events"), ODD)
    return rows.withColumn("happened", F.col("happened").cast("string"))


@query(
    "rows_split",
    with_views(
        """
        SELECT count(*) FILTER (WHERE amount <> 'n/k' AND happened <> 'soon') AS good,
          count(*) FILTER (WHERE amount = 'n/k' OR happened = 'soon') AS bad
        FROM loose_events
        """,
        "loose_events",
    ),
)
def rows_split(spark, folder):
    good, bad = mapping.split_rows(table(spark, folder, "loose_events"), LOOSE)
    counted = good.agg(F.count(F.lit(1)).alias("good"))
    return counted.withColumn("bad", bad.agg(F.count(F.lit(1))).scalar())


@query(
    "json_stringify",
    """
    SELECT vec_id, len(embedding) AS "values", label,
      len(string_split(array_to_string(embedding, ','), ',')) AS parsed
    FROM embeddings
    """,
)
def json_stringify(spark, folder):
    """Nested values travel as JSON text and read back whole."""
    vectors = table(spark, folder, "embeddings")
    columns = [ColumnMap("vec_id", "vec_id"), ColumnMap("embedding", "text", None, "json_stringify")]
    text = mapping.apply_mapping(vectors, columns)
    return text.join(vectors, "vec_id").select(
        "vec_id",
        F.size("embedding").cast("bigint").alias("values"),
        "label",
        F.size(F.from_json("text", "array<double>")).cast("bigint").alias("parsed"),
    )


PREVIEWED = [
    ColumnMap("event_id", "id", "BIGINT"),
    ColumnMap("ok", "ok", "BOOLEAN"),
    ColumnMap("value", "value", "DECIMAL(10,1)"),
    ColumnMap("user_text", "user_number", "INTEGER"),
    ColumnMap("flag", "flag", "BOOLEAN", "to_boolean"),
    ColumnMap("amount", "amount", "TEXT", "to_string"),
]
CHANGED_SQL = """
changed AS (SELECT event_id, array_to_string(list_filter([
    'ok', CASE WHEN round("value", 2) <> "value" THEN 'value' END, 'user_number',
    CASE WHEN flag IS NOT NULL THEN 'flag' END], lambda x: x IS NOT NULL), ',') AS changed_columns
  FROM loose_events)
"""


@query(
    "change_preview",
    with_views(
        f"WITH {CHANGED_SQL.strip()} SELECT event_id, changed_columns FROM changed ORDER BY event_id LIMIT 50",
        "loose_events",
    ),
)
def change_preview(spark, folder):
    """The fifty rows a person is shown."""
    rows = preview.change_preview(table(spark, folder, "loose_events"), PREVIEWED, ["event_id"])
    return preview.preview_rows(rows, ["event_id"]).select(
        "event_id", F.array_join("changed_columns", ",").alias("changed_columns")
    )


CUSTOMER_PREVIEW = [
    ColumnMap("has_credit", "has_credit", "INTEGER"),
    ColumnMap("ratio", "ratio", "NUMERIC(12,2)"),
    ColumnMap("segment", "segment", "VARCHAR(20)"),
    ColumnMap("credit_flag", "credit", "BOOLEAN"),
    ColumnMap("in_debt", "in_debt", "BOOLEAN"),
]


@query(
    "change_summary",
    with_views(
        """
        SELECT count(*) AS rows_simulated,
          count(*) FILTER (WHERE round(ratio, 2) <> ratio OR credit_flag IS NOT NULL) AS rows_with_changes
        FROM contacts
        """,
        "contacts",
    ),
)
def change_summary(spark, folder):
    rows = preview.change_preview(table(spark, folder, "contacts"), CUSTOMER_PREVIEW, ["contact_id"])
    return preview.change_summary(rows)


@query(
    "changes_per_column",
    with_views(
        """
        SELECT 'ratio' AS "column", count(*) AS rows_changed FROM contacts WHERE round(ratio, 2) <> ratio
        UNION ALL SELECT 'credit', count(*) FROM contacts
        """,
        "contacts",
    ),
)
def changes_per_column(spark, folder):
    rows = preview.change_preview(table(spark, folder, "contacts"), CUSTOMER_PREVIEW, ["contact_id"])
    return preview.changes_per_column(rows)


# --- uploads -------------------------------------------------------------------------------

# Every nation's customers make up one upload; their segments decide which headers it has.
HEADERS_SQL = """
headers AS (SELECT DISTINCT c_nationkey AS upload,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'O_ORDERKEY' WHEN 'AUTOMOBILE' THEN 'o_custkey'
    WHEN 'MACHINERY' THEN CASE WHEN c_nationkey < 12 THEN 'O_TotalPrice' ELSE 'c_name' END
    WHEN 'HOUSEHOLD' THEN CASE WHEN c_nationkey < 18 THEN 'Comment' ELSE 'c_custkey' END
    ELSE CASE WHEN c_nationkey < 6 THEN 'Clerk' ELSE 'Ship Mode' END END AS header
  FROM customer)
"""
CATALOG_SQL = """
cols("table", name) AS (VALUES ('orders', 'o_orderkey'), ('orders', 'o_custkey'),
  ('orders', 'o_orderstatus'), ('orders', 'o_totalprice'), ('orders', 'o_orderdate'),
  ('orders', 'o_orderpriority'), ('customer', 'c_custkey'), ('customer', 'c_name'),
  ('customer', 'c_nationkey'), ('customer', 'c_acctbal'), ('customer', 'c_mktsegment'))
"""
MATCH_SQL = f"""
WITH {HEADERS_SQL.strip()}, {CATALOG_SQL.strip()},
sizes AS (SELECT upload, count(*) AS headers FROM headers GROUP BY upload),
scored AS (SELECT upload, "table", count(DISTINCT name) AS matched
  FROM headers JOIN cols ON lower(header) = name GROUP BY upload, "table"),
ranked AS (SELECT *, row_number() OVER (PARTITION BY upload ORDER BY matched DESC, "table") AS r FROM scored),
best AS (SELECT s.upload, "table", coalesce(matched, 0) AS matched, headers,
  coalesce(matched, 0) >= greatest(1, headers // 2) AS accepted
  FROM sizes s LEFT JOIN ranked k ON k.upload = s.upload AND r = 1)
"""


def _uploads(spark, folder):
    segment, nation = F.col("c_mktsegment"), F.col("c_nationkey")
    header = (
        F.when(segment == "BUILDING", "O_ORDERKEY")
        .when(segment == "AUTOMOBILE", "o_custkey")
        .when(segment == "MACHINERY", F.when(nation < 12, "O_TotalPrice").otherwise("c_name"))
        .when(segment == "HOUSEHOLD", F.when(nation < 18, "Comment").otherwise("c_custkey"))
        .otherwise(F.when(nation < 6, "Clerk").otherwise("Ship Mode"))
    )
    rows = table(spark, folder, "customer")
    headers = rows.select(nation.alias("upload"), F.lit(0).alias("position"), header.alias("header"))
    columns = read_catalog(spark, tables(spark, folder, "orders", "customer"), DECLARED).columns
    return mapping.match_header(headers.distinct(), columns)


@query(
    "header_match",
    MATCH_SQL + 'SELECT upload, "table", matched, headers, accepted FROM best',
)
def header_match(spark, folder):
    return _uploads(spark, folder)[0]


@query(
    "header_leftovers",
    MATCH_SQL
    + """
    SELECT h.upload, header FROM headers h JOIN best b ON b.upload = h.upload AND b.accepted
    WHERE NOT EXISTS (SELECT 1 FROM cols c WHERE c."table" = b."table" AND c.name = lower(header))
    """,
)
def header_leftovers(spark, folder):
    return _uploads(spark, folder)[1].drop("position")


def _upload_file(spark, folder) -> str:
    """Events as a CSV file with untidy headers and NULL words."""
    events = table(spark, folder, "loose_events")
    path = fresh_path(spark, "upload")
    events.select(
        F.col("event_id").cast("string").alias(" Event ID "),
        F.when(F.col("ok") == 1, "True").otherwise("FALSE").alias("Ok?"),
        F.when(F.col("flag") == "0", "N/A").otherwise(F.concat(F.lit(" "), F.col("user_id"))).alias("user"),
        F.col("amount"),
        F.when(F.col("amount") == "n/k", "none").otherwise(F.col("amount")).alias("price"),
        F.lit("null").alias("nothing"),
    ).write.csv(path, header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return path


@query(
    "csv_types",
    with_views(
        """
        SELECT unnest(['Event ID', 'Ok?', 'user', 'amount', 'price', 'nothing']) AS "column",
          unnest(['event_id', 'ok_', 'user', 'amount', 'price', 'nothing']) AS name,
          unnest([
            CASE WHEN count(TRY_CAST(event_id AS BIGINT)) = count(*) THEN 'bigint' ELSE 'string' END,
            'boolean',
            'bigint',
            CASE WHEN count(TRY_CAST(amount AS DOUBLE)) = count(*) THEN 'float' ELSE 'string' END,
            CASE WHEN count(TRY_CAST(nullif(amount, 'n/k') AS DOUBLE)) = count(nullif(amount, 'n/k'))
              THEN 'float' ELSE 'string' END,
            'string']) AS canonical_type
        FROM loose_events
        """,
        "loose_events",
    ),
)
def csv_types(spark, folder):
    cells = delimited.read_delimited(spark, _upload_file(spark, folder))
    types = delimited.column_types(cells)
    return types.withColumn("name", mapping.normal_header(F.col("column"), F.lit(0))).select(
        "column", "name", "canonical_type"
    )


@query(
    "csv_rows",
    with_views(
        """
        SELECT event_id, ok = 1 AS ok, CASE WHEN flag = '0' THEN NULL ELSE user_id END AS "user", amount,
          TRY_CAST(amount AS DOUBLE) AS price
        FROM loose_events
        """,
        "loose_events",
    ),
)
def csv_rows(spark, folder):
    cells = delimited.read_delimited(spark, _upload_file(spark, folder))
    types = {r["column"]: r["canonical_type"] for r in delimited.column_types(cells).collect()}
    return delimited.typed(cells, types).select(
        F.col("`Event ID`").alias("event_id"), F.col("`Ok?`").alias("ok"), "user", "amount", "price"
    )


@query(
    "csv_breaks",
    """
    SELECT doc_id, source, sha256(CASE WHEN lower(trim(text)) IN ('', 'null', 'none', 'n/a') THEN ''
      ELSE coalesce(trim(text), '') END) AS text_sha256
    FROM documents
    """,
)
def csv_breaks(spark, folder):
    """Texts with line breaks and quotes, from files that are read in many splits."""
    path = fresh_path(spark, "texts")
    docs = table(spark, folder, "documents").select("doc_id", "text", "source")
    docs.write.csv(
        path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )
    split = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(split)
    spark.conf.set(split, str(1 << 20))
    try:
        cells = delimited.read_delimited(spark, path)
    finally:
        spark.conf.set(split, before)
    return cells.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), "source",
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"),
    )


@query(
    "upload_insert",
    """
    SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM orders
    UNION ALL
    SELECT -1 - o_orderkey, o_custkey, o_totalprice, NULL FROM orders WHERE o_orderstatus = 'P'
    """,
)
def upload_insert(spark, folder):
    """A file with three known headers and one unknown is appended to the orders table."""
    orders = table(spark, folder, "orders")
    stored = orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    base = fresh_path(spark, "upload-target")
    replace_table(stored, f"{base}/orders")
    orders.where("o_orderstatus = 'P'").select(
        (-1 - F.col("o_orderkey")).alias("O_OrderKey"),
        F.col("o_custkey").alias("o_custkey "),
        F.col("o_totalprice").alias("O_TOTALPRICE"),
        F.lit("by hand").alias("Remark"),
    ).write.csv(f"{base}/file", header=True)
    columns = read_catalog(spark, {"orders": stored, **tables(spark, folder, "customer")}).columns
    types = {"orders": {f.name: f.dataType.simpleString() for f in stored.schema.fields}}
    cells = delimited.read_delimited(spark, f"{base}/file")
    plan = upload.plan_upload(cells, columns, types, "uploaded_data")
    upload.execute_upload(cells, plan, base)
    return spark.read.schema(stored.schema).parquet(f"{base}/orders")


# --- per-target values ---------------------------------------------------------------------


@query(
    "target_adapt_sqlite",
    """
    SELECT o_orderkey, CAST(o_totalprice AS DOUBLE) AS price,
      strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS placed, CAST(o_totalprice > 200000 AS INT) AS big
    FROM orders
    """,
)
def adapt_sqlite(spark, folder):
    rows = table(spark, folder, "orders").select(
        "o_orderkey",
        F.col("o_totalprice").cast("decimal(18,2)").alias("price"),
        F.col("o_orderdate").alias("placed"),
        (F.col("o_totalprice") > 200000).alias("big"),
    )
    return adapt_rows(rows, "sqlite")


@query(
    "target_adapt_bigquery",
    """
    SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S')
      || CASE WHEN microsecond(ts) % 1000000 = 0 THEN ''
         ELSE '.' || lpad(CAST(microsecond(ts) % 1000000 AS VARCHAR), 6, '0') END AS ts,
      strftime(ts, '%Y-%m-%d') AS day, event_type AS raw,
      '{"user":' || user_id || ',"kind":"' || event_type || '"}' AS who
    FROM events
    """,
)
def adapt_bigquery(spark, folder):
    rows = table(spark, folder, "events").select(
        "event_id",
        "ts",
        F.col("ts").cast("date").alias("day"),
        F.encode("event_type", "UTF-8").alias("raw"),
        F.struct(F.col("user_id").alias("user"), F.col("event_type").alias("kind")).alias("who"),
    )
    return adapt_rows(rows, "bigquery")


def _sampler(spark, folder):
    """One column of every kind that families treat in their own way."""
    price, status = F.col("o_totalprice"), F.col("o_orderstatus")
    return table(spark, folder, "orders").select(
        "o_orderkey",
        price.cast("decimal(18,2)").alias("exact"),
        price.alias("price"),
        F.col("o_orderdate").alias("placed"),
        F.when(status != "P", status).otherwise("").alias("state"),
        F.encode("o_orderpriority", "UTF-8").alias("raw"),
        F.struct(F.col("o_custkey").alias("who"), status.alias("state")).alias("nested"),
    )


def _kinds(df, *columns):
    found = dict(df.dtypes)
    return F.lit(" ".join(found[c] for c in columns)).alias("kinds")


@query(
    "target_adapt_mongodb",
    """
    SELECT o_orderkey, CAST(o_totalprice AS DOUBLE) AS exact, o_totalprice AS price, o_custkey AS who,
      CASE WHEN o_orderstatus = 'P' THEN '' ELSE o_orderstatus END AS state,
      strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS placed, 'double timestamp binary' AS kinds
    FROM orders
    """,
)
def adapt_mongodb(spark, folder):
    rows = adapt_rows(_sampler(spark, folder), "mongodb")
    return rows.select(
        "o_orderkey", "exact", "price", F.col("nested.who").alias("who"), "state",
        F.date_format("placed", "yyyy-MM-dd HH:mm:ss").alias("placed"),
        _kinds(rows, "exact", "placed", "raw"),
    )


@query(
    "target_adapt_dynamodb",
    """
    SELECT o_orderkey, o_totalprice AS price, o_custkey AS who,
      CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS state,
      strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS placed, 'decimal(18,2) decimal(38,10) string' AS kinds
    FROM orders
    """,
)
def adapt_dynamodb(spark, folder):
    rows = adapt_rows(_sampler(spark, folder), "dynamodb")
    return rows.select(
        "o_orderkey", F.col("price").cast("double").alias("price"), F.col("nested.who").alias("who"),
        "state", "placed", _kinds(rows, "exact", "price", "placed"),
    )


@query(
    "target_adapt_neo4j",
    """
    SELECT o_orderkey, CAST(o_totalprice AS DOUBLE) AS exact, o_orderpriority AS raw,
      CASE WHEN o_orderstatus = 'P' THEN '' ELSE o_orderstatus END AS state,
      '{"who":' || o_custkey || ',"state":"' || o_orderstatus || '"}' AS nested,
      strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS placed
    FROM orders
    """,
)
def adapt_neo4j(spark, folder):
    rows = adapt_rows(_sampler(spark, folder), "neo4j")
    return rows.select("o_orderkey", "exact", "raw", "state", "nested", "placed")
