"""Documents and tables turned into each other."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabletrust.operators import reshape
from tabletrust.sources.catalog import document_census, path_census
from tabletrust.workload.registry import query
from tabletrust.workload.scenario import table, with_views

FIELDS = ["_id", "kind", "k", "note", "tags", "v", "ok", "at"]
FIELD_SQL = "\nUNION ALL ".join(
    f"""SELECT '{f}' AS field, json_type(doc, '$.{f}') AS t FROM documents_json
    WHERE json_exists(doc, '$.{f}')"""
    for f in FIELDS
)


def _census_sql(names: dict[str, str]) -> str:
    kinds = " ".join(f"WHEN '{json}' THEN '{name}'" for json, name in names.items())
    return with_views(
        f"""
        WITH typed AS (SELECT field, CASE t {kinds} END AS kind FROM ({FIELD_SQL})),
        counted AS (SELECT field, kind, count(*) AS n FROM typed GROUP BY field, kind),
        folded AS (SELECT field, CAST(sum(n) AS BIGINT) AS present,
          arg_max(kind, struct_pack(n := n, kind := kind)) AS "type", bool_or(kind = 'null') AS nullable,
          count(*) FILTER (WHERE kind <> 'null') AS kinds FROM counted GROUP BY field),
        total AS (SELECT count(*) AS docs FROM documents_json)
        SELECT field, "type", nullable, field = '_id' AS primary_key, present,
          round(100.0 * present / docs, 1) AS presence_pct, present / docs::DOUBLE < 0.8 AS optional,
          kinds > 1 AS mixed_types, CASE WHEN kinds > 1 THEN 'string' ELSE "type" END AS target_kind
        FROM folded, total
        """,
        "documents_json",
    )


@query(
    "json_field_census",
    _census_sql(
        {
            "NULL": "null", "BOOLEAN": "bool", "UBIGINT": "long", "BIGINT": "long",
            "DOUBLE": "double", "VARCHAR": "string", "OBJECT": "object", "ARRAY": "array",
        }
    ),
)
def json_field_census(spark, folder):
    return document_census(table(spark, folder, "documents_json"), "doc")


@query(
    "json_field_census_wide_column",
    _census_sql(
        {
            "NULL": "null", "BOOLEAN": "bool", "UBIGINT": "number", "BIGINT": "number",
            "DOUBLE": "number", "VARCHAR": "string", "OBJECT": "map", "ARRAY": "list",
        }
    ),
)
def json_field_census_wide_column(spark, folder):
    return document_census(table(spark, folder, "documents_json"), "doc", "dynamodb")


# One document per chat: a head with a list of turns, each with a list of numbers; some are cut off.
CHAT_DOC = """
'{"id":' || conv_id || ',"head":{"role":"' || role || '","n":' ||
  CASE WHEN turn % 2 = 0 THEN CAST(turn AS STRING) ELSE '"' || turn || '"' END ||
  '},"turns":[{"size":' || length(text) || ',"marks":[' || turn || ',null,1.5]},' ||
  CASE WHEN turn % 3 = 0 THEN '[]' ELSE '{"size":null,"deep":{"ok":true}}' END || ']' ||
  CASE WHEN conv_id % 7 = 0 THEN '' ELSE '}' END
"""


@query(
    "json_path_census",
    f"""
    WITH docs AS (SELECT {CHAT_DOC.replace("STRING", "VARCHAR")} AS doc FROM conversations),
    good AS (SELECT doc FROM docs WHERE json_valid(doc)),
    nodes AS (SELECT regexp_replace(t.fullkey, '[[][0-9]+[]]', '[]', 'g') AS path,
      regexp_replace(t.path, '[[][0-9]+[]]', '[]', 'g') AS parent,
      CASE t.type WHEN 'NULL' THEN 'null' WHEN 'BOOLEAN' THEN 'bool' WHEN 'UBIGINT' THEN 'long'
        WHEN 'BIGINT' THEN 'long' WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string'
        WHEN 'OBJECT' THEN 'object' ELSE 'array' END AS kind
      FROM good, json_tree(doc) t),
    counted AS (SELECT path, parent, kind, count(*) AS n FROM nodes GROUP BY ALL),
    inside AS (SELECT path AS parent, CAST(sum(n) AS BIGINT) AS parents FROM counted
      WHERE kind IN ('object', 'array') GROUP BY path),
    folded AS (SELECT path, CASE WHEN path = '$' THEN NULL ELSE parent END AS parent,
      CAST(sum(n) AS BIGINT) AS present,
      arg_max(kind, struct_pack(n := n, kind := kind)) AS "type", bool_or(kind = 'null') AS nullable,
      count(*) FILTER (WHERE kind <> 'null') AS kinds FROM counted GROUP BY ALL)
    SELECT path, "type", nullable, present, parents, kinds > 1 AS mixed_types,
      CASE WHEN kinds > 1 THEN 'string' ELSE "type" END AS target_kind,
      (SELECT count(*) FROM docs WHERE NOT json_valid(doc)) AS unparsed
    FROM folded LEFT JOIN inside USING (parent)
    """,
)
def json_path_census(spark, folder):
    docs = table(spark, folder, "conversations").select(F.expr(CHAT_DOC).alias("doc"))
    return path_census(docs, "doc")


# Conversations as documents with their turns inside, three to a segment.
def _talks(spark, folder):
    turns = table(spark, folder, "conversations")
    parents = turns.select("conv_id").distinct()
    return reshape.embed_children(
        parents, "conv_id", turns, "conv_id", ["turn", "role", "text"], per_document=3
    )


@query(
    "array_shape",
    """
    SELECT 'children' AS "column", round(avg(n), 3) AS avg_size,
      CASE WHEN avg(n) > 3 THEN 'child_table' ELSE 'json_column' END AS shape
    FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id)
    """,
)
def array_shape(spark, folder):
    return reshape.array_size(_talks(spark, folder), "children", "conv_id")


@query(
    "array_child_table",
    """
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS position,
      turn, role, text
    FROM conversations
    """,
)
def array_child_table(spark, folder):
    return reshape.child_table(_talks(spark, folder), "conv_id", "children")


@query(
    "array_json_column",
    """
    SELECT conv_id, segment, segment * 3 AS "offset",
      CAST(to_json(list({'turn': turn, 'role': role, 'text': text} ORDER BY turn, role, text)) AS VARCHAR)
        AS children
    FROM (SELECT *, (row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1) // 3 AS segment
      FROM conversations)
    GROUP BY conv_id, segment
    """,
)
def array_json_column(spark, folder):
    return reshape.json_column(_talks(spark, folder), "children")


@query(
    "embed_children",
    """
    SELECT c_custkey, c_name, count(o_orderkey) AS orders,
      coalesce(string_agg(o_orderkey || ':' || o_orderstatus, ',' ORDER BY o_orderkey), '') AS children
    FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_name
    """,
)
def embed_children(spark, folder):
    customers = table(spark, folder, "customer").select("c_custkey", "c_name")
    orders = table(spark, folder, "orders")
    embedded = reshape.embed_children(
        customers, "c_custkey", orders, "o_custkey", ["o_orderkey", "o_orderstatus"]
    )
    pairs = F.transform(
        "children", lambda c: F.concat(c["o_orderkey"].cast("string"), F.lit(":"), c["o_orderstatus"])
    )
    return embedded.select(
        "c_custkey",
        "c_name",
        F.size("children").cast("bigint").alias("orders"),
        F.array_join(pairs, ",").alias("children"),
    )


@query(
    "embed_children_split",
    """
    SELECT user_id, segment, segment * 4 AS "offset",
      string_agg(event_id || ':' || event_type, ',' ORDER BY event_id, event_type) AS events
    FROM (SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY event_id, event_type) - 1) // 4
        AS segment FROM events)
    GROUP BY user_id, segment
    """,
)
def embed_children_split(spark, folder):
    """Users with more than four events become several documents, each a range of them in order."""
    events = table(spark, folder, "events")
    users = events.select("user_id").distinct()
    embedded = reshape.embed_children(
        users, "user_id", events, "user_id", ["event_id", "event_type"], per_document=4
    )
    pairs = F.transform(
        "children", lambda c: F.concat(c["event_id"].cast("string"), F.lit(":"), c["event_type"])
    )
    return embedded.select("user_id", "segment", "offset", F.array_join(pairs, ",").alias("events"))
