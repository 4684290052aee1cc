"""Inputs of the registered queries: the given tables, and tables derived from all their rows.

The given tables are clean, so checks on them find nothing. The derived ones carry faults
where a row's own values say so. Each definition is one SQL text that Spark and the checking
engine both run, so both sides look at the same input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabletrust.sources.catalog import Declared

STAR = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]
ALL = [
    *STAR, "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

DECLARED = {
    "region": Declared(key=("r_regionkey",)),
    "nation": Declared(
        key=("n_nationkey",), foreign_keys=(("n_regionkey", "region", "r_regionkey"),)
    ),
    "customer": Declared(
        key=("c_custkey",), foreign_keys=(("c_nationkey", "nation", "n_nationkey"),)
    ),
    "supplier": Declared(
        key=("s_suppkey",), foreign_keys=(("s_nationkey", "nation", "n_nationkey"),)
    ),
    "part": Declared(key=("p_partkey",)),
    "orders": Declared(
        key=("o_orderkey",), foreign_keys=(("o_custkey", "customer", "c_custkey"),)
    ),
    "lineitem": Declared(
        foreign_keys=(
            ("l_orderkey", "orders", "o_orderkey"),
            ("l_partkey", "part", "p_partkey"),
            ("l_suppkey", "supplier", "s_suppkey"),
        )
    ),
    "events": Declared(key=("event_id",)),
    "documents": Declared(key=("doc_id",)),
    "embeddings": Declared(key=("vec_id",)),
    "pages": Declared(key=("page_id",)),
    "benchmark": Declared(key=("item_id",)),
    "labels": Declared(),
    "conversations": Declared(key=("conv_id", "turn")),
}

# Text columns of every shape the detectors know, some with a share of garbage.
CONTACTS = """
SELECT c_custkey AS contact_id,
  CASE WHEN c_acctbal < -560 THEN 'unknown'
       ELSE lower(replace(c_name, '#', '.')) || '@example.com' END AS email,
  CASE WHEN c_acctbal < 500 THEN 'unknown'
       ELSE lower(replace(c_name, '#', '.')) || '@example.com' END AS old_email,
  '+1 (555) ' || lpad(CAST(c_nationkey AS STRING), 3, '0') || '-'
       || lpad(CAST(c_custkey AS STRING), 6, '0') AS phone,
  '00000000-0000-4000-8000-' || lpad(CAST(c_custkey AS STRING), 12, '0') AS guid,
  'https://example.com/c/' || CAST(c_custkey AS STRING) AS homepage,
  lpad(CAST(c_custkey AS STRING), 9, '0') AS area_code,
  CAST(100000 + c_custkey AS STRING) AS postal_text,
  CAST(1000000 + c_custkey AS STRING) AS ref_no,
  CAST(10000 + c_nationkey AS BIGINT) AS zip_code,
  1700000000 + c_custkey AS signup_s,
  (1700000000 + c_custkey) * 1000 AS signup_ms,
  CASE WHEN c_nationkey < 5 THEN '2021-03-04' WHEN c_nationkey < 10 THEN '2021-03-04T05:06:07'
       WHEN c_nationkey < 15 THEN '03/04/2021' WHEN c_nationkey < 20 THEN '04-03-2021'
       ELSE '1614834367' END AS seen,
  CASE WHEN c_acctbal < -560 THEN 'never' ELSE '2021-03-04' END AS joined,
  CASE WHEN c_acctbal < -560 THEN '{"k": 1}x' ELSE '{"k": 1}' END AS payload,
  CASE WHEN c_acctbal < 500 THEN '{"k": ' ELSE '[1, 2]' END AS weak_payload,
  c_acctbal AS balance,
  c_acctbal / 3 AS ratio,
  c_name AS note,
  CASE WHEN c_acctbal < 0 THEN 0 ELSE 1 END AS has_credit,
  CASE WHEN c_acctbal < 0 THEN '0' ELSE '1' END AS credit_flag,
  c_acctbal < 0 AS in_debt,
  CASE WHEN c_acctbal < 0 THEN NULL ELSE c_mktsegment END AS segment,
  CAST(NULL AS STRING) AS fax
FROM {customer}
"""

# Orders with empty, placeholder and sentinel values.
DIRTY_ORDERS = """
SELECT o_orderkey, o_custkey,
  CASE WHEN o_totalprice < 5000 THEN '' ELSE o_orderpriority END AS o_orderpriority,
  CASE WHEN o_totalprice < 20000 THEN '1970-01-01'
       WHEN o_totalprice > 490000 THEN '1900-01-01 00:00:00'
       WHEN o_totalprice > 480000 THEN NULL
       ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS o_orderdate,
  CASE WHEN o_orderstatus = 'P' THEN CAST(-1 AS DOUBLE)
       WHEN o_totalprice < 20000 THEN CAST(9999 AS DOUBLE) ELSE o_totalprice END AS o_totalprice,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 99999 ELSE o_custkey + 1000000 END AS o_clerk
FROM {orders}
"""

# A parent table with gaps, and a UNIQUE column with repeats, one of them very frequent.
DIRTY_CUSTOMER = """
SELECT c_custkey, c_nationkey, c_acctbal, c_mktsegment,
  CASE WHEN c_acctbal < 0 THEN 'Customer#unknown'
       WHEN c_acctbal > 9800 THEN c_mktsegment ELSE c_name END AS c_name
FROM {customer} WHERE c_acctbal > -700
"""

# A copy of orders that lags behind and has one altered group.
ORDERS_COPY = """
SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderstatus AS status,
  CASE WHEN o_totalprice > 490000 THEN o_totalprice + 0.01 ELSE o_totalprice END AS total,
  o_orderdate AS placed_at, o_orderpriority AS priority
FROM {orders} WHERE o_orderdate < TIMESTAMP '2001-07-01 00:00:00'
"""

# A copy of customer that holds everything but the customers deepest in debt, plus one group twice
# under new keys.
CUSTOMER_COPY = """
SELECT c_custkey AS id, c_name AS name, c_nationkey AS nation_id, c_acctbal AS balance,
  c_mktsegment AS segment
FROM {customer} WHERE c_acctbal > -950
UNION ALL
SELECT -1 - c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment
FROM {customer} WHERE c_acctbal > 9950
"""

# Events as loosely typed text, the way an untyped store hands them over.
LOOSE_EVENTS = """
SELECT event_id, user_id,
  CASE WHEN event_type = 'error' THEN 'Yes' WHEN event_type = 'click' THEN ' TRUE '
       WHEN event_type = 'view' THEN '0' WHEN event_type = 'signup' THEN 'maybe' END AS flag,
  CASE WHEN value > 60 THEN 'n/k' ELSE CAST(CAST(floor(value) AS BIGINT) AS STRING) || '.75' END
       AS amount,
  CASE WHEN value < 1 THEN 'soon'
       WHEN event_type = 'view' THEN CAST(CAST(ts AS DATE) AS STRING) || 'T10:20:30Z'
       ELSE CAST(CAST(ts AS DATE) AS STRING) || ' 10:20:30' END AS happened,
  CAST(user_id AS STRING) AS user_text,
  CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS ok,
  value,
  props
FROM {events}
"""

# Text that only looks like numbers and moments.
ODD_EVENTS = """
SELECT event_id, value,
  CASE event_id % 8 WHEN 0 THEN '12d' WHEN 1 THEN '0x1p3' WHEN 2 THEN '7f' WHEN 3 THEN ' -3.5e2 '
       WHEN 4 THEN '9007199254740993' WHEN 5 THEN '1.' WHEN 6 THEN 'x' END AS amount,
  CASE event_id % 7 WHEN 0 THEN '10:20:30' WHEN 1 THEN '2020' WHEN 2 THEN '2020-05'
       WHEN 3 THEN '2020-1-2' WHEN 4 THEN '2020-01-02' WHEN 5 THEN '2020-01-02 03:04:05' END AS happened
FROM {events}
"""

# JSON documents whose fields come, go, and change type.
DOCUMENTS_JSON = """
SELECT '{"_id": ' || CAST(event_id AS STRING) || ', "kind": "' || event_type || '"'
  || CASE WHEN event_type = 'view' THEN ''
          WHEN event_type = 'error' THEN ', "k": "' || CAST(user_id AS STRING) || '"'
          ELSE ', "k": ' || CAST(user_id AS STRING) END
  || CASE WHEN value > 60 THEN ', "note": null' ELSE ', "note": "n"' END
  || CASE WHEN value > 10 THEN ', "tags": [1, 2]' ELSE '' END
  || ', "v": ' || CAST(CAST(floor(value) AS BIGINT) AS STRING) || '.25'
  || ', "ok": true, "at": {"d": 1}}' AS doc
FROM {events}
"""

# Catalog snapshots: every part stands for a column of a table, its brand for a monitored
# database.
BASE_CATALOG = """
SELECT p_brand AS monitor, p_name AS "table",
  CASE WHEN p_size > 45 THEN 'is_' WHEN p_size > 40 THEN 'price_' WHEN p_size > 38 THEN 'email_'
       ELSE 'c_' END || CAST(p_partkey AS STRING) AS "column",
  CASE p_type WHEN 'ECONOMY' THEN 'BIGINT' WHEN 'STANDARD' THEN 'VARCHAR(20)'
       WHEN 'PROMO' THEN 'DECIMAL(10,2)' WHEN 'SMALL' THEN 'TIMESTAMP'
       WHEN 'MEDIUM' THEN 'VARCHAR(255)' ELSE 'INT' END AS "type",
  p_size < 30 AS nullable,
  CASE WHEN p_size < 10 THEN '0' END AS "default"
FROM {part} WHERE p_retailprice < 999 AND NOT (p_name LIKE 'red%' AND p_brand = 'Brand#3')
"""
CURRENT_CATALOG = """
SELECT p_brand AS monitor, p_name AS "table",
  CASE WHEN p_size > 45 THEN 'is_' WHEN p_size > 40 THEN 'price_' WHEN p_size > 38 THEN 'email_'
       ELSE 'c_' END || CAST(p_partkey AS STRING) AS "column",
  CASE WHEN p_size < 25 THEN
    CASE p_type WHEN 'ECONOMY' THEN 'BIGINT' WHEN 'STANDARD' THEN 'VARCHAR(20)'
       WHEN 'PROMO' THEN 'DECIMAL(10,2)' WHEN 'SMALL' THEN 'TIMESTAMP'
       WHEN 'MEDIUM' THEN 'VARCHAR(255)' ELSE 'INT' END
  ELSE
    CASE p_type WHEN 'ECONOMY' THEN 'SMALLINT' WHEN 'STANDARD' THEN 'VARCHAR(40)'
       WHEN 'PROMO' THEN 'FLOAT' WHEN 'SMALL' THEN 'DATE'
       WHEN 'MEDIUM' THEN 'VARCHAR(50)' ELSE 'BIGINT' END
  END AS "type",
  CASE WHEN p_size BETWEEN 28 AND 31 THEN p_size >= 30 ELSE p_size < 30 END AS nullable,
  CASE WHEN p_size < 10 THEN '0' END AS "default"
FROM {part} WHERE p_retailprice > 901 AND NOT (p_name LIKE 'blue%' AND p_brand = 'Brand#7')
"""
BASE_INDEXES = """
SELECT p_brand AS monitor, p_name AS "table", 'ix_' || CAST(p_partkey AS STRING) AS "index",
  p_size > 25 AS "unique"
FROM {part} WHERE p_retailprice < 999 AND p_size <> 7
"""
CURRENT_INDEXES = """
SELECT p_brand AS monitor, p_name AS "table", 'ix_' || CAST(p_partkey AS STRING) AS "index",
  p_size > 25 AS "unique"
FROM {part} WHERE p_retailprice < 999 AND p_size <> 9
"""

VIEWS = {
    "contacts": CONTACTS,
    "dirty_orders": DIRTY_ORDERS,
    "dirty_customer": DIRTY_CUSTOMER,
    "orders_copy": ORDERS_COPY,
    "customer_copy": CUSTOMER_COPY,
    "loose_events": LOOSE_EVENTS,
    "odd_events": ODD_EVENTS,
    "documents_json": DOCUMENTS_JSON,
    "base_catalog": BASE_CATALOG,
    "current_catalog": CURRENT_CATALOG,
    "base_indexes": BASE_INDEXES,
    "current_indexes": CURRENT_INDEXES,
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A given table, or a derived one."""
    if name not in VIEWS:
        return spark.read.parquet(f"{folder}/{name}.parquet")
    text = VIEWS[name].replace('"', "`") if name.endswith(("catalog", "indexes")) else VIEWS[name]
    base = next(t for t in ALL if "{" + t + "}" in text)
    return spark.sql(_keep_literals(text, base), **{base: table(spark, folder, base)})


def _keep_literals(text: str, base: str) -> str:
    """Braces that are not the table's own are part of JSON literals."""
    marked = text.replace("{" + base + "}", "\0").replace("{", "{{").replace("}", "}}")
    return marked.replace("\0", "{" + base + "}")


def tables(spark: SparkSession, folder: str, *names: str) -> dict[str, DataFrame]:
    return {name: table(spark, folder, name) for name in names}


def with_views(sql: str, *names: str) -> str:
    """`sql` with the derived tables it uses as leading CTEs."""
    parts = []
    for name in names:
        text = VIEWS[name]
        base = next(t for t in ALL if "{" + t + "}" in text)
        parts.append(f"{name} AS ({text.replace('{' + base + '}', base).strip()})")
    body = sql.strip()
    if not parts:
        return body
    if body.upper().startswith("WITH RECURSIVE"):
        return "WITH RECURSIVE " + ",\n".join(parts) + ",\n" + body[len("WITH RECURSIVE") :].lstrip()
    if body.upper().startswith("WITH "):
        return "WITH " + ",\n".join(parts) + ",\n" + body[5:]
    return "WITH " + ",\n".join(parts) + "\n" + body
