"""Scans, catalogs and load order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabletrust.operators import relations, report
from tabletrust.operators.validate import reference_faults, source_references
from tabletrust.session import materialize
from tabletrust.sources import tables as reading
from tabletrust.sources.catalog import read_catalog, relationship_census, row_counts, schema_summary
from tabletrust.workload.registry import query
from tabletrust.workload.scenario import ALL, DECLARED, STAR, table, tables

COUNTS_SQL = "\nUNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS \"rows\" FROM {t}" for t in ALL)
WITH_FKS = ",".join(sorted(t for t in ALL if DECLARED[t].foreign_keys))


@query("table_counts", COUNTS_SQL)
def table_counts(spark, folder):
    return row_counts(tables(spark, folder, *ALL))


@query(
    "schema_summary",
    f"""
    SELECT count(*) AS table_count, CAST(sum("rows") AS BIGINT) AS total_rows,
      '{WITH_FKS}' AS tables_with_fks
    FROM ({COUNTS_SQL})
    """,
)
def summary(spark, folder):
    data = tables(spark, folder, *ALL)
    return schema_summary(read_catalog(spark, data, DECLARED), row_counts(data))


@query(
    "catalog_columns",
    """
    SELECT 'orders' AS "table", "column", declared, present FROM (
      SELECT unnest(['o_orderkey', 'o_custkey', 'o_orderstatus', 'o_totalprice', 'o_orderdate',
                     'o_orderpriority']) AS "column",
        unnest(['BIGINT', 'BIGINT', 'STRING', 'DOUBLE', 'TIMESTAMP_NTZ', 'STRING']) AS declared,
        unnest([count(o_orderkey), count(o_custkey), count(o_orderstatus), count(o_totalprice),
                count(o_orderdate), count(o_orderpriority)]) AS present
      FROM orders)
    """,
)
def catalog_columns(spark, folder):
    data = tables(spark, folder, "orders")
    catalog = read_catalog(spark, data, DECLARED)
    names = data["orders"].columns
    present = data["orders"].agg(*[F.count(c).alias(c) for c in names]).select(
        F.inline(
            F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("present")) for c in names])
        )
    )
    return catalog.columns.join(present, "column").select(
        "table", "column", F.col("type").alias("declared"), "present"
    )


KEYSET_SQL = """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders
WHERE o_orderkey > (SELECT max(o_orderkey) FROM orders WHERE o_orderdate < TIMESTAMP '1995-01-03 00:00:00')
"""


@query("keyset_scan", KEYSET_SQL)
def keyset_scan(spark, folder):
    """Resume after the last key of the orders of the first days."""
    orders = table(spark, folder, "orders")
    last = orders.where(F.col("o_orderdate") < F.lit("1995-01-03").cast("timestamp_ntz")).agg(
        F.max("o_orderkey")
    )
    return reading.rows_after(orders, "o_orderkey", last.first()[0]).select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"
    )


@query(
    "no_key_scan",
    """
    SELECT l_returnflag, l_linestatus, count(*) AS "rows",
      CAST(sum(l_orderkey) AS BIGINT) AS key_sum, CAST(sum(l_linenumber) AS BIGINT) AS line_sum
    FROM lineitem GROUP BY ALL
    """,
)
def no_key_scan(spark, folder):
    """A table without a key is read in parallel as it lies; no paging, no order."""
    return table(spark, folder, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum("l_orderkey").alias("key_sum"),
        F.sum("l_linenumber").alias("line_sum"),
    )


@query(
    "no_key_slices",
    """
    SELECT slice, count(*) AS "rows", CAST(sum(l_orderkey) AS BIGINT) AS l_orderkey_sum
    FROM (SELECT l_orderkey, CASE WHEN l_partkey = l_suppkey THEN 0
      ELSE CAST(abs(l_partkey - l_suppkey) % 8 AS INTEGER) END AS slice FROM lineitem)
    GROUP BY slice
    """,
)
def no_key_slices(spark, folder):
    """The slices in which a table without a key is read over JDBC hold each row once."""
    slices = reading.hash_slices("NULLIF(l_partkey - l_suppkey, 0)", 8)
    return reading.slice_sizes(table(spark, folder, "lineitem"), slices, ["l_orderkey"])


@query(
    "key_lookup",
    """
    SELECT c_custkey, c_name, c_acctbal FROM customer
    WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 490000)
    """,
)
def key_lookup(spark, folder):
    wanted = table(spark, folder, "orders").where("o_totalprice > 490000")
    wanted = wanted.select(F.col("o_custkey").alias("c_custkey"))
    return reading.rows_by_key(table(spark, folder, "customer"), "c_custkey", wanted).select(
        "c_custkey", "c_name", "c_acctbal"
    )


@query("head_sample", "SELECT event_id, user_id, event_type, value FROM events ORDER BY event_id LIMIT 1000")
def head_sample(spark, folder):
    events = table(spark, folder, "events").select("event_id", "user_id", "event_type", "value")
    return reading.head(events, ["event_id"], 1000)


# Orders whose customers, parts and suppliers all exist give the edges of the load order.
REFERENCES = source_references(DECLARED, STAR)
EDGES_SQL = "\nUNION ALL ".join(
    f"""SELECT '{t}' AS "table", '{rt}' AS ref_table,
      (SELECT count(*) FROM {t} WHERE {c} IS NOT NULL
         AND {c} NOT IN (SELECT {rc} FROM {rt} WHERE {rc} IS NOT NULL)) AS orphans"""
    for t, c, rt, rc in REFERENCES
)
LEVELS_SQL = f"""
WITH RECURSIVE edges AS ({EDGES_SQL}),
sizes AS ({" UNION ALL ".join(f"SELECT '{t}' AS t, count(*) AS n FROM {t}" for t in STAR)}),
walk(t, depth) AS (
  SELECT t, 0 FROM sizes
  UNION
  SELECT e."table", w.depth + 1 FROM walk w JOIN edges e ON e.ref_table = w.t
  WHERE e.orphans = 0 AND w.depth < 7),
levels AS (SELECT t, max(depth) AS level FROM walk GROUP BY t)
"""


@query(
    "fk_load_order",
    LEVELS_SQL
    + """
    SELECT l.t AS "table", l.level, n AS "rows",
      CAST(row_number() OVER (ORDER BY level, l.t) AS INT) AS load_position,
      CAST(row_number() OVER (ORDER BY level DESC, l.t DESC) AS INT) AS drop_position
    FROM levels l JOIN sizes s ON s.t = l.t
    """,
)
def fk_load_order(spark, folder):
    """Load and drop order over the references the data bears out."""
    data = tables(spark, folder, *STAR)
    edges = reference_faults(data, REFERENCES).where("orphans = 0").select("table", "ref_table")
    sizes = materialize(row_counts(data), "sizes")
    order = relations.load_order(sizes.select("table"), edges)
    return order.join(sizes, "table").select("table", "level", "rows", "load_position", "drop_position")


@query(
    "fk_load_order_large",
    """
    SELECT 'part_' || p_partkey AS "table",
      CAST(CASE WHEN p_partkey BETWEEN 1 AND 150 THEN p_partkey - 1 WHEN p_partkey BETWEEN 160 AND 163 THEN -1
        ELSE 0 END AS INT) AS level,
      p_partkey BETWEEN 160 AND 163 AS in_cycle
    FROM part
    """,
)
def fk_load_order_large(spark, folder):
    """A catalog of one table per part: a chain of 150 tables, a cycle of three, and one below it."""
    k = F.col("p_partkey")
    parent = (
        F.when((k > 1) & (k <= 150), k - 1)
        .when((k == 160) | (k == 161), k + 1)
        .when((k == 162) | (k == 163), F.lit(160))
        .otherwise(k)
    )
    name = lambda c: F.concat(F.lit("part_"), c.cast("string"))
    links = table(spark, folder, "part").select(name(k).alias("table"), name(parent).alias("ref_table"))
    return relations.load_order(links.select("table"), links).select("table", "level", "in_cycle")


@query(
    "table_status",
    LEVELS_SQL
    + """
    SELECT l.t AS "table", CAST(row_number() OVER (ORDER BY level, l.t) AS INT) AS load_position,
      CASE l.t WHEN 'part' THEN 'skipped' WHEN 'orders' THEN 'migrating'
        WHEN 'customer' THEN 'validated' WHEN 'nation' THEN 'validated'
        WHEN 'region' THEN 'validated' ELSE 'pending' END AS status,
      CASE l.t WHEN 'orders' THEN (SELECT count(*) FROM orders WHERE o_orderstatus = 'F')
        WHEN 'customer' THEN (SELECT count(*) FROM customer)
        WHEN 'nation' THEN (SELECT count(*) FROM nation)
        WHEN 'region' THEN (SELECT count(*) FROM region) ELSE 0 END AS rows_committed,
      coalesce((SELECT string_agg(DISTINCT ref_table, ',' ORDER BY ref_table) FROM edges
                WHERE "table" = l.t), '') AS depends_on
    FROM levels l
    """,
)
def table_status(spark, folder):
    """A run in progress: three tables done, orders under way, part left out."""
    data = tables(spark, folder, *STAR)
    edges = materialize(reference_faults(data, REFERENCES).select("table", "ref_table"), "edges")
    done = row_counts({t: data[t] for t in ("region", "nation", "customer")})
    part_way = row_counts({"orders": data["orders"].where("o_orderstatus = 'F'")})
    log = done.withColumn("done", F.lit(True)).unionByName(part_way.withColumn("done", F.lit(False)))
    log = materialize(log, "run-log")
    names = materialize(row_counts(data).select("table"), "plan-tables")
    order = relations.load_order(names, edges)
    return report.table_status(names, order, edges, log, validated=True, skipped=("part",))


@query(
    "relationship_census",
    """
    SELECT DISTINCT a.label AS "table", '-[:' || rel || ']->' AS "column", b.label AS ref_table,
      '(node)' AS ref_column
    FROM (SELECT 'c' || c_custkey AS src, 'lives_in' AS rel, 'n' || c_nationkey AS dst FROM customer
          UNION ALL SELECT 'n' || n_nationkey, 'part_of', 'r' || n_regionkey FROM nation
          UNION ALL SELECT 'o' || o_orderkey, 'placed_by', 'c' || o_custkey FROM orders
          UNION ALL SELECT 'c' || o_custkey, 'placed', 'o' || o_orderkey FROM orders) e
    JOIN (SELECT 'c' || c_custkey AS id,
            CASE WHEN c_acctbal < 0 THEN 'debtor' ELSE 'customer' END AS label FROM customer
          UNION ALL SELECT 'n' || n_nationkey, 'nation' FROM nation
          UNION ALL SELECT 'r' || r_regionkey, 'region' FROM region
          UNION ALL SELECT 'o' || o_orderkey, 'order' FROM orders) a ON a.id = e.src
    JOIN (SELECT 'c' || c_custkey AS id,
            CASE WHEN c_acctbal < 0 THEN 'debtor' ELSE 'customer' END AS label FROM customer
          UNION ALL SELECT 'n' || n_nationkey, 'nation' FROM nation
          UNION ALL SELECT 'r' || r_regionkey, 'region' FROM region
          UNION ALL SELECT 'o' || o_orderkey, 'order' FROM orders) b ON b.id = e.dst
    """,
)
def graph_links(spark, folder):
    data = tables(spark, folder, "region", "nation", "customer", "orders")

    def node(t: str, mark: str, key: str, label) -> DataFrame:
        return data[t].select(F.concat(F.lit(mark), F.col(key)).alias("id"), label.alias("label"))

    def edge(t: str, m1: str, k1: str, rel: str, m2: str, k2: str) -> DataFrame:
        return data[t].select(
            F.concat(F.lit(m1), F.col(k1)).alias("src"),
            F.lit(rel).alias("rel"),
            F.concat(F.lit(m2), F.col(k2)).alias("dst"),
        )

    person = F.when(F.col("c_acctbal") < 0, "debtor").otherwise("customer")
    nodes = reduce(
        DataFrame.unionAll,
        [
            node("customer", "c", "c_custkey", person),
            node("nation", "n", "n_nationkey", F.lit("nation")),
            node("region", "r", "r_regionkey", F.lit("region")),
            node("orders", "o", "o_orderkey", F.lit("order")),
        ],
    )
    edges = reduce(
        DataFrame.unionAll,
        [
            edge("customer", "c", "c_custkey", "lives_in", "n", "c_nationkey"),
            edge("nation", "n", "n_nationkey", "part_of", "r", "n_regionkey"),
            edge("orders", "o", "o_orderkey", "placed_by", "c", "o_custkey"),
            edge("orders", "c", "o_custkey", "placed", "o", "o_orderkey"),
        ],
    )
    return relationship_census(nodes, edges)
