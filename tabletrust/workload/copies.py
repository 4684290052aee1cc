"""Writing tables under each conflict rule, and proving copies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabletrust.operators import report, validate
from tabletrust.operators.mapping import ColumnMap, TableMap, apply_mapping, table_maps
from tabletrust.operators.profile import personal_columns, profile_dataset
from tabletrust.plans.migration import (
    analyse,
    copy_tables,
    final_report,
    order_of,
    plan,
    validate_copy,
)
from tabletrust.session import fresh_path
from tabletrust.sources import keyed, sinks
from tabletrust.sources.catalog import Declared, read_catalog
from tabletrust.workload.registry import query
from tabletrust.workload.scenario import DECLARED, table, tables, with_views

# --- keyed writes --------------------------------------------------------------------------

# The table already holds the orders that are closed. The batch brings open and pending ones,
# closed ones again at a new price, and every order of the dearest group twice.
OLD_SQL = "old AS (SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F')"
NEW_SQL = """
new AS (SELECT o_orderkey, o_totalprice + 1 AS o_totalprice, 1 AS seq FROM orders
    WHERE o_orderpriority <> '5-LOW'
  UNION ALL SELECT o_orderkey, o_totalprice + 2, 2 FROM orders
    WHERE o_orderpriority <> '5-LOW' AND o_totalprice > 400000)
"""


def _old(spark, folder) -> DataFrame:
    orders = table(spark, folder, "orders").where("o_orderstatus = 'F'")
    return orders.select("o_orderkey", "o_totalprice")


def _new(spark, folder) -> DataFrame:
    orders = table(spark, folder, "orders").where("o_orderpriority <> '5-LOW'")
    price = F.col("o_totalprice")
    first = orders.select("o_orderkey", (price + 1).alias("o_totalprice"), F.lit(1).alias("_seq"))
    again = orders.where(price > 400000)
    return first.unionAll(
        again.select("o_orderkey", (price + 2).alias("o_totalprice"), F.lit(2).alias("_seq"))
    )


def _written(spark, folder, strategy: str) -> tuple[DataFrame, int]:
    target = keyed.KeyedTable(spark, fresh_path(spark, strategy), "o_orderkey", rows_per_bucket=1 << 16)
    target.create(_old(spark, folder))
    written = keyed.write_keyed(target, _new(spark, folder), strategy, "_seq")
    return target.read(), written


@query(
    "write_skip",
    f"""
    WITH {OLD_SQL}, {NEW_SQL.strip()}
    SELECT * FROM old
    UNION ALL SELECT o_orderkey, o_totalprice FROM new
    WHERE seq = 1 AND o_orderkey NOT IN (SELECT o_orderkey FROM old)
    """,
)
def write_skip(spark, folder):
    return _written(spark, folder, "skip")[0]


@query(
    "write_overwrite",
    f"""
    WITH {OLD_SQL}, {NEW_SQL.strip()}
    SELECT * FROM old WHERE o_orderkey NOT IN (SELECT o_orderkey FROM new)
    UNION ALL SELECT o_orderkey, arg_max(o_totalprice, seq) FROM new GROUP BY o_orderkey
    """,
)
def write_overwrite(spark, folder):
    return _written(spark, folder, "overwrite")[0]


@query(
    "write_counts",
    f"""
    WITH {OLD_SQL}, {NEW_SQL.strip()}
    SELECT 'skip' AS strategy, count(DISTINCT o_orderkey) AS written FROM new
      WHERE o_orderkey NOT IN (SELECT o_orderkey FROM old)
    UNION ALL SELECT 'overwrite', count(DISTINCT o_orderkey) FROM new
    """,
)
def write_counts(spark, folder):
    """Rows each rule reports as written, from two writes of the whole batch."""
    rows = [(s, _written(spark, folder, s)[1]) for s in ("skip", "overwrite")]
    return spark.createDataFrame(rows, "strategy string, written bigint")


def _grown(spark, folder) -> tuple[keyed.KeyedTable, DataFrame]:
    """A table that outgrew its first bucket in three writes, and a thin batch for it."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    target = keyed.KeyedTable(spark, fresh_path(spark, "grown"), "o_orderkey", rows_per_bucket=1 << 13)
    part = F.col("o_orderkey") % 8
    target.create(orders.where(part < 4))
    for low, high in ((4, 5), (6, 7)):
        batch = orders.where(part.between(low, high)).withColumn("_seq", F.lit(1))
        keyed.write_keyed(target, batch, "skip", "_seq")
    known = orders.where("o_orderkey % 1999 = 7").selectExpr("o_orderkey", "o_totalprice + 1 AS o_totalprice")
    unknown = orders.where("o_orderkey % 1999 = 8").selectExpr("-o_orderkey - 1", "o_totalprice")
    return target, known.unionAll(unknown).withColumn("_seq", F.lit(1))


@query(
    "write_thin_batch",
    """
    SELECT o_orderkey, o_totalprice + CASE WHEN o_orderkey % 1999 = 7 THEN 1 ELSE 0 END AS o_totalprice
    FROM orders
    UNION ALL SELECT -o_orderkey - 1, o_totalprice FROM orders WHERE o_orderkey % 1999 = 8
    """,
)
def write_thin_batch(spark, folder):
    """A few known and unknown keys for a table whose buckets have been split."""
    target, batch = _grown(spark, folder)
    keyed.write_keyed(target, batch, "overwrite", "_seq")
    return target.read()


@query(
    "write_buckets",
    """
    SELECT count(*) AS "rows", true AS bounded, true AS every_key_in_its_bucket FROM orders
    """,
)
def write_buckets(spark, folder):
    """Rows by the manifest; whether every bucket keeps its bound and holds no key of another."""
    target, _ = _grown(spark, folder)
    parts = target.parts()
    sizes = {b: sum(p.rows for p in parts if p.bucket == b) for b in target.leaves()}
    bounded = F.lit(max(sizes.values()) <= 1.1 * (1 << 13))
    rows = target.read().select(target.bucket().alias("b"), "o_orderkey")
    stored = F.regexp_extract(F.input_file_name(), f"{keyed.BUCKET}=([0-9]+)", 1).cast("bigint")
    rows = rows.withColumn("stored", stored)
    return rows.agg(
        F.lit(target.rows()).cast("bigint").alias("rows"), bounded.alias("bounded"),
        F.bool_and(F.col("b") == F.col("stored")).alias("every_key_in_its_bucket"),
    )


@query(
    "write_fail_conflicts",
    f"""
    WITH {OLD_SQL}, {NEW_SQL.strip()}
    SELECT o_orderkey, count(*) AS "rows",
      o_orderkey IN (SELECT o_orderkey FROM old) AS in_target
    FROM new GROUP BY o_orderkey HAVING count(*) > 1 OR in_target
    """,
)
def write_fail(spark, folder):
    return sinks.conflicting_keys(_old(spark, folder), _new(spark, folder), "o_orderkey")


@query(
    "write_create_append",
    """
    SELECT event_type, count(*) AS "rows", CAST(sum(event_id) AS BIGINT) AS ids FROM events
    GROUP BY event_type
    """,
)
def write_create_append(spark, folder):
    events = table(spark, folder, "events")
    path = fresh_path(spark, "append")
    sinks.create_table(events.where("event_type = 'view'"), path)
    sinks.append_rows(events.where("event_type <> 'view'"), path)
    back = spark.read.parquet(path)
    return back.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("event_id").alias("ids")
    )


@query("write_replace", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def write_replace(spark, folder):
    """Loading twice leaves the rows once."""
    customer = table(spark, folder, "customer").select("c_custkey", "c_name", "c_acctbal")
    path = fresh_path(spark, "replace")
    for _ in range(2):
        sinks.replace_table(customer, path)
    return spark.read.parquet(path)


# --- reconciliation ------------------------------------------------------------------------

MAPS = {
    "orders": TableMap(
        "orders",
        "orders_copy",
        (
            ColumnMap("o_orderkey", "order_id"),
            ColumnMap("o_custkey", "customer_id"),
            ColumnMap("o_orderstatus", "status"),
            ColumnMap("o_totalprice", "total"),
            ColumnMap("o_orderdate", "placed_at"),
            ColumnMap("o_orderpriority", "priority"),
        ),
    ),
    "customer": TableMap(
        "customer",
        "customer_copy",
        (
            ColumnMap("c_custkey", "id"),
            ColumnMap("c_name", "name"),
            ColumnMap("c_nationkey", "nation_id"),
            ColumnMap("c_acctbal", "balance"),
            ColumnMap("c_mktsegment", "segment"),
        ),
    ),
    "lineitem": TableMap(
        "lineitem",
        "lineitem",
        tuple(
            ColumnMap(c, c)
            for c in (
                "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
                "l_shipdate",
            )
        ),
    ),
}
COPIES = ["orders_copy", "customer_copy", "lineitem"]
SOURCES = ["orders", "customer", "lineitem", "nation"]


def _both(spark, folder):
    return tables(spark, folder, *SOURCES), tables(spark, folder, *COPIES)


COUNTS_SQL = """
sides(source_table, target_table, source_rows, target_rows) AS (
  SELECT 'orders', 'orders_copy', (SELECT count(*) FROM orders), (SELECT count(*) FROM orders_copy)
  UNION ALL SELECT 'customer', 'customer_copy', (SELECT count(*) FROM customer), (SELECT count(*) FROM customer_copy)
  UNION ALL SELECT 'lineitem', 'lineitem', (SELECT count(*) FROM lineitem), (SELECT count(*) FROM lineitem)),
counts AS (SELECT *, CASE WHEN source_rows > 0 THEN abs(source_rows - target_rows) / source_rows::DOUBLE
    WHEN target_rows > 0 THEN 1.0 ELSE 0.0 END AS mismatch FROM sides)
"""
MATCHED_SQL = """
hashes(source_table, checked, matched) AS (
  SELECT 'orders', (SELECT count(*) FROM orders),
    (SELECT count(*) FROM orders o JOIN orders_copy c ON o_orderkey = order_id AND o_custkey = customer_id
       AND o_orderstatus = status AND o_totalprice = total AND o_orderdate = placed_at
       AND o_orderpriority = priority)
  UNION ALL SELECT 'customer', (SELECT count(*) FROM customer),
    (SELECT count(*) FROM customer c JOIN customer_copy t ON c_custkey = id AND c_name = name
       AND c_nationkey = nation_id AND c_acctbal = balance AND c_mktsegment = segment)
  UNION ALL SELECT 'lineitem', (SELECT count(*) FROM lineitem), (SELECT count(*) FROM lineitem)),
ratios AS (SELECT *, round(matched / checked::DOUBLE, 3) AS match_ratio FROM hashes)
"""
FAULTS_SQL = """
faults(source_table, fk_ok) AS (
  SELECT 'orders', (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)) = 0
    AND (SELECT count(*) FROM orders_copy WHERE customer_id NOT IN (SELECT id FROM customer_copy)) = 0
  UNION ALL SELECT 'customer',
    (SELECT count(*) FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation)) = 0
  UNION ALL SELECT 'lineitem',
    (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)) = 0
    AND (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT order_id FROM orders_copy)) = 0)
"""
SCORES_SQL = f"""
{COUNTS_SQL.strip()}, {MATCHED_SQL.strip()}, {FAULTS_SQL.strip()},
scores AS (SELECT source_table, target_table, source_rows, target_rows,
    round(100 * mismatch, 3) AS mismatch_pct, mismatch <= 0.001 AS row_count_ok, checked, matched,
    match_ratio, fk_ok,
    CASE WHEN mismatch <= 0.001 THEN 0.6 ELSE greatest(0.0, 0.6 * (1 - mismatch)) END
      + 0.3 * match_ratio + CASE WHEN fk_ok THEN 0.1 ELSE 0.0 END AS score
  FROM counts JOIN ratios USING (source_table) JOIN faults USING (source_table))
"""


def _with_copies(sql: str) -> str:
    return with_views(sql, "orders_copy", "customer_copy")


@query(
    "row_count_recon",
    _with_copies(
        f"""WITH {COUNTS_SQL.strip()} SELECT source_table, target_table, source_rows, target_rows,
        round(100 * mismatch, 3) AS mismatch_pct, mismatch <= 0.001 AS row_count_ok FROM counts"""
    ),
)
def row_count_recon(spark, folder):
    return validate.compare_counts(*_both(spark, folder), MAPS).drop("mismatch")


@query(
    "hash_recon",
    _with_copies(f"WITH {MATCHED_SQL.strip()} SELECT source_table, checked, matched, match_ratio FROM ratios"),
)
def hash_recon(spark, folder):
    source, target = _both(spark, folder)
    parts = [
        validate.compare_hashes(source[m.source_table], target[m.target_table], m)
        for m in MAPS.values()
    ]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


@query(
    "hash_recon_raw",
    with_views(
        """
        SELECT count(*) AS checked, count(*) FILTER (WHERE flag IS NULL OR trim(flag) IN ('0', '1')) AS matched
        FROM loose_events
        """,
        "loose_events",
    ),
)
def hash_recon_raw(spark, folder):
    """Untransformed source against transformed target: only values a conversion left alone."""
    events = table(spark, folder, "loose_events")
    maps = TableMap(
        "loose_events",
        "typed_events",
        (
            ColumnMap("event_id", "id"),
            ColumnMap("flag", "flag", "BOOLEAN", "to_boolean"),
            ColumnMap("ok", "ok", "BOOLEAN", "to_boolean"),
        ),
    )
    target = apply_mapping(events, maps.columns)
    return validate.compare_hashes(events, target, maps, raw=True).select("checked", "matched")


@query(
    "fk_source_check",
    """
    SELECT 'orders' AS "table", 'o_custkey' AS "column", 'customer' AS ref_table,
      (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)) AS orphans
    UNION ALL SELECT 'customer', 'c_nationkey', 'nation',
      (SELECT count(*) FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation))
    UNION ALL SELECT 'lineitem', 'l_orderkey', 'orders',
      (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders))
    """,
)
def fk_source_check(spark, folder):
    source = tables(spark, folder, *SOURCES)
    return validate.reference_faults(source, validate.source_references(DECLARED, source))


@query(
    "fk_types_check",
    """
    SELECT 'orders' AS "table", 'o_custkey' AS "column", 'customer' AS ref_table,
      count(o_custkey) AS orphans FROM orders
    UNION ALL SELECT 'events', 'user_id', 'customer', (SELECT count(*) FROM events
      WHERE user_id NOT IN (SELECT c_custkey FROM customer))
    """,
)
def fk_types_check(spark, folder):
    """Text, some of it no number, in front of a number key finds no parent; a number of other size does."""
    data = tables(spark, folder, "orders", "events", "customer")
    number = F.col("o_custkey")
    text = F.when(number % 7 == 0, "none").otherwise(number.cast("string"))
    data["orders"] = data["orders"].withColumn("o_custkey", text)
    data["events"] = data["events"].withColumn("user_id", F.col("user_id").cast("int"))
    links = [(t, c, "customer", "c_custkey") for t, c in (("orders", "o_custkey"), ("events", "user_id"))]
    return validate.reference_faults(data, links)


@query(
    "fk_target_check",
    _with_copies(
        """
        SELECT 'orders_copy' AS "table", 'customer_id' AS "column", 'customer_copy' AS ref_table,
          (SELECT count(*) FROM orders_copy WHERE customer_id NOT IN (SELECT id FROM customer_copy)) AS orphans
        UNION ALL SELECT 'lineitem', 'l_orderkey', 'orders_copy',
          (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT order_id FROM orders_copy))
        """
    ),
)
def fk_target_check(spark, folder):
    target = tables(spark, folder, *COPIES)
    return validate.reference_faults(target, validate.target_references(DECLARED, MAPS))


@query(
    "row_diff",
    _with_copies(
        """
        SELECT coalesce(s.o_orderkey, t.order_id) AS order_id,
          CASE WHEN t.order_id IS NULL THEN 'missing' WHEN s.o_orderkey IS NULL THEN 'extra'
            ELSE 'changed' END AS difference
        FROM orders s FULL JOIN orders_copy t ON s.o_orderkey = t.order_id
        WHERE t.order_id IS NULL OR s.o_orderkey IS NULL OR s.o_totalprice <> t.total
        UNION ALL
        SELECT coalesce(s.c_custkey, t.id),
          CASE WHEN t.id IS NULL THEN 'missing' ELSE 'extra' END
        FROM customer s FULL JOIN customer_copy t ON s.c_custkey = t.id
        WHERE t.id IS NULL OR s.c_custkey IS NULL
        """
    ),
)
def row_diff(spark, folder):
    source, target = _both(spark, folder)
    found = []
    for name, key in (("orders", "order_id"), ("customer", "id")):
        m = MAPS[name]
        mapped = apply_mapping(source[name], m.columns)
        columns = [c.target for c in m.columns]
        diff = validate.compare_rows(mapped, target[m.target_table], [key], columns)
        found.append(diff.select(F.col(key).alias("order_id"), "difference"))
    return found[0].unionAll(found[1])


@query(
    "row_diff_no_key",
    """
    SELECT l_orderkey, l_linenumber, 'changed' AS difference FROM lineitem
    GROUP BY l_orderkey, l_linenumber
    HAVING count(*) <> count(*) FILTER (WHERE l_shipdate < TIMESTAMP '2001-01-01 00:00:00')
      AND count(*) FILTER (WHERE l_shipdate < TIMESTAMP '2001-01-01 00:00:00') > 0
    UNION ALL SELECT l_orderkey, l_linenumber, 'missing' FROM lineitem
    GROUP BY l_orderkey, l_linenumber
    HAVING count(*) FILTER (WHERE l_shipdate < TIMESTAMP '2001-01-01 00:00:00') = 0
    """,
)
def row_diff_no_key(spark, folder):
    """Keys that repeat are compared as bags of rows."""
    lines = table(spark, folder, "lineitem")
    copy = lines.where(F.col("l_shipdate") < F.lit("2001-01-01").cast("timestamp_ntz"))
    return validate.compare_rows(lines, copy, ["l_orderkey", "l_linenumber"], lines.columns)


def _scores(spark, folder) -> DataFrame:
    return validate_copy(*_both(spark, folder), MAPS, DECLARED)


@query(
    "validation_scores",
    _with_copies(f"WITH {SCORES_SQL.strip()} SELECT * FROM scores"),
)
def validation_scores(spark, folder):
    return _scores(spark, folder)


@query(
    "validation_missing_table",
    _with_copies(
        f"""WITH {SCORES_SQL.strip()}
        SELECT source_table, source_rows, target_rows, row_count_ok, match_ratio FROM scores
        WHERE source_table <> 'customer'
        UNION ALL SELECT 'customer', count(*), 0, false, 0.0 FROM customer"""
    ),
)
def validation_missing_table(spark, folder):
    """A table that was never copied matches in nothing."""
    source, target = _both(spark, folder)
    target = {t: df for t, df in target.items() if t != "customer_copy"}
    scores = validate_copy(source, target, MAPS, DECLARED)
    return scores.select("source_table", "source_rows", "target_rows", "row_count_ok", "match_ratio")


ODD_PLAN = TableMap(
    "odd_events",
    "odd_copy",
    (
        ColumnMap("event_id", "id", "BIGINT"),
        ColumnMap("amount", "amount", "DECIMAL(12,2)"),
        ColumnMap("happened", "happened", "DATE", "parse_datetime"),
        ColumnMap("value", "note", "VARCHAR(20)"),
    ),
)


def _odd_copy(spark, folder, declared=None):
    path = fresh_path(spark, "odd-copy")
    data = tables(spark, folder, "odd_events")
    return path, copy_tables(data, {"odd_events": ODD_PLAN}, path, declared=declared)["odd_copy"]


@query(
    "migration_rejects",
    with_views(
        """
        SELECT event_id, 'amount' AS "column", amount AS original FROM odd_events
        WHERE amount IN ('12d', '0x1p3', '7f', 'x', '9007199254740993')
        UNION ALL SELECT event_id, 'happened', happened FROM odd_events
        WHERE happened IN ('10:20:30', '2020', '2020-05', '2020-1-2')
        """,
        "odd_events",
    ),
)
def migration_rejects(spark, folder):
    """Values that do not fit their target column, under the table's declared key."""
    path, _ = _odd_copy(spark, folder, {"odd_events": Declared(key=("event_id",))})
    return spark.read.parquet(f"{path}/odd_copy.rejects").drop("transformation")


@query(
    "migration_rejects_whole_rows",
    with_views(
        """
        SELECT count(*) AS cells, count(DISTINCT event_id) AS "rows" FROM (
          SELECT event_id FROM odd_events WHERE amount IN ('12d', '0x1p3', '7f', 'x', '9007199254740993')
          UNION ALL SELECT event_id FROM odd_events
          WHERE happened IN ('10:20:30', '2020', '2020-05', '2020-1-2'))
        """,
        "odd_events",
    ),
)
def migration_rejects_whole_rows(spark, folder):
    """Without a declared key the whole row is kept."""
    path, _ = _odd_copy(spark, folder)
    rejects = spark.read.parquet(f"{path}/odd_copy.rejects")
    key = F.get_json_object("row", "$.event_id")
    return rejects.agg(F.count(F.lit(1)).alias("cells"), F.count_distinct(key).alias("rows"))


@query(
    "copied_values",
    with_views(
        """
        SELECT event_id AS id,
          CASE amount WHEN ' -3.5e2 ' THEN '-350.00' WHEN '1.' THEN '1.00' END AS amount,
          CASE WHEN happened LIKE '2020-01-02%' THEN DATE '2020-01-02' END AS happened,
          'bigint decimal(12,2) date string' AS types
        FROM odd_events
        """,
        "odd_events",
    ),
)
def copied_values(spark, folder):
    """A copy has the types of its plan."""
    _, copy = _odd_copy(spark, folder)
    kinds = dict(copy.dtypes)
    types = " ".join(kinds[c] for c in ("id", "amount", "happened", "note"))
    return copy.select("id", F.col("amount").cast("string").alias("amount"), "happened",
                       F.lit(types).alias("types"))


@query(
    "validation_overall",
    _with_copies(
        f"""WITH {SCORES_SQL.strip()}
        SELECT count(*) AS tables, CAST(round(100 * avg(score)) AS INT) AS confidence_score,
          coalesce(string_agg(source_table, ',' ORDER BY source_table) FILTER (WHERE NOT row_count_ok), '')
            AS flagged_tables,
          bool_and(row_count_ok) AND round(100 * avg(score)) >= 90 AS passed
        FROM scores"""
    ),
)
def validation_overall(spark, folder):
    return validate.overall_score(_scores(spark, folder))


@query(
    "score_components",
    _with_copies(
        f"""WITH {SCORES_SQL.strip()}
        SELECT 'Row counts' AS component, 60 AS weight, CAST(round(100 * avg(CASE WHEN row_count_ok THEN 1.0
            ELSE greatest(0.0, 1 - mismatch_pct / 100) END)) AS INT) AS score FROM scores
        UNION ALL SELECT 'Row contents', 30, CAST(round(100 * avg(match_ratio)) AS INT) FROM scores
        UNION ALL SELECT 'References', 10,
          CAST(round(100 * avg(CASE WHEN fk_ok THEN 1.0 ELSE 0.0 END)) AS INT) FROM scores"""
    ),
)
def score_components(spark, folder):
    return validate.score_components(_scores(spark, folder))


# --- reports on a validated copy -----------------------------------------------------------

_HIDDEN_SQL = """
hidden("table", "column", hides, private) AS (VALUES
  ('orders', 'o_orderkey', false, false), ('orders', 'o_custkey', false, false),
  ('orders', 'o_orderstatus', true, false), ('orders', 'o_totalprice', false, false),
  ('orders', 'o_orderdate', false, false), ('orders', 'o_orderpriority', true, false),
  ('customer', 'c_custkey', false, false), ('customer', 'c_name', false, false),
  ('customer', 'c_nationkey', false, false), ('customer', 'c_acctbal', false, false),
  ('customer', 'c_mktsegment', true, false))
"""


@query(
    "confidence_breakdown",
    _with_copies(
        f"""WITH {SCORES_SQL.strip()}, {_HIDDEN_SQL.strip()}
        SELECT h."table", "column", CAST(round(100 * score) AS INT) AS table_confidence,
          CAST(greatest(0, round(100 * score) - CASE WHEN hides THEN 10 ELSE 0 END) AS INT) AS confidence,
          round(100 * score) - CASE WHEN hides THEN 10 ELSE 0 END < 90 AS needs_review,
          concat_ws('; ', CASE WHEN hides THEN 'declared free text is an enum' END,
            CASE WHEN match_ratio < 1.0 THEN 'row match ' || format('{{:.3f}}', match_ratio) END) AS reasons
        FROM hidden h JOIN scores s ON s.source_table = h."table" """
    ),
)
def confidence_breakdown(spark, folder):
    data = tables(spark, folder, "orders", "customer")
    profile = profile_dataset(data, DECLARED, samples=False)
    facts = report.column_facts(profile, read_catalog(spark, data, DECLARED).columns)
    return report.confidence_breakdown(_scores(spark, folder), facts)


@query(
    "flags_union",
    _with_copies(
        f"""WITH {SCORES_SQL.strip()}
        SELECT 'high' AS severity, source_table AS "table", 'Row count mismatch' AS title,
          source_rows || ' source rows, ' || target_rows || ' target rows' AS detail
          FROM scores WHERE NOT row_count_ok
        UNION ALL SELECT CASE WHEN match_ratio >= 0.9 THEN 'medium' ELSE 'high' END, source_table,
          'Rows differ', format('{{:.3f}}', match_ratio) || ' of rows match' FROM scores WHERE match_ratio < 1.0
        UNION ALL SELECT 'high', source_table, 'Broken references', 'some foreign keys find no parent'
          FROM scores WHERE NOT fk_ok
        UNION ALL SELECT 'high', 'loose_events', 'Execution error',
          count(*) || ' values of amount did not convert' FROM events WHERE "value" > 60
        UNION ALL SELECT 'low', 'contacts', 'Planner warning', 'may hold personal data: ' || c
          FROM (VALUES ('email'), ('old_email'), ('phone'), ('postal_text'), ('zip_code')) v(c)
        UNION ALL SELECT 'low', '-', 'Planner warning', 'plan made from ' || count(*) || ' contacts' FROM customer
        UNION ALL SELECT 'low', 'contacts', 'Personal data copied',
          'email, old_email, phone, postal_text, zip_code'
        """
    ),
)
def flags_union(spark, folder):
    contacts = tables(spark, folder, "contacts")
    profile = profile_dataset(contacts, {"contacts": Declared(key=("contact_id",))}, samples=False)
    planned = report.P.is_personal_name(F.col("column"))
    catalog = read_catalog(spark, contacts)
    warnings = catalog.columns.select(
        "table", F.when(planned, F.concat(F.lit("may hold personal data: "), "column")).alias("warning")
    )
    lost = table(spark, folder, "loose_events").where("amount = 'n/k'").agg(
        F.concat(F.count(F.lit(1)).cast("string"), F.lit(" values of amount did not convert")).alias("error")
    )
    general = contacts["contacts"].agg(
        F.concat(F.lit("plan made from "), F.count(F.lit(1)).cast("string"), F.lit(" contacts")).alias("warning")
    )
    flags = report.flags(
        _scores(spark, folder),
        lost.withColumn("table", F.lit("loose_events")),
        warnings,
        personal_columns(profile),
        general,
    )
    return flags.withColumn("table", F.coalesce("table", F.lit("-")))


@query(
    "public_summary",
    _with_copies(
        f"""WITH {COUNTS_SQL.strip()}
        SELECT 'table_' || CASE source_table WHEN 'orders' THEN 1 WHEN 'customer' THEN 2 ELSE 3 END AS "table",
          source_rows, target_rows, mismatch <= 0.001 AS row_count_ok FROM counts"""
    ),
)
def public_summary(spark, folder):
    counts = validate.compare_counts(*_both(spark, folder), MAPS)
    position = F.lit(99)
    for i, name in enumerate(MAPS):
        position = F.when(F.col("source_table") == name, i).otherwise(position)
    return report.public_summary(counts.withColumn("position", position))


@query(
    "run_totals",
    """
    WITH log AS (SELECT user_id AS job, event_type AS "table", event_id % 10 + 1 AS n, ts FROM events),
    jobs AS (SELECT job, count(DISTINCT "table") AS tables, CAST(sum(n) AS BIGINT) AS rows_migrated,
      1000 AS rows_total,
      CAST(greatest(0, floor(epoch(max(ts))) - floor(epoch(min(ts)))) AS BIGINT) AS seconds
      FROM log GROUP BY job)
    SELECT job, tables, rows_migrated, CAST(rows_total AS BIGINT) AS rows_total,
      CAST(floor(100.0 * rows_migrated / rows_total) AS INT) AS percent, seconds,
      round(2.0 * tables + 1.5 * (rows_migrated / 100000.0), 1) AS manual_hours,
      coalesce(round((rows_total - rows_migrated) / (rows_migrated / nullif(seconds, 0)::DOUBLE), 1), -1)
        AS seconds_left
    FROM jobs
    """,
)
def run_totals(spark, folder):
    """Every event is one written chunk of its user's job."""
    log = table(spark, folder, "events").select(
        F.col("user_id").alias("job"),
        F.col("event_type").alias("table"),
        (F.col("event_id") % 10 + 1).alias("rows"),
        F.lit(1000).cast("bigint").alias("rows_total"),
        F.col("ts").alias("started"),
        F.col("ts").alias("ended"),
    )
    totals = report.run_totals(log)
    return totals.withColumn("seconds_left", F.coalesce("seconds_left", F.lit(-1.0)))


# --- a whole migration ---------------------------------------------------------------------


@query(
    "migration_round_trip",
    """
    SELECT 'customer' AS source_table, count(*) AS target_rows, true AS row_count_ok,
      1.0::DOUBLE AS match_ratio, true AS fk_ok, 1.0::DOUBLE AS score FROM customer
    UNION ALL SELECT 'labels', count(*), true, 1.0, true, 1.0 FROM labels
    UNION ALL SELECT 'nation', count(*), true, 1.0, true, 1.0 FROM nation
    UNION ALL SELECT 'orders', count(*), true, 1.0, true, 1.0 FROM orders
    """,
)
def migration_round_trip(spark, folder):
    """Profile, plan, copy in load order, validate: a faithful copy scores 1."""
    data = tables(spark, folder, "nation", "customer", "orders", "labels")
    says = {t: d for t, d in DECLARED.items() if t in data}
    analysis = analyse(spark, data, says, samples=False)
    planned = plan(analysis, "mysql", "postgres")
    maps = table_maps(planned)
    copies = copy_tables(
        data, maps, fresh_path(spark, "migration"), order_of(analysis), declared=says
    )
    outcome = final_report(analysis, planned, validate_copy(data, copies, maps, says))
    return outcome.tables.select(
        "source_table", "target_rows", "row_count_ok", "match_ratio", "fk_ok",
        F.round("score", 6).alias("score"),
    )
