"""Faults and undeclared references."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabletrust.functions import rules
from tabletrust.operators import quality, relations
from tabletrust.sources.catalog import Declared, row_counts
from tabletrust.workload.registry import query
from tabletrust.workload.scenario import table, tables, with_views

SAYS = {
    "dirty_orders": Declared(
        key=("o_orderkey",),
        not_null=("o_orderpriority",),
        foreign_keys=(("o_custkey", "dirty_customer", "c_custkey"),),
    ),
    "dirty_customer": Declared(key=("c_custkey",), not_null=("c_name",), unique=("c_name", "c_custkey")),
}
DIRTY = ["dirty_orders", "dirty_customer"]
TEXT_COLUMNS = {
    "dirty_orders": ["o_orderpriority", "o_orderdate"],
    "dirty_customer": ["c_mktsegment", "c_name"],
}
NUMBER_COLUMNS = {
    "dirty_orders": ["o_orderkey", "o_custkey", "o_totalprice", "o_clerk"],
    "dirty_customer": ["c_custkey", "c_nationkey", "c_acctbal"],
}
DATES = ", ".join(f"'{d}'" for d in rules.SENTINEL_DATES)

EMPTY_SQL = """
SELECT 'medium' AS severity, 'empty_string_in_not_null' AS kind, 'dirty_orders' AS "table",
  'o_orderpriority' AS "column", '' AS "value",
  count(*) FILTER (WHERE o_orderpriority = '') AS hits, count(*) AS "rows", '' AS examples
FROM dirty_orders HAVING hits > 0
"""
NUMBERS_SQL = "\nUNION ALL ".join(
    f"""SELECT 'low' AS severity, 'numeric_sentinel' AS kind, '{t}' AS "table", '{c}' AS "column",
      '{n}' AS "value", count(*) FILTER (WHERE {c} = {n}) AS hits, count(*) AS "rows", '' AS examples
    FROM {t} HAVING hits > 0 AND hits >= 0.05 * count(*)"""
    for t, columns in NUMBER_COLUMNS.items()
    for c in columns
    for n in rules.SENTINEL_NUMBERS
)
DATES_SQL = "\nUNION ALL ".join(
    f"""SELECT 'medium' AS severity, 'sentinel_date' AS kind, '{t}' AS "table", '{c}' AS "column",
      '' AS "value", count(*) AS hits, (SELECT count(*) FROM {t}) AS "rows",
      array_to_string(list_sort(list(DISTINCT {c}))[1:3], ', ') AS examples
    FROM {t} WHERE substr({c}, 1, 19) IN ({DATES}) OR substr({c}, 1, 10) IN ({DATES})
    HAVING count(*) > 0"""
    for t, columns in TEXT_COLUMNS.items()
    for c in columns
)
DUPLICATES_SQL = """
SELECT 'high' AS severity, 'duplicate_in_unique' AS kind, 'dirty_customer' AS "table",
  'c_name' AS "column", '' AS "value", count(*) AS hits,
  (SELECT count(*) FROM dirty_customer) AS "rows",
  array_to_string(list_sort(list(v))[1:3], ', ') AS examples
FROM (SELECT c_name AS v FROM dirty_customer GROUP BY c_name HAVING count(*) > 1)
HAVING count(*) > 0
"""
ORPHANS_SQL = """
SELECT 'high' AS severity, 'orphaned_rows' AS kind, 'dirty_orders' AS "table",
  'o_custkey' AS "column", '' AS "value", count(*) AS hits,
  (SELECT count(*) FROM dirty_orders) AS "rows",
  array_to_string(list_sort(list(DISTINCT CAST(o_custkey AS VARCHAR)))[1:3], ', ') AS examples
FROM dirty_orders WHERE o_custkey NOT IN (SELECT c_custkey FROM dirty_customer) HAVING count(*) > 0
"""
ISSUES_SQL = "\nUNION ALL ".join([EMPTY_SQL, NUMBERS_SQL, DATES_SQL, DUPLICATES_SQL, ORPHANS_SQL])


def _sql(text: str) -> str:
    return with_views(text, *DIRTY)


@query("quality_empty_notnull", _sql(EMPTY_SQL))
def empty_strings(spark, folder):
    data = tables(spark, folder, "dirty_orders")["dirty_orders"]
    found = quality.value_faults(data, "dirty_orders", SAYS["dirty_orders"])
    return found.where("kind = 'empty_string_in_not_null'")


@query("quality_sentinel_number", _sql(NUMBERS_SQL))
def sentinel_numbers(spark, folder):
    data = tables(spark, folder, *DIRTY)
    found = [quality.value_faults(data[t], t, SAYS[t]) for t in DIRTY]
    return found[0].unionAll(found[1]).where("kind = 'numeric_sentinel'")


@query("quality_sentinel_date", _sql(DATES_SQL))
def sentinel_dates(spark, folder):
    data = tables(spark, folder, *DIRTY)
    found = [quality.sentinel_dates(data[t], t) for t in DIRTY]
    return quality.summarise(found[0].unionAll(found[1]), row_counts(data))


@query("quality_duplicate_unique", _sql(DUPLICATES_SQL))
def duplicates(spark, folder):
    data = tables(spark, folder, "dirty_customer")
    found = quality.duplicate_uniques(
        data["dirty_customer"], "dirty_customer", SAYS["dirty_customer"]
    )
    return quality.summarise(found, row_counts(data))


@query("quality_orphans", _sql(ORPHANS_SQL))
def orphaned(spark, folder):
    data = tables(spark, folder, *DIRTY)
    found = quality.orphaned_rows(data, "dirty_orders", SAYS["dirty_orders"])
    return quality.summarise(found, row_counts(data))


@query(
    "quality_issues",
    _sql(f'SELECT severity, kind, "table", "column", "value", hits, "rows", examples FROM ({ISSUES_SQL})'),
)
def issues(spark, folder):
    return quality.quality_issues(tables(spark, folder, *DIRTY), SAYS).drop("detail")


@query(
    "quality_score",
    _sql(
        f"""
        SELECT CAST(greatest(0, 100 - sum(CASE severity WHEN 'high' THEN 12 WHEN 'medium' THEN 6 ELSE 2 END))
            AS INT) AS quality_score,
          count(*) FILTER (WHERE severity = 'high') AS high,
          count(*) FILTER (WHERE severity = 'medium') AS medium,
          count(*) FILTER (WHERE severity = 'low') AS low,
          count(*) AS issues, count(DISTINCT "table") AS tables_with_issues,
          2 AS tables_checked
        FROM ({ISSUES_SQL})
        """
    ),
)
def score(spark, folder):
    return quality.quality_score(quality.quality_issues(tables(spark, folder, *DIRTY), SAYS), len(DIRTY))


@query(
    "quality_per_table",
    _sql(
        f"""
        SELECT "table", count(*) AS issues, count(*) FILTER (WHERE severity = 'high') AS high,
          count(*) FILTER (WHERE severity = 'medium') AS medium,
          count(*) FILTER (WHERE severity = 'low') AS low
        FROM ({ISSUES_SQL}) GROUP BY "table"
        """
    ),
)
def per_table(spark, folder):
    return quality.issues_per_table(quality.quality_issues(tables(spark, folder, *DIRTY), SAYS))


# --- undeclared references -----------------------------------------------------------------

LINKED = ["events", "labels", "documents", "customer", "dirty_customer", "conversations", "part"]
LINK_SAYS = {
    "events": Declared(key=("event_id",)),
    "documents": Declared(key=("doc_id",)),
    "customer": Declared(key=("c_custkey",)),
    "dirty_customer": Declared(key=("c_custkey",)),
    "part": Declared(key=("p_partkey",)),
    "conversations": Declared(key=("conv_id", "turn")),
}
_KEYS = {t: d.key[0] for t, d in LINK_SAYS.items() if len(d.key) == 1}
_ID_COLUMNS = [
    ("events", "event_id"), ("events", "user_id"), ("labels", "doc_id"),
    ("documents", "doc_id"), ("conversations", "conv_id"),
]


def _stem(name: str) -> str:
    return name.removesuffix("_id").rstrip("s")


SHARES_SQL = "\nUNION ALL ".join(
    f"""SELECT '{t}' AS "table", '{c}' AS "column", '{rt}' AS ref_table, '{rc}' AS ref_column,
      {str(rt.rstrip("s") == _stem(c)).lower()} AS name_match, {i} AS ord,
      (SELECT count(*) FROM {t} WHERE {c} IN (SELECT {rc} FROM {rt})) AS hits,
      (SELECT count({c}) FROM {t}) AS total"""
    for t, c in _ID_COLUMNS
    for i, (rt, rc) in enumerate((x, _KEYS[x]) for x in LINKED if x in _KEYS)
    if rt != t
)


@query(
    "reference_shares",
    with_views(
        f"""SELECT "table", "column", ref_table, ref_column, name_match,
          round(100.0 * hits / total, 1) AS match_pct FROM ({SHARES_SQL})""",
        "dirty_customer",
    ),
)
def reference_shares(spark, folder):
    found = relations.reference_matches(tables(spark, folder, *LINKED), LINK_SAYS)
    return found.select("table", "column", "ref_table", "ref_column", "name_match", "match_pct")


# The fold over at most six candidates is written out with a recursive walk in catalog order.
FOLD_SQL = f"""
WITH RECURSIVE shares AS ({SHARES_SQL}),
cand AS (SELECT *, round(100.0 * hits / total, 1) AS pct,
  row_number() OVER (PARTITION BY "table", "column" ORDER BY ord) AS n
  FROM shares WHERE hits >= 0.95 * total),
walk AS (
  SELECT "table", "column", n, ref_table, ref_column, pct, name_match FROM cand WHERE n = 1
  UNION ALL
  SELECT w."table", w."column", c.n,
    CASE WHEN (c.name_match AND NOT w.name_match) OR c.pct > w.pct THEN c.ref_table ELSE w.ref_table END,
    CASE WHEN (c.name_match AND NOT w.name_match) OR c.pct > w.pct THEN c.ref_column ELSE w.ref_column END,
    CASE WHEN (c.name_match AND NOT w.name_match) OR c.pct > w.pct THEN c.pct ELSE w.pct END,
    CASE WHEN (c.name_match AND NOT w.name_match) OR c.pct > w.pct THEN c.name_match ELSE w.name_match END
  FROM walk w JOIN cand c ON c."table" = w."table" AND c."column" = w."column" AND c.n = w.n + 1)
SELECT "table", "column", ref_table || '.' || ref_column AS likely_references, pct AS match_pct, name_match
FROM walk w
WHERE n = (SELECT max(n) FROM cand c WHERE c."table" = w."table" AND c."column" = w."column")
"""


@query("implicit_fk", with_views(FOLD_SQL, "dirty_customer"))
def implicit_fk(spark, folder):
    return relations.implicit_foreign_keys(tables(spark, folder, *LINKED), LINK_SAYS)


# Every value of 200 dense columns is a key of up to eight tables.
WIDE_COLUMNS, WIDE_TABLES = 200, 8


@query(
    "implicit_fk_wide",
    f"""
    WITH used AS (SELECT 'c' || k || '_id' AS col, 1 + p_partkey % (5 * (k + 1)) AS v
      FROM part, range({WIDE_COLUMNS}) t(k)),
    held AS (SELECT j, c_custkey AS v FROM customer, range({WIDE_TABLES}) t(j)
      WHERE c_custkey BETWEEN 1 AND 100 * (j + 1)),
    counts AS (SELECT col, v, count(*) AS n FROM used GROUP BY ALL),
    totals AS (SELECT col, sum(n) AS total FROM counts GROUP BY col),
    shares AS (SELECT col, j, sum(n) AS n FROM counts JOIN held USING (v) GROUP BY col, j)
    SELECT 'wide' AS "table", col AS "column", 'parent_' || j || '.k' AS likely_references,
      round(100.0 * n / total, 1) AS match_pct, false AS name_match
    FROM shares JOIN totals USING (col) WHERE n >= 0.95 * total
    QUALIFY row_number() OVER (PARTITION BY col ORDER BY round(100.0 * n / total, 1) DESC, j) = 1
    """,
)
def implicit_fk_wide(spark, folder):
    key = F.col("p_partkey")
    wide = table(spark, folder, "part").select(
        *((1 + key % (5 * (k + 1))).alias(f"c{k}_id") for k in range(WIDE_COLUMNS))
    )
    keys = table(spark, folder, "customer").select(F.col("c_custkey").alias("k"))
    data = {f"parent_{j}": keys.where(F.col("k").between(1, 100 * (j + 1))) for j in range(WIDE_TABLES)}
    says = {name: Declared(key=("k",)) for name in data}
    return relations.implicit_foreign_keys({"wide": wide} | data, says)
