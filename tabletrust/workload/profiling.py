"""Profiles, detections, and the reports on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabletrust.functions import rules
from tabletrust.operators import profile as profiling
from tabletrust.operators import relations, report
from tabletrust.operators.mapping import mapping_plan
from tabletrust.operators.profile import profile_dataset
from tabletrust.sources.catalog import Declared, read_catalog
from tabletrust.workload.profile_sql import facts_sql, profile_sql, quoted
from tabletrust.workload.registry import query
from tabletrust.workload.scenario import DECLARED, tables, with_views

# Declared constraints of the derived and given tables the reports run on.
SAYS = {
    **DECLARED,
    "contacts": Declared(key=("contact_id",), not_null=("email", "note")),
    "customer": Declared(key=("c_custkey",), not_null=("c_name",)),
    "labels": Declared(not_null=("doc_id",)),
}
REPORTED = {
    "contacts": ["contact_id", "email", "note"],
    "orders": ["o_orderkey"],
    "labels": ["doc_id"],
}

PROFILE_COLUMNS = [
    "table", "ordinal", "column", "declared_type", "rows", "nulls", "null_pct", "distinct_count",
    "implicit_boolean", "implicit_enum", "enum_values", "date_formats", "semantic_type",
    "confidence_pct", "danger", "pii_suspected",
]


def flat(profile: DataFrame, *more: str) -> DataFrame:
    """Lists as text, so that results compare as plain values."""
    out = profile.withColumn("enum_values", F.coalesce(F.array_join("enum_values", ","), F.lit("")))
    out = out.withColumn("date_formats", F.array_join("date_formats", ","))
    out = out.withColumn("sample_values", F.array_join("sample_values", "|"))
    return out.select(*PROFILE_COLUMNS, *more)


def _profile(spark, folder, *names: str, **options) -> DataFrame:
    return profile_dataset(tables(spark, folder, *names), SAYS, **options)


@query("profile_orders", profile_sql("orders", samples=True))
def profile_orders(spark, folder):
    return flat(_profile(spark, folder, "orders", exact_distinct=True), "sample_values")


@query("profile_contacts", with_views(profile_sql("contacts", samples=True), "contacts"))
def profile_contacts(spark, folder):
    return flat(_profile(spark, folder, "contacts", exact_distinct=True), "sample_values")


@query("profile_documents", profile_sql("documents"))
def profile_documents(spark, folder):
    return flat(_profile(spark, folder, "documents", exact_distinct=True, samples=False))


@query("profile_lineitem", profile_sql("lineitem"))
def profile_lineitem(spark, folder):
    return flat(_profile(spark, folder, "lineitem", exact_distinct=True, samples=False))


FAST_SQL = f"""
SELECT "table", "column", "rows", nulls, implicit_boolean, implicit_enum, enum_values,
  semantic_type, CASE WHEN distinct_count <= 200 THEN distinct_count END AS distinct_count,
  true AS estimated
FROM ({profile_sql("lineitem", "customer", "orders", "documents", "labels")})
"""


@query("profile_fast", FAST_SQL)
def profile_fast(spark, folder):
    """Five tables with estimated distinct counts; exact ones where there are at most 200."""
    names = ["lineitem", "customer", "orders", "documents", "labels"]
    low, high = F.col("distinct_low"), F.col("distinct_high")
    # An exact count lies inside the bounds, and a count of more than 200 inside none below.
    sound = F.coalesce(F.col("distinct_count").between(low, high), high > 200)
    found = flat(_profile(spark, folder, *names, samples=False).withColumn("estimated", sound), "estimated")
    return found.select(
        "table", "column", "rows", "nulls", "implicit_boolean", "implicit_enum", "enum_values",
        "semantic_type", "distinct_count", "estimated",
    )


MEASURED = ["lineitem", "customer", "orders"]


def _distinct_sql() -> str:
    return f"""
    SELECT "table", "column", "rows", distinct_count, true AS in_bounds
    FROM ({profile_sql(*MEASURED)})
    """


def _against_exact(spark, folder, estimates: DataFrame) -> DataFrame:
    exact = _profile(spark, folder, *MEASURED, exact_distinct=True, samples=False)
    exact = exact.select("table", "column", "distinct_count")
    bounds = estimates.select("table", "column", "rows", "distinct_low", "distinct_high")
    return exact.join(bounds, ["table", "column"]).select(
        "table", "column", "rows", "distinct_count",
        F.col("distinct_count").between(F.col("distinct_low"), F.col("distinct_high")).alias("in_bounds"),
    )


@query("distinct_estimates", _distinct_sql())
def distinct_estimates(spark, folder):
    """Exact distinct counts against the bounds of the sketches."""
    return _against_exact(spark, folder, _profile(spark, folder, *MEASURED, samples=False))


@query("distinct_merged", _distinct_sql())
def distinct_merged(spark, folder):
    """Sketches of three overlapping parts of each table, united without reading the tables again."""
    data = tables(spark, folder, *MEASURED)
    parts = []
    for k in range(3):
        cut = {t: df.where(F.pmod(F.xxhash64(df.columns[0], df.columns[1]), F.lit(3)) == k) for t, df in data.items()}
        parts.append(profile_dataset(cut, SAYS, samples=False))
    united = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return _against_exact(spark, folder, profiling.merged_distinct(united))


@query(
    "semantic_types",
    with_views(
        f"""
        SELECT "column", semantic_type, confidence_pct, danger,
          format('{{:.1f}}', confidence_pct) || '% of ' || ("rows" - nulls) || ' values look like '
            || semantic_type AS evidence
        FROM ({profile_sql("contacts")}) WHERE semantic_type IS NOT NULL
        """,
        "contacts",
    ),
)
def semantic_types(spark, folder):
    found = _profile(spark, folder, "contacts", samples=False)
    return found.where(F.col("semantic_type").isNotNull()).select(
        "column", "semantic_type", "confidence_pct", "danger", "evidence"
    )


@query(
    "semantic_types_given",
    f"""
    SELECT "table", "column", semantic_type, confidence_pct, danger
    FROM ({profile_sql("orders", "customer", "lineitem", "documents")})
    WHERE semantic_type IS NOT NULL
    """,
)
def semantic_types_given(spark, folder):
    names = ["orders", "customer", "lineitem", "documents"]
    found = _profile(spark, folder, *names, samples=False)
    return found.where(F.col("semantic_type").isNotNull()).select(
        "table", "column", "semantic_type", "confidence_pct", "danger"
    )


@query(
    "json_values",
    with_views(
        """
        SELECT count(*) FILTER (WHERE json_valid(payload)) AS payload_json,
          count(*) FILTER (WHERE json_valid(weak_payload)) AS weak_json,
          count(*) AS "rows"
        FROM contacts
        """,
        "contacts",
    ),
)
def json_values(spark, folder):
    contacts = tables(spark, folder, "contacts")["contacts"]
    return contacts.agg(
        F.count_if(profiling.P.parses_as_json("payload")).alias("payload_json"),
        F.count_if(profiling.P.parses_as_json("weak_payload")).alias("weak_json"),
        F.count(F.lit(1)).alias("rows"),
    )


_LABEL = " ".join(
    f"WHEN regexp_matches(seen, {quoted(p)}) THEN {quoted(label)}" for p, label in rules.DATE_FORMATS
)


@query(
    "date_formats",
    with_views(
        f"""
        SELECT date_format, count(*) AS "rows" FROM (SELECT CASE {_LABEL} END AS date_format FROM contacts)
        GROUP BY date_format
        """,
        "contacts",
    ),
)
def date_formats(spark, folder):
    contacts = tables(spark, folder, "contacts")["contacts"]
    label = profiling.P.date_format_of(F.col("seen"))
    return contacts.groupBy(label.alias("date_format")).agg(F.count(F.lit(1)).alias("rows"))


FACTS = facts_sql(REPORTED)


def _facts_sql(body: str) -> str:
    return with_views(f"WITH {FACTS}\n{body}", "contacts")


@query("pii_columns", _facts_sql('SELECT "table", "column", pii_type FROM facts WHERE pii_suspected'))
def pii_columns(spark, folder):
    return profiling.personal_columns(_profile(spark, folder, *REPORTED, samples=False))


@query(
    "pii_fields",
    _facts_sql(
        """SELECT string_agg("table" || '.' || "column", ',' ORDER BY "table" || '.' || "column")
        AS pii_fields, count(*) AS fields FROM facts WHERE pii_suspected"""
    ),
)
def pii_fields(spark, folder):
    found = profiling.personal_columns(_profile(spark, folder, *REPORTED, samples=False))
    names = F.collect_list(F.concat("table", F.lit("."), "column"))
    return found.agg(
        F.array_join(F.sort_array(names), ",").alias("pii_fields"),
        F.count(F.lit(1)).alias("fields"),
    )


def _facts(spark, folder) -> tuple[DataFrame, dict[str, DataFrame]]:
    data = tables(spark, folder, *REPORTED)
    profile = profile_dataset(data, SAYS, samples=False)
    return report.column_facts(profile, read_catalog(spark, data, SAYS).columns), data


def _implicit_fks(data: dict[str, DataFrame]) -> DataFrame:
    return relations.implicit_foreign_keys(data, SAYS, ("_id", "_custkey", "_orderkey"))


# Undeclared references among the reported tables: orders.o_custkey is declared, the labels'
# documents are not loaded, and both keys count as candidates.
FK_PAIRS_SQL = """
pairs AS (
  SELECT 'contacts' AS "table", 'contact_id' AS "column",
    (SELECT avg(CASE WHEN contact_id IN (SELECT o_orderkey FROM orders) THEN 1.0 ELSE 0.0 END)
     FROM contacts) AS share
  UNION ALL SELECT 'orders', 'o_orderkey',
    (SELECT avg(CASE WHEN o_orderkey IN (SELECT contact_id FROM contacts) THEN 1.0 ELSE 0.0 END)
     FROM orders)
  UNION ALL SELECT 'labels', 'doc_id',
    (SELECT greatest(
       avg(CASE WHEN doc_id IN (SELECT contact_id FROM contacts) THEN 1.0 ELSE 0.0 END),
       avg(CASE WHEN doc_id IN (SELECT o_orderkey FROM orders) THEN 1.0 ELSE 0.0 END))
     FROM labels)),
fk_count AS (SELECT count(*) AS n FROM pairs WHERE share >= 0.95)"""


@query(
    "semantic_report",
    _facts_sql(
        """
        SELECT "table", "column", 'implicit_boolean' AS kind, 'BOOLEAN' AS detail,
          size_confidence AS confidence FROM facts WHERE is_boolean
        UNION ALL SELECT "table", "column", 'implicit_enum', enum_values, enum_confidence
          FROM facts WHERE is_enum
        UNION ALL SELECT "table", "column", 'never_null_nullable', 'no null found', size_confidence
          FROM facts WHERE never_null
        UNION ALL SELECT "table", "column", 'semantic', semantic_type,
          CAST(round(confidence_pct) AS INT) FROM facts WHERE is_semantic
        UNION ALL SELECT "table", "column", 'danger', danger, CAST(round(confidence_pct) AS INT)
          FROM facts WHERE is_dangerous
        UNION ALL SELECT "table", "column", 'pii', pii_type, size_confidence
          FROM facts WHERE pii_suspected
        """
    ),
)
def semantic_report(spark, folder):
    return report.findings(_facts(spark, folder)[0])


@query(
    "finding_counts",
    with_views(
        f"""WITH {FACTS}, {FK_PAIRS_SQL.strip()}
        SELECT 'implicit_boolean' AS kind, count(*) FILTER (WHERE is_boolean) AS findings FROM facts
        UNION ALL SELECT 'implicit_enum', count(*) FILTER (WHERE is_enum) FROM facts
        UNION ALL SELECT 'never_null_nullable', count(*) FILTER (WHERE never_null) FROM facts
        UNION ALL SELECT 'semantic', count(*) FILTER (WHERE is_semantic) FROM facts
        UNION ALL SELECT 'danger', count(*) FILTER (WHERE is_dangerous) FROM facts
        UNION ALL SELECT 'pii', count(*) FILTER (WHERE pii_suspected) FROM facts
        UNION ALL SELECT 'implicit_fk', n FROM fk_count""",
        "contacts",
    ),
)
def finding_counts(spark, folder):
    facts, data = _facts(spark, folder)
    return report.finding_counts(facts, _implicit_fks(data))


@query(
    "trust_score",
    with_views(
        f"""WITH {FACTS}, {FK_PAIRS_SQL.strip()},
        parts AS (SELECT count(*) AS columns,
          count(*) FILTER (WHERE is_boolean OR is_enum OR is_semantic) AS hard_columns,
          count(*) FILTER (WHERE never_null AND NOT (is_boolean OR is_enum OR is_semantic)) AS soft_columns,
          count(*) FILTER (WHERE is_dangerous) AS dangers,
          count(*) FILTER (WHERE pii_suspected) AS pii_columns,
          (SELECT n FROM fk_count) AS implicit_fks FROM facts)
        SELECT *, CAST(greatest(0, least(100,
            round(100 * (1 - least(1.0, (hard_columns + 0.35 * soft_columns) / columns)))
            - 5 * dangers - 3 * implicit_fks - pii_columns)) AS INT) AS schema_trust_score
        FROM parts""",
        "contacts",
    ),
)
def trust_score(spark, folder):
    facts, data = _facts(spark, folder)
    return report.trust_score(facts, _implicit_fks(data))


_ADVICE_SQL = " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in rules.ADVICE.items())
PREVIEW_SQL = _facts_sql(
    f"""
    SELECT "table", "column", declared_type, nullable, inferred_type, not_null_in_practice,
      coalesce(pii_type, '-') AS pii_type, recommendation, differs, confidence
    FROM (SELECT *, never_null AS not_null_in_practice, coalesce(found, declared_type) AS inferred_type,
      found IS NOT NULL OR never_null AS differs,
      CASE WHEN is_boolean THEN size_confidence WHEN is_enum THEN enum_confidence
        WHEN is_semantic THEN CAST(round(confidence_pct) AS INT) ELSE size_confidence END AS confidence,
      CASE WHEN NOT is_boolean AND NOT is_enum AND is_semantic THEN CASE semantic_type {_ADVICE_SQL} END
        WHEN found IS NOT NULL OR never_null THEN 'migrate as ' || coalesce(found, declared_type)
        ELSE 'keep as declared' END AS recommendation
      FROM (SELECT *, CASE WHEN is_boolean THEN 'BOOLEAN'
        WHEN is_enum THEN 'ENUM(' || distinct_count || ' values)'
        ELSE upper(semantic_type) END AS found FROM facts))
    """
)


def _preview(rows: DataFrame) -> DataFrame:
    return rows.select(
        "table", "column", "declared_type", "nullable", "inferred_type", "not_null_in_practice",
        F.coalesce("pii_type", F.lit("-")).alias("pii_type"), "recommendation", "differs", "confidence",
    )


@query("preview_diff", PREVIEW_SQL)
def preview_diff(spark, folder):
    return _preview(report.preview_diff(_facts(spark, folder)[0]))


@query(
    "preview_diff_planned",
    f"""
    SELECT * REPLACE (CASE WHEN "table" = 'labels' THEN recommendation ELSE CASE declared_type
      WHEN 'BIGINT' THEN 'BIGINT' WHEN 'INT' THEN 'INTEGER' WHEN 'DOUBLE' THEN 'DOUBLE PRECISION'
      WHEN 'BOOLEAN' THEN 'BOOLEAN' ELSE 'TEXT' END END AS recommendation)
    FROM ({PREVIEW_SQL})
    """,
)
def preview_diff_planned(spark, folder):
    """The plan's target types are the advice; the labels are not in the plan and keep their own."""
    data = tables(spark, folder, *REPORTED)
    profile = profile_dataset(data, SAYS, samples=False)
    columns = read_catalog(spark, data, SAYS).columns
    plan = mapping_plan(columns, profile, "mysql", "postgres", skip=("labels",))
    return _preview(report.preview_diff(report.column_facts(profile, columns), plan))


# --- plans over the profile ----------------------------------------------------------------

@query(
    "mapping_plan",
    _facts_sql(
        """
        SELECT "table", ordinal, "column" AS source_column, "column" AS target_column,
          declared_type AS source_type,
          CASE declared_type WHEN 'BIGINT' THEN 'BIGINT' WHEN 'INT' THEN 'INTEGER'
            WHEN 'DOUBLE' THEN 'DOUBLE PRECISION' WHEN 'BOOLEAN' THEN 'BOOLEAN' ELSE 'TEXT' END
            AS target_type,
          coalesce(CASE WHEN implicit_boolean AND declared_type <> 'BOOLEAN' THEN 'to_boolean' END, '-')
            AS transformation,
          coalesce(CASE WHEN pii_suspected THEN 'may hold personal data: ' || "column" END, '-')
            AS warning,
          "rows" AS estimated_rows
        FROM facts WHERE "table" <> 'labels'
        """
    ),
)
def plan_for_postgres(spark, folder):
    """From a MySQL-typed catalog to PostgreSQL, labels left out."""
    data = tables(spark, folder, *REPORTED)
    profile = profile_dataset(data, SAYS, samples=False)
    columns = read_catalog(spark, data, SAYS).columns
    plan = mapping_plan(columns, profile, "mysql", "postgres", skip=("labels",))
    return plan.withColumns(
        {
            "transformation": F.coalesce("transformation", F.lit("-")),
            "warning": F.coalesce("warning", F.lit("-")),
        }
    )


@query(
    "mapping_plan_spark",
    _facts_sql(
        """
        SELECT "table", ordinal, "column" AS source_column, declared_type AS source_type,
          CASE declared_type WHEN 'BIGINT' THEN 'BIGINT' WHEN 'DOUBLE' THEN 'DOUBLE PRECISION'
            WHEN 'TIMESTAMP_NTZ' THEN 'TIMESTAMPTZ' WHEN 'STRING' THEN 'TEXT' END AS target_type,
          'load after customer' AS note
        FROM facts WHERE "table" = 'orders'
        """
    ),
)
def plan_of_spark_tables(spark, folder):
    """Types by the names Spark gives them, for one table, with its parents."""
    data = tables(spark, folder, *REPORTED)
    profile = profile_dataset(data, SAYS, samples=False)
    catalog = read_catalog(spark, {**data, **tables(spark, folder, "customer")}, SAYS)
    plan = mapping_plan(
        catalog.columns, profile, "spark", "postgres", only=("orders",),
        foreign_keys=catalog.foreign_keys,
    )
    return plan.select("table", "ordinal", "source_column", "source_type", "target_type", "note")
