"""Quality, previews, reports, drift and type rules on literal rows."""

import pytest
from pyspark.sql import functions as F

from tabletrust.functions import rules
from tabletrust.functions.conversions import adapt
from tabletrust.operators import drift, mapping, preview, quality, relations, report
from tabletrust.operators.mapping import ColumnMap
from tabletrust.sources.catalog import (
    Declared,
    catalog_from_information_schema,
    document_census,
    indexes_from_statistics,
    read_catalog,
    with_schema_names,
)
from tabletrust.sources.tables import hash_slices, slice_sizes

USERS = [(1, "a@x.com", 30, "2020-01-01"), (2, "a@x.com", -1, "0000-00-00"), (3, "", 41, "2021-06-01"),
         (4, "d@x.com", -1, "1970-01-01")]
ORDERS = [(10, 1), (11, 999), (12, 2)]
SAYS = {
    "users": Declared(key=("id",), not_null=("email",), unique=("email",)),
    "orders": Declared(key=("id",), foreign_keys=(("user_id", "users", "id"),)),
}


@pytest.fixture(scope="module")
def dirty(spark):
    return {
        "users": spark.createDataFrame(USERS, "id int, email string, age int, joined string"),
        "orders": spark.createDataFrame(ORDERS, "id int, user_id int"),
    }


def test_quality_literals(dirty):
    issues = quality.quality_issues(dirty, SAYS)
    got = {(r["kind"], r["table"], r["column"]): r for r in issues.collect()}
    assert set(got) == {
        ("duplicate_in_unique", "users", "email"),
        ("empty_string_in_not_null", "users", "email"),
        ("numeric_sentinel", "users", "age"),
        ("sentinel_date", "users", "joined"),
        ("orphaned_rows", "orders", "user_id"),
    }
    assert got[("numeric_sentinel", "users", "age")]["hits"] == 2
    assert got[("sentinel_date", "users", "joined")]["examples"] == "0000-00-00, 1970-01-01"
    assert got[("orphaned_rows", "orders", "user_id")]["examples"] == "999"
    assert "999" in got[("orphaned_rows", "orders", "user_id")]["detail"]
    score = quality.quality_score(issues, 2).first()
    assert score["quality_score"] == 100 - 12 - 6 - 2 - 6 - 12


def test_clean_tables_score_100(spark):
    users = spark.createDataFrame([(1, "a"), (2, "b")], "id int, email string")
    issues = quality.quality_issues({"users": users}, {"users": SAYS["users"]})
    assert quality.quality_score(issues, 1).first()["quality_score"] == 100


def test_empty_parent_is_not_checked(dirty, spark):
    data = {**dirty, "users": dirty["users"].limit(0)}
    found = quality.orphaned_rows(data, "orders", SAYS["orders"])
    assert found.count() == 0


def test_rare_sentinels_are_ignored(spark):
    df = spark.createDataFrame([(-1 if i == 0 else i,) for i in range(30)], "n int")
    assert quality.value_faults(df, "t", Declared()).count() == 0


def test_implicit_fk_literals(spark):
    says = {"users": Declared(key=("id",)), "orders": Declared(key=("id",))}
    data = {
        "users": spark.createDataFrame([(1,), (2,), (3,)], "id int"),
        "orders": spark.createDataFrame(
            [(10, 1, 777, "1"), (11, 2, 888, "2"), (12, 3, 999, "3")],
            "id int, user_id bigint, ghost_id int, text_id string",
        ),
    }
    got = relations.implicit_foreign_keys(data, says).collect()
    assert [(r["column"], r["likely_references"], r["match_pct"], r["name_match"]) for r in got] == [
        ("user_id", "users.id", 100.0, True)
    ]
    declared = {**says, "orders": Declared(key=("id",), foreign_keys=(("user_id", "users", "id"),))}
    assert relations.implicit_foreign_keys(data, declared).count() == 0


@pytest.mark.parametrize(
    "order, winner", [([("a", True, 95.0), ("b", False, 96.0)], "b"), ([("b", False, 96.0), ("a", True, 95.0)], "a")]
)
def test_best_reference_depends_on_order(spark, order, winner):
    rows = [("t", "x_id", i, name, "id", pct, match) for i, (name, match, pct) in enumerate(order)]
    df = spark.createDataFrame(
        rows,
        "table string, column string, parent int, ref_table string, ref_column string, "
        "match_pct double, name_match boolean",
    )
    assert relations.best_reference(df).first()["likely_references"] == f"{winner}.id"


def test_load_order_with_cycle_and_self_reference(spark):
    links = [("b", "a"), ("c", "b"), ("c", "a"), ("x", "y"), ("y", "x"), ("z", "y"), ("s", "s")]
    tables = spark.createDataFrame([(t,) for t in "zyxcbas"], "table string")
    fks = spark.createDataFrame(links, "table string, ref_table string")
    got = relations.load_order(tables, fks).orderBy("load_position").collect()
    assert [r["table"] for r in got] == ["a", "s", "b", "c", "x", "y", "z"]
    assert [r["table"] for r in sorted(got, key=lambda r: r["drop_position"])] == list("zyxcbsa")
    assert [r["table"] for r in got if r["in_cycle"]] == ["x", "y", "z"]


MAPPING = [
    ColumnMap("is_active", "is_active", "BOOLEAN"),
    ColumnMap("price", "price", "DECIMAL(10,2)"),
    ColumnMap("name", "name", "TEXT"),
]


def test_preview_flags_changes(spark):
    df = spark.createDataFrame([(1, 1, 9.999, "ada")], "id int, is_active int, price double, name string")
    row = preview.change_preview(df, MAPPING, ["id"]).first()
    assert row["transformed"]["is_active"] is True and row["transformed"]["price"] == 10.0
    assert row["changed_columns"] == ["is_active", "price"]


def test_preview_unchanged(spark):
    df = spark.createDataFrame(
        [(1, True, 10.0, "ada"), (2, None, None, None)], "id int, is_active boolean, price double, name string"
    )
    rows = preview.change_preview(df, MAPPING, ["id"])
    assert [r["changed_columns"] for r in rows.collect()] == [[], []]
    assert preview.change_summary(rows).first()["rows_with_changes"] == 0


def test_preview_shows_fifty_counts_all(spark):
    df = spark.range(300).selectExpr("id", "1 AS is_active", "1.0D AS price", "'n' AS name")
    rows = preview.change_preview(df, MAPPING, ["id"])
    assert preview.preview_rows(rows, ["id"]).count() == 50
    summary = preview.change_summary(rows).first()
    assert (summary["rows_simulated"], summary["rows_with_changes"]) == (300, 300)


def test_conversions_keep_what_does_not_convert(spark):
    df = spark.createDataFrame([(1, "7.9"), (2, "-7.9"), (3, "seven"), (4, None)], "id int, v string")
    columns = [ColumnMap("id", "id"), ColumnMap("v", "n", "BIGINT", "to_int")]
    got = {r["id"]: r["n"] for r in mapping.apply_mapping(df, columns).collect()}
    assert got == {1: 7, 2: -7, 3: None, 4: None}
    lost = mapping.failed_conversions(df, columns, "id").collect()
    assert [(r["id"], r["column"], r["original"]) for r in lost] == [(3, "n", "seven")]


def test_unknown_conversion_passes_through(spark):
    df = spark.createDataFrame([("x", {"k": 1})], "a string, m map<string,int>")
    row = mapping.apply_mapping(df, [ColumnMap("a", "a", None, "reverse it"), ColumnMap("m", "m")]).first()
    assert (row["a"], row["m"]) == ("x", '{"k":1}')


def test_boolean_of_one_point_zero_is_false(spark):
    df = spark.createDataFrame([(1.0, " Yes "), (0.0, "no")], "x double, y string")
    columns = [ColumnMap("x", "x", None, "to_boolean"), ColumnMap("y", "y", None, "to_boolean")]
    assert [tuple(r) for r in mapping.apply_mapping(df, columns).collect()] == [(False, True), (False, False)]


@pytest.mark.parametrize(
    "source, target, native, expected",
    [
        ("mysql", "postgres", "tinyint(1)", "BOOLEAN"),
        ("mysql", "postgres", "tinyint(4)", "INTEGER"),
        ("mysql", "postgres", "TinyInt(1) unsigned", "BOOLEAN"),
        ("postgres", "mysql", "varchar(120)", "VARCHAR(255)"),
        ("sqlite", "postgres", "integer", "BIGINT"),
        ("postgres", "mysql", "no such type", "TEXT"),
        ("mongodb", "bigquery", "objectid", "STRING"),
        ("postgres", "mongodb", "jsonb", "json"),
        ("postgres", "nowhere", "int", "TEXT"),
        ("neo4j", "sqlserver", "list", "NVARCHAR(MAX)"),
    ],
)
def test_type_rules(spark, source, target, native, expected):
    df = spark.createDataFrame([(native,)], "type string")
    assert mapping.with_target_types(df, source, target).first()["target_type"] == expected


def test_families():
    assert rules.family_of("Aurora-Postgres") == "postgres"
    with pytest.raises(ValueError):
        rules.family_of("paper")


def test_adapt_values(spark):
    df = spark.sql(
        "SELECT CAST(1.50 AS DECIMAL(5,2)) d, DATE'2020-01-02' t, true b, CAST('é' AS BINARY) x, "
        "array(1, 2) a, '' e, 2.5D f"
    )
    types = {f.name: f.dataType for f in df.schema.fields}

    def one(name, family):
        return df.select(adapt(F.col(name), types[name], family)).first()[0]

    assert one("d", "sqlite") == 1.5 and one("t", "neo4j") == "2020-01-02" and one("b", "sqlite") == 1
    assert one("x", "bigquery") == "é" and one("a", "sqlite") == "[1,2]" and one("a", "mongodb") == [1, 2]
    assert one("e", "dynamodb") is None and str(one("f", "dynamodb")) == "2.5000000000"
    assert str(one("t", "mongodb")) == "2020-01-02 00:00:00"


# --- reports -------------------------------------------------------------------------------

COLUMNS = [("id", "INTEGER", False), ("is_active", "TINYINT(1)", True), ("status", "VARCHAR(50)", True),
           ("email", "VARCHAR(255)", True), ("nickname", "VARCHAR(50)", True)]


@pytest.fixture(scope="module")
def facts(spark):
    says = {"id": (0, 1000, False, False, None, False), "is_active": (0, 2, True, False, None, False),
            "status": (0, 3, False, True, ["active", "banned", "pending"], False),
            "email": (20, 980, False, False, None, True), "nickname": (400, 500, False, False, None, False)}
    rows = [
        ("users", i, c, t, 1000, *says[c], None, None, None, None)
        for i, (c, t, _) in enumerate(COLUMNS)
    ]
    profile = spark.createDataFrame(
        rows,
        "table string, ordinal int, column string, declared_type string, rows bigint, nulls bigint, "
        "distinct_count bigint, implicit_boolean boolean, implicit_enum boolean, "
        "enum_values array<string>, pii_suspected boolean, semantic_type string, "
        "confidence_pct double, danger string, evidence string",
    )
    columns = spark.createDataFrame(
        [("users", c, t, n, c == "id") for c, t, n in COLUMNS],
        "table string, column string, type string, nullable boolean, primary_key boolean",
    )
    return report.column_facts(profile, columns)


def test_findings_and_trust(spark, facts):
    kinds = {}
    for r in report.findings(facts).collect():
        kinds.setdefault(r["kind"], {})[r["column"]] = r
    assert set(kinds["implicit_boolean"]) == {"is_active"}
    assert kinds["implicit_boolean"]["is_active"]["confidence"] == 99
    assert kinds["implicit_enum"]["status"]["detail"] == "active,banned,pending"
    assert set(kinds["never_null_nullable"]) == {"is_active", "status"}
    assert kinds["pii"]["email"]["detail"] == "email"
    none = spark.createDataFrame([], "table string")
    assert report.trust_score(facts, none).first()["schema_trust_score"] == 59
    assert report.trust_score(facts.limit(0), none).first()["schema_trust_score"] == 0


def test_preview_diff_rows(spark, facts):
    rows = report.preview_diff(facts).collect()
    assert [r["column"] for r in rows if r["differs"]] == ["is_active", "status"]
    assert [r["differs"] for r in rows] == [True, True, False, False, False]
    assert rows[0]["inferred_type"] == "BOOLEAN" and rows[0]["declared_type"] == "TINYINT(1)"
    assert rows[1]["inferred_type"] == "ENUM(3 values)"
    plan = spark.createDataFrame(
        [("users", "is_active", "BOOLEAN")], "table string, source_column string, target_type string"
    )
    planned = {r["column"]: r["recommendation"] for r in report.preview_diff(facts, plan).collect()}
    assert planned["is_active"] == "BOOLEAN" and planned["nickname"] == "keep as declared"


@pytest.mark.parametrize("ratio, table, review", [(1.0, 100, set()), (0.8, 94, {"is_active", "status", "email"})])
def test_confidence(spark, facts, ratio, table, review):
    scores = spark.createDataFrame(
        [("users", 0.7 + 0.3 * ratio, ratio)], "source_table string, score double, match_ratio double"
    )
    rows = report.confidence_breakdown(scores, facts).collect()
    assert {r["table_confidence"] for r in rows} == {table}
    assert {r["column"] for r in rows if r["needs_review"]} == review
    if ratio == 1.0:
        by = {r["column"]: r["confidence"] for r in rows}
        assert (by["is_active"], by["email"], by["id"]) == (90, 95, 100)


# --- drift ---------------------------------------------------------------------------------

BASE = [("id", "INT", False, None), ("email", "VARCHAR(255)", False, None)]


def _drift(spark, before, after, old_indexes=(), new_indexes=()):
    columns = "monitor string, table string, column string, type string, nullable boolean, default string"
    indexes = "monitor string, table string, index string, unique boolean"

    def cols(rows):
        return spark.createDataFrame([("m", "users", *r) for r in rows], columns)

    def idx(rows):
        return spark.createDataFrame([("m", "users", *r) for r in rows], indexes)

    events = drift.diff_catalogs(cols(before), cols(after), idx(old_indexes), idx(new_indexes))
    monitors = spark.createDataFrame([("m",)], "monitor string")
    checks = drift.check_results(monitors, events, F.current_timestamp())
    return drift.in_order(events).collect(), checks.first()["health_score"]


DRIFTS = [
    (BASE, BASE, [], 100),
    (BASE, BASE[:1], [("critical", "column_dropped")], 75),
    (BASE, [], [("critical", "table_dropped")], 75),
    ([], BASE, [("info", "table_added")], 100),
    (BASE, [BASE[0], ("email", "VARCHAR(255)", True, None)], [("critical", "not_null_dropped")], 75),
    ([("id", "BIGINT", False, None)], [("id", "SMALLINT", False, None)], [("critical", "type_changed")], 75),
    ([("id", "INT", False, None)], [("id", "BIGINT", False, None)], [("warning", "type_changed")], 92),
    ([("id", "int", False, None)], [("id", "INT", False, None)], [], 100),
    ([("c", "VARCHAR(20)", True, None)], [("c", "VARCHAR(255)", True, None)], [("warning", "type_changed")], 92),
    ([("c", "TEXT", True, None)], [("c", "VARCHAR(255)", True, None)], [("critical", "type_changed")], 75),
    (BASE, [*BASE, ("tier", "VARCHAR(20)", False, None)], [("warning", "column_added")], 92),
    (BASE, [*BASE, ("tier", "VARCHAR(20)", False, "x")], [("info", "column_added")], 100),
    (BASE, [*BASE, ("notes", "TEXT", True, None)], [("info", "column_added")], 100),
]


@pytest.mark.parametrize("before, after, expected, health", DRIFTS)
def test_drift(spark, before, after, expected, health):
    events, score = _drift(spark, before, after)
    assert [(e["severity"], e["kind"]) for e in events] == expected
    assert score == health


def test_drift_hints_and_indexes(spark):
    events, _ = _drift(spark, BASE, [*BASE, ("is_verified", "TINYINT", True, None)])
    assert events[0]["likely_type"] == "boolean" and "BOOLEAN" in events[0]["advice"]
    events, _ = _drift(spark, BASE, BASE, old_indexes=[("uq_email", True)])
    assert events[0]["kind"] == "index_dropped" and "uniqueness" in events[0]["detail"]
    events, _ = _drift(spark, BASE, [("id", "SMALLINT", True, None)], new_indexes=[("ix", False)])
    assert [e["severity"] for e in events] == ["critical", "critical", "warning", "info"]


def test_row_counts_are_not_drift(spark):
    a = spark.createDataFrame([("m", "t", "c", 5)], "monitor string, table string, column string, rows int")
    assert drift.structural(a).columns == ["monitor", "table", "column"]


def test_unreadable_monitor_keeps_its_score(spark):
    from tabletrust.streaming.recurring import run_check

    monitors = spark.createDataFrame(
        [("ok", True, None, None), ("down", True, "timeout", 84), ("off", False, None, None)],
        "monitor string, enabled boolean, error string, last_score int",
    )
    columns = "monitor string, table string, column string, type string, nullable boolean, default string"
    base = spark.createDataFrame([(m, "t", "c", "INT", True, None) for m in ("ok", "down", "off")], columns)
    current = spark.createDataFrame([], columns)
    none = spark.createDataFrame([], "monitor string, table string, index string, unique boolean")
    events, checks = run_check(monitors, base, current, none, none, F.current_timestamp())
    assert [(e["monitor"], e["kind"]) for e in events.collect()] == [("ok", "table_dropped")]
    got = {r["monitor"]: (r["health_score"], r["has_drift"], r["error"]) for r in checks.collect()}
    assert got == {"ok": (75, True, None), "down": (84, False, "timeout")}


# --- catalogs ------------------------------------------------------------------------------


def test_indexes_and_schema_names_of_a_database(spark):
    rows = [
        ("app", "o", "by_user", 2, "at", 1), ("app", "o", "by_user", 1, "u", 1), ("app", "o", "one", 1, "id", 0),
        ("old", "o", "one", 1, "code", 0),
    ]
    schema = "table_schema string, table_name string, index_name string, seq_in_index int, column_name string, non_unique int"
    found = indexes_from_statistics(with_schema_names(spark.createDataFrame(rows, schema), "app"))
    assert {(r["table"], r["index"], tuple(r["columns"]), r["unique"]) for r in found.collect()} == {
        ("o", "by_user", ("u", "at"), False), ("o", "one", ("id",), True), ("old.o", "one", ("code",), True),
    }


def test_hash_slices_hold_each_row_once(spark):
    rows = spark.createDataFrame([(k,) for k in (-7, -1, 0, 1, 8, 9, None, None)], "k int")
    got = slice_sizes(rows, hash_slices("k", 4), ["k"])
    assert {r["slice"]: r["rows"] for r in got.collect()} == {0: 4, 1: 3, 3: 1}


def test_information_schema(spark):
    columns = spark.createDataFrame(
        [("o", "id", 1, "int", "NO", None), ("o", "u", 2, "int", "YES", None), ("u", "id", 1, "int", "NO", "0")],
        "table_name string, column_name string, ordinal_position int, data_type string, "
        "is_nullable string, column_default string",
    )
    constraints = spark.createDataFrame(
        [("pk_o", "o", "PRIMARY KEY"), ("pk_u", "u", "PRIMARY KEY"), ("fk", "o", "FOREIGN KEY")],
        "constraint_name string, table_name string, constraint_type string",
    )
    usage = spark.createDataFrame(
        [("pk_o", "o", "id", 1), ("pk_u", "u", "id", 1), ("fk", "o", "u", 1)],
        "constraint_name string, table_name string, column_name string, ordinal_position int",
    )
    references = spark.createDataFrame(
        [("fk", "u", "id")], "constraint_name string, table_name string, column_name string"
    )
    cols, keys, fks = catalog_from_information_schema(columns, constraints, usage, references)
    assert {(r["table"], r["column"], r["nullable"], r["primary_key"]) for r in cols.collect()} == {
        ("o", "id", False, True), ("o", "u", True, False), ("u", "id", False, True)
    }
    assert {r["table"]: r["columns"] for r in keys.collect()} == {"o": ["id"], "u": ["id"]}
    assert [tuple(r) for r in fks.collect()] == [("o", "u", "u", "id")]


def test_composite_foreign_keys_are_paired_by_position(spark):
    columns = spark.createDataFrame(
        [], "table_name string, column_name string, ordinal_position int, data_type string, "
        "is_nullable string, column_default string",
    )
    constraints = spark.createDataFrame(
        [("fk", "o", "FOREIGN KEY")], "constraint_name string, table_name string, constraint_type string"
    )
    usage = spark.createDataFrame(
        [("fk", "o", "a", 1, 2), ("fk", "o", "b", 2, 1)],
        "constraint_name string, table_name string, column_name string, ordinal_position int, "
        "position_in_unique_constraint int",
    )
    references = spark.createDataFrame(
        [("fk", "u", "x", 1), ("fk", "u", "y", 2)],
        "constraint_name string, table_name string, column_name string, ordinal_position int",
    )
    _, _, fks = catalog_from_information_schema(columns, constraints, usage, references)
    assert sorted(tuple(r) for r in fks.collect()) == [("o", "a", "u", "y"), ("o", "b", "u", "x")]


def test_document_census(spark):
    docs = [f'{{"_id": {i}, "orders": [1], "full_name": {"null" if i % 7 == 0 else chr(34) + "n" + chr(34)}'
            + (', "loyalty_tier": "gold"' if i % 5 == 0 else "") + "}" for i in range(100)]
    df = spark.createDataFrame([(d,) for d in docs], "doc string")
    got = {r["field"]: r for r in document_census(df, "doc").collect()}
    assert got["_id"]["type"] == "long" and got["_id"]["primary_key"]
    assert got["orders"]["type"] == "array" and not got["orders"]["optional"]
    assert got["loyalty_tier"]["optional"] and got["loyalty_tier"]["presence_pct"] == 20.0
    assert got["full_name"]["nullable"] and not got["full_name"]["mixed_types"]


def test_empty_and_broken_documents(spark):
    docs = ['{"a": 1}', "{}", '{"a": 2, "b": "x"}', "not json", '{"a": "y"}']
    df = spark.createDataFrame([(d,) for d in docs], "doc string")
    got = {r["field"]: r for r in document_census(df, "doc").collect()}
    assert set(got) == {"a", "b"}
    assert (got["a"]["presence_pct"], got["b"]["presence_pct"]) == (75.0, 25.0)
    assert got["a"]["mixed_types"] and got["a"]["target_kind"] == "string" and got["a"]["type"] == "long"


def test_catalog_of_tables(spark, dirty):
    catalog = read_catalog(spark, dirty, SAYS)
    rows = {(r["table"], r["column"]): r for r in catalog.columns.collect()}
    assert rows[("users", "id")]["primary_key"] and not rows[("users", "email")]["nullable"]
    assert [r["index"] for r in catalog.indexes.collect()] == ["users_email_key"]


def test_path_census(spark):
    from tabletrust.sources.catalog import path_census

    texts = ['{"a": 1, "b": {"c": [1, null, {"d": "x"}]}}', '{"a": "1", "b": {}}', "[]", "3", "{cut", None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "doc string")
    got = {r["path"]: r for r in path_census(df, "doc").collect()}
    assert {p: (r["type"], r["present"], r["parents"]) for p, r in got.items()} == {
        "$": ("object", 4, None), "$.a": ("string", 2, 3), "$.b": ("object", 2, 3),
        "$.b.c": ("array", 1, 2), "$.b.c[]": ("object", 3, 1), "$.b.c[].d": ("string", 1, 1),
    }
    assert got["$.a"]["mixed_types"] and got["$.a"]["target_kind"] == "string"
    assert got["$.b.c[]"]["nullable"] and {r["unparsed"] for r in got.values()} == {2}
    assert path_census(df.limit(0), "doc").collect() == []


def test_first_sight_of_a_monitor_survives_a_second_run(spark):
    from tabletrust.session import fresh_path
    from tabletrust.sources.sinks import VersionedTable
    from tabletrust.streaming.recurring import DriftSweep, snapshot_rows

    base = fresh_path(spark, "sweep")
    sweep = DriftSweep(VersionedTable(spark, f"{base}/b"), f"{base}/e", f"{base}/c", f"{base}/k")
    columns = "monitor string, table string, column string, type string, nullable boolean, default string"
    rows = lambda kind: spark.createDataFrame([("m", "t", "c", kind, True, None)], columns)
    none = spark.createDataFrame([], "monitor string, table string, index string, unique boolean")
    names = spark.createDataFrame([("m",), ("bare",)], "monitor string")
    for _ in range(2):
        sweep.check_batch(snapshot_rows(rows("BIGINT"), none, names), 0)
    sweep.check_batch(snapshot_rows(rows("SMALLINT"), none, names), 1)
    events = spark.read.parquet(f"{base}/e").orderBy("batch", "monitor").collect()
    assert [(e["batch"], e["monitor"], e["kind"], e["detail"]) for e in events[:2]] == [
        (0, "bare", "baseline_created", "baseline of 0 columns taken"),
        (0, "m", "baseline_created", "baseline of 1 columns taken"),
    ]
    assert [(e["batch"], e["monitor"], e["severity"]) for e in events[2:]] == [(1, "m", "critical")]
    checks = spark.read.parquet(f"{base}/c").orderBy("batch", "monitor").collect()
    assert [(c["monitor"], c["has_drift"], c["health_score"]) for c in checks] == [
        ("bare", False, 100), ("m", False, 100), ("bare", False, 100), ("m", True, 75)
    ]
