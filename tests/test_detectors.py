"""Column detectors on literal values, with the cases that must not match."""

import pytest
from pyspark.sql import functions as F

from tabletrust.functions import predicates as P
from tabletrust.operators.profile import profile_table
from tabletrust.sources.catalog import Declared

CASES = [
    ("contact", [f"n.ito+{i}@post.example.org" for i in range(80)], "email"),
    ("contact", [f"k{i}_b@x.example" for i in range(45)] + ["at home"] * 5, None),
    ("contact", [f"k{i}_b@x.example" for i in range(57)] + ["at home"] * 3, "email"),
    ("ref", [f"{i:08d}-0000-4000-8000-{i:012d}" for i in range(50)], "uuid"),
    ("site", [f"http://shop.example.net:8080/item?id={7 * i}#top" for i in range(25)], "url"),
    ("mobile", [f"+44 20 7946 {300 + i:04d}" for i in range(30)], "phone"),
    ("code", [f"{1000000 + i}" for i in range(40)], None),
    ("postal", ["02134"] * 20 + ["10001"] * 20, "zip_code"),
    ("area", ["02134"] * 20 + ["10001"] * 20, "zip_code"),
    ("area", ["12134"] * 20 + ["10001"] * 20, None),
    ("due", [f"2026-0{i % 9 + 1}-15" for i in range(40)], "date_string"),
    ("payload", ['{"a": %d}' % i for i in range(40)], "json_string"),
    ("payload", ['  [1, {"a": null}]  '] * 40, "json_string"),
    ("payload", ['{"a": 1}x'] * 40, None),
    ("notes", [f"some free text number {i}" for i in range(50)], None),
    ("created", [1_555_000_000 + 86_400 * i for i in range(30)], "unix_timestamp"),
    ("created", [(1_555_000_000 + 86_400 * i) * 1000 for i in range(30)], "unix_timestamp"),
    ("qty", list(range(50)), None),
    ("zip_code", [10001, 94105, 60601] * 10, "zip_code"),
    ("price", [round(3.05 + i * 1.25, 2) for i in range(44)], "currency"),
    ("price", [float(i) for i in range(60)], "currency"),
    ("depth", [float(i) for i in range(60)], None),
    ("depth", [i / 7 for i in range(1, 60)], None),
    ("price", [float("nan")] * 10 + [1.25] * 10, None),
]


@pytest.mark.parametrize("column, values, expected", CASES)
def test_semantic_type(spark, column, values, expected):
    kind = {str: "string", int: "bigint", float: "double"}[type(values[0])]
    df = spark.createDataFrame([(v,) for v in values], f"{column} {kind}")
    row = profile_table(df, "t", samples=False).first()
    assert row["semantic_type"] == expected


def test_only_nulls_find_nothing(spark):
    df = spark.createDataFrame([(None,)] * 3, "anything string")
    row = profile_table(df, "t").first()
    assert (row["semantic_type"], row["implicit_boolean"], row["null_pct"]) == (None, False, 100.0)
    assert row["sample_values"] == []


def test_empty_table(spark):
    row = profile_table(spark.createDataFrame([], "a string"), "t").first()
    assert (row["rows"], row["null_pct"], row["distinct_count"]) == (0, 0.0, 0)


def test_dangers(spark):
    df = spark.createDataFrame([(0.5, 10001, "02134")], "price double, zip int, postal string")
    risks = {r["column"]: r["danger"] for r in profile_table(df, "t").collect()}
    assert "DECIMAL" in risks["price"]
    assert "leading zeros" in risks["zip"] and "leading zeros" in risks["postal"]


def test_seeded_tables(spark):
    """Users with a phone missing on every fifth row, a 0/1 flag and a three-valued status."""
    rows = [
        (i, f"u{i}@example.com", None if i % 5 == 0 else f"+1 555 010 {i:04d}",
         ("active", "inactive", "banned")[i % 3], i % 2)
        for i in range(1, 51)
    ]
    users = spark.createDataFrame(
        rows, "id int, email string, phone string, status string, is_verified int"
    )
    got = {r["column"]: r for r in profile_table(users, "users", Declared(key=("id",))).collect()}
    assert got["phone"]["null_pct"] == 20.0 and got["phone"]["pii_suspected"]
    assert got["email"]["pii_suspected"] and not got["status"]["pii_suspected"]
    assert got["is_verified"]["implicit_boolean"] and not got["id"]["implicit_boolean"]
    assert got["status"]["implicit_enum"]
    assert got["status"]["enum_values"] == ["active", "banned", "inactive"]
    assert got["id"]["sample_values"] == ["1", "2", "3", "4", "5"]
    assert got["phone"]["sample_values"][0] == "+1 555 010 0001"


def test_enum_limits(spark):
    rows = [(f"v{i % 19:02d}", f"v{i % 20:02d}", f"v{i:02d}") for i in range(40)]
    df = spark.createDataFrame(rows, "nineteen string, twenty string, unique string")
    got = {r["column"]: r for r in profile_table(df, "t").collect()}
    assert got["nineteen"]["implicit_enum"] and len(got["nineteen"]["enum_values"]) == 19
    assert not got["twenty"]["implicit_enum"] and got["twenty"]["enum_values"] is None
    assert not got["unique"]["implicit_enum"]


def test_samples_reach_past_the_head(spark):
    """A column that is NULL in the first rows still gets its first values in key order."""
    rows = [(i, f"v{i}" if i > 900 else None) for i in range(1000)]
    df = spark.createDataFrame(rows, "id int, late string").repartition(5)
    got = profile_table(df, "t", Declared(key=("id",))).where("column = 'late'").first()
    assert got["sample_values"] == ["v901", "v902", "v903", "v904", "v905"]


def test_exact_distinct_against_brute_force(spark):
    import random

    rng = random.Random(3)
    rows = [
        (rng.choice([0.0, -0.0, 1.5, None]), "x" * rng.randint(1, 60), [rng.randint(0, 3)])
        for _ in range(500)
    ]
    df = spark.createDataFrame(rows, "a double, b string, c array<int>")
    got = profile_table(df, "t", exact_distinct=True, samples=False).collect()
    expected = [len({repr(v) if isinstance(v, list) else v for v in col if v is not None}) for col in zip(*rows)]
    assert [r["distinct_count"] for r in got] == expected


@pytest.mark.parametrize(
    "text, label",
    [
        ("2020-01-02", "YYYY-MM-DD"),
        ("2020-01-02T03:04", "ISO datetime"),
        ("2020-01-02 03:04:05", "ISO datetime"),
        ("01/02/2020", "MM/DD/YYYY or DD/MM/YYYY"),
        ("01-02-2020", "DD-MM-YYYY"),
        ("1700000000", "unix epoch"),
        ("17000000001", "unix epoch"),
        ("soon", None),
        ("2020-1-2", None),
    ],
)
def test_date_formats(spark, text, label):
    assert spark.range(1).select(P.date_format_of(F.lit(text))).first()[0] == label


def test_pii_categories(spark):
    names = {
        "user_email": "email", "Mobile_No": "phone", "ssn": "government_id", "api_key": "credential",
        "cvv": "payment", "dob": "date_of_birth", "home_address": "address", "token_name": "credential",
        "zipped": "address",
    }
    df = spark.createDataFrame([(n,) for n in names], "column string")
    got = df.select(
        "column",
        P.is_personal_name(F.col("column")).alias("flag"),
        P.personal_category(F.col("column"), F.lit(None)).alias("category"),
    ).collect()
    assert all(r["flag"] for r in got)
    assert {r["column"]: r["category"] for r in got} == names


def test_samples_of_a_wide_table_without_key_are_one_scan(spark):
    from tabletrust.operators import profile

    rows = spark.range(3_000).select(
        *(F.when(F.col("id") % 7 != k % 7, F.col("id") * 31 % (100 + k)).alias(f"c{k}") for k in range(50))
    )
    tops = profile._tops(rows, [], list(range(50)))
    plan = tops._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Range (") == 1 and plan.count("WindowGroupLimit") == 2
    got = {r["column"]: r["sample_values"] for r in profile_table(rows, "wide").collect()}
    data = rows.collect()
    for k in range(50):
        assert got[f"c{k}"] == sorted(str(r[k]) for r in data if r[k] is not None)[:5]


def test_distinct_counts_are_exact_up_to_the_limit_and_sketches_merge(spark):
    from tabletrust.operators import profile

    rows = spark.range(20_000).select(
        (F.col("id") % 200).alias("few"), (F.col("id") % 201).alias("more"), F.col("id").alias("all"),
        F.when(F.col("id") % 2 == 0, 0.0).otherwise(-0.0).alias("zero"),
        F.array(F.col("id") % 1_000).alias("nested"), F.lit(None).cast("date").alias("none"),
    )
    exact = {"few": 200, "more": 201, "all": 20_000, "zero": 1, "nested": 1_000, "none": 0}
    got = {r["column"]: r for r in profile_table(rows, "t", samples=False).collect()}
    assert {c: r["distinct_count"] for c, r in got.items()} == {
        c: n if n <= 200 else None for c, n in exact.items()
    }
    assert all(got[c]["distinct_low"] <= n <= got[c]["distinct_high"] for c, n in exact.items())
    parts = [profile_table(rows.where(f"id % 4 <= {k} or id % 3 = 0"), "t", samples=False) for k in (0, 3)]
    merged = {r["column"]: r for r in profile.merged_distinct(parts[0].union(parts[1])).collect()}
    assert all(merged[c]["distinct_low"] <= n <= merged[c]["distinct_high"] for c, n in exact.items())
    assert merged["all"]["distinct_high"] < 25_000


def test_phones_are_told_without_rewriting_the_text(spark):
    import re

    from tabletrust.functions import rules
    from tabletrust.operators import profile

    texts = [
        "+44 20 7946 0300", "12345678", "123-4567", "123-456", " 1234567", "1234567\n", "1234567\r\n",
        "1" + "." * 6 + "234567", "123.456.789.012.345.6\n", "123.456.789.012.345.67", "+1234567", "1234567x",
        "(123) 456\u0661", "1234567\u2028", "+" + "1" * 19 + "-", "+" + "1" * 19 + "-\u2028", "7 " * 9_000, "", None,
    ]

    def told(text):
        ends = text.rstrip("\n\r\u0085\u2028\u2029")
        body = text if re.fullmatch(rules.PHONE[1:-1], text, re.ASCII) else ends
        fits = re.fullmatch(rules.PHONE[1:-1], body, re.ASCII) and text < ":"
        digits = len(re.findall(r"[0-9]", text))
        return bool(fits and digits >= 7 and digits < len(text))

    df = spark.createDataFrame([(t,) for t in texts], "t string")
    found = df.select(P.is_phone(F.col("t"))).collect()
    assert [r[0] for r in found] == [None if t is None else told(t) for t in texts]
    measures = df.agg(profile._counters(F.col("t"), df.schema[0].dataType)["phone"])
    plan = measures._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" in plan and "regexp_replace" not in plan


def test_sketches_of_moments_and_floats_read_no_text(spark):
    from tabletrust.operators import profile

    rows = spark.range(30_000).select(
        F.when(F.col("id") > 0, F.timestamp_seconds("id")).alias("at"),
        F.when(F.col("id") > 0, F.timestamp_seconds("id").cast("timestamp_ntz")).alias("plain"),
        F.when(F.col("id") > 0, F.col("id") / 8).alias("x"),
        F.when(F.col("id") % 3 == 0, 0.0).when(F.col("id") % 3 == 1, -0.0).alias("zero"),
        F.when(F.col("id") % 2 == 0, float("nan")).alias("nan"),
    )
    for f in rows.schema.fields:
        sketch = rows.agg(*profile._estimates(F.col(f.name), f.dataType).values())
        assert "as string" not in sketch._jdf.queryExecution().optimizedPlan().toString()
    got = {r["column"]: r for r in profile_table(rows, "t", samples=False).collect()}
    assert [got[c]["distinct_estimate"] for c in ("zero", "nan")] == [1, 1]
    assert all(got[c]["distinct_low"] <= 29_999 <= got[c]["distinct_high"] for c in ("at", "plain", "x"))
