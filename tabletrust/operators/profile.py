"""What the data in each column looks like, from every row.

`distinct_count` is exact: always where the caller asks for it, otherwise for columns of at most
`FEW_DISTINCT` values, and null for others. `distinct_estimate` and its bounds come from a sketch that
the profile keeps, so profiles of parts of a table can be merged.

One pass computes all measures of a table's columns. Later passes read only the columns that
need them: exact distinct counts, JSON parsing, and sample values the head of the table did not
supply. What reaches the driver is one row of counters per column.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabletrust.functions import predicates as P
from tabletrust.functions import rules
from tabletrust.functions.conversions import TEMPORAL, as_text
from tabletrust.sources.catalog import Declared, type_name

#: Up to so many distinct values of a column are counted exactly; more are estimated only.
FEW_DISTINCT = 200
#: Binary logarithm of the registers in a sketch, and its bounds in standard errors.
SKETCH_LG, SKETCH_ERRORS = 12, 4
HEAD_ROWS = 256
COUNTERS_PER_JOB = 60
SAMPLES = 5

COUNTERS = [
    "rows", "non_null", "zero_one", "email", "uuid", "url", "iso_date",
    "phone", "digits", "leading_zero", "opens_json", "date_bits", "epoch_s", "epoch_ms",
    "two_decimals", "cents",
]
METRICS_SCHEMA = (
    "table string, ordinal int, column string, declared_type string, kind string, "
    + ", ".join(f"{name} bigint" for name in COUNTERS)
    + ", json bigint, distinct_count bigint, distinct_estimate bigint, distinct_sketch binary, "
    "enum_values array<string>, sample_values array<string>"
)


def kind_of(dtype: T.DataType) -> str:
    if isinstance(dtype, T.StringType):
        return "string"
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, P.INTEGRAL):
        return "integer"
    if isinstance(dtype, P.FLOATING):
        return "float"
    if isinstance(dtype, T.DecimalType):
        return "decimal"
    return "other"


def _counters(c: Column, dtype: T.DataType) -> dict[str, Column]:
    """Aggregates that apply to a column of this type."""
    kind = kind_of(dtype)
    out = {"non_null": F.count(c)}
    if kind != "other":
        out["zero_one"] = F.count_if(P.is_zero_or_one(c, dtype) & c.isNotNull())
    if kind == "string":
        bits = F.lit(0)
        for i, (pattern, _) in reversed(list(enumerate(rules.DATE_FORMATS))):
            bits = F.when(c.rlike(pattern), 1 << i).otherwise(bits)
        out |= {
            "email": F.count_if(P.is_email(c)),
            "uuid": F.count_if(P.is_uuid(c)),
            "url": F.count_if(P.is_url(c)),
            "iso_date": F.count_if(P.is_iso_date(c)),
            "phone": F.count_if(P.is_phone(c)),
            "digits": F.count_if(P.is_digits_4_10(c)),
            "leading_zero": F.count_if(c.startswith("0")),
            "opens_json": F.count_if(P.opens_json(c)),
            "date_bits": F.bit_or(F.when(P.may_be_date(c), bits)),
        }
    if kind == "integer":
        out["epoch_s"] = F.count_if(P.in_epoch_seconds(c))
        out["epoch_ms"] = F.count_if(P.in_epoch_millis(c))
    if kind == "float":
        two = P.has_two_decimals(c)
        out["two_decimals"] = F.count_if(two)
        out["cents"] = F.count_if(two & (c != F.floor(c)))
    return out


def _side_by_side(jobs: list) -> list:
    """Results of independent Spark jobs, submitted together."""
    if len(jobs) < 2:
        return [job() for job in jobs]
    with ThreadPoolExecutor(max_workers=8) as pool:
        return list(pool.map(lambda job: job(), jobs))


def _estimates(c: Column, dtype: T.DataType) -> dict[str, Column]:
    """Kept apart from the counters: a sketch in an aggregate rules out generated code for it."""
    if kind_of(dtype) == "integer":
        value = c.cast("bigint")
    elif kind_of(dtype) == "float":
        value = F.when(c.isNotNull(), F.xxhash64(c + F.lit(0.0)))  # -0.0 equals 0.0
    elif isinstance(dtype, TEMPORAL):
        value = F.when(c.isNotNull(), F.xxhash64(c))  # text would cost more than the sketch
    else:
        value = as_text(c, dtype)
    return {"distinct_sketch": F.hll_sketch_agg(value, F.lit(SKETCH_LG))}


def distinct_bounds(estimate: Column) -> tuple[Column, Column]:
    """Least and greatest number of distinct values behind an estimate of a sketch."""
    error = SKETCH_ERRORS * 1.04 / 2 ** (SKETCH_LG / 2)
    return (
        F.floor(estimate * (1 - error)).alias("distinct_low"),
        F.ceil(estimate * (1 + error)).alias("distinct_high"),
    )


def _measure(df: DataFrame, estimate: bool = True) -> list[dict[str, int]]:
    """A dict of counters per column, in column order.

    Columns are measured in groups, one job each, so the generated code stays small however
    wide the table is. Every job reads its own columns only.
    """
    fields = df.schema.fields
    columns = [(i, F.col(f"`{f.name}`"), f.dataType) for i, f in enumerate(fields)]
    plan = [(i, _counters(c, dtype)) for i, c, dtype in columns]
    if estimate:
        plan += [(i, _estimates(c, dtype)) for i, c, dtype in columns]
    chunks: list[list] = [[]]
    for number, entry in enumerate(plan):
        full = sum(len(exprs) for _, exprs in chunks[-1]) >= COUNTERS_PER_JOB
        if full or number == len(fields):
            chunks.append([])
        chunks[-1].append(entry)

    def job(chunk: list):
        aggregates = [F.count(F.lit(1)).alias("rows")]
        for i, exprs in chunk:
            aggregates += [expr.alias(f"{i}:{name}") for name, expr in exprs.items()]
        sketches = [i for i, exprs in chunk if "distinct_sketch" in exprs]
        read = [
            F.hll_sketch_estimate(f"`{i}:distinct_sketch`").alias(f"{i}:distinct_estimate")
            for i in sketches
        ]
        frame = df.agg(*aggregates).select("*", *read)
        return lambda: frame.first()

    found = {}
    for row in _side_by_side([job(chunk) for chunk in chunks]):
        found |= row.asDict()
    measured = [{**dict.fromkeys(COUNTERS, 0), "rows": found["rows"]} for _ in fields]
    for i, exprs in plan:
        measured[i] |= {name: found[f"{i}:{name}"] or 0 for name in exprs}
        if "distinct_sketch" in exprs:
            measured[i]["distinct_estimate"] = found[f"{i}:distinct_estimate"]
    return measured


def _json_count(df: DataFrame, column: str) -> int:
    """Values that are whole JSON texts."""
    return df.agg(F.count_if(P.parses_as_json(F.col(f"`{column}`")))).first()[0]


def _distinct_count(df: DataFrame, i: int, few: bool) -> int:
    """Exact distinct values of one column.

    A single distinct aggregate needs no row expansion: each task drops its own repeats, so a
    value found in a third of the rows moves once per task. Long texts of columns with many
    values move as digests.
    """
    f = df.schema.fields[i]
    value = F.col(f"`{f.name}`")
    if isinstance(f.dataType, P.NESTED):
        value = F.md5(F.to_json(value))
    elif kind_of(f.dataType) == "string" and not few:
        value = F.when(F.length(value) > 32, F.md5(value)).otherwise(value)
    return df.agg(F.count_distinct(value)).first()[0]


def _enum_values(df: DataFrame, i: int) -> list[str]:
    """The smallest distinct values of a text column, as many as an enum may have."""
    c = F.col(f"`{df.schema.fields[i].name}`").alias("value")
    values = df.select(c).where(F.col("value").isNotNull()).distinct()
    return [r[0] for r in values.orderBy("value").limit(rules.ENUM_LIMIT).collect()]


def _first_values(df: DataFrame, keys: list[str], non_null: list[int]) -> dict[int, list[str]]:
    """First five non-null values per column in key order (in value order without a key)."""
    fields = df.schema.fields
    found: dict[int, list[str]] = {i: [] for i in range(len(fields))}
    if keys:
        head = df
        if len(keys) == 1:  # reading the key alone first lets the scan skip row groups
            edge = df.select(keys[0]).where(F.col(keys[0]).isNotNull())
            edge = edge.orderBy(keys[0]).limit(HEAD_ROWS).agg(F.max(keys[0])).first()[0]
            head = df.where(F.col(keys[0]) <= F.lit(edge)) if edge is not None else df
        rows = head.orderBy(*keys).limit(HEAD_ROWS)
        texts = [as_text(F.col(f"`{f.name}`"), f.dataType).alias(str(i)) for i, f in enumerate(fields)]
        for row in rows.select(*texts).collect():
            for i, values in found.items():
                if row[i] is not None and len(values) < SAMPLES:
                    values.append(row[i])
    short = [i for i, v in found.items() if len(v) < min(SAMPLES, non_null[i])]
    if short:
        found |= {i: [] for i in short}
        for r in sorted(_tops(df, keys, short).collect(), key=lambda r: r["place"]):
            found[r["ordinal"]].append(r["value"])
    return found


def _tops(df: DataFrame, keys: list[str], columns: list[int]) -> DataFrame:
    """(ordinal, value, place): the first SAMPLES values of each of these columns.

    All columns are read in one scan; the rank limit holds inside each task before the one shuffle.
    """
    fields = df.schema.fields
    cells = [
        F.struct(F.lit(i).alias("ordinal"), as_text(F.col(f"`{f.name}`"), f.dataType).alias("value"))
        for i, f in ((i, fields[i]) for i in columns)
    ]
    order = [f"_key{k}" for k in range(len(keys))] or ["value"]
    rows = df.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(keys, order)), F.inline(F.array(*cells)))
    rank = F.row_number().over(Window.partitionBy("ordinal").orderBy(*order))
    rows = rows.where("value IS NOT NULL").withColumn("place", rank)
    return rows.where(F.col("place") <= SAMPLES).select("ordinal", "value", "place")


def measure_table(
    df: DataFrame,
    table: str,
    declared: Declared | None = None,
    exact_distinct: bool = False,
    samples: bool = True,
) -> DataFrame:
    """Counters, distinct counts, enum values and samples: one row per column."""
    declared = declared or Declared()
    fields = df.schema.fields
    everything = range(len(fields))
    if exact_distinct:
        count_all = [partial(_measure, df, False)]
        count_all += [partial(_distinct_count, df, i, False) for i in everything]
        measured, *exact_counts = _side_by_side(count_all)
        for m, d in zip(measured, exact_counts):
            m |= {"distinct_estimate": d, "distinct_sketch": None}
    else:
        measured = _measure(df)
    # Far enough above the limit that no column with few values is missed.
    few = [m["distinct_estimate"] <= 2 * FEW_DISTINCT for m in measured]
    wanted = [] if exact_distinct else [i for i in everything if few[i]]
    texts = [i for i in everything if kind_of(fields[i].dataType) == "string"]
    maybe_enum = [i for i in texts if few[i] and measured[i]["non_null"]]
    maybe_json = [
        i
        for i in texts
        if measured[i]["non_null"]
        and measured[i]["opens_json"] >= rules.MATCH_SHARE * measured[i]["non_null"]
    ]
    jobs = {("distinct", i): partial(_distinct_count, df, i, few[i]) for i in wanted}
    jobs |= {("values", i): partial(_enum_values, df, i) for i in maybe_enum}
    jobs |= {("json", i): partial(_json_count, df, fields[i].name) for i in maybe_json}
    if samples:
        non_null = [m["non_null"] for m in measured]
        jobs["first"] = partial(_first_values, df, list(declared.key), non_null)
    done = dict(zip(jobs, _side_by_side(list(jobs.values()))))
    firsts = done.get("first", {})
    rows = []
    for i, (f, m) in enumerate(zip(fields, measured)):
        distinct = m["distinct_estimate"] if exact_distinct else done.get(("distinct", i))
        if not exact_distinct and distinct is not None and distinct > FEW_DISTINCT:
            distinct = None
        is_small = distinct is not None and distinct < rules.ENUM_LIMIT
        values = done.get(("values", i)) if is_small else None
        rows.append(
            Row(
                table,
                i,
                f.name,
                declared.types.get(f.name, type_name(f.dataType)),
                kind_of(f.dataType),
                *[m[name] for name in COUNTERS],
                done.get(("json", i), 0),
                distinct,
                m["distinct_estimate"],
                m["distinct_sketch"],
                values,
                firsts.get(i, []),
            )
        )
    return df.sparkSession.createDataFrame(rows, METRICS_SCHEMA)


def describe(metrics: DataFrame) -> DataFrame:
    """Turn counters into findings. Works on any number of columns at once."""
    n = F.col("non_null")
    name = F.col("column")
    is_text = (F.col("kind") == "string") & (n > 0)
    is_int = (F.col("kind") == "integer") & (n > 0)
    floats = F.upper("declared_type").rlike("FLOAT|DOUBLE|REAL") & (F.col("kind") == "float") & (n > 0)
    zip_named = P.name_matches(name, rules.ZIP_NAME)
    money_named = P.name_matches(name, rules.MONEY_NAME)
    zeros = F.col("leading_zero") > 0

    def reached(counter: str) -> Column:
        return F.col(counter) >= rules.MATCH_SHARE * n

    def pct(counter: str) -> Column:
        return F.round(100.0 * F.col(counter) / n, 1)

    # (condition, type, confidence, danger); the first that holds is the finding.
    found = [
        (is_text & reached("email"), "email", pct("email"), None),
        (is_text & reached("uuid"), "uuid", pct("uuid"), None),
        (is_text & reached("url"), "url", pct("url"), None),
        (is_text & reached("iso_date"), "date_string", pct("iso_date"), None),
        (is_text & reached("phone"), "phone", pct("phone"), None),
        (
            is_text & reached("digits") & (zeros | zip_named),
            "zip_code",
            pct("digits"),
            "casting to INT loses leading zeros",
        ),
        (is_text & reached("json"), "json_string", pct("json"), None),
        (is_int & reached("epoch_s"), "unix_timestamp", pct("epoch_s"), None),
        (is_int & reached("epoch_ms"), "unix_timestamp", pct("epoch_ms"), None),
        (
            is_int & zip_named,
            "zip_code",
            F.lit(90.0),
            "stored as INT — leading zeros already lost",
        ),
        (
            floats & reached("two_decimals") & (money_named | (F.col("cents") > 0)),
            "currency",
            pct("two_decimals"),
            "FLOAT cannot represent currency exactly — use DECIMAL/NUMERIC in the target",
        ),
    ]
    semantic = F.lit(None).cast("string")
    confidence = F.lit(None).cast("double")
    danger = F.lit(None).cast("string")
    for holds, label, share, risk in reversed(found):
        semantic = F.when(holds, label).otherwise(semantic)
        confidence = F.when(holds, share).otherwise(confidence)
        danger = F.when(holds, F.lit(risk).cast("string")).otherwise(danger)

    formats = F.array_compact(
        F.array(
            *[
                F.when(F.col("date_bits").bitwiseAND(1 << i) > 0, label)
                for i, (_, label) in enumerate(rules.DATE_FORMATS)
            ]
        )
    )
    d = F.col("distinct_count")
    small = (F.col("kind") == "string") & F.coalesce(d.between(1, rules.ENUM_LIMIT - 1), F.lit(False))
    described = metrics.select(
        "table",
        "ordinal",
        "column",
        "declared_type",
        "rows",
        (F.col("rows") - n).alias("nulls"),
        F.when(F.col("rows") == 0, 0.0)
        .otherwise(F.round(100.0 * (F.col("rows") - n) / F.col("rows"), 1))
        .alias("null_pct"),
        "distinct_count",
        "distinct_estimate",
        *(F.when(F.col("distinct_sketch").isNull(), d).otherwise(b).alias(name)
          for name, b in zip(("distinct_low", "distinct_high"), distinct_bounds(F.col("distinct_estimate")))),
        "distinct_sketch",
        ((n > 0) & (F.col("zero_one") == n)).alias("implicit_boolean"),
        F.coalesce(small & (n > d), F.lit(False)).alias("implicit_enum"),
        F.when(small, F.col("enum_values")).alias("enum_values"),
        F.sort_array(formats).alias("date_formats"),
        "sample_values",
        semantic.alias("semantic_type"),
        confidence.alias("confidence_pct"),
        danger.alias("danger"),
    )
    personal = F.coalesce(F.col("semantic_type").isin("email", "phone"), F.lit(False))
    return described.withColumn("pii_suspected", P.is_personal_name(name) | personal).withColumn(
        "evidence",
        F.when(
            F.col("semantic_type").isNotNull(),
            F.concat(
                F.format_string("%.1f", "confidence_pct"),
                F.lit("% of "),
                (F.col("rows") - F.col("nulls")).cast("string"),
                F.lit(" values look like "),
                F.col("semantic_type"),
            ),
        ),
    )


def profile_table(df: DataFrame, table: str, declared: Declared | None = None, **options) -> DataFrame:
    return describe(measure_table(df, table, declared, **options))


def profile_dataset(
    tables: dict[str, DataFrame], declared: dict[str, Declared] | None = None, **options
) -> DataFrame:
    """Profiles of all tables; tables are measured side by side."""
    declared = declared or {}
    with ThreadPoolExecutor(max_workers=4) as pool:
        parts = list(
            pool.map(lambda t: measure_table(tables[t], t, declared.get(t), **options), tables)
        )
    return describe(reduce(DataFrame.unionByName, parts))


def merged_distinct(profiles: DataFrame) -> DataFrame:
    """(table, column, rows, nulls, distinct_estimate, distinct_low, distinct_high, distinct_sketch).

    `profiles` has one row per column and part of a table. Sketches are united, so a value that several
    parts hold counts once; no data is read.
    """
    united = profiles.groupBy("table", "column").agg(
        F.sum("rows").alias("rows"), F.sum("nulls").alias("nulls"),
        F.hll_union_agg("distinct_sketch").alias("distinct_sketch"),
    )
    united = united.withColumn("distinct_estimate", F.hll_sketch_estimate("distinct_sketch"))
    return united.withColumns({
        name: b for name, b in zip(("distinct_low", "distinct_high"), distinct_bounds(F.col("distinct_estimate")))
    })


def personal_columns(profile: DataFrame) -> DataFrame:
    """Columns suspected to hold personal data, with a category."""
    return profile.where("pii_suspected").select(
        "table",
        "column",
        P.personal_category(F.col("column"), F.col("semantic_type")).alias("pii_type"),
    )
