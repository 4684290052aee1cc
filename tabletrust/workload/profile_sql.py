"""SQL for profiles and the reports on them, written out per column."""

from __future__ import annotations

from tabletrust.functions import rules

# Column kinds of the profiled tables: s text, i integer, f double, b Boolean, o other.
SHAPES = {
    "contacts": (
        "contact_id:i email:s old_email:s phone:s guid:s homepage:s area_code:s postal_text:s "
        "ref_no:s zip_code:i signup_s:i signup_ms:i seen:s joined:s payload:s weak_payload:s "
        "balance:f ratio:f note:s has_credit:n credit_flag:s in_debt:b segment:s fax:s"
    ),
    "orders": "o_orderkey:i o_custkey:i o_orderstatus:s o_totalprice:f o_orderdate:o o_orderpriority:s",
    "customer": "c_custkey:i c_name:s c_nationkey:n c_acctbal:f c_mktsegment:s",
    "labels": "doc_id:i quality:n toxic:n",
    "documents": "doc_id:i text:s lang:s source:s n_chars:i",
    "lineitem": (
        "l_orderkey:i l_partkey:i l_suppkey:i l_linenumber:n l_quantity:f l_extendedprice:f "
        "l_discount:f l_tax:f l_returnflag:s l_linestatus:s l_shipdate:o"
    ),
}
KEYS = {
    "contacts": "contact_id", "orders": "o_orderkey", "customer": "c_custkey",
    "documents": "doc_id", "labels": None, "lineitem": None,
}
NAMES = {"s": "STRING", "i": "BIGINT", "n": "INT", "f": "DOUBLE", "b": "BOOLEAN", "o": "TIMESTAMP_NTZ"}


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def cells(view: str) -> list[tuple[str, str]]:
    return [tuple(cell.split(":")) for cell in SHAPES[view].split()]


def _share(condition: str, c: str) -> str:
    return f"(count(*) FILTER (WHERE {condition}) / nullif(count({c}), 0)::DOUBLE)"


def _matches(c: str, pattern: str) -> str:
    return f"regexp_matches({c}, {quoted(pattern)})"


def _detectors(c: str, kind: str) -> list[tuple[str, str, str, str]]:
    """(condition, type, share, risk) in the order they are tried."""
    out = []
    if kind == "s":
        for name, pattern in [
            ("email", rules.EMAIL),
            ("uuid", rules.UUID),
            ("url", rules.URL),
            ("date_string", rules.ISO_DATE),
        ]:
            out.append(("true", name, _share(_matches(c, pattern), c), "NULL"))
        phone = (
            f"{_matches(c, rules.PHONE)} AND length(regexp_replace({c}, '[^0-9]', '', 'g')) >= 7 "
            f"AND NOT {_matches(c, '^[0-9]+$')}"
        )
        out.append(("true", "phone", _share(phone, c), "NULL"))
        named = "true" if "zip" in c or "postal" in c else f"coalesce(bool_or({c} LIKE '0%'), false)"
        out.append(
            (named, "zip_code", _share(_matches(c, rules.DIGITS_4_10), c),
             quoted("casting to INT loses leading zeros"))
        )
        valid = f"({c} LIKE '{{%' OR {c} LIKE '[%') AND json_valid({c})"
        out.append(("true", "json_string", _share(valid, c), "NULL"))
    if kind in "in":
        for low, high in (rules.EPOCH_SECONDS, rules.EPOCH_MILLIS):
            out.append(
                ("true", "unix_timestamp", _share(f"{c} BETWEEN {low} AND {high}", c), "NULL")
            )
        if "zip" in c or "postal" in c:
            out.append(
                (f"count({c}) > 0", "zip_code", "0.9501",
                 quoted("stored as INT — leading zeros already lost"))
            )
    if kind == "f":
        money = any(w in c for w in ("price", "balance", "total", "cost", "fee", "amount"))
        cents = f"coalesce(bool_or(round({c}, 2) = {c} AND {c} <> floor({c})), false)"
        out.append(
            ("true" if money else cents, "currency", _share(f"round({c}, 2) = {c}", c),
             quoted("FLOAT cannot represent currency exactly — use DECIMAL/NUMERIC in the target"))
        )
    return out


def _chain(c: str, kind: str, pick: int) -> str:
    branches = []
    for condition, name, share, risk in _detectors(c, kind):
        value = (
            quoted(name),
            "90.0" if share == "0.9501" else f"round(100.0 * {share}, 1)",
            risk,
        )[pick]
        branches.append(f"WHEN {condition} AND {share} >= 0.95 THEN {value}")
    empty = "CAST(NULL AS DOUBLE)" if pick == 1 else "CAST(NULL AS VARCHAR)"
    return f"CASE {' '.join(branches)} ELSE {empty} END" if branches else empty


def _formats(c: str) -> str:
    branches = " ".join(
        f"WHEN {_matches(c, pattern)} THEN {quoted(label)}" for pattern, label in rules.DATE_FORMATS
    )
    label = f"CASE {branches} END"
    return f"coalesce(array_to_string(list_sort(list(DISTINCT {label}) FILTER (WHERE {label} IS NOT NULL)), ','), '')"


def column_sql(view: str, i: int, c: str, kind: str, samples: bool = False) -> str:
    small = f"count({c}) > 0 AND count(DISTINCT {c}) < 20"
    flag = {
        "s": f"count({c}) > 0 AND count(*) FILTER (WHERE {c} IN ('0', '1')) = count({c})",
        "b": f"count({c}) > 0",
        "o": "false",
    }.get(kind, f"count({c}) > 0 AND count(*) FILTER (WHERE {c} IN (0, 1)) = count({c})")
    text = kind == "s"
    key = KEYS[view]
    parts = [
        f"{quoted(view)} AS \"table\"",
        f"{i} AS ordinal",
        f"{quoted(c)} AS \"column\"",
        f"{quoted(NAMES[kind])} AS declared_type",
        'count(*) AS "rows"',
        f"count(*) - count({c}) AS nulls",
        f"round(100.0 * (count(*) - count({c})) / count(*), 1) AS null_pct",
        f"count(DISTINCT {c}) AS distinct_count",
        f"{flag} AS implicit_boolean",
        (f"{small} AND count({c}) > count(DISTINCT {c})" if text else "false") + " AS implicit_enum",
        (
            f"CASE WHEN {small} THEN array_to_string(list_sort(list(DISTINCT {c})"
            f" FILTER (WHERE {c} IS NOT NULL)), ',') ELSE '' END"
            if text
            else "''"
        )
        + " AS enum_values",
        (_formats(c) if text else "''") + " AS date_formats",
        f"{_chain(c, kind, 0)} AS semantic_type",
        f"{_chain(c, kind, 1)} AS confidence_pct",
        f"{_chain(c, kind, 2)} AS danger",
        f"regexp_matches({quoted(c)}, {quoted('(?i)' + rules.PII_NAME)}) OR "
        f"coalesce(({_chain(c, kind, 0)}) IN ('email', 'phone'), false) AS pii_suspected",
    ]
    if samples:
        order = key or c
        parts.append(
            f"(SELECT coalesce(string_agg(CAST(v AS VARCHAR), '|' ORDER BY k), '') FROM "
            f"(SELECT {c} AS v, {order} AS k FROM {view} WHERE {c} IS NOT NULL ORDER BY {order} LIMIT 5)) "
            f"AS sample_values"
        )
    return f"SELECT {', '.join(parts)} FROM {view}"


def profile_sql(*views: str, samples: bool = False) -> str:
    return "\nUNION ALL ".join(
        column_sql(view, i, c, kind, samples)
        for view in views
        for i, (c, kind) in enumerate(cells(view))
    )


def facts_sql(views: dict[str, list[str]]) -> str:
    """CTEs `prof` and `facts`; `views` lists each view's NOT NULL columns."""
    strict = ", ".join(f"({quoted(v)}, {quoted(c)})" for v, cs in views.items() for c in cs)
    categories = " ".join(
        f"WHEN regexp_matches(\"column\", {quoted('(?i)' + pattern)}) THEN {quoted(label)}"
        for pattern, label in rules.PII_CATEGORIES
    )
    return f"""
prof AS ({profile_sql(*views)}),
typed AS (SELECT *, ("table", "column") NOT IN ({strict}) AS nullable,
  implicit_boolean AND declared_type <> 'BOOLEAN' AS is_boolean FROM prof),
facts AS (SELECT *, NOT is_boolean AND implicit_enum AS is_enum,
  nullable AND nulls = 0 AND "rows" > 0 AS never_null,
  semantic_type IS NOT NULL AS is_semantic, danger IS NOT NULL AS is_dangerous,
  CASE WHEN pii_suspected THEN
    CASE {categories} ELSE coalesce(semantic_type, 'other') END END AS pii_type,
  CAST(round(100 * least(0.99, 0.5 + "rows" / 2000.0)) AS INT) AS size_confidence,
  CAST(round(100 * least(0.99, least(0.99, 0.5 + "rows" / 2000.0)
    * (0.6 + 0.4 * (1 - distinct_count / "rows"::DOUBLE)))) AS INT) AS enum_confidence
  FROM typed)"""
