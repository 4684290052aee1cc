"""Run a query on Spark and its SQL on DuckDB; compare columns, types and every value."""

from __future__ import annotations

import math

import duckdb

from tabletrust.workload.scenario import ALL

TYPE_NAMES = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE",
    "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "date": "DATE",
}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in ALL:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9))
    return repr(value)


def rows_of(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(row[i]) for i in order) for row in rows)


def differences(df, con, sql: str) -> list[str]:
    """Empty when both sides agree."""
    rel = con.sql(sql)
    columns, theirs = list(rel.columns), [str(t) for t in rel.types]
    if sorted(columns) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} / {sorted(columns)}"]
    out = []
    ours = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    for name, kind in zip(columns, theirs):
        if TYPE_NAMES.get(ours[name], ours[name]) != kind:
            out.append(f"type of {name}: {ours[name]} / {kind}")
    a = rows_of([tuple(r) for r in df.collect()], df.columns)
    b = rows_of(rel.fetchall(), columns)
    if len(a) != len(b):
        out.append(f"rows {len(a)} / {len(b)}")
    in_a, in_b = set(a), set(b)
    only_a, only_b = [r for r in a if r not in in_b], [r for r in b if r not in in_a]
    if only_a or only_b or a != b:
        out.append(f"{sorted(df.columns)}\n   spark {only_a[:3]}\n   sql   {only_b[:3]}")
    return out
