"""Load order on Spark, and hidden references of wide tables, against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from tabletrust.operators import peeling, relations
from tabletrust.sources.catalog import Declared


def brute(nodes, links):
    """(level or None, on a cycle) of each node."""
    out = {n: {b for a, b in links if a == n and b != n and b in nodes} for n in nodes}
    level = {}
    while ready := [n for n in nodes if n not in level and out[n] <= level.keys()]:
        level |= {n: max((level[p] + 1 for p in out[n]), default=0) for n in ready}
    cyclic = set()
    for n in nodes:
        seen, ahead = set(), set(out[n])
        while ahead - seen:
            seen |= ahead
            ahead = {q for p in ahead for q in out[p]}
        if n in seen:
            cyclic.add(n)
    return {n: (level.get(n), n in cyclic) for n in nodes}


def order_of(spark, nodes, links):
    tables = spark.createDataFrame([(n,) for n in nodes], "table string")
    fks = spark.createDataFrame(links, "table string, ref_table string")
    return relations.load_order(tables, fks).orderBy("load_position").collect()


@pytest.mark.parametrize("seed, n, m", [(1, 30, 25), (2, 30, 45), (3, 12, 40), (4, 60, 60)])
def test_load_order_of_random_graphs(spark, seed, n, m):
    rnd = random.Random(seed)
    nodes = [f"t{k:02d}" for k in range(n)]
    links = [(rnd.choice(nodes), rnd.choice([*nodes, "elsewhere"])) for _ in range(m)]
    want = brute(set(nodes), links)
    got = order_of(spark, nodes + nodes[:3], links)
    assert {r.table: (None if r.in_cycle else r.level, r.on_cycle) for r in got} == want
    keys = [(r.in_cycle, r.level, r.table) for r in got]
    assert keys == sorted(keys)
    assert [r.load_position for r in got] == list(range(1, n + 1))
    assert [r.drop_position for r in got] == list(range(n, 0, -1))


def test_load_order_of_chains_and_rings(spark):
    """A chain into a ring, a chain out of it, and a long free chain: few rounds, right labels."""
    chain = [(f"c{k:03d}", f"c{k - 1:03d}") for k in range(1, 200)]
    ring = [(f"r{k}", f"r{(k + 1) % 7}") for k in range(7)]
    links = [*chain, *ring, ("above", "r0"), ("top", "above"), ("r3", "c199"), ("self", "self")]
    nodes = sorted({n for link in links for n in link})
    assert {r.table: (None if r.in_cycle else r.level, r.on_cycle)
            for r in order_of(spark, nodes, links)} == brute(set(nodes), links)


def test_load_order_of_nothing(spark):
    assert order_of(spark, [], []) == []
    assert [r.table for r in order_of(spark, ["b", "a"], [])] == ["a", "b"]


def test_chains_take_few_rounds(spark, monkeypatch):
    rounds, step = [], peeling._round
    monkeypatch.setattr(peeling, "_round", lambda *a: rounds.append(1) or step(*a))
    nodes = spark.range(500).select(F.format_string("%04d", "id").alias("node"))
    links = spark.range(1, 500).select(
        F.format_string("%04d", "id").alias("node"), F.format_string("%04d", F.col("id") - 1).alias("to")
    )
    got = peeling.levels(nodes, links)
    assert got.where("cast(node as int) <> level").isEmpty() and len(rounds) <= 12


def test_references_of_dense_columns(spark):
    """Rows dealt out to tables follow the sets of tables, not values times columns times tables."""
    wide = spark.range(3_000).select(
        *(F.when(F.col("id") % 50 > 0, F.col("id") % (100 + 40 * k)).alias(f"c{k}_id") for k in range(12))
    )
    data = {"wide": wide}
    for j in range(6):
        data[f"p{j}"] = spark.range(0, 90 * (j + 1), 1 + j % 2).toDF("k")
    says = {f"p{j}": Declared(key=("k",)) for j in range(6)}
    got = relations.reference_matches(data, says).collect()
    rows = wide.collect()
    held = {f"p{j}": set(range(0, 90 * (j + 1), 1 + j % 2)) for j in range(6)}
    assert len(got) == 72
    for r in got:
        values = [v for row in rows if (v := row[r["column"]]) is not None]
        assert (r["rows"], r["total"]) == (sum(v in held[r["ref_table"]] for v in values), len(values))


def test_values_are_counted_before_they_are_rows(spark, monkeypatch):
    """Many rows of many columns leave a task as a few counts, in whatever steps it counts them."""
    df = spark.sql(
        "SELECT CAST(id % 3 AS INT) AS a_id, IF(id % 2 = 0, NULL, CAST(id % 4 AS STRING)) AS b_id, "
        "id % 5 AS c_id, CAST(NULL AS STRING) AS d_id FROM range(0, 3000, 1, 2)"
    )
    columns = [(4, "a_id", "integer"), (7, "b_id", "string"), (9, "c_id", "integer"), (11, "d_id", "string")]
    want = {("integer", str(v), 4, 1000) for v in range(3)}
    want |= {("string", str(v), 7, 750) for v in (1, 3)}
    want |= {("integer", str(v), 9, 600) for v in range(5)}
    for step in (relations.COUNTED_BYTES, 1):
        monkeypatch.setattr(relations, "COUNTED_BYTES", step)
        found = relations.value_counts(df, columns)
        assert "MapInArrow" in found._jdf.queryExecution().toString()
        assert sorted(map(tuple, found.collect())) == sorted(want)
    assert relations.value_counts(df.limit(0), columns).isEmpty()
