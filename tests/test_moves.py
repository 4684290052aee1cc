"""Copies: conflict rules, skew, resuming, and what validation says about broken copies."""

import pytest
from pyspark.sql import functions as F

from tabletrust.operators import mapping, reshape, skew, validate
from tabletrust.operators.mapping import ColumnMap, TableMap, table_maps
from tabletrust.plans import migration, upload
from tabletrust.session import fresh_path, shared_dir
from tabletrust.sources import delimited, keyed, sinks, tables
from tabletrust.sources.catalog import Declared, relationship_census
from tabletrust.streaming.copy import CopyJob, RejectedRows


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: [(v is None, v) for v in r])


@pytest.fixture
def target(spark):
    table = keyed.KeyedTable(spark, fresh_path(spark, "target"), "id", rows_per_bucket=8)
    table.create(spark.createDataFrame([(1, "old"), (2, "old")], "id int, v string"))
    return table


NEW = [(2, "first", 1), (2, "last", 2), (3, "first", 3), (3, "last", 4), (None, "nokey", 5)]
NEW_SCHEMA = "id int, v string, _seq int"


def test_skip_keeps_old_and_first(spark, target):
    new = spark.createDataFrame(NEW, NEW_SCHEMA)
    assert keyed.write_keyed(target, new, "skip", "_seq") == 2
    assert _rows(target.read()) == [(1, "old"), (2, "old"), (3, "first"), (None, "nokey")]


def test_overwrite_keeps_last(spark, target):
    new = spark.createDataFrame(NEW[:4], NEW_SCHEMA)
    assert keyed.write_keyed(target, new, "overwrite", "_seq") == 2
    assert _rows(target.read()) == [(1, "old"), (2, "last"), (3, "last")]


def test_fail_refuses_and_changes_nothing(spark, target):
    for rows in (NEW[:1], NEW[2:4]):
        with pytest.raises(sinks.ConflictError):
            new = spark.createDataFrame(rows, NEW_SCHEMA)
            keyed.write_keyed(target, new, "fail", "_seq")
    assert _rows(target.read()) == [(1, "old"), (2, "old")]
    fresh = spark.createDataFrame([(7, "x", 1)], NEW_SCHEMA)
    assert keyed.write_keyed(target, fresh, "fail", "_seq") == 1
    assert target.read().count() == 3


def test_unknown_strategy(spark, target):
    with pytest.raises(ValueError):
        keyed.write_keyed(target, spark.createDataFrame(NEW, NEW_SCHEMA), "merge", "_seq")


def test_unfinished_version_is_not_read(spark, target):
    target.read().write.parquet(f"{target.path}/write=half")
    hadoop = spark._jvm.org.apache.hadoop.fs
    half = hadoop.Path(f"{target.path}/manifest/version=999999999-dead")
    half.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(half)
    assert _rows(target.read()) == [(1, "old"), (2, "old")]


def test_only_touched_buckets_are_read_and_old_files_go(spark, target):
    more = spark.range(40).selectExpr("cast(id + 10 as int) id", "'x' v", "1 _seq")
    assert keyed.write_keyed(target, more, "skip", "_seq") == 40
    one = spark.createDataFrame([(11, "new", 1)], NEW_SCHEMA)
    files = set(target.read(target.touched(one)).inputFiles())
    assert files and files < set(target.read().inputFiles())
    before = set(target.read().inputFiles())
    for _ in range(4):
        assert keyed.write_keyed(target, one, "overwrite", "_seq") == 1
    rows = target.read()
    assert rows.count() == target.rows() == 42 and rows.where("id = 11").first()["v"] == "new"
    assert len(before & set(rows.inputFiles())) >= len(before) - len(files)
    for _ in range(keyed.MOST_PARTS + 2):
        keyed.write_keyed(target, one.withColumn("id", F.lit(None).cast("int")), "skip", "_seq")
    assert target.read().count() == target.rows() == 42 + keyed.MOST_PARTS + 2


def test_one_per_key_limits_before_the_shuffle(spark):
    df = spark.createDataFrame([(1, i) for i in range(1000)] + [(2, 5)], "k int, s int").repartition(4)
    kept = sinks.one_per_key(df, "k", "s", "last")
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert _rows(kept) == [(1, 999), (2, 5)]


# --- skew ----------------------------------------------------------------------------------


def test_join_by_key_with_hot_keys(spark):
    big = spark.range(9000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("v")
    )
    big = big.unionAll(spark.sql("SELECT CAST(NULL AS BIGINT), -1L"))
    small = spark.range(0, 9000, 2).select(F.col("id").alias("k"), (F.col("id") * 10).alias("w"))
    for how in ("inner", "left"):
        plain = _rows(big.join(small, "k", how).fillna(-5))
        assert _rows(skew.join_by_key(big, small, "k", how, rows=100).fillna(-5)) == plain
    assert _rows(skew.heavy_keys(big, "k", rows=100)) == [(0,)]


def test_census_with_a_hub(spark):
    nodes = spark.range(2000).selectExpr("id", "CASE WHEN id = 0 THEN 'hub' ELSE 'leaf' END AS label")
    edges = spark.range(1, 2000).selectExpr("0L AS src", "'has' AS rel", "id AS dst")
    assert _rows(relationship_census(nodes, edges)) == [("hub", "-[:has]->", "leaf", "(node)")]


def test_embedding_a_hot_parent(spark):
    child = spark.range(1000).selectExpr("CASE WHEN id < 700 THEN 1L ELSE id END AS p", "id AS c")
    parent = spark.createDataFrame([(1,), (2,), (701,)], "p bigint")
    got = reshape.embed_children(parent, "p", child, "p", ["c"], per_document=50).collect()
    hot = [r for r in got if r["p"] == 1]
    assert 10 <= len(hot) <= 14
    assert sorted(c["c"] for r in hot for c in r["children"]) == list(range(700))
    assert [(r["p"], len(r["children"])) for r in got if r["p"] != 1] in ([(2, 0), (701, 1)], [(701, 1), (2, 0)])


# --- validation ----------------------------------------------------------------------------

SAYS = {
    "users": Declared(key=("id",)),
    "orders": Declared(key=("id",), foreign_keys=(("user_id", "users", "id"),)),
}


@pytest.fixture(scope="module")
def shop(spark):
    users = spark.range(1, 51).selectExpr(
        "CAST(id AS INT) id", "concat('u', id, '@x.com') email", "CAST(id % 2 AS INT) is_verified"
    )
    orders = spark.range(1, 121).selectExpr(
        "CAST(id AS INT) id", "CAST(id % 50 + 1 AS INT) user_id",
        "CASE WHEN id % 13 = 0 THEN NULL ELSE round(id * 1.5D, 2) END total",
    )
    return {"users": users, "orders": orders}


@pytest.fixture(scope="module")
def copied(spark, shop):
    analysis = migration.analyse(spark, shop, SAYS)
    plan = migration.plan(analysis, "mysql", "postgres")
    maps = table_maps(plan)
    order = migration.order_of(analysis)
    folder = fresh_path(spark, "shop")
    copies = migration.copy_tables(shop, maps, folder, order, declared=SAYS)
    return analysis, plan, maps, order, copies


def test_faithful_copy_scores_100(shop, copied):
    analysis, plan, maps, order, copies = copied
    assert order == ["users", "orders"]
    assert sum(df.count() for df in copies.values()) == 170
    assert {m.transformation for m in maps["users"].columns} == {None, "to_boolean"}
    outcome = migration.final_report(analysis, plan, migration.validate_copy(shop, copies, maps, SAYS))
    overall = outcome.overall.first()
    assert (overall["confidence_score"], overall["passed"], overall["flagged_tables"]) == (100, True, "")
    assert [r["score"] for r in outcome.components.collect()] == [100, 100, 100]
    assert {r["severity"] for r in outcome.flags.collect()} == {"low"}


def test_missing_rows_lower_the_score(shop, copied):
    _, _, maps, _, copies = copied
    broken = {**copies, "orders": copies["orders"].where("id > 10")}
    scores = migration.validate_copy(shop, broken, maps, SAYS)
    row = scores.where("source_table = 'orders'").first()
    assert not row["row_count_ok"] and row["match_ratio"] == round(110 / 120, 3)
    assert row["score"] == pytest.approx(0.6 * 110 / 120 + 0.3 * round(110 / 120, 3) + 0.1)
    overall = validate.overall_score(scores).first()
    assert overall["flagged_tables"] == "orders" and not overall["passed"]


def test_broken_reference_in_the_target(shop, copied):
    _, _, maps, _, copies = copied
    broken = {**copies, "users": copies["users"].where("id <> 7")}
    scores = migration.validate_copy(shop, broken, maps, SAYS)
    assert not scores.where("source_table = 'orders'").first()["fk_ok"]


def test_hashes_see_through_types_and_order(spark):
    source = spark.sql("SELECT 1 id, 86.20D amount, true flag, CAST(NULL AS STRING) note, DATE'2020-01-02' d")
    target = spark.sql(
        "SELECT 1L id, CAST(86.2 AS DECIMAL(9,2)) amount, 1 flag, CAST(NULL AS STRING) note, '2020-01-02' d"
    )
    maps = TableMap("s", "t", tuple(ColumnMap(c, c) for c in source.columns))
    assert validate.compare_hashes(source, target, maps).first()["match_ratio"] == 1.0
    blank = target.withColumn("note", F.lit(""))
    assert validate.compare_hashes(source, blank, maps).first()["match_ratio"] == 0.0


def test_shifted_nulls_differ(spark):
    a = spark.createDataFrame([(None, 1)], "x int, y int")
    b = spark.createDataFrame([(1, None)], "x int, y int")
    maps = TableMap("a", "b", (ColumnMap("x", "x"), ColumnMap("y", "y")))
    assert validate.compare_hashes(a, b, maps).first()["matched"] == 0


def test_rows_are_compared_as_bags(spark):
    a = spark.createDataFrame([(1, "p"), (1, "q"), (2, "p"), (2, "p"), (3, "z"), (5, "n")], "k int, v string")
    b = spark.createDataFrame([(1, "q"), (1, "p"), (2, "q"), (2, "q"), (4, "z"), (5, "n")], "k int, v string")
    got = validate.compare_rows(a, b, ["k"], ["k", "v"])
    assert _rows(got) == [(2, "changed"), (3, "missing"), (4, "extra")]


def test_empty_source(spark):
    empty = spark.createDataFrame([], "id int")
    maps = {"t": TableMap("t", "t", (ColumnMap("id", "id"),))}
    assert validate.compare_hashes(empty, empty, maps["t"]).first()["match_ratio"] == 1.0
    full = spark.createDataFrame([(1,)], "id int")
    assert validate.compare_counts({"t": empty}, {"t": full}, maps).first()["mismatch"] == 1.0


# --- files ---------------------------------------------------------------------------------


def test_delimited(spark, tmp_path):
    path = tmp_path / "u.tsv"
    path.write_text("﻿ id\tok \tn\tmix\tnone\n1\tTRUE\t1.5\t1\tn/a\n\t\t\t\t\n 2 \tfalse\t2\tx\tNULL\n")
    cells = delimited.read_delimited(spark, str(path))
    assert cells.columns == ["id", "ok", "n", "mix", "none"]
    types = {r["column"]: r["canonical_type"] for r in delimited.column_types(cells).collect()}
    assert types == {"id": "bigint", "ok": "boolean", "n": "float", "mix": "string", "none": "string"}
    typed = delimited.typed(cells, types)
    assert sorted(map(str, _rows(typed))) == ["(1, True, 1.5, '1', None)", "(2, False, 2.0, 'x', None)"]


def test_upload_creates_a_table_when_nothing_matches(spark):
    cells = spark.createDataFrame([("1", "2.5", "x"), ("2", None, "y")], "`First No` string, `  ` string, c string")
    columns = spark.createDataFrame([("users", "id")], "table string, column string")
    plan = upload.plan_upload(cells, columns, {"users": {"id": "int"}}, "fresh")
    assert (plan.kind, plan.table) == ("create_and_insert", "fresh")
    assert [(m.target, m.target_type) for m in plan.columns] == [
        ("first_no", "bigint"), ("col_1", "double"), ("c", "string")
    ]
    folder = fresh_path(spark, "uploads")
    assert upload.execute_upload(cells, plan, folder) == 2
    assert _rows(spark.read.parquet(f"{folder}/fresh")) == [(1, 2.5, "x"), (2, None, "y")]


def test_upload_stops_at_a_cell_that_does_not_fit(spark):
    cells = spark.createDataFrame([("1", "a"), ("one", "b")], "ID string, other string")
    columns = spark.createDataFrame([("users", "id")], "table string, column string")
    plan = upload.plan_upload(cells, columns, {"users": {"id": "int"}}, "fresh")
    assert (plan.kind, plan.table, plan.unmapped) == ("insert", "users", ("other",))
    with pytest.raises(upload.BadCells):
        upload.execute_upload(cells, plan, fresh_path(spark, "uploads"))


def test_lookup_and_sample(spark):
    df = spark.range(100).withColumnRenamed("id", "k")
    keys = spark.createDataFrame([(3,), (3,), (500,)], "k bigint")
    assert _rows(tables.rows_by_key(df, "k", keys)) == [(3,)]
    assert tables.seeded_sample(df, 0.5).count() == tables.seeded_sample(df, 0.5).count()
    assert _rows(tables.rows_after(df, "k", 97)) == [(98,), (99,)]


# --- streams -------------------------------------------------------------------------------

COPY = TableMap("t", "t", (ColumnMap("id", "id"), ColumnMap("v", "n", "BIGINT", "to_int")))


def _job(spark, **options):
    base = fresh_path(spark, "job")
    return CopyJob(
        f"{base}/in", spark.createDataFrame([], "id int, v string").schema, f"{base}/out",
        f"{base}/checkpoint", COPY, "id", rejects=f"{base}/rejects", log=f"{base}/log", **options,
    )


def _arrive(spark, job, rows):
    spark.createDataFrame(rows, "id int, v string").write.mode("append").parquet(job.source)


def test_copy_resumes_without_loss_or_repeat(spark):
    job = _job(spark)
    _arrive(spark, job, [(i, str(i)) for i in range(60)])
    job.run(spark)
    _arrive(spark, job, [(i, str(i)) for i in range(50, 120)])
    job.run(spark)
    job.run(spark)
    got = job.table(spark).read()
    assert _rows(got) == [(i, i) for i in range(120)]


def test_batch_run_twice_adds_nothing(spark):
    job = _job(spark)
    batch = spark.createDataFrame([(1, "1"), (2, "x"), (3, "3"), (None, "4")], "id int, v string")
    for _ in range(2):
        job.write_batch(batch, 0)
    assert _rows(job.table(spark).read()) == [(1, 1), (3, 3)]
    assert _rows(spark.read.parquet(job.rejects).select("id", "v")) == [(2, "x"), (None, "4")]


def test_log_of_a_batch_run_twice_counts_once(spark):
    job = _job(spark)
    batch = spark.createDataFrame([(1, "1"), (2, "2")], "id int, v string")
    for _ in range(2):
        job.write_batch(batch, 0)
    log = spark.read.parquet(job.log).collect()
    assert [(r["rows_read"], r["rows_in_target"]) for r in log] == [(2, 2)]


def test_quoted_line_breaks(spark, tmp_path):
    path = tmp_path / "cells.csv"
    path.write_text('a,b\n1,"two\nlines"\n')
    rows = delimited.read_delimited(spark, str(path), multi_line=True).collect()
    assert [tuple(r) for r in rows] == [("1", "two\nlines")]


def test_a_tie_goes_to_the_first_table_of_the_catalog(spark):
    heads = spark.createDataFrame([("f", 0, "id"), ("f", 1, "x")], "upload string, position int, header string")
    columns = spark.createDataFrame([("b", "id"), ("a", "id")], "table string, column string")
    best, _ = mapping.match_header(heads, columns, ["b", "a"])
    assert best.first()["table"] == "b"
    best, _ = mapping.match_header(heads, columns)
    assert best.first()["table"] == "a"


def test_all_targets_missing_is_scored(spark):
    source = {"t": spark.createDataFrame([(1,)], "id int")}
    maps = {"t": TableMap("t", "t2", (ColumnMap("id", "id"),))}
    row = migration.validate_copy(source, {}, maps, {}).first()
    assert (row["match_ratio"], row["target_rows"]) == (0.0, 0)
    assert row["score"] == pytest.approx(0.1)


def test_equal_children_of_a_hot_parent_are_split(spark):
    child = spark.range(40).selectExpr("1L AS p", "'same' AS c")
    parent = spark.createDataFrame([(1,)], "p bigint")
    rows = reshape.embed_children(parent, "p", child, "p", ["c"], per_document=10)
    got = sorted((r["segment"], r["offset"], len(r["children"])) for r in rows.collect())
    assert got == [(i, 10 * i, 10) for i in range(4)]
    items = reshape.child_table(rows, "p", "children").select("position").collect()
    assert sorted(r[0] for r in items) == list(range(40))


def test_fail_fast(spark):
    job = _job(spark, skip_errors=False)
    with pytest.raises(RejectedRows):
        job.write_batch(spark.createDataFrame([(1, "x")], "id int, v string"), 0)


class _Session:
    """A session that names a checkpoint folder, or none, on a given master."""

    def __init__(self, folder, master="yarn"):
        self.conf = {"spark.checkpoint.dir": folder} if folder else {}
        self.sparkContext = self
        self.master = master

    def getCheckpointDir(self):
        return None


def test_shared_dir_is_the_clusters_own():
    assert shared_dir(_Session("hdfs://shared/checkpoints")) == "hdfs://shared/checkpoints"
    with pytest.raises(RuntimeError):
        shared_dir(_Session(None))


def test_quoted_line_breaks_over_many_splits(spark, tmp_path):
    """Cells with breaks, separators and doubled quotes, in files cut into splits of 100 bytes."""
    import csv
    import random

    rnd = random.Random(9)
    words = ["a", "two words", "x,y", 'say "hi"', "line\nbreak", "\n\n", '"', "", 'end"\n,"', "ü", "long " * 40]
    want = []
    for k in range(3):
        rows = [[f"{k}-{i}", rnd.choice(words), rnd.choice(words)] for i in range(200)]
        want += rows
        with open(tmp_path / f"f{k}.csv", "w", newline="") as f:
            writer = csv.writer(f, lineterminator="\n")
            writer.writerows([["id", "text\nbroken", "more"], *rows])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100")
    try:
        got = delimited.read_delimited(spark, str(tmp_path))
        assert got.columns == ["id", "text\nbroken", "more"]
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 100
        got = sorted(tuple(r) for r in got.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    # Spaces at the ends go; nothing else of white space does.
    clean = lambda c: c.strip(" ") or None
    assert [(a, b or None, c or None) for a, b, c in got] == sorted(
        (a, clean(b), clean(c)) for a, b, c in want
    )


def test_stray_quotes_do_not_swallow_lines(spark, tmp_path):
    path = tmp_path / "pipes.csv"
    path.write_text('id,size,note\n1,5" pipe,x\n2,"a\nb",6" pipe\n3,7",y\n')
    rows = sorted(tuple(r) for r in delimited.read_delimited(spark, str(path)).collect())
    assert rows == [("1", '5" pipe', "x"), ("2", "a\nb", '6" pipe'), ("3", '7"', "y")]


def test_quotes_that_do_not_close_are_refused(spark, tmp_path):
    path = tmp_path / "open.csv"
    path.write_text('id,note\n1,"never closed\n2,x\n3,y\n')
    for multi_line in (True, False):
        with pytest.raises(delimited.OpenQuoteError):
            delimited.read_delimited(spark, str(path), multi_line=multi_line)


@pytest.mark.parametrize("window_rows", [0, 100, 10_000])
def test_children_are_numbered_alike_by_window_and_ranges(spark, window_rows):
    child = spark.range(1_500).selectExpr("CASE WHEN id < 900 THEN 1L ELSE 2 + id % 9 END AS p", "id % 700 AS c")
    parent = spark.range(1, 13).selectExpr("id AS p")
    rows = reshape.embed_children(parent, "p", child, "p", ["c"], 40, window_rows)
    got = {(r["p"], r["segment"]): (r["offset"], [c["c"] for c in r["children"]]) for r in rows.collect()}
    data = sorted((r["p"], r["c"]) for r in child.collect())
    want = {}
    for p in range(1, 13):
        own = [c for q, c in data if q == p]
        for k in range(0, max(1, len(own)), 40):
            want[p, k // 40] = (k, own[k : k + 40])
    assert got == want
