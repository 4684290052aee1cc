"""Tables written by key: buckets that split, filters that never miss, and what a batch opens."""

import datetime

import pytest
from pyspark.sql import functions as F

from tabletrust.operators.mapping import ColumnMap, TableMap
from tabletrust.session import fresh_path
from tabletrust.sources import keyed
from tabletrust.sources.keyed import KeyedTable, Part, write_keyed
from tabletrust.streaming.copy import CopyJob


def _numbers(spark, start, end, text="x"):
    rows = spark.range(start, end, 1, 4)
    return rows.select("id", F.lit(text).alias("v"), F.lit(1).alias("_seq"))


def _table(spark, key="id", **bounds):
    return KeyedTable(spark, fresh_path(spark, "keyed"), key, **bounds)


def test_directory_of_split_leaves():
    assert keyed.directory([1]) == [1]
    assert keyed.split_leaf(1, 1) == [0b10, 0b11] and keyed.split_leaf(0b11, 1) == [0b101, 0b111]
    leaves = [0b10, *keyed.split_leaf(0b11, 2)]
    slots = keyed.directory(leaves)
    assert len(slots) == 8 and set(slots) == set(leaves)
    for slot, leaf in enumerate(slots):
        depth = leaf.bit_length() - 1
        assert slot & ((1 << depth) - 1) == leaf - (1 << depth)


def test_merging_leaves_large_parts_alone():
    parts = [Part(1, f"f{n}", n) for n in (10_000, 3, 2, 5, 900, 8)]
    assert [p.rows for p in keyed.merge_group(parts)] == [2, 3, 5, 8]
    # Over many equal batches, every row is merged a logarithm of times.
    held, moved = [], 0
    for n in range(2_000):
        if len(held) >= keyed.MOST_PARTS:
            group = keyed.merge_group(held)
            moved += sum(p.rows for p in group)
            held = [p for p in held if p not in group] + [Part(1, f"m{n}", sum(p.rows for p in group) + 1)]
        else:
            held.append(Part(1, f"w{n}", 1))
    assert moved < 2_000 * 12 and len(held) <= keyed.MOST_PARTS


@pytest.mark.parametrize("rows", [1_000, 30_000, 300_000])
def test_buckets_stay_bounded(spark, rows):
    table = _table(spark, rows_per_bucket=4_000)
    table.create(_numbers(spark, 0, rows // 2).drop("_seq"))
    assert write_keyed(table, _numbers(spark, rows // 4, rows), "skip", "_seq") == rows - rows // 2
    sizes = {}
    for p in table.parts():
        sizes[p.bucket] = sizes.get(p.bucket, 0) + p.rows
    assert max(sizes.values()) < 1.1 * 4_000 and len(sizes) <= 8 * rows / 4_000 + 1
    assert table.read().count() == table.read().select("id").distinct().count() == table.rows() == rows


def test_buckets_are_bounded_in_bytes(spark):
    table = _table(spark, bytes_per_bucket=50_000)
    long = F.expr("concat(uuid(), uuid(), uuid(), uuid())")
    table.create(_numbers(spark, 0, 500).drop("_seq").withColumn("v", long))
    write_keyed(table, _numbers(spark, 500, 3_000).withColumn("v", long), "skip", "_seq")
    sizes = {}
    for p in table.parts():
        sizes[p.bucket] = sizes.get(p.bucket, 0) + p.bytes
    assert len(sizes) > 4 and max(sizes.values()) < 75_000 and table.rows() == 3_000


def test_reopened_with_other_bounds_and_keys(spark):
    table = _table(spark, rows_per_bucket=1_000)
    table.create(_numbers(spark, 0, 5_000).drop("_seq"))
    again = KeyedTable(spark, table.path, "id", rows_per_bucket=64)
    assert write_keyed(again, _numbers(spark, 0, 5_100), "skip", "_seq") == 100
    assert again.read().count() == again.read().select("id").distinct().count() == 5_100
    assert again.bounds[0] == 1_000
    with pytest.raises(ValueError):
        KeyedTable(spark, table.path, "v").parts()


def _opened(table, monkeypatch):
    """Rows of the parts that writes open, one number per write."""
    opened, read = [], KeyedTable.read_parts

    def spy(self, parts):
        opened.append(sum(p.rows for p in parts))
        return read(self, parts)

    monkeypatch.setattr(KeyedTable, "read_parts", spy)
    return opened


def test_a_thin_batch_opens_only_parts_with_its_keys(spark, monkeypatch):
    table = _table(spark, rows_per_bucket=20_000)
    table.create(_numbers(spark, 0, 200_000).drop("_seq").withColumn("id", F.col("id") * 2))
    assert all(p.filter for p in table.parts())
    opened = _opened(table, monkeypatch)
    # Odd keys lie between the least and the greatest key of every part; only the filters know.
    odd = _numbers(spark, 0, 40).withColumn("id", F.col("id") * 9_999 + 1 - F.col("id") % 2)
    assert odd.where("id % 2 = 0").isEmpty()
    assert write_keyed(table, odd, "skip", "_seq") == 40 and sum(opened) <= 40_000
    opened.clear()
    far = _numbers(spark, 10**6, 10**6 + 40)
    assert write_keyed(table, far, "skip", "_seq") == 40 and sum(opened) < 2_000
    opened.clear()
    one = spark.createDataFrame([(1_234, "new", 1)], "id bigint, v string, _seq int")
    assert write_keyed(table, one, "overwrite", "_seq") == 1 and 0 < opened[0] <= 30_000
    rows = table.read()
    assert rows.count() == table.rows() == 200_080
    assert [r.v for r in rows.where("id = 1234").collect()] == ["new"]


def test_filters_never_miss(spark):
    table = _table(spark, "k", rows_per_bucket=10_000)
    rows = spark.range(30_000).select(F.sha2(F.col("id").cast("string"), 256).alias("k"), "id")
    table.create(rows)
    for residue in range(3):
        batch = rows.where((F.col("id") - residue) % 1_000 == 0).withColumn(keyed.BUCKET, table.bucket())
        counts = keyed.bucket_counts(batch)
        parts = table.parts_with(batch, counts)
        found = table.read_parts(parts).join(batch.select("k"), "k", "left_semi")
        assert found.count() == 30
        assert sum(n * keyed.ROWS_PER_ASKED_KEY < 4_096 for n in counts.values()) == len(counts)


def test_a_replayed_batch_writes_nothing(spark):
    table = _table(spark)
    table.create(_numbers(spark, 0, 100).drop("_seq"))
    before = table.manifest.current_path()
    assert write_keyed(table, _numbers(spark, 10, 60), "skip", "_seq") == 0
    assert table.manifest.current_path() == before


def test_an_unstable_batch_is_read_once(spark):
    table = _table(spark)
    table.create(_numbers(spark, 0, 10).drop("_seq"))
    shaky = spark.range(1_000, numPartitions=4).select(
        F.floor(F.rand() * 1e9).cast("bigint").alias("id"), F.lit("r").alias("v"), F.lit(1).alias("_seq")
    )
    written = write_keyed(table, shaky, "skip", "_seq")
    assert written == table.read().where("v = 'r'").count() == table.rows() - 10


def test_rows_without_a_key_fill_no_bucket(spark):
    table = _table(spark, rows_per_bucket=100)
    rows = _numbers(spark, 0, 5_000).withColumn("id", F.when(F.col("id") % 2 == 0, F.col("id")))
    table.create(rows.drop("_seq").limit(0))
    assert write_keyed(table, rows, "overwrite", "_seq") == 5_000
    assert write_keyed(table, rows, "overwrite", "_seq") == 5_000
    assert table.rows() == 7_500
    assert sum(p.rows for p in table.parts() if p.bucket == keyed.NO_KEY) == 5_000
    assert max(table.leaves()) < 1 << 9


def test_keys_of_other_types(spark):
    day = datetime.date(2024, 1, 1)
    for kind, values in {
        "double": [0.0, -0.0, float("nan"), 1.5], "date": [day, day], "boolean": [True, False],
        "binary": [b"\xff\x00", b"", b"\xff"], "decimal(20,3)": None, "timestamp": None, "string": ["", "a" * 999],
    }.items():
        if values is None:
            rows = spark.range(1, 50).select(F.col("id").cast("int").cast("double").cast(kind).alias("k"))
        else:
            rows = spark.createDataFrame([(v,) for v in values], f"k {kind}")
        rows = rows.withColumn("_seq", F.lit(1))
        table = _table(spark, "k")
        n = write_keyed(table, rows, "skip", "_seq")
        assert n == rows.select("k").distinct().count()
        assert write_keyed(table, rows, "skip", "_seq") == 0 and table.read().count() == n


def test_a_stream_does_not_read_its_target_again(spark, monkeypatch):
    """Batches of one size open about as many rows late as early, while the target grows."""
    monkeypatch.setattr(keyed, "FILTER_ROWS", 64)
    source, base = fresh_path(spark, "in"), fresh_path(spark, "out")
    events = spark.range(20_000).select("id", F.lit("a").alias("v"))
    events.repartitionByRange(20, "id").write.parquet(source)
    mapping = TableMap("events", "copy", (ColumnMap("id", "id"), ColumnMap("v", "v")))
    job = CopyJob(source, events.schema, f"{base}/t", f"{base}/c", mapping, "id",
                  log=f"{base}/log", files_per_batch=1, rows_per_bucket=3_000)
    opened = []
    monkeypatch.setattr(KeyedTable, "parts_with", _counting(KeyedTable.parts_with, opened))
    monkeypatch.setattr(keyed, "ROWS_PER_ASKED_KEY", 0)
    job.run(spark)
    assert job.table(spark).read().count() == 20_000
    # Reading the target again would take over 15,000 rows in each of these batches.
    assert sum(opened[-5:]) <= 6_000
    log = spark.read.parquet(job.log).orderBy("batch").collect()
    assert [r.rows_read for r in log] == [1_000] * 20 or sum(r.rows_read for r in log) == 20_000
    assert max(r.rows_in_target for r in log) == 20_000


def _counting(parts_with, opened):
    def spy(self, rows, counts):
        parts = parts_with(self, rows, counts)
        opened.append(sum(p.rows for p in parts))
        return parts

    return spy


def test_few_rows_are_dealt_to_buckets_by_few_tasks(spark):
    rows = spark.range(0, 5_000, 1, 200)
    most = spark.sparkContext.defaultParallelism
    assert keyed.gathered(rows, 5_000).rdd.getNumPartitions() <= most
    assert keyed.gathered(rows, 100 * keyed.ROWS_PER_TASK).rdd.getNumPartitions() == max(most, 100)
    table = _table(spark, rows_per_bucket=500)
    table.create(rows)
    read = table._held(spark.range(5_000, 10_000, 1, 200))
    counts = keyed.held_counts(read)
    assert sum(counts.values()) == 5_000 and table.write(read, counts) == 5_000
    read.unpersist()
    assert sorted(r.id for r in table.read().collect()) == list(range(10_000))


def test_a_write_goes_through_the_manifest_a_fixed_number_of_times(spark, monkeypatch):
    table = _table(spark, rows_per_bucket=4)
    table.create(spark.range(600).select("id"))
    assert len(table.leaves()) > 100
    parts, asked = KeyedTable.parts, []
    monkeypatch.setattr(KeyedTable, "parts", lambda self: asked.append(1) or parts(self))
    assert table.append(spark.range(600, 1_200).select("id")) == 600
    assert len(asked) < 20
    monkeypatch.undo()
    assert sorted(r.id for r in table.read().collect()) == list(range(1_200))


def test_arriving_files_can_be_read_by_several_tasks(spark):
    from tabletrust.workload import streams

    path = fresh_path(spark, "arriving")
    rows = spark.range(400_000).select("id", F.xxhash64("id").alias("a"), F.xxhash64("id", F.lit(1)).alias("b"))
    streams._split_files(rows, path, 1)
    with_conf = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(streams.ROW_GROUP))
        read = spark.read.parquet(path).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", with_conf)
    assert len(read) > 1 and sum(r["count"] for r in read) == 400_000
