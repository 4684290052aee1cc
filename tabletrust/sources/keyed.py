"""Tables that are written by key: a write reads and rewrites only the parts that may hold its keys.

Rows lie in buckets by the hash of their key. The buckets are the leaves of a directory that grows by
extendible hashing: a bucket over its bound is split by further bits of the hash, and no other bucket
moves. Each write adds at most one part to a bucket. The manifest holds the directory and, for each
part, its rows, bytes, and least and greatest key; beside the larger parts lies a Bloom filter of
their keys, in blocks of 4 KB that are looked up by join. A batch therefore opens only those
parts that have one of its keys, but for about one part in a thousand per key.

The driver holds the manifest, a line per part; keys and filters stay on the cluster.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DoubleType, FloatType, NumericType, StringType

from tabletrust.sources.sinks import (
    ConflictError,
    VersionedTable,
    conflicting_keys,
    one_per_key,
)

BUCKET = "bucket_of_key"
#: A bucket with more rows or bytes is split by the next write that touches it.
ROWS_PER_BUCKET, BYTES_PER_BUCKET = 1 << 20, 256 << 20
#: Rows that a task at least deals out to buckets, where there are more of them than tasks at once.
ROWS_PER_TASK = 1 << 16
#: With so many parts in a bucket, the next write that touches it merges the small ones.
MOST_PARTS = 16
#: Manifests whose files stay for readers that are still at work.
KEPT_MANIFESTS = 2
#: Bits of a filter block, keys it is made for, and bits set for each key.
BLOCK_BITS, BLOCK_KEYS, KEY_BITS = 1 << 15, 1 << 11, 6
#: Smaller parts have no filter. Larger ones are opened unasked by a batch with at least one key for
#: so many of their rows.
FILTER_ROWS, ROWS_PER_ASKED_KEY = 1 << 12, 16
#: A least or greatest key with a longer text is not kept.
LONGEST_LIMIT = 256
#: The bucket of rows without a key, and the directory of a new table.
NO_KEY, ROOT = 0, 1

_MANIFEST = pa.schema(
    [("key", pa.string()), ("rows_per_bucket", pa.int64()), ("bytes_per_bucket", pa.int64()),
     ("bucket", pa.int64()), ("folder", pa.string()), ("rows", pa.int64()), ("bytes", pa.int64()),
     ("low", pa.string()), ("high", pa.string()), ("filter", pa.bool_())]
)


_ASKED = pa.schema(
    [(BUCKET, pa.int64()), ("folder", pa.string()), ("blocks", pa.int64()), ("low", pa.string()),
     ("high", pa.string())]
)


@dataclass(frozen=True)
class Part:
    """What one write left in one bucket; an empty leaf of the directory has no folder."""

    bucket: int
    folder: str | None = None
    rows: int = 0
    bytes: int = 0
    low: str | None = None
    high: str | None = None
    filter: bool = False


def split_leaf(bucket: int, levels: int) -> list[int]:
    """The leaves under a bucket that is split `levels` times.

    A bucket is a 1 followed by the low bits of the hash that all of its keys share.
    """
    depth = bucket.bit_length() - 1
    shared = bucket - (1 << depth)
    return [1 << depth + levels | more << depth | shared for more in range(1 << levels)]


def directory(leaves: list[int]) -> list[int]:
    """The leaf for each value of as many low hash bits as the deepest leaf has."""
    depth = max(leaves).bit_length() - 1
    out = [0] * (1 << depth)
    for leaf in leaves:
        own = leaf.bit_length() - 1
        for slot in range(leaf - (1 << own), 1 << depth, 1 << own):
            out[slot] = leaf
    return out


def merge_group(parts: list[Part]) -> list[Part]:
    """The small parts of a bucket: each at most twice as large as all smaller ones together.

    A row is merged again only after its part has grown by half, so merging costs a logarithm.
    """
    parts = sorted(parts, key=lambda p: p.rows)
    group, total = parts[:2], sum(p.rows for p in parts[:2])
    for part in parts[2:]:
        if part.rows > 2 * total:
            break
        group, total = [*group, part], total + part.rows
    return group


class KeyedTable:
    """A Parquet table in buckets of its key's hash, for one writer and any number of readers.

    Each write makes one new folder with a subfolder per bucket it touches, then a new manifest
    that says which folders make up each bucket. A reader takes the newest complete manifest, so it
    sees a write whole or not at all. Folders that no kept manifest names are deleted. The bounds
    of a bucket are stored with the table; those given here only matter when it is made.
    """

    def __init__(
        self, spark: SparkSession, path: str, key: str,
        rows_per_bucket: int = ROWS_PER_BUCKET, bytes_per_bucket: int = BYTES_PER_BUCKET,
    ):
        self.spark, self.path, self.key = spark, path, key
        self.bounds = rows_per_bucket, bytes_per_bucket
        self.manifest = VersionedTable(spark, f"{path}/manifest")
        self._known: dict[str, list[Part]] = {}
        self._first: list[Part] | None = None
        self._shape = None

    # --- what the table is ---------------------------------------------------------------

    def exists(self) -> bool:
        return self.manifest.exists()

    def create(self, df: DataFrame) -> None:
        df.limit(0).write.mode("overwrite").parquet(f"{self.path}/shape")
        self._shape, self._known = df.schema, {}
        self._first = [Part(ROOT)]
        rows = self._held(df)
        try:
            if not self.write(rows, held_counts(rows)):
                self._commit(self._first)
        finally:
            rows.unpersist()

    def parts(self) -> list[Part]:
        """The newest manifest; read once, as manifests do not change."""
        if self._first:
            return self._first
        path = self.manifest.current_path()
        if path not in self._known:
            lines = self.spark.read.parquet(path).collect()
            if lines[0].key != self.key:
                raise ValueError(f"the table at {self.path} is written by {lines[0].key}")
            self.bounds = lines[0].rows_per_bucket, lines[0].bytes_per_bucket
            names = Part.__dataclass_fields__
            self._known[path] = [Part(**{n: line[n] for n in names}) for line in lines]
        return self._known[path]

    def leaves(self) -> list[int]:
        return sorted({p.bucket for p in self.parts()} - {NO_KEY})

    def rows(self) -> int:
        """Rows of the table, by the manifest."""
        return sum(p.rows for p in self.parts())

    def schema(self):
        if self._shape is None:
            self._shape = self.spark.read.parquet(f"{self.path}/shape").schema
        return self._shape

    def _ordered(self) -> bool:
        """Whether keys of this type can be compared through the text in the manifest."""
        return isinstance(self.schema()[self.key].dataType, (NumericType, StringType, DateType))

    def _hash(self, *more: str) -> Column:
        """64 bits of the key; equal keys of one type have equal bits."""
        key = F.col(self.key)
        if isinstance(self.schema()[self.key].dataType, (FloatType, DoubleType)):
            key = key + F.lit(0.0)  # -0.0 equals 0.0
        return F.xxhash64(key.cast("string"), *map(F.lit, more))

    def bucket(self, leaves: list[int] | None = None) -> Column:
        """The bucket of each row. The directory is one constant text, a number per slot."""
        slots = directory(leaves or self.leaves())
        known = F.split(F.lit(",".join(map(str, slots))), ",")
        slot = self._hash().bitwiseAND(len(slots) - 1) + 1
        leaf = F.element_at(known, slot.cast("int")).cast("bigint")
        return F.when(F.col(self.key).isNull(), F.lit(NO_KEY).cast("bigint")).otherwise(leaf)

    def touched(self, df: DataFrame) -> list[int]:
        """Buckets of the keys of `df`; at most as many numbers as the table has buckets."""
        return sorted(r[0] for r in df.select(self.bucket()).distinct().collect())

    # --- reading -------------------------------------------------------------------------

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        wanted = None if buckets is None else set(buckets)
        return self.read_parts([p for p in self.parts() if wanted is None or p.bucket in wanted])

    def read_parts(self, parts: list[Part]) -> DataFrame:
        paths = [f"{self.path}/{p.folder}/{BUCKET}={p.bucket}" for p in parts if p.folder]
        if not paths:
            return self.spark.createDataFrame([], self.schema())
        return self.spark.read.schema(self.schema()).parquet(*paths)

    def parts_with(self, rows: DataFrame, counts: dict[int, int]) -> list[Part]:
        """Parts that may hold keys of `rows`, which have their bucket as BUCKET; no other part does.

        `counts` are the rows in each bucket. Parts with a filter are asked only where the batch is
        thin; the others are named by their bucket.
        """
        own = [p for p in self.parts() if p.folder and p.bucket in counts and p.bucket != NO_KEY]
        asked = {p for p in own if p.filter and counts[p.bucket] * ROWS_PER_ASKED_KEY < p.rows}
        if not asked:
            return own
        kind = self.schema()[self.key].dataType
        lines = [{BUCKET: p.bucket, "blocks": _blocks(p.rows)} | vars(p) for p in asked]
        lines = self.spark.createDataFrame(pa.Table.from_pylist(lines, _ASKED))
        within = F.lit(True)
        if self._ordered():
            key, low, high = F.col(self.key), F.col("low").cast(kind), F.col("high").cast(kind)
            within = (low.isNull() | (key >= low)) & (high.isNull() | (key <= high))
        keys = rows.select(BUCKET, self.key).join(lines, BUCKET).where(within)
        keys = keys.select(BUCKET, "folder", self._block(), *self._places())
        paths = [f"{self.path}/{_filters(folder)}" for folder in sorted({p.folder for p in asked})]
        buckets = sorted({p.bucket for p in asked})
        filters = self.spark.read.parquet(*paths).where(F.col(BUCKET).isin(buckets))
        found = keys.join(filters, [BUCKET, "folder", "block"]).where(_all_set())
        hits = {tuple(r) for r in found.select(BUCKET, "folder").distinct().collect()}
        return [p for p in own if p not in asked or (p.bucket, p.folder) in hits]

    # --- writing -------------------------------------------------------------------------

    def append(self, df: DataFrame) -> int:
        """Add rows; returns how many."""
        rows = self._held(df)
        try:
            return self.write(rows, held_counts(rows))
        finally:
            rows.unpersist()

    def _held(self, df: DataFrame) -> DataFrame:
        """The rows with their buckets, evaluated once."""
        return df.withColumn(BUCKET, self.bucket()).persist(StorageLevel.MEMORY_AND_DISK)

    def write(self, rows: DataFrame, counts: dict[int, int], replaced: list[Part] = ()) -> int:
        """Write `rows`, of which `counts` says how many fall in each bucket, and drop `replaced`.

        Returns the rows written, without those of parts that only move to other buckets or are
        merged on the way.
        """
        if not counts and not replaced:
            return 0
        gone = set(replaced)
        moved: list[Part] = []
        leaves = set(self.leaves())
        held: dict[int, list[Part]] = {}
        for p in self.parts():
            if p.folder and p not in gone:
                held.setdefault(p.bucket, []).append(p)
        per_row = _bytes_per_row(self.parts())
        for bucket, n in counts.items():
            own = held.get(bucket, [])
            levels = self._levels(bucket, own, n, per_row)
            if levels:
                leaves.discard(bucket)
                leaves.update(split_leaf(bucket, levels))
                moved += own
            elif len(own) >= MOST_PARTS:
                moved += merge_group(own)
        leaves = sorted(leaves)
        rows = gathered(rows, sum(counts.values()))
        if moved:
            rows = rows.drop(BUCKET).unionByName(self.read_parts(moved))
        gone.update(moved)
        kept = [p for p in self.parts() if p not in gone and p.folder]
        new = self._write_parts(rows.withColumn(BUCKET, self.bucket(leaves)))
        used = {p.bucket for p in (*kept, *new)}
        self._commit([*kept, *new, *(Part(b) for b in leaves if b not in used)])
        return sum(p.rows for p in new) - sum(p.rows for p in moved)

    def _levels(self, bucket: int, parts: list[Part], n: int, per_row: float) -> int:
        """How many times a bucket must be split to take `n` more rows; an empty one's take `per_row`."""
        if bucket == NO_KEY:
            return 0
        rows = n + sum(p.rows for p in parts)
        per_row = _bytes_per_row(parts) if parts else per_row
        most_rows, most_bytes = self.bounds
        return max(0, math.ceil(math.log2(max(1, rows / most_rows, rows * per_row / most_bytes))))

    def _write_parts(self, rows: DataFrame) -> list[Part]:
        folder = f"write={uuid.uuid4().hex}"
        path = f"{self.path}/{folder}"
        # A bucket that is too large for a task, as that of the keyless may be, is dealt to several.
        rows.hint("rebalance", F.col(BUCKET)).write.partitionBy(BUCKET).parquet(path)
        schema = f"`{self.key}` {self.schema()[self.key].dataType.simpleString()}, {BUCKET} bigint"
        written = self.spark.read.schema(schema).parquet(path)
        key = F.col(self.key) if self._ordered() else F.lit(None).cast("string")
        limits = [F.min(key).alias("low"), F.max(key).alias("high")]
        files = written.select("*", "_metadata.file_path", "_metadata.file_size")
        files = files.groupBy(BUCKET, "file_path", "file_size").agg(F.count(F.lit(1)).alias("rows"), *limits)
        text = lambda c: F.when(F.char_length(c) <= LONGEST_LIMIT, c)
        stats = files.groupBy(BUCKET).agg(
            F.sum("rows").alias("rows"), F.sum("file_size").alias("bytes"),
            text(F.min("low").cast("string")).alias("low"),
            text(F.max("high").cast("string")).alias("high"),
        )
        parts = [
            Part(r[BUCKET], folder, r["rows"], r["bytes"], r["low"], r["high"]) for r in stats.collect()
        ]
        large = {p for p in parts if p.rows >= FILTER_ROWS and p.bucket != NO_KEY}
        if large:
            self._write_filters(written, folder, sorted(large, key=lambda p: p.bucket))
        return [replace(p, filter=p in large) for p in parts]

    # --- filters -------------------------------------------------------------------------

    def _block(self) -> Column:
        return F.pmod(self._hash("block"), F.col("blocks")).alias("block")

    def _places(self) -> list[Column]:
        """The bits of a key in its block, of 15 hash bits each."""
        first, second = self._hash("bits"), self._hash("more")
        each = [(first, 15 * k) for k in range(4)] + [(second, 15 * k) for k in range(KEY_BITS - 4)]
        return [
            F.shiftrightunsigned(h, by).bitwiseAND(BLOCK_BITS - 1).alias(f"place{k}")
            for k, (h, by) in enumerate(each)
        ]

    def _write_filters(self, written: DataFrame, folder: str, parts: list[Part]) -> None:
        blocks = {BUCKET: [p.bucket for p in parts], "blocks": [_blocks(p.rows) for p in parts]}
        blocks = self.spark.createDataFrame(pa.table(blocks))
        places = F.explode(F.array(*self._places())).alias("place")
        rows = written.join(blocks, BUCKET).select(BUCKET, self._block(), places)
        filters = rows.groupBy(BUCKET, "block").agg(F.bitmap_construct_agg("place").alias("bits"))
        filters = filters.withColumn("folder", F.lit(folder))
        filters.repartition(BUCKET).sortWithinPartitions(BUCKET, "block").write.parquet(
            f"{self.path}/{_filters(folder)}"
        )

    # --- manifest ------------------------------------------------------------------------

    def _commit(self, parts: list[Part]) -> None:
        bounds = dict(zip(("rows_per_bucket", "bytes_per_bucket"), self.bounds))
        lines = [{"key": self.key} | bounds | vars(p) for p in parts]
        lines = pa.Table.from_pylist(lines, _MANIFEST)
        self.manifest.replace(self.spark.createDataFrame(lines).coalesce(1))
        self._first = None
        self._known[self.manifest.current_path()] = parts
        kept = self.manifest.expire(KEPT_MANIFESTS)
        named = set()
        for path in kept:
            if path not in self._known:
                lines = self.spark.read.parquet(path).select("folder").collect()
                named |= {r.folder for r in lines}
        self._known = {path: self._known[path] for path in kept if path in self._known}
        named |= {p.folder for known in self._known.values() for p in known}
        named |= {_filters(folder) for folder in named if folder}
        self.manifest.drop_others(self.path, "write=", named)


def _filters(folder: str) -> str:
    """The folder of the filters that belong to the parts in a folder."""
    return f"{folder}.filters"


def _blocks(rows: int) -> int:
    return -(-rows // BLOCK_KEYS)


def _all_set() -> Column:
    """Whether a block has all bits of the key beside it."""
    out = F.lit(True)
    for k in range(KEY_BITS):
        place = F.col(f"place{k}")
        byte = F.col("bits").substr((F.shiftright(place, 3) + 1).cast("int"), F.lit(1))
        value = F.conv(F.hex(byte), 16, 10).cast("bigint")
        out = out & (F.getbit(value, place.bitwiseAND(7).cast("int")) == 1)
    return out


def _bytes_per_row(parts: list[Part]) -> float:
    return sum(p.bytes for p in parts) / max(1, sum(p.rows for p in parts))


def gathered(rows: DataFrame, n: int) -> DataFrame:
    """The `n` rows in no more partitions than they need.

    A shuffle by bucket sends something from nearly every partition to every other, so its small
    blocks grow with the square of the partitions, however few rows each has.
    """
    parallel = rows.sparkSession.sparkContext.defaultParallelism
    return rows.coalesce(max(1, parallel, -(-n // ROWS_PER_TASK)))


def held_counts(rows: DataFrame) -> dict[int, int]:
    """The counts of held rows, which a first job evaluates in all their partitions."""
    return bucket_counts(gathered(rows, rows.count()))


def bucket_counts(rows: DataFrame) -> dict[int, int]:
    """Rows in each bucket; at most as many numbers as the table has buckets."""
    return {r[0]: r[1] for r in rows.groupBy(BUCKET).agg(F.count(F.lit(1))).collect()}


def write_keyed(table: KeyedTable, new: DataFrame, strategy: str, sequence: str) -> int:
    """Write `new` under `fail`, `skip` or `overwrite`; returns the rows written.

    `new` is evaluated once. Only parts that may hold its keys are read, and only those rewritten.
    `sequence` is a column of `new` that says which of two rows with one key came first; it is not
    stored unless the table has it. Rows without a key never conflict. A batch that brings nothing
    new writes nothing.
    """
    if strategy not in ("fail", "skip", "overwrite"):
        raise ValueError(f"unknown conflict strategy {strategy!r}")
    if not table.exists():
        table.create(new.limit(0).drop(*([sequence] if sequence.startswith("_") else [])))
    key, columns = table.key, table.schema().names
    if strategy != "fail":
        known = new.where(F.col(key).isNotNull())
        known = one_per_key(known, key, sequence, "first" if strategy == "skip" else "last")
        new = known.unionByName(new.where(F.col(key).isNull()))
    rows = table._held(new.select(*columns))
    held = [rows]
    try:
        counts = held_counts(rows)
        parts = table.parts_with(rows, counts)
        old = table.read_parts(parts)
        if strategy == "fail":
            if not conflicting_keys(old, rows, key).isEmpty():
                raise ConflictError(f"rows with an existing or repeated {key}")
            return table.write(rows, counts)
        keyed = rows.where(F.col(key).isNotNull()).select(key)
        if strategy == "overwrite":
            kept = old.join(keyed, key, "left_anti").select(*columns)
            whole = rows.select(*columns).unionByName(kept).withColumn(BUCKET, table.bucket())
            # At most so many rows are in each bucket afterwards.
            most = dict(counts)
            for p in parts:
                most[p.bucket] += p.rows
            table.write(whole, most, parts)
            return sum(counts.values())
        if parts:
            # A row without a key has no equal among the old keys and stays.
            rows = rows.join(old.select(key), key, "left_anti").select(*rows.columns)
            held.append(rows.persist(StorageLevel.MEMORY_AND_DISK))
            counts = held_counts(rows)
        return table.write(rows, counts)
    finally:
        for df in held:
            df.unpersist()
