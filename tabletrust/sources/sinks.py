"""Writing copies: create, append, replace, and keyed writes with a conflict rule."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabletrust.functions.conversions import adapt


class ConflictError(RuntimeError):
    """A `fail` write met keys that are already there, or met one key twice."""


def adapt_rows(df: DataFrame, family: str) -> DataFrame:
    """Every column in the form the target family's sink accepts."""
    return df.select(
        *[adapt(F.col(f"`{f.name}`"), f.dataType, family).alias(f.name) for f in df.schema.fields]
    )


def create_table(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").parquet(path)


def append_rows(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def replace_table(df: DataFrame, path: str) -> None:
    """A re-run ends with the same rows, never with duplicates."""
    df.write.mode("overwrite").parquet(path)


def one_per_key(new: DataFrame, key: str, sequence: str, keep: str) -> DataFrame:
    """The first or the last row of each key by `sequence`.

    The rank limit is also applied inside each task before the shuffle, so a key repeated
    millions of times sends one row per task.
    """
    order = F.asc(sequence) if keep == "first" else F.desc(sequence)
    rank = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return new.withColumn("_rank", rank).where(F.col("_rank") == 1).drop("_rank")


def skip_existing(old: DataFrame, new: DataFrame, key: str, sequence: str) -> DataFrame:
    """Rows to append: new keys only, the first row of each. Rows without a key never conflict."""
    keyed = one_per_key(new.where(F.col(key).isNotNull()), key, sequence, "first")
    fresh = keyed.join(old.select(key), key, "left_anti")
    return fresh.select(*new.columns).unionByName(new.where(F.col(key).isNull()))


def overwrite_existing(old: DataFrame, new: DataFrame, key: str, sequence: str) -> DataFrame:
    """The whole table afterwards: old rows not replaced, plus the last new row of each key."""
    keyed = one_per_key(new.where(F.col(key).isNotNull()), key, sequence, "last")
    kept = old.join(keyed.select(key), key, "left_anti").select(*old.columns)
    return kept.unionByName(keyed.select(*old.columns)).unionByName(
        new.where(F.col(key).isNull()).select(*old.columns)
    )


def conflicting_keys(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, rows, in_target): keys a `fail` write would refuse."""
    counts = new.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("rows"))
    held = old.select(F.col(key), F.lit(True).alias("held"))
    return (
        counts.join(held, key, "left")
        .withColumn("in_target", F.coalesce("held", F.lit(False)))
        .where(F.col("in_target") | (F.col("rows") > 1))
        .select(key, "rows", "in_target")
    )


class VersionedTable:
    """A Parquet table whose replacement is visible at once.

    A Parquet folder cannot be overwritten while it is read. Each write of the whole table goes
    to a new version folder; a reader takes the newest one Spark marked complete.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path

    def _folders(self, path: str) -> tuple:
        """(file system, path maker, names of the folders in `path`)."""
        make = self.spark._jvm.org.apache.hadoop.fs.Path
        root = make(path)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return fs, make, []
        return fs, make, [s.getPath().getName() for s in fs.listStatus(root) if s.isDirectory()]

    def _versions(self) -> list[str]:
        fs, make, names = self._folders(self.path)
        done = [n for n in names if fs.exists(make(f"{self.path}/{n}/_SUCCESS"))]
        return sorted(n for n in done if n.startswith("version="))

    def expire(self, keep: int) -> list[str]:
        """Delete all complete versions but the last `keep`; returns the paths of those."""
        versions = self._versions()
        fs, make, _ = self._folders(self.path)
        for name in versions[:-keep]:
            fs.delete(make(f"{self.path}/{name}"), True)
        return [f"{self.path}/{name}" for name in versions[-keep:]]

    def drop_others(self, path: str, prefix: str, named: set[str]) -> None:
        """Delete the folders in `path` that start with `prefix` and are not in `named`."""
        fs, make, names = self._folders(path)
        for name in names:
            if name.startswith(prefix) and name not in named:
                fs.delete(make(f"{path}/{name}"), True)

    def exists(self) -> bool:
        return bool(self._versions())

    def holds(self, path: str, name: str) -> bool:
        """Whether the folder `path` has a folder of that name."""
        return name in self._folders(path)[2]

    def current_path(self) -> str:
        return f"{self.path}/{self._versions()[-1]}"

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.current_path())

    def replace(self, df: DataFrame) -> None:
        versions = self._versions()
        number = int(versions[-1].split("=")[1].split("-")[0]) + 1 if versions else 1
        df.write.parquet(f"{self.path}/version={number:09d}-{uuid.uuid4().hex[:8]}")

    def append(self, df: DataFrame) -> None:
        if self.exists():
            append_rows(df, self.current_path())
        else:
            self.replace(df)


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", **options: str) -> None:
    """Rows to a database table, one transaction per partition, in batches."""
    df.write.format("jdbc").mode(mode).options(
        url=url, dbtable=table, batchsize=options.pop("batchsize", "10000"), **options
    ).save()
