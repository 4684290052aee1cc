"""Reading tables: whole, after a key, by keys, or a reproducible head."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_KEYS = 1_000_000  # most lookup keys that are sent to every executor


def load_dataset(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{folder}/{name}.parquet") for name in names}


def rows_after(df: DataFrame, key: str, last) -> DataFrame:
    """Rows past a checkpointed key. The filter reaches the scan and skips row groups."""
    return df if last is None else df.where(F.col(key) > F.lit(last))


def head(df: DataFrame, key: list[str], rows: int) -> DataFrame:
    """The first rows in key order: the same rows on every run."""
    return df.orderBy(*key).limit(rows)


def seeded_sample(df: DataFrame, fraction: float, seed: int = 7) -> DataFrame:
    return df.sample(fraction, seed)


def rows_by_key(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """Rows whose key is listed in `keys`. A short list is broadcast, after counting it."""
    wanted = keys.select(key).distinct()
    if wanted.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
        wanted = F.broadcast(wanted)
    return df.join(wanted, key, "left_semi")


def hash_slices(expression: str, parts: int) -> list[str]:
    """Predicates that put every row into exactly one of `parts` slices.

    `expression` is a number in the database's own SQL; rows where it is null are in slice 0.
    """
    return [f"ABS(MOD(COALESCE({expression}, 0), {parts})) = {i}" for i in range(parts)]


def slice_sizes(df: DataFrame, predicates: list[str], sums: list[str]) -> DataFrame:
    """Per slice its rows and the sums of some columns, all in one scan: shows gaps, overlaps and skew."""
    slices = F.array(*(F.when(F.expr(p), F.lit(i)) for i, p in enumerate(predicates)))
    rows = df.select(F.explode(F.array_compact(slices)).alias("slice"), *sums)
    return rows.groupBy("slice").agg(
        F.count(F.lit(1)).alias("rows"), *(F.sum(c).alias(f"{c}_sum") for c in sums)
    )


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    key: str | None = None,
    bounds: tuple[int, int] | None = None,
    partitions: int = 8,
    hash_expression: str | None = None,
    **options: str,
) -> DataFrame:
    """A database table, read in parallel.

    With a numeric key and its bounds the scan is split into key ranges. Without one it is
    split by `hash_expression`, an integer expression in the database's own SQL.
    """
    if hash_expression and not key:
        predicates = hash_slices(hash_expression, partitions)
        return spark.read.jdbc(url, table, predicates=predicates, properties=options)
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if key and bounds:
        reader = reader.options(
            partitionColumn=key,
            lowerBound=str(bounds[0]),
            upperBound=str(bounds[1]),
            numPartitions=str(partitions),
        )
    return reader.load()
