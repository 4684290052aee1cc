"""Joins that hold up when a few keys carry most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabletrust.session import materialize

HEAVY_SHARE = 0.001
HEAVY_ROWS = 100_000


def heavy_keys(
    big: DataFrame, key: str, share: float = HEAVY_SHARE, rows: int = HEAVY_ROWS
) -> DataFrame:
    """Keys with more than `share` of all rows, and more than `rows`.

    There can be at most 1/share of them, whatever the data. The count reads the key alone
    and is combined inside each task.
    """
    counts = big.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    total = big.agg(F.count(F.lit(1)).alias("t"))
    least = F.greatest(F.lit(float(rows)), total.scalar() * F.lit(share))
    return counts.where(F.col("n") > least).select(key)


def join_by_key(
    big: DataFrame, small: DataFrame, key: str, how: str = "inner", rows: int = HEAVY_ROWS
) -> DataFrame:
    """`big` joined to `small`, which holds each key once, without moving heavy keys.

    The heavy keys are found first. Without any this is a plain join. Otherwise their rows stay
    where they are and meet a broadcast of at most 1/HEAVY_SHARE rows, while all other rows
    are shuffled as usual. `how` is inner or left; rows with a null key stay out of the join.
    """
    heavy = materialize(heavy_keys(big, key, rows=rows), "heavy-keys")
    keyless = None
    if how == "left":
        # A null key matches nothing, but a join would send all of its rows to one task.
        added = [c for c in small.columns if c != key]
        kinds = small.schema
        keyless = big.where(F.col(key).isNull()).select(
            "*", *(F.lit(None).cast(kinds[c].dataType).alias(c) for c in added)
        )
    big = big.where(F.col(key).isNotNull())
    if heavy.isEmpty():
        out = big.join(small, key, how)
    else:
        heavy = F.broadcast(heavy)
        heavy_small = F.broadcast(small.join(heavy, key, "left_semi"))
        out = big.join(heavy, key, "left_semi").join(heavy_small, key, how)
        out = out.unionByName(big.join(heavy, key, "left_anti").join(small, key, how))
    return out if keyless is None else out.unionByName(keyless)
