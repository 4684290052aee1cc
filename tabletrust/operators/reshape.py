"""Documents to tables and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabletrust.functions import rules
from tabletrust.session import materialize

#: Parents with more children are numbered by ranges over several tasks, others in one window.
WINDOW_ROWS = 100_000


def array_size(df: DataFrame, column: str, key: str) -> DataFrame:
    """One row: average array length per `key` and the shape it calls for.

    A parent that is split into segments counts once, with all of its items.
    """
    average = F.sum(F.size(column)) / F.count_distinct(key)
    return df.agg(average.alias("avg_size")).select(
        F.lit(column).alias("column"),
        F.round("avg_size", 3).alias("avg_size"),
        F.when(F.col("avg_size") > rules.CHILD_TABLE_MIN_AVG, "child_table")
        .otherwise("json_column")
        .alias("shape"),
    )


def child_table(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, position, item fields or `item`): one row per array element.

    Positions count on over the segments of a parent, from the `offset` column if there is one.
    """
    start = F.col("offset") if "offset" in df.columns else F.lit(0).cast("bigint")
    exploded = df.select(key, start.alias("_start"), F.posexplode(column).alias("_at", "item"))
    exploded = exploded.select(key, (F.col("_start") + F.col("_at")).alias("position"), "item")
    item = exploded.schema["item"].dataType
    if hasattr(item, "names"):
        return exploded.select(key, "position", "item.*")
    return exploded


def json_column(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.to_json(column))


def _window_ranked(child: DataFrame, foreign_key: str) -> DataFrame:
    """As `_ranked`, for parents whose children fit in one task."""
    rank = F.row_number().over(Window.partitionBy(foreign_key).orderBy("child")) - 1
    return child.select(foreign_key, "child", rank.cast("bigint").alias("rank"))


def _ranked(child: DataFrame, foreign_key: str) -> DataFrame:
    """Children with `rank`, their place among their parent's children, from 0.

    The children are dealt into ranges of (parent, child), so a parent with very many children is
    spread over tasks, and equal children are told apart by a number. A child's rank is its place in
    its range plus the sizes of the parent's earlier ranges.
    """
    numbered = materialize(
        child.withColumn("_tie", F.monotonically_increasing_id()), "numbered-children"
    )
    ranges = numbered.repartitionByRange(foreign_key, "child", "_tie")
    ranges = materialize(ranges.withColumn("_part", F.spark_partition_id()), "child-ranges")
    earlier = Window.partitionBy(foreign_key).orderBy("_part").rowsBetween(
        Window.unboundedPreceding, -1
    )
    sizes = ranges.groupBy(foreign_key, "_part").agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.select(
        foreign_key, "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start")
    )
    place = F.row_number().over(Window.partitionBy(foreign_key, "_part").orderBy("child", "_tie"))
    return (
        ranges.withColumn("_place", place)
        .join(starts, [foreign_key, "_part"])
        .select(foreign_key, "child", (F.col("_start") + F.col("_place") - 1).alias("rank"))
    )


def embed_children(
    parent: DataFrame,
    key: str,
    child: DataFrame,
    foreign_key: str,
    fields: list[str],
    per_document: int = 10_000,
    window_rows: int = WINDOW_ROWS,
) -> DataFrame:
    """Parents with their children as an array of structs in the order of `fields`.

    Every result row is one (parent, `segment`): the children from `offset` on, at most
    `per_document` of them. Most parents have the one segment 0; a parent without children has an
    empty one. Children without a parent key belong to no document.
    """
    used = child.where(F.col(foreign_key).isNotNull()).select(
        foreign_key, F.struct(*fields).alias("child")
    )
    counts = used.groupBy(foreign_key).agg(F.count(F.lit(1)).alias("n"))
    most = counts.agg(F.max("n")).first()[0] or 0
    segment = F.floor(F.col("rank") / per_document).alias("segment")
    if most <= per_document:
        numbered = used.withColumn("segment", F.lit(0).cast("bigint"))
    elif most <= max(window_rows, per_document):
        numbered = _window_ranked(used, foreign_key).select(foreign_key, "child", segment)
    else:
        large = counts.where(F.col("n") > max(window_rows, per_document)).select(foreign_key)
        large = materialize(large, "large-parents")
        many = _ranked(used.join(large, foreign_key, "left_semi"), foreign_key)
        few = _window_ranked(used.join(large, foreign_key, "left_anti"), foreign_key)
        numbered = few.unionByName(many).select(foreign_key, "child", segment)
    grouped = (
        numbered.groupBy(foreign_key, "segment")
        .agg(F.sort_array(F.collect_list("child")).alias("children"))
        .withColumnRenamed(foreign_key, key)
    )
    children = grouped.schema["children"].dataType
    return (
        parent.join(grouped, key, "left")
        .fillna(0, ["segment"])
        .withColumn("offset", F.col("segment") * per_document)
        .withColumn("children", F.coalesce("children", F.array().cast(children)))
    )
