"""Proof that a copy holds what its source holds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabletrust.functions import rules
from tabletrust.functions.hashing import fingerprint, shared_types
from tabletrust.operators.mapping import TableMap, apply_mapping, stored_like
from tabletrust.operators.relations import orphans
from tabletrust.sources.catalog import Declared, row_counts


def compare_counts(
    source: dict[str, DataFrame], target: dict[str, DataFrame], maps: dict[str, TableMap]
) -> DataFrame:
    """Rows on both sides of each mapped table, and whether they agree within 0.1 %."""
    first = next(iter(maps.values()))
    spark = source[first.source_table].sparkSession
    names = spark.createDataFrame(
        [(m.source_table, m.target_table) for m in maps.values()],
        "source_table string, target_table string",
    )
    src = row_counts({m.source_table: source[m.source_table] for m in maps.values()})
    there = {m.target_table: target[m.target_table] for m in maps.values() if m.target_table in target}
    tgt = row_counts(there) if there else spark.createDataFrame([], "table string, rows bigint")
    s, t = F.col("source_rows"), F.col("target_rows")
    mismatch = F.when(s > 0, F.abs(s - t) / s).when(t > 0, 1.0).otherwise(0.0)
    return (
        names.join(
            src.select(F.col("table").alias("source_table"), F.col("rows").alias("source_rows")),
            "source_table",
            "left",
        )
        .join(
            tgt.select(F.col("table").alias("target_table"), F.col("rows").alias("target_rows")),
            "target_table",
            "left",
        )
        .withColumn("target_rows", F.coalesce("target_rows", F.lit(0)))
        .withColumn("mismatch", mismatch)
        .select(
            "source_table",
            "target_table",
            "source_rows",
            "target_rows",
            "mismatch",
            F.round(100 * F.col("mismatch"), 3).alias("mismatch_pct"),
            (F.col("mismatch") <= rules.ROW_COUNT_TOLERANCE).alias("row_count_ok"),
        )
    )


def compare_hashes(
    source: DataFrame,
    target: DataFrame,
    mapping: TableMap,
    raw: bool = False,
    fraction: float | None = None,
    seed: int = 7,
) -> DataFrame:
    """One row: source rows checked, how many occur in the target, and their share.

    Every source row is hashed after the mapping (`raw=True` hashes it before). Both sides are
    grouped by hash in one shuffle; equal rows are combined inside each task, so a row
    repeated very often moves once. `fraction` checks a seeded sample instead.
    """
    names = [m.target for m in mapping.columns]
    if fraction is not None:
        source = source.sample(fraction, seed)
    if raw:
        mapped = source.select(*[F.col(f"`{m.source}`").alias(m.target) for m in mapping.columns])
    else:
        mapped = apply_mapping(source, mapping.columns)
        mapped = stored_like(mapped, target)
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    as_is = shared_types(mapped, target, names)

    def hashed(df: DataFrame, s, t) -> DataFrame:
        h1, h2 = fingerprint(df, names, as_is)
        return df.select(h1.alias("h1"), h2.alias("h2"), s.alias("s"), t.alias("t"))

    both = hashed(mapped, one, none).unionAll(hashed(target, none, one))
    per_hash = both.groupBy("h1", "h2").agg(F.sum("s").alias("s"), F.max("t").alias("t"))
    return per_hash.agg(
        F.coalesce(F.sum("s"), F.lit(0)).alias("checked"),
        F.coalesce(F.sum(F.when(F.col("t") > 0, F.col("s"))), F.lit(0)).alias("matched"),
    ).select(
        F.lit(mapping.source_table).alias("source_table"),
        "checked",
        "matched",
        F.when(F.col("checked") == 0, 1.0)
        .otherwise(F.round(F.col("matched") / F.col("checked"), 3))
        .alias("match_ratio"),
    )


def reference_faults(
    tables: dict[str, DataFrame], references: list[tuple[str, str, str, str]]
) -> DataFrame:
    """(table, column, ref_table, orphans) for each (table, column, ref_table, ref_column)."""
    found = [
        orphans(tables[table], column, tables[ref_table], ref_column)
        .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("orphans"))
        .select(
            F.lit(table).alias("table"),
            F.lit(column).alias("column"),
            F.lit(ref_table).alias("ref_table"),
            "orphans",
        )
        for table, column, ref_table, ref_column in references
    ]
    return reduce(DataFrame.unionAll, found)


def source_references(declared: dict[str, Declared], tables) -> list[tuple[str, str, str, str]]:
    return [
        (t, *fk) for t, d in declared.items() if t in tables for fk in d.foreign_keys if fk[1] in tables
    ]


def target_references(
    declared: dict[str, Declared], maps: dict[str, TableMap]
) -> list[tuple[str, str, str, str]]:
    """Foreign keys under their target names; one with an unmapped end is left out."""
    out = []
    for t, m in maps.items():
        for column, ref_table, ref_column in declared.get(t, Declared()).foreign_keys:
            parent = maps.get(ref_table)
            near = m.target_of(column)
            far = parent.target_of(ref_column) if parent else None
            if near and far:
                out.append((m.target_table, near, parent.target_table, far))
    return out


# A bag of row hashes is summed in three pieces of 21 bits: a sum of bigints that cannot
# overflow below four trillion rows per key.
PIECES = [43, 22, 1]
PIECE_MASK = (1 << 21) - 1


def compare_rows(source: DataFrame, target: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Keys whose rows are `missing` from the target, `extra` in it, or `changed`.

    Both sides are grouped by key in one shuffle: rows per side, and the sum of the source's row
    hashes minus the target's, which is zero for equal bags in any order. The sums are combined
    inside each task, so a key with very many rows stays cheap.
    """
    as_is = shared_types(source, target, columns)

    def side(df: DataFrame, sign: int) -> DataFrame:
        mark, _ = fingerprint(df, columns, as_is)
        pieces = [
            (F.shiftrightunsigned(F.col("mark"), shift).bitwiseAND(PIECE_MASK) * sign).alias(f"p{i}")
            for i, shift in enumerate(PIECES)
        ]
        return df.select(*key, mark.alias("mark")).select(
            *key, F.lit(int(sign > 0)).alias("s"), F.lit(int(sign < 0)).alias("t"), *pieces
        )

    sums = [F.sum(f"p{i}").alias(f"p{i}") for i in range(len(PIECES))]
    per_key = (
        side(source, 1)
        .unionByName(side(target, -1))
        .groupBy(*key)
        .agg(F.sum("s").alias("s"), F.sum("t").alias("t"), *sums)
    )
    s, t = F.col("s"), F.col("t")
    unequal = s != t
    for i in range(len(PIECES)):
        unequal = unequal | (F.col(f"p{i}") != 0)
    label = F.when(t == 0, "missing").when(s == 0, "extra").when(unequal, "changed")
    return per_key.select(*key, label.alias("difference")).where(F.col("difference").isNotNull())


def score_tables(counts: DataFrame, hashes: DataFrame, faults: DataFrame) -> DataFrame:
    """One row per table: counts 60 %, rows 30 %, references 10 %.

    `faults(table, orphans)` is named by source table; a table without references passes. A table
    with rows that has no copy matches in none of them.
    """
    matched = F.coalesce("match_ratio", F.when(F.col("source_rows") > 0, 0.0).otherwise(1.0))
    fk = faults.groupBy(F.col("table").alias("source_table")).agg(F.sum("orphans").alias("orphans"))
    joined = counts.join(
        hashes.select("source_table", "checked", "matched", "match_ratio"), "source_table", "left"
    ).join(fk, "source_table", "left")
    fk_ok = F.coalesce(F.col("orphans"), F.lit(0)) == 0
    count_part = F.when(F.col("row_count_ok"), 0.6).otherwise(
        F.greatest(F.lit(0.0), 0.6 * (1 - F.col("mismatch")))
    )
    return joined.select(
        "source_table",
        "target_table",
        "source_rows",
        "target_rows",
        "mismatch_pct",
        "row_count_ok",
        "checked",
        "matched",
        matched.alias("match_ratio"),
        fk_ok.alias("fk_ok"),
        (
            count_part
            + 0.3 * matched
            + F.when(fk_ok, 0.1).otherwise(0.0)
        ).alias("score"),
    )


def overall_score(tables: DataFrame) -> DataFrame:
    """One row: confidence out of 100, flagged tables, and whether the copy passes."""
    scored = tables.agg(
        F.count(F.lit(1)).alias("tables"),
        F.coalesce(F.round(100 * F.avg("score")), F.lit(0)).cast("int").alias("confidence_score"),
        F.array_join(
            F.sort_array(F.collect_list(F.when(~F.col("row_count_ok"), F.col("source_table")))), ","
        ).alias("flagged_tables"),
    )
    return scored.withColumn(
        "passed", (F.col("flagged_tables") == "") & (F.col("confidence_score") >= 90)
    )


def score_components(tables: DataFrame) -> DataFrame:
    """Three rows: what each check contributes, out of 100."""
    share = F.when(F.col("row_count_ok"), 1.0).otherwise(
        F.greatest(F.lit(0.0), 1 - F.col("mismatch_pct") / 100)
    )
    parts = tables.agg(
        F.round(100 * F.avg(share)).cast("int").alias("counts"),
        F.round(100 * F.avg("match_ratio")).cast("int").alias("rows"),
        F.round(100 * F.avg(F.when(F.col("fk_ok"), 1.0).otherwise(0.0))).cast("int").alias("refs"),
    )
    named = [("Row counts", 60, "counts"), ("Row contents", 30, "rows"), ("References", 10, "refs")]
    return parts.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(label).alias("component"),
                        F.lit(weight).alias("weight"),
                        F.col(column).alias("score"),
                    )
                    for label, weight, column in named
                ]
            )
        )
    )
