"""Key, reference and count checks; edges from reference columns."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def _filled(columns: list[str]) -> Column:
    return _all([F.col(c).isNotNull() for c in columns])


def _text(columns: list[str]) -> Column:
    return F.concat_ws("|", *[F.col(c).cast("string") for c in columns])


def check_primary_key(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that are null or occur twice: [key, problem, rows]. Copies are counted before the shuffle."""
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
            .withColumn("problem", F.when(~_filled(keys), "null key").when(F.col("rows") > 1, "duplicate key"))
            .where(F.col("problem").isNotNull()).select(_text(keys).alias("key"), "problem", "rows"))


def check_foreign_key(child: DataFrame, parent: DataFrame, fk: list[str], pk: list[str]) -> DataFrame:
    """Reference values without a target: [key, rows]. A null reference is no error."""
    used = child.where(_filled(fk)).groupBy(*fk).agg(F.count(F.lit(1)).alias("rows"))
    target = parent.select(*[F.col(k).alias(f"_p_{k}") for k in pk])
    same = _all([F.col(f) == F.col(f"_p_{k}") for f, k in zip(fk, pk)])
    return used.join(target, same, "left_anti").select(_text(fk).alias("key"), "rows")


def check_duplicate_edges(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)


def build_edges(child: DataFrame, parent: DataFrame, key: list[str], fk: list[str], pk: list[str], type_: str) -> DataFrame:
    """[src, dst, type] for every row whose reference has a target; single or composite keys."""
    target = parent.select(*[F.col(k).alias(f"_p_{k}") for k in pk])
    same = _all([F.col(f) == F.col(f"_p_{k}") for f, k in zip(fk, pk)])
    return child.join(target, same, "left_semi").select(_text(key).alias("src"), _text(fk).alias("dst"), F.lit(type_).alias("type"))


def check_out_degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per edge type: sources, edges, and sources that do not have exactly one target.

    ``nodes``: [id, type], one row per type that a node must have; ``edges``: [src, dst, type].
    """
    degree = edges.groupBy(F.col("src").alias("_src"), F.col("type").alias("_type")).agg(F.count(F.lit(1)).alias("_n"))
    return (nodes.join(degree, (F.col("id") == F.col("_src")) & (F.col("type") == F.col("_type")), "left")
            .withColumn("_n", F.coalesce("_n", F.lit(0)))
            .groupBy("type").agg(F.count(F.lit(1)).alias("sources"), F.sum("_n").alias("edges"), F.count(F.when(F.col("_n") != 1, 1)).alias("invalid")))


def reconcile_counts(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """Names whose counts differ or that one side lacks: [name, actual, expected]. Inputs: [name, n]."""
    a = actual.select("name", F.col("n").alias("actual"))
    e = expected.select("name", F.col("n").alias("expected"))
    return a.join(e, "name", "full").where(~F.col("actual").eqNullSafe(F.col("expected")))


def state_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows and non-null cells per table, one pass each: [table, rows, cells]."""
    parts = []
    for name, df in tables.items():
        filled = reduce(lambda x, y: x + y, [F.col(c).isNotNull().cast("long") for c in df.columns])
        parts.append(df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(filled), F.lit(0)).alias("cells"))
                     .select(F.lit(name).alias("table"), "rows", "cells"))
    return reduce(DataFrame.unionAll, parts)
