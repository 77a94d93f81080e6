"""Ranks, running totals and expansions that never put one key's rows into one task."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

# Rows of a value bin, about.
BIN_ROWS = 20_000
CHUNK = 4096


def with_value_bins(df: DataFrame, column: str, name: str, bins: int | None = None) -> DataFrame:
    """Add a bin number that grows with ``column``; the bounds are approximate quantiles, so many that a bin has about BIN_ROWS rows.

    A row's bin is found by halving steps through the bounds, not by comparing with each.
    """
    bins = bins or max(2, -(-df.count() // BIN_ROWS))
    steps = [i / bins for i in range(1, bins)]
    bounds = df.agg(F.array_distinct(F.percentile_approx(column, steps, max(1000, 10 * bins))).alias("bounds")).scalar()
    halves = F.array(*[F.lit(1 << i) for i in reversed(range(bins.bit_length()))])
    below = F.aggregate(halves, F.lit(0), lambda at, step: F.when(F.get("_bounds", at + step - 1) < F.col(column), at + step).otherwise(at))
    return (df.withColumn("_bounds", bounds)
            .withColumn(name, F.when(F.col("_bounds").isNull(), 0).otherwise(below)).drop("_bounds"))


def running_totals(df: DataFrame, keys: list[str], order: str, measures: list[str], bins: int | None = None) -> DataFrame:
    """Add ``<m>_before``: the sum of ``m`` over the rows of the same keys with a smaller ``order``.

    ``df`` has one row per (keys, order), for example after an aggregation. A key's rows are split
    into value bins; totals of the earlier bins come from one small row per key and bin.
    """
    binned = with_value_bins(df, order, "_bin", bins)
    spread = [*keys, "_bin"]
    inside = W.partitionBy(*spread).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    earlier = W.partitionBy(*(keys or [F.lit(1)])).orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)
    totals = binned.groupBy(*spread).agg(*[F.sum(m).alias(m) for m in measures])
    offsets = totals.select(*[F.col(k).alias(f"_k_{k}") for k in spread],
                            *[F.coalesce(F.sum(m).over(earlier), F.lit(0)).alias(f"_o_{m}") for m in measures])
    same = F.lit(True)
    for k in spread:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return (binned.join(offsets, same)
            .withColumns({f"{m}_before": F.coalesce(F.sum(m).over(inside), F.lit(0)) + F.col(f"_o_{m}")
                          for m in measures})
            .select(*df.columns, *[f"{m}_before" for m in measures]))


def exact_quantiles(df: DataFrame, keys: list[str], cuts: dict[str, tuple[str | Column, float]]) -> DataFrame:
    """Interpolated quantiles per group: [keys..., one column per cut]; a cut is (value, share). Null values don't count.

    Rows are counted per value before they are moved, the counts get running totals by value bins, and a quantile is
    read off where its rank falls: no task holds a group's values.
    """
    values = [v for v, _ in cuts.values()]
    long = df.select(*keys, F.inline(F.array(*[F.struct(F.lit(i).alias("_m"), (F.col(v) if isinstance(v, str) else v).cast("double").alias("_v")) for i, v in enumerate(values)])))
    counts = long.where(F.col("_v").isNotNull()).groupBy(*keys, "_m", "_v").agg(F.count(F.lit(1)).alias("_n"))
    totals = counts.groupBy(*keys, "_m").agg(F.sum("_n").alias("_all")).withColumnsRenamed({k: f"_t_{k}" for k in [*keys, "_m"]})
    same = F.lit(True)
    for k in [*keys, "_m"]:
        same = same & F.col(k).eqNullSafe(F.col(f"_t_{k}"))
    ranked = running_totals(counts, [*keys, "_m"], "_v", ["_n"]).join(totals, same)
    parts = []
    for i, (name, (_, share)) in enumerate(cuts.items()):
        place = F.lit(share) * (F.col("_all") - 1)
        own = F.col("_m") == i
        at = lambda rank, own=own: F.max(F.when(own & (F.col("_n_before") <= rank) & (rank < F.col("_n_before") + F.col("_n")), F.col("_v")))
        parts += [at(F.floor(place)).alias(f"_lo_{name}"), at(F.ceil(place)).alias(f"_hi_{name}"), F.max(F.when(own, place - F.floor(place))).alias(f"_f_{name}")]
    found = ranked.groupBy(*keys).agg(*parts)
    return found.select(*keys, *[((1 - F.col(f"_f_{n}")) * F.col(f"_lo_{n}") + F.col(f"_f_{n}") * F.col(f"_hi_{n}")).alias(n) for n in cuts])


def with_quantiles(grouped: DataFrame, df: DataFrame, keys: list[str], cuts: dict[str, tuple[str | Column, float]]) -> DataFrame:
    """``grouped`` (one row per keys) with the quantiles of the rows of ``df``; null where a group has no values."""
    found = exact_quantiles(df, keys, cuts).withColumnsRenamed({k: f"_k_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return grouped.join(found, same, "left").drop(*[f"_k_{k}" for k in keys])


def expand_copies(df: DataFrame, count: str, position: str) -> DataFrame:
    """One row per copy, numbered from 1. Copies are made in chunks, so no array grows with the count."""
    starts = F.sequence(F.lit(0), F.floor((F.col(count) - 1) / CHUNK))
    first = F.col("_chunk") * CHUNK + 1
    return (df.where(F.col(count) > 0).withColumn("_chunk", F.explode(starts))
            .withColumn(position, F.explode(F.sequence(first, F.least(first + (CHUNK - 1), F.col(count)))))
            .drop("_chunk"))


def sample_order(seed: int | str, *columns: str | Column) -> Column:
    """Pseudo-random order of rows: the md5 text of seed and key, the same on every run and engine."""
    parts = [F.col(c).cast("string") if isinstance(c, str) else c for c in columns]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *parts))


def hash_positions(df: DataFrame, keys: list[str], seed: int | str, row: list[str], name: str = "position",
                   digits: int = 2) -> DataFrame:
    """Number the rows of each key from 1 in seeded pseudo-random order.

    The order is that of ``sample_order``. Its first hex digits split every key evenly into bins; rows
    are numbered inside a bin, and counts of the earlier bins come from a small row per key and bin.
    """
    marked = df.withColumn("_h", sample_order(seed, *row)).withColumn("_bin", F.substring("_h", 1, digits))
    counts = marked.groupBy(*keys, "_bin").agg(F.count(F.lit(1)).alias("_n"))
    earlier = W.partitionBy(*(keys or [F.lit(1)])).orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(*[F.col(k).alias(f"_k_{k}") for k in [*keys, "_bin"]], F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_o"))
    same = F.col("_bin") == F.col("_k__bin")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    inside = W.partitionBy(*keys, "_bin").orderBy("_h", *row)
    return (marked.join(offsets, same).withColumn(name, F.row_number().over(inside) + F.col("_o"))
            .select(*df.columns, name))
