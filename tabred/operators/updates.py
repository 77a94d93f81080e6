"""Batches of updates on folded and normalised tables, and what they cost."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window as W, functions as F

from tabred.operators.compare import multiset_difference
from tabred.operators.fold import Layout, all_copies_per_key, digest, digested, fold_root, folded_roots, narrow_layout
from tabred.operators.ranking import exact_quantiles, hash_positions, sample_order, with_quantiles
from tabred.schemas import KEYS, REFERENCES, TABLE_OF, UPDATE_COLUMN, mask_codes

Tables = dict[str, DataFrame]


def update_workload(t: Tables, table: str, count: int, seed: int) -> DataFrame:
    """``count`` updates: the first rows in key order that every incoming reference reaches, used again in turn where
    there are fewer, each with another row's value as its new value: [ordinal, key..., a0, a1].

    The new value is that of the next row in a seeded order of the values, so it always differs and is a value in
    use. Fewer than two values are an error.
    """
    keys, column = list(KEYS[table]), UPDATE_COLUMN[table]
    rows = t[TABLE_OF[table]].select(*keys, F.col(column).alias("a0"))
    for ref in (r for r in REFERENCES if r.target == table):
        used = t[TABLE_OF[ref.source]].select(*[F.col(f).alias(f"_f_{f}") for f in ref.fields])
        same = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_f_{f}") for k, f in zip(keys, ref.fields)])
        rows = rows.join(used, same, "left_semi")
    chosen = rows.where(F.col("a0").isNotNull()).orderBy(*keys).limit(count)
    numbered = chosen.withColumn("place", F.row_number().over(W.orderBy(*keys)))
    values = chosen.select(F.col("a0").alias("value")).distinct().withColumn("rank", F.row_number().over(W.orderBy(sample_order(seed, "value"))))
    sizes = numbered.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("a0").alias("values"))
    enough = F.when(F.col("values") < 2, F.raise_error(F.lit("fewer than two values to exchange"))).otherwise(F.col("rows"))
    items = t[TABLE_OF[table]].sparkSession.range(1, count + 1).join(sizes.select(enough.cast("long").alias("rows"), "values")).select(
        F.col("id").cast("int").alias("ordinal"), (F.pmod(F.col("id") - 1, F.col("rows")) + 1).cast("int").alias("place"), "values")
    follower = values.select(F.col("value").alias("a1"), F.col("rank").alias("next"))
    return (items.join(numbered, "place").join(values, F.col("a0") == F.col("value"))
            .join(follower, F.pmod(F.col("rank"), F.col("values")) + 1 == F.col("next")).select("ordinal", *keys, "a0", "a1"))


def apply_updates(df: DataFrame, updates: DataFrame, locator: dict[str, str], column: str) -> DataFrame:
    """Set ``column`` to ``a1`` on every row whose locator columns equal the update's keys.

    One left join for the whole batch. Whether the batch is broadcast is left to its measured size.
    ``locator`` maps a key of ``updates`` to a column of ``df``.
    """
    batch = updates.select(*[F.col(k).alias(f"_u_{k}") for k in locator], F.col("a1").alias("_a1"))
    same = reduce(lambda a, b: a & b, [F.col(place) == F.col(f"_u_{k}") for k, place in locator.items()])
    return (df.join(batch, same, "left").withColumn(column, F.coalesce("_a1", column)).select(*df.columns))


def apply_to_fold(t: Tables, mask: int, root: str, table: str, updates: DataFrame, layout: Layout | None = None) -> DataFrame:
    """The updates on every place of ``table`` in one fold."""
    codes = mask_codes(mask)
    layout = layout or Layout(root, codes)
    frame = fold_root(t, root, codes, layout)
    for path in layout.places(table):
        frame = apply_updates(frame, updates, dict(zip(KEYS[table], layout.keys(path))), layout.column(path, UPDATE_COLUMN[table]))
    return frame


def apply_to_table(t: Tables, table: str, updates: DataFrame) -> DataFrame:
    """The updates once, on the normalised table."""
    return apply_updates(t[TABLE_OF[table]], updates, {k: k for k in KEYS[table]}, UPDATE_COLUMN[table])


def touched_rows(t: Tables, mask: int, table: str, updates: DataFrame) -> DataFrame:
    """Per update: rows touched on the folded side (all places) and on the normalised side."""
    codes, keys = mask_codes(mask), list(KEYS[table])
    counts = []
    for root in folded_roots(codes):
        layout = Layout(root, codes)
        for path in layout.places(table):
            counts.append(fold_root(t, root, codes).groupBy(*[F.col(layout.column(path, k)).alias(k) for k in keys])
                          .agg(F.count(F.lit(1)).alias("folded"), F.lit(0).cast("long").alias("normalised")))
    counts.append(t[TABLE_OF[table]].groupBy(*keys).agg(F.lit(0).cast("long").alias("folded"), F.count(F.lit(1)).alias("normalised")))
    every = reduce(DataFrame.unionAll, counts).groupBy(*keys).agg(F.sum("folded").alias("folded"), F.sum("normalised").alias("normalised"))
    return updates.join(every, keys).select("ordinal", *keys, "folded", "normalised")


def all_touched_rows(t: Tables, table: str, updates: DataFrame) -> DataFrame:
    """:func:`touched_rows` of every update in all 256 masks: [mask, ordinal, key..., folded, normalised]."""
    keys = list(KEYS[table])
    own = t[TABLE_OF[table]].groupBy(*keys).agg(F.count(F.lit(1)).alias("normalised"))
    every = updates.join(own, keys).withColumn("mask", F.explode(F.sequence(F.lit(0), F.lit((1 << len(REFERENCES)) - 1))))
    return (every.join(all_copies_per_key(t, table), ["mask", *keys], "left")
            .select("mask", "ordinal", *keys, F.coalesce("copies", F.lit(0).cast("long")).alias("folded"), "normalised"))


def check_update(t: Tables, mask: int, root: str, table: str, updates: DataFrame) -> DataFrame:
    """Updating the fold and folding the updated table must agree: number of differing rows.

    Keys, references and the updated column go through both as they are, the other columns of a row as one digest;
    flat rows are compared by the root's key and a digest of the rest.
    """
    codes, kept = mask_codes(mask), (UPDATE_COLUMN[table],)
    narrow, layout = digested(t, kept), narrow_layout(root, codes, kept)
    after = {**narrow, TABLE_OF[table]: apply_to_table(narrow, table, updates)}
    keys = layout.keys(())
    rest = sorted({out for p in layout.paths for out in layout.stored(p).values()} - set(keys))
    compared = [f.select(*keys, digest(rest).alias("_rest")) for f in (
        apply_to_fold(narrow, mask, root, table, updates, layout), fold_root(after, root, codes, layout))]
    return multiset_difference(*compared).agg(F.count(F.lit(1)).alias("differing"))


def partial_update(df: DataFrame, x: str, column: str, row: str, q: float, seed: int, suffix: str) -> DataFrame:
    """Correct ``ceil(q * copies)`` rows of each X group, the first ones in seeded hash order."""
    want = df.groupBy(F.col(x).alias("_x")).agg(F.ceil(F.count(F.lit(1)) * F.lit(q)).alias("_want"))
    placed = hash_positions(df, [x], seed, [row], "_rank").join(want, F.col(x).eqNullSafe(F.col("_x")))
    old = F.col(column).cast("string")
    return placed.withColumn(column, F.when(F.col("_rank") <= F.col("_want"), F.concat(old, F.lit(suffix))).otherwise(old)).select(*df.columns)


def pair_update_times(samples: DataFrame) -> DataFrame:
    """Median over repeats per case and side, their difference, and its spread per group.

    ``samples``: [group, key, side ('folded' or 'normalised'), elapsed_ms].
    """
    of = lambda side: (F.when(F.col("side") == side, F.col("elapsed_ms")), 0.5)
    per_case = exact_quantiles(samples, ["group", "key"], {"folded_ms": of("folded"), "normalised_ms": of("normalised")}).withColumn("saving_ms", F.col("folded_ms") - F.col("normalised_ms"))
    rest = per_case.groupBy("group").agg(F.count(F.lit(1)).alias("cases"), F.min("saving_ms").alias("min_ms"), F.max("saving_ms").alias("max_ms"))
    return with_quantiles(rest, per_case, ["group"], {"median_ms": ("saving_ms", 0.5)}).select("group", "cases", "min_ms", "median_ms", "max_ms")


def break_even(df: DataFrame) -> DataFrame:
    """``kappa``: updates after which normalising pays off; null without a saving. Needs normalization_ms, saving_ms."""
    return df.withColumn("kappa", F.when(F.col("saving_ms") > 0, F.ceil(F.col("normalization_ms") / F.col("saving_ms"))))
