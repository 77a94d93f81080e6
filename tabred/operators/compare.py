"""Comparison of two results: multiset equality with tolerance, result order, key differences."""
from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tabred.operators.ranking import running_totals
from tabred.session import written

# Tolerances for floating-point columns.
REL_TOL, ABS_TOL = 1e-10, 1e-7


def is_close(a: Column, b: Column, rel: float = REL_TOL, abs_: float = ABS_TOL) -> Column:
    """Both null, or both finite and within tolerance."""
    finite = lambda x: ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    near = F.abs(a - b) <= F.greatest(F.lit(rel) * F.greatest(F.abs(a), F.abs(b)), F.lit(abs_))
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(finite(a) & finite(b) & near)


def multiset_counts(a: DataFrame, b: DataFrame) -> DataFrame:
    """Different rows of both sides with their numbers of copies. Copies are counted before the shuffle."""
    cols = a.columns
    sides = (a.select(*cols, F.lit(1).alias("_a"), F.lit(0).alias("_b"))
             .unionAll(b.select(*cols, F.lit(0).alias("_a"), F.lit(1).alias("_b"))))
    return sides.groupBy(*cols).agg(F.sum("_a").alias("left_count"), F.sum("_b").alias("right_count"))


def multiset_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows whose number of copies differs, with both counts."""
    return multiset_counts(a, b).where(F.col("left_count") != F.col("right_count"))


def _cell(value: Column, rel: float, abs_: float) -> Column:
    """Cells of a scale on which values within tolerance lie in the same cell or in neighbours: even up to the size where
    the relative tolerance takes over, logarithmic beyond it."""
    knee = abs_ / rel
    beyond = knee / abs_ + F.log(F.abs(value) / knee) / rel
    place = F.when(F.abs(value) <= knee, F.abs(value) / abs_).otherwise(beyond)
    return F.floor(F.signum(value) * place / 1.01)


def _runs(rows: DataFrame, column: str, rel: float, abs_: float) -> DataFrame:
    """Extend ``bucket`` by the run of occupied cells that a row's value lies in; rows of different runs never match.

    A cell without neighbours is a run of its own, named by itself; only the others are numbered by running totals.
    """
    rows = written(rows.withColumn("_cell", _cell(F.col(column), rel, abs_)))
    places = F.inline(F.array(*[F.struct((F.col("_cell") + step).alias("_cell"), *[F.lit(int(step == at)).alias(name) for at, name in ((0, "_here"), (1, "_follows"), (-1, "_leads"))])
                                for step in (0, 1, -1)]))
    marked = rows.where(F.col("_cell").isNotNull()).select("bucket", places).groupBy("bucket", "_cell").agg(*[F.max(c).alias(c) for c in ("_here", "_follows", "_leads")])
    starts = marked.where("_here = 1 and _follows + _leads > 0").select("bucket", "_cell", (1 - F.col("_follows")).alias("start"))
    runs = running_totals(starts, ["bucket"], "_cell", ["start"]).select("bucket", "_cell", (F.col("start_before") + F.col("start")).alias("_run"))
    named = rows.join(runs, ["bucket", "_cell"], "left")
    alone = F.concat(F.lit("="), F.col("_cell").cast("string"))
    return named.withColumn("bucket", F.concat_ws("/", "bucket", F.coalesce(F.col("_run").cast("string"), alone, F.lit("null")))).drop("_cell", "_run")


def _all_near(low: Column, high: Column, rel: float, abs_: float) -> Column:
    """Whether any two values from ``low`` to ``high`` are within tolerance; both are null where all values are."""
    smallest = F.when(F.signum(low) == F.signum(high), F.least(F.abs(low), F.abs(high))).otherwise(0.0)
    return F.coalesce(high - low <= F.greatest(F.lit(rel) * smallest, F.lit(abs_)), F.lit(True))


def matched_rows(left: list[tuple], right: list[tuple], near) -> int:
    """Rows of a greatest matching between (values, copies) of two sides, where ``near`` says which values may match.

    Copies of equal rows move together along augmenting paths.
    """
    there = [[j for j, (v, _) in enumerate(right) if near(u, v)] for u, _ in left]
    free_left, free_right = [n for _, n in left], [n for _, n in right]
    flow: dict[tuple[int, int], int] = {}
    total = 0
    for start in range(len(left)):
        while free_left[start]:
            came: dict[int, int] = {}                                     # right row: the left row it is reached from
            back: dict[int, int] = {start: -1}                            # left row: the right row it is reached from
            line, end = [start], None
            while line and end is None:
                i = line.pop(0)
                for j in there[i]:
                    if j in came:
                        continue
                    came[j] = i
                    if free_right[j]:
                        end = j
                        break
                    for (k, l), n in flow.items():
                        if l == j and n and k not in back:
                            back[k] = j
                            line.append(k)
            if end is None:
                break
            path, j = [], end
            while j != -1:
                path.append((came[j], j))
                j = back[came[j]]
            most = min([free_left[start], free_right[end], *[flow[i, back[i]] for i, _ in path if back[i] != -1]])
            for i, j in path:
                flow[i, j] = flow.get((i, j), 0) + most
                if back[i] != -1:
                    flow[i, back[i]] -= most
            free_left[start] -= most
            free_right[end] -= most
            total += most
    return total


def compare_results(a: DataFrame, b: DataFrame, rel: float = REL_TOL, abs_: float = ABS_TOL) -> DataFrame:
    """One row: ``equal`` and the number of rows of either side without a partner.

    Rows with equal exact columns are cut into runs of near values, column after column. A run whose rows agree exactly
    is equal. Where a run has one side only, or all its values are near each other, the numbers of rows decide. Any other
    gets a greatest matching, in which an exact partner is no better than a near one. What a task holds is one such run:
    different rows whose values hang together within the tolerance.
    """
    if a.columns != b.columns:
        raise ValueError(f"columns differ: {a.columns} and {b.columns}")
    floats = [n for n, t in a.dtypes if t in ("double", "float")]
    if not floats:
        rest = multiset_difference(a, b)
        return rest.agg(F.count(F.lit(1)).alias("unmatched")).select((F.col("unmatched") == 0).alias("equal"), "unmatched")
    exact = [c for c in a.columns if c not in floats]
    bucket = F.sha2(F.to_json(F.struct(*exact), {"ignoreNullFields": "false"}), 256) if exact else F.lit("")
    names = [f"_{i}" for i in range(len(floats))]
    every = multiset_counts(a, b).select(bucket.alias("bucket"), *[F.col(f).cast("double").alias(n) for f, n in zip(floats, names)], "left_count", "right_count")
    never = reduce(lambda x, y: x | y, [F.coalesce(F.isnan(n) | (F.abs(n) == F.lit(float("inf"))), F.lit(False)) for n in names])
    differs = F.col("left_count") != F.col("right_count")
    rows = every.where(~never).join(every.where(~never & differs).select("bucket").distinct(), "bucket", "left_semi")
    for n in names:
        rows = _runs(rows, n, rel, abs_)
    rows = written(rows)
    sides = rows.groupBy("bucket").agg(F.sum("left_count").alias("left"), F.sum("right_count").alias("right"), F.max(differs).alias("differs"),
                                       *[f(n).alias(f"{n}_{at}") for n in names for f, at in ((F.min, "lo"), (F.max, "hi"))])
    counted = sides.where("differs").withColumn("simple", (F.col("left") == 0) | (F.col("right") == 0) | reduce(
        lambda x, y: x & y, [_all_near(F.col(f"{n}_lo"), F.col(f"{n}_hi"), rel, abs_) for n in names]))
    plain = counted.where("simple").agg(F.coalesce(F.sum(F.abs(F.col("left") - F.col("right"))), F.lit(0)).alias("unmatched"))
    rows = rows.join(counted.where("not simple").select("bucket"), "bucket", "left_semi")

    def near(u: tuple, v: tuple) -> bool:
        return all(x is None and y is None or x is not None and y is not None and abs(x - y) <= max(rel * max(abs(x), abs(y)), abs_) for x, y in zip(u, v))

    def match(run: pd.DataFrame) -> pd.DataFrame:
        values = [tuple(None if pd.isna(x) else float(x) for x in r) for r in run[names].itertuples(index=False)]
        sides = [[(v, int(n)) for v, n in zip(values, run[side]) if n] for side in ("left_count", "right_count")]
        return pd.DataFrame({"unmatched": [sum(n for _, n in sides[0] + sides[1]) - 2 * matched_rows(*sides, near)]})

    alone = every.where(never).agg(F.coalesce(F.sum(F.abs(F.col("left_count") - F.col("right_count"))), F.lit(0)).cast("long").alias("unmatched"))
    both = rows.groupBy("bucket").applyInPandas(match, "unmatched long").unionByName(alone).unionByName(plain)
    return both.agg(F.coalesce(F.sum("unmatched"), F.lit(0)).alias("unmatched")).select((F.col("unmatched") == 0).alias("equal"), "unmatched")


def check_order(df: DataFrame, position: str, fields: list[tuple[str, bool]]) -> DataFrame:
    """Rows that come before their predecessor; ``fields`` are (column, descending), nulls last.

    The predecessor comes by a join on position + 1, so no task has to hold the whole result.
    """
    names = [f for f, _ in fields]
    earlier = df.select((F.col(position) + 1).alias("_at"), *[F.col(n).alias(f"_p_{n}") for n in names])
    wrong: Column = F.lit(False)
    for name, descending in reversed(fields):
        now, before = F.col(name), F.col(f"_p_{name}")
        out_of_order = (now > before) if descending else (now < before)
        # Nulls sort last in the direction of the field.
        falls = (F.when(before.isNull() & now.isNull(), F.lit(False))
                 .when(before.isNull(), F.lit(not descending)).when(now.isNull(), F.lit(descending))
                 .otherwise(out_of_order))
        wrong = falls | (now.eqNullSafe(before) & wrong)
    return df.join(earlier, F.col(position) == F.col("_at")).where(wrong).select(*df.columns)


def diff_keys(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct keys of only one side, marked ``missing`` (only left) or ``extra`` (only right)."""
    a, b = a.distinct(), b.distinct()
    same = reduce(lambda x, y: x & y, [a[c].eqNullSafe(b[c]) for c in a.columns])
    return (a.join(b, same, "left_anti").withColumn("side", F.lit("missing"))
            .unionByName(b.join(a, same, "left_anti").withColumn("side", F.lit("extra"))))


def bounded_count(df: DataFrame, limit: int) -> DataFrame:
    """Exact row count up to ``limit``; beyond it the count is null and ``over_limit`` is true."""
    return (df.limit(limit + 1).agg(F.count(F.lit(1)).alias("n"))
            .select(F.when(F.col("n") <= limit, F.col("n")).alias("rows"), (F.col("n") > limit).alias("over_limit")))


def top_k(df: DataFrame, order: list[tuple[str, bool]], k: int, tie: str) -> DataFrame:
    """First ``k`` rows by (column, descending) fields, with a tie-breaking column added at the end."""
    keys = [F.desc_nulls_last(n) if d else F.asc_nulls_last(n) for n, d in order]
    return df.orderBy(*keys, F.asc_nulls_last(tie)).limit(k)
