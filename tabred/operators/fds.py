"""Functional dependencies: checking, valid groups, redundancy, discovery, splitting."""
from __future__ import annotations

from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame, functions as F

from tabred.session import written

# Evidence thresholds of the discovery.
MIN_SUPPORT, MIN_COVERAGE, MIN_REPEATED = 20, 0.2, 3
# One of so many values of X is looked at first, with all its rows.
REFUTED_ON = 64


def _both(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def _filled(column: str, dtype: str, empty_is_missing: bool) -> Column:
    present = F.col(column).isNotNull()
    return present & (F.col(column) != "") if empty_is_missing and dtype == "string" else present


def check_fd(df: DataFrame, x: list[str], ys: list[str]) -> DataFrame:
    """Groups of X that hold two values of some Y: [x..., rows].

    Smallest and largest value decide, so the aggregate combines before the shuffle and stays constant
    in size however large a group is.
    """
    rows = df.where(_both([F.col(c).isNotNull() for c in x]))
    broken = reduce(lambda a, b: a | b, [F.col(f"_lo_{y}") != F.col(f"_hi_{y}") for y in ys])
    return (rows.groupBy(*x).agg(F.count(F.lit(1)).alias("rows"), *[F.min(y).alias(f"_lo_{y}") for y in ys],
                                 *[F.max(y).alias(f"_hi_{y}") for y in ys])
            .where(broken).select(*x, "rows"))


def group_states(df: DataFrame, x: str, ys: list[str], empty_is_missing: bool = True) -> DataFrame:
    """Per value of X: [key, fanout, complete, low, high]; low and high are the extreme Y tuples of complete rows."""
    types = dict(df.dtypes)
    complete = _both([_filled(y, types[y], empty_is_missing) for y in ys])
    tuple_ = F.when(complete, F.struct(*ys))
    return (df.where(_filled(x, types[x], empty_is_missing)).groupBy(F.col(x).alias("key"))
            .agg(F.count(F.lit(1)).alias("fanout"), F.count(tuple_).alias("complete"),
                 F.min(tuple_).alias("low"), F.max(tuple_).alias("high")))


def _valid(min_fanout: int) -> Column:
    return ((F.col("fanout") >= min_fanout) & (F.col("complete") == F.col("fanout")) & (F.col("low") == F.col("high")))


def valid_groups(df: DataFrame, x: str, ys: list[str], min_fanout: int = 2, empty_is_missing: bool = True) -> DataFrame:
    """Groups with enough rows, all Y filled, and one Y tuple: [key, rhs, fanout]."""
    return (group_states(df, x, ys, empty_is_missing).where(_valid(min_fanout))
            .select("key", F.col("low").alias("rhs"), "fanout"))


def fd_summary(df: DataFrame, x: str, ys: list[str], min_fanout: int = 2, empty_is_missing: bool = True) -> DataFrame:
    """One row: groups, rows, valid groups and rows, conflicting and incomplete groups."""
    ok, one = _valid(min_fanout), F.lit(1)
    return group_states(df, x, ys, empty_is_missing).agg(
        F.count(one).alias("groups"), F.sum("fanout").alias("rows"), F.count(F.when(ok, one)).alias("valid_groups"),
        F.coalesce(F.sum(F.when(ok, F.col("fanout"))), F.lit(0)).alias("valid_rows"),
        F.count(F.when(F.col("low") != F.col("high"), one)).alias("conflicting_groups"),
        F.count(F.when(F.col("complete") < F.col("fanout"), one)).alias("incomplete_groups"))


def redundancy(df: DataFrame, x: str, ys: list[str], min_fanout: int = 2, empty_is_missing: bool = True) -> DataFrame:
    """Dependent values stored more than once in valid groups."""
    return valid_groups(df, x, ys, min_fanout, empty_is_missing).agg(
        F.count(F.lit(1)).alias("groups"),
        (F.coalesce(F.sum(F.col("fanout") - 1), F.lit(0)) * len(ys)).alias("redundant_values"))


def split_by_fd(df: DataFrame, x: str, ys: list[str], min_fanout: int = 2, empty_is_missing: bool = True) -> tuple[DataFrame, DataFrame]:
    """(fact, dimension): valid groups move to the dimension, rows of other groups keep their values."""
    groups = valid_groups(df, x, ys, min_fanout, empty_is_missing)
    dim = groups.select(F.col("key").alias(x), "rhs.*")
    moved = groups.select(F.col("key").alias("_key"))
    keep = lambda c: F.when(F.col("_key").isNull(), F.col(c)).alias(c)
    fact = df.join(moved, F.col(x) == F.col("_key"), "left").select(
        *[c for c in df.columns if c != x and c not in ys], keep(x), *[keep(y) for y in ys], F.col("_key").alias(f"ref_{x}"))
    return fact, dim


# -- discovery ------------------------------------------------------------------------------------

def _threshold(total: Column | int, min_support: int, min_coverage: float):
    if isinstance(total, int):
        return max(min_support, ceil(total * min_coverage))
    return F.greatest(F.lit(min_support), F.ceil(total * min_coverage))


def _digests(column: str, name: str) -> list[Column]:
    """Two 64-bit digests that stand for a value. Discovery only asks whether values are equal, and numbers of fixed size
    combine in a hash map before the shuffle, where the smallest of texts would need every row sorted."""
    value, filled = F.col(column), F.col(column).isNotNull()
    return [F.when(filled, F.xxhash64(value)).alias(f"{name}_a"), F.when(filled, F.xxhash64(F.lit("again"), value)).alias(f"{name}_b")]


def _by_value(rows: DataFrame, dependents: dict[int, list[int]]) -> DataFrame:
    """One row per (class, X, value of X): its digests, and per slot k count and extreme digests of the k-th dependent of X."""
    widest = max(len(ys) for ys in dependents.values())
    parts = [(k, d) for k in range(widest) for d in "ab"]
    none = F.lit(None).cast("long")
    options = [F.struct(F.lit(x).alias("_x"), F.col(f"f{x}_a").alias("_a"), F.col(f"f{x}_b").alias("_b"),
                        *[(F.col(f"f{ys[k]}_{d}") if k < len(ys) else none).alias(f"y{k}_{d}") for k, d in parts]) for x, ys in dependents.items()]
    return (rows.select("class", F.inline(F.array(*options))).where(F.col("_a").isNotNull()).groupBy("class", "_x", "_a", "_b")
            .agg(*[F.count(f"y{k}_a").alias(f"n{k}") for k in range(widest)], *[F.min(f"y{k}_{d}").alias(f"lo{k}_{d}") for k, d in parts],
                 *[F.max(f"y{k}_{d}").alias(f"hi{k}_{d}") for k, d in parts]))


def _changed(one: str, other: str) -> Column:
    return (F.col(f"{one}_a") != F.col(f"{other}_a")) | (F.col(f"{one}_b") != F.col(f"{other}_b"))


def _repeated(rows: DataFrame, fields: int, min_repeated: int) -> list[int]:
    """Fields that have enough repeated values in some class; only their numbers come to the driver."""
    long = F.inline(F.array(*[F.struct(F.lit(i).alias("_x"), F.col(f"f{i}_a").alias("_a"), F.col(f"f{i}_b").alias("_b")) for i in range(fields)]))
    counts = rows.select("class", long).where(F.col("_a").isNotNull()).groupBy("class", "_x", "_a", "_b").agg(F.count(F.lit(1)).alias("n"))
    enough = counts.where(F.col("n") > 1).groupBy("class", "_x").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_repeated)
    return sorted(r["_x"] for r in enough.select("_x").distinct().collect())


def _not_refuted(rows: DataFrame, dependents: dict[int, list[int]]) -> dict[int, list[int]]:
    """Dependents that no class or only some classes refute on all rows of some values of X, one in ``REFUTED_ON``.

    What is refuted there is refuted on the whole, so this narrows what the full pass moves and drops no dependency.
    """
    some = reduce(lambda a, b: a | b, [F.pmod(F.col(f"f{x}_a"), F.lit(REFUTED_ON)) == 0 for x in dependents])
    groups = _by_value(rows.where(some), dependents).where(F.pmod("_a", F.lit(REFUTED_ON)) == 0)
    widest = max(len(ys) for ys in dependents.values())
    broken = groups.groupBy("class", "_x").agg(*[F.max(F.coalesce(_changed(f"lo{k}", f"hi{k}"), F.lit(False)).cast("int")).alias(f"v{k}") for k in range(widest)])
    classes = rows.select("class").distinct().count()
    seen = {r["_x"]: r for r in broken.groupBy("_x").agg(*[F.sum(f"v{k}").alias(f"v{k}") for k in range(widest)]).collect()}
    left = {x: [y for k, y in enumerate(ys) if x not in seen or seen[x][f"v{k}"] < classes] for x, ys in dependents.items()}
    return {x: ys for x, ys in left.items() if ys}


COUNTS = ("eligible_rows", "distinct_x", "repeated_groups", "rows_in_repeated", "violations", "differs")


def _evidence(rows: DataFrame, fields: list[str], min_repeated: int) -> DataFrame | None:
    """Evidence per (class, X, Y) that may hold: rows with both, values of X and Y, repeated values, violations, differences.

    ``rows`` has a class and the digests ``f0_a``, ``f0_b``, ``f1_a`` and so on of the fields. None if no pair is left.
    """
    dependents = {x: [y for y in range(len(fields)) if y != x] for x in _repeated(rows, len(fields), min_repeated)}
    dependents = {x: ys for x, ys in dependents.items() if ys}
    dependents = _not_refuted(rows, dependents) if dependents else {}
    if not dependents:
        return None
    widest = max(len(ys) for ys in dependents.values())
    names = F.create_map(*[v for x, ys in dependents.items() for k, y in enumerate(ys) for v in (F.lit(x * widest + k), F.array(F.lit(fields[x]), F.lit(fields[y])))])
    slots = F.inline(F.array(*[F.struct((F.col("_x") * widest + k).alias("_pair"), F.col(f"n{k}").alias("n"), *[F.col(f"{e}{k}_{d}").alias(f"{e}_{d}") for e in ("lo", "hi") for d in "ab"])
                               for k in range(widest)]))
    pairs = _by_value(rows, dependents).select("class", F.col("_a").alias("v_a"), F.col("_b").alias("v_b"), slots).where(F.col("n") > 0)
    n = F.col("n")
    per_y = pairs.groupBy("class", "_pair", "lo_a", "lo_b").agg(
        F.sum(n).alias("eligible_rows"), F.count(F.lit(1)).alias("distinct_x"), F.count(F.when(n > 1, 1)).alias("repeated_groups"),
        F.sum(F.when(n > 1, n).otherwise(0)).alias("rows_in_repeated"), F.count(F.when(_changed("lo", "hi"), 1)).alias("violations"),
        F.count(F.when(_changed("lo", "v") | _changed("hi", "v"), 1)).alias("differs"))
    return (per_y.groupBy("class", "_pair").agg(*[F.sum(c).alias(c) for c in COUNTS], F.count(F.lit(1)).alias("distinct_y"))
            .select("class", names[F.col("_pair")][0].alias("x"), names[F.col("_pair")][1].alias("y"), *COUNTS, "distinct_y"))


def _passed(evidence: DataFrame, min_support: int, min_coverage: float, min_repeated: int) -> DataFrame:
    """Pairs without violation that have enough evidence, with coverage; ``total`` is the number of rows of the class."""
    return (evidence.where((F.col("eligible_rows") >= _threshold(F.col("total"), min_support, min_coverage)) & (F.col("violations") == 0)
                           & (F.col("distinct_y") >= 2) & (F.col("differs") > 0) & (F.col("repeated_groups") >= min_repeated))
            .withColumn("coverage", F.col("eligible_rows") / F.col("total"))
            .withColumn("redundant_rows", F.col("eligible_rows") - F.col("distinct_x")))


def _no_findings(df: DataFrame, names: tuple[str, ...]) -> DataFrame:
    kinds = {"class": "string", "x": "string", "y": "string", "coverage": "double"}
    return df.sparkSession.createDataFrame([], ", ".join(f"`{n}` {kinds.get(n, 'long')}" for n in names))


def discover_fds(df: DataFrame, min_support: int = MIN_SUPPORT, min_coverage: float = MIN_COVERAGE,
                 min_repeated: int = MIN_REPEATED) -> DataFrame:
    """All X -> Y between the columns of one relation, with evidence.

    Rows are written once, as digests of their values. Every row is repeated once per candidate X (not per pair), with the
    columns that may depend on X, and grouped by (X, value); each group keeps count, smallest and largest digest of them.
    """
    cols = df.columns
    text = df.select(*[F.col(c).cast("string").alias(f"f{i}") for i, c in enumerate(cols)])
    rows = written(text.select(F.lit("").alias("class"), *[d for i in range(len(cols)) for d in _digests(f"f{i}", f"f{i}")]))
    names = ("x", "y", "eligible_rows", "coverage", "distinct_x", "repeated_groups", "rows_in_repeated", "redundant_rows")
    evidence = _evidence(rows, cols, min_repeated)
    if evidence is None:
        return _no_findings(df, names)
    total = rows.agg(F.count(F.lit(1)).alias("total")).scalar()
    return _passed(evidence.withColumn("total", total), min_support, min_coverage, min_repeated).select(*names)


def ranked(findings: DataFrame) -> DataFrame:
    """Result order: coverage and redundant rows downwards, then names."""
    return findings.orderBy(F.desc("coverage"), F.desc("redundant_rows"), "x", "y")


def cells_of(df: DataFrame, class_: str | Column, row: str, fields: list[str]) -> DataFrame:
    """Long form of a relation: [class, row, field, term], without nulls."""
    cls = F.lit(class_) if isinstance(class_, str) else class_
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("term")) for f in fields])
    return (df.select(cls.alias("class"), F.col(row).cast("string").alias("row"), F.inline(pairs))
            .where(F.col("term").isNotNull()))


def single_valued(cells: DataFrame) -> DataFrame:
    """Cells with exactly one distinct term: [class, row, field, term]."""
    return (cells.groupBy("class", "row", "field").agg(F.min("term").alias("term"), F.max("term").alias("_hi"))
            .where(F.col("term") == F.col("_hi")).drop("_hi"))


def field_profile(cells: DataFrame) -> DataFrame:
    """Per class and field: rows with one term, with several, and without."""
    rows = cells.groupBy("class").agg(F.countDistinct("row").alias("total"))
    per = (cells.groupBy("class", "row", "field").agg((F.min("term") == F.max("term")).alias("one"))
           .groupBy("class", "field").agg(F.count(F.when(F.col("one"), 1)).alias("single"),
                                          F.count(F.when(~F.col("one"), 1)).alias("multiple")))
    return per.join(rows, "class").select("class", "field", "single", "multiple",
                                          (F.col("total") - F.col("single") - F.col("multiple")).alias("missing"))


def _single_digests(cells: DataFrame, fields: list[str]) -> DataFrame:
    """One row per (class, row): digests of the fields that have one distinct term, in the form of :func:`_evidence`."""
    known = (cells.where(F.col("class").isNotNull() & F.col("row").isNotNull())
             .select("class", "row", F.array_position(F.array(*map(F.lit, fields)), F.col("field")).cast("int").alias("_f"), *_digests("term", "_t")))
    each = [(i, d, F.when(F.col("_f") == i + 1, F.col(f"_t_{d}"))) for i in range(len(fields)) for d in "ab"]
    extremes = known.groupBy("class", "row").agg(*[F.min(v).alias(f"lo{i}_{d}") for i, d, v in each], *[F.max(v).alias(f"hi{i}_{d}") for i, d, v in each])
    return extremes.select("class", *[F.when(~_changed(f"lo{i}", f"hi{i}"), F.col(f"lo{i}_{d}")).alias(f"f{i}_{d}") for i, d, _ in each])


def discover_fds_by_class(cells: DataFrame, min_support: int = MIN_SUPPORT, min_coverage: float = MIN_COVERAGE,
                          min_repeated: int = MIN_REPEATED, min_rows: int = 1, max_rows: int | None = None) -> DataFrame:
    """X -> Y per class over cells, all classes in one job.

    The cells of a row meet once, as digests side by side; field names come to the driver. From there on it is
    :func:`discover_fds` with a class: values of a hot X are combined before the shuffle.
    """
    names = ("class", "x", "y", "eligible_rows", "coverage", "distinct_x", "distinct_y", "repeated_groups", "rows_in_repeated", "redundant_rows")
    fields = sorted(r["field"] for r in cells.where(F.col("field").isNotNull() & F.col("term").isNotNull()).select("field").distinct().collect())
    if not fields:
        return _no_findings(cells, names)
    rows = written(_single_digests(cells, fields))
    totals = rows.groupBy("class").agg(F.count(F.lit(1)).alias("total")).where(F.col("total") >= min_rows)
    if max_rows is not None:
        totals = totals.where(F.col("total") <= max_rows)
    if min_rows > 1 or max_rows is not None:
        rows = rows.join(totals, "class", "left_semi")
    evidence = _evidence(rows, fields, min_repeated)
    if evidence is None:
        return _no_findings(cells, names)
    return _passed(evidence.join(totals, "class"), min_support, min_coverage, min_repeated).select(*names)


def pending_classes(inventory: DataFrame, done: DataFrame) -> DataFrame:
    """Classes without a finished result; failed ones come again. ``done``: [class, status]."""
    return inventory.join(done.where(F.col("status") == "done"), "class", "left_anti")


def discover_multi_fds(df: DataFrame, singles: dict[str, list[str]], min_support: int = MIN_SUPPORT,
                       min_coverage: float = MIN_COVERAGE, min_repeated: int = MIN_REPEATED, min_dependents: int = 2) -> DataFrame:
    """Maximal X -> {Y1, ..., Yn} that pass on the rows where X and all Y are filled.

    The sets of column names are walked on the driver from the largest downwards; one Spark job decides
    all sets of a level. Each X -> Y already holds, so only the evidence on the common rows is counted.
    """
    spark = df.sparkSession
    text = df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])
    total = text.count()
    floor_ = _threshold(total, min_support, min_coverage)
    level = {(x, tuple(sorted(ys))) for x, ys in singles.items() if len(ys) >= min_dependents}
    accepted: list[tuple] = []
    while level:
        facts = _level_facts(text, sorted(level))
        below = set()
        for x, ys in sorted(level):
            f = facts.get((x, ys))
            if f and f["eligible"] >= floor_ and f["repeated"] >= min_repeated and f["informative"]:
                accepted.append((x, list(ys), f["eligible"], f["eligible"] / total, f["distinct_x"], f["repeated"],
                                 f["in_repeated"], f["eligible"] - f["distinct_x"]))
            elif len(ys) > min_dependents:
                below |= {(x, tuple(y for y in ys if y != gone)) for gone in ys}
        level = {(x, ys) for x, ys in below
                 if not any(x == a[0] and set(ys) <= set(a[1]) for a in accepted)}
    return spark.createDataFrame(accepted, "x string, ys array<string>, eligible_rows long, coverage double, distinct_x long, "
                                           "repeated_groups long, rows_in_repeated long, redundant_rows long")


def _level_facts(text: DataFrame, level: list[tuple[str, tuple[str, ...]]]) -> dict:
    """Evidence of all candidate sets of one level in one job; the result has one row per candidate."""
    widest = max(len(ys) for _, ys in level)
    options = []
    for i, (x, ys) in enumerate(level):
        filled = _both([F.col(c).isNotNull() for c in (x, *ys)])
        slots = [F.col(ys[k]) if k < len(ys) else F.lit(None).cast("string") for k in range(widest)]
        options.append(F.when(filled, F.struct(F.lit(i).alias("i"), F.col(x).alias("v"), *[s.alias(f"y{k}") for k, s in enumerate(slots)])))
    rows = text.select(F.explode(F.array_compact(F.array(*options))).alias("o")).select("o.*")
    groups = rows.groupBy("i", "v").agg(F.count(F.lit(1)).alias("n"), *[F.min(f"y{k}").alias(f"y{k}") for k in range(widest)])
    n = F.col("n")
    facts = groups.groupBy("i").agg(
        F.sum(n).alias("eligible"), F.count(F.lit(1)).alias("distinct_x"), F.count(F.when(n > 1, 1)).alias("repeated"),
        F.sum(F.when(n > 1, n).otherwise(0)).alias("in_repeated"),
        *[((F.min(f"y{k}") != F.max(f"y{k}")) & (F.count(F.when(F.col(f"y{k}") != F.col("v"), 1)) > 0)).alias(f"ok{k}") for k in range(widest)])
    return {level[r["i"]]: {**r.asDict(), "informative": all(r[f"ok{k}"] for k in range(len(level[r["i"]][1])))}
            for r in facts.collect()}


def fd_examples(df: DataFrame, x: str, ys: list[str], row: str, groups: int = 2, members: int = 3) -> DataFrame:
    """The largest groups with a few member rows each: [x, ys..., group_size, row].

    Members are the first rows of the chosen groups only; the limits are the report's own.
    """
    filled = df.where(_both([F.col(c).isNotNull() for c in (x, *ys)]))
    top = (filled.groupBy(x).agg(F.count(F.lit(1)).alias("group_size"), *[F.min(y).alias(y) for y in ys])
           .where(F.col("group_size") > 1).orderBy(F.desc("group_size"), x).limit(groups))
    from pyspark.sql import Window as W
    first = filled.select(F.col(x).alias("_x"), F.col(row).alias("row")).join(top, F.col("_x") == F.col(x))
    return (first.withColumn("_r", F.row_number().over(W.partitionBy(x).orderBy("row")))
            .where(F.col("_r") <= members).select(x, *ys, "group_size", "row"))
