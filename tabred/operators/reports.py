"""Summaries of result records: query runs, fold runs, updates."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tabred.functions.vectors import let
from tabred.operators.ranking import with_quantiles

# Bounds of the copy-count bins.
COPY_BINS = ((100, "<100"), (1000, "100-999"), (10000, "1000-9999"))


def _c(name: str) -> Column:
    return F.col(name)


def _mean_of_all(value: Column) -> Column:
    """Mean that is null as soon as one value of the group is missing."""
    return F.when(F.count(value) == F.count("*"), F.avg(value))


def observations(records: DataFrame) -> DataFrame:
    """Query-run records with ``observed`` time (a capped run gives its lower bound) and ``is_bound``."""
    exact, capped = _c("template_result.client_time_ms"), _c("template_result.status") == "capped"
    bound = exact.isNull() & F.coalesce(capped, F.lit(False))
    return records.withColumn("observed", F.when(bound, _c("template_result.client_time_lower_bound_ms")).otherwise(exact)).withColumn("is_bound", bound)


def strategy_means(records: DataFrame) -> DataFrame:
    """Means per strategy; null when any run lacks the value, a lower bound when any run was capped."""
    return (observations(records).groupBy("query_id", "template", "strategy").agg(
        F.count("*").alias("runs"), _mean_of_all(_c("mv_create_time_ms")).alias("build_ms"),
        _mean_of_all(_c("baseline.client_time_ms")).alias("baseline_ms"), _mean_of_all(_c("observed")).alias("template_ms"),
        F.max("is_bound").alias("_any_bound"))
        .withColumn("lower_bound", _c("template_ms").isNotNull() & _c("_any_bound")).drop("_any_bound"))


def query_summary(records: DataFrame) -> DataFrame:
    """Equal-weight mean over the complete strategies of each query: times, saving, speed-up, build time."""
    means = strategy_means(records)
    complete = F.when(_c("build_ms").isNotNull() & _c("baseline_ms").isNotNull() & _c("template_ms").isNotNull(), F.lit(1))
    rows = means.groupBy("query_id").agg(
        F.count("*").alias("strategies"), F.count(complete).alias("usable"), F.avg(F.when(complete == 1, _c("baseline_ms"))).alias("baseline_ms"),
        F.avg(F.when(complete == 1, _c("template_ms"))).alias("template_ms"), F.avg(F.when(complete == 1, _c("build_ms"))).alias("build_ms"),
        F.coalesce(F.max(F.when(complete == 1, _c("lower_bound"))), F.lit(False)).alias("lower_bound"))
    return (rows.withColumn("saving_ms", _c("template_ms") - _c("baseline_ms")).withColumn("speed_up", F.try_divide(_c("template_ms"), _c("baseline_ms"))))


def faster_slower(records: DataFrame) -> DataFrame:
    """Strategies with exact means, marked faster or slower than the base query, largest difference first."""
    means = strategy_means(records).where(~_c("lower_bound") & _c("template_ms").isNotNull() & _c("baseline_ms").isNotNull())
    diff = _c("baseline_ms") - _c("template_ms")
    return (means.where(diff != 0).select("query_id", "strategy", F.when(diff > 0, "faster").otherwise("slower").alias("side"), diff.alias("saving_ms"))
            .orderBy("side", F.desc(F.abs("saving_ms")), "strategy"))


def validate_records(records: DataFrame) -> DataFrame:
    """Violations: [strategy, problem, n]: missing fields, times that are not positive, uneven numbers of runs."""
    def problems(name: str, condition: Column) -> DataFrame:
        return records.where(condition).groupBy("strategy").agg(F.count("*").alias("n")).select("strategy", F.lit(name).alias("problem"), "n")
    missing = problems("missing field", _c("query_id").isNull() | _c("strategy").isNull() | _c("baseline").isNull() | _c("template_result").isNull())
    negative = problems("time not positive", (_c("baseline.client_time_ms") <= 0) | (_c("template_result.client_time_ms") <= 0))
    runs = records.groupBy("query_id", "strategy").agg(F.count("*").alias("n"))
    spread = runs.groupBy(F.col("query_id").alias("_q")).agg(F.min("n").alias("low"), F.max("n").alias("high")).where("low <> high")
    uneven = runs.join(spread, F.col("query_id") == F.col("_q")).select("strategy", F.lit("uneven runs").alias("problem"), "n")
    return missing.unionAll(negative).unionAll(uneven)


def fold_rows(records: DataFrame) -> DataFrame:
    """One row per mask and updated table, with times, median copies, break-even count and deltas."""
    u = _c("u")
    return records.select(
        "mask", "folded_edges", F.when(F.size("folded_edges") == 0, "Normalized").otherwise(F.array_join("folded_edges", " + ")).alias("strategy"),
        _c("normalization.elapsed_ms").alias("normalization_ms"), "structural_delta.*", F.explode("updates").alias("terminal", "u")).select(
        "mask", "folded_edges", "strategy", "terminal", u["min_ms"].alias("min_ms"), u["median_ms"].alias("median_ms"), u["max_ms"].alias("max_ms"),
        u["normalized_update"]["median_ms"].alias("normalized_ms"), u["normalization_save"]["median_ms"].alias("saving_ms"), "normalization_ms",
        _median(F.transform(u["samples"], lambda s: s["touched_nodes"].cast("double"))).alias("copies"),
        F.when(u["normalization_save"]["median_ms"] > 0, F.ceil(_c("normalization_ms") / u["normalization_save"]["median_ms"])).alias("kappa"),
        "delta_nodes", "delta_relationships", "delta_property_cells", effective_edges("folded_edges", "terminal").alias("effective"))


def _median(values: Column) -> Column:
    """Median of a short array of samples."""
    sorted_ = F.array_sort(values)
    n = F.size(values)
    at = lambda i: F.get(sorted_, F.floor(i).cast("int"))
    return (at((n - 1) / 2) + at(n / 2)) / 2


def effective_edges(folded: str, terminal: str) -> Column:
    """Folded references from which ``terminal`` can be reached over folded references, in order.

    The reference graph has eight edges and at most five steps, so five rounds of closing suffice.
    """
    source = lambda e: F.element_at(F.split(e, "_"), 1)
    target = lambda e: F.element_at(F.split(e, "_"), 2)
    into = lambda reach: F.filter(F.col(folded), lambda e: F.array_contains(reach, target(e)))
    reach = F.array(F.col(terminal))
    for _ in range(5):
        reach = let(reach, lambda r: F.array_union(r, F.transform(into(r), source)))
    return let(reach, into)


def representatives(rows: DataFrame) -> DataFrame:
    """Per table and effective paths the row with the fewest folded edges, then the lowest mask."""
    best = F.row_number().over(W.partitionBy("terminal", "effective").orderBy(F.size("folded_edges"), "mask"))
    return rows.withColumn("_r", best).where("_r = 1").drop("_r")


def sf_influence(samples: DataFrame, baseline: DataFrame) -> DataFrame:
    """Median and quartiles of saving percent and speed-up per scale and strategy.

    ``samples``: [sf, strategy, group, elapsed_ms]; ``baseline``: [sf, group, elapsed_ms] of the normalised side.
    """
    base = baseline.select(F.col("sf").alias("_sf"), F.col("group").alias("_g"), F.col("elapsed_ms").alias("n_ms"))
    both = samples.join(base, (F.col("sf") == F.col("_sf")) & (F.col("group") == F.col("_g")))
    both = both.withColumn("pct", 100.0 * (_c("elapsed_ms") - _c("n_ms")) / _c("elapsed_ms")).withColumn("speed_up", _c("elapsed_ms") / _c("n_ms"))
    cuts = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    every = {f"{n}_{v}": (v, q) for v in ("pct", "speed_up") for n, q in cuts.items()}
    return with_quantiles(both.groupBy("sf", "strategy").agg(F.count("*").alias("samples")), both, ["sf", "strategy"], every).select("sf", "strategy", *every, "samples")


def case_rows(samples: DataFrame, baseline: DataFrame, group: int) -> DataFrame:
    """All strategies on one update group next to the normalised side, by number of copies.

    ``samples``: [strategy, group, elapsed_ms, copies, cells]; ``baseline``: [group, elapsed_ms].
    """
    base = baseline.where(F.col("group") == group).select(F.col("elapsed_ms").alias("normalised_ms"), F.col("group").alias("_g"))
    return (samples.where(F.col("group") == group).join(base, F.col("group") == F.col("_g"))
            .select("strategy", "copies", "cells", F.col("elapsed_ms").alias("folded_ms"), "normalised_ms").orderBy("copies", "strategy"))


def speedup_bins(cases: DataFrame) -> DataFrame:
    """Median speed-up per copy-count bin. ``cases``: [copies, d_median_ms, n_median_ms]."""
    bin_ = F.when(_c("copies") < COPY_BINS[0][0], COPY_BINS[0][1])
    for bound, name in COPY_BINS[1:]:
        bin_ = bin_.when(_c("copies") < bound, name)
    binned = cases.withColumn("bin", bin_.otherwise(">=10000")).withColumn("speed_up", _c("d_median_ms") / _c("n_median_ms"))
    return with_quantiles(binned.groupBy("bin").agg(F.count("*").alias("groups")), binned, ["bin"], {"median_speed_up": ("speed_up", 0.5)})


def update_summary(records: DataFrame) -> DataFrame:
    """Per dependency: groups, redundant values, rebuild time, median times, and the largest sampled group."""
    flat = records.select("fd", "valid_groups", "redundant_values", "normalization_seconds", F.explode("cases").alias("c")).select("*", "c.*")
    order = F.struct("copies", "key")
    rest = flat.groupBy("fd").agg(
        F.first("valid_groups").alias("valid_groups"), F.first("redundant_values").alias("redundant_values"), F.first("normalization_seconds").alias("normalization_seconds"),
        F.max("copies").alias("largest_copies"), F.max_by("d_median_ms", order).alias("largest_d_ms"), F.max_by("n_median_ms", order).alias("largest_n_ms"))
    medians = {c: (c, 0.5) for c in ("d_median_ms", "n_median_ms")}
    return with_quantiles(rest, flat, ["fd"], medians).select("fd", "valid_groups", "redundant_values", "normalization_seconds", *medians, "largest_copies", "largest_d_ms", "largest_n_ms")


def sf1_summary(records: DataFrame) -> DataFrame:
    """Per strategy: runs, base mean and median, completed mean, capped, over limit, mean with bounds, errors."""
    status, done = _c("template_result.status"), _c("template_result.client_time_ms")
    rest = records.groupBy("strategy").agg(
        F.count("*").alias("runs"), F.avg("baseline.client_time_ms").alias("base_mean_ms"), F.avg(done).alias("done_mean_ms"), F.count(F.when(status == "capped", 1)).alias("capped"),
        F.count(F.when(status == "completed_over_limit", 1)).alias("over_limit"),
        F.avg(F.coalesce("template_result.client_time_lower_bound_ms", done)).alias("bound_mean_ms"),
        F.count(F.when(~status.isin("completed", "capped", "completed_over_limit"), 1)).alias("errors"))
    medians = {"base_median_ms": (_c("baseline.client_time_ms"), 0.5), "done_median_ms": (done, 0.5)}
    return with_quantiles(rest, records, ["strategy"], medians).select(
        "strategy", "runs", "base_mean_ms", "base_median_ms", "done_mean_ms", "done_median_ms", "capped", "over_limit", "bound_mean_ms", "errors")


def sf1_updates(records: DataFrame) -> DataFrame:
    """Update table: times, rebuild seconds, extra cells and median copies per table and folded edges."""
    return fold_rows(records).select("terminal", F.array_join("folded_edges", ",").alias("edges"), "min_ms", "median_ms", "max_ms", "normalized_ms", "saving_ms",
                                     (_c("normalization_ms") / 1000).alias("rebuild_s"), "delta_property_cells", "copies")


def check_deltas(df: DataFrame) -> DataFrame:
    """Cross-check of counts after a split: [id, problem].

    Rows grow by the valid groups, edges equal the valid rows, and cells lose the removed columns of the
    valid rows and gain the columns of the groups.
    """
    tests = {"nodes": _c("n_nodes") != _c("d_nodes") + _c("valid_groups"), "edges": _c("n_edges") != _c("valid_rows"),
             "cells": _c("n_cells") != _c("d_cells") - _c("valid_rows") * _c("removed") + _c("valid_groups") * _c("properties")}
    found = F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t in tests.items()]))
    return df.select("id", F.explode(found).alias("problem"))
