"""Result analytics over records that Spark derives from the event and order tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from tabred import oracle
from tabred.catalog import register
from tabred.catalog.sources import fresh
from tabred.operators import reports as R
from tabred.sources import results
from tabred.sources.tables import tpch_view

V = oracle.with_views
c = F.col


def query_records(s, d):
    """Every event as one run: errors are capped runs, sign-ups lack a time for every fifth user."""
    e = s.read.parquet(f"{d}/events.parquet")
    status = F.when(c("event_type") == "error", "capped").when(c("event_type") == "signup", "completed_over_limit").otherwise("completed")
    time = F.when(c("event_type") != "error", F.when(~((c("event_type") == "signup") & (c("user_id") % 5 == 0)), c("value") * 2))
    return e.select((c("user_id") % 8).alias("query_id"), F.lit("manual").alias("template"), F.concat(F.lit("s"), (c("user_id") % 40).cast("string")).alias("strategy"),
                    (c("user_id") * 10.0).alias("mv_create_time_ms"), F.struct(c("value").alias("client_time_ms"), c("value").alias("server_time_ms")).alias("baseline"),
                    F.struct(status.alias("status"), time.alias("client_time_ms"), F.when(c("event_type") == "error", c("value") * 3).alias("client_time_lower_bound_ms"),
                             time.alias("server_time_ms")).alias("template_result"))


RUNS = """select user_id % 8 as query_id, 's' || user_id % 40 as strategy, user_id * 10.0::double as build, value as base, event_type = 'error' as bound,
    case when event_type = 'error' then 'capped' when event_type = 'signup' then 'completed_over_limit' else 'completed' end as status,
    case when event_type = 'error' then value * 3 when event_type = 'signup' and user_id % 5 = 0 then null else value * 2 end as obs,
    case when event_type = 'error' or (event_type = 'signup' and user_id % 5 = 0) then null else value * 2 end as done from events"""
MEANS = f"""select query_id, 'manual' as template, strategy, count(*) as runs, avg(build) as build_ms, avg(base) as baseline_ms,
    case when count(obs) = count(*) then avg(obs) end as template_ms, count(obs) = count(*) and bool_or(bound) as lower_bound from ({RUNS}) group by 1, 2, 3"""
rnd = lambda df, *cols: df.withColumns({x: F.round(x, 6) for x in cols})
register("r1_strategy_means", lambda s, d: rnd(R.strategy_means(query_records(s, d)), "build_ms", "baseline_ms", "template_ms"),
         f"select query_id, template, strategy, runs, round(build_ms, 6) as build_ms, round(baseline_ms, 6) as baseline_ms, round(template_ms, 6) as template_ms, lower_bound from ({MEANS})")
register("r2_query_summary", lambda s, d: rnd(R.query_summary(query_records(s, d)), "build_ms", "baseline_ms", "template_ms", "saving_ms", "speed_up"),
         f"""with q as (select query_id, count(*) as strategies, count(template_ms) as usable, avg(baseline_ms) filter (template_ms is not null) as baseline_ms, avg(template_ms) as template_ms,
             avg(build_ms) filter (template_ms is not null) as build_ms, coalesce(bool_or(lower_bound) filter (template_ms is not null), false) as lower_bound from ({MEANS}) group by 1)
             select query_id, strategies, usable, round(baseline_ms, 6) as baseline_ms, round(template_ms, 6) as template_ms, round(build_ms, 6) as build_ms, lower_bound,
             round(template_ms - baseline_ms, 6) as saving_ms, round(template_ms / baseline_ms, 6) as speed_up from q""")
_no_errors = lambda s, d: query_records(s, d).where("template_result.status <> 'capped'")
register("r3_faster_slower", lambda s, d: rnd(R.faster_slower(_no_errors(s, d)), "saving_ms"),
         f"""select query_id, strategy, case when b > t then 'faster' else 'slower' end as side, round(b - t, 6) as saving_ms from (select query_id, strategy, avg(base) as b,
             case when count(obs) = count(*) then avg(obs) end as t from ({RUNS}) where status <> 'capped' group by 1, 2) where t is not null and b <> t""")
register("r4_validate_records", lambda s, d: R.validate_records(query_records(s, d)),
         f"""select strategy, 'time not positive' as problem, count(*) as n from ({RUNS}) where base <= 0 or done <= 0 group by 1 union all
             select strategy, 'uneven runs', n from (select *, min(n) over (partition by query_id) as lo, max(n) over (partition by query_id) as hi from
             (select query_id, strategy, count(*) as n from ({RUNS}) group by 1, 2)) where lo <> hi""")


def fold_records(s, d):
    """Customers as update samples of two masks: copies are their orders, times follow from balances."""
    t = tpch_view(s, d)
    per = t["orders"].groupBy("o_custkey").agg(F.count(F.lit(1)).alias("copies"))
    x = per.join(t["customer"], c("o_custkey") == c("c_custkey")).select((c("c_nationkey") + 1).cast("long").alias("mask"), "copies", "c_custkey", c("c_acctbal").alias("ms"))
    sample = F.struct(c("c_custkey").alias("group"), c("c_custkey").cast("string").alias("key"), F.lit("a").alias("a0"), F.lit("b").alias("a1"), c("copies").alias("touched_nodes"), F.abs("ms").alias("elapsed_ms"))
    stats = x.groupBy("mask").agg(F.min("ms").alias("lo"), F.max("ms").alias("hi"), F.min("copies").alias("c0"), F.max("copies").alias("c1"), F.max("c_custkey").alias("k"))
    update = F.struct(c("lo").alias("min_ms"), c("hi").alias("median_ms"), c("hi").alias("max_ms"), F.array(*[
        F.struct(F.lit(i).cast("long").alias("group"), c("k").cast("string").alias("key"), F.lit("a").alias("a0"), F.lit("b").alias("a1"), c(col).alias("touched_nodes"), c("hi").alias("elapsed_ms"))
        for i, col in enumerate(("c0", "c1", "k"))]).alias("samples"), F.struct(c("lo").alias("median_ms")).alias("normalized_update"), F.struct((c("hi") - 9000).alias("median_ms")).alias("normalization_save"))
    edges = F.when(c("mask") % 2 == 0, F.array(F.lit("O_C"), F.lit("C_N"), F.lit("PS_P"))).otherwise(F.array(F.lit("C_N")))
    return stats.select("mask", edges.alias("folded_edges"), F.array(F.lit("N")).alias("terminal_relations"),
                        F.struct(c("k").alias("delta_nodes"), (c("k") * 2).alias("delta_relationships"), (c("k") * 3).alias("delta_property_cells")).alias("structural_delta"),
                        F.create_map(F.lit("N"), update).alias("updates"), F.struct((c("k") * 100.0).alias("elapsed_ms")).alias("normalization"))


FOLDS = """with x as (select c_nationkey + 1 as mask, n as copies, c_custkey, c_acctbal as ms from customer join (select o_custkey, count(*) as n from orders group by 1) on o_custkey = c_custkey),
    f as (select cast(mask as bigint) as mask, min(ms) as lo, max(ms) as hi, min(copies) as c0, max(copies) as c1, max(c_custkey) as k from x group by 1)
    select mask, 'N' as terminal, case when mask % 2 = 0 then 'O_C + C_N + PS_P' else 'C_N' end as strategy, lo as min_ms, hi as median_ms, hi as max_ms, lo as normalized_ms, hi - 9000 as saving_ms,
    k * 100.0::double as normalization_ms, quantile_cont(v, 0.5)::double as copies, case when hi - 9000 > 0 then cast(ceil(k * 100.0::double / (hi - 9000)) as bigint) end as kappa,
    k as delta_nodes, k * 2 as delta_relationships, k * 3 as delta_property_cells, case when mask % 2 = 0 then 'O_C,C_N' else 'C_N' end as effective
    from (select *, unnest([c0, c1, k]) as v from f) group by all"""
register("r5_fold_rows", lambda s, d: R.fold_rows(fold_records(s, d)).drop("folded_edges").withColumn("effective", F.array_join("effective", ",")), FOLDS)
register("r5_representatives", lambda s, d: R.representatives(R.fold_rows(fold_records(s, d))).select("mask", "terminal", F.array_join("effective", ",").alias("effective")),
         f"select min(mask) as mask, terminal, effective from ({FOLDS}) group by 2, 3")
register("r11_sf1_updates", lambda s, d: R.sf1_updates(fold_records(s, d)),
         f"select terminal, replace(strategy, ' + ', ',') as edges, min_ms, median_ms, max_ms, normalized_ms, saving_ms, normalization_ms / 1000 as rebuild_s, delta_property_cells, copies from ({FOLDS})")


def group_samples(s, d):
    e = s.read.parquet(f"{d}/events.parquet").where("value > 0")
    keyed = e.select((c("user_id") % 3).alias("sf"), c("event_type").alias("strategy"), c("user_id").alias("group"), c("value").alias("elapsed_ms"))
    per = keyed.groupBy("sf", "strategy", "group").agg(F.max("elapsed_ms").alias("elapsed_ms"), F.count(F.lit(1)).alias("copies"))
    return per.where("strategy <> 'view'").withColumn("cells", c("copies") * 3), per.where("strategy = 'view'").select("sf", "group", "elapsed_ms")


SAMPLES = """with s as (select user_id % 3 as sf, event_type as strategy, user_id as grp, max(value) as ms, count(*) as copies from events where value > 0 group by 1, 2, 3),
    b as (select sf, strategy, s.grp, s.ms, s.copies, v.ms as n from s join (select grp, ms from s where strategy = 'view') v using (grp) where strategy <> 'view')"""
_six = ("q1_pct", "median_pct", "q3_pct", "q1_speed_up", "median_speed_up", "q3_speed_up")
register("r6_scale_influence", lambda s, d: rnd(R.sf_influence(*group_samples(s, d)), *_six),
         SAMPLES + " select sf, strategy, " + ", ".join(f"round(quantile_cont({e}, {q}), 6) as {n}" for n, e, q in (
             ("q1_pct", "100.0 * (ms - n) / ms", 0.25), ("median_pct", "100.0 * (ms - n) / ms", 0.5), ("q3_pct", "100.0 * (ms - n) / ms", 0.75),
             ("q1_speed_up", "ms / n", 0.25), ("median_speed_up", "ms / n", 0.5), ("q3_speed_up", "ms / n", 0.75))) + ", count(*) as samples from b group by 1, 2")
register("r7_case_rows", lambda s, d: R.case_rows(*group_samples(s, d), 8),
         SAMPLES + " select strategy, copies, copies * 3 as cells, ms as folded_ms, n as normalised_ms from b where grp = 8")


def update_cases(s, d):
    """Customers of a nation as sampled groups: copies are order prices in hundreds."""
    o = tpch_view(s, d)["orders"].groupBy("o_custkey").agg(F.floor(F.max("o_totalprice") / 30).alias("copies"), F.count(F.lit(1)).alias("n"))
    return o.join(tpch_view(s, d)["customer"], c("o_custkey") == c("c_custkey")).select(
        F.concat(F.lit("fd"), c("c_nationkey").cast("string")).alias("fd"), c("o_custkey").cast("string").alias("key"), "copies", (c("n") * 2.0).alias("d_median_ms"), (c("c_custkey") % 5 + 1.0).alias("n_median_ms"))


CASES = """select 'fd' || c_nationkey as fd, o_custkey::varchar as key, cast(floor(max(o_totalprice) / 30) as bigint) as copies, count(*) * 2.0::double as d, any_value(c_custkey % 5 + 1.0)::double as n
    from orders join customer on o_custkey = c_custkey group by c_nationkey, o_custkey"""
register("r8_speedup_bins", lambda s, d: rnd(R.speedup_bins(update_cases(s, d)), "median_speed_up"),
         f"""select case when copies < 100 then '<100' when copies < 1000 then '100-999' when copies < 10000 then '1000-9999' else '>=10000' end as bin, count(*) as groups,
             round(quantile_cont(d / n, 0.5), 6) as median_speed_up from ({CASES}) group by 1""")


def update_records(s, d):
    """One record per dependency with its first and last sampled group."""
    row = F.struct("key", "copies", "d_median_ms", "n_median_ms")
    return update_cases(s, d).groupBy("fd").agg(F.count(F.lit(1)).alias("valid_groups"), F.sum("copies").alias("redundant_values"), F.lit(1.5).alias("normalization_seconds"),
                                                F.array(F.min_by(row, "key"), F.max_by(row, "key")).alias("cases"))


register("r9_update_summary", lambda s, d: R.update_summary(update_records(s, d)),
         f"""with c as ({CASES}), e as (select *, min(key) over (partition by fd) as lo, max(key) over (partition by fd) as hi, count(*) over (partition by fd) as g, sum(copies) over (partition by fd) as r from c)
             select fd, g as valid_groups, cast(r as bigint) as redundant_values, cast(1.5 as double) as normalization_seconds, quantile_cont(d, 0.5) as d_median_ms, quantile_cont(n, 0.5) as n_median_ms,
             max(copies) as largest_copies, arg_max(d, (copies, key)) as largest_d_ms, arg_max(n, (copies, key)) as largest_n_ms from e where key in (lo, hi) group by 1, 2, 3""")
register("r10_sf1_summary", lambda s, d: rnd(R.sf1_summary(query_records(s, d)), "base_mean_ms", "base_median_ms", "done_mean_ms", "done_median_ms", "bound_mean_ms"),
         f"""select strategy, count(*) as runs, round(avg(base), 6) as base_mean_ms, round(quantile_cont(base, 0.5), 6) as base_median_ms, round(avg(done), 6) as done_mean_ms,
             round(quantile_cont(done, 0.5), 6) as done_median_ms, count(*) filter (status = 'capped') as capped, count(*) filter (status = 'completed_over_limit') as over_limit,
             round(avg(obs), 6) as bound_mean_ms, cast(0 as bigint) as errors from ({RUNS}) group by 1""")


def split_states(s, d):
    """Counts before and after splitting customers by nation; every third nation's count is wrong."""
    n = tpch_view(s, d)["customer"].groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("rows"))
    return n.select(c("c_nationkey").alias("id"), c("rows").alias("d_nodes"), (c("rows") + 1 + F.when(c("c_nationkey") % 3 == 0, 1).otherwise(0)).alias("n_nodes"), c("rows").alias("valid_rows"),
                    F.lit(1).alias("valid_groups"), c("rows").alias("n_edges"), (c("rows") * 5).alias("d_cells"), (c("rows") * 3 + 2 - F.when(c("c_nationkey") % 6 == 0, 1).otherwise(0)).alias("n_cells"),
                    F.lit(2).alias("removed"), F.lit(2).alias("properties"))


register("r12_check_deltas", lambda s, d: R.check_deltas(split_states(s, d)),
         "select distinct c_nationkey as id, 'nodes' as problem from customer where c_nationkey % 3 = 0 union all select distinct c_nationkey, 'cells' from customer where c_nationkey % 6 = 0")


def stored_records(s, d, kind, df):
    path = fresh(s)
    results.write_results(df, path)
    return results.read_results(s, path, kind, multi_line=False)


register("s11_read_results", lambda s, d: rnd(R.strategy_means(stored_records(s, d, "query", query_records(s, d))), "build_ms", "baseline_ms", "template_ms"),
         f"select query_id, template, strategy, runs, round(build_ms, 6) as build_ms, round(baseline_ms, 6) as baseline_ms, round(template_ms, 6) as template_ms, lower_bound from ({MEANS})")
register("s12_write_results", lambda s, d: R.fold_rows(stored_records(s, d, "fold", fold_records(s, d))).drop("folded_edges").withColumn("effective", F.array_join("effective", ",")), FOLDS)
