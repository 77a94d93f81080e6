"""Expressions, joins, aggregates, windows, ordering and checks, one small query each."""
from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from tabred import oracle
from tabred.catalog import register
from tabred.catalog.graph import tpch_graph, g
from tabred.functions import exact as X, tokens as K
from tabred.operators import compare as C, evaluate as E, validate as VAL
from tabred.plans import sweep, tpch
from tabred.plans.joins import join_parts, role_part
from tabred.plans.graphs import query_links
from tabred.sources.tables import load_tables, tpch_view

V = oracle.with_views
c = F.col


def select(name, table, columns, sql: str, where: str | None = None):
    """Register a projection of one view table; ``columns`` builds the expressions once a session runs."""
    def fn(s, d):
        df = tpch_view(s, d)[table]
        df = df if where is None else df.where(where)
        return df.select(*[e.alias(n) for n, e in columns().items()])
    register(name, fn, V(sql))


def keys():
    return {k: c(k) for k in _lk}


def tpch_day():
    return c("o_orderdate").cast("date")


def words():
    return F.split("p_name", " ")


def price():
    return X.hundredths("l_extendedprice")


# -- S1 -----------------------------------------------------------------------------------------
register("s1_parquet_scan", lambda s, d: load_tables(s, d, "customer")["customer"].where("c_nationkey = 3").select("c_custkey", "c_name"),
         "select c_custkey, c_name from customer where c_nationkey = 3")
# -- P: expressions ---------------------------------------------------------------------------------------
_lk = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
_lks = ", ".join(_lk)
select("p1_revenue_expressions", "lineitem", lambda: {**keys(), "revenue": X.revenue_units() / 10000.0, "charge": X.charge_units() / 1000000.0},
       f"select {_lks}, {oracle.REV} / 10000.0 as revenue, {oracle.CHARGE} / 1000000.0 as charge from v_lineitem")
select("p2_date_arithmetic", "orders", lambda: {"o_orderkey": c("o_orderkey"), "minus_90": F.date_sub(tpch_day(), 90), "plus_3_months": F.add_months(tpch_day(), 3), "plus_1_year": F.add_months(tpch_day(), 12)},
       """select o_orderkey, o_orderdate - 90 as minus_90, cast(o_orderdate + interval 3 month as date) as plus_3_months, cast(o_orderdate + interval 1 year as date) as plus_1_year from v_orders""")
select("p3_year", "orders", lambda: {"o_orderkey": c("o_orderkey"), "y": F.year("o_orderdate").cast("long")}, "select o_orderkey, cast(year(o_orderdate) as bigint) as y from v_orders")
select("p4_text_tests", "part", lambda: {"p_partkey": c("p_partkey"), "ends": c("p_type").endswith("MO"), "starts": c("p_type").startswith("PRO"), "has": c("p_name").contains("blue")},
       "select p_partkey, p_type like '%MO' as ends, starts_with(p_type, 'PRO') as starts, contains(p_name, 'blue') as has from part")
select("p5_regex_full_match", "supplier", lambda: {"s_suppkey": c("s_suppkey"), "hit": c("s_comment").rlike("^.*Customer.*Complaints.*$")},
       "select s_suppkey, regexp_full_match(s_comment, '.*Customer.*Complaints.*') as hit from v_supplier")
select("p6_two_word_pattern", "orders", lambda: {"o_orderkey": c("o_orderkey"), "hit": tpch.like_two_words(c("o_comment"), "%special%requests%")},
       "select o_orderkey, o_comment like '%special%requests%' as hit from v_orders")
select("p7_substring", "customer", lambda: {"c_custkey": c("c_custkey"), "code": F.substring("c_phone", 1, 2)}, "select c_custkey, substr(c_phone, 1, 2) as code from v_customer")
select("p8_in_list", "part", lambda: {"p_partkey": c("p_partkey")}, "select p_partkey from part where p_size in (1, 5, 9, 22)", "p_size in (1, 5, 9, 22)")
select("p9_null_default", "supplier", lambda: {"s_suppkey": c("s_suppkey"), "missing": F.nullif(c("s_suppkey") % 3, F.lit(0)).isNull(), "value": F.coalesce(F.nullif(c("s_suppkey") % 3, F.lit(0)), F.lit(-1))},
       "select s_suppkey, nullif(s_suppkey % 3, 0) is null as missing, coalesce(nullif(s_suppkey % 3, 0), -1) as value from supplier")
select("p10_case_when", "orders", lambda: {"o_orderkey": c("o_orderkey"), "high": F.when(c("o_orderpriority").isin("1-URGENT", "2-HIGH"), 1).otherwise(0)},
       "select o_orderkey, case when o_orderpriority in ('1-URGENT', '2-HIGH') then 1 else 0 end as high from orders")
select("p11_integer_percent", "lineitem", lambda: {**keys(), "near": F.abs(X.hundredths("l_discount") - 6) <= 1},
       f"select {_lks}, abs({oracle.cents('l_discount')} - 6) <= 1 as near from lineitem")
select("p12_replace", "part", lambda: {"p_partkey": c("p_partkey"), "name": F.replace("p_name", F.lit(" "), F.lit(""))}, "select p_partkey, replace(p_name, ' ', '') as name from part")
select("p13_list_operations", "part", lambda: {"p_partkey": c("p_partkey"), "kept": F.size(F.filter(words(), lambda w: w != "")), "tail": F.array_join(F.slice(words(), 2, 100), " "),
                                       "any_o": F.exists(words(), lambda w: w.contains("o"))},
       """select p_partkey, cast(len(list_filter(string_split(p_name, ' '), lambda w: w <> '')) as int) as kept, array_to_string(string_split(p_name, ' ')[2:], ' ') as tail,
          len(list_filter(string_split(p_name, ' '), lambda w: contains(w, 'o'))) > 0 as any_o from part""")
select("p14_concat_lists", "part", lambda: {"p_partkey": c("p_partkey"), "all": F.array_join(F.aggregate(F.array(words(), F.array("p_brand")), F.array().cast("array<string>"), lambda a, b: F.concat(a, b)), "/"),
                                    "flat": F.size(F.flatten(F.array(words(), F.array("p_brand"))))},
       """select p_partkey, array_to_string(list_concat(string_split(p_name, ' '), [p_brand]), '/') as "all", cast(len(list_concat(string_split(p_name, ' '), [p_brand])) as int) as flat from part""")
register("p15_structs_and_unwind",
         lambda s, d: tpch_view(s, d)["orders"].select("o_orderkey", F.inline(F.array(F.struct(F.lit("status").alias("field"), c("o_orderstatus").alias("value")),
                                                                                      F.struct(F.lit("priority").alias("field"), c("o_orderpriority").alias("value"))))),
         "select o_orderkey, 'status' as field, o_orderstatus as value from orders union all select o_orderkey, 'priority', o_orderpriority from orders")
register("p16_property_bag",
         lambda s, d: tpch_view(s, d)["supplier"].withColumn("s_phone", F.when(c("s_suppkey") % 2 == 0, c("s_phone")))
         .select("s_suppkey", F.array_join(F.sort_array(F.map_keys(K.property_bag(tpch_view(s, d)["supplier"], ["s_name", "s_phone"]))), ",").alias("keys")),
         "select s_suppkey, case when s_suppkey % 2 = 0 then 's_name,s_phone' else 's_name' end as keys from supplier")
select("p19_tokens", "part", lambda: {"p_partkey": c("p_partkey"), "tokens": F.array_join(K.tokens("Part", "p_name"), ";")},
       """select p_partkey, 'Part.p_name=' || lower(trim(p_name)) || ';' || array_to_string(list_transform(regexp_extract_all(lower(trim(p_name)), '\\w+'), lambda w: 'Part.p_name:word=' || w), ';') as tokens from part""")
register("p20_missing_token",
         lambda s, d: tpch_view(s, d)["part"].withColumn("tag", F.when(c("p_size") > 25, c("p_brand")))
         .select("p_partkey", F.array_join(K.tokens("Part", "tag", missing=K.MISSING), ";").alias("with_placeholder"), F.array_join(K.tokens("Part", "tag"), ";").alias("without")),
         """with t as (select p_partkey, case when p_size > 25 then lower(p_brand) end as v from part), u as (select p_partkey, coalesce(v, '<MISSING>') as w, v from t)
            select p_partkey, 'Part.tag=' || w || ';' || array_to_string(list_transform(regexp_extract_all(w, '\\w+'), lambda x: 'Part.tag:word=' || x), ';') as with_placeholder,
            case when v is null then '' else 'Part.tag=' || v || ';' || array_to_string(list_transform(regexp_extract_all(v, '\\w+'), lambda x: 'Part.tag:word=' || x), ';') end as without from u""")
select("p21_value_correction", "nation", lambda: {"n_nationkey": c("n_nationkey"), "n_name": K.correct("n_name")}, "select n_nationkey, n_name || ' [corrected]' as n_name from nation")
for _q in range(1, 23):
    _sets = sweep.parameter_sets(_q, 50, 20260818)
    register(f"p22_parameter_sweep_q{_q}", lambda s, d, q=_q, p=_sets: sweep.run_param_sweep(tpch_view(s, d), q, p),
             V("select * from (" + ") union all select * from (".join(f"select *, {i} as run from ({oracle.tpch(_q, p)})" for i, p in enumerate(_sets)) + ")"))

# -- J: joins -----------------------------------------------------------------------------------------------
_fk = "from v_lineitem join v_orders on l_orderkey = o_orderkey join v_customer on o_custkey = c_custkey"
register("j1_path_join", lambda s, d: join_parts([role_part(tpch_view(s, d), r) for r in ("L", "O", "C")], query_links(3)).frame.select(*_lk, "o_totalprice", "c_name"),
         V(f"select {_lks}, o_totalprice, c_name {_fk}"))
register("j2_composite_key_join", lambda s, d: join_parts([role_part(tpch_view(s, d), r) for r in ("L", "PS")], [(("l_partkey", "l_suppkey"), ("ps_partkey", "ps_suppkey"))]).frame.select(*_lk, "ps_availqty"),
         V(f"select {_lks}, ps_availqty from v_lineitem join v_partsupp on l_partkey = ps_partkey and l_suppkey = ps_suppkey"))
_fy = "(select * from orders where year(o_orderdate) = 1996)"


def orders_1996(s, d):
    return tpch_view(s, d)["orders"].where(tpch.in_months("o_orderdate", "1996-01-01", 12))


register("j3_left_outer_join", lambda s, d: tpch_view(s, d)["customer"].join(orders_1996(s, d), c("c_custkey") == c("o_custkey"), "left").select("c_custkey", "o_orderkey"),
         f"select c_custkey, o_orderkey from customer left join {_fy} on c_custkey = o_custkey")
register("j4_semi_join", lambda s, d: tpch_view(s, d)["customer"].join(orders_1996(s, d), c("c_custkey") == c("o_custkey"), "left_semi").select("c_custkey"),
         f"select c_custkey from customer where c_custkey in (select o_custkey from {_fy})")
register("j5_anti_join", lambda s, d: tpch_view(s, d)["customer"].join(orders_1996(s, d), c("c_custkey") == c("o_custkey"), "left_anti").select("c_custkey"),
         f"select c_custkey from customer where c_custkey not in (select o_custkey from {_fy})")


def other_supplier(s, d, keep):
    l = tpch_view(s, d)["lineitem"]
    ends = l.groupBy(c("l_orderkey").alias("k")).agg(F.min("l_suppkey").alias("lo"), F.max("l_suppkey").alias("hi"))
    return l.join(ends.where(c("lo") != c("hi") if keep else c("lo") == c("hi")), c("l_orderkey") == c("k"), "left_semi").select(*_lk)


_exists = "exists (select 1 from lineitem b where b.l_orderkey = a.l_orderkey and b.l_suppkey <> a.l_suppkey)"
register("j6_semi_with_inequality", lambda s, d: other_supplier(s, d, True), f"select {_lks} from lineitem a where {_exists}")
register("j6_anti_with_inequality", lambda s, d: other_supplier(s, d, False), f"select {_lks} from lineitem a where not {_exists}")


def small_lines(s, d):
    l = tpch_view(s, d)["lineitem"]
    return l.join(l.groupBy(c("l_partkey").alias("k")).agg((0.5 * F.avg("l_quantity")).alias("b")), (c("l_partkey") == c("k")) & (c("l_quantity") < c("b"))).select(*_lk)


register("j7_rejoin_with_aggregate", small_lines, f"select {_lks} from lineitem join (select l_partkey as k, 0.5 * avg(l_quantity) as b from lineitem group by 1) on l_partkey = k and l_quantity < b")
register("j8_scalar_broadcast", lambda s, d: tpch_view(s, d)["customer"].where(c("c_acctbal") > tpch_view(s, d)["customer"].agg(X.exact_avg(X.hundredths("c_acctbal"), 2)).scalar()).select("c_custkey"),
         f"select c_custkey from customer where c_acctbal > (select {oracle.total(oracle.cents('c_acctbal'), 2)} / count(*) from customer)")
register("j9_cycle_join", lambda s, d: join_parts([role_part(tpch_view(s, d), r) for r in ("L", "O", "C", "S", "N")], query_links(5)).frame.select(*_lk, "n_name"),
         V(f"select {_lks}, n_name {_fk} join v_supplier on s_suppkey = l_suppkey and s_nationkey = c_nationkey join v_nation on n_nationkey = s_nationkey"))
register("j10_disjunctive_join", lambda s, d: tpch.relation(tpch_view(s, d), 19).where(((c("p_size") < 5) & (c("l_quantity") < 10)) | ((c("p_size") > 45) & (c("l_quantity") > 40))).select(*_lk),
         f"select {_lks} from lineitem join part on l_partkey = p_partkey where (p_size < 5 and l_quantity < 10) or (p_size > 45 and l_quantity > 40)")
register("j11_value_join", lambda s, d: tpch_view(s, d)["lineitem"].join(tpch_view(s, d)["supplier"], c("l_suppkey") == c("s_suppkey")).select(*_lk, "s_name"),
         f"select {_lks}, s_name from lineitem join supplier on l_suppkey = s_suppkey")
register("j16_cycle_closing_predicates", lambda s, d: join_parts([role_part(tpch_view(s, d), r) for r in ("S", "N", "R")], query_links(2)).frame.select("s_suppkey", "n_name", "r_name"),
         "select s_suppkey, n_name, r_name from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey")

# -- A: aggregates ---------------------------------------------------------------------------------------------
register("a1_grouped_aggregates", lambda s, d: tpch_view(s, d)["lineitem"].groupBy("l_returnflag").agg(X.exact_sum(price(), 2).alias("s"), F.avg("l_quantity").alias("a"),
         F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi"), F.count(F.lit(1)).alias("n")),
         f"select l_returnflag, {oracle.total(oracle.cents('l_extendedprice'), 2)} as s, avg(l_quantity) as a, min(l_quantity) as lo, max(l_quantity) as hi, count(*) as n from lineitem group by 1")
register("a2_count_distinct", lambda s, d: tpch_view(s, d)["lineitem"].groupBy("l_returnflag").agg(F.countDistinct("l_suppkey").alias("suppliers")),
         "select l_returnflag, count(distinct l_suppkey) as suppliers from lineitem group by 1")
register("a3_conditional_sum", lambda s, d: tpch_view(s, d)["orders"].groupBy("o_orderstatus").agg(F.sum(F.when(c("o_orderpriority") == "1-URGENT", 1).otherwise(0)).alias("urgent")),
         "select o_orderstatus, cast(sum(case when o_orderpriority = '1-URGENT' then 1 else 0 end) as bigint) as urgent from orders group by 1")
register("a4_null_on_empty", lambda s, d: tpch_view(s, d)["lineitem"].where("l_quantity > 1000").agg(X.exact_sum(price(), 2).alias("total"), F.count(F.lit(1)).alias("n")),
         "select cast(null as double) as total, count(*) as n from lineitem where l_quantity > 1000")
register("a5_having", lambda s, d: tpch_view(s, d)["orders"].groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).where(c("n") > 14), "select o_custkey, count(*) as n from orders group by 1 having count(*) > 14")
register("a6_two_level", lambda s, d: tpch_view(s, d)["orders"].groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("customers")),
         "select n, count(*) as customers from (select count(*) as n from orders group by o_custkey) group by 1")
register("a7_ratio_of_sums", lambda s, d: tpch_view(s, d)["lineitem"].groupBy("l_returnflag").agg((X.exact_sum(F.when(c("l_shipmode") == "AIR", price()).otherwise(F.lit(0)), 2) / X.exact_sum(price(), 2)).alias("share")),
         V(f"""select l_returnflag, {oracle.total("case when l_shipmode = 'AIR' then " + oracle.cents('l_extendedprice') + " else 0 end", 2)} / {oracle.total(oracle.cents('l_extendedprice'), 2)} as share from v_lineitem group by 1"""))
register("a8_single_variant", lambda s, d: tpch_view(s, d)["orders"].groupBy("o_custkey").agg((F.min(F.struct("o_orderstatus", "o_orderpriority")) == F.max(F.struct("o_orderstatus", "o_orderpriority"))).alias("one")),
         "select o_custkey, count(distinct (o_orderstatus, o_orderpriority)) = 1 as one from orders group by 1")
register("a9_group_by_identity", lambda s, d: tpch_view(s, d)["orders"].join(tpch_view(s, d)["customer"], c("o_custkey") == c("c_custkey")).groupBy("c_custkey").agg(F.first("c_name").alias("c_name"), F.count(F.lit(1)).alias("n")),
         "select c_custkey, c_name, count(*) as n from orders join customer on o_custkey = c_custkey group by 1, 2")
register("a10_distinct", lambda s, d: tpch_view(s, d)["lineitem"].select("l_partkey", "l_suppkey").distinct(), "select distinct l_partkey, l_suppkey from lineitem")
_stats = ("median", "mean", "sd", "q1", "q3", "low", "high")
register("a11_summary_statistics", lambda s, d: E.summarise(s.read.parquet(f"{d}/events.parquet"), ["event_type"], "value").select("event_type", *[F.round(x, 6).alias(x) for x in _stats]),
         """select event_type, round(quantile_cont(value, 0.5), 6) as median, round(avg(value), 6) as mean, round(stddev_samp(value), 6) as sd, round(quantile_cont(value, 0.25), 6) as q1,
            round(quantile_cont(value, 0.75), 6) as q3, round(min(value), 6) as low, round(max(value), 6) as high from events group by 1""")
register("a12_macro_mean", lambda s, d: s.read.parquet(f"{d}/events.parquet").groupBy("event_type", "user_id").agg(F.avg("value").alias("m")).groupBy("event_type").agg(F.round(F.avg("m"), 6).alias("macro")),
         "select event_type, round(avg(m), 6) as macro from (select event_type, user_id, avg(value) as m from events group by 1, 2) group by 1")

# -- W, O: windows, order, comparison ---------------------------------------------------------------------------
register("w1_order_check", lambda s, d: C.check_order(s.read.parquet(f"{d}/events.parquet").select("event_id", "user_id", "value"), "event_id", [("user_id", True), ("value", False)]),
         """select event_id, user_id, value from (select event_id, user_id, value, lag(user_id) over (order by event_id) as pu, lag(value) over (order by event_id) as pv from events)
            where user_id > pu or (user_id = pu and value < pv)""")
register("w2_representative", lambda s, d: tpch_view(s, d)["orders"].withColumn("r", F.row_number().over(W.partitionBy("o_custkey").orderBy("o_totalprice", "o_orderkey"))).where("r = 1").select("o_custkey", "o_orderkey"),
         "select o_custkey, arg_min(o_orderkey, (o_totalprice, o_orderkey)) as o_orderkey from orders group by 1")
register("o1_order_by", lambda s, d: tpch_view(s, d)["customer"].select("c_custkey", "c_mktsegment", "c_acctbal").orderBy(F.desc_nulls_last("c_acctbal"), F.asc_nulls_last("c_custkey")),
         "select c_custkey, c_mktsegment, c_acctbal from customer order by c_acctbal desc, c_custkey")
register("o2_top_k", lambda s, d: C.top_k(tpch_view(s, d)["orders"].select("o_orderkey", "o_totalprice"), [("o_totalprice", True)], 25, "o_orderkey"),
         "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 25")
register("o3_bounded_count", lambda s, d: C.bounded_count(tpch_view(s, d)["orders"], 1000), "select cast(null as bigint) as rows, true as over_limit from (select count(*) as n from orders) where n > 1000")
register("o3_bounded_count_exact", lambda s, d: C.bounded_count(tpch_view(s, d)["customer"], 1_000_000), "select count(*) as rows, false as over_limit from customer")


def shifted(s, d, step):
    return tpch_view(s, d)["customer"].select("c_mktsegment", (c("c_acctbal") * (1 + step)).alias("c_acctbal"))


register("o4_compare_equal_within_tolerance", lambda s, d: C.compare_results(shifted(s, d, 0.0), shifted(s, d, 1e-12)), "select true as equal, cast(0 as bigint) as unmatched from customer limit 1")
register("o4_compare_unequal", lambda s, d: C.compare_results(shifted(s, d, 0.0), shifted(s, d, 1e-3)).select("equal"), "select false as equal from customer limit 1")
register("o5_union_components", lambda s, d: tpch_view(s, d)["customer"].select(c("c_custkey").alias("id"), c("c_mktsegment").alias("segment")).unionByName(
    tpch_view(s, d)["supplier"].select(c("s_suppkey").alias("id"), c("s_acctbal").alias("balance")), allowMissingColumns=True),
         "select c_custkey as id, c_mktsegment as segment, cast(null as double) as balance from customer union all select s_suppkey, null, s_acctbal from supplier")
register("o6_key_difference", lambda s, d: C.diff_keys(tpch_view(s, d)["orders"].select(c("o_orderkey").alias("k")), tpch_view(s, d)["lineitem"].select(c("l_orderkey").alias("k"))),
         "select o_orderkey as k, 'missing' as side from orders where o_orderkey not in (select l_orderkey from lineitem)")

# -- V: checks ---------------------------------------------------------------------------------------------------
register("v1_primary_key_violations", lambda s, d: VAL.check_primary_key(tpch_view(s, d)["lineitem"], ["l_orderkey", "l_linenumber"]),
         "select l_orderkey || '|' || l_linenumber as key, 'duplicate key' as problem, count(*) as rows from lineitem group by 1 having count(*) > 1")
register("v2_foreign_key_orphans", lambda s, d: VAL.check_foreign_key(tpch_view(s, d)["orders"], tpch_view(s, d)["lineitem"].select("l_orderkey").distinct(), ["o_orderkey"], ["l_orderkey"]),
         "select o_orderkey::varchar as key, count(*) as rows from orders where o_orderkey not in (select l_orderkey from lineitem) group by 1")
register("v3_duplicate_edges", lambda s, d: VAL.check_duplicate_edges(tpch_view(s, d)["lineitem"].select(c("l_orderkey").alias("src"), c("l_suppkey").alias("dst"))),
         "select l_orderkey as src, l_suppkey as dst, count(*) as copies from lineitem group by 1, 2 having count(*) > 1")
register("v4_build_edges_composite", lambda s, d: VAL.build_edges(tpch_view(s, d)["lineitem"], tpch_view(s, d)["partsupp"], list(_lk), ["l_partkey", "l_suppkey"], ["ps_partkey", "ps_suppkey"], "L_PS"),
         "select concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber) as src, concat_ws('|', l_partkey, l_suppkey) as dst, 'L_PS' as type from lineitem")
register("v5_out_degree", lambda s, d: VAL.check_out_degree(tpch_graph(s, d)[0].where("label <> 'R'").select("id", F.when(c("label") == "O", "O_C").when(c("label") == "C", "C_N").when(c("label") == "S", "S_N").otherwise("N_R").alias("type")), tpch_graph(s, d)[1]),
         g("select type, count(distinct src) as sources, count(*) as edges, cast(0 as bigint) as invalid from g_edges group by 1"))
register("v6_reconcile_counts", lambda s, d: VAL.reconcile_counts(tpch_view(s, d)["orders"].groupBy(c("o_custkey").alias("name")).agg(F.count(F.lit(1)).alias("n")),
                                                                  orders_1996(s, d).groupBy(c("o_custkey").alias("name")).agg(F.count(F.lit(1)).alias("n"))),
         f"""select o_custkey as name, a as actual, e as expected from (select o_custkey, count(*) as a from orders group by 1) left join (select o_custkey, count(*) as e from {_fy} group by 1) using (o_custkey)
             where a is distinct from e""")
register("v7_state_counts", lambda s, d: VAL.state_counts({"customer": load_tables(s, d, "customer")["customer"], "orders": tpch_view(s, d)["customer"].select("c_custkey").join(orders_1996(s, d).select("o_orderkey", "o_custkey"), c("c_custkey") == c("o_custkey"), "left")}),
         f"""select 'customer' as "table", count(*) as rows, count(*) * 5 as cells from customer union all
             select 'orders', count(*), count(c_custkey) + count(o_orderkey) + count(o_custkey) from customer left join {_fy} on c_custkey = o_custkey""")
