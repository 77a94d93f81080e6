"""Folding, unfolding, updates, dependencies and splitting on the driver tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from tabred import oracle
from tabred.catalog import register
from tabred.operators import fds, fold, normalize, updates
from tabred.schemas import KEYS, REFERENCES, TABLE_OF, mask_codes, mask_of
from tabred.sources.tables import tpch_view

TWICE = mask_of("L_PS", "L_O", "PS_S", "O_C", "C_N", "S_N")
ORDERS = mask_of("O_C", "C_N", "N_R")
LINES = mask_of("L_O", "O_C", "C_N", "N_R")
SUPPLY = mask_of("PS_S", "S_N", "N_R")
ALL = 255
V = oracle.with_views


def view(code: str) -> str:
    return f"v_{TABLE_OF[code]}"


def fold_sql(root: str, mask: int, columns: list[str] | None = None) -> str:
    """Flat rows of a root as SQL."""
    layout = fold.Layout(root, mask_codes(mask))
    items = [f"{layout.token(p)}.{col} as {out}" for p in layout.paths for col, out in layout.stored(p).items() if columns is None or out in columns]
    text = f"{view(root)} {root}"
    for p in layout.paths[1:]:
        on = " and ".join(f"{layout.token(p[:-1])}.{f} = {layout.token(p)}.{k}" for k, f in layout.by_reference(p).items())
        text += f" join {view(layout.end(p))} {layout.token(p)} on {on}"
    return f"select {', '.join(items)} from {text}"


def text_sql(cols) -> str:
    return "concat_ws('|', " + ", ".join(cols) + ")"


def t_(s, d):
    return tpch_view(s, d)


# -- D: de-normalise and normalise -----------------------------------------------------------------
_twice = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "o_custkey", "c_name", "s_name", "n_name__n__l_ps__ps_s__s_n",
          "n_name__n__l_o__o_c__c_n", "n_regionkey__n__l_o__o_c__c_n", "ps_availqty"]
register("d1_fold_nation_twice", lambda s, d: fold.fold(t_(s, d), TWICE)["L"].select(*_twice), V(fold_sql("L", TWICE, _twice)))
_orders = ["o_orderkey", "o_custkey", "o_totalprice", "c_name", "c_nationkey", "n_name", "n_regionkey", "r_name"]
register("d1_fold_orders", lambda s, d: fold.fold(t_(s, d), ORDERS)["O"].select(*_orders), V(fold_sql("O", ORDERS, _orders)))


def lineage_sql(mask: int) -> str:
    parts = []
    for root in fold.folded_roots(mask_codes(mask)):
        layout = fold.Layout(root, mask_codes(mask))
        for p in layout.paths:
            parts.append(f"select '{root}' as root, {text_sql(layout.keys(()))} as row_key, '{layout.token(p)}' as token, "
                         f"{text_sql(layout.keys(p))} as source_key from ({fold_sql(root, mask)})")
    return " union all ".join(parts)


register("d2_fold_lineage", lambda s, d: fold.fold_lineage(t_(s, d), ORDERS), V(lineage_sql(ORDERS)))


def inherited_sql(mask: int) -> str:
    codes, parts = mask_codes(mask), []
    for root in fold.roots(codes):
        for ref, columns in fold.Layout(root, codes).open_references():
            parts.append(f"select '{ref.code}' as type, '{root}' as source_root, {text_sql(KEYS[root])} as source_key, "
                         f"'{ref.target}' as target_root, {text_sql(columns)} as target_key from ({fold_sql(root, mask)})")
    return " union all ".join(parts)


register("d3_inherited_edges", lambda s, d: fold.inherited_edges(t_(s, d), SUPPLY), V(inherited_sql(SUPPLY)))
register("d4_unfold_customer", lambda s, d: fold.unfold(fold.fold(t_(s, d), ORDERS), ORDERS)["C"],
         V(f"select {', '.join(fold.COLUMNS['C'])} from v_customer where c_custkey in (select o_custkey from orders)"))
register("d4_rebuilt_edges", lambda s, d: fold.rebuilt_edges(fold.unfold(fold.fold(t_(s, d), ORDERS), ORDERS)),
         V("""select 'O_C' as type, o_orderkey::varchar as source_key, o_custkey::varchar as target_key from orders
              union all select 'C_N', c_custkey::varchar, c_nationkey::varchar from customer where c_custkey in (select o_custkey from orders)
              union all select 'N_R', n_nationkey::varchar, n_regionkey::varchar from nation"""))
register("d5_lossless_orders", lambda s, d: fold.check_lossless(t_(s, d), ORDERS),
         "select * from (values ('O', cast(0 as bigint)), ('C', 0), ('N', 0), ('R', 0)) t(\"table\", differing)")
register("d5_lossless_nation_twice", lambda s, d: fold.check_lossless(t_(s, d), TWICE),
         "select * from (values ('L', cast(0 as bigint)), ('PS', 0), ('O', 0), ('S', 0), ('C', 0), ('N', 0)) t(\"table\", differing)")


def delta_sql(mask: int) -> str:
    codes = mask_codes(mask)
    folded = fold.folded_roots(codes)
    gone = folded + [c for c in TABLE_OF if c not in fold.roots(codes)]
    filled = lambda cols: " + ".join(f"cast({c} is not null as bigint)" for c in cols)
    parts = []
    for r in folded:
        layout = fold.Layout(r, codes)
        outs = [o for p in layout.paths for o in layout.stored(p).values()]
        parts.append(f"select count(*) as n, 0 as e, sum({filled(outs)}) as k from ({fold_sql(r, mask)})")
    for c in gone:
        parts.append(f"select -count(*), 0, -sum({filled(fold.COLUMNS[c])}) from {view(c)}")
    for ref in REFERENCES:
        parts.append(f"select 0, -count(*), 0 from {view(ref.source)}")
    for r in fold.roots(codes):
        times = len(fold.Layout(r, codes).open_references())
        if times:
            parts.append(f"select 0, {times} * count(*), 0 from ({fold_sql(r, mask)})")
    return (f"select {mask} as mask, cast(sum(n) as bigint) as delta_nodes, cast(sum(e) as bigint) as delta_edges, "
            f"cast(sum(k) as bigint) as delta_cells from ({' union all '.join(parts)})")


for _n, _m in {"orders": ORDERS, "lines": LINES, "nation_twice": TWICE, "all": ALL}.items():
    register(f"d6_structural_delta_{_n}", lambda s, d, m=_m: fold.structural_delta(t_(s, d), m), V(delta_sql(_m)))


def deltas_sql() -> str:
    """Every root folded in every way, counted in its flat rows; a mask takes the ways of its own roots."""
    totals, taken = [], []
    for root in TABLE_OF:
        reach = fold.reach(root)
        for way in sorted({m & reach for m in range(256)}):
            layout = fold.Layout(root, mask_codes(way))
            outs = [o for p in layout.paths for o in layout.stored(p).values()]
            filled = " + ".join(f"cast({c} is not null as bigint)" for c in outs)
            totals.append(f"select '{root}' as root, {way} as way, count(*) as n, {len(layout.open_references())} * count(*) as e, sum({filled}) as k from ({fold_sql(root, way)})")
    for mask in range(256):
        taken += [f"({mask}, '{r}', {mask & fold.reach(r)}, 1)" for r in fold.roots(mask_codes(mask))] + [f"({mask}, '{r}', 0, -1)" for r in TABLE_OF]
    return (f"select mask, cast(sum(sign * n) as bigint) as delta_nodes, cast(sum(sign * e) as bigint) as delta_edges, cast(sum(sign * k) as bigint) as delta_cells "
            f"from (values {', '.join(taken)}) x(mask, root, way, sign) join ({' union all '.join(totals)}) using (root, way) group by mask")


register("d6_structural_deltas_all_masks", lambda s, d: fold.all_structural_deltas(t_(s, d)), V(deltas_sql()))


def _short(df, prefix):
    return df.select(*[F.col(c).alias(c.removeprefix(prefix)) for c in df.columns])


register("d7_fold_edge", lambda s, d: fold.fold_edge(_short(t_(s, d)["customer"], "c_"), _short(t_(s, d)["nation"], "n_"), ["nationkey"], ["nationkey"]),
         V("""select c_custkey as custkey, c_name as name, c_nationkey as nationkey, c_acctbal as acctbal, c_mktsegment as mktsegment,
              c_address as address, c_phone as phone, c_comment as comment, n_name as parent_name, n_regionkey as regionkey, n_comment as parent_comment
              from v_customer join v_nation on c_nationkey = n_nationkey"""))


def tpch_edges(t):
    """Edges O_C, C_N, S_N, N_R as one frame: [type, src_label, src, dst_label, dst]."""
    from functools import reduce
    from pyspark.sql import DataFrame
    parts = [t[TABLE_OF[r.source]].select(F.lit(r.code).alias("type"), F.lit(r.source).alias("src_label"),
                                          F.col(KEYS[r.source][0]).cast("long").alias("src"), F.lit(r.target).alias("dst_label"),
                                          F.col(r.fields[0]).cast("long").alias("dst"))
             for r in REFERENCES if r.code in ("O_C", "C_N", "S_N", "N_R")]
    return reduce(DataFrame.unionAll, parts)


register("d8_rewire_edges",
         lambda s, d: fold.rewire_edges(tpch_edges(t_(s, d)), t_(s, d)["customer"].select(F.col("c_custkey").alias("child"), F.col("c_nationkey").cast("long").alias("parent")),
                                        "C", "N", "CN", "C_N"),
         """select 'O_C' as type, 'O' as src_label, o_orderkey as src, 'CN' as dst_label, o_custkey as dst from orders
            union all select 'S_N', 'S', s_suppkey, 'CN', c_custkey from supplier join customer on s_nationkey = c_nationkey
            union all select 'N_R', 'CN', c_custkey, 'R', n_regionkey from customer join nation on c_nationkey = n_nationkey""")
ORDER_INFO = """select o_orderkey, o_custkey, o_orderpriority, o_orderstatus, c_mktsegment, c_nationkey, n_name, n_regionkey, r_name
    from v_orders join v_customer on o_custkey = c_custkey join v_nation on c_nationkey = n_nationkey join v_region on n_regionkey = r_regionkey"""
_info = ["o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus", "c_mktsegment", "c_nationkey", "n_name", "n_regionkey", "r_name"]


def order_info(s, d):
    return fold.fold_root(t_(s, d), "O", mask_codes(ORDERS)).select(*_info)


register("d9_split_by_fd_dimension", lambda s, d: fds.split_by_fd(order_info(s, d), "c_nationkey", ["n_name", "n_regionkey"])[1],
         V(f"select distinct c_nationkey, n_name, n_regionkey from ({ORDER_INFO})"))
register("d9_split_by_fd_fact", lambda s, d: fds.split_by_fd(order_info(s, d), "o_custkey", ["c_mktsegment", "o_orderstatus"])[0]
         .select("o_orderkey", "o_custkey", "c_mktsegment", "o_orderstatus", "ref_o_custkey"),
         V(f"""with i as ({ORDER_INFO}), ok as (select o_custkey as k from i group by 1 having count(*) >= 2
               and count(distinct o_orderstatus) = 1 and count(distinct c_mktsegment) = 1)
               select o_orderkey, case when k is null then o_custkey end as o_custkey, case when k is null then c_mktsegment end as c_mktsegment,
               case when k is null then o_orderstatus end as o_orderstatus, k as ref_o_custkey from i left join ok on o_custkey = k"""))
register("d10_split_by_reference",
         lambda s, d: fold.split_by_reference(t_(s, d)["customer"].select(F.col("c_custkey").alias("id"), (F.col("c_nationkey") % 5).alias("region")),
                                              t_(s, d)["customer"].select(F.col("c_custkey").alias("src"), F.col("c_nationkey").alias("dst")), "region", "customer"),
         """select c_nationkey as dst, cast(min(c_nationkey % 5) as varchar) as region_customer, count(*) as fanout from customer
            group by 1 having count(*) >= 2""")
register("d11_copies_per_key", lambda s, d: fold.copies_per_key(t_(s, d), TWICE, "N"),
         V(f"""select k as n_nationkey, cast(count(*) as bigint) as copies from (select c_nationkey as k from ({fold_sql('L', TWICE)})
               union all select s_nationkey from ({fold_sql('L', TWICE)})) group by 1"""))


def copies_sql(table: str) -> str:
    """Copies of every key in the flat rows of every root folded in every way; a mask takes the ways of its folded roots."""
    totals, taken = [], []
    for root in TABLE_OF:
        for way in sorted({m & fold.reach(root) for m in range(256)}):
            layout = fold.Layout(root, mask_codes(way))
            for p in layout.places(table):
                cols = [layout.column(p, k) for k in KEYS[table]]
                totals.append(f"select '{root}' as root, {way} as way, {', '.join(f'{c} as {k}' for c, k in zip(cols, KEYS[table]))}, count(*) as n "
                              f"from ({fold_sql(root, way, cols)}) group by all")
    for mask in range(256):
        taken += [f"({mask}, '{r}', {mask & fold.reach(r)})" for r in fold.folded_roots(mask_codes(mask))]
    keys = ", ".join(KEYS[table])
    return (f"select mask, {keys}, cast(sum(n) as bigint) as copies from (values {', '.join(taken)}) x(mask, root, way) "
            f"join ({' union all '.join(totals)}) using (root, way) group by mask, {keys}")


register("d11_copies_per_key_all_masks", lambda s, d: fold.all_copies_per_key(t_(s, d), "N"), V(copies_sql("N")))

# -- U: updates ------------------------------------------------------------------------------------
WORKLOAD_SQL = """with rows as (select {key}, {column} as a0 from v_{table} where {key} in (select {field} from v_{child}) order by {key} limit {count}),
    placed as (select *, row_number() over (order by {key}) as place, count(*) over () as n from rows),
    vals as (select a0 as value, row_number() over (order by md5('7:' || a0)) as rank, count(*) over () as v from (select distinct a0 from rows))
    select o.i::int as ordinal, {key}, a0, f.value as a1 from range(1, {count} + 1) o(i) join placed p on (o.i - 1) % p.n + 1 = p.place
    join vals w on p.a0 = w.value join vals f on w.rank % w.v + 1 = f.rank"""
register("u1_update_workload", lambda s, d: updates.update_workload(t_(s, d), "C", 50, 7),
         V(WORKLOAD_SQL.format(key="c_custkey", column="c_comment", table="customer", field="o_custkey", child="orders", count=50)))
register("u1_update_workload_region", lambda s, d: updates.update_workload(t_(s, d), "R", 50, 7),
         V(WORKLOAD_SQL.format(key="r_regionkey", column="r_comment", table="region", field="n_regionkey", child="nation", count=50)))


def batch(s, d):
    """One update for every nation row."""
    return t_(s, d)["nation"].select("n_nationkey", F.concat("n_comment", F.lit(" [corrected]")).alias("a1"),
                                     F.col("n_nationkey").alias("ordinal"))


register("u2_apply_to_fold", lambda s, d: updates.apply_to_fold(t_(s, d), ORDERS & ~mask_of("N_R"), "O", "N", batch(s, d))
         .select("o_orderkey", "n_comment"),
         V("""select o_orderkey, n_comment || ' [corrected]' as n_comment
              from v_orders join v_customer on o_custkey = c_custkey join v_nation on c_nationkey = n_nationkey"""))
register("u3_apply_to_table", lambda s, d: updates.apply_to_table(t_(s, d), "N", batch(s, d)).select("n_nationkey", "n_comment"),
         V("select n_nationkey, n_comment || ' [corrected]' as n_comment from v_nation"))
register("u4_touched_rows", lambda s, d: updates.touched_rows(t_(s, d), LINES, "N", batch(s, d)),
         V("""select n_nationkey as ordinal, n_nationkey, cast(count(l_orderkey) + 1 as bigint) as folded, cast(1 as bigint) as normalised
              from nation left join (customer join orders on c_custkey = o_custkey join lineitem on l_orderkey = o_orderkey) on c_nationkey = n_nationkey group by 1"""))
register("u4_touched_rows_all_masks", lambda s, d: updates.all_touched_rows(t_(s, d), "N", batch(s, d)),
         V(f"""select m.mask::int as mask, n_nationkey as ordinal, n_nationkey, coalesce(copies, 0) as folded, cast(1 as bigint) as normalised
               from nation cross join range(256) m(mask) left join ({copies_sql('N')}) using (mask, n_nationkey)"""))
register("u5_update_consistency", lambda s, d: updates.check_update(t_(s, d), TWICE, "L", "N", batch(s, d)), "select cast(0 as bigint) as differing")
register("u6_partial_update",
         lambda s, d: updates.partial_update(order_info(s, d), "c_nationkey", "n_name", "o_orderkey", 0.25, 11, " [corrected]").select("o_orderkey", "c_nationkey", "n_name"),
         V(f"""with i as ({ORDER_INFO}), r as (select *, row_number() over (partition by c_nationkey order by md5('11:' || o_orderkey)) as k,
               count(*) over (partition by c_nationkey) as n from i)
               select o_orderkey, c_nationkey, case when k <= ceil(n * 0.25) then n_name || ' [corrected]' else n_name end as n_name from r"""))


def samples(s, d):
    """Timing samples out of the event stream: clicks as folded, views as normalised updates."""
    e = s.read.parquet(f"{d}/events.parquet").where(F.col("event_type").isin("click", "view"))
    return e.select((F.col("user_id") % 8).alias("group"), F.col("user_id").alias("key"),
                    F.when(F.col("event_type") == "click", "folded").otherwise("normalised").alias("side"), F.col("value").alias("elapsed_ms"))


_cases = """select user_id % 8 as "group", user_id as key, quantile_cont(value, 0.5) filter (event_type = 'click') as f,
    quantile_cont(value, 0.5) filter (event_type = 'view') as n, f - n as saving_ms from events where event_type in ('click', 'view') group by 1, 2"""
register("u7_paired_times", lambda s, d: updates.pair_update_times(samples(s, d)),
         f"""select "group", count(*) as cases, min(saving_ms) as min_ms, quantile_cont(saving_ms, 0.5) as median_ms, max(saving_ms) as max_ms
             from ({_cases}) group by 1""")
register("u8_break_even", lambda s, d: updates.break_even(updates.pair_update_times(samples(s, d)).select(
    "group", F.col("median_ms").alias("saving_ms"), F.lit(5040.1).alias("normalization_ms"))),
         f"""select "group", saving_ms, 5040.1 as normalization_ms, case when saving_ms > 0 then cast(ceil(5040.1 / saving_ms) as bigint) end as kappa
             from (select "group", quantile_cont(saving_ms, 0.5) as saving_ms from ({_cases}) group by 1)""")

# -- F: functional dependencies ----------------------------------------------------------------------
register("f1_check_fd_fails", lambda s, d: fds.check_fd(t_(s, d)["part"], ["p_brand"], ["p_type"]),
         "select p_brand, count(*) as rows from part group by 1 having count(distinct p_type) > 1")
register("f1_check_fd_holds", lambda s, d: fds.check_fd(order_info(s, d), ["o_custkey"], ["c_mktsegment", "n_name"]).agg(F.count(F.lit(1)).alias("violating_groups")),
         "select cast(0 as bigint) as violating_groups")
register("f2_valid_groups", lambda s, d: fds.valid_groups(order_info(s, d), "o_custkey", ["o_orderstatus", "c_mktsegment"])
         .select("key", F.col("rhs.o_orderstatus").alias("o_orderstatus"), F.col("rhs.c_mktsegment").alias("c_mktsegment"), "fanout"),
         V(f"""select o_custkey as key, min(o_orderstatus) as o_orderstatus, min(c_mktsegment) as c_mktsegment, count(*) as fanout from ({ORDER_INFO})
               group by 1 having count(*) >= 2 and count(distinct o_orderstatus) = 1 and count(distinct c_mktsegment) = 1"""))
_groups = f"""select o_custkey as key, count(*) as fanout, count(distinct o_orderstatus) as v from ({ORDER_INFO}) group by 1"""
register("f3_fd_summary", lambda s, d: fds.fd_summary(order_info(s, d), "o_custkey", ["o_orderstatus"]),
         V(f"""select count(*) as groups, cast(sum(fanout) as bigint) as rows, count(*) filter (fanout >= 2 and v = 1) as valid_groups,
               cast(coalesce(sum(fanout) filter (fanout >= 2 and v = 1), 0) as bigint) as valid_rows, count(*) filter (v > 1) as conflicting_groups,
               cast(0 as bigint) as incomplete_groups from ({_groups})"""))
register("f4_redundancy", lambda s, d: fds.redundancy(order_info(s, d), "c_nationkey", ["n_name", "n_regionkey"]),
         V(f"""select count(*) as groups, cast(sum(n - 1) * 2 as bigint) as redundant_values from (select c_nationkey, count(*) as n from ({ORDER_INFO}) group by 1) where n >= 2"""))


def discovery_sql(source: str, columns: list[str]) -> str:
    """All pairs by brute force."""
    parts = []
    for x in columns:
        for y in columns:
            if x != y:
                parts.append(f"""select '{x}' as x, '{y}' as y, sum(n) as eligible, count(*) as dx, count(*) filter (n > 1) as rep,
                    coalesce(sum(n) filter (n > 1), 0) as inrep, max(v) as v, min(lo) <> max(hi) as varies, bool_or(lo <> x or hi <> x) as differs
                    from (select cast({x} as varchar) as x, count(*) as n, count(distinct {y}) as v, min(cast({y} as varchar)) as lo, max(cast({y} as varchar)) as hi
                    from src group by 1)""")
    return f"""with src as ({source}), p as ({' union all '.join(parts)}), tot as (select count(*) as total from src)
        select x, y, cast(eligible as bigint) as eligible_rows, eligible / total as coverage, dx as distinct_x, rep as repeated_groups,
        cast(inrep as bigint) as rows_in_repeated, cast(eligible - dx as bigint) as redundant_rows from p, tot
        where v = 1 and varies and differs and rep >= 3 and eligible >= greatest(20, ceil(total * 0.2))"""


register("f5_discover_fds", lambda s, d: fds.discover_fds(order_info(s, d)), V(discovery_sql(ORDER_INFO, _info)))
register("f11_ranked_fds", lambda s, d: fds.ranked(fds.discover_fds(order_info(s, d))), V(discovery_sql(ORDER_INFO, _info)))
_part_cols = ["p_name", "p_brand", "p_type", "p_size", "p_mfgr", "p_container"]
register("f5_discover_fds_part", lambda s, d: fds.discover_fds(t_(s, d)["part"].select(*_part_cols)),
         V(discovery_sql(f"select {', '.join(_part_cols)} from v_part", _part_cols)))


def event_cells(s, d):
    """Cells per event type: one row per user, so fields of a user have one or several values."""
    e = s.read.parquet(f"{d}/events.parquet").withColumn("hour", F.hour("ts")).withColumn("half", F.floor(F.hour("ts") / 12))
    return fds.cells_of(e.withColumn("k", F.get_json_object("props", "$.k")), F.col("event_type"), "user_id", ["k", "hour", "half"])


_cells = """select event_type as class, cast(user_id as varchar) as row, field, term from (
    select event_type, user_id, 'k' as field, json_extract_string(props, '$.k') as term from events union all
    select event_type, user_id, 'hour', cast(hour(ts) as varchar) from events union all
    select event_type, user_id, 'half', cast(hour(ts) // 12 as varchar) from events) where term is not null"""
register("f6_field_profile", lambda s, d: fds.field_profile(event_cells(s, d)),
         f"""with c as ({_cells}), per as (select class, row, field, count(distinct term) as n from c group by 1, 2, 3),
             tot as (select class, count(distinct row) as total from c group by 1)
             select class, field, count(*) filter (n = 1) as single, count(*) filter (n > 1) as multiple, any_value(total) - count(*) as missing
             from per join tot using (class) group by 1, 2""")


def order_cells(s, d):
    """Orders as entities, their status as class."""
    i = order_info(s, d)
    return fds.cells_of(i, F.col("o_orderstatus"), "o_orderkey", [c for c in _info if c not in ("o_orderkey", "o_orderstatus")])


def class_discovery_sql() -> str:
    cols = [c for c in _info if c not in ("o_orderkey", "o_orderstatus")]
    parts = []
    for x in cols:
        for y in cols:
            if x != y:
                parts.append(f"""select class, '{x}' as x, '{y}' as y, sum(n) as e, count(*) as dx, count(distinct lo) as dy, count(*) filter (n > 1) as rep,
                    coalesce(sum(n) filter (n > 1), 0) as inrep, max(v) as v, bool_or(lo <> x or hi <> x) as differs
                    from (select o_orderstatus as class, cast({x} as varchar) as x, count(*) as n, count(distinct {y}) as v, min(cast({y} as varchar)) as lo,
                    max(cast({y} as varchar)) as hi from src group by 1, 2) group by 1""")
    return f"""with src as ({ORDER_INFO}), p as ({' union all '.join(parts)}), tot as (select o_orderstatus as class, count(*) as total from src group by 1)
        select class, x, y, cast(e as bigint) as eligible_rows, e / total as coverage, dx as distinct_x, dy as distinct_y, rep as repeated_groups,
        cast(inrep as bigint) as rows_in_repeated, cast(e - dx as bigint) as redundant_rows from p join tot using (class)
        where v = 1 and dy >= 2 and differs and rep >= 3 and e >= greatest(20, ceil(total * 0.2))"""


register("f7_discover_by_class", lambda s, d: fds.discover_fds_by_class(order_cells(s, d)), V(class_discovery_sql()))
_sing = {"o_custkey": ["c_mktsegment", "c_nationkey", "n_name", "n_regionkey", "r_name"], "c_nationkey": ["n_name", "n_regionkey", "r_name"]}
register("f8_discover_multi", lambda s, d: fds.discover_multi_fds(order_info(s, d), _sing).select(
    "x", F.array_join("ys", ",").alias("ys"), "eligible_rows", "coverage", "distinct_x", "repeated_groups", "rows_in_repeated", "redundant_rows"),
         V("select * from (" + " union all ".join(
             f"""select '{x}' as x, '{",".join(sorted(ys))}' as ys, cast(sum(n) as bigint) as eligible_rows, cast(1 as double) as coverage, count(*) as distinct_x,
                 count(*) filter (n > 1) as repeated_groups, cast(sum(n) filter (n > 1) as bigint) as rows_in_repeated, cast(sum(n) - count(*) as bigint) as redundant_rows
                 from (select {x}, count(*) as n from ({ORDER_INFO}) group by 1)""" for x, ys in _sing.items()) + ")"))
register("f9_fd_evidence", lambda s, d: fds.discover_fds_by_class(fds.cells_of(t_(s, d)["customer"].join(t_(s, d)["nation"], F.col("c_nationkey") == F.col("n_nationkey")),
                                                                               "customer", "c_custkey", ["c_nationkey", "n_name", "n_regionkey"])),
         """with src as (select c_nationkey, n_name, n_regionkey from customer join nation on c_nationkey = n_nationkey), p as (
            select 'c_nationkey' as x, 'n_name' as y, c_nationkey::varchar as v, n_name as w from src union all
            select 'c_nationkey', 'n_regionkey', c_nationkey::varchar, n_regionkey::varchar from src union all
            select 'n_name', 'c_nationkey', n_name, c_nationkey::varchar from src union all
            select 'n_name', 'n_regionkey', n_name, n_regionkey::varchar from src)
            select 'customer' as class, x, y, cast(sum(n) as bigint) as eligible_rows, cast(1 as double) as coverage, count(*) as distinct_x, count(distinct w) as distinct_y,
            count(*) filter (n > 1) as repeated_groups, cast(sum(n) filter (n > 1) as bigint) as rows_in_repeated, cast(sum(n) - count(*) as bigint) as redundant_rows
            from (select x, y, v, min(w) as w, count(*) as n from p group by 1, 2, 3) group by 1, 2, 3""")
_examples = f"""with top as (select c_nationkey, count(*) as group_size, min(n_name) as n_name from ({ORDER_INFO}) group by 1 having count(*) > 1
    order by 2 desc, 1 limit 2), m as (select i.c_nationkey, top.n_name, group_size, o_orderkey as row,
    row_number() over (partition by i.c_nationkey order by o_orderkey) as r from ({ORDER_INFO}) i join top on i.c_nationkey = top.c_nationkey)
    select c_nationkey, n_name, group_size, row from m where r <= 3"""
register("f10_fd_examples", lambda s, d: fds.fd_examples(order_info(s, d), "c_nationkey", ["n_name"], "o_orderkey"), V(_examples))
register("w4_largest_groups", lambda s, d: fds.fd_examples(order_info(s, d), "c_nationkey", ["n_name"], "o_orderkey"), V(_examples))
register("f12_pending_classes",
         lambda s, d: fds.pending_classes(order_cells(s, d).select("class").distinct(),
                                          t_(s, d)["orders"].where("o_orderstatus <> 'P'").select(F.col("o_orderstatus").alias("class")).distinct()
                                          .withColumn("status", F.when(F.col("class") == "O", "failed").otherwise("done"))),
         "select distinct o_orderstatus as class from orders where o_orderstatus in ('O', 'P')")

# -- N: splitting by dependencies ----------------------------------------------------------------------
LINE_INFO = """select l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, o_custkey, o_orderstatus, o_orderpriority, c_mktsegment, c_nationkey, n_regionkey
    from v_lineitem join v_orders on l_orderkey = o_orderkey join v_customer on o_custkey = c_custkey join v_nation on c_nationkey = n_nationkey"""
_line = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "o_custkey", "o_orderstatus", "o_orderpriority", "c_mktsegment", "c_nationkey", "n_regionkey"]
_line_fds = [(["l_orderkey"], ["o_custkey", "o_orderstatus", "o_orderpriority"]), (["o_custkey"], ["c_mktsegment", "c_nationkey"]), (["c_nationkey"], ["n_regionkey"])]
LINE_SPLIT = normalize.plan_splits("line", _line, ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"], _line_fds)


def line_info(s, d):
    return fold.fold(t_(s, d), LINES)["L"].select(*_line)


def _part_with(column):
    return next(t.name for t in LINE_SPLIT.types if column in t.features)


register("n1_normalized_customer", lambda s, d: normalize.normalize_by_fds(line_info(s, d), LINE_SPLIT)[_part_with("c_mktsegment")].select("o_custkey", "c_mktsegment"),
         V(f"select distinct o_custkey, c_mktsegment from ({LINE_INFO})"))
register("n1_normalized_order", lambda s, d: normalize.normalize_by_fds(line_info(s, d), LINE_SPLIT)[_part_with("o_orderstatus")].select("l_orderkey", "o_orderstatus", "o_orderpriority"),
         V(f"select distinct l_orderkey, o_orderstatus, o_orderpriority from ({LINE_INFO})"))
register("n2_recompose", lambda s, d: normalize.check_recompose(line_info(s, d), LINE_SPLIT, "line"), "select cast(0 as bigint) as differing")


def occurrences_sql(columns=None):
    parts = []
    for t in LINE_SPLIT.types:
        flat = LINE_SPLIT.flat(t.key)
        merged = len(t.key) == 1 and flat == sorted(t.key) and flat[0] in ("l_orderkey", "o_custkey")
        parts.append(f"select '{t.name}' as part, count(*) as rows, {len(t.features)} as features, {merged} as merged, "
                     f"count(*) * {len(t.features) - merged} as stored from (select distinct {', '.join(flat)} from ({LINE_INFO}))")
    return " union all ".join(parts)


register("d12_stored_occurrences", lambda s, d: normalize.occurrences(line_info(s, d), LINE_SPLIT, {"l_orderkey", "o_custkey"}), V(occurrences_sql()))
register("n3_normalization_report", lambda s, d: normalize.normalization_report(line_info(s, d), LINE_SPLIT, {"l_orderkey", "o_custkey"}),
         V(f"""with a as (select cast(sum(stored) as bigint) as after from ({occurrences_sql()})), b as (select count(*) * 11 as before from ({LINE_INFO}))
               select before, after, before - after as eliminated, 100.0 * (before - after) / before as percent from a, b"""))
# Two overlapping determinants: splitting the first would lose the second, which therefore stays.
BLOCK_SPLIT = normalize.plan_splits("order", ["o_orderkey", "o_orderpriority", "c_mktsegment", "c_nationkey", "n_name", "n_regionkey"], ["o_orderkey", "c_mktsegment"],
                                    [(["c_nationkey", "c_mktsegment"], ["n_name"]), (["n_name", "o_orderpriority"], ["n_regionkey"])])
register("n4_remaining_redundancy", lambda s, d: normalize.remaining_redundancy(order_info(s, d), BLOCK_SPLIT),
         V("select * from (" + (" union all ".join(
             f"""select '{name}' as part, '{",".join(BLOCK_SPLIT.flat(v))}' as determinant, 'blocked' as kind, count(*) as groups,
                 cast(coalesce(sum(n - 1), 0) * {len([y for y in BLOCK_SPLIT.flat(w) if y not in BLOCK_SPLIT.flat(v)])} as bigint) as redundant_values
                 from (select {", ".join(BLOCK_SPLIT.flat(v))}, count(*) as n from ({ORDER_INFO}) group by all having count(*) >= 2
                 and {" and ".join(f"count(distinct {y}) = 1" for y in BLOCK_SPLIT.flat(w))})"""
             for (v, w), name in BLOCK_SPLIT.blocked) or "select '' as part, '' as determinant, '' as kind, 0::bigint as groups, 0::bigint as redundant_values where false") + ")"))
register("n5_single_reference_rows",
         lambda s, d: normalize.single_reference_rows(t_(s, d)["orders"].select(F.col("o_orderkey").alias("id"), "o_orderstatus"),
                                                      t_(s, d)["lineitem"].select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst")),
                                                      t_(s, d)["part"].select(F.col("p_partkey").alias("id"))),
         """select o_orderkey as id, o_orderstatus, target from orders join (select l_orderkey, min(l_partkey) as target from lineitem group by 1 having count(*) = 1)
            on l_orderkey = o_orderkey""")
