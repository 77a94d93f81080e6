"""The 22 queries, each over one joined relation.

``shape(rel, t, p)`` holds the filters and aggregates of a query. ``rel`` is the join of its roles, in
whatever way it was put together: from normalised tables here, from a flat table in ``flat.py``.
Filters stand above the joins; Catalyst moves them into the scans.
"""
from __future__ import annotations

from collections.abc import Callable
from datetime import date as _date
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from tabred.functions import exact as X
from tabred.plans.graphs import QUERY_ROLES, query_links
from tabred.plans.joins import join_parts, role_part

Tables = dict[str, DataFrame]
Params = dict[str, Any]
c = F.col


def day(text: str) -> Column:
    return F.lit(_date.fromisoformat(text))


def months_after(text: str, months: int) -> Column:
    return F.add_months(day(text), months)


def in_months(column: str, start: str, months: int) -> Column:
    """Half-open range of whole months."""
    return (c(column) >= day(start)) & (c(column) < months_after(start, months))


def like_two_words(column: Column, pattern: str) -> Column:
    """``%w1%w2%`` as plain LIKE; false unless the pattern has exactly two words."""
    words = [w for w in pattern.split("%") if w]
    return column.like("%" + "%".join(words) + "%") if len(words) == 2 else F.lit(False)


def relation(t: Tables, query: int) -> DataFrame:
    """Join of a query's roles over normalised tables."""
    return join_parts([role_part(t, r) for r in QUERY_ROLES[query]], query_links(query)).frame


def q01(rel, t, p):
    price, qty, disc = (X.hundredths(x) for x in ("l_extendedprice", "l_quantity", "l_discount"))
    return (rel.where(c("l_shipdate") <= F.date_sub(day("1998-12-01"), p["delta"]))
            .groupBy("l_returnflag", "l_linestatus")
            .agg(F.sum("l_quantity").alias("sum_qty"),
                 X.exact_sum(price, 2).alias("sum_base_price"),
                 X.exact_sum(X.revenue_units(), 4).alias("sum_disc_price"),
                 X.exact_sum(X.charge_units(), 6).alias("sum_charge"),
                 X.exact_avg(qty, 2).alias("avg_qty"), X.exact_avg(price, 2).alias("avg_price"),
                 X.exact_avg(disc, 2).alias("avg_disc"), F.count(F.lit(1)).alias("count_order"))
            .orderBy("l_returnflag", "l_linestatus"))


def q02(rel, t, p):
    local = rel.where((c("p_size") == p["p_size"]) & c("p_type").endswith(p["type_suffix"])
                      & (c("r_name") == p["region"]))
    cheapest = local.groupBy(c("p_partkey").alias("k")).agg(F.min("ps_supplycost").alias("min_cost"))
    return (local.join(cheapest, (c("p_partkey") == c("k")) & (c("ps_supplycost") == c("min_cost")))
            .select("s_acctbal", "s_name", "n_name", "p_partkey", "p_mfgr", "s_address", "s_phone", "s_comment")
            .orderBy(F.desc("s_acctbal"), "n_name", "s_name", "p_partkey"))


def q03(rel, t, p):
    return (rel.where((c("c_mktsegment") == p["segment"]) & (c("o_orderdate") < day(p["date"]))
                      & (c("l_shipdate") > day(p["date"])))
            .groupBy("l_orderkey", c("o_orderdate").cast("date").alias("o_orderdate"), "o_shippriority")
            .agg(X.exact_sum(X.revenue_units(), 4).alias("revenue"))
            .select("l_orderkey", "revenue", "o_orderdate", "o_shippriority")
            .orderBy(F.desc("revenue"), "o_orderdate", "l_orderkey").limit(10))


def q04(rel, t, p):
    """A line's order counts once: the late lines are reduced to their order keys first."""
    late = t["lineitem"].where(c("l_commitdate") < c("l_receiptdate"))
    return q04_count(t["orders"].where(in_months("o_orderdate", p["date"], 3))
                     .join(late, c("o_orderkey") == c("l_orderkey"), "left_semi"))


def q04_count(orders: DataFrame) -> DataFrame:
    return (orders.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("order_count"))
            .orderBy("o_orderpriority"))


def q05(rel, t, p):
    return (rel.where((c("r_name") == p["region"]) & in_months("o_orderdate", p["date"], 12))
            .groupBy("n_name").agg(X.exact_sum(X.revenue_units(), 4).alias("revenue"))
            .orderBy(F.desc("revenue")))


def q06_condition(p: Params) -> Column:
    percent = int(p["discount"] * 100 + 0.5)
    return (in_months("l_shipdate", p["date"], 12)
            & X.hundredths("l_discount").between(percent - 1, percent + 1)
            & (c("l_quantity") < p["quantity"]))


def q06(rel, t, p):
    saved = X.hundredths("l_extendedprice") * X.hundredths("l_discount")
    return rel.where(q06_condition(p)).agg(F.round(X.exact_sum(saved, 4), 4).alias("revenue"))


def q07(rel, t, p):
    one, two = p["nation1"], p["nation2"]
    pair = (((c("n1_name") == one) & (c("n2_name") == two)) | ((c("n1_name") == two) & (c("n2_name") == one)))
    return (rel.where(pair & (c("l_shipdate") >= day("1995-01-01")) & (c("l_shipdate") < day("1997-01-01")))
            .groupBy(c("n1_name").alias("supp_nation"), c("n2_name").alias("cust_nation"),
                     F.year("l_shipdate").cast("long").alias("l_year"))
            .agg(X.exact_sum(X.revenue_units(), 4).alias("revenue"))
            .orderBy("supp_nation", "cust_nation", "l_year"))


def q08(rel, t, p):
    volume = X.revenue_units()
    share = X.exact_sum(F.when(c("n2_name") == p["nation"], volume).otherwise(F.lit(0)), 4)
    return (rel.where((c("r_name") == p["region"]) & (c("p_type") == p["ptype"])
                      & (c("o_orderdate") >= day("1995-01-01")) & (c("o_orderdate") < day("1997-01-01")))
            .groupBy(F.year("o_orderdate").cast("long").alias("o_year"))
            .agg((share / X.exact_sum(volume, 4)).alias("mkt_share")).orderBy("o_year"))


def q09(rel, t, p):
    return (rel.where(c("p_name").contains(p["color"]))
            .groupBy(c("n_name").alias("nation"), F.year("o_orderdate").cast("long").alias("o_year"))
            .agg(X.exact_sum(X.profit_units(), 4).alias("sum_profit"))
            .orderBy("nation", F.desc("o_year")))


def q10(rel, t, p):
    """Revenue is summed per customer key; the wide columns ride along as key attributes."""
    who = ("c_custkey", "c_name", "c_acctbal", "n_name", "c_address", "c_phone", "c_comment")
    return (rel.where(in_months("o_orderdate", p["date"], 3) & (c("l_returnflag") == "R"))
            .groupBy("c_custkey")
            .agg(X.exact_sum(X.revenue_units(), 4).alias("revenue"),
                 *[F.first(w).alias(w) for w in who[1:]])
            .select("c_custkey", "c_name", "revenue", *who[2:])
            .orderBy(F.desc("revenue"), "c_custkey").limit(20))


def q11(rel, t, p):
    local = rel.where(c("n_name") == p["nation"])
    threshold = local.agg((X.exact_sum(X.stock_units(), 2) * p["fraction"]).alias("threshold")).scalar()
    return (local.groupBy("ps_partkey").agg(X.exact_sum(X.stock_units(), 2).alias("value"))
            .where(c("value") > threshold).orderBy(F.desc("value")))


def q12(rel, t, p):
    urgent = c("o_orderpriority").isin("1-URGENT", "2-HIGH")
    return (rel.where(c("l_shipmode").isin(p["shipmode1"], p["shipmode2"])
                      & (c("l_commitdate") < c("l_receiptdate")) & (c("l_shipdate") < c("l_commitdate"))
                      & in_months("l_receiptdate", p["date"], 12))
            .groupBy("l_shipmode")
            .agg(F.sum(F.when(urgent, 1).otherwise(0)).alias("high_line_count"),
                 F.sum(F.when(urgent, 0).otherwise(1)).alias("low_line_count"))
            .orderBy("l_shipmode"))


def q13(rel, t, p):
    wanted = t["orders"].where(~like_two_words(c("o_comment"), p["pattern"])).select("o_orderkey", "o_custkey")
    return q13_histogram(t["customer"].select("c_custkey")
                         .join(wanted, c("c_custkey") == c("o_custkey"), "left"), c("o_orderkey"))


def q13_histogram(rel: DataFrame, order: Column) -> DataFrame:
    return (rel.groupBy("c_custkey").agg(F.count(order).alias("c_count"))
            .groupBy("c_count").agg(F.count(F.lit(1)).alias("custdist"))
            .orderBy(F.desc("custdist"), F.desc("c_count")))


def q14(rel, t, p):
    promo = X.exact_sum(F.when(c("p_type").startswith("PROMO"), X.revenue_units()).otherwise(F.lit(0)), 4)
    return (rel.where(in_months("l_shipdate", p["date"], 1))
            .agg((F.lit(100.0) * promo / X.exact_sum(X.revenue_units(), 4)).alias("promo_revenue")))


def q15(rel, t, p):
    """The maximum is a scalar subquery over per-supplier sums; ties all stay."""
    revenue = (t["lineitem"].where(in_months("l_shipdate", p["date"], 3)).groupBy("l_suppkey")
               .agg(X.exact_total(X.revenue_units()).alias("total")))
    best = revenue.agg(F.max("total")).scalar()
    top = revenue.where(c("total") == best)
    return (top.join(t["supplier"], c("l_suppkey") == c("s_suppkey"))
            .select("s_suppkey", "s_name", "s_address", "s_phone",
                    (c("total").cast("double") / 10000.0).alias("total_revenue")).orderBy("s_suppkey"))


def q16(rel, t, p):
    return (rel.where((c("p_brand") != p["brand"]) & ~c("p_type").startswith(p["type_prefix"])
                      & c("p_size").isin(*p["sizes"]) & ~c("s_comment").rlike("^.*Customer.*Complaints.*$"))
            .groupBy("p_brand", "p_type", "p_size").agg(F.countDistinct("ps_suppkey").alias("supplier_cnt"))
            .orderBy(F.desc("supplier_cnt"), "p_brand", "p_type", "p_size"))


def q17(rel, t, p):
    chosen = rel.where((c("p_brand") == p["brand"]) & (c("p_container") == p["container"]))
    limits = chosen.groupBy(c("p_partkey").alias("k")).agg((F.lit(0.2) * F.avg("l_quantity")).alias("bound"))
    return (chosen.join(limits, (c("p_partkey") == c("k")) & (c("l_quantity") < c("bound")))
            .agg((X.exact_sum(X.hundredths("l_extendedprice"), 2) / 7.0).alias("avg_yearly")))


def q18(rel, t, p):
    """Lines are summed per order before the join, so only large orders meet orders and customers."""
    large = (t["lineitem"].groupBy("l_orderkey").agg(F.sum("l_quantity").alias("sum_qty"))
             .where(c("sum_qty") > p["quantity"]))
    rel = (large.join(t["orders"], c("l_orderkey") == c("o_orderkey"))
           .join(t["customer"], c("o_custkey") == c("c_custkey")))
    return q18_top(rel)


def q18_top(rel: DataFrame) -> DataFrame:
    return (rel.select("c_name", "c_custkey", "o_orderkey", c("o_orderdate").cast("date").alias("o_orderdate"),
                       "o_totalprice", "sum_qty")
            .orderBy(F.desc("o_totalprice"), "o_orderdate", "o_orderkey").limit(100))


def q18_rows(rel: DataFrame, p: Params) -> DataFrame:
    """The same from line-level rows."""
    who = ("c_name", "c_custkey", "o_orderdate", "o_totalprice")
    return q18_top(rel.groupBy("o_orderkey")
                   .agg(F.sum("l_quantity").alias("sum_qty"), *[F.first(w).alias(w) for w in who])
                   .where(c("sum_qty") > p["quantity"]))


# Container size, container kinds and largest part size of the three branches of Q19.
Q19_SIZES = (("SM", ("CASE", "BOX", "PACK", "PKG"), 5), ("MED", ("BAG", "BOX", "PKG", "PACK"), 10),
             ("LG", ("CASE", "BOX", "PACK", "PKG"), 15))


def q19(rel, t, p):
    branches = F.lit(False)
    for i, (size, kinds, top) in enumerate(Q19_SIZES, 1):
        low = p[f"q{i}"]
        branches = branches | ((c("p_brand") == p[f"brand{i}"]) & c("p_container").isin(*[f"{size} {k}" for k in kinds])
                               & c("l_quantity").between(low, low + 10) & c("p_size").between(1, top))
    return (rel.where(c("l_shipmode").isin("AIR", "AIR REG")
                      & (c("l_shipinstruct") == "DELIVER IN PERSON") & branches)
            .agg(X.exact_sum(X.revenue_units(), 4).alias("revenue")))


def q20(rel, t, p):
    return (rel.where(c("p_name").startswith(p["p_name"].replace("%", "")) & (c("n_name") == p["nation"])
                      & in_months("l_shipdate", p["date"], 12))
            .groupBy("ps_partkey", "ps_suppkey")
            .agg(F.sum("l_quantity").alias("shipped"), F.first("ps_availqty").alias("available"),
                 F.first("s_name").alias("s_name"), F.first("s_address").alias("s_address"))
            .where(c("available") > 0.5 * c("shipped"))
            .groupBy("ps_suppkey").agg(F.first("s_name").alias("s_name"), F.first("s_address").alias("s_address"))
            .select("s_name", "s_address").orderBy("s_name"))


def order_suppliers(lines: DataFrame) -> DataFrame:
    """Per order: is there a second supplier, and is the late supplier the only late one?

    Smallest and largest supplier key replace the list of an order's lines, so the aggregate is
    constant in size per order and combines before the shuffle.
    """
    late = c("l_receiptdate") > c("l_commitdate")
    return (lines.groupBy(c("l_orderkey").alias("waiting_order"))
            .agg(F.min("l_suppkey").alias("first_supplier"), F.max("l_suppkey").alias("last_supplier"),
                 F.min(F.when(late, c("l_suppkey"))).alias("first_late"),
                 F.max(F.when(late, c("l_suppkey"))).alias("last_late"),
                 F.count(F.when(late, 1)).alias("late_lines"))
            .where((c("first_supplier") != c("last_supplier")) & (c("first_late") == c("last_late"))))


def q21(rel, t, p):
    orders = t["orders"].where(c("o_orderstatus") == "F")
    waiting = order_suppliers(t["lineitem"].join(orders, c("l_orderkey") == c("o_orderkey"), "left_semi"))
    suppliers = t["supplier"].join(t["nation"].where(c("n_name") == p["nation"]), c("s_nationkey") == c("n_nationkey"))
    return q21_count(waiting.join(suppliers, c("first_late") == c("s_suppkey")))


def q21_count(rel: DataFrame) -> DataFrame:
    """Every late line of a waiting order counts for its one late supplier."""
    return (rel.groupBy("s_name").agg(F.sum("late_lines").alias("numwait"))
            .orderBy(F.desc("numwait"), "s_name"))


def q22(rel, t, p):
    rich = q22_coded(t["customer"], p).where(c("c_acctbal") > q22_mean(t["customer"], p))
    return q22_sum(rich.join(t["orders"], c("c_custkey") == c("o_custkey"), "left_anti"))


def q22_coded(customers: DataFrame, p: Params) -> DataFrame:
    return customers.withColumn("cntrycode", F.substring("c_phone", 1, 2)).where(c("cntrycode").isin(*p["codes"]))


def q22_mean(customers: DataFrame, p: Params) -> Column:
    return (q22_coded(customers, p).where(c("c_acctbal") > 0.0)
            .agg(X.exact_avg(X.hundredths("c_acctbal"), 2).alias("mean_balance")).scalar())


def q22_sum(rel: DataFrame) -> DataFrame:
    return (rel.groupBy("cntrycode")
            .agg(F.count(F.lit(1)).alias("numcust"), X.exact_sum(X.hundredths("c_acctbal"), 2).alias("totacctbal"))
            .orderBy("cntrycode"))


SHAPES: dict[int, Callable[[DataFrame | None, Tables, Params], DataFrame]] = {
    1: q01, 2: q02, 3: q03, 4: q04, 5: q05, 6: q06, 7: q07, 8: q08, 9: q09, 10: q10, 11: q11, 12: q12,
    13: q13, 14: q14, 15: q15, 16: q16, 17: q17, 18: q18, 19: q19, 20: q20, 21: q21, 22: q22,
}
# These read tables at different grains, so they take the tables and not one joined relation.
_FROM_TABLES = {4, 13, 15, 18, 21, 22}

DEFAULTS: dict[int, Params] = {
    1: {"delta": 90}, 2: {"p_size": 15, "type_suffix": "MO", "region": "EUROPE"},
    3: {"segment": "BUILDING", "date": "1998-03-15"}, 4: {"date": "1997-07-01"},
    5: {"region": "ASIA", "date": "1996-01-01"}, 6: {"date": "1996-01-01", "discount": 0.06, "quantity": 24},
    7: {"nation1": "NATION_3", "nation2": "NATION_7"},
    8: {"nation": "NATION_3", "region": "AMERICA", "ptype": "PROMO"}, 9: {"color": "blue"},
    10: {"date": "1997-10-01"}, 11: {"nation": "NATION_4", "fraction": 0.002},
    12: {"shipmode1": "MAIL", "shipmode2": "SHIP", "date": "1997-01-01"},
    13: {"pattern": "%special%requests%"}, 14: {"date": "1998-09-01"}, 15: {"date": "1998-01-01"},
    16: {"brand": "Brand#4", "type_prefix": "MEDIUM", "sizes": [49, 14, 23, 45, 19, 3, 36, 9]},
    17: {"brand": "Brand#2", "container": "MED BOX"}, 18: {"quantity": 260},
    19: {"brand1": "Brand#1", "brand2": "Brand#2", "brand3": "Brand#3", "q1": 1, "q2": 10, "q3": 20},
    20: {"p_name": "blue%", "nation": "NATION_3", "date": "1997-01-01"}, 21: {"nation": "NATION_5"},
    22: {"codes": ["13", "31", "23", "29", "30", "18", "17"]},
}


def run(t: Tables, query: int, params: Params | None = None) -> DataFrame:
    """A query over normalised tables."""
    rel = None if query in _FROM_TABLES else relation(t, query)
    return SHAPES[query](rel, t, {**DEFAULTS[query], **(params or {})})
