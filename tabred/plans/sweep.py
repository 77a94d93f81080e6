"""One query for many parameter sets."""
from __future__ import annotations

import random
from collections.abc import Callable
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tabred.functions import exact as X
from tabred.plans import tpch
from tabred.sources.tables import COMMENT_WORDS_1, COMMENT_WORDS_2, SHIP_MODES

# Domains of the parameters on the driver tables.
REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "MACHINERY", "HOUSEHOLD")
TYPES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
COLORS = ("blue", "green", "red", "small")
YEARS = range(1995, 2001)


def _first(rng: random.Random, months: tuple[int, ...] = (1,)) -> str:
    return date(rng.choice(YEARS), rng.choice(months), 1).isoformat()


_ANY_MONTH = tuple(range(1, 13))
_GENERATORS: dict[int, Callable[[random.Random], dict]] = {
    1: lambda r: {"delta": r.randint(60, 120)},
    2: lambda r: {"p_size": r.randint(1, 50), "type_suffix": r.choice(TYPES)[-2:], "region": r.choice(REGIONS)},
    3: lambda r: {"segment": r.choice(SEGMENTS), "date": (date(1995, 3, 1) + timedelta(days=r.randint(0, 30))).isoformat()},
    4: lambda r: {"date": _first(r, (1, 4, 7, 10))},
    5: lambda r: {"region": r.choice(REGIONS), "date": _first(r)},
    6: lambda r: {"date": _first(r), "discount": r.randint(2, 9) / 100, "quantity": r.randint(24, 25)},
    7: lambda r: dict(zip(("nation1", "nation2"), (f"NATION_{k}" for k in r.sample(range(25), 2)))),
    8: lambda r: (lambda n: {"nation": f"NATION_{n}", "region": REGIONS[n % 5], "ptype": r.choice(TYPES)})(r.randrange(25)),
    9: lambda r: {"color": r.choice(COLORS)}, 10: lambda r: {"date": _first(r, _ANY_MONTH)},
    11: lambda r: {"nation": f"NATION_{r.randrange(25)}", "fraction": 0.002},
    12: lambda r: {**dict(zip(("shipmode1", "shipmode2"), r.sample(SHIP_MODES, 2))), "date": _first(r)},
    13: lambda r: {"pattern": f"%{r.choice(COMMENT_WORDS_1)}%{r.choice(COMMENT_WORDS_2)}%"},
    14: lambda r: {"date": _first(r, _ANY_MONTH)}, 15: lambda r: {"date": _first(r, _ANY_MONTH)},
    16: lambda r: {"brand": f"Brand#{r.randint(1, 25)}", "type_prefix": r.choice(TYPES), "sizes": r.sample(range(1, 51), 8)},
    17: lambda r: {"brand": f"Brand#{r.randint(1, 25)}", "container": "MED BOX"},
    18: lambda r: {"quantity": r.randint(250, 315)},
    19: lambda r: {**{f"brand{i}": f"Brand#{r.randint(1, 25)}" for i in (1, 2, 3)}, "q1": r.randint(1, 10), "q2": r.randint(10, 20), "q3": r.randint(20, 30)},
    20: lambda r: {"p_name": f"{r.choice(COLORS)}%", "nation": f"NATION_{r.randrange(25)}", "date": _first(r)},
    21: lambda r: {"nation": f"NATION_{r.randrange(25)}"},
    22: lambda r: {"codes": [str(k) for k in r.sample(range(10, 35), 7)]},
}


def parameter_sets(query: int, runs: int, seed: int) -> list[dict]:
    """Seeded parameter sets of a query."""
    rng = random.Random(seed)
    return [_GENERATORS[query](rng) for _ in range(runs)]


def run_param_sweep(t: dict[str, DataFrame], query: int, sets: list[dict]) -> DataFrame:
    """Results of all sets, marked by ``run``.

    Every row carries the numbers of the sets whose filter it passes, so each table is read for all sets at once.
    """
    return GROUPED[query](t, sets) if query in GROUPED else _one_scan(t, query, sets)


def _matching(conditions: list[Column]) -> Column:
    return F.explode(F.array_compact(F.array(*[F.when(c, F.lit(i)) for i, c in enumerate(conditions)])))


def _tagged(rel: DataFrame, conditions: list[Column]) -> DataFrame:
    """Rows that pass any condition, once for each that they pass; what all conditions ask of one table goes to its scan."""
    return rel.where(reduce(lambda a, b: a | b, conditions)).withColumn("run", _matching(conditions))


def _best(rows: DataFrame, order: list[Column], count: int) -> DataFrame:
    """First rows of every set; Spark cuts each partition to ``count`` rows of a set before they are moved."""
    place = F.row_number().over(Window.partitionBy("run").orderBy(*order))
    return rows.withColumn("place", place).where(F.col("place") <= count).drop("place")


def _q03(t: dict[str, DataFrame], sets: list[dict]) -> DataFrame:
    asked = [(F.col("c_mktsegment") == p["segment"]) & (F.col("o_orderdate") < tpch.day(p["date"])) & (F.col("l_shipdate") > tpch.day(p["date"])) for p in sets]
    sums = (_tagged(tpch.relation(t, 3), asked).groupBy("run", "l_orderkey", F.col("o_orderdate").cast("date").alias("o_orderdate"), "o_shippriority")
            .agg(X.exact_sum(X.revenue_units(), 4).alias("revenue")))
    return _best(sums, [F.desc("revenue"), F.col("o_orderdate"), F.col("l_orderkey")], 10)


def _q04(t: dict[str, DataFrame], sets: list[dict]) -> DataFrame:
    asked = [tpch.in_months("o_orderdate", p["date"], 3) for p in sets]
    late = t["lineitem"].where(F.col("l_commitdate") < F.col("l_receiptdate"))
    held = t["orders"].where(reduce(lambda a, b: a | b, asked)).join(late, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi")
    return _tagged(held, asked).groupBy("run", "o_orderpriority").agg(F.count(F.lit(1)).alias("order_count"))


def _q05(t: dict[str, DataFrame], sets: list[dict]) -> DataFrame:
    asked = [(F.col("r_name") == p["region"]) & tpch.in_months("o_orderdate", p["date"], 12) for p in sets]
    return _tagged(tpch.relation(t, 5), asked).groupBy("run", "n_name").agg(X.exact_sum(X.revenue_units(), 4).alias("revenue"))


def _q09(t: dict[str, DataFrame], sets: list[dict]) -> DataFrame:
    rel = _tagged(tpch.relation(t, 9), [F.col("p_name").contains(p["color"]) for p in sets])
    return (rel.groupBy("run", F.col("n_name").alias("nation"), F.year("o_orderdate").cast("long").alias("o_year"))
            .agg(X.exact_sum(X.profit_units(), 4).alias("sum_profit")))


def _q10(t: dict[str, DataFrame], sets: list[dict]) -> DataFrame:
    who = ("c_name", "c_acctbal", "n_name", "c_address", "c_phone", "c_comment")
    rel = _tagged(tpch.relation(t, 10).where(F.col("l_returnflag") == "R"), [tpch.in_months("o_orderdate", p["date"], 3) for p in sets])
    sums = rel.groupBy("run", "c_custkey").agg(X.exact_sum(X.revenue_units(), 4).alias("revenue"), *[F.first(w).alias(w) for w in who])
    return _best(sums, [F.desc("revenue"), F.col("c_custkey")], 20)


def _q12(t: dict[str, DataFrame], sets: list[dict]) -> DataFrame:
    rel = tpch.relation(t, 12).where((F.col("l_commitdate") < F.col("l_receiptdate")) & (F.col("l_shipdate") < F.col("l_commitdate")))
    asked = [F.col("l_shipmode").isin(p["shipmode1"], p["shipmode2"]) & tpch.in_months("l_receiptdate", p["date"], 12) for p in sets]
    urgent = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    return _tagged(rel, asked).groupBy("run", "l_shipmode").agg(
        F.sum(F.when(urgent, 1).otherwise(0)).alias("high_line_count"), F.sum(F.when(urgent, 0).otherwise(1)).alias("low_line_count"))


def _q02(t: dict[str, DataFrame], sets: list[dict]) -> DataFrame:
    asked = [(F.col("p_size") == p["p_size"]) & F.col("p_type").endswith(p["type_suffix"]) & (F.col("r_name") == p["region"]) for p in sets]
    local = _tagged(tpch.relation(t, 2), asked)
    cheapest = local.groupBy(F.col("run").alias("of"), F.col("p_partkey").alias("k")).agg(F.min("ps_supplycost").alias("min_cost"))
    return (local.join(cheapest, (F.col("run") == F.col("of")) & (F.col("p_partkey") == F.col("k")) & (F.col("ps_supplycost") == F.col("min_cost")))
            .select("run", "s_acctbal", "s_name", "n_name", "p_partkey", "p_mfgr", "s_address", "s_phone", "s_comment"))


def _in_two_years(column: str) -> Column:
    return (F.col(column) >= tpch.day("1995-01-01")) & (F.col(column) < tpch.day("1997-01-01"))


def _q07(t: dict[str, DataFrame], sets: list[dict]) -> DataFrame:
    pairs = [(p["nation1"], p["nation2"]) for p in sets]
    asked = [reduce(lambda a, b: a | b, [(F.col("n1_name") == x) & (F.col("n2_name") == y) for x, y in ((one, two), (two, one))]) for one, two in pairs]
    rel = _tagged(tpch.relation(t, 7).where(_in_two_years("l_shipdate")), asked)
    return (rel.groupBy("run", F.col("n1_name").alias("supp_nation"), F.col("n2_name").alias("cust_nation"), F.year("l_shipdate").cast("long").alias("l_year"))
            .agg(X.exact_sum(X.revenue_units(), 4).alias("revenue")))


def _q08(t: dict[str, DataFrame], sets: list[dict]) -> DataFrame:
    asked = [(F.col("r_name") == p["region"]) & (F.col("p_type") == p["ptype"]) for p in sets]
    rel = _tagged(tpch.relation(t, 8).where(_in_two_years("o_orderdate")), asked)
    nation = F.array(*[F.lit(p["nation"]) for p in sets])[F.col("run")]
    share = X.exact_sum(F.when(F.col("n2_name") == nation, X.revenue_units()).otherwise(F.lit(0)), 4)
    return rel.groupBy("run", F.year("o_orderdate").cast("long").alias("o_year")).agg((share / X.exact_sum(X.revenue_units(), 4)).alias("mkt_share"))


def _q11(t: dict[str, DataFrame], sets: list[dict]) -> DataFrame:
    local = _tagged(tpch.relation(t, 11), [F.col("n_name") == p["nation"] for p in sets])
    fraction = F.array(*[F.lit(p["fraction"]) for p in sets])[F.col("run")]
    bounds = local.groupBy("run").agg(X.exact_sum(X.stock_units(), 2).alias("all")).select("run", (F.col("all") * fraction).alias("bound"))
    values = local.groupBy("run", "ps_partkey").agg(X.exact_sum(X.stock_units(), 2).alias("value"))
    return values.join(bounds, "run").where(F.col("value") > F.col("bound")).drop("bound")


def _q13(t: dict[str, DataFrame], sets: list[dict]) -> DataFrame:
    """A customer's orders are counted for all sets at once, so no order is repeated."""
    rel = t["customer"].select("c_custkey").join(t["orders"].select("o_orderkey", "o_custkey", "o_comment"), F.col("c_custkey") == F.col("o_custkey"), "left")
    counts = [F.count(F.when(~tpch.like_two_words(F.col("o_comment"), p["pattern"]), F.col("o_orderkey"))) for p in sets]
    each = rel.groupBy("c_custkey").agg(F.array(*counts).alias("counts")).select(F.posexplode("counts").alias("run", "c_count"))
    return each.groupBy("run", "c_count").agg(F.count(F.lit(1)).alias("custdist"))


def _q15(t: dict[str, DataFrame], sets: list[dict]) -> DataFrame:
    revenue = (_tagged(t["lineitem"], [tpch.in_months("l_shipdate", p["date"], 3) for p in sets])
               .groupBy("run", "l_suppkey").agg(X.exact_total(X.revenue_units()).alias("total")))
    best = revenue.groupBy("run").agg(F.max("total").alias("best"))
    return (revenue.join(best, "run").where(F.col("total") == F.col("best")).join(t["supplier"], F.col("l_suppkey") == F.col("s_suppkey"))
            .select("run", "s_suppkey", "s_name", "s_address", "s_phone", (F.col("total").cast("double") / 10000.0).alias("total_revenue")))


def _q16(t: dict[str, DataFrame], sets: list[dict]) -> DataFrame:
    """Sets ask for brands, types and sizes only, so suppliers are counted once for all sets and no row is repeated."""
    rel = tpch.relation(t, 16).where(~F.col("s_comment").rlike("^.*Customer.*Complaints.*$"))
    counts = rel.groupBy("p_brand", "p_type", "p_size").agg(F.countDistinct("ps_suppkey").alias("supplier_cnt"))
    asked = [(F.col("p_brand") != p["brand"]) & ~F.col("p_type").startswith(p["type_prefix"]) & F.col("p_size").isin(*p["sizes"]) for p in sets]
    return _tagged(counts, asked).select("run", "p_brand", "p_type", "p_size", "supplier_cnt")


def _q17(t: dict[str, DataFrame], sets: list[dict]) -> DataFrame:
    chosen = _tagged(tpch.relation(t, 17), [(F.col("p_brand") == p["brand"]) & (F.col("p_container") == p["container"]) for p in sets])
    limits = chosen.groupBy(F.col("run").alias("of"), F.col("p_partkey").alias("k")).agg((F.lit(0.2) * F.avg("l_quantity")).alias("bound"))
    small = chosen.join(limits, (F.col("run") == F.col("of")) & (F.col("p_partkey") == F.col("k")) & (F.col("l_quantity") < F.col("bound")))
    return _with_empty(t, small.groupBy("run").agg((X.exact_sum(X.hundredths("l_extendedprice"), 2) / 7.0).alias("avg_yearly")), len(sets))


def _q18(t: dict[str, DataFrame], sets: list[dict]) -> DataFrame:
    sums = t["lineitem"].groupBy("l_orderkey").agg(F.sum("l_quantity").alias("sum_qty"))
    large = _tagged(sums, [F.col("sum_qty") > p["quantity"] for p in sets])
    rel = large.join(t["orders"], F.col("l_orderkey") == F.col("o_orderkey")).join(t["customer"], F.col("o_custkey") == F.col("c_custkey"))
    rel = rel.select("run", "c_name", "c_custkey", "o_orderkey", F.col("o_orderdate").cast("date").alias("o_orderdate"), "o_totalprice", "sum_qty")
    return _best(rel, [F.desc("o_totalprice"), F.col("o_orderdate"), F.col("o_orderkey")], 100)


def _q19(t: dict[str, DataFrame], sets: list[dict]) -> DataFrame:
    """Three branches per set, which no row shares, are a table of their own; it joins by brand."""
    branches = t["part"].sparkSession.createDataFrame(
        [(run, p[f"brand{i}"], [f"{size} {kind}" for kind in kinds], p[f"q{i}"], top)
         for run, p in enumerate(sets) for i, (size, kinds, top) in enumerate(tpch.Q19_SIZES, 1)],
        "run int, brand string, containers array<string>, low int, top int")
    rel = tpch.relation(t, 19).where(F.col("l_shipmode").isin("AIR", "AIR REG") & (F.col("l_shipinstruct") == "DELIVER IN PERSON"))
    found = rel.join(branches, (F.col("p_brand") == F.col("brand")) & F.array_contains("containers", F.col("p_container"))
                     & F.col("l_quantity").between(F.col("low"), F.col("low") + 10) & F.col("p_size").between(1, F.col("top")))
    return _with_empty(t, found.groupBy("run").agg(X.exact_sum(X.revenue_units(), 4).alias("revenue")), len(sets))


def _q20(t: dict[str, DataFrame], sets: list[dict]) -> DataFrame:
    asked = [F.col("p_name").startswith(p["p_name"].replace("%", "")) & (F.col("n_name") == p["nation"]) & tpch.in_months("l_shipdate", p["date"], 12) for p in sets]
    stock = (_tagged(tpch.relation(t, 20), asked).groupBy("run", "ps_partkey", "ps_suppkey")
             .agg(F.sum("l_quantity").alias("shipped"), *[F.first(x).alias(x) for x in ("ps_availqty", "s_name", "s_address")]))
    return (stock.where(F.col("ps_availqty") > 0.5 * F.col("shipped")).groupBy("run", "ps_suppkey")
            .agg(F.first("s_name").alias("s_name"), F.first("s_address").alias("s_address")).drop("ps_suppkey"))


def _q21(t: dict[str, DataFrame], sets: list[dict]) -> DataFrame:
    orders = t["orders"].where(F.col("o_orderstatus") == "F")
    waiting = tpch.order_suppliers(t["lineitem"].join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi"))
    local = _tagged(t["nation"], [F.col("n_name") == p["nation"] for p in sets])
    suppliers = t["supplier"].join(local, F.col("s_nationkey") == F.col("n_nationkey"))
    return (waiting.join(suppliers, F.col("first_late") == F.col("s_suppkey"))
            .groupBy("run", "s_name").agg(F.sum("late_lines").alias("numwait")))


def _q22(t: dict[str, DataFrame], sets: list[dict]) -> DataFrame:
    customers = t["customer"].withColumn("cntrycode", F.substring("c_phone", 1, 2))
    coded = _tagged(customers, [F.col("cntrycode").isin(*p["codes"]) for p in sets])
    means = coded.where(F.col("c_acctbal") > 0.0).groupBy("run").agg(X.exact_avg(X.hundredths("c_acctbal"), 2).alias("mean_balance"))
    rich = coded.join(means, "run").where(F.col("c_acctbal") > F.col("mean_balance"))
    return (rich.join(t["orders"], F.col("c_custkey") == F.col("o_custkey"), "left_anti").groupBy("run", "cntrycode")
            .agg(F.count(F.lit(1)).alias("numcust"), X.exact_sum(X.hundredths("c_acctbal"), 2).alias("totacctbal")))


GROUPED = {2: _q02, 3: _q03, 4: _q04, 5: _q05, 7: _q07, 8: _q08, 9: _q09, 10: _q10, 11: _q11, 12: _q12, 13: _q13, 15: _q15, 16: _q16,
           17: _q17, 18: _q18, 19: _q19, 20: _q20, 21: _q21, 22: _q22}


def _one_scan(t: dict[str, DataFrame], query: int, sets: list[dict]) -> DataFrame:
    lines = t["lineitem"]
    if query == 6:
        rows = lines.withColumn("run", _matching([tpch.q06_condition(p) for p in sets]))
        saved = X.hundredths("l_extendedprice") * X.hundredths("l_discount")
        found = rows.groupBy("run").agg(F.round(X.exact_sum(saved, 4), 4).alias("revenue"))
        return _with_empty(t, found, len(sets))
    if query == 14:
        rows = lines.withColumn("run", _matching([tpch.in_months("l_shipdate", p["date"], 1) for p in sets]))
        rel = rows.join(t["part"], F.col("l_partkey") == F.col("p_partkey"))
        promo = X.exact_sum(F.when(F.col("p_type").startswith("PROMO"), X.revenue_units()).otherwise(F.lit(0)), 4)
        found = rel.groupBy("run").agg((F.lit(100.0) * promo / X.exact_sum(X.revenue_units(), 4)).alias("promo_revenue"))
        return _with_empty(t, found, len(sets))
    # Q1: sets differ only in the cut-off date, so rows are summed per group and day first.
    cut = [F.col("day") <= F.date_sub(tpch.day("1998-12-01"), p["delta"]) for p in sets]
    price, qty, disc = (X.hundredths(x) for x in ("l_extendedprice", "l_quantity", "l_discount"))
    units = {"qty": qty, "price": price, "disc": disc, "net": X.revenue_units(), "gross": X.charge_units()}
    daily = (lines.groupBy("l_returnflag", "l_linestatus", F.col("l_shipdate").cast("date").alias("day"))
             .agg(F.count(F.lit(1)).alias("n"), *[X.exact_total(u).alias(k) for k, u in units.items()])
             .withColumn("run", _matching(cut)))
    s = lambda k, d: F.sum(k).cast("double") / F.lit(float(10 ** d))
    n = F.sum("n")
    return daily.groupBy("run", "l_returnflag", "l_linestatus").agg(
        s("qty", 2).alias("sum_qty"), s("price", 2).alias("sum_base_price"), s("net", 4).alias("sum_disc_price"), s("gross", 6).alias("sum_charge"),
        (s("qty", 2) / n).alias("avg_qty"), (s("price", 2) / n).alias("avg_price"), (s("disc", 2) / n).alias("avg_disc"), n.alias("count_order"))


def _with_empty(t: dict[str, DataFrame], found: DataFrame, runs: int) -> DataFrame:
    """A global aggregate has a row for every set, also without input rows."""
    every = t["region"].sparkSession.range(runs).select(F.col("id").cast("int").alias("run"))
    return every.join(found, "run", "left")
