"""DuckDB texts of the view layer and of the 22 queries."""
from __future__ import annotations

import re
from typing import Any

from tabred.sources.tables import COMMENT_WORDS_1, COMMENT_WORDS_2, CONTAINERS, SHIP_INSTRUCTIONS, SHIP_MODES


def _pick(values: tuple[str, ...], index: str) -> str:
    return "list_extract([" + ", ".join(f"'{v}'" for v in values) + f"], cast({index} as int) + 1)"


VIEWS = {
    "v_region": "select *, 'region ' || r_regionkey as r_comment from region",
    "v_nation": "select *, 'nation ' || n_nationkey as n_comment from nation",
    "v_supplier": """select *, 'supplier street ' || s_suppkey as s_address,
        (s_nationkey + 10) || '-' || s_suppkey as s_phone,
        case when s_suppkey % 10 = 0 then 'Customer slow Complaints' else 'supplier ' || s_suppkey end as s_comment
        from supplier""",
    "v_customer": """select *, 'customer street ' || c_custkey as c_address,
        (c_nationkey + 10) || '-' || c_custkey as c_phone, 'customer ' || c_custkey as c_comment from customer""",
    "v_part": f"""select *, 'Manufacturer#' || (p_partkey % 5 + 1) as p_mfgr,
        {_pick(CONTAINERS, 'p_partkey % 12')} as p_container, 'part ' || p_partkey as p_comment from part""",
    "v_orders": f"""select o_orderkey, o_custkey, o_orderstatus, o_totalprice, cast(o_orderdate as date) as o_orderdate,
        o_orderpriority, 'Clerk#' || (o_custkey % 1000) as o_clerk, 0 as o_shippriority,
        case when o_orderkey % 5 = 0 then {_pick(COMMENT_WORDS_1, 'o_orderkey % 4')} || ' filler ' ||
          {_pick(COMMENT_WORDS_2, '(o_orderkey // 4) % 4')} else 'plain text' end as o_comment from orders""",
    "v_lineitem": f"""select l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount,
        l_tax, l_returnflag, l_linestatus, cast(l_shipdate as date) as l_shipdate,
        cast(l_shipdate as date) + cast((l_partkey * 7 + l_suppkey * 3 + l_linenumber) % 61 - 30 as int) as l_commitdate,
        cast(l_shipdate as date) + cast((l_orderkey + l_partkey) % 30 + 1 as int) as l_receiptdate,
        {_pick(SHIP_MODES, '(l_orderkey + l_partkey) % 7')} as l_shipmode,
        {_pick(SHIP_INSTRUCTIONS, 'l_suppkey % 4')} as l_shipinstruct, 'line ' || l_orderkey as l_comment
        from lineitem""",
    "v_partsupp": """select ps_partkey, ps_suppkey, cast((ps_partkey * 31 + ps_suppkey * 17) % 40 + 1 as int) as ps_availqty,
        floor(unit * 100) / 100.0 as ps_supplycost, 'partsupp ' || ps_partkey || ' ' || ps_suppkey as ps_comment
        from (select l_partkey as ps_partkey, l_suppkey as ps_suppkey, min(l_extendedprice / l_quantity) as unit
              from lineitem group by all)""",
}


def with_views(sql: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``sql`` with the views it names, each after the views that it names itself."""
    views = {**VIEWS, **(extra or {})}
    ordered: list[str] = []

    def add(text: str, above: tuple[str, ...]) -> None:
        for v in views:
            if v not in ordered and v not in above and re.search(rf"\b{v}\b", text):
                add(views[v], (*above, v))
                ordered.append(v)

    add(sql, ())
    if not ordered:
        return sql
    head = ", ".join(f"{v} as ({views[v]})" for v in ordered)
    body = sql.lstrip()
    if body.lower().startswith("with recursive "):
        return f"with recursive {head}, {body[15:]}"
    return f"with {head}, {body[5:]}" if body.lower().startswith("with ") else f"with {head} {body}"


def cents(x: str) -> str:
    return f"cast(floor({x} * 100 + 0.5) as bigint)"


def total(units: str, decimals: int) -> str:
    return f"(cast(sum({units}) as double) / {float(10 ** decimals)})"


REV = f"({cents('l_extendedprice')} * (100 - {cents('l_discount')}))"
CHARGE = f"({REV} * (100 + {cents('l_tax')}))"
PROFIT = f"({REV} - {cents('ps_supplycost')} * {cents('l_quantity')})"
STOCK = f"({cents('ps_supplycost')} * ps_availqty)"


def tpch(query: int, p: dict[str, Any]) -> str:
    """Text of a base query with its parameters."""
    f: dict[int, Any] = {
        1: lambda: f"""select l_returnflag, l_linestatus, sum(l_quantity) as sum_qty,
            {total(cents('l_extendedprice'), 2)} as sum_base_price, {total(REV, 4)} as sum_disc_price,
            {total(CHARGE, 6)} as sum_charge, {total(cents('l_quantity'), 2)} / count(*) as avg_qty,
            {total(cents('l_extendedprice'), 2)} / count(*) as avg_price,
            {total(cents('l_discount'), 2)} / count(*) as avg_disc, count(*) as count_order
            from v_lineitem where l_shipdate <= date '1998-12-01' - {p['delta']} group by 1, 2""",
        2: lambda: f"""with j as (select * from v_part join v_partsupp on ps_partkey = p_partkey
            join v_supplier on s_suppkey = ps_suppkey join v_nation on n_nationkey = s_nationkey
            join v_region on r_regionkey = n_regionkey where p_size = {p['p_size']}
            and p_type like '%{p['type_suffix']}' and r_name = '{p['region']}')
            select s_acctbal, s_name, n_name, p_partkey, p_mfgr, s_address, s_phone, s_comment from j
            where ps_supplycost = (select min(ps_supplycost) from j j2 where j2.p_partkey = j.p_partkey)""",
        3: lambda: f"""select l_orderkey, {total(REV, 4)} as revenue, o_orderdate, o_shippriority from v_lineitem
            join v_orders on l_orderkey = o_orderkey join v_customer on o_custkey = c_custkey
            where c_mktsegment = '{p['segment']}' and o_orderdate < date '{p['date']}' and l_shipdate > date '{p['date']}'
            group by l_orderkey, o_orderdate, o_shippriority order by revenue desc, o_orderdate, l_orderkey limit 10""",
        4: lambda: f"""select o_orderpriority, count(*) as order_count from v_orders
            where o_orderdate >= date '{p['date']}' and o_orderdate < date '{p['date']}' + interval 3 month
            and exists (select 1 from v_lineitem where l_orderkey = o_orderkey and l_commitdate < l_receiptdate)
            group by 1""",
        5: lambda: f"""select n_name, {total(REV, 4)} as revenue from v_customer, v_orders, v_lineitem, v_supplier,
            v_nation, v_region where c_custkey = o_custkey and l_orderkey = o_orderkey and l_suppkey = s_suppkey
            and c_nationkey = s_nationkey and s_nationkey = n_nationkey and n_regionkey = r_regionkey
            and r_name = '{p['region']}' and o_orderdate >= date '{p['date']}'
            and o_orderdate < date '{p['date']}' + interval 1 year group by n_name""",
        6: lambda: f"""select round({total(f"{cents('l_extendedprice')} * {cents('l_discount')}", 4)}, 4) as revenue
            from v_lineitem where l_shipdate >= date '{p['date']}' and l_shipdate < date '{p['date']}' + interval 1 year
            and abs({cents('l_discount')} - cast(round({p['discount']} * 100) as bigint)) <= 1
            and l_quantity < {p['quantity']}""",
        7: lambda: f"""select n1.n_name as supp_nation, n2.n_name as cust_nation,
            cast(year(l_shipdate) as bigint) as l_year, {total(REV, 4)} as revenue
            from v_supplier, v_lineitem, v_orders, v_customer, v_nation n1, v_nation n2
            where s_suppkey = l_suppkey and o_orderkey = l_orderkey and c_custkey = o_custkey
            and s_nationkey = n1.n_nationkey and c_nationkey = n2.n_nationkey
            and ((n1.n_name = '{p['nation1']}' and n2.n_name = '{p['nation2']}')
              or (n1.n_name = '{p['nation2']}' and n2.n_name = '{p['nation1']}'))
            and l_shipdate between date '1995-01-01' and date '1996-12-31' group by 1, 2, 3""",
        8: lambda: f"""select cast(year(o_orderdate) as bigint) as o_year,
            {total(f"case when n2.n_name = '{p['nation']}' then {REV} else 0 end", 4)} / {total(REV, 4)} as mkt_share
            from v_part, v_supplier, v_lineitem, v_orders, v_customer, v_nation n1, v_nation n2, v_region
            where p_partkey = l_partkey and s_suppkey = l_suppkey and l_orderkey = o_orderkey
            and o_custkey = c_custkey and c_nationkey = n1.n_nationkey and n1.n_regionkey = r_regionkey
            and r_name = '{p['region']}' and s_nationkey = n2.n_nationkey
            and o_orderdate between date '1995-01-01' and date '1996-12-31' and p_type = '{p['ptype']}' group by 1""",
        9: lambda: f"""select n_name as nation, cast(year(o_orderdate) as bigint) as o_year,
            {total(PROFIT, 4)} as sum_profit from v_part, v_supplier, v_lineitem, v_partsupp, v_orders, v_nation
            where s_suppkey = l_suppkey and ps_suppkey = l_suppkey and ps_partkey = l_partkey
            and p_partkey = l_partkey and o_orderkey = l_orderkey and s_nationkey = n_nationkey
            and contains(p_name, '{p['color']}') group by 1, 2""",
        10: lambda: f"""select c_custkey, c_name, {total(REV, 4)} as revenue, c_acctbal, n_name, c_address, c_phone,
            c_comment from v_customer, v_orders, v_lineitem, v_nation where c_custkey = o_custkey
            and l_orderkey = o_orderkey and o_orderdate >= date '{p['date']}'
            and o_orderdate < date '{p['date']}' + interval 3 month and l_returnflag = 'R'
            and c_nationkey = n_nationkey group by c_custkey, c_name, c_acctbal, n_name, c_address, c_phone, c_comment
            order by revenue desc, c_custkey limit 20""",
        11: lambda: f"""with j as (select * from v_partsupp, v_supplier, v_nation where ps_suppkey = s_suppkey
            and s_nationkey = n_nationkey and n_name = '{p['nation']}')
            select ps_partkey, {total(STOCK, 2)} as value from j group by 1
            having value > (select {total(STOCK, 2)} * {p['fraction']} from j)""",
        12: lambda: f"""select l_shipmode,
            cast(sum(case when o_orderpriority in ('1-URGENT', '2-HIGH') then 1 else 0 end) as bigint) as high_line_count,
            cast(sum(case when o_orderpriority not in ('1-URGENT', '2-HIGH') then 1 else 0 end) as bigint) as low_line_count
            from v_orders, v_lineitem where o_orderkey = l_orderkey
            and l_shipmode in ('{p['shipmode1']}', '{p['shipmode2']}') and l_commitdate < l_receiptdate
            and l_shipdate < l_commitdate and l_receiptdate >= date '{p['date']}'
            and l_receiptdate < date '{p['date']}' + interval 1 year group by 1""",
        13: lambda: f"""select c_count, count(*) as custdist from (select c_custkey, count(o_orderkey) as c_count
            from v_customer left join v_orders on c_custkey = o_custkey and o_comment not like '{p['pattern']}'
            group by 1) group by 1""",
        14: lambda: f"""select 100.0 * {total(f"case when p_type like 'PROMO%' then {REV} else 0 end", 4)}
            / {total(REV, 4)} as promo_revenue from v_lineitem, v_part where l_partkey = p_partkey
            and l_shipdate >= date '{p['date']}' and l_shipdate < date '{p['date']}' + interval 1 month""",
        15: lambda: f"""with r as (select l_suppkey, sum({REV}) as total from v_lineitem
            where l_shipdate >= date '{p['date']}' and l_shipdate < date '{p['date']}' + interval 3 month group by 1)
            select s_suppkey, s_name, s_address, s_phone, cast(total as double) / 10000.0 as total_revenue
            from r, v_supplier where s_suppkey = l_suppkey and total = (select max(total) from r)""",
        16: lambda: f"""select p_brand, p_type, p_size, count(distinct ps_suppkey) as supplier_cnt
            from v_partsupp, v_part, v_supplier where p_partkey = ps_partkey and s_suppkey = ps_suppkey
            and p_brand <> '{p['brand']}' and p_type not like '{p['type_prefix']}%'
            and p_size in ({', '.join(map(str, p['sizes']))}) and s_comment not like '%Customer%Complaints%'
            group by 1, 2, 3""",
        17: lambda: f"""select {total(cents('l_extendedprice'), 2)} / 7.0 as avg_yearly from v_lineitem l, v_part
            where p_partkey = l_partkey and p_brand = '{p['brand']}' and p_container = '{p['container']}'
            and l_quantity < (select 0.2 * avg(l_quantity) from v_lineitem l2 where l2.l_partkey = p_partkey)""",
        18: lambda: f"""select c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice, sum(l_quantity) as sum_qty
            from v_customer, v_orders, v_lineitem where c_custkey = o_custkey and o_orderkey = l_orderkey
            group by c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice having sum(l_quantity) > {p['quantity']}
            order by o_totalprice desc, o_orderdate, o_orderkey limit 100""",
        19: lambda: f"""select {total(REV, 4)} as revenue from v_lineitem, v_part where p_partkey = l_partkey
            and l_shipmode in ('AIR', 'AIR REG') and l_shipinstruct = 'DELIVER IN PERSON' and (
            (p_brand = '{p['brand1']}' and p_container in ('SM CASE', 'SM BOX', 'SM PACK', 'SM PKG')
              and l_quantity between {p['q1']} and {p['q1'] + 10} and p_size between 1 and 5) or
            (p_brand = '{p['brand2']}' and p_container in ('MED BAG', 'MED BOX', 'MED PKG', 'MED PACK')
              and l_quantity between {p['q2']} and {p['q2'] + 10} and p_size between 1 and 10) or
            (p_brand = '{p['brand3']}' and p_container in ('LG CASE', 'LG BOX', 'LG PACK', 'LG PKG')
              and l_quantity between {p['q3']} and {p['q3'] + 10} and p_size between 1 and 15))""",
        20: lambda: f"""select s_name, s_address from v_supplier where s_suppkey in (select ps_suppkey from (
            select ps_partkey, ps_suppkey, ps_availqty, sum(l_quantity) as shipped from v_partsupp, v_part, v_lineitem
            where ps_partkey = p_partkey and l_partkey = ps_partkey and l_suppkey = ps_suppkey
            and starts_with(p_name, '{p['p_name'].replace('%', '')}') and l_shipdate >= date '{p['date']}'
            and l_shipdate < date '{p['date']}' + interval 1 year group by 1, 2, 3) where ps_availqty > 0.5 * shipped)
            and s_nationkey in (select n_nationkey from v_nation where n_name = '{p['nation']}')""",
        21: lambda: f"""select s_name, count(*) as numwait from v_supplier, v_lineitem l1, v_orders, v_nation
            where s_suppkey = l1.l_suppkey and o_orderkey = l1.l_orderkey and o_orderstatus = 'F'
            and l1.l_receiptdate > l1.l_commitdate
            and exists (select 1 from v_lineitem l2 where l2.l_orderkey = l1.l_orderkey and l2.l_suppkey <> l1.l_suppkey)
            and not exists (select 1 from v_lineitem l3 where l3.l_orderkey = l1.l_orderkey
              and l3.l_suppkey <> l1.l_suppkey and l3.l_receiptdate > l3.l_commitdate)
            and s_nationkey = n_nationkey and n_name = '{p['nation']}' group by 1""",
        22: lambda: (lambda codes, avg: f"""select substr(c_phone, 1, 2) as cntrycode, count(*) as numcust,
            {total(cents('c_acctbal'), 2)} as totacctbal from v_customer where substr(c_phone, 1, 2) in ({codes})
            and c_acctbal > {avg} and not exists (select 1 from v_orders where o_custkey = c_custkey) group by 1""")(
            ", ".join(f"'{x}'" for x in p["codes"]),
            f"""(select {total(cents('c_acctbal'), 2)} / count(*) from v_customer where c_acctbal > 0.0
            and substr(c_phone, 1, 2) in ({', '.join(f"'{x}'" for x in p['codes'])}))"""),
    }
    return f[query]()
