"""The 22 queries on the driver tables."""
from __future__ import annotations

from tabred import oracle
from tabred.catalog import register
from tabred.plans import tpch
from tabred.sources.tables import tpch_view

NAMES = {1: "pricing_summary", 2: "minimum_cost_supplier", 3: "shipping_priority", 4: "order_priority",
         5: "local_supplier_volume", 6: "forecast_revenue", 7: "volume_shipping", 8: "market_share",
         9: "product_profit", 10: "returned_items", 11: "important_stock", 12: "shipping_modes",
         13: "customer_distribution", 14: "promotion_effect", 15: "top_supplier", 16: "parts_suppliers",
         17: "small_quantity_orders", 18: "large_volume_customer", 19: "discounted_revenue",
         20: "potential_promotion", 21: "waiting_suppliers", 22: "sales_opportunity"}


def one_year(t):
    """Orders of one year only, so that some customers have none."""
    return {**t, "orders": t["orders"].where(tpch.in_months("o_orderdate", "1996-01-01", 12))}


def one_year_views(sql: str, extra: dict[str, str] | None = None) -> str:
    return oracle.with_views(sql, {
        "v_orders_all": oracle.VIEWS["v_orders"],
        "v_orders": "select * from v_orders_all where year(o_orderdate) = 1996", **(extra or {})})


for _q, _name in NAMES.items():
    register(f"q{_q}_{_name}", lambda s, d, q=_q: tpch.run(tpch_view(s, d), q),
             oracle.with_views(oracle.tpch(_q, tpch.DEFAULTS[_q])))
for _q in (13, 22):
    register(f"q{_q}_{NAMES[_q]}_one_year", lambda s, d, q=_q: tpch.run(one_year(tpch_view(s, d)), q),
             one_year_views(oracle.tpch(_q, tpch.DEFAULTS[_q])))
