"""Flat-table operators and the 74 queries over flat tables."""
from __future__ import annotations

from tabred import oracle
from tabred.catalog import register
from tabred.catalog.base import one_year, one_year_views
from tabred.plans import flat, tpch
from tabred.plans.graphs import candidate_name, candidate_references, reference_link
from tabred.plans.joins import role_column, role_table
from tabred.schemas import KEYS, REFERENCES
from tabred.sources.tables import tpch_view

for _q, _s in flat.all_candidates():
    register(candidate_name(_q, _s), lambda s, d, q=_q, y=_s: flat.template(s, tpch_view(s, d), d, q, y),
             oracle.with_views(oracle.tpch(_q, tpch.DEFAULTS[_q])))
for _q in (13, 22):
    register(f"t{_q}_o_c_one_year",
             lambda s, d, q=_q: flat.template(s, one_year(tpch_view(s, d)), d + "#1996", q, ("O", "C")),
             one_year_views(oracle.tpch(_q, tpch.DEFAULTS[_q])))


def flat_from(query: int, symbols: tuple[str, ...]) -> str:
    """FROM clause of a flat table, with role aliases."""
    refs = candidate_references(query, symbols)
    on = lambda a, b: " and ".join(
        f"{a}.{f} = {b}.{k}" for f, k in zip(next(r for r in REFERENCES if (r.source, r.target) == (a.rstrip('12'), b.rstrip('12'))).fields,
                                             KEYS[b.rstrip("12")]))
    view = lambda r: f"v_{role_table(r)} {r}"
    if flat.keeps_customers(symbols):
        inner = view("O") + (" left join v_lineitem L on L.l_orderkey = O.o_orderkey" if "L" in symbols else "")
        text = f"{view('C')} left join ({inner}) on O.o_custkey = C.c_custkey"
        done = {"C", "O", "L"}
    else:
        text, done = view(symbols[0]), {symbols[0]}
    while not set(symbols) <= done:
        a, b = next((a, b) for a, b in refs if (a in done) != (b in done))
        new = b if a in done else a
        text += f" join {view(new)} on {on(a, b)}"
        done.add(new)
    return text


_sizes = " union all ".join(f"select '{candidate_name(q, s)}' as candidate, {len(s)} as tables, count(*) as rows from {flat_from(q, s)}"
                            for q, s in flat.all_candidates())
register("m1_candidate_sizes", lambda s, d: flat.candidate_sizes(tpch_view(s, d), s), oracle.with_views(_sizes))


def _flat_columns(query, symbols, columns):
    """Spark select list and SQL select list of (role, column) pairs."""
    return ([role_column(r, c) for r, c in columns], ", ".join(f"{r}.{c} as {role_column(r, c)}" for r, c in columns))


def _register_flat(name, query, symbols, columns, transform=lambda t: t, views=oracle.with_views, tag=""):
    spark_cols, sql_cols = _flat_columns(query, symbols, columns)
    register(name, lambda s, d: flat.flat_table(s, transform(tpch_view(s, d)), d + tag, query, symbols).frame.select(*spark_cols),
             views(f"select {sql_cols} from {flat_from(query, symbols)}"))


_register_flat("m2_materialize_l_o_c_n2", 7, ("L", "O", "C", "N2"),
               [("L", "l_orderkey"), ("L", "l_linenumber"), ("L", "l_partkey"), ("L", "l_suppkey"), ("O", "o_totalprice"), ("C", "c_name"),
                ("N2", "n_nationkey"), ("N2", "n_name")])
_register_flat("m3_outer_flat_keeps_customers", 18, ("L", "O", "C"),
               [("C", "c_custkey"), ("O", "o_orderkey"), ("L", "l_linenumber"), ("L", "l_partkey"), ("L", "l_suppkey")],
               one_year, one_year_views, "#1996")
register("m4_closure_component",
         lambda s, d: flat.closure_components(tpch_view(s, d), 5, ("S", "N", "R"))[0][2].select("n_nationkey", "n_name", "r_name", "_component")
         .unionByName(flat.closure_components(tpch_view(s, d), 8, ("C", "N1", "R"))[0][2].select("n_nationkey", "n_name", "r_name", "_component")),
         """select n_nationkey, n_name, r_name, c as _component from nation join region on n_regionkey = r_regionkey,
            (values ('nation_region_closure'), ('supplier_nation_region_closure')) x(c)""")


def edge_sql(query: int, symbols: tuple[str, ...]) -> str:
    """Inherited edges of a flat table whose members are all present."""
    text = lambda alias, cols: "concat_ws('|', " + ", ".join(f"{alias}.{c}" for c in cols) + ")"
    anchor = symbols[0]
    key = text(anchor, KEYS[anchor.rstrip("12")])
    if flat.keeps_customers(symbols):
        key = f"concat_ws('|', {', '.join(f'{anchor}.{c}' for c in KEYS[anchor])}, C.c_custkey)"
    parts = []
    for direction, member, code in flat.boundary_roles(query, symbols):
        ref = next(r for r in REFERENCES if r.code == code)
        far = ref.target if direction == "outgoing" else ref.source
        near_cols, far_cols = (ref.fields, KEYS[ref.target]) if direction == "outgoing" else (KEYS[ref.target], ref.fields)
        on = " and ".join(f"{member}.{a} = x.{b}" for a, b in zip(near_cols, far_cols))
        parts.append(f"select '{direction}' as direction, '{code}' as type, {key} as flat_key, {text('x', KEYS[far])} as external_key "
                     f"from {flat_from(query, symbols)} join v_{role_table(far)} x on {on}")
    return " union all ".join(parts)


_FANOUT = """select type, cast(sum(n) as bigint) as projected, max(n) as max_fanout, count(*) as reached, max(n) <= 1 as allowed
    from (select type, {end}, count(*) as n from ({edges}) where direction = '{direction}' group by 1, 2) group by 1"""
_EDGE_CASES = {"l_o": (3, ("L", "O")), "ps_s": (2, ("PS", "S")), "o_c": (3, ("O", "C")), "s_n": (2, ("S", "N"))}
for _n, (_q, _s) in _EDGE_CASES.items():
    register(f"m5_inherited_edges_{_n}", lambda s, d, q=_q, y=_s: flat.inherit_edges(tpch_view(s, d), q, y),
             oracle.with_views(edge_sql(_q, _s)))
    register(f"m6_incoming_fanout_{_n}", lambda s, d, q=_q, y=_s: flat.incoming_fanout(tpch_view(s, d), q, y),
             oracle.with_views(_FANOUT.format(end="external_key", edges=edge_sql(_q, _s), direction="incoming")))
    register(f"m7_outgoing_degree_{_n}", lambda s, d, q=_q, y=_s: flat.outgoing_degree(tpch_view(s, d), q, y),
             oracle.with_views(_FANOUT.format(end="flat_key", edges=edge_sql(_q, _s), direction="outgoing")))
for _n, (_limit) in {"write": 10_000_000, "too_large": 1000}.items():
    register(f"m8_size_gate_{_n}", lambda s, d, m=_limit: flat.size_gate(flat.materialize_join(tpch_view(s, d), 3, ("L", "O")).frame, m),
             oracle.with_views(f"""select case when n <= {_limit} then n end as rows, n <= {_limit} as exact,
                case when n > {_limit} then 'too_large' else 'write' end as decision
                from (select count(*) as n from {flat_from(3, ('L', 'O'))})"""))
register("m9_compare_plans_q9",
         lambda s, d: flat.compare_plans(s, tpch_view(s, d), d, 9, ("L", "O", "PS")),
         "select true as equal, cast(0 as bigint) as unmatched, 't9_l_o_ps' as candidate")
register("m9_compare_plans_q2",
         lambda s, d: flat.compare_plans(s, tpch_view(s, d), d, 2, ("PS", "S", "P")),
         "select true as equal, cast(0 as bigint) as unmatched, 't2_ps_s_p' as candidate")
