"""Pre-joined flat tables: sizes, materialisation, inherited references, and queries over them."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tabred.operators.compare import bounded_count, compare_results
from tabred.plans import tpch
from tabred.plans.graphs import (FOLDABLE, QUERY_ROLES, ROLE_ORDER, candidate_name, candidate_references, candidates,
                                 query_links, reference_link)
from tabred.plans.joins import Part, join_parts, role_column, role_part
from tabred.schemas import KEYS, REFERENCES
from tabred.session import stored

Symbols = tuple[str, ...]
Tables = dict[str, DataFrame]


# Columns that each query uses beside keys and references.
QUERY_COLUMNS = {
    2: "p_size p_type r_name ps_supplycost s_acctbal s_name n_name p_mfgr s_address s_phone s_comment",
    3: "c_mktsegment o_orderdate l_shipdate o_shippriority l_extendedprice l_discount",
    4: "o_orderdate l_commitdate l_receiptdate o_orderpriority",
    5: "r_name n_name o_orderdate l_extendedprice l_discount",
    7: "n1_name n2_name l_shipdate l_extendedprice l_discount",
    8: "n2_name r_name p_type o_orderdate l_extendedprice l_discount",
    9: "p_name n_name o_orderdate ps_supplycost l_extendedprice l_discount l_quantity",
    10: "o_orderdate l_returnflag c_name c_acctbal n_name c_address c_phone c_comment l_extendedprice l_discount",
    11: "n_name ps_supplycost ps_availqty",
    12: "l_shipmode l_shipdate l_commitdate l_receiptdate o_orderpriority",
    13: "o_comment", 16: "p_brand p_type p_size s_comment", 18: "l_quantity c_name o_orderdate o_totalprice",
    20: "p_name n_name l_shipdate l_quantity ps_availqty s_name s_address",
    21: "o_orderstatus l_receiptdate l_commitdate n_name s_name", 22: "c_phone c_acctbal",
}


def used_columns(query: int, symbols: Symbols) -> set[str]:
    """Columns of a flat table that its query uses, with all keys and references of its members."""
    links = {c for s in symbols for c in KEYS[base(s)]} | {f for s in symbols for r in REFERENCES if r.source == base(s) for f in r.fields}
    numbered = {role_column(s, c) for s in symbols if s in ("N1", "N2") for c in (*KEYS["N"], "n_regionkey")}
    return links | numbered | set(QUERY_COLUMNS[query].split())


def base(role: str) -> str:
    return role.rstrip("12")


def keeps_customers(symbols: Symbols) -> bool:
    """Flat tables over orders and customers keep customers without orders, and orders without lines."""
    return "O" in symbols and "C" in symbols


def materialize_join(t: Tables, query: int, symbols: Symbols) -> Part:
    """One flat row per joined row, with all columns of the members."""
    links = [reference_link(a, b) for a, b in candidate_references(query, symbols)]
    if not keeps_customers(symbols):
        return join_parts([role_part(t, s) for s in symbols], links)
    kept = join_parts([role_part(t, s) for s in symbols if s not in ("L", "O")], links)
    orders, lines = role_part(t, "O"), role_part(t, "L")
    optional = orders
    if "L" in symbols:
        optional = Part(orders.frame.join(lines.frame, F.col("o_orderkey") == F.col("l_orderkey"), "left"), lines.key)
    return Part(kept.frame.join(optional.frame, F.col("c_custkey") == F.col("o_custkey"), "left"), optional.key)


def flat_table(spark: SparkSession, t: Tables, source: str, query: int, symbols: Symbols) -> Part:
    """The flat table with all columns, written once per application."""
    part = materialize_join(t, query, symbols)
    name = "flat_" + "_".join(symbols).lower()
    return Part(stored(spark, name, source, lambda: part.frame), part.key)


def query_table(spark: SparkSession, t: Tables, source: str, query: int, symbols: Symbols) -> Part:
    """All rows of the flat table with the columns of :func:`used_columns`, written once per application and query."""
    part, used = materialize_join(t, query, symbols), used_columns(query, symbols)
    name = "flat_" + "_".join(symbols).lower() + f"_q{query}"
    return Part(stored(spark, name, source, lambda: part.frame.select(*[c for c in part.frame.columns if c in used])), part.key)


def closure_components(t: Tables, query: int, symbols: Symbols) -> list[tuple[str, str, DataFrame]]:
    """Second nation-region component for the parent that the flat table leaves out.

    Where nation and region are folded together with exactly one of supplier and customer, the other
    one gets its own nation-region table: (component name, nation role, frame).
    """
    edges = {frozenset(e) for e in candidate_references(query, symbols)}
    found = []
    for nation in (s for s in symbols if base(s) == "N"):
        with_s, with_c = frozenset(("S", nation)) in edges, frozenset(("C", nation)) in edges
        if frozenset((nation, "R")) in edges and with_s != with_c:
            name = "nation_region_closure" if with_s else "supplier_nation_region_closure"
            frame = join_parts([role_part(t, "N"), role_part(t, "R")], [reference_link("N", "R")]).frame
            found.append((name, "N2" if query == 8 else "N", frame.withColumn("_component", F.lit(name))))
    return found


def _closure_part(t: Tables, query: int, symbols: Symbols) -> tuple[list[Part], list, set[str]]:
    """Closure components as parts of a query that also joins customers to their nation."""
    parts, links, covered = [], [], set()
    if "C" not in QUERY_ROLES[query]:
        return parts, links, covered
    for _, role, frame in closure_components(t, query, symbols):
        prefix = "n2" if query == 8 else "closure"
        renamed = frame.select(*[F.col(c).alias(f"{prefix}_{c.split('_', 1)[1]}" if c.startswith("n_") else f"{prefix}_{c}")
                                 for c in frame.columns])
        parts.append(Part(renamed, (f"{prefix}_nationkey",)))
        if query == 8:
            covered.add("N2")
        else:
            links.append((("c_nationkey",), ("closure_nationkey",)))
    return parts, links, covered


def template(spark: SparkSession, t: Tables, source: str, query: int, symbols: Symbols,
             params: dict | None = None) -> DataFrame:
    """A query answered from a flat table plus the tables that it does not contain."""
    p = {**tpch.DEFAULTS[query], **(params or {})}
    flat = query_table(spark, t, source, query, symbols)
    col = F.col
    if query == 4:
        late = flat.frame.where(tpch.in_months("o_orderdate", p["date"], 3) & (col("l_commitdate") < col("l_receiptdate")))
        return tpch.q04_count(late.select("o_orderkey", "o_orderpriority").dropDuplicates(["o_orderkey"]))
    if query == 13:
        counted = F.when(~tpch.like_two_words(col("o_comment"), p["pattern"]), col("o_orderkey"))
        return tpch.q13_histogram(flat.frame, counted)
    if query == 18 and "L" not in symbols:
        large = (t["lineitem"].groupBy("l_orderkey").agg(F.sum("l_quantity").alias("sum_qty"))
                 .where(col("sum_qty") > p["quantity"]))
        return tpch.q18_top(large.join(flat.frame, col("l_orderkey") == col("o_orderkey")))
    if query == 21:
        late_nation = t["supplier"].join(t["nation"], col("s_nationkey") == col("n_nationkey")) \
            if "S" not in symbols else flat.frame
        suppliers = late_nation.where(col("n_name") == p["nation"])
        if "L" in symbols:
            waiting = tpch.order_suppliers(flat.frame.where(col("o_orderstatus") == "F"))
        else:
            waiting = tpch.order_suppliers(t["lineitem"]).join(
                t["orders"].where(col("o_orderstatus") == "F"), col("waiting_order") == col("o_orderkey"), "left_semi")
        return tpch.q21_count(waiting.join(suppliers, col("first_late") == col("s_suppkey")))
    if query == 22:
        mean = tpch.q22_mean(t["customer"], p)
        lonely = tpch.q22_coded(flat.frame.where(col("o_orderkey").isNull()), p)
        return tpch.q22_sum(lonely.where(col("c_acctbal") > mean))

    frame = flat.frame
    if keeps_customers(symbols):
        frame = frame.where(col("o_orderkey").isNotNull() & (col("l_linenumber").isNotNull() if "L" in symbols else F.lit(True)))
    closure, extra_links, covered = _closure_part(t, query, symbols)
    live = [role_part(t, r) for r in QUERY_ROLES[query] if r not in symbols and r not in covered]
    links = query_links(query)
    rel = join_parts([Part(frame, flat.key), *live, *closure], links + extra_links).frame
    return tpch.q18_rows(rel, p) if query == 18 else tpch.SHAPES[query](rel, t, p)


# -- sizes ---------------------------------------------------------------------------------------

def all_candidates() -> list[tuple[int, Symbols]]:
    return [(q, s) for q in FOLDABLE for s in candidates(q)]


def candidate_sizes(t: Tables, spark: SparkSession, queries: list[int] | None = None) -> DataFrame:
    """Rows of every candidate. Candidates that fold the same tables are joined and counted once."""
    wanted = [(q, s) for q, s in all_candidates() if queries is None or q in queries]
    shared: dict[Symbols, tuple[int, Symbols]] = {}
    for q, s in wanted:
        shared.setdefault(tuple(map(base, s)), (q, s))
    counts = [materialize_join(t, q, s).frame.agg(F.count(F.lit(1)).alias("rows"))
              .select(F.lit("_".join(k)).alias("folded"), "rows") for k, (q, s) in shared.items()]
    names = spark.createDataFrame([(candidate_name(q, s), len(s), "_".join(map(base, s))) for q, s in wanted],
                                  "candidate string, tables int, folded string")
    return names.join(reduce(DataFrame.unionAll, counts), "folded").select("candidate", "tables", "rows")


def size_gate(df: DataFrame, max_rows: int) -> DataFrame:
    """Exact count up to a limit, and whether the table would be written."""
    return bounded_count(df, max_rows).select(
        "rows", (~F.col("over_limit")).alias("exact"),
        F.when(F.col("over_limit"), "too_large").otherwise("write").alias("decision"))


# -- references that flat rows inherit ------------------------------------------------------------

def text_key(columns: tuple[str, ...] | list[str]) -> Column:
    return F.concat_ws("|", *[F.col(c).cast("string") for c in columns])


def _absorbed(query: int, symbols: Symbols) -> set[tuple[str, str]]:
    """(member, reference code) pairs whose join-back side is blocked, seen from the first symbol outwards."""
    edges = list(candidate_references(query, symbols))
    reached, blocked = [sorted(symbols, key=ROLE_ORDER.index)[0]], set()
    for owner in reached:
        for a, b in edges:
            other = b if a == owner else a if b == owner else None
            if other and other not in reached:
                reached.append(other)
                blocked.add((other, f"{base(a)}_{base(b)}"))
    return blocked


def boundary_roles(query: int, symbols: Symbols) -> list[tuple[str, str, str]]:
    """(direction, member, reference code) of the references that the flat rows inherit."""
    folded = candidate_references(query, symbols)
    blocked = _absorbed(query, symbols)
    members = set(map(base, symbols))
    hard = set()
    if {"S", "N"} <= members and "C" not in members:
        hard.add("C_N")
    if {"C", "N"} <= members and "S" not in members:
        hard.add("S_N")
    roles = []
    for member in symbols:
        for ref in REFERENCES:
            if ref.source == base(member) and not any(a == member and base(b) == ref.target for a, b in folded) \
                    and (member, ref.code) not in blocked:
                roles.append(("outgoing", member, ref.code))
            if ref.target == base(member) and not any(b == member and base(a) == ref.source for a, b in folded) \
                    and (member, ref.code) not in blocked and ref.code not in hard:
                roles.append(("incoming", member, ref.code))
    return roles


def inherit_edges(t: Tables, query: int, symbols: Symbols) -> DataFrame:
    """Edges of flat rows to rows outside: [direction, type, flat_key, external_key]."""
    flat = materialize_join(t, query, symbols)
    found = []
    anchors = flat.key if not keeps_customers(symbols) else (*flat.key, "c_custkey")
    for direction, member, code in boundary_roles(query, symbols):
        ref = next(r for r in REFERENCES if r.code == code)
        far = ref.target if direction == "outgoing" else ref.source
        outside = role_part(t, far)
        outside = Part(outside.frame.select(*[F.col(c).alias(f"x_{c}") for c in outside.frame.columns]), ())
        near_role = lambda c: c if member == base(member) else f"n{member[1]}{c[1:]}"
        if direction == "outgoing":
            pairs = [(near_role(f), f"x_{k}") for f, k in zip(ref.fields, KEYS[ref.target])]
        else:
            pairs = [(near_role(k), f"x_{f}") for f, k in zip(ref.fields, KEYS[ref.target])]
        same = reduce(lambda a, b: a & b, [F.col(a) == F.col(b) for a, b in pairs])
        found.append(flat.frame.join(outside.frame, same).select(
            F.lit(direction).alias("direction"), F.lit(code).alias("type"), text_key(anchors).alias("flat_key"),
            text_key([f"x_{k}" for k in KEYS[far]]).alias("external_key")))
    return reduce(DataFrame.unionAll, found)


def _profile(edges: DataFrame, end: str, limit: int) -> DataFrame:
    return (edges.groupBy("type", end).agg(F.count(F.lit(1)).alias("n"))
            .groupBy("type").agg(F.sum("n").alias("projected"), F.max("n").alias("max_fanout"),
                                 F.count(F.lit(1)).alias("reached"))
            .withColumn("allowed", F.col("max_fanout") <= limit))


def incoming_fanout(t: Tables, query: int, symbols: Symbols, limit: int = 1) -> DataFrame:
    """Per incoming type: edges, largest number of flat rows per outside row, outside rows reached."""
    return _profile(inherit_edges(t, query, symbols).where(F.col("direction") == "incoming"), "external_key", limit)


def outgoing_degree(t: Tables, query: int, symbols: Symbols, limit: int = 1) -> DataFrame:
    """Per outgoing type: edges, largest degree of a flat row, flat rows with the type."""
    return _profile(inherit_edges(t, query, symbols).where(F.col("direction") == "outgoing"), "flat_key", limit)


def compare_plans(spark: SparkSession, t: Tables, source: str, query: int, symbols: Symbols,
                  params: dict | None = None) -> DataFrame:
    """Base query against flat-table query on the same parameters."""
    return compare_results(tpch.run(t, query, params), template(spark, t, source, query, symbols, params)) \
        .withColumn("candidate", F.lit(candidate_name(query, symbols)))
