"""Which tables, in which roles, each of the 22 queries joins, and along which columns."""
from __future__ import annotations

from tabred.plans.joins import Link
from tabred.schemas import KEYS, REFERENCES

# Roles of a query. Among the tables that one table looks up, the order here is the join order.
QUERY_ROLES: dict[int, tuple[str, ...]] = {
    1: ("L",), 2: ("R", "N", "S", "PS", "P"), 3: ("C", "O", "L"), 4: ("O", "L"),
    5: ("R", "N", "C", "O", "L", "S"), 6: ("L",), 7: ("N1", "S", "L", "O", "C", "N2"),
    8: ("P", "L", "O", "C", "N1", "R", "S", "N2"), 9: ("P", "L", "PS", "O", "S", "N"),
    10: ("O", "L", "C", "N"), 11: ("N", "S", "PS"), 12: ("L", "O"), 13: ("C", "O"), 14: ("L", "P"),
    15: ("L", "S"), 16: ("P", "PS", "S"), 17: ("P", "L"), 18: ("L", "O", "C"), 19: ("P", "L"),
    20: ("N", "S", "PS", "P", "L"), 21: ("N", "S", "L", "O"), 22: ("C", "O"),
}

# References between roles of a query that it doesn't follow, and the order of roles in names of flat tables.
UNUSED: dict[int, tuple[tuple[str, str], ...]] = {5: (("C", "N"),), 8: (("N2", "R"),), 9: (("PS", "P"), ("PS", "S"))}
ROLE_ORDER = ("L", "O", "PS", "S", "P", "C", "N", "N1", "N2", "R")
# Which role of nation a table refers to where there are two.
NATION_OF = {7: {"S": "N1", "C": "N2"}, 8: {"C": "N1", "S": "N2"}}


def _role(name: str, role: str) -> str:
    return f"n{role[1]}{name[1:]}" if role in ("N1", "N2") else name


def reference_link(source: str, target: str) -> Link:
    """Columns of a reference between two roles."""
    base_s, base_t = source.rstrip("12"), target.rstrip("12")
    ref = next(r for r in REFERENCES if (r.source, r.target) == (base_s, base_t))
    return (tuple(_role(f, source) for f in ref.fields), tuple(_role(k, target) for k in KEYS[base_t]))


def role_references(query: int) -> list[tuple[str, str]]:
    """Every reference between two roles of a query, in the order of the references."""
    roles = QUERY_ROLES[query]
    nation = NATION_OF.get(query, {})
    pairs = [(a, b) for r in REFERENCES for a in roles for b in roles if (a.rstrip("12"), b.rstrip("12")) == (r.source, r.target)]
    return [(a, b) for a, b in pairs if not b.startswith("N") or nation.get(a, b) == b]


def query_links(query: int) -> list[Link]:
    """All equalities of a query: references between its roles, then value joins."""
    roles = QUERY_ROLES[query]
    links = [reference_link(*pair) for pair in role_references(query) if pair not in UNUSED.get(8, ())]
    if "PS" not in roles or query == 9:
        if "L" in roles and "S" in roles:
            links.append((("l_suppkey",), ("s_suppkey",)))
        if "L" in roles and "P" in roles:
            links.append((("l_partkey",), ("p_partkey",)))
    if query == 5:
        links.append((("c_nationkey",), ("s_nationkey",)))
    return links


#: References that each query follows between stored tables. Value joins such as line to supplier are none.
FOLDABLE = {q: kept for q in QUERY_ROLES if (kept := tuple(e for e in role_references(q) if e not in UNUSED.get(q, ())))}


def candidates(query: int) -> list[tuple[str, ...]]:
    """Every connected set of roles, grown from single references by one reference at a time."""
    links = {frozenset(e) for e in FOLDABLE[query]}
    found, newest = set(links), links
    while newest:
        newest = {s | e for s in newest for e in links if s & e} - found
        found |= newest
    place = {role: i for i, role in enumerate(ROLE_ORDER)}
    ordered = [tuple(sorted(s, key=place.get)) for s in found]
    return sorted(ordered, key=lambda s: (len(s), [place[r] for r in s]))


def candidate_references(query: int, symbols: tuple[str, ...]) -> list[tuple[str, str]]:
    return [e for e in FOLDABLE[query] if set(e) <= set(symbols)]


def candidate_name(query: int, symbols: tuple[str, ...]) -> str:
    return f"t{query}_" + "_".join(s.lower() for s in symbols)
