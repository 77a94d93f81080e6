"""Roles of the TPC-H tables in a query, and joining a set of frames along their keys."""
from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tabred.schemas import KEYS, TABLE_OF

Link = tuple[tuple[str, ...], tuple[str, ...]]


@dataclass
class Part:
    """A frame with the columns that identify its rows."""
    frame: DataFrame
    key: tuple[str, ...]


def role_table(role: str) -> str:
    return TABLE_OF[role.rstrip("12")]


def role_column(role: str, column: str) -> str:
    """Columns of a second nation role carry the role's number: ``n1_name``."""
    return f"n{role[1]}{column[1:]}" if role in ("N1", "N2") else column


def role_part(t: dict[str, DataFrame], role: str) -> Part:
    df = t[role_table(role)]
    key = KEYS[role.rstrip("12")]
    if role in ("N1", "N2"):
        df = df.select(*[F.col(c).alias(role_column(role, c)) for c in df.columns])
    return Part(df, tuple(role_column(role, c) for c in key))


def _looks_up(child: Part, parent: Part, links: list[Link]) -> bool:
    """Do the links bind the whole key of ``parent`` to columns of ``child``?"""
    bound: set[str] = set()
    for a, b in links:
        for here, there in ((a, b), (b, a)):
            if set(child.frame.columns).issuperset(here) and set(parent.frame.columns).issuperset(there):
                bound.update(there)
    return bound.issuperset(parent.key)


def join_parts(parts: list[Part], links: list[Link]) -> Part:
    """Join all parts as a snowflake: every part first takes in the parts that it looks up.

    The larger side of each join stays on the left and meets a parent that its own filters have
    already reduced. A join always binds the whole key of its right side, so no step multiplies
    rows. Links that close a cycle become further equalities of the join where both ends meet.
    """
    children = {i: [j for j, p in enumerate(parts) if j != i and _looks_up(parts[i], p, links)]
                for i in range(len(parts))}
    roots = [i for i in children if all(i not in c for c in children.values())]
    if len(roots) != 1:
        raise ValueError("the parts do not hang together by keys under one finest table")
    attached, level = {roots[0]: None}, [roots[0]]
    while level:
        found = [(j, i) for i in level for j in children[i]]
        level = []
        for j, i in found:
            if j not in attached:
                attached[j] = i
                level.append(j)
    if len(attached) != len(parts):
        raise ValueError("the parts are not connected by keys")
    same: dict[str, str] = {}

    def leader(column: str) -> str:
        while same.get(column, column) != column:
            column = same[column]
        return column

    def build(i: int) -> DataFrame:
        frame = parts[i].frame
        for j in (j for j in range(len(parts)) if attached.get(j, -1) == i):
            other = build(j)
            conditions: list[Column] = []
            for a, b in links:
                if set(other.columns).issuperset(a):
                    a, b = b, a
                if set(frame.columns).issuperset(a) and set(other.columns).issuperset(b):
                    for x, y in zip(a, b):
                        if leader(x) != leader(y):
                            same[leader(y)] = leader(x)
                            conditions.append(frame[x] == other[y])
            frame = frame.join(other, reduce(lambda p, q: p & q, conditions))
        return frame

    return Part(build(roots[0]), parts[roots[0]].key)
