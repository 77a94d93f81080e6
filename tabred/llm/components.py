"""Connected components of links between numbers, by alternating stars."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tabred.llm.tables import drop, saved


def forest(left: list[int], right: list[int]) -> list[tuple[int, int]]:
    """(member, root) links with the components of the given links, fewer than there are members; for use inside a task."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.get(x, x) != x:
            root[x] = root.get(root[x], root[x])
            x = root[x]
        return x
    for a, b in zip(left, right):
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return [(x, find(x)) for x in root]


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node with a link; the component is its smallest node.

    ``links`` has the columns a and b of long numbers. Each round hangs every node's greater neighbours on its
    smallest one, and then its smaller neighbours on the smallest of them; stars remain after few rounds. A node's
    neighbours are never gathered: a minimum is combined before the shuffle and joined back, a join that Spark splits
    where one node has very many links. Links are written after each round, so a lost executor costs one round.
    """
    now = saved(_clean(links.select(F.col("a").cast("long"), F.col("b").cast("long"))))
    mark = _mark(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = _clean(large)
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        hung = large.join(small, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = saved(_clean(hung.unionByName(small.select("a", F.col("m").alias("b")))))
        last, mark = mark, _mark(new)
        drop(now)
        now = new
        if mark == last:
            break
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _clean(links: DataFrame) -> DataFrame:
    """Links from the greater to the smaller node, each once, none to itself or to nothing."""
    return links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _mark(links: DataFrame) -> tuple:
    """Number of links and a sum over their hashes, alike where nothing has changed."""
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
