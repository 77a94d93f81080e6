"""Edges, degrees, neighbourhoods, projections and dimension nodes of a property graph."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tabred.functions.tokens import hash_features
from tabred.operators.ranking import hash_positions
from tabred.session import checkpointed


def project(edges: DataFrame, types: list[str] | None = None, undirected: bool = True) -> DataFrame:
    """Adjacency [src, dst] of the chosen types, in both directions when undirected."""
    chosen = edges if types is None else edges.where(F.col("type").isin(*types))
    one_way = chosen.select("src", "dst")
    return one_way.unionAll(chosen.select(F.col("dst").alias("src"), F.col("src").alias("dst"))) if undirected else one_way


def graph_inventory(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, and the distinct edge types in order."""
    per_type = edges.groupBy("type").agg(F.count(F.lit(1)).alias("n"))
    return (per_type.agg(F.sum("n").alias("edges"), F.array_join(F.sort_array(F.collect_set("type")), ",").alias("types"))
            .select(nodes.agg(F.count(F.lit(1)).alias("n")).scalar().alias("nodes"), "edges", "types"))


def node_degrees(edges: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Degree of each node, and its degrees per edge type in type order: [id, degree, by_type]."""
    ends = edges.select(F.col("src").alias("id"), "type").unionAll(edges.select(F.col("dst").alias("id"), "type"))
    if ids is not None:
        ends = ends.join(ids.select("id"), "id", "left_semi")
    per_type = ends.groupBy("id", "type").agg(F.count(F.lit(1)).alias("n"))
    return per_type.groupBy("id").agg(
        F.sum("n").alias("degree"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("type", "n"))),
                                 lambda e: F.concat(e["type"], F.lit(":"), e["n"].cast("string"))), ",").alias("by_type"))


def lookup(df: DataFrame, keys: DataFrame, column: str, key: str = "key") -> DataFrame:
    """Rows whose column is among the keys."""
    return df.join(keys.select(F.col(key).alias("_key")), F.col(column) == F.col("_key"), "left_semi")


def one_hop(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, exclude_label: str) -> DataFrame:
    """Neighbours of the seeds in both directions, without nodes of the seeds' own label: [id]."""
    seed = seeds.select(F.col("id").alias("_s")).distinct()
    out = edges.join(seed, F.col("src") == F.col("_s"), "left_semi").select(F.col("dst").alias("id"))
    into = edges.join(seed, F.col("dst") == F.col("_s"), "left_semi").select(F.col("src").alias("id"))
    return (out.unionAll(into).distinct()
            .join(nodes.where(F.col("label") == exclude_label).select("id"), "id", "left_anti"))


def induced_edges(edges: DataFrame, nodes: DataFrame, types: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """Edges with both ends among the nodes, of chosen types only."""
    if types is not None:
        edges = edges.where(F.col("type").isin(*types))
    if exclude:
        edges = edges.where(~F.col("type").isin(*exclude))
    inside = nodes.select(F.col("id").alias("_n"))
    return (edges.join(inside, F.col("src") == F.col("_n"), "left_semi")
            .join(inside, F.col("dst") == F.col("_n"), "left_semi"))


def undirected_pairs(edges: DataFrame, types: list[str]) -> DataFrame:
    """Distinct unordered pairs linked by one of the types: [a, b] with a < b."""
    return (edges.where(F.col("type").isin(*types) & (F.col("src") != F.col("dst")))
            .select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct())


def fd_feature_variants(targets: DataFrame, id_: str, namespace: str, fd_name: str, own: list[str], moved: list[str]) -> DataFrame:
    """Features of a row before and after its dependent columns move to a dimension row.

    [id, denormalised, normalised]: own columns under the row's label, moved ones under the name of the
    dependency, so both sides hash the same tokens for the same column.
    """
    before = hash_features(targets, id_, [(namespace, own), (fd_name, moved)]).withColumnRenamed("features", "denormalised")
    after = hash_features(targets, id_, [(namespace, own)]).withColumnRenamed("features", "normalised")
    return before.join(after, "id")


def dimension_features(groups: DataFrame, x: str, ys: list[str], fd_name: str) -> DataFrame:
    """[id, features] of dimension rows: determinant and dependents under the dependency's name."""
    return hash_features(groups, x, [(fd_name, [x, *ys])])


def attach_dimension(targets: DataFrame, id_: str, x: str, ys: list[str], label: str, edge_type: str) -> tuple[DataFrame, DataFrame]:
    """Dimension nodes and the edges that lead to them: ([id, label, x, ys...], [src, dst, type])."""
    node = F.concat(F.lit(f"{label}|"), F.col(x).cast("string"))
    nodes = targets.groupBy(x).agg(*[F.min(y).alias(y) for y in ys]).select(node.alias("id"), F.lit(label).alias("label"), x, *ys)
    edges = targets.where(F.col(x).isNotNull()).select(F.col(id_).cast("string").alias("src"), node.alias("dst"), F.lit(edge_type).alias("type"))
    return nodes, edges


def random_hubs(targets: DataFrame, id_: str, group: str, seed: int) -> DataFrame:
    """Edges to the same hubs with the same sizes but shuffled members: [src, dst].

    All members are numbered twice in two seeded orders; the member at a place of one order takes the
    group found at that place of the other, so group sizes stay and nothing is collected.
    """
    rows = targets.select(F.col(id_).alias("src"), F.col(group).alias("dst"))
    places = hash_positions(rows, [], f"{seed}:hub", ["src"]).select("dst", "position")
    members = hash_positions(rows, [], f"{seed}:member", ["src"]).select("src", "position")
    return members.join(places, "position").select("src", "dst")


def self_loops(ids: DataFrame, edge_type: str = "SELF") -> DataFrame:
    return ids.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(edge_type).alias("type"))


def receptive_field(adjacency: DataFrame, seeds: DataFrame, hops: int = 3) -> DataFrame:
    """Nodes within 1..hops steps of the seeds, seeds included: [hops, nodes].

    Only the newest ring is joined in each step; the visited set is written out after each step, so the
    plan stays short and lost executors do not replay all steps.
    """
    visited = checkpointed(seeds.select("id").distinct().withColumn("distance", F.lit(0)))
    for hop in range(1, hops + 1):
        ring = visited.where(F.col("distance") == hop - 1).select(F.col("id").alias("src"))
        found = (adjacency.join(ring, "src", "left_semi").select(F.col("dst").alias("id")).distinct()
                 .join(visited.select("id"), "id", "left_anti").withColumn("distance", F.lit(hop)))
        visited = checkpointed(visited.unionByName(found))
    return visited.agg(*[F.count(F.when(F.col("distance") <= h, 1)).alias(str(h)) for h in range(1, hops + 1)]).select(
        F.inline(F.array(*[F.struct(F.lit(h).alias("hops"), F.col(str(h)).alias("nodes")) for h in range(1, hops + 1)])))


def check_vectors(vectors: DataFrame, ids: DataFrame, dimension: int) -> DataFrame:
    """Ids without a vector, or with one of wrong length or with a value that is not finite: [id, problem]."""
    bad = F.exists("vec", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    problem = (F.when(F.col("vec").isNull(), "missing").when(F.size("vec") != dimension, "length").when(bad, "not finite"))
    return (ids.select("id").join(vectors.select("id", "vec"), "id", "left").withColumn("problem", problem)
            .where(F.col("problem").isNotNull()).select("id", "problem"))
