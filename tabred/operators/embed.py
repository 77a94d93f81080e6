"""Node embeddings as joins and aggregates over the adjacency.

Vectors of one row are small numpy work inside Arrow batches. Everything that crosses rows is a join
and a partial aggregation, so a hub with a third of all edges never becomes one group in one task.
"""
from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from tabred.functions.tokens import DIMENSION
from tabred.functions.vectors import unit
from tabred.operators.ranking import exact_quantiles, hash_positions
from tabred.session import checkpointed, written

VECTOR = T.ArrayType(T.DoubleType())
# Nodes of a block, and numbers (nodes times dimensions) of one that a task of the walk product holds.
BLOCK, CELLS = 8_000_000, 8_000_000
# Edges up to which a task holds the whole graph, nodes of a packed row of vectors, and steps of walks gone at a time.
HELD_EDGES, RANGE, STEPS = 16_000_000, 8_192, 2_000_000


def neighbour_mean(adjacency: DataFrame, vectors: DataFrame, dimension: int, name: str = "vec") -> DataFrame:
    """Mean vector of each node's neighbours: [id, vec]."""
    other = vectors.select(F.col("id").alias("dst"), F.col(name).alias("_v"))
    sums = adjacency.join(other, "dst").groupBy("src").agg(F.count("_v").alias("_n"), *[F.sum(F.get("_v", F.lit(i))).alias(f"_{i}") for i in range(dimension)])
    return sums.select(F.col("src").alias("id"), F.array(*[F.col(f"_{i}") / F.col("_n") for i in range(dimension)]).alias("vec"))


def _mixed(codes: np.ndarray, width: int, salt: int) -> np.ndarray:
    """Random 64-bit words per (row code, column), by integer mixing."""
    with np.errstate(over="ignore"):
        z = codes.astype(np.uint64)[:, None] + np.arange(1, width + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
        z = z + np.uint64(salt) * np.uint64(0xD1B54A32D192ED03)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def _sparse_signs(words: np.ndarray) -> np.ndarray:
    """+sqrt(3), 0, -sqrt(3) with chances 1/6, 2/3, 1/6."""
    r = words % np.uint64(6)
    return np.where(r == 0, np.sqrt(3.0), np.where(r == 1, -np.sqrt(3.0), 0.0))


def _start_vectors(dimension: int, property_ratio: float, seed: int):
    own = dimension - int(dimension * property_ratio)

    @F.pandas_udf(VECTOR)
    def start(code: pd.Series, features: pd.Series) -> pd.Series:
        random_part = _sparse_signs(_mixed(code.to_numpy(), own, seed))
        matrix = np.stack(features.to_numpy())
        rows = np.arange(matrix.shape[1], dtype=np.int64)
        property_part = matrix @ _sparse_signs(_mixed(rows, dimension - own, seed + 1))
        return pd.Series(list(np.hstack([random_part, property_part])))

    return start


def fast_rp(nodes: DataFrame, adjacency: DataFrame, dimension: int = DIMENSION, weights: tuple[float, ...] = (0.0, 1.0, 1.0),
            property_ratio: float = 0.5, seed: int = 1) -> DataFrame:
    """Random projection: weighted sum of the normalised neighbour means of 1, 2, ... steps.

    ``nodes``: [id, features]; result [id, vec]. A part of the start vector, given by the ratio, is a
    projection of the features, the rest is random per node.
    """
    start = _start_vectors(dimension, property_ratio, seed)
    zero = F.array_repeat(F.lit(0.0), dimension)
    state = nodes.select("id", start(F.xxhash64("id"), "features").alias("vec"), zero.alias("sum"))
    for weight in weights:
        reached = neighbour_mean(adjacency, state.select("id", "vec"), dimension).select("id", unit(F.col("vec")).alias("vec"))
        reached = state.select("id", "sum").join(reached, "id", "left").select("id", F.coalesce("vec", zero).alias("vec"), "sum")
        total = F.zip_with("sum", "vec", lambda a, b: a + b * weight) if weight else F.col("sum")
        state = written(reached.select("id", "vec", total.alias("sum")))
    return state.select("id", F.col("sum").alias("vec"))


def random_walks(adjacency: DataFrame, walks: int = 5, length: int = 20, seed: int = 1) -> DataFrame:
    """``walks`` walks of up to ``length`` nodes from every node: [walk, path].

    Neighbours are numbered per node; a step draws a number and joins on (node, number), so no
    neighbour list is ever collected and hub rows spread over all tasks. Equal return and in-out
    weights make the walk first-order.
    """
    numbered = hash_positions(adjacency.select("src", "dst"), ["src"], f"{seed}:step", ["dst"])
    degree = adjacency.groupBy("src").agg(F.count(F.lit(1)).alias("degree"))
    steps = written(numbered.join(degree.select(F.col("src").alias("dst"), F.col("degree").alias("next_degree")), "dst", "left")
                    .select("src", "position", "dst", F.coalesce("next_degree", F.lit(0)).alias("next_degree")))
    state = (degree.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(walks))))
             .select(F.concat_ws("#", F.col("src").cast("string"), "n").alias("walk"), F.col("src").alias("at"), "degree",
                     F.array(F.col("src").cast("string")).alias("path")))
    pieces: list[DataFrame] = []
    for step in range(1, length):
        draw = F.pmod(F.xxhash64("walk", F.lit(step), F.lit(seed)), F.col("degree")) + 1
        moved = (state.where(F.col("degree") > 0).withColumn("draw", draw)
                 .join(steps, (F.col("at") == F.col("src")) & (F.col("draw") == F.col("position"))))
        done = state.where(F.col("degree") == 0)
        state = moved.select("walk", F.col("dst").alias("at"), F.col("next_degree").alias("degree"),
                             F.concat("path", F.array(F.col("dst").cast("string"))).alias("path")).unionAll(done)
        if step % 5 == 0:
            # Nodes gone through stay behind in tables, so that later steps move none of them.
            state = written(state)
            pieces.append(state.select("walk", F.lit(step).alias("step"), "path"))
            state = state.withColumn("path", F.array().cast("array<string>"))
    if not pieces:
        return state.select("walk", "path")
    parts = reduce(DataFrame.unionAll, [*pieces, state.select("walk", F.lit(length).alias("step"), "path")]).where(F.size("path") > 0)
    return (parts.groupBy("walk").agg(F.sort_array(F.collect_list(F.struct("step", "path"))).alias("parts"))
            .select("walk", F.flatten(F.transform("parts", lambda x: x["path"])).alias("path")))


def _floats(payload, width: int) -> np.ndarray:
    return np.frombuffer(payload, np.float32).reshape(-1, width)


@dataclass(frozen=True)
class _Plan:
    """How the walk product is dealt out. Nodes are numbers from 0 without gaps; ``size`` of them are a packed row, ``per``
    packed rows a block. A task has ``width`` dimensions of one block as source and one as target, and a part of the walks."""
    nodes: int
    dimension: int
    size: int
    per: int
    width: int
    parts: int

    @staticmethod
    def of(nodes: int, dimension: int, cores: int) -> _Plan:
        size = min(RANGE, BLOCK)
        per = max(1, min(BLOCK // size, -(-nodes // size)))
        width = max(1, min(dimension, CELLS // (per * size)))
        blocks = max(1, -(-nodes // (per * size)))
        return _Plan(nodes, dimension, size, per, width, max(1, -(-cores // (-(-dimension // width) * blocks * blocks))))

    @property
    def blocks(self) -> int:
        return max(1, -(-self.nodes // (self.per * self.size)))

    @property
    def chunks(self) -> list[slice]:
        return [slice(at, min(at + self.width, self.dimension)) for at in range(0, self.dimension, self.width)]

    @property
    def tasks(self) -> int:
        return len(self.chunks) * self.parts * self.blocks ** 2

    def rows(self, range_: int) -> int:
        return min(self.size, self.nodes - range_ * self.size)

    def block(self, number: int) -> tuple[int, int]:
        """First node of a block and its nodes."""
        first = number * self.per * self.size
        return first, max(0, min(self.per * self.size, self.nodes - first))


def _step_walks(walk: np.ndarray, walks: int, length: int, seed: int, first: np.ndarray, degree: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Nodes of the walks with these numbers, one step a row; where a walk has ended, the number of nodes stands."""
    none = len(degree) - 1
    path = np.empty((length, len(walk)), np.int32)
    at = path[0] = walk // walks
    for step in range(1, length):
        here = degree[at]
        draw = (_mixed(walk * length + step, 1, seed)[:, 0] % np.maximum(here, 1).astype(np.uint64)).astype(np.int64)
        at = np.where(here > 0, ends[np.minimum(first[at] + draw, len(ends) - 1)], none)
        path[step] = at
    return path


class _Product:
    """One task of the walk product: takes in a graph or walks and the vectors of a block, and adds up those near on walks."""

    def __init__(self, plan: _Plan, task: int, walks: int, length: int, window: int, seed: int) -> None:
        task, self.source = divmod(task, plan.blocks)
        task, self.target = divmod(task, plan.blocks)
        self.chunk, self.part = divmod(task, plan.parts)
        self.plan, self.walks, self.length, self.window, self.seed = plan, walks, length, window, seed
        self.width = plan.chunks[self.chunk].stop - plan.chunks[self.chunk].start
        self.vectors = np.zeros((self.width, plan.block(self.source)[1] + 1), np.float32)
        self.sums = np.zeros((self.width, plan.block(self.target)[1] + 1))
        self.met = np.zeros(self.sums.shape[1], bool)
        self.degree, self.ends = np.zeros(plan.nodes + 1, np.int32), []

    def take(self, kind: int, range_: int, payload, ends) -> None:
        at = range_ * self.plan.size
        if kind == GRAPH:
            self.degree[at:at + self.plan.rows(range_)] = np.frombuffer(payload, np.int32)
            self.ends.append(np.frombuffer(ends, np.int32).copy())
        elif kind == VECTORS:
            at -= self.plan.block(self.source)[0]
            self.vectors[:, at:at + self.plan.rows(range_)] = _floats(payload, self.width).T
        else:
            self.add(np.frombuffer(payload, np.int32).reshape(-1, self.length).T)

    def _inside(self, path: np.ndarray, block: int) -> np.ndarray:
        """Places in a block; the last one for nodes of other blocks and where there is none."""
        first, nodes = self.plan.block(block)
        place = path.astype(np.int64) - first
        return np.where((place < 0) | (place > nodes), nodes, place)

    def add(self, path: np.ndarray) -> None:
        """``path``: a step of all walks a row, so that sums along walks are sums of rows."""
        if min(self.length - 1, self.window) < 1:
            return
        source, target = self._inside(path, self.source), self._inside(path, self.target).ravel()
        self.met[target] = True
        until, near = np.zeros((self.length + 1, path.shape[1]), np.float32), np.empty(path.shape, np.float32)
        for vectors, sums in zip(self.vectors, self.sums):
            own = vectors[source]
            np.cumsum(own, axis=0, out=until[1:])
            for step in range(self.length):
                np.subtract(until[min(step + self.window + 1, self.length)], until[max(step - self.window, 0)], out=near[step])
            near -= own
            sums += np.bincount(target, near.ravel(), len(sums))

    def finish(self):
        """Packed rows (range, chunk, sums, nodes met) of the target block."""
        if self.ends:
            ends, self.ends = np.concatenate(self.ends), []
            first = np.cumsum(self.degree, dtype=np.int64) - self.degree
            own = np.flatnonzero(self.degree)
            own = own[own % self.plan.parts == self.part]
            at_once = max(1, STEPS // (self.length * self.walks))
            for at in range(0, len(own), at_once):
                walk = (own[at:at + at_once, None] * self.walks + np.arange(self.walks)).ravel()
                self.add(_step_walks(walk, self.walks, self.length, self.seed, first, self.degree, ends))
        low = self.target * self.plan.per
        for range_ in range(low, low + -(-(self.sums.shape[1] - 1) // self.plan.size)):
            rows = slice((range_ - low) * self.plan.size, (range_ - low) * self.plan.size + self.plan.rows(range_))
            yield _packed(range_, self.chunk, self.sums[:, rows].T, self.met[rows])


GRAPH, VECTORS, PATHS = range(3)
PACKED = "range int, chunk int, vec binary, met binary"


def _packed(range_: int, chunk: int, vectors: np.ndarray, met: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([range_], pa.int32()), pa.array([chunk], pa.int32()), pa.array([np.ascontiguousarray(vectors, np.float32).tobytes()], pa.binary()),
                                       pa.array([np.packbits(met).tobytes()], pa.binary())], ["range", "chunk", "vec", "met"])


def _unpacked(plan: _Plan, group: pa.Table) -> tuple[int, np.ndarray, np.ndarray]:
    """(range, summed vectors, nodes met) of the packed rows of one range."""
    range_ = group["range"][0].as_py()
    total, met = np.zeros((plan.rows(range_), plan.dimension)), np.zeros(plan.rows(range_), bool)
    for chunk, vec, bits in zip(group["chunk"], group["vec"], group["met"]):
        own = plan.chunks[chunk.as_py()]
        total[:, own] += _floats(vec.as_buffer(), own.stop - own.start)
        met |= np.unpackbits(np.frombuffer(bits.as_buffer(), np.uint8), count=len(met)).astype(bool)
    return range_, total, met


def _unit_rows(rows: np.ndarray) -> np.ndarray:
    size = np.sqrt(np.einsum("nd,nd->n", rows, rows))[:, None]
    return rows / np.where(size > 0, size, 1.0)


def _walk_product(plan: _Plan, given: DataFrame, kind: int, now: DataFrame, walks: int, length: int, window: int, seed: int) -> DataFrame:
    """Vectors of length 1 in the direction of the sums of the vectors near each node on the walks, as packed rows.

    ``given``: [range, payload, ends], the graph or packed walks; ``now``: packed rows of the vectors. Every task is handed
    the whole graph, and its dimensions of the vectors of one block of nodes; it goes the walks of its part again.
    """
    copies = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    blocks = F.lit(plan.blocks)
    to_all = given.select(copies(plan.tasks).alias("task"), F.lit(kind).alias("kind"), "range", "payload", "ends")
    if kind == PATHS:
        to_all = to_all.where(F.floor(F.col("task") / blocks / blocks) % plan.parts == F.pmod("range", F.lit(plan.parts)))
    to_block = now.withColumn("_copy", copies(plan.parts * plan.blocks)).select(
        ((F.col("chunk") * (plan.parts * plan.blocks) + F.col("_copy")) * blocks + F.floor(F.col("range") / plan.per)).cast("int").alias("task"),
        F.lit(VECTORS).alias("kind"), "range", F.col("vec").alias("payload"), F.lit(None).cast("binary").alias("ends"))

    def add(batches):
        at, here = None, None
        for batch in batches:
            for task, kind, range_, payload, ends in zip(*[batch.column(i) for i in range(5)]):
                if at != task.as_py():
                    yield from here.finish() if here else ()
                    at, here = task.as_py(), None
                    here = _Product(plan, at, walks, length, window, seed)
                here.take(kind.as_py(), range_.as_py(), payload.as_buffer(), ends.as_buffer())
        yield from here.finish() if here else ()

    def total(group: pa.Table) -> pa.Table:
        range_, sums, met = _unpacked(plan, group)
        sums = _unit_rows(sums)
        return pa.Table.from_batches([_packed(range_, i, sums[:, own], met) for i, own in enumerate(plan.chunks)])

    streams = to_all.unionAll(to_block).repartitionById(plan.tasks, F.col("task")).sortWithinPartitions("task", "kind", "range")
    return streams.mapInArrow(add, PACKED).groupBy("range").applyInArrow(total, PACKED)


def _held_graph(edges: DataFrame, plan: _Plan) -> DataFrame:
    """[range, payload, ends]: the degrees of the nodes of a range, and their neighbours one node after the other."""
    def pack(group: pa.Table) -> pa.Table:
        range_ = group["range"][0].as_py()
        a, b = group["a"].to_numpy() - range_ * plan.size, group["b"].to_numpy()
        degree = np.bincount(a, minlength=plan.rows(range_)).astype(np.int32)
        return pa.table({"range": pa.array([range_], pa.int32()), "payload": pa.array([degree.tobytes()], pa.binary()),
                         "ends": pa.array([b[np.lexsort((b, a))].astype(np.int32).tobytes()], pa.binary())})
    ranged = edges.withColumn("range", F.floor(F.col("a") / plan.size).cast("int"))
    return ranged.groupBy("range").applyInArrow(pack, "range int, payload binary, ends binary")


def _written_walks(edges: DataFrame, plan: _Plan, walks: int, length: int, seed: int) -> DataFrame:
    """[range, payload, ends]: walks by joins, where the graph is too large for a task; packed, and numbered in any order."""
    def pack(batches):
        for batch in batches:
            path = batch.column(0)
            sizes = path.value_lengths().to_numpy(zero_copy_only=False)
            rows = np.full((len(path), length), plan.nodes, np.int32)
            rows[np.arange(length)[None, :] < sizes[:, None]] = path.flatten().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array([int(rows.astype(np.int64).sum() & 0x7FFFFFFF)], pa.int32()), pa.array([rows.tobytes()], pa.binary()), pa.array([b""], pa.binary())], ["range", "payload", "ends"])
    paths = random_walks(edges.select(F.col("a").alias("src"), F.col("b").alias("dst")), walks, length, seed)
    return written(paths.select(F.col("path").cast("array<int>").alias("path")).mapInArrow(pack, "range int, payload binary, ends binary"))


def node2vec(adjacency: DataFrame, walks: int = 5, length: int = 20, window: int = 5, iterations: int = 2,
             dimension: int = DIMENSION, seed: int = 1) -> DataFrame:
    """Vectors of nodes that random walks visit together: [id, vec].

    Random start vectors are averaged over the pairs of nodes within ``window`` steps of a walk, ``iterations`` times, each
    time brought to length 1, and the rounds are added up: a factorisation of the co-occurrence counts. Neither pairs nor
    walks are moved or written: a task holds the graph and a few dimensions of the vectors, goes walks from seeded draws,
    and adds up running sums along them. A graph of more than HELD_EDGES edges is walked by joins instead. Vectors move as
    floats, many nodes a row.
    """
    spark = adjacency.sparkSession
    links = adjacency.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst")).dropna()
    ids = links.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    names = written(hash_positions(ids, [], f"{seed}:node", ["id"]).select("id", (F.col("position") - 1).cast("int").alias("number")))
    ends = [names.select(F.col("id").alias(x), F.col("number").alias(y)) for x, y in (("src", "a"), ("dst", "b"))]
    edges = written(links.join(ends[0], "src").join(ends[1], "dst").select("a", "b"))
    plan = _Plan.of(names.count(), dimension, spark.sparkContext.defaultParallelism)
    held = edges.count() <= HELD_EDGES
    given = _held_graph(edges, plan) if held else _written_walks(edges, plan, walks, length, seed)

    def start(group: pa.Table) -> pa.Table:
        range_ = group["range"][0].as_py()
        codes = np.zeros(plan.rows(range_), np.int64)
        codes[group["number"].to_numpy() - range_ * plan.size] = group["code"].to_numpy()
        rows = _sparse_signs(_mixed(codes, dimension, seed))
        return pa.Table.from_batches([_packed(range_, i, rows[:, own], np.ones(len(rows), bool)) for i, own in enumerate(plan.chunks)])

    def finish(group: pa.Table, named: pa.Table) -> pa.Table:
        range_, total, met = _unpacked(plan, group)
        own = named["number"].to_numpy() - range_ * plan.size
        there = met[own]
        rows = _unit_rows(total)[own[there]]
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, dimension, dtype=np.int32)), pa.array(rows.reshape(-1)))
        return pa.table({"id": named["id"].filter(pa.array(there)), "vec": lists})

    named = names.withColumn("range", F.floor(F.col("number") / plan.size).cast("int"))
    now = named.withColumn("code", F.xxhash64("id")).groupBy("range").applyInArrow(start, PACKED)
    rounds: list[DataFrame] = []
    for _ in range(iterations):
        now = _walk_product(plan, given, GRAPH if held else PATHS, now, walks, length, window, seed)
        if len(rounds) < iterations - 1:
            now = written(now)
        rounds.append(now)
    return reduce(DataFrame.unionAll, rounds).groupBy("range").cogroup(named.groupBy("range")).applyInArrow(finish, "id string, vec array<double>")


_WORD = 64


def _as_matrix(frame: pd.DataFrame) -> np.ndarray:
    words = frame.to_numpy(dtype=np.int64).view(np.uint64)
    bits = (words[:, :, None] >> np.arange(_WORD, dtype=np.uint64)[None, None, :]) & np.uint64(1)
    return bits.reshape(len(words), -1).astype(bool)


def _as_words(bits: np.ndarray) -> list[np.ndarray]:
    weights = np.uint64(1) << np.arange(_WORD, dtype=np.uint64)
    words = (bits.reshape(len(bits), -1, _WORD).astype(np.uint64) * weights).sum(axis=2, dtype=np.uint64)
    return list(words.view(np.int64))


def hash_gnn(nodes: DataFrame, adjacency: DataFrame, rounds: int = 1, density: int = DIMENSION, bits: int = DIMENSION * 4,
             neighbour_influence: float = 1.0, dimension: int = DIMENSION, seed: int = 1) -> DataFrame:
    """Min-hash message passing on binary features: [id, vec].

    Features become ``bits`` binary ones by random hyperplanes, packed into longs. A round takes the
    union of the neighbours' bits with ``bit_or`` and keeps, for each of ``density`` hash functions, the
    bit with the smallest hash among own and neighbour bits. A random projection makes the vector dense.
    """
    n_words = bits // _WORD
    packed = T.ArrayType(T.LongType())

    @F.pandas_udf(packed)
    def binarise(features: pd.Series) -> pd.Series:
        matrix = np.stack(features.to_numpy())
        planes = _sparse_signs(_mixed(np.arange(matrix.shape[1]), bits, seed))
        return pd.Series(_as_words(matrix @ planes > 0))

    def pick(round_: int):
        own_hash = (_mixed(np.arange(density), bits, seed + 10 + round_) >> np.uint64(11)).astype(float)
        near_hash = (_mixed(np.arange(density), bits, seed + 20 + round_) >> np.uint64(11)).astype(float) / max(neighbour_influence, 1e-9)

        def least(matrix: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Per row the set bit with the smallest hash, and that hash; infinite where no bit is set."""
            order = np.argsort(hashes, kind="stable")
            ranked = matrix[:, order]
            place = ranked.argmax(axis=1)
            some = ranked[np.arange(len(matrix)), place]
            return order[place], np.where(some, hashes[order[place]], np.inf)

        @F.pandas_udf(packed)
        def choose(own: pd.Series, near: pd.Series) -> pd.Series:
            a = _as_matrix(pd.DataFrame(np.stack(own.to_numpy())))
            # Rows with the same neighbourhood are many: each different one is searched once.
            different, which = np.unique(np.stack(near.to_numpy()), axis=0, return_inverse=True)
            b, which = _as_matrix(pd.DataFrame(different)), which.reshape(-1)
            chosen = np.zeros_like(a)
            rows = np.arange(len(a))
            for k in range(density):
                i, best1 = least(a, own_hash[k])
                j, best2 = least(b, near_hash[k])
                j, best2 = j[which], best2[which]
                index = np.where(best1 <= best2, i, j)
                some = np.isfinite(np.minimum(best1, best2))
                chosen[rows[some], index[some]] = True
            return pd.Series(_as_words(chosen))

        return choose

    @F.pandas_udf(VECTOR)
    def dense(own: pd.Series) -> pd.Series:
        matrix = _as_matrix(pd.DataFrame(np.stack(own.to_numpy()))).astype(float)
        return pd.Series(list(matrix @ _sparse_signs(_mixed(np.arange(bits), dimension, seed + 30)) / np.sqrt(dimension)))

    current = nodes.select("id", binarise("features").alias("own"))
    empty = F.array_repeat(F.lit(0).cast("long"), n_words)
    for round_ in range(rounds):
        other = current.select(F.col("id").alias("dst"), F.col("own").alias("_o"))
        union = (adjacency.join(other, "dst").groupBy("src")
                 .agg(*[F.bit_or(F.get("_o", F.lit(i))).alias(f"_{i}") for i in range(n_words)])
                 .select(F.col("src").alias("id"), F.array(*[f"_{i}" for i in range(n_words)]).alias("near")))
        current = current.join(union, "id", "left").select("id", pick(round_)(F.col("own"), F.coalesce("near", empty)).alias("own"))
    return current.select("id", dense("own").alias("vec"))


def mean_aggregate(nodes: DataFrame, adjacency: DataFrame, hops: int = 2, dimension: int = DIMENSION, seed: int = 1) -> DataFrame:
    """Untrained neighbourhood aggregation: sigmoid of a fixed projection of (own, neighbour mean): [id, vec]."""
    def layer(hop: int):
        @F.pandas_udf(VECTOR)
        def apply(own: pd.Series, near: pd.Series) -> pd.Series:
            x = np.hstack([np.stack(own.to_numpy()), np.stack(near.to_numpy())])
            words = _mixed(np.arange(x.shape[1]), dimension, seed + hop) >> np.uint64(11)
            w = (words.astype(float) / float(1 << 53) - 0.5) * 2.0 / np.sqrt(x.shape[1])
            return pd.Series(list(1.0 / (1.0 + np.exp(-(x @ w)))))
        return apply

    current, width = nodes.select("id", F.col("features").alias("vec")), DIMENSION
    for hop in range(hops):
        near = neighbour_mean(adjacency, current, width).withColumnRenamed("vec", "near")
        zero = F.array_repeat(F.lit(0.0), width)
        current = checkpointed(current.join(near, "id", "left").select("id", layer(hop)(F.col("vec"), F.coalesce("near", zero)).alias("vec")))
        width = dimension
    return current


def sweep(nodes: DataFrame, adjacency: DataFrame, score, ratios: list[float], influences: list[float], rounds: list[int],
          seeds: list[int]) -> DataFrame:
    """Median over seeds of a score per setting: [method, parameter, value, median].

    ``score`` maps a vector frame to a one-row frame with the column ``score``.
    """
    runs = []

    def add(method: str, parameter: str, value: float, vectors: DataFrame) -> None:
        # Written once: a score reads its vectors several times.
        runs.append(score(written(vectors)).select(F.lit(method).alias("method"), F.lit(parameter).alias("parameter"), F.lit(float(value)).alias("value"), "score"))

    for seed in seeds:
        for r in ratios:
            add("fast_rp", "property_ratio", r, fast_rp(nodes, adjacency, property_ratio=r, seed=seed))
        for i in influences:
            add("hash_gnn", "neighbour_influence", i, hash_gnn(nodes, adjacency, neighbour_influence=i, seed=seed))
        for n in rounds:
            add("hash_gnn", "rounds", n, hash_gnn(nodes, adjacency, rounds=n, seed=seed))
    return exact_quantiles(written(reduce(DataFrame.unionAll, runs)), ["method", "parameter", "value"], {"median": ("score", 0.5)})
