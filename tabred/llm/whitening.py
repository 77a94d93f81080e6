"""Whitening of vectors by an incremental eigendecomposition.

1. Every remaining entry becomes a whole number; each distinct vector is in the fit list once.
2. A task keeps mean and spectrum of what it has seen. A further vector changes the scatter matrix by one centred
   rank-one term: the new eigenvalues are the roots of a secular equation, after deflation.
3. Spectra of tasks are combined pairwise by rank-one updates, a few per group, until one is left.
4. A last pass over the fit list projects the exact covariance on that basis (Rayleigh-Ritz) and turns the basis.
Tasks hold a batch of vectors and one square matrix; the driver holds two square matrices and the sums.
"""
from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tabred.llm.tables import drop, saved, small_batches

#: Entries become floor(SCALE * entry) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Vectors that one task takes in, about; an update takes some milliseconds.
ROWS_PER_TASK = 2000
#: Spectra that are combined by one task.
FAN_IN = 8
#: Components whose variance is below this share of the largest one's count as having none.
FLAT = 1e-12
_EPS = np.finfo(float).eps


@dataclass
class Spectrum:
    """Count, mean and eigendecomposition (values rising, vectors in columns) of the scatter around the mean."""
    count: int
    mean: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @staticmethod
    def empty(dims: int) -> Spectrum:
        return Spectrum(0, np.zeros(dims), np.zeros(dims), np.eye(dims))

    def add(self, row: np.ndarray) -> None:
        """Take in one vector: a centred rank-one update."""
        away = row - self.mean
        if self.count:
            self.values, self.vectors = rank_one(self.values, self.vectors, away, self.count / (self.count + 1))
        self.count += 1
        self.mean = self.mean + away / self.count

    def merge(self, other: Spectrum) -> None:
        """Take in another spectrum: one update for each of its values and one for the distance of the means."""
        if not other.count:
            return
        if not self.count:
            self.count, self.mean, self.values, self.vectors = other.count, other.mean, other.values, other.vectors
            return
        for value, vector in zip(other.values, other.vectors.T):
            if value > 0:
                self.values, self.vectors = rank_one(self.values, self.vectors, vector, value)
        both, away = self.count + other.count, other.mean - self.mean
        self.values, self.vectors = rank_one(self.values, self.vectors, away, self.count * (other.count / both))
        self.mean = self.mean + away * (other.count / both)
        self.count = both


def rank_one(values: np.ndarray, vectors: np.ndarray, row: np.ndarray, weight: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigendecomposition of ``vectors diag(values) vectors' + weight row row'`` with ``weight`` above 0; values rise."""
    z = vectors.T @ row
    size = float(np.abs(z).max(initial=0.0))
    if not size or not weight:
        return values, vectors
    least = 8 * _EPS * max(float(np.abs(values).max()), weight * float(z @ z))
    # Deflation: directions of equal values are turned until one of them holds all of the row.
    close = np.diff(values) <= least
    if close.any():
        vectors, z = vectors.copy(), z.copy()
        starts = np.flatnonzero(np.concatenate(([True], ~close)))
        for a, b in zip(starts, np.append(starts[1:], len(values))):
            part = z[a:b].copy()
            length = float(np.sqrt(part @ part))
            if b - a < 2 or not part[:-1].any():
                continue
            mirror = part.copy()
            mirror[-1] += math.copysign(length, part[-1])
            vectors[:, a:b] -= np.outer(vectors[:, a:b] @ mirror, mirror) * (2 / (mirror @ mirror))
            z[a:b] = 0.0
            z[b - 1] = -math.copysign(length, part[-1])
    # Directions that the row hardly meets stay as they are.
    live = np.flatnonzero(weight * np.abs(z) * np.sqrt(z @ z) > least)
    if not len(live):
        return values, vectors
    d, y = values[live], z[live]
    home, shift = secular_roots(d, y, weight)
    gaps = (d[None, :] - d[home][:, None]) - shift[:, None]              # pole j minus root i, free of cancellation
    # Weights for which the found roots are exact keep the new vectors orthogonal.
    over = -gaps.T                                                       # root i minus pole j, row j
    with np.errstate(divide="ignore", invalid="ignore"):
        apart = d[None, :] - d[:, None]
        np.fill_diagonal(apart, 1.0)
        ratio = over / apart
        np.fill_diagonal(ratio, over.diagonal())
        square = np.abs(np.prod(ratio, axis=1)) / weight
    y = np.copysign(np.sqrt(square), y)
    turn = y[None, :] / gaps
    turn /= np.sqrt((turn ** 2).sum(axis=1))[:, None]
    values, vectors = values.copy(), vectors.copy()
    values[live] = d[home] + shift
    vectors[:, live] = vectors[:, live] @ turn.T
    order = np.argsort(values, kind="stable")
    return values[order], vectors[:, order]


def secular_roots(d: np.ndarray, z: np.ndarray, weight: float) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + weight * sum(z_j^2 / (d_j - root)) = 0 as (nearest pole, distance from it), one above each pole.

    ``d`` rises strictly and no z is 0. All roots are refined together: a step fits one pole on either side to the
    two halves of the sum, and is halved into its bracket where it would leave it.
    """
    n = len(d)
    square = z * z
    top = d[-1] + weight * float(square.sum())
    right = np.append(d[1:], top)
    each = np.arange(n)
    middle = (right - d) / 2
    at_middle = 1 / weight + (square / ((d[None, :] - d[:, None]) - middle[:, None])).sum(axis=1)
    near_right = (at_middle < 0) & (each < n - 1)
    home = np.where(near_right, each + 1, each)
    poles = d[None, :] - d[home][:, None]
    low = np.where(near_right, -middle, np.where(at_middle < 0, middle, 0.0))
    high = np.where(near_right, 0.0, np.where((each == n - 1) & (at_middle < 0), right - d, middle))
    left_side = each[None, :] <= each[:, None]
    own, after = poles[each, each], np.where(each < n - 1, poles[each, np.minimum(each + 1, n - 1)], np.inf)
    x, noise = (low + high) / 2, 2 * _EPS * math.sqrt(n)
    for _ in range(80):
        gap = poles - x[:, None]
        term = square / gap
        total = 1 / weight + term.sum(axis=1)
        low, high = np.where(total < 0, x, low), np.where(total < 0, high, x)
        slope = term / gap
        before = np.where(left_side, slope, 0.0).sum(axis=1)
        behind = slope.sum(axis=1) - before
        a, b = own - x, np.where(np.isinf(after), 1.0, after - x)
        s, t = before * a * a, np.where(np.isinf(after), 0.0, behind * b * b)
        c = total - a * before - np.where(np.isinf(after), 0.0, b * behind)
        # c + s / (a - step) + t / (b - step) = 0
        with np.errstate(all="ignore"):
            p, q = c * (a + b) + s + t, c * a * b + s * b + t * a
            root = np.sqrt(np.maximum(p * p - 4 * c * q, 0.0))
            step = np.where(p > 0, 2 * q / (p + root), (p - root) / (2 * c))
            step = np.where(np.isinf(after), a + s / c, step)
            new = x + step
        outside = ~((new > low) & (new < high))
        new = np.where(outside, (low + high) / 2, new)
        done = (np.abs(total) <= noise * (1 / weight + np.abs(term).sum(axis=1))) | (np.abs(new - x) <= 4 * _EPS * np.abs(new))
        x = np.where(done, x, new)
        if done.all():
            break
    # A root never lies on a pole.
    return home, np.where(x == 0.0, np.where(near_right, -1.0, 1.0) * np.finfo(float).tiny, x)


def _usable(c):
    return c.isNotNull() & ~F.exists(c, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of whole numbers of a list column whose lists are all equally long."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _pack(spectrum: Spectrum) -> bytes:
    return np.concatenate(([0.0], spectrum.mean, spectrum.values, spectrum.vectors.ravel())).astype("<f8").tobytes()


def _unpack(count: int, data: bytes, dims: int) -> Spectrum:
    flat = np.frombuffer(data, "<f8")[1:]
    return Spectrum(count, flat[:dims].copy(), flat[dims:2 * dims].copy(), flat[2 * dims:].reshape(dims, dims).copy())


def fit_spectrum(fit: DataFrame, dims: int) -> Spectrum:
    """Spectrum of the scatter of ``fit`` (one column ``x`` of equally long lists), by tasks and then by groups of tasks."""
    kind = "id long, count long, body binary"

    def local(batches):
        own = Spectrum.empty(dims)
        for batch in batches:
            for row in _matrix(batch.column(0)) - float(SHIFT):
                own.add(row)
        yield pa.RecordBatch.from_pydict({"id": [0], "count": [own.count], "body": [_pack(own)]})

    def combine(batches):
        held: dict[int, Spectrum] = {}
        for batch in batches:
            for group, count, body in zip(*(c.to_pylist() for c in batch.columns)):
                held.setdefault(group, Spectrum.empty(dims)).merge(_unpack(count, body, dims))
        for group, own in held.items():
            yield pa.RecordBatch.from_pydict({"id": [group], "count": [own.count], "body": [_pack(own)]})

    parts = saved(fit.mapInArrow(local, kind).where("count > 0").withColumn("id", F.spark_partition_id().cast("long")))
    left = parts.count()
    while left > 1:
        dealt = parts.withColumn("id", F.col("id") % -(-left // FAN_IN)).repartition(-(-left // FAN_IN), "id")
        new = saved(dealt.mapInArrow(combine, kind))
        drop(parts)
        parts, left = new, new.count()
    row = parts.first()
    drop(parts)
    return _unpack(row["count"], bytes(row["body"]), dims) if row else Spectrum.empty(dims)


def _summed(fit: DataFrame, of, size: int) -> tuple[int, np.ndarray]:
    """(count, sum) of what ``of`` makes of the rows of ``fit``; doubles, added up once per task and then in Spark."""
    def run(batches):
        total, count = np.zeros(size), 0
        for batch in batches:
            rows = _matrix(batch.column(0))
            if len(rows):
                total, count = total + of(rows).ravel(), count + len(rows)
        yield pa.RecordBatch.from_pydict({"i": np.arange(size + 1), "v": np.append(total, count)})
    out = fit.mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    total = np.zeros(size + 1)
    for r in out:
        total[r.i] = r.v
    return int(total[-1]), total[:-1]


def _sums(fit: DataFrame, dims: int) -> tuple[int, np.ndarray]:
    """(count, exact sums per dimension); sums are whole numbers of any size."""
    def run(batches):
        total, count = [0] * dims, 0
        for batch in batches:
            rows = _matrix(batch.column(0))
            if len(rows):
                total, count = [a + b for a, b in zip(total, rows.sum(axis=0).tolist())], count + len(rows)
        yield pa.RecordBatch.from_pydict({"i": list(range(dims + 1)), "v": [*total, count]}, schema=pa.schema([("i", pa.int64()), ("v", pa.int64())]))
    out = {r.i: int(r.v) for r in fit.mapInArrow(run, "i long, v long").groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()}
    return out.get(dims, 0), np.array([out.get(i, 0) for i in range(dims)], dtype=object)


def whiten(df: DataFrame, components: int = 16) -> DataFrame:
    """One row per usable vector and component: exact distance from the mean, whitened value, share of variance.

    ``df`` has ``vec_id`` and ``embedding``; other columns are ignored. Rows whose vector is null or holds a null or
    non-finite entry are left out. The fit list holds each distinct vector once, however often it occurs; repeated
    rows all come back. Vectors of another length than most (the longer length wins a tie) have no place in the fit
    list; their rows come back with null measures, as do empty vectors. A component without variance has null
    ``whitened``; without any variance ``explained`` is null as well. An empty table gives an empty result.
    ``deviation`` is a decimal of 38 digits, so that it stays exact at any count.
    """
    spark = df.sparkSession
    entries = F.transform("embedding", lambda v: (F.floor(v.cast("double") * SCALE) + SHIFT).cast("long"))
    rows = df.where(_usable(F.col("embedding"))).select("vec_id", entries.alias("x"))
    found = rows.groupBy(F.size("x").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    dims = found.dims if found else 0
    out_kind = "vec_id {}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    out_kind = out_kind.format(df.schema["vec_id"].dataType.simpleString())
    if not dims:
        return _null_rows(rows, components, out_kind)
    tasks = max(spark.sparkContext.defaultParallelism, -(-found["count"] // ROWS_PER_TASK))
    fit = saved(rows.where(F.size("x") == dims).select("x").distinct().repartition(tasks))
    with small_batches(spark, 4000):
        n, sums = _sums(fit, dims)
        basis = fit_spectrum(fit, dims).vectors
        centre = _centred(n, sums)
        _, inner = _summed(fit, lambda x: (y := centre(x) @ basis).T @ y, dims * dims)
        values, turn = np.linalg.eigh(inner.reshape(dims, dims) / n)
        values, vectors = values[::-1], (basis @ turn)[:, ::-1]
        trace = float(np.trace(inner.reshape(dims, dims)) / n)
        most = min(components, dims)
        live = values[:most] > FLAT * max(float(values[0]), 0.0)
        scaled = vectors[:, :most] / np.sqrt(np.where(live, values[:most], 1.0))
        good = int(live.sum())
        error = None
        if good:
            _, square = _summed(fit, lambda x: np.concatenate([(y := centre(x) @ scaled[:, :good]).sum(axis=0), (y.T @ y).ravel()]), good + good * good)
            middle = square[:good] / n
            error = float(np.abs(square[good:].reshape(good, good) / n - np.outer(middle, middle) - np.eye(good)).max())
    drop(fit)
    explained = [float(v) / trace if trace > 0 else None for v in values[:most]]
    usual, limit = [int(s) for s in sums], 2.0 ** 62 / dims

    id_type = to_arrow_type(df.schema["vec_id"].dataType)

    def run(batches):
        schema = pa.schema([("vec_id", id_type), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.decimal128(38, 0)),
                            ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])
        for batch in batches:
            x = _matrix(batch.column(1))
            if not len(x):
                continue
            away = centre(x)
            if n * float(np.abs(away).max()) < math.sqrt(limit):
                exact = ((x * n - np.array(usual, np.int64)) ** 2).sum(axis=1).tolist()
            else:
                exact = [sum((v * n - s) ** 2 for v, s in zip(row, usual)) for row in x.tolist()]
            white = away @ scaled
            mask = np.broadcast_to(~live, white.shape)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(np.repeat(np.arange(len(x)), most)), pa.array(np.tile(np.arange(1, most + 1, dtype=np.int32), len(x))),
                pa.array(np.full(len(x) * most, n)), pa.array([v for v in exact for _ in range(most)], pa.decimal128(38, 0)),
                pa.array(white.ravel(), mask=mask.ravel()), pa.array(explained * len(x), pa.float64()),
                pa.array([error] * (len(x) * most), pa.float64())], schema=schema)
    usable = rows.where(F.size("x") == dims).mapInArrow(run, out_kind)
    return usable.unionByName(_null_rows(rows.where(F.size("x") != dims), components, out_kind, n))


def _centred(n: int, sums: np.ndarray):
    """Function from rows of whole numbers to doubles around the mean; the whole part of the mean is taken off exactly."""
    whole = np.array([int(s) // n for s in sums], np.int64)
    rest = np.array([(int(s) % n) / n for s in sums])
    return lambda x: (x - whole).astype(float) - rest


def _null_rows(rows: DataFrame, components: int, kind: str, n: int = 0) -> DataFrame:
    number = F.explode(F.sequence(F.lit(1), F.lit(components)))
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("deviation", "decimal(38,0)"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double"))]
    return rows.select("vec_id", number.alias("component"), F.lit(n).cast("long").alias("n"), *nothing)


def whitened_vectors(df: DataFrame) -> DataFrame:
    """The digest of :func:`whiten` with ``deviation`` as a long; null beyond its range."""
    return whiten(df).withColumn("deviation", F.expr("try_cast(deviation as bigint)"))
