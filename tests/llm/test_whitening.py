"""Whitening against numpy on all vectors at once."""
import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tabred.llm import whitening


@settings(max_examples=25, deadline=None)
@given(st.integers(1, 6), st.lists(st.integers(-3, 3), min_size=1, max_size=60), st.integers(0, 10))
def test_updates_and_merges_give_the_scatter(dims, flat, cut):
    rows = np.array((flat * dims)[:len(flat) // dims * dims or dims], float).reshape(-1, dims)
    parts = [whitening.Spectrum.empty(dims) for _ in range(3)]
    for i, row in enumerate(rows):
        for own in (parts[0], parts[1 + (i >= cut)]):
            own.add(row)
    parts[1].merge(parts[2])
    away = rows - rows.mean(axis=0)
    for own in parts[:2]:
        assert np.allclose(own.vectors @ np.diag(own.values) @ own.vectors.T, away.T @ away, atol=1e-9)
        assert np.allclose(own.vectors.T @ own.vectors, np.eye(dims), atol=1e-12)
        assert np.allclose(own.mean, rows.mean(axis=0)) and own.count == len(rows)


def test_secular_roots_lie_between_poles():
    rng = np.random.default_rng(5)
    for n in (1, 2, 7, 40):
        d, z, w = np.sort(rng.normal(size=n)), rng.normal(size=n) * 10.0 ** rng.integers(-4, 1, n), 0.7
        home, shift = whitening.secular_roots(d, z, w)
        assert np.allclose(d[home] + shift, np.linalg.eigvalsh(np.diag(d) + w * np.outer(z, z)), atol=1e-12)


def expected(vectors, components=16):
    x = np.floor(64 * np.array(vectors, np.float64)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    away = (n * fit - sums) / n
    cov = away.T @ away / n
    values, vecs = np.linalg.eigh(cov)
    return x, n, sums, values[::-1][:components], vecs[:, ::-1][:, :components], np.trace(cov)


def test_given_vectors(spark, folder):
    df = spark.read.parquet(f"{folder}/embeddings.parquet")
    copies = df.limit(3).withColumn("vec_id", F.col("vec_id") + 1_000_000)
    both = df.unionByName(copies)
    rows = both.collect()
    got = whitening.whitened_vectors(both).collect()
    assert len(got) == 16 * len(rows)
    x, n, sums, values, vecs, trace = expected([r.embedding for r in rows])
    at = {r.vec_id: i for i, r in enumerate(rows)}
    white = np.full((len(rows), 16), np.nan)
    for r in got:
        white[at[r.vec_id], r.component - 1] = r.whitened
        assert r.n == n and r.deviation == sum((n * int(v) - int(s)) ** 2 for v, s in zip(x[at[r.vec_id]], sums))
        assert abs(r.explained - values[r.component - 1] / trace) <= 1e-10 and r.identity_error < 1e-9
    want = (n * x - sums) / n @ vecs / np.sqrt(values)
    signs = np.sign((white * want).sum(axis=0))
    assert np.allclose(white, want * signs, atol=1e-7)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, 0.25, 1.0]), (2, [0.5, 0.25, 1.0]), (2, [0.5, 0.25, 1.0]), (None, [1.5, 0.75, 1.0]), (3, None), (4, [1.0, None, 2.0]),
            (5, [nan, 1.0, 1.0]), (6, [1.0, inf, 1.0]), (7, []), (8, [1.0]), (9, [-3.0, 2.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("n", F.lit("x")).withColumn("component", F.lit("y"))
    got = whitening.whitened_vectors(df).collect()
    from collections import Counter
    assert Counter(r.vec_id for r in got) == {1: 3, 2: 6, None: 3, 9: 3, 7: 16, 8: 16}
    assert all(r.n == 3 and r.whitened is None and r.deviation is None for r in got if r.vec_id in (7, 8))
    whole = [r for r in got if r.vec_id in (1, 9)]
    assert all((r.whitened is None) == (r.component == 3) for r in whole)
    assert {r.deviation for r in got if r.vec_id == 1} == {sum((3 * a - s) ** 2 for a, s in zip((32, 16, 64), (-64, 192, 192)))}
    assert all(r.identity_error < 1e-12 for r in whole)
    one = whitening.whitened_vectors(df.where("vec_id = 1")).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 0, None, None, None)] * 3
    assert whitening.whitened_vectors(df.limit(0)).count() == 0
    assert whitening.whitened_vectors(df.where("vec_id = 3")).count() == 0


@pytest.mark.parametrize("spread", [1, 10 ** 7])
def test_deviation_is_exact_beyond_a_long(spark, spread):
    rows = [(i, [float(spread * i), float(-i)]) for i in range(200)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).where("component = 1").collect()
    x = [[64 * spread * i + 1_000_000, -64 * i + 1_000_000] for i in range(200)]
    sums = [sum(c) for c in zip(*x)]
    assert all(int(r.deviation) == sum((200 * a - s) ** 2 for a, s in zip(x[r.vec_id], sums)) for r in got)
