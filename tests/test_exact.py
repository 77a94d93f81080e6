"""Exact quantiles and the tolerance comparison against plain forms."""
import itertools
import random

import numpy as np
import pytest

from tabred.operators import compare, ranking


def test_quantiles_of_a_group_with_most_rows(spark):
    rng = random.Random(4)
    rows = [("hot", float(rng.randrange(50)), None)] * 0 + [("hot", float(rng.randrange(400)), rng.random()) for _ in range(3000)]
    rows += [(f"g{i % 40}", rng.choice([None, rng.random(), -1.0]), rng.random()) for i in range(1000)] + [(None, 2.0, None), (None, 4.0, None), ("none", None, 1.0)]
    df = spark.createDataFrame(rows, "k string, v double, w double")
    got = {r.k: r for r in ranking.exact_quantiles(df, ["k"], {"a": ("v", 0.25), "b": ("v", 0.5), "c": ("w", 0.9)}).collect()}
    for k in {r[0] for r in rows}:
        for name, i, q in (("a", 1, 0.25), ("b", 1, 0.5), ("c", 2, 0.9)):
            own = [r[i] for r in rows if r[0] == k and r[i] is not None]
            assert got[k][name] == (pytest.approx(np.quantile(own, q), rel=1e-12) if own else None)
    assert ranking.exact_quantiles(df.limit(0), [], {"a": ("v", 0.5)}).collect()[0].a is None


def frame(spark, rows, schema="x double, y double"):
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("left,right", [([(1.0, 5.0), (1.0 + 1e-12, 3.0)], [(1.0 + 1e-12, 5.0), (1.0, 3.0)]), ([(0.0, 0.0), (-6e-8, 0.0)], [(0.0, 0.0), (6e-8, 0.0)]),
                                        ([(None, 1.0), (2e6, None)], [(2e6 + 1e-5, None), (None, 1.0 + 1e-9)])])
def test_rows_that_match_crosswise_are_equal(spark, left, right):
    r = compare.compare_results(frame(spark, left), frame(spark, right)).first()
    assert (r.equal, r.unmatched) == (True, 0)


def test_comparison_finds_the_greatest_matching(spark):
    rng = random.Random(9)
    for _ in range(1):
        left, right = ([(rng.randrange(6) * 0.6e-7, rng.randrange(4) * 0.6e-7) for _ in range(6)] for _ in range(2))
        near = lambda u, v: all(abs(x - y) <= 1e-7 for x, y in zip(u, v))
        best = max(sum(near(u, v) for u, v in zip(left, p)) for p in itertools.permutations(right))
        r = compare.compare_results(frame(spark, left), frame(spark, right)).first()
        assert r.unmatched == 12 - 2 * best and r.equal == (best == 6)
    r = compare.compare_results(frame(spark, [(float("nan"), 1.0), (1.0, 1.0)]), frame(spark, [(float("inf"), 1.0), (1.0, 1.1)])).first()
    assert (r.equal, r.unmatched) == (False, 4)
