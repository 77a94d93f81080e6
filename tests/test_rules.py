"""Driver-side rules: candidates, masks, splits, registry."""
import random

import __spark_entry__ as entry
from tabred.operators import fold, normalize
from tabred.plans.graphs import FOLDABLE, candidates
from tabred.plans.sweep import parameter_sets
from tabred.schemas import TABLE_OF, mask_codes


def test_74_candidates_over_16_queries():
    assert len(FOLDABLE) == 16
    assert sum(len(candidates(q)) for q in FOLDABLE) == 74


def test_every_mask_represents_every_table():
    for mask in range(256):
        codes = mask_codes(mask)
        layouts = {r: fold.Layout(r, codes) for r in fold.roots(codes)}
        seen = {w.end(p) for w in layouts.values() for p in w.paths}
        assert seen == set(TABLE_OF)
        for r in fold.folded_roots(codes):
            outs = [o for p in layouts[r].paths for o in layouts[r].stored(p).values()]
            assert len(outs) == len(set(outs))


def test_nation_twice_is_suffixed_and_keys_are_located():
    layout = fold.Layout("L", mask_codes(123))
    nations = layout.places("N")
    assert len(nations) == 2
    assert {layout.column(p, "n_nationkey") for p in nations} == {"c_nationkey", "s_nationkey"}
    assert all("n_nationkey" not in layout.stored(p) and layout.stored(p)["n_name"].startswith("n_name__") for p in nations)


FEATURES = ["product", "customer", "shipper", "orderDate", "orderTime", "address", "paymentMethod", "quantity", "discount"]
KEY = ["product", "customer", "orderDate", "orderTime"]
X1, X2 = ["customer", "orderDate", "orderTime"], ["customer", "orderDate", "address"]


def test_running_example_splits_and_blocks():
    one = normalize.plan_splits("OrderInfo", FEATURES, KEY, [(X1, ["address", "paymentMethod", "shipper"])])
    assert (one.splits, len(one.blocked)) == (1, 0)
    two = normalize.plan_splits("OrderInfo", FEATURES, KEY, [(X1, ["address", "paymentMethod"]), (X2, ["shipper"])])
    assert (two.splits, len(two.blocked)) == (1, 1)


def test_order_of_splits_does_not_matter():
    fds = [(["b"], ["c", "d"]), (["d"], ["e"]), (["f"], ["g"]), (["c"], ["h"])]
    outcomes = set()
    for seed in range(20):
        rng = random.Random(seed)
        s = normalize.plan_splits("t", list("abcdefgh"), ["a", "b", "f"], fds, pick=rng.choice)
        outcomes.add((s.splits, len(s.blocked), tuple(sorted(tuple(s.flat(t.features)) for t in s.types))))
    assert len(outcomes) == 1


def test_parameter_sets_repeat_and_cover_all_queries():
    for q in range(1, 23):
        assert parameter_sets(q, 50, 1) == parameter_sets(q, 50, 1)
        assert len(parameter_sets(q, 50, 1)) == 50


def test_registry_covers_templates_and_oracles_have_queries():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q)
    assert sum(1 for n in q if n.startswith("t") and n.split("_")[0][1:].isdigit() and "stream" not in n and "windowed" not in n and "one_year" not in n) == 74
    assert {f"q{i}" for i in range(1, 23)} <= {n.split("_")[0] for n in q}


def test_reduced_dependencies_are_equivalent_and_tight():
    import itertools
    import numpy as np
    rng = np.random.default_rng(3)
    names = list("abcdef")
    every = np.array(list(itertools.product((False, True), repeat=6)))
    for _ in range(40):
        fds = [(rng.choice(names, rng.integers(1, 4), replace=False).tolist(), rng.choice(names, rng.integers(1, 3), replace=False).tolist()) for _ in range(rng.integers(1, 7))]
        given = normalize.Dependencies.of(names, fds)
        tight = given.reduced()
        assert (given.closure(every) == tight.closure(every)).all()
        for i, side in enumerate(tight.left):
            assert (tight.without(i).closure(side[None]) != given.closure(side[None])).any()
            for c in np.flatnonzero(side):
                less = side.copy()
                less[c] = False
                assert not less.any() or (given.closure(less[None]) != given.closure(side[None])).any()
