"""What queries move and write must not grow with columns that they do not need."""
import contextlib
import io

import pytest
from pyspark.sql import functions as F

from tabred.operators import fold, updates
from tabred.schemas import mask_of
from tabred.sources.tables import tpch_view

TWICE = mask_of("L_PS", "L_O", "PS_S", "O_C", "C_N", "S_N")


def plan(df) -> str:
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain("formatted")
    return text.getvalue()


def moved(df) -> list[str]:
    """What the shuffles of a plan take in."""
    lines = plan(df).split("\n")
    return [lines[i + 1] for i, line in enumerate(lines) if "Exchange" in line and line.startswith("(") and "Input" in lines[i + 1]]


def test_lossless_check_folds_narrow_rows_and_still_sees_differences(spark, folder, monkeypatch):
    t = tpch_view(spark, folder)
    seen = []
    keep = fold.written
    monkeypatch.setattr(fold, "written", lambda df: seen.append(df) or keep(df))
    assert all(r["differing"] == 0 for r in fold.check_lossless(t, TWICE).collect())
    assert seen and not any(c.endswith("comment") for df in seen for c in df.columns)
    whole = fold.fold_root

    def wrong(narrow, root, codes, layout=None):
        frame = whole(narrow, root, codes, layout)
        return frame.withColumn("s_digest", F.when(F.col("l_suppkey") == 1, 0).otherwise(F.col("s_digest"))).where("o_custkey <> 2")

    monkeypatch.setattr(fold, "fold_root", wrong)
    got = dict(map(tuple, fold.check_lossless(t, TWICE).collect()))
    assert got["S"] == 2 and got["C"] == 1 and got["O"] == t["orders"].where("o_custkey = 2").count() and got["N"] == 0


def test_recompose_check_reads_narrow_rows_once_and_still_sees_differences(spark, monkeypatch):
    from tabred.operators import normalize
    split = normalize.plan_splits("line", ["o", "n", "q", "c", "s", "g", "r"], ["o", "n"], [(["o"], ["c", "s"]), (["c"], ["g", "r"])])
    seen = []
    keep = normalize.written
    monkeypatch.setattr(normalize, "written", lambda df: seen.append(df.columns) or keep(df))
    good = [(None if o == 3 else o, n, f"text {o * n}", o % 4 if o != 6 else None, f"state {o}", f"segment {o % 4 if o != 6 else 9}", None if o % 4 == 1 else o % 4 + 0.5)
            for o in range(12) for n in range(3)]
    check = lambda rows: normalize.check_recompose(spark.createDataFrame(rows, "o int, n int, q string, c int, s string, g string, r double"), split, "line").first()[0]
    assert check(good) == 0
    assert seen and all(not {"q", "s", "g", "r"} & set(c) for c in seen)
    def old(rows):
        df = spark.createDataFrame(rows, "o int, n int, q string, c int, s string, g string, r double")
        whole = normalize.recompose(normalize.normalize_by_fds(df, split), split, "line").select(*df.columns)
        return normalize.multiset_difference(whole, df).count()
    again = [*good, good[5]]                                              # a row twice comes back once
    broken = [(*good[0][:4], "other", *good[0][5:]), *good[1:]]           # an order with two states keeps one of them
    assert check(again) == old(again) == 1
    assert check(broken) in (2, 4) and old(broken) in (2, 4)


def test_structural_delta_and_update_check_move_no_comments(spark, folder):
    t = tpch_view(spark, folder)
    batch = t["nation"].select("n_nationkey", F.concat("n_comment", F.lit("!")).alias("a1"), F.col("n_nationkey").alias("ordinal"))
    for df in (fold.structural_delta(t, TWICE), updates.check_update(t, TWICE, "L", "N", batch)):
        inputs = moved(df)
        assert inputs and not any(c in text for text in inputs for c in ("l_comment", "o_comment", "c_comment", "ps_comment"))


def test_update_check_sees_a_row_that_was_not_updated(spark, folder, monkeypatch):
    t = tpch_view(spark, folder)
    batch = t["nation"].select("n_nationkey", F.concat("n_comment", F.lit("!")).alias("a1"), F.col("n_nationkey").alias("ordinal"))
    keep = updates.apply_to_fold
    monkeypatch.setattr(updates, "apply_to_fold", lambda *a: keep(*a[:4], batch.where("n_nationkey <> 3"), a[5]))
    touched = t["orders"].join(t["customer"].where("c_nationkey = 3"), F.col("o_custkey") == F.col("c_custkey")).count()
    assert updates.check_update(t, mask_of("O_C", "C_N"), "O", "N", batch).first()[0] == 2 * touched > 0


def test_walk_vectors_do_not_depend_on_blocks_and_pairs_are_not_written(spark, monkeypatch):
    from tabred.operators import embed
    ring = spark.range(40).select(F.concat(F.lit("n"), F.col("id")).alias("src"), F.concat(F.lit("n"), (F.col("id") + 1) % 40).alias("dst"))
    both = ring.unionAll(ring.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    seen = []
    keep = embed.written
    monkeypatch.setattr(embed, "written", lambda df: seen.append(df.columns) or keep(df))
    one = {r["id"]: r["vec"] for r in embed.node2vec(both, walks=2, length=8).collect()}
    monkeypatch.setattr(embed, "BLOCK", 7)
    many = {r["id"]: r["vec"] for r in embed.node2vec(both, walks=2, length=8).collect()}
    assert len(one) == 40 and one.keys() == many.keys() and ["src", "dst"] not in seen
    assert all(abs(x - y) < 1e-5 for k in one for x, y in zip(one[k], many[k]))


def test_walk_product_adds_every_pair_near_on_walks_in_parts_and_dimensions(spark, monkeypatch):
    import numpy as np
    from tabred.operators import embed
    links = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "end"), ("e", "a"), ("a", "a")]          # ``end`` has no neighbour
    both = spark.createDataFrame(links * 3 + [(None, "a"), ("x", None)], "src string, dst string")
    want = {r["id"]: r["vec"] for r in embed.node2vec(both, walks=9, length=7, window=2).collect()}
    ids = [*"abcde", "end"]
    assert set(want) == set(ids)
    for name, value in (("CELLS", 30), ("RANGE", 2), ("BLOCK", 4), ("STEPS", 50)):
        monkeypatch.setattr(embed, name, value)
    plan = embed._Plan.of(6, 128, 4)
    assert plan.blocks == 2 and plan.width == 7 and len(plan.chunks) == 19
    got = {r["id"]: r["vec"] for r in embed.node2vec(both, walks=9, length=7, window=2).collect()}
    assert all(got[k] == pytest.approx(want[k], abs=1e-5) for k in ids)
    # One task against sums over listed pairs.
    plan = embed._Plan(6, 3, 2, 3, 3, 1)
    task = embed._Product(plan, 0, 2, 5, 2, 1)
    path = np.array([[0, 1, 2, 0, 3], [4, 5, 6, 6, 6], [1, 1, 1, 2, 5]]).T
    task.vectors[:, :6] = np.random.default_rng(1).normal(size=(3, 6))
    task.add(path)
    near = np.zeros((3, 7))
    for walk in path.T:
        for i, j in ((i, j) for i in range(5) for j in range(5) if i != j and abs(i - j) <= 2):
            near[:, walk[i]] += task.vectors[:, walk[j]]
    assert np.allclose(task.sums[:, :6], near[:, :6], atol=1e-5)
    monkeypatch.setattr(embed, "HELD_EDGES", 0)
    assert {r["id"] for r in embed.node2vec(both, walks=9, length=7, window=2).collect()} == set(ids)


def test_group_cosines_equal_those_of_every_pair_and_no_member_meets_all_groups(spark):
    import numpy as np
    from tabred.operators import evaluate
    rng = np.random.default_rng(3)
    vectors = {i: rng.normal(size=4) for i in ("m0", "m1", "m2", "m3", "g0", "g1", "g2")} | {"m4": np.zeros(4)}
    members = [("m0", "g0"), ("m1", "g0"), ("m2", "g1"), ("m3", "g2"), ("m4", "g2"), ("m4", "g2"), ("gone", "g1"), ("m1", "lost"), ("m2", None)]
    cosine = lambda a, b: float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)) if a.any() and b.any() else 0.0
    pairs = [(g == o, cosine(vectors[m], vectors[o])) for m, g in members if m in vectors and g for o in ("g0", "g1", "g2")]
    got = evaluate.group_cosines(spark.createDataFrame(members, "id string, group string"),
                                 spark.createDataFrame([(k, v.tolist()) for k, v in vectors.items()], "id string, vec array<double>"), 4).first()
    for own, name in ((True, "own"), (False, "other")):
        assert got[name] == pytest.approx(np.mean([c for same, c in pairs if same == own]))


def test_query_tables_hold_every_row_and_only_used_columns(spark, folder):
    from tabred.plans import flat
    t = tpch_view(spark, folder)
    whole = flat.materialize_join(t, 5, ("L", "O", "C")).frame
    kept = flat.query_table(spark, t, folder, 5, ("L", "O", "C")).frame
    assert kept.count() == whole.count()
    assert set(kept.columns) < set(whole.columns) and not any(c.endswith("comment") for c in kept.columns)
    assert flat.template(spark, t, folder, 5, ("L", "O", "C")).count()


def test_rewired_edges_of_a_parent_are_sliced_and_whole(spark):
    edges = spark.createDataFrame([("O_C", "O", 1, "C", 5), ("S_N", "S", 9, "N", 2), ("C_N", "C", 5, "N", 2), ("N_R", "N", 2, "R", 0)],
                                  "type string, src_label string, src long, dst_label string, dst long")
    pairs = spark.range(200).select(F.col("id").alias("child"), F.lit(2).cast("long").alias("parent"))
    got = fold.rewire_edges(edges, pairs, "C", "N", "CN", "C_N")
    assert "_slice" in plan(got)
    found = sorted(tuple(r) for r in got.collect())
    assert found == sorted([("O_C", "O", 1, "CN", 5), *[("S_N", "S", 9, "CN", c) for c in range(200)], *[("N_R", "CN", c, "R", 0) for c in range(200)]])


def test_rewired_edges_are_made_from_lists_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(fold, "SLICE_ROWS", 10)
    edges = spark.createDataFrame([("S_N", "S", 9, "N", 2), ("S_N", "S", 8, "N", 2), ("S_N", "S", 7, "N", 3), ("S_N", "S", 7, "N", 4)],
                                  "type string, src_label string, src long, dst_label string, dst long")
    pairs = spark.range(2000).select(F.col("id").alias("child"), (F.col("id") % 2 + 2).alias("parent"))
    got = fold.rewire_edges(edges, pairs.unionAll(spark.sql("select cast(null as bigint), 3L")), "C", "N", "CN", "C_N")
    assert "inline(_children" in plan(got) and "SortMergeJoin" in plan(got)
    found = sorted((r["src"], -1 if r["dst"] is None else r["dst"]) for r in got.collect())
    assert found == sorted([(s, c) for s in (9, 8) for c in range(0, 2000, 2)] + [(7, c) for c in range(1, 2000, 2)] + [(7, -1)])


def test_runs_that_counting_decides_get_no_matching(spark, monkeypatch):
    from tabred.operators import compare

    def refused(*_):
        raise AssertionError("matched one by one")

    frame = lambda values: spark.createDataFrame(values, "k string, v double")
    left = frame([("a", float(i)) for i in range(50)] + [("a", 7.0), ("b", 1e12), ("b", None)])
    right = frame([("a", i + 0.5) for i in range(50)] + [("a", 7.00000001), ("b", 1e12 + 1), ("b", None), ("b", None)])
    keep = compare.matched_rows
    monkeypatch.setattr(compare, "matched_rows", refused)
    assert tuple(compare.compare_results(left, right).first()) == (False, 101)
    monkeypatch.setattr(compare, "matched_rows", keep)
    chain = [frame([("a", x * 1e-7) for x in side]) for side in ((0, 1.6, 3.2), (0.8, 2.4, 4.9))]
    assert tuple(compare.compare_results(*chain).first()) == (False, 2)


def test_value_bins_halve_their_bounds_and_count_those_below(spark):
    from tabred.operators import ranking
    df = spark.range(5000).select((F.col("id") * 7919 % 5003).cast("double").alias("v")).unionAll(spark.createDataFrame([(None,), (float("nan"),)], "v double"))
    for bins in (2, 3, 64, 100):
        got = ranking.with_value_bins(df, "v", "bin", bins)
        assert "filter(" not in plan(got)
        bounds = df.agg(F.percentile_approx("v", [i / bins for i in range(1, bins)], max(1000, 10 * bins))).first()[0]
        for v, at in got.collect():
            assert at == (0 if v is None else len(set(bounds)) if v != v else sum(b < v for b in set(bounds)))


def test_sweep_of_q16_counts_suppliers_once_for_all_sets(spark, folder):
    from tabred.plans import sweep, tpch
    t = tpch_view(spark, folder)
    sets = sweep.parameter_sets(16, 4, 5)
    got = sweep.run_param_sweep(t, 16, sets)
    assert moved(got) and not any("run#" in text for text in moved(got))
    columns = ("p_brand", "p_type", "p_size", "supplier_cnt")
    want = sorted((i, *[r[c] for c in columns]) for i, p in enumerate(sets) for r in tpch.run(t, 16, p).collect())
    assert want and sorted((r["run"], *[r[c] for c in columns]) for r in got.collect()) == want


def sorted_aggregates(df) -> bool:
    return "SortAggregate" in plan(df)


def test_discovery_combines_values_without_sorting_rows(spark, folder, monkeypatch):
    from tabred.operators import fds
    rows = [(f"x{i % 40}", f"y{i % 40 % 7}" if i % 3 else None, "z" if i == 5 else f"z{i % 40 % 4}", f"k{i}") for i in range(4000)]
    df = spark.createDataFrame(rows, "x string, y string, z string, k string")
    for share in (1, 64):                                   # all values looked at first, and few of them
        monkeypatch.setattr(fds, "REFUTED_ON", share)
        got = fds.discover_fds(df)
        assert not sorted_aggregates(got)
        assert [tuple(r) for r in got.collect()] == [("x", "y", sum(i % 3 > 0 for i in range(4000)), sum(i % 3 > 0 for i in range(4000)) / 4000, 40, 40, sum(i % 3 > 0 for i in range(4000)), sum(i % 3 > 0 for i in range(4000)) - 40)]
    assert fds.discover_fds(df.select("k", "z").limit(3)).collect() == []


def test_order_info_asks_for_no_tables_beside_its_own(spark, folder):
    from tabred.catalog.fold import order_info
    assert set(order_info(spark, f"{folder}/.").columns) >= {"o_orderkey", "r_name"}
    assert "partsupp" not in tpch_view(spark, f"{folder}/.")._made


def test_classes_meet_their_cells_once_and_keep_what_one_class_refutes(spark, monkeypatch):
    from tabred.operators import fds
    data = [(c, f"r{i}", f, v) for c in "AB" for i in range(300) for f, v in (("x", f"x{i % 30}"), ("y", f"y{i % 5}" if c == "A" else f"y{i % 7}"), ("k", f"k{i}"))]
    data += [("A", "r0", "y", "other"), ("A", "r1", "y", None), ("A", "none", "x", None), ("A", None, "x", "x1"), (None, "r", "x", "x1")]
    cells = spark.createDataFrame(data, "class string, row string, field string, term string")
    for share in (1, 64):
        monkeypatch.setattr(fds, "REFUTED_ON", share)
        got = fds.discover_fds_by_class(cells)
        assert not sorted_aggregates(got)
        found = {(r["class"], r["x"], r["y"]): r.asDict() for r in got.collect()}
        assert set(found) == {("A", "x", "y")}
        assert found["A", "x", "y"] == {"class": "A", "x": "x", "y": "y", "eligible_rows": 299, "coverage": 299 / 301, "distinct_x": 30, "distinct_y": 5,
                                        "repeated_groups": 30, "rows_in_repeated": 299, "redundant_rows": 269}
    assert fds.discover_fds_by_class(cells, min_rows=301).count() == 1 and fds.discover_fds_by_class(cells, max_rows=300).count() == 0
