"""Operators that compare, number or pack documents, and the pipeline."""
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tabred.llm import catalog, components, jaccard, neighbours, packing, sharding, words
from tabred.llm.tables import numbered
from tests_brute import roots, shingles, similar_groups


def test_weights_and_growth(spark):
    keys = spark.range(20_000).withColumn("k", F.col("id").cast("string"))
    at = lambda weights: [r[0] for r in sharding.shard_rows(keys, ["k"], weights).orderBy("id").select("shard").collect()]
    three, four, double = at([1.0, 1.0, 1.0]), at([1.0, 1.0, 1.0, 1.0]), at([1.0, 1.0, 2.0])
    assert all(a == b or b == 3 for a, b in zip(three, four)) and 0.22 < four.count(3) / 20_000 < 0.28
    assert all(a == b or b == 2 for a, b in zip(three, double)) and 0.47 < double.count(2) / 20_000 < 0.53
    with pytest.raises(ValueError):
        sharding.shard_rows(keys, ["k"], [1.0, 0.0])


def test_shards_of_documents(odd):
    rows = sharding.shard_documents(odd, 5).collect()
    want = Counter((r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in odd.collect())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 5)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert sharding.shard_documents(odd.limit(0)).count() == 0


def test_numbering_splits_a_hot_row(spark):
    rows = spark.range(1000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("x"), F.lit(1).alias("k"))
    assert sorted(r.at for r in numbered(rows, ["k"], "at").collect()) == list(range(1000))


def test_components_of_random_links(spark):
    rng = np.random.default_rng(5)
    links = [tuple(map(int, p)) for p in rng.integers(0, 300, (200, 2))] + [(i, i + 1) for i in range(400, 460)] + [(500, i) for i in range(501, 560)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = roots(sorted({n for p in links for n in p}), links)
    assert got == {n: c for n, c in want.items() if n in got} and all(n in got for n, c in want.items() if n != c)
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("k, percent", [(3, 90), (5, 80)])
def test_similar_documents(spark, odd, documents, k, percent):
    base = "w0 w1 w2 w3 w4 w5 w6 w7 w8 w9 " * 3 + " ".join(f"v{i}" for i in range(60))
    family = [(5000 + i, base.replace(f"v{i % 60} ", f"u{i} ").replace(f"v{(7 * i) % 60} ", "" if i % 3 else "t ")) for i in range(120)]
    rows = odd.select("doc_id", "text").union(documents.select(F.col("doc_id") + 100, "text")).union(spark.createDataFrame(family, "doc_id long, text string"))
    every = rows.collect()
    group, sets = similar_groups([r[1] for r in every], k, percent)
    ids = defaultdict(list)
    for i, root in group.items():
        ids[root].append(every[i][0])
    least = {root: min((x for x in m if x is not None), default=None) for root, m in ids.items()}
    want = Counter((r[0], len(sets[i]), least[group[i]]) for i, r in enumerate(every))
    assert Counter(tuple(r) for r in jaccard.similar_documents(rows, k, percent).collect()) == want


def test_one_of_each(odd, documents):
    rows = odd.unionByName(documents.withColumn("doc_id", F.col("doc_id") + 100), allowMissingColumns=True)
    every = rows.select("doc_id", "text").collect()
    group, sets = similar_groups([r.text for r in every], 5, 80)
    some = Counter(group[i] for i in range(len(every)) if sets[i])
    kept = jaccard.one_of_each(rows, 5, 80)
    assert kept.columns == rows.columns
    got = kept.select("doc_id", "text").collect()
    assert len(got) == len(some) + sum(not s for s in sets)
    assert {r.doc_id for r in got if shingles(r.text or "", 5)} == {min((every[i].doc_id for i in range(len(every)) if group[i] == g and every[i].doc_id is not None), default=None) for g in some}
    assert jaccard.one_of_each(rows.limit(0)).count() == 0


def test_prefixes_share_what_is_asked(monkeypatch):
    rng = np.random.default_rng(8)
    common = (np.arange(200, dtype=np.uint64), np.arange(200, 0, -1).astype(np.int64) * 50)
    for _ in range(300):
        x = set(rng.choice(400, int(rng.integers(3, 60)), replace=False).tolist())
        y = set(x)
        for t in rng.choice(sorted(x), min(len(x) - 1, int(rng.integers(0, 4))), replace=False).tolist():
            y.discard(t)
            y.add(int(rng.integers(400, 500)))
        if 100 * len(x & y) < 80 * len(x | y):
            continue
        (p, l, _), (q, m, _) = (jaccard.prefix_of(np.array(sorted(s), np.uint64), common, 80) for s in (x, y))
        asked = min(l, m)
        assert len(set(p[:len(p) - l + asked].tolist()) & set(q[:len(q) - m + asked].tolist())) >= asked


def test_near_vectors(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 16))
    vectors = [c + rng.normal(size=16) * s for c in centres for s in (0.05, 0.1, 0.2, 0.3, 0.05)] + list(rng.normal(size=(100, 16)))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    rows += [(1000 + i, rows[3][1]) for i in range(30)] + [(1000, rows[3][1]), (2000, None), (2001, [0.0] * 16), (2002, [1.0, None]), (2003, [float("nan")] * 16),
                                                         (2004, [float("inf")] + [0.0] * 15), (2005, [1.0, 0.0]), (2006, [2.0, 0.0]), (2007, [])]
    got = neighbours.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    usable = [i for i, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    unit = {i: np.array(rows[i][1]) / np.linalg.norm(rows[i][1]) for i in usable}
    links = [(i, j) for i in usable for j in usable if i < j and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.9]
    root, degree = roots(range(len(rows)), links), Counter(x for p in links for x in p)
    want = Counter((rows[i][0], degree[i], rows[root[i]][0], rows[i][0] == rows[root[i]][0]) for i in range(len(rows)))
    assert Counter(tuple(r) for r in got) == want
    assert neighbours.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_graph_recall():
    rng = np.random.default_rng(1)
    data = neighbours.unit(np.repeat(rng.normal(size=(150, 24)), 12, axis=0) + rng.normal(size=(1800, 24)) * 0.12)
    rng.shuffle(data)
    graph = neighbours.Graph(data.astype(np.float32))
    beam, found, there = neighbours._audited(graph, data[:128], data, 0.9)
    assert there > 128 and found >= 0.99 * there


def test_audit_has_links_and_an_exact_way_out(spark, monkeypatch):
    rng = np.random.default_rng(4)
    data, far = neighbours.unit(rng.normal(size=(1000, 48))), neighbours.unit(rng.normal(size=(512, 48)))
    assert not (far @ data.T >= 0.9).any()
    graph = neighbours.Graph(data.astype(np.float32))
    beam, found, there = neighbours._audited(graph, far, data, 0.9)
    assert beam and there >= 128 and found >= 0.99 * there
    for layer in graph.layers:
        layer.links[:] = -1                                      # no node is reached by any beam
    beam, found, there = neighbours._audited(graph, data, data, 0.9)
    assert beam == 0 and found == there > 128
    row, hit = neighbours._exact(data, data, 0.9)
    assert Counter(zip(row.tolist(), hit.tolist())) == Counter(zip(*[x.tolist() for x in np.nonzero(data @ data.T >= 0.9)]))
    bad = spark.createDataFrame([(2, 0, 32, 989_999)], "kind int, a long, b long, n long")
    monkeypatch.setattr(neighbours, "search_links", lambda *_: bad)
    with pytest.raises(RuntimeError, match="1 audits"):
        neighbours.near_vectors(spark.createDataFrame([(1, [1.0, 2.0])], "vec_id long, embedding array<double>"))


def test_dense_shards_are_answered_whole_in_bounded_memory():
    import tracemalloc
    rng = np.random.default_rng(7)
    data = neighbours.unit(np.concatenate([rng.normal(size=32) + 0.1 * rng.normal(size=(1500, 32)), rng.normal(size=(1500, 32))]))
    rng.shuffle(data)
    graph = neighbours.Graph(data.astype(np.float32))
    tracemalloc.start()
    row, hit = graph.near(data[:512].astype(np.float32), 32, 0.9)
    beam, found, there = neighbours._audited(graph, data, data, 0.9)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    real = set(zip(*[x.tolist() for x in np.nonzero(data[:512] @ data.T >= 0.9001)]))
    assert len(real) > 200_000 and len(real - set(zip(row.tolist(), hit.tolist()))) < 0.01 * len(real)
    assert found >= 0.99 * there and peak < 96e6


def test_graphs_keep_doubles_that_floats_would_change(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.1, 0.995]), (2, [0.1000000001, 0.995]), (3, [0.0, 1.0])]
    assert neighbours._short(np.array([r[1] for r in rows])).dtype == np.float64
    assert neighbours._short(np.array([[1.0, 0.5], [0.25, 0.0]])).dtype == np.float32
    got = {r["vec_id"]: r["n_links"] for r in neighbours.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), threshold=0.9949).collect()}
    assert got == {0: 0, 1: 2, 2: 2, 3: 2}


def _valid(rows, capacity):
    """Places in each sequence are gapless and within the capacity."""
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        end = 0
        for at, n in sorted(places):
            assert at == end
            end += n
        assert end <= capacity
    return len(by)


def test_packing(odd, documents, vocabulary, ranks):
    from tabred.llm import bpe
    rows = odd.select("doc_id", "text").union(documents.select(F.col("doc_id") + 100, "text"))
    got = packing.pack_documents(rows, vocabulary).collect()
    enc, want = bpe.encoding(*ranks), Counter()
    for doc, text in rows.collect():
        ids = np.array([*enc.encode_ordinary(text or ""), 2], "<u4")
        first = (len(ids) - 1) % 1024 + 1
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
            want[doc, i, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    total = sum(r.length for r in got)
    assert _valid(got, 1024) <= 1.06 * -(-total // 1024) + 1
    assert packing.pack_documents(odd.limit(0), vocabulary).count() == 0


def test_plans_place_every_piece():
    rng = np.random.default_rng(4)
    for size in (0, 1, 50, 5000):
        lengths = Counter(int(x) for x in rng.integers(1, 1025, size))
        plan = packing.Plan(lengths)
        placed, sequences = Counter(), defaultdict(list)
        for n, rank, count, first, at in plan.rows:
            assert rank == placed[n]
            placed[n] += count
            for i in range(count):
                sequences[first + i].append((at, n))
        assert placed == lengths and len(sequences) == plan.sequences
        for places in sequences.values():
            end = 0
            for at, n in sorted(places):
                assert at == end
                end += n
            assert end <= 1024
        assert plan.sequences <= 1.02 * -(-sum(n * c for n, c in lengths.items()) // 1024) + 10


def test_word_arithmetic():
    import pyarrow as pa
    texts = ["", None, "a", "A b", "a b c d", " x\ty\nz ", "é ü é ü é ü", "a b c d"]
    got = dict(words.shingle_sets(pa.array(texts), 3))
    assert [len(got[i]) for i in range(len(texts))] == [len(shingles(t or "", 3)) for t in texts]
    assert (got[4] == got[7]).all() and not (got[2] == got[3]).any()


def test_pipeline(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before, held = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, folder)
        held[name] = after.toPandas()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert after.columns == docs.columns
            before = spark.createDataFrame(held[name], docs.schema)
    good, single, masked, packed = held.values()
    group, _ = similar_groups(good.text.tolist(), 5, 80)
    assert sorted(single.doc_id) == sorted({good.doc_id.iloc[i] for i in group.values()})
    assert sorted(masked.doc_id) == sorted(single.doc_id) and not masked.text.str.contains(r"[\w.]+@mail\d").any()
    assert set(packed.doc_id) == set(masked.doc_id)
    run = corpus_pipeline.run(spark, folder).toPandas()
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert run[key].sort_values(key).values.tolist() == packed[key].sort_values(key).values.tolist()


def test_every_query_is_registered():
    names = set(catalog.QUERIES)
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))


def test_equal_fast_hashes_are_told_apart(vocabulary):
    import pyarrow as pa
    from tokenizers import Tokenizer
    from conftest import SAME_A, SAME_B
    data = np.frombuffer((SAME_A + SAME_B).encode(), np.uint8)
    ends = np.array([2048, 4096])
    assert len(set(words.span_hashes(data, ends - 2048, ends).tolist())) == 1
    assert len(set(words.word_keys(data, ends - 2048, ends).tolist())) == 2
    one, two = (own for _, own in words.shingle_sets(pa.array([SAME_A + " x y z", SAME_B + " x y z"]), 3))
    assert len(np.intersect1d(one, two)) == 1
    plain = Tokenizer.from_file(vocabulary)
    for texts in ([SAME_A, SAME_B], [SAME_A, "a b", SAME_B, SAME_A], [SAME_B]):
        encoder = packing.ChunkTokenizer(vocabulary)
        for part in (texts, texts[::-1]):
            flat = "".join(part).encode()
            offsets = np.concatenate(([0], np.cumsum([len(t) for t in part])))
            ids, bounds = encoder.encode(np.frombuffer(flat, np.uint8), offsets)
            assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == [plain.encode(t, add_special_tokens=False).ids for t in part]
