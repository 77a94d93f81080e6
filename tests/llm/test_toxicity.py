"""The field against all label sequences, and scores against held-out labels."""
import itertools

import numpy as np
from pyspark.sql import functions as F

from tabred.llm import toxicity


def test_marginals_match_all_sequences():
    rng = np.random.default_rng(4)
    bounds = np.array([0, 5, 5, 6, 10])
    scores, steps = rng.normal(size=10), rng.normal(size=(2, 2))
    chance, pairs = toxicity.marginals(scores, steps, bounds)
    for a, b in zip(bounds[:-1], bounds[1:]):
        total, one, two = 0.0, np.zeros(b - a), np.zeros((b - a, 2, 2))
        for states in itertools.product((0, 1), repeat=b - a):
            w = np.exp(sum(scores[a + i] * s for i, s in enumerate(states)) + sum(steps[s, t] for s, t in zip(states, states[1:])))
            total += w
            for i, s in enumerate(states):
                one[i] += w * s
                if i:
                    two[i, states[i - 1], s] += w
        if b > a:
            assert np.allclose(chance[a:b], one / total) and np.allclose(pairs[a:b], two / total)


def test_blocks_do_not_show():
    rng = np.random.default_rng(6)
    bounds = np.array([0, 700, 701, 5000])
    scores, steps = rng.normal(size=5000) * 3, rng.normal(size=(2, 2))
    chance, pairs = toxicity.marginals(scores, steps, bounds)
    for a, b in zip(bounds[:-1], bounds[1:]):
        alone, two = toxicity.marginals(scores[a:b], steps, np.array([0, b - a]))
        assert np.allclose(alone, chance[a:b]) and np.allclose(two, pairs[a:b])


def test_gradient_leads_to_the_labels():
    """A field that made the labels is found again: the fit's expected counts equal those of the labels, less the hold."""
    rng = np.random.default_rng(7)
    bounds = np.arange(0, 4001, 20)
    rows = np.concatenate([np.ones((4000, 1)), rng.normal(size=(4000, len(toxicity.FEATURES) - 1))], axis=1)
    toxic = rows @ rng.normal(size=rows.shape[1]) > 0.5
    weights, steps = toxicity.fit_field(rows, bounds, toxic, rounds=1500, hold=5.0)
    chance, _ = toxicity.marginals(rows @ weights, steps, bounds)
    assert np.abs(rows.T @ (toxic - chance) - 5.0 * (weights - toxicity.PRIOR)).max() < 2.0
    assert ((chance >= 0.5) == toxic).mean() > 0.97


def auc(score, label):
    order = np.argsort(np.argsort(score, kind="stable"), kind="stable")
    ones = label == 1
    return (order[ones].mean() - (ones.sum() - 1) / 2) / (~ones).sum()


def test_held_out_labels(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    got = toxicity.score_documents(docs, labels)
    assert got.count() == docs.count() and got.where("score < 0 or score > 1 or (score >= 0.5) <> (predicted = 1)").count() == 0
    import zlib
    rows = got.join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out]
    assert auc(np.array([r.score for r in held]), np.array([r.toxic for r in held])) > 0.93
    assert np.mean([r.predicted == r.toxic for r in held]) > 0.97
    found = docs.join(got.where("spans <> ''"), "doc_id").select("text", "spans").collect()
    words = {r.text[int(a):int(b)].lower() for r in found for a, b in (s.split(":") for s in r.spans.split(","))}
    assert found and {"idiot", "stupid"} <= {w for x in words for w in x.split()}


def test_held_out_labels_do_not_matter(spark):
    folder = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    turned = labels.withColumn("toxic", F.when(out, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    shuffled = docs.select("doc_id", "text", F.lit("x").alias("source"), F.lit("y").alias("lang"))
    one, two = ({r.doc_id: r.score for r in toxicity.score_documents(*x).collect()} for x in ((docs, labels), (shuffled, turned)))
    assert one == two


def test_odd_texts(spark, odd, folder):
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = toxicity.score_documents(odd, labels).collect()
    assert len(rows) == odd.count()
    empty = {r.score for r in rows if r.doc_id in (3, 4, 7)}
    assert len(empty) == 1 and all(0 <= r.score <= 1 for r in rows)
    assert not any(r.held_out for r in rows if r.doc_id is None)
    assert toxicity.score_documents(odd.limit(0), labels).count() == 0
    assert len({r.score for r in toxicity.score_documents(odd, labels.limit(0)).collect()}) == 1
    ties = labels.withColumn("toxic", F.lit(None).cast("int")).unionByName(labels.limit(5)).unionByName(labels.limit(5))
    assert toxicity.score_documents(odd, ties).count() == odd.count()


def test_offsets_count_code_points(spark):
    rows = [(i, f"çé😀 all is well here number {i}") for i in range(60)] + [(100 + i, f"çé😀 ÜBLERKERL you are number {i}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i >= 100)) for i, _ in rows], "doc_id long, toxic int")
    for r in toxicity.score_documents(docs, labels).collect():
        text = dict(rows)[r.doc_id]
        assert r.predicted == (r.doc_id >= 100)
        if r.predicted:
            a, b = map(int, r.spans.split(",")[0].split(":"))
            assert text[a:b].startswith("ÜBLERKERL")
