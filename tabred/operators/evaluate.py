"""Similarity scores, classification and retrieval metrics, drift, and paired tests."""
from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tabred.functions.vectors import as_double, cosine, dot, unit
from tabred.operators.ranking import running_totals, with_quantiles
from tabred.session import checkpointed

# Rows of a block of queries or pool rows in retrieval, about.
RETRIEVAL_BLOCK = 512


def score_pairs(pairs: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Cosine of each pair in two representations and the difference: pairs + [score_d, score_n, delta]."""
    def joined(frame: DataFrame, vectors: DataFrame, name: str) -> DataFrame:
        left = vectors.select(F.col("id").alias("_ia"), F.col("vec").alias("_va"))
        right = vectors.select(F.col("id").alias("_ib"), F.col("vec").alias("_vb"))
        return (frame.join(left, F.col("a") == F.col("_ia")).join(right, F.col("b") == F.col("_ib"))
                .withColumn(name, cosine("_va", "_vb")).drop("_ia", "_ib", "_va", "_vb"))
    return joined(joined(pairs, before, "score_d"), after, "score_n").withColumn("delta", F.col("score_n") - F.col("score_d"))


def summarise(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Median, mean, sample deviation, inclusive quartiles and range per group."""
    rest = df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.min(value).alias("low"), F.max(value).alias("high"))
    cuts = {"median": (value, 0.5), "q1": (value, 0.25), "q3": (value, 0.75)}
    return with_quantiles(rest, df, keys, cuts).select(*keys, "median", "mean", "sd", "q1", "q3", "low", "high")


def auc(df: DataFrame, by: list[str], score: str, positive: Column) -> DataFrame:
    """U / (positives x negatives) per group, ties half: [by..., auc].

    Rows are first counted per score. The number of negatives below a score is a running total over
    distinct scores, split into value bins.
    """
    counts = df.groupBy(*by, score).agg(F.count(F.when(positive, 1)).alias("pos"), F.count(F.when(~positive, 1)).alias("neg"))
    ranked = running_totals(counts, by, score, ["neg"])
    wins = F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2.0))
    return (ranked.groupBy(*by).agg(wins.alias("u"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
            .select(*by, F.try_divide("u", F.col("p") * F.col("n")).alias("auc")))


def ecdf(df: DataFrame, keys: list[str], value: str, grid: list[float], repeat: str | None = None) -> DataFrame:
    """Share of values at or below each grid point, averaged over repeats: [keys..., point, share]."""
    groups = keys + ([repeat] if repeat else [])
    shares = df.groupBy(*groups).agg(*[(F.count(F.when(F.col(value) <= g, 1)) / F.count(F.lit(1))).alias(f"_{i}") for i, g in enumerate(grid)])
    long = shares.select(*groups, F.inline(F.array(*[F.struct(F.lit(float(g)).alias("point"), F.col(f"_{i}").alias("share")) for i, g in enumerate(grid)])))
    return long.groupBy(*keys, "point").agg(F.avg("share").alias("share"))


def retrieval_metrics(vectors: DataFrame, seed: int = 0, block: int = RETRIEVAL_BLOCK) -> DataFrame:
    """Nearest-neighbour retrieval inside a pool: R-precision, MAP, MRR, precision at 5 and lift over chance.

    ``vectors``: [id, group, vec], each id once; queries without another row of their group don't count. Rows are dealt
    into blocks. For one block of queries the blocks of the pool pass by twice: first the scores of relevant rows are
    noted, then the rows placed before each of them are counted. A task holds one block and the relevant scores of its
    queries, never the pool. Ties are in the order of a seeded hash of the id.
    """
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.col("id").cast("string"))), 1, 13), 16, 10).cast("double")
    rows = vectors.select(F.col("id").cast("string").alias("id"), F.col("group").cast("string").alias("group"), unit(as_double("vec")).alias("vec"), draw.alias("draw"))
    total = vectors.count()
    blocks = max(1, -(-total // block))
    packed = checkpointed(rows.groupBy(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("part")).agg(
        F.collect_list("id").alias("id"), F.collect_list("group").alias("group"), F.collect_list("vec").alias("vec"), F.collect_list("draw").alias("draw")))
    items = ("id", "group", "vec", "draw")
    passing = (packed.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("step", F.explode(F.array(F.lit(0), F.lit(1))))
               .select("q", "step", *items))
    streams = packed.select(F.col("part").alias("q"), F.lit(-1).alias("step"), *items).unionByName(passing)
    streams = streams.repartition(blocks, "q").sortWithinPartitions("q", "step")

    def score(batches):
        asked, relevant, before = None, [], []

        def told():
            made = []
            for keys, count in zip(relevant, before):
                if len(keys):
                    places = np.sort(count) + 1
                    precision = float((places <= len(keys)).mean())
                    made.append((precision, float((np.arange(1, len(keys) + 1) / places).mean()), 1.0 / places[0],
                                 float((places <= 5).sum() / min(5, total - 1)), precision * (total - 1) / len(keys)))
            return pd.DataFrame(made, columns=["r_precision", "map", "mrr", "p_at_5", "lift"], dtype=float)
        for batch in batches:
            for row in batch.itertuples(index=False):
                ids, groups, matrix, draws = np.array(row.id), np.array(row.group), np.stack(row.vec), np.array(row.draw)
                if row.step < 0:
                    if asked is not None:
                        yield told()
                    asked, relevant, before = (ids, groups, matrix), [np.zeros(0, complex)] * len(ids), [np.zeros(0, np.int64)] * len(ids)
                    continue
                if asked is None:
                    continue
                # A place is before another if its key is smaller: first by score, then by draw.
                keys = -np.round(asked[2] @ matrix.T, 12) + 1j * draws[None]
                other = asked[0][:, None] != ids[None]
                for i in range(len(asked[0])):
                    if row.step == 0:
                        relevant[i] = np.concatenate([relevant[i], keys[i][other[i] & (groups == asked[1][i])]])
                    elif len(relevant[i]):
                        count = np.searchsorted(np.sort(keys[i][other[i]]), relevant[i], "left")
                        before[i] = count + before[i] if len(before[i]) else count
        if asked is not None:
            yield told()
    per_query = streams.mapInPandas(score, "r_precision double, map double, mrr double, p_at_5 double, lift double")
    return per_query.agg(*[F.avg(m).alias(m) for m in ("r_precision", "map", "mrr", "p_at_5", "lift")],
                         F.count(F.lit(1)).alias("queries")).withColumn("pool", F.lit(total).cast("long"))


def drift(before: DataFrame, after: DataFrame, inside: DataFrame) -> DataFrame:
    """Mean of 1 - cosine before/after, inside and outside the updated set; 0 for an empty side."""
    moved = (before.select("id", F.col("vec").alias("_b")).join(after.select("id", F.col("vec").alias("_a")), "id")
             .join(inside.select("id", F.lit(True).alias("_in")), "id", "left").withColumn("drift", 1.0 - cosine("_b", "_a")))
    return moved.agg(F.coalesce(F.avg(F.when(F.col("_in"), F.col("drift"))), F.lit(0.0)).alias("inside"),
                     F.coalesce(F.avg(F.when(F.col("_in").isNull(), F.col("drift"))), F.lit(0.0)).alias("outside"))


def within_group_similarity(vectors: DataFrame, dimension: int) -> DataFrame:
    """Mean over groups of the mean pair cosine: one row ``similarity``.

    With unit vectors u the sum of all pair cosines of a group is (|sum u|^2 - sum |u|^2) / 2, so each
    group needs only a vector sum, which combines before the shuffle; no pair is formed.
    """
    u = vectors.select("group", unit(as_double("vec")).alias("u"))
    sums = u.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.sum(dot(F.col("u"), F.col("u"))).alias("own"),
                                  *[F.sum(F.get("u", F.lit(i))).alias(f"_{i}") for i in range(dimension)])
    whole = F.array(*[f"_{i}" for i in range(dimension)])
    n = F.col("n").cast("double")
    return (sums.where(F.col("n") > 1).select(((dot(whole, whole) - F.col("own")) / (n * (n - 1))).alias("mean"))
            .agg(F.avg("mean").alias("similarity")))


def group_cosines(members: DataFrame, vectors: DataFrame, dimension: int) -> DataFrame:
    """Mean cosine of members with the vector of their own group, and with those of the other groups: one row [own, other].

    ``members``: [id, group], where a group is the id of a vector, too. A cosine is a product of unit vectors, so a group
    needs only the sum of its members' unit vectors, which combines before the shuffle; no member meets another group.
    """
    u = vectors.select("id", unit(as_double("vec")).alias("u"))
    sums = members.join(u, "id").groupBy("group").agg(F.count(F.lit(1)).cast("double").alias("n"), *[F.sum(F.get("u", F.lit(i))).alias(f"_{i}") for i in range(dimension)])
    sums = sums.select("group", "n", F.array(*[f"_{i}" for i in range(dimension)]).alias("sum"))
    groups = members.select(F.col("group").alias("other")).distinct().join(u.withColumnRenamed("id", "other"), "other")
    same = F.col("group") == F.col("other")
    met = sums.where(F.col("group").isNotNull()).join(groups)
    mean = lambda of: F.sum(F.when(of, dot(F.col("sum"), F.col("u")))) / F.sum(F.when(of, F.col("n")))
    return met.agg(mean(same).alias("own"), mean(~same).alias("other"))


def er_metrics(scores: DataFrame) -> DataFrame:
    """Duplicate detection: AUC against random and hard negatives, by same or different key, and MRR.

    ``scores``: [kind, a, b, score, same_group]; kinds positive, hard, random. The partner of a positive
    pair is ranked among the negatives of both its ends.
    """
    positive = F.col("kind") == "positive"
    slices = {"auc_random": F.col("kind").isin("positive", "random"), "auc_hard": F.col("kind").isin("positive", "hard"),
              "auc_hard_same_det": (positive & F.col("same_group")) | (F.col("kind") == "hard"),
              "auc_hard_diff_det": (positive & ~F.col("same_group")) | (F.col("kind") == "hard")}
    tagged = reduce(DataFrame.unionAll, [scores.where(c).select(F.lit(n).alias("metric"), "score", positive.alias("is_positive")) for n, c in slices.items()])
    areas = auc(tagged, ["metric"], "score", F.col("is_positive")).withColumnRenamed("auc", "value")
    found = scores.where(positive).select("a", "b", F.col("score").alias("s"))
    ends = found.select("a", "b", "s", F.explode(F.array("a", "b")).alias("end"))
    beaten = (scores.where(~positive).select(F.col("a").alias("anchor"), F.col("score").alias("x"))
              .join(ends, F.col("anchor") == F.col("end")).groupBy("a", "b").agg(F.count(F.when(F.col("x") > F.col("s"), 1)).alias("above")))
    mrr = (found.join(beaten, ["a", "b"], "left").agg(F.avg(1.0 / (1 + F.coalesce("above", F.lit(0)))).alias("value"))
           .select(F.lit("mrr").alias("metric"), "value"))
    return areas.select("metric", "value").unionByName(mrr)


def signed_rank(df: DataFrame, case: list[str], a: str, b: str, form: str = "exact") -> DataFrame:
    """Paired signed-rank test per case: [case..., n, w_plus, w_minus, p].

    ``form`` names the distribution, whatever the number of pairs: "exact" counts the sign patterns of every rank sum
    by adding one pair after the other, for cases of few pairs such as one per seed; "normal" is the normal form with
    tie correction, from sums alone.
    """
    if form not in ("exact", "normal"):
        raise ValueError(f"form {form}")
    diffs = df.select(*case, (F.col(a) - F.col(b)).alias("d")).where(F.col("d") != 0).withColumn("m", F.abs("d"))
    over = W.partitionBy(*case)
    ranked = (diffs.withColumn("low", F.rank().over(over.orderBy("m"))).withColumn("ties", F.count(F.lit(1)).over(W.partitionBy(*case, "m")))
              .withColumn("r", F.col("low") + (F.col("ties") - 1) / 2.0))
    sums = [F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.when(F.col("d") > 0, F.col("r"))), F.lit(0.0)).alias("w_plus"),
            F.coalesce(F.sum(F.when(F.col("d") < 0, F.col("r"))), F.lit(0.0)).alias("w_minus")]
    least = F.least("w_plus", "w_minus")
    if form == "exact":
        stats = ranked.groupBy(*case).agg(*sums, F.collect_list((F.col("r") * 2).cast("int")).alias("ranks"))
        gap = lambda r: F.transform(F.sequence(F.lit(1), r), lambda _: F.lit(0.0))
        ways = F.aggregate("ranks", F.array(F.lit(1.0)), lambda w, r: F.zip_with(F.concat(w, gap(r)), F.concat(gap(r), w), lambda x, y: (x + y) / 2))
        chance = F.aggregate(F.slice(ways, F.lit(1), F.floor(least * 2 + 1e-9).cast("int") + 1), F.lit(0.0), lambda s, x: s + x)
        return stats.select(*case, "n", "w_plus", "w_minus", F.least(F.lit(1.0), 2.0 * chance).alias("p"))
    stats = ranked.groupBy(*case).agg(*sums, F.sum((F.col("ties") * F.col("ties") - 1) / 48.0).alias("tie_term"))
    n = F.col("n").cast("double")
    z = (least - n * (n + 1) / 4) / F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("tie_term"))
    # Two-sided tail of the normal distribution by a rational approximation (error below 1.5e-7).
    t = 1 / (1 + 0.3275911 * F.abs(z) / F.sqrt(F.lit(2.0)))
    poly = ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t
    return stats.select(*case, "n", "w_plus", "w_minus", F.least(F.lit(1.0), poly * F.exp(-z * z / 2)).alias("p"))


def holm(df: DataFrame, family: list[str], p: str = "p") -> DataFrame:
    """Holm adjustment over the cases of a family: adds ``p_holm``. Cases are few."""
    over = W.partitionBy(*(family or [F.lit(1)]))
    ranked = df.withColumn("_r", F.row_number().over(over.orderBy(p))).withColumn("_m", F.count(F.lit(1)).over(over))
    raised = F.least(F.lit(1.0), (F.col("_m") - F.col("_r") + 1) * F.col(p))
    return ranked.withColumn("p_holm", F.max(raised).over(over.orderBy("_r").rowsBetween(W.unboundedPreceding, 0))).drop("_r", "_m")


def paired_test(df: DataFrame, case: list[str], a: str, b: str, form: str = "exact") -> DataFrame:
    return holm(signed_rank(df, case, a, b, form), [])


def noise_filter(df: DataFrame, limit: float = 0.01) -> DataFrame:
    """Cases whose repeat without any change drifts no more than ``limit``, and each curve relative to the full update."""
    return df.where(F.col("null_drift") <= limit).withColumn("ratio", F.try_divide("partial", "full"))
