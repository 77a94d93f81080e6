"""Samples of rows and pairs. A sample draws positions; pairs of a group are never listed.

Sample sizes are the operators' own parameters. Draws follow a seeded md5 order, so they repeat on
every run; they are not the draws of another program's generator.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tabred.operators.ranking import hash_positions, running_totals, sample_order
from tabred.session import checkpointed


def sample_per_group(df: DataFrame, key: str, row: str, k: int | Column, seed: int) -> DataFrame:
    """Up to ``k`` rows of each group, in seeded order: adds ``position``."""
    return hash_positions(df, [key], seed, [row]).where(F.col("position") <= k)


def same_pairs(df: DataFrame, key: str, row: str, n: int, seed: int) -> DataFrame:
    """Disjoint pairs of rows with the same key, spread evenly over the groups: [key, a, b], at most n."""
    groups = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= 2)
    each = groups.agg((F.ceil(F.lit(n) / F.count(F.lit(1))) * 2).cast("long").alias("each")).scalar()
    kept = df.join(groups.select(F.col(key).alias("_g")), F.col(key) == F.col("_g"), "left_semi").select(key, row)
    numbered = hash_positions(kept, [key], seed, [row]).withColumn("_each", each).where(F.col("position") <= F.col("_each"))
    paired = (numbered.groupBy(key, F.ceil(F.col("position") / 2).alias("pair"))
              .agg(F.min_by(row, "position").alias("a"), F.max_by(row, "position").alias("b"), F.count(F.lit(1)).alias("_n"))
              .where(F.col("_n") == 2))
    return paired.orderBy(sample_order(f"{seed}:pair", "a", "b")).limit(n).select(key, "a", "b")


def group_pairs(df: DataFrame, key: str, row: str, n: int, seed: int) -> DataFrame:
    """One pair from each of n sampled groups: [key, a, b]."""
    groups = (df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= 2)
              .orderBy(sample_order(f"{seed}:group", key)).limit(n).select(F.col(key).alias("_g")))
    return same_pairs_of(df.join(groups, F.col(key) == F.col("_g"), "left_semi"), key, row, seed)


def same_pairs_of(df: DataFrame, key: str, row: str, seed: int) -> DataFrame:
    first_two = sample_per_group(df.select(key, row), key, row, 2, seed)
    return first_two.groupBy(key).agg(F.min_by(row, "position").alias("a"), F.max_by(row, "position").alias("b"))


def draws(df: DataFrame, total: Column, n: int, seed: int) -> DataFrame:
    """``n`` different positions in [0, total), one per equal stretch: [draw]. Fails when total < n.

    Stretches are cut in whole numbers, and a draw has 60 bits, so every position can be drawn. ``df`` only lends its
    session.
    """
    numbers = df.sparkSession.range(n).withColumn("total", total)
    whole = lambda part: F.expr(f"({part} * cast(total as decimal(38,0))) div {n}")
    low, high = whole("cast(id as decimal(18,0))"), whole("cast(id + 1 as decimal(18,0))")
    shift = F.conv(F.substring(sample_order(f"{seed}:draw", "id"), 1, 15), 16, 10).cast("long") % (high - low)
    enough = F.when(F.coalesce(F.col("total"), F.lit(0)) < n, F.raise_error(F.lit("not enough pairs to draw from"))).otherwise(low + shift)
    return numbers.select(enough.cast("long").alias("draw"))


def locate(drawn: DataFrame, blocks: DataFrame, total: Column, n: int) -> DataFrame:
    """The block of each draw and the place inside it: blocks [..., start, size] -> [..., draw, offset].

    Positions are cut into n stretches; a block meets only draws of the stretches that it covers, so
    the lookup is an equality join.
    """
    width = f"greatest(cast(_total as bigint) div {n}, 1)"
    spans = (blocks.where(F.col("size") > 0).withColumn("_total", total)
             .withColumn("_s", F.explode(F.sequence(F.expr(f"start div {width}"), F.expr(f"(start + size - 1) div {width}")))))
    at = drawn.withColumn("_total", total).select("draw", F.expr(f"draw div {width}").alias("_d"))
    hit = (F.col("_s") == F.col("_d")) & (F.col("draw") >= F.col("start")) & (F.col("draw") < F.col("start") + F.col("size"))
    return spans.join(at, hit).withColumn("offset", F.col("draw") - F.col("start")).drop("_s", "_d", "_total")


def pair_blocks(df: DataFrame, key: str) -> DataFrame:
    """Unordered pairs per group as a stretch of one numbering: [key, n, size, start]."""
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= 2)
    sizes = sizes.withColumn("size", F.expr("n * (n - 1) div 2"))
    ordered = sizes.withColumn("_o", F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 15), 16, 10).cast("long"))
    return running_totals(ordered, [], "_o", ["size"]).select(key, "n", "size", F.col("size_before").alias("start"))


def child_pairs(df: DataFrame, parent: str, row: str, n: int, seed: int) -> DataFrame:
    """``n`` of all pairs of rows under one parent, every pair equally likely: [parent, a, b].

    A drawn number is turned into (group, i, j) by arithmetic; only the drawn rows are joined.
    """
    blocks = pair_blocks(df, parent)
    total = blocks.agg(F.sum("size").alias("t")).scalar()
    hits = locate(draws(df, total, n, seed), blocks, total, n)
    o = F.col("offset")
    j = F.floor((F.sqrt(8 * o + 1) + 1) / 2).cast("long")
    # The square root may be off by one for huge numbers; step to the exact triangle row.
    hits = hits.withColumn("_j", j)
    j = F.col("_j")
    j = F.when(F.expr("_j * (_j - 1) div 2") > o, j - 1).when(F.expr("(_j + 1) * _j div 2") <= o, j + 1).otherwise(j)
    placed = hits.withColumn("_j", j).withColumn("_i", o - F.expr("_j * (_j - 1) div 2"))
    numbered = hash_positions(df.select(parent, row), [parent], f"{seed}:child", [row])
    at = lambda p, out: numbered.select(F.col(parent).alias(f"_p{p}"), (F.col("position") - 1).alias(f"_n{p}"), F.col(row).alias(out))
    return (placed.join(at("i", "a"), (F.col(parent) == F.col("_pi")) & (F.col("_i") == F.col("_ni")))
            .join(at("j", "b"), (F.col(parent) == F.col("_pj")) & (F.col("_j") == F.col("_nj")))
            .select(parent, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))


def pool(pairs: DataFrame, key: str) -> DataFrame:
    """Distinct rows of the pairs with their group: [id, group]."""
    return (pairs.select(F.col(key).alias("group"), F.explode(F.array("a", "b")).alias("id"))
            .dropDuplicates(["id"]).select("id", "group"))


def different_pairs(pairs: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """``n`` unique pairs of pool members with different keys: [group_a, group_b, a, b].

    Members are numbered group by group. All pairs (member, any member of a later group) form one
    numbering; a draw gives the group of the first member, and the rest follows by division. The pool is
    a sample, so it is written once and read by the following steps.
    """
    members = checkpointed(pool(pairs, key))
    sizes = members.groupBy("group").agg(F.count(F.lit(1)).alias("n"))
    placed = running_totals(sizes, [], "group", ["n"]) if dict(sizes.dtypes)["group"] != "string" else running_totals(
        sizes.withColumn("_o", F.conv(F.substring(F.md5("group"), 1, 15), 16, 10).cast("long")), [], "_o", ["n"]).drop("_o")
    everyone = sizes.agg(F.sum("n").alias("t")).scalar()
    later = placed.withColumn("_all", everyone).withColumn("later", F.col("_all") - F.col("n_before") - F.col("n"))
    # A later group comes after in member numbering, so block starts follow from member counts.
    later = later.withColumn("size", F.col("n") * F.col("later"))
    blocks = running_totals(later.select("group", "n", "n_before", "later", "size"), [], "n_before", ["size"]).withColumnRenamed("size_before", "start")
    total = blocks.agg(F.sum("size").alias("t")).scalar()
    hits = locate(draws(pairs, total, n, seed), blocks, total, n)
    spots = hits.select(F.col("group").alias("group_a"), (F.col("n_before") + F.expr("offset div later")).alias("_first"),
                        (F.col("n_before") + F.col("n") + F.col("offset") % F.col("later")).alias("_second"))
    numbered = (hash_positions(members, ["group"], f"{seed}:member", ["id"])
                .join(placed.select(F.col("group").alias("_g"), "n_before"), F.col("group") == F.col("_g"))
                .select("group", "id", (F.col("position") - 1 + F.col("n_before")).alias("_at")))
    one = numbered.select(F.col("id").alias("a"), F.col("_at").alias("_at_a"))
    two = numbered.select(F.col("group").alias("group_b"), F.col("id").alias("b"), F.col("_at").alias("_at_b"))
    return (spots.join(one, F.col("_first") == F.col("_at_a")).join(two, F.col("_second") == F.col("_at_b"))
            .select("group_a", "group_b", "a", "b"))


def pair_population(df: DataFrame, key: str) -> DataFrame:
    """Number of pairs with equal and with different keys."""
    n = F.col("n").cast("decimal(38,0)")
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(
        (F.sum(n * (n - 1)) / 2).cast("double").alias("same_pairs"), ((F.sum(n) * F.sum(n) - F.sum(n * n)) / 2).cast("double").alias("different_pairs"))


# Primes for the steps of keyed permutations.
STEPS = (1000000007, 1000000009, 1000000021, 1000000033, 1000000087, 1000000093, 1000000097, 1000000103)


def _permuted(seed: str, anchor: str, t: Column, n: Column) -> Column:
    """Position t (from 0) of a keyed permutation of 1..n: a start and a step that shares no factor with n."""
    drawn = lambda part: F.conv(F.substring(sample_order(f"{seed}:{part}", anchor), 1, 15), 16, 10).cast("long")
    steps = F.filter(F.array(*[F.lit(p).cast("long") for p in STEPS]), lambda p: n % p != 0)
    step = F.element_at(steps, (drawn("step") % F.size(steps) + 1).cast("int")) % n
    return (drawn("start") % n + (t * F.greatest(step, F.lit(1))) % n) % n + 1


def er_samples(entities: DataFrame, duplicates: DataFrame, n: int, hard: int, rand: int, seed: int) -> DataFrame:
    """Positive pairs and negatives per anchor: [kind, a, b].

    ``entities``: [id, group], each id once; ``duplicates``: [a, b] with a < b. Hard negatives share the anchor's group,
    random ones come from all entities. Each anchor goes through a permutation of its pool, so nothing is drawn twice,
    and passes itself and known duplicates by. Anchors that are not complete go on, in rounds of growing length, until
    they are or their pool is used up.
    """
    known = entities.select(F.col("id").alias("_e"))
    positives = (duplicates.join(known, F.col("a") == F.col("_e"), "left_semi").join(known, F.col("b") == F.col("_e"), "left_semi")
                 .orderBy(sample_order(f"{seed}:positive", "a", "b")).limit(n))
    odd = F.substring(sample_order(f"{seed}:side", "a", "b"), 1, 1) < "8"
    anchors = positives.select(F.when(odd, F.col("a")).otherwise(F.col("b")).alias("anchor")).distinct()
    anchors = anchors.join(entities, F.col("anchor") == F.col("id")).select("anchor", "group")
    every = entities.withColumn("everyone", F.lit(0))
    known_pairs = duplicates.select(F.col("a").alias("_da"), F.col("b").alias("_db"))
    is_known = (F.least("anchor", "id") == F.col("_da")) & (F.greatest("anchor", "id") == F.col("_db"))

    def negatives(kind: str, group: str, count: int) -> DataFrame:
        numbered = checkpointed(hash_positions(every.select("id", group), [group], f"{seed}:{kind}", ["id"]).select("id", F.col(group).alias("_g"), "position"))
        sizes = every.groupBy(F.col(group).alias("_g")).agg(F.count(F.lit(1)).alias("_n"))
        waiting = checkpointed(anchors.withColumn("everyone", F.lit(0)).join(sizes, F.col(group) == F.col("_g")).select("anchor", F.col("_g").alias("_wg"), "_n"))
        found, first, width = None, 0, 2 * count + 4
        while True:
            last = F.least(F.lit(first + width), F.col("_n")) - 1
            tried = waiting.where(F.col("_n") > first).withColumn("_t", F.explode(F.sequence(F.lit(first).cast("long"), last)))
            spots = tried.select("anchor", "_t", "_wg", _permuted(f"{seed}:{kind}", "anchor", F.col("_t"), F.col("_n")).alias("_spot"))
            new = (spots.join(numbered, (F.col("_wg") == F.col("_g")) & (F.col("_spot") == F.col("position"))).where(F.col("id") != F.col("anchor"))
                   .join(known_pairs, is_known, "left_anti").select("anchor", "id", "_t"))
            found = checkpointed(new if found is None else found.unionByName(new))
            done = found.groupBy("anchor").agg(F.count(F.lit(1)).alias("_have")).where(F.col("_have") >= count)
            first, width = first + width, 4 * width
            waiting = checkpointed(waiting.where(F.col("_n") > first).join(done, "anchor", "left_anti"))
            if waiting.isEmpty():
                break
        order = F.row_number().over(W.partitionBy("anchor").orderBy("_t"))
        return (found.withColumn("_r", order).where(F.col("_r") <= count)
                .select(F.lit(kind).alias("kind"), F.col("anchor").alias("a"), F.col("id").alias("b")))

    return (positives.select(F.lit("positive").alias("kind"), "a", "b")
            .unionByName(negatives("hard", "group", hard)).unionByName(negatives("random", "everyone", rand)))
