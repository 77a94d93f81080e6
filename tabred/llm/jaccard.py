"""Jaccard self-join of shingle sets with adaptive multi-match prefixes, down to components.

All texts order their shingles alike, rare ones first. Two sets that are alike enough share at least l shingles among the
first ones of each, where every further shared shingle asked for lengthens the prefix by one. A text that common
shingles threaten with many candidates takes a longer prefix and asks for more shared shingles (l up to ``MATCHES``).

1. One pass counts the shingles that occur often; the commonest decide the order.
2. A second pass gives each text its set's digest, size, prefix and a parity sketch. Equal sets become one class.
3. Stars: on every prefix shingle, each class is compared with the class most exposed to candidates.
4. On shingles where several components still meet, classes are compared in blocks by size and a small sketch, and those
   left by the whole sketch, which puts them into families. A family's classes are compared by whole sets, in blocks, if
   they share as many prefix shingles as they ask for. Each of these passes returns classes or links, at most one per
   class and group, never pairs: a block unites what it has found. Links of both steps give the components.
Verification compares whole sets, which a further pass makes for the classes in question only.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tabred.llm.components import components, forest
from tabred.llm.tables import drop, giving_back, saved, small_batches, tidy
from tabred.llm.words import shingle_sets

#: Shared prefix shingles asked for at most.
MATCHES = 4
#: Common shingles whose counts order the others; what is told to every task has this many entries at most.
COMMON = 50_000
#: Shingles that are counted together, and texts among them that one must occur in to count.
COUNTED, OFTEN = 1_000_000, 4
#: Classes of one block, about, and bits of the smallest sketch; a larger set has one bit or more for each shingle.
BLOCK, SKETCH = 1024, 512
#: Bytes of sets or sketches of one block, about.
BLOCK_BYTES = 32_000_000
#: Bits of the filter for classes in question: at least, and at most (4 MB).
FILTER_BITS = (1 << 16, 1 << 25)
_S = "struct<rid:long,component:long,n:int,matches:int,level:int,sketch:binary>"
_T = "struct<rid:long,component:long,n:int,matches:int,prefix:array<long>,own:binary>"


def common_shingles(docs: DataFrame, k: int, limit: int = COMMON) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, counts) of the commonest shingles of all texts; only shingles that are common in a batch count."""
    def run(batches):
        for batch in batches:
            own, size = [], 0
            for i, hashes in shingle_sets(batch.column(0), k):
                own.append(hashes)
                size += len(hashes)
                if size > COUNTED or i + 1 == batch.num_rows:
                    every, times = np.unique(np.concatenate(own), return_counts=True)
                    often = times >= OFTEN
                    yield pa.RecordBatch.from_arrays([pa.array(every[often].view(np.int64)), pa.array(times[often].astype(np.int64))], names=["token", "n"])
                    own, size = [], 0
    counted = docs.select("text").mapInArrow(giving_back(run), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    rows = counted.orderBy(F.desc("n"), "token").limit(limit).collect()
    tokens = np.array([r[0] for r in rows], np.int64).view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], np.array([r[1] for r in rows], np.int64)[order]


def least_overlap(n: int, percent: int) -> int:
    return -(-percent * n // 100)


def prefix_of(own: np.ndarray, common: tuple[np.ndarray, np.ndarray], percent: int) -> tuple[np.ndarray, int, int]:
    """(prefix, matches asked for, exposure) of a set.

    Candidates are estimated by the counts of the prefix shingles over the matches asked for; an entry costs one.
    """
    tokens, counts = common
    if len(tokens):
        at = np.minimum(np.searchsorted(tokens, own), len(tokens) - 1)
        often = np.where(tokens[at] == own, counts[at], 0)
    else:
        often = np.zeros(len(own), np.int64)
    order = np.lexsort((own, often))
    first = len(own) - least_overlap(len(own), percent) + 1
    best, asked = None, 1
    for l in range(1, min(MATCHES, least_overlap(len(own), percent)) + 1):
        cost = often[order[:first + l - 1]].sum() / l + first + l - 1
        if best is None or cost < best:
            best, asked = cost, l
    chosen = order[:first + asked - 1]
    return own[chosen], asked, int(often[chosen].sum())


def sketch_of(own: np.ndarray) -> bytes:
    """Parity of the shingles in each of as many cells as bits; sets differ in as many shingles as bits at least."""
    bits = max(SKETCH, 1 << (len(own) - 1).bit_length())
    return np.packbits(np.bincount((own & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).tobytes()


def folded(sketch: bytes, size: int) -> np.ndarray:
    """A sketch brought down to ``size`` bytes: cells that fall together add up."""
    return np.bitwise_xor.reduce(np.frombuffer(sketch, np.uint64).reshape(-1, size // 8), axis=0)


def apart(x: bytes, y: bytes) -> int:
    """Shingles in which two sets differ at least."""
    size = min(len(x), len(y))
    return int(np.bitwise_count(folded(x, size) ^ folded(y, size)).sum())


def profiles(docs: DataFrame, k: int, percent: int, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """One row per document: doc_id, text hash, digest and size of its set, and once per task and digest the rest."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        told: set[bytes] = set()
        for batch in batches:
            out = []
            for _, own in shingle_sets(batch.column(2), k):
                if not len(own):
                    out.append((None, 0, None, None, None, None, None))
                    continue
                digest = hashlib.blake2b(own.tobytes(), digest_size=16).digest()
                if digest in told:
                    out.append((digest, len(own), None, None, None, None, None))
                    continue
                if len(told) < 1_000_000:
                    told.add(digest)
                prefix, asked, exposure = prefix_of(own, common, percent)
                sketch = sketch_of(own)
                out.append((digest, len(own), prefix.view(np.int64), asked, exposure, sketch, folded(sketch, SKETCH // 8).tobytes()))
            c = list(zip(*out)) or [[]] * 7
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(c[0], pa.binary()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.list_(pa.int64())),
                 pa.array(c[3], pa.int32()), pa.array(c[4], pa.int64()), pa.array(c[5], pa.binary()), pa.array(c[6], pa.binary())],
                names=["doc_id", "tid", "digest", "n", "prefix", "matches", "exposure", "sketch", "small"])
    return docs.select("doc_id", text_hash(), "text").mapInArrow(
        giving_back(run), f"doc_id {kind}, tid long, digest binary, n long, prefix array<long>, matches int, exposure long, sketch binary, small binary")


def text_hash():
    return F.xxhash64(F.coalesce("text", F.lit(""))).alias("tid")


def _alike(n: np.ndarray, m: np.ndarray, apart: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of these sizes, that differ in at least ``apart`` shingles, can be alike enough."""
    return (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & (apart * (100 + percent) <= (n + m) * (100 - percent))


def _plausible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that sizes and sketches allow."""
    side = lambda x: classes.select(F.col("rid").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    near = pairs.join(side("a").drop("sa"), "a").join(side("b").drop("sb"), "b").where(
        F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent).select("a", "b")
    told = near.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "sa", "sb")

    def run(batches):
        for batch in batches:
            a, b, n, m = (batch.column(i).to_numpy() for i in range(4))
            differ = np.array([apart(x.as_py(), y.as_py()) for x, y in zip(batch.column(4), batch.column(5))], np.int64)
            good = _alike(n, m, differ, percent)
            yield pa.RecordBatch.from_arrays([pa.array(a[good]), pa.array(b[good])], names=["a", "b"])
    return told.mapInArrow(giving_back(run), "a long, b long")


def _near(left: list[dict], right: list[dict] | None, percent: int, whole: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, columns, matches asked for) of items of different components that may be alike, where this shingle counts for both.

    A pair asks for the fewer matches of its two; shingles beyond the prefix that goes with these don't count. Sketches
    are compared at the smallest size first, and at their own size where ``whole``.
    """
    other = left if right is None else right
    n, m = (np.array([r["n"] for r in side], np.int64) for side in (left, other))
    x, y = (np.stack([folded(r["sketch"], SKETCH // 8) for r in side]) for side in (left, other))
    c, d = (np.array([r["component"] for r in side]) for side in (left, other))
    p, q = (np.array([r["matches"] for r in side]) for side in (left, other))
    u, v = (np.array([r["level"] for r in side]) for side in (left, other))
    for i in range(len(left)):
        asked = np.minimum(p[i], q)
        good = (c[i] != d) & (np.maximum(u[i], v) <= asked) & (100 * np.minimum(n[i], m) >= percent * np.maximum(n[i], m))
        if right is None:
            good[:i + 1] = False
        at = np.flatnonzero(good)
        if len(at):
            at = at[_alike(n[i], m[at], np.bitwise_count(x[i] ^ y[at]).sum(axis=1, dtype=np.int64), percent)]
        if whole and len(at):
            differ = np.array([apart(left[i]["sketch"], other[j]["sketch"]) for j in at.tolist()], np.int64)
            at = at[_alike(n[i], m[at], differ, percent)]
        if len(at):
            yield i, at, asked[at]


def _each_block(entries: DataFrame, item: str, run, kind: str, then=lambda df: df) -> DataFrame:
    """What ``run`` and ``then`` make, written as a table, of (left, right) from entries (token, n_blocks, item): each block with itself (right null) and with the later ones of its shingle."""
    entries = entries.withColumn("block", F.pmod(F.xxhash64("item.rid"), F.col("n_blocks")).cast("int"))
    packed = saved(entries.groupBy("token", "n_blocks", "block").agg(F.collect_list("item").alias("items")))
    alone = packed.select("token", F.col("items").alias("left"), F.lit(None).cast(f"array<{item}>").alias("right"))
    many = packed.where("n_blocks > 1")
    two = many.select("token", "block", F.col("items").alias("left")).join(
        many.select(F.col("token").alias("t"), F.col("block").alias("b"), F.col("items").alias("right")), (F.col("token") == F.col("t")) & (F.col("block") < F.col("b")))
    out = saved(then(alone.unionByName(two.select("token", "left", "right")).mapInArrow(giving_back(run), kind)))
    drop(packed)
    tidy(entries.sparkSession)
    return out


def _in_question(entries: DataFrame, percent: int) -> DataFrame:
    """The (token, rid) among the entries that have a partner which may be alike by its small sketch: never more rows than entries."""
    def run(batches):
        for batch in batches:
            tokens, rids = [], []
            for token, left, right in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                left, right = left.as_py(), right.as_py()
                found: set[int] = set()
                for i, at, _ in _near(left, right, percent, False):
                    found.add(left[i]["rid"])
                    found.update((left if right is None else right)[j]["rid"] for j in at.tolist())
                tokens += [token] * len(found)
                rids += found
            yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.int64()), pa.array(rids, pa.int64())], names=["token", "rid"])
    return _each_block(entries, _S, run, "token long, rid long", DataFrame.distinct)


def _families(entries: DataFrame, percent: int) -> DataFrame:
    """(rid, family): classes that may be alike by their whole sketches hang together; never more links than entries."""
    def run(batches):
        for batch in batches:
            links: list[tuple[int, int]] = []
            for left, right in zip(batch.column(1), batch.column(2)):
                left, right = left.as_py(), right.as_py()
                other, met = left if right is None else right, ([], [])
                for i, at, _ in _near(left, right, percent, True):
                    met[0].extend([left[i]["rid"]] * len(at))
                    met[1].extend(other[j]["rid"] for j in at.tolist())
                links += [p for p in forest(*met) if p[0] != p[1]]
            c = list(zip(*links)) or [[], []]
            yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64())], names=["a", "b"])
    return saved(components(_each_block(entries, _S, run, "a long, b long")).toDF("rid", "family"))


def alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets have ``percent`` hundredths of Jaccard similarity."""
    at = np.minimum(np.searchsorted(y, x), len(y) - 1) if len(y) else np.zeros(0, int)
    both = int((y[at] == x).sum()) if len(y) else 0
    return both > 0 and 100 * both >= percent * (len(x) + len(y) - both)


def _links_in_blocks(entries: DataFrame, percent: int) -> DataFrame:
    """Links that join what the components leave apart, verified on whole sets in the task: at most one per entry and block.

    A pair is verified once it shares as many prefix shingles as it asks for.
    """
    def run(batches):
        for batch in batches:
            links: list[tuple[int, int]] = []
            for left, right in zip(batch.column(1), batch.column(2)):
                left, right = left.as_py(), right.as_py()
                for side in (left, right or []):
                    for r in side:
                        r["own"] = np.frombuffer(r["own"], np.uint64)
                        r["sketch"], r["level"] = sketch_of(r["own"]), 1
                root: dict[int, int] = {}

                def find(x: int) -> int:
                    while root.get(x, x) != x:
                        root[x] = root.get(root[x], root[x])
                        x = root[x]
                    return x
                other = left if right is None else right
                for i, at, asked in _near(left, right, percent, True):
                    one = left[i]
                    for j, l in zip(at.tolist(), asked.tolist()):
                        two = other[j]
                        a, b = find(one["component"]), find(two["component"])
                        if a == b:
                            continue
                        shared = set(one["prefix"][:len(one["prefix"]) - one["matches"] + l]).intersection(two["prefix"][:len(two["prefix"]) - two["matches"] + l])
                        if len(shared) >= l and alike(one["own"], two["own"], percent):
                            root[max(a, b)] = min(a, b)
                            links.append((one["rid"], two["rid"]))
            c = list(zip(*links)) or [[], []]
            yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64())], names=["a", "b"])
    return _each_block(entries, _T, run, "a long, b long")


def _blocked(entries: DataFrame, size: str) -> DataFrame:
    """Add ``n_blocks`` to entries (token, item): blocks of about BLOCK classes and BLOCK_BYTES bytes."""
    of = entries.groupBy("token").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum(F.expr(size)) / BLOCK_BYTES)).cast("int").alias("n_blocks"))
    return entries.join(of, "token")


def _sets(docs: DataFrame, classes: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """(rid, own) with the whole set of every class in ``nodes`` (rid), made again from the texts of these classes only."""
    asked = saved(classes.select("rid", "tid").join(nodes, "rid"))
    count = asked.count()
    bits = min(max(FILTER_BITS[0], 1 << (12 * max(count, 1) - 1).bit_length()), FILTER_BITS[1])
    probes = [F.pmod(F.xxhash64("tid", F.lit(i)), F.lit(bits)) for i in range(3)]
    words = asked.select(F.explode(F.array(*probes)).alias("bit")).groupBy(F.shiftright("bit", 6).alias("word")).agg(
        F.expr("bit_or(shiftleft(1L, cast(bit % 64 as int)))").alias("mask")).collect()
    mask = np.zeros(bits // 64, np.int64)
    mask[[w[0] for w in words]] = [w[1] for w in words]

    def run(batches):
        done: set[int] = set()
        for batch in batches:
            hit = np.ones(batch.num_rows, bool)
            for i in range(1, 4):
                at = batch.column(i).to_numpy()
                hit &= (mask[at >> 6] >> (at & 63)) & 1 == 1
            tid = batch.column(0).to_numpy()
            rows = []
            for r in np.flatnonzero(hit).tolist():
                if tid[r] not in done:
                    if len(done) < 1_000_000:
                        done.add(int(tid[r]))
                    rows.append(r)
            sets = [own.tobytes() for _, own in shingle_sets(batch.column(4).take(pa.array(rows, pa.int64())), k)]
            yield pa.RecordBatch.from_arrays([pa.array(tid[rows]), pa.array(sets, pa.binary())], names=["tid", "own"])
    source = docs.select(text_hash(), "text")
    made = source.select("tid", *[F.pmod(F.xxhash64("tid", F.lit(i)), F.lit(bits)).alias(f"p{i}") for i in range(3)], "text").mapInArrow(giving_back(run), "tid long, own binary")
    sets = saved(made.join(asked, "tid").groupBy("rid").agg(F.first("own").alias("own")))
    drop(asked)
    return sets


def _asking(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) that share as many shingles of their prefixes as they ask for."""
    side = lambda x: classes.select(F.col("rid").alias(x), F.col("prefix").alias(f"p{x}"), F.col("matches").alias(f"m{x}"))
    asked = F.least("ma", "mb")
    part = lambda x: F.slice(f"p{x}", F.lit(1), F.size(f"p{x}") - F.col(f"m{x}") + asked)
    return pairs.join(side("a"), "a").join(side("b"), "b").where(F.size(F.array_intersect(part("a"), part("b"))) >= asked).select("a", "b")


def _verify(docs: DataFrame, classes: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """The saved pairs (a, b) whose whole sets are alike enough."""
    sets = _sets(docs, classes, pairs.select(F.col("a").alias("rid")).unionByName(pairs.select(F.col("b").alias("rid"))).distinct(), k)

    def check(batches):
        for batch in batches:
            good = [alike(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent) for x, y in zip(batch.column(2), batch.column(3))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))
    with_a = pairs.join(sets.select(F.col("rid").alias("a"), F.col("own").alias("x")), "a")
    with_b = with_a.join(sets.select(F.col("rid").alias("b"), F.col("own").alias("y")), "b").select("a", "b", "x", "y")
    links = saved(with_b.mapInArrow(giving_back(check), "a long, b long"))
    drop(sets)
    tidy(docs.sparkSession)
    return links


def _join(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(profiles of all documents, (digest, rid, component) of every class)."""
    with small_batches(docs.sparkSession):
        return _joined(docs, k, percent)


def _joined(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    profile = saved(profiles(docs, k, percent, common_shingles(docs, k)))
    grouped = profile.where("digest is not null").groupBy("digest").agg(
        F.min("tid").alias("tid"), F.max(F.struct("matches", "n", "exposure", "prefix", "sketch", "small")).alias("p"))
    classes = saved(grouped.select(F.monotonically_increasing_id().alias("rid"), "digest", "tid", F.col("p.n").cast("int").alias("n"),
                                   "p.matches", "p.exposure", "p.prefix", "p.sketch", "p.small"))
    tidy(docs.sparkSession)
    entries = classes.select("rid", "exposure", "matches", (F.size("prefix") - F.col("matches")).alias("last"), F.posexplode("prefix").alias("place", "token"))
    entries = entries.select("token", "rid", "exposure", F.col("matches").cast("tinyint").alias("matches"), F.greatest(F.lit(1), F.col("place") - F.col("last") + 1).cast("tinyint").alias("level"))
    often = entries.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    shared = saved(entries.join(often, "token"))
    leaders = shared.groupBy("token").agg(F.max(F.struct("exposure", "rid"))["rid"].alias("leader"))
    tidy(docs.sparkSession)
    stars = shared.select("token", "rid").join(leaders, "token").where("rid <> leader").select(F.col("rid").alias("a"), F.col("leader").alias("b")).distinct()
    pairs = saved(_plausible(stars, classes, percent))
    links = _verify(docs, classes, pairs, k, percent)
    drop(pairs)
    first = saved(components(links))
    tidy(docs.sparkSession)
    label = first.withColumnRenamed("node", "rid")
    labelled = shared.select("token", "rid", "matches", "level", "df").join(label, "rid", "left").withColumn("component", F.coalesce("component", "rid"))
    labelled = saved(labelled)
    of_two = labelled.where("df = 2").groupBy("token").agg(*[f(F.struct("rid", "component", "matches", "level")).alias(x) for f, x in ((F.min, "u"), (F.max, "v"))])
    few = (of_two.where((F.col("u.component") != F.col("v.component")) & (F.greatest("u.level", "v.level") <= F.least("u.matches", "v.matches")))
           .select(F.col("u.rid").alias("a"), F.col("v.rid").alias("b")).distinct())
    rest = saved(_asking(_plausible(few, classes, percent), classes))
    more = _verify(docs, classes, rest, k, percent)
    several = labelled.where("df > 2")
    mixed = several.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("token")
    meeting = several.join(mixed, "token")
    def items_of(meeting: DataFrame, sketch: str) -> DataFrame:
        items = meeting.select("token", "rid", "component", "level").join(classes.select("rid", "n", "matches", F.col(sketch).alias("sketch")), "rid")
        return items.select("token", F.struct("rid", "component", "n", "matches", F.col("level").cast("int").alias("level"), "sketch").alias("item"))
    left = _in_question(_blocked(items_of(meeting, "small"), f"{SKETCH // 8}L"), percent)
    tidy(docs.sparkSession)
    families = _families(_blocked(items_of(labelled.join(left, ["token", "rid"]), "sketch"), "length(item.sketch)"), percent)
    tidy(docs.sparkSession)
    sets = _sets(docs, classes, families.select("rid"), k)
    items = families.join(label, "rid", "left").join(classes.select("rid", "n", "matches", "prefix"), "rid").join(sets, "rid")
    items = items.select(F.col("family").alias("token"), F.struct("rid", F.coalesce("component", "rid").alias("component"), "n", "matches", "prefix", "own").alias("item"))
    found = _links_in_blocks(_blocked(items, "length(item.own)"), percent)
    whole = components(links.unionByName(more).unionByName(found)).withColumnRenamed("node", "rid")
    drop(shared, labelled, rest, left, families, sets)
    tidy(docs.sparkSession)
    return profile, classes.select("rid", "digest").join(whole, "rid", "left").withColumn("component", F.coalesce("component", "rid"))


def similar_documents(docs: DataFrame, k: int = 3, percent: int = 90) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document by links of ``percent`` hundredths of Jaccard similarity.

    Words are runs without white space, A-Z in lower case; a set holds the different k-word shingles, or a shorter text
    as a whole. Null texts and texts without words have empty sets and are linked with nothing. Documents of equal sets
    are one class; repeated rows repeat in the result. A null doc_id names no component unless all its members are null.
    """
    profile, classes = _join(docs, k, percent)
    classes = saved(classes)
    least = profile.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("least"))
    named = classes.join(least, "digest")
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    of_class = named.join(smallest, "component").select(F.col("digest").alias("d"), "component_id")
    return profile.join(of_class, F.col("digest") == F.col("d"), "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each group of similar documents: the one of smallest doc_id, null last, and its columns.

    Rows without words are groups of their own and all stay. Of repeated rows one stays.
    """
    profile, classes = _join(docs, k, percent)
    rows = profile.where("digest is not null").groupBy("digest", "tid", "doc_id").agg(F.count(F.lit(1)).alias("copies"))
    keep = saved(rows.join(classes.select("digest", "component"), "digest").groupBy("component").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), F.col("tid").alias("t"), F.col("copies").alias("c"))).alias("k")).select("k.*"))
    words = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    tid = "tid__"
    while tid in docs.columns:
        tid += "_"
    found = docs.where(words).withColumn(tid, text_hash()).join(keep.select("t", "id"), (F.col(tid) == F.col("t")) & F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")
    if keep.where("c > 1").limit(1).count():
        found = found.dropDuplicates([tid, "doc_id"])
    return found.drop(tid).unionByName(docs.where(~words))
