"""Prefix trie of rebuilt conversations: a skeleton of splitter paths, and sorted shards for all else.

1. A turn becomes a mark: a digest of role and text, and its bytes. Turns are placed in their conversation by a range
   sort, so that no conversation has to fit into a task. Marks of up to ``SEGMENT`` turns make a path; a longer
   conversation is a chain of segments, each under the digest of all before it. Equal paths become one row with counts.
2. Keys of a bounded sample cut the sorted paths into shards. All prefixes of these splitters are the skeleton, the only
   nodes whose members lie in several shards; every task is told this small trie.
3. A task reads its shard in order and finishes every other node as soon as the path leaves it. For skeleton nodes it
   gives partial counts and sums, which Spark adds up; what hangs on totals of skeleton nodes is finished on the trie.
Segments deeper than the first are worked on before the ones above, whose last nodes take over their sums.
"""
from __future__ import annotations

import hashlib
from bisect import bisect_right
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from tabred.llm.tables import drop, saved
from tabred.operators.ranking import expand_copies

#: Turns of a path at most; bytes of a mark: a digest and the length of the text.
SEGMENT, MARK = 4096, 40
#: Bytes of paths of one shard, about, and of all splitters together at most.
SHARD_BYTES, SKELETON_BYTES = 4_000_000, 8_000_000
#: Sampled paths per splitter.
SAMPLED = 8
#: Opening turns of a base conversation that others take over, at most.
OPENING = 8
FAMILY, TAKEN = 5, 9
_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, pid binary"


def _sha(column):
    return F.unhex(F.sha2(column, 256))


def placed_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, mark) of all turns: places from 0 in the order of turn (null first), role, text.

    Equal rows are counted before they are moved. Texts travel as digest, length and their first 32 characters; texts
    of one turn and role that agree so far are ordered by digest. A range sort deals even one conversation's rows to
    several tasks; each numbers its own, from where the tasks before it end.
    """
    spark = conversations.sparkSession
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    size = F.unhex(F.lpad(F.hex(F.octet_length(text).cast("long")), 16, "0"))
    mark = F.concat(_sha(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)), size)
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), F.substring(text, 1, 32).alias("head"), mark.alias("mark"))
    once = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("times"))
    order = [F.asc_nulls_first("turn"), "role", "head", "mark"]
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = saved(once.repartitionByRange(tasks, "conv_id", *order).withColumn("part", F.spark_partition_id()))
    sums = dealt.groupBy("conv_id", "part").agg(F.sum("times").alias("of_part"))
    sums = sums.select("conv_id", "part", (F.sum("of_part").over(W.partitionBy("conv_id").orderBy("part")) - F.col("of_part")).alias("first"))
    inside = W.partitionBy("conv_id", "part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    numbered = dealt.withColumn("inside", F.sum("times").over(inside) - F.col("times")).join(sums, ["conv_id", "part"])
    out = expand_copies(numbered, "times", "copy")
    return out.select("conv_id", (F.col("first") + F.col("inside") + F.col("copy") - 1).alias("place"), "mark")


def rebuilt_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth, mark, length) of all rebuilt turns, and (conv_id) of conversations without any.

    Conversation c has the first h turns of conversation c - c % 5 and then its own after its first h; h is the crc32
    of its decimal id mod 9. Rows without a conv_id belong to no conversation.
    """
    turns = saved(placed_turns(conversations))
    taken = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % TAKEN).cast("long")
    ids = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own")).withColumn("h", taken).withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY)
    bases = ids.where(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("base"), F.least("own", F.lit(OPENING)).alias("there"))
    ids = ids.join(bases, "base", "left").withColumn("from_base", F.least("h", F.coalesce("there", F.lit(0))))
    ids = saved(ids.withColumn("length", F.col("from_base") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).select("conv_id", "base", "h", "from_base", "length"))
    opening = turns.where((F.col("conv_id") % FAMILY == 0) & (F.col("place") < OPENING)).withColumnRenamed("conv_id", "base")
    first = opening.join(ids, "base").where("place < from_base").select("conv_id", (F.col("place") + 1).alias("depth"), "mark", "length")
    own = turns.where(F.col("place") >= taken).join(ids.where("length > from_base"), "conv_id")
    rest = own.select("conv_id", (F.col("from_base") + F.col("place") - F.col("h") + 1).alias("depth"), "mark", "length")
    return first.unionByName(rest), ids.where("length = 0").select("conv_id")


def path_groups(turns: DataFrame, turnless: DataFrame, segment: int = SEGMENT) -> tuple[DataFrame, DataFrame]:
    """Distinct paths with counts, and (pid, conv_id) of the last path of every conversation.

    A path has a level (how many segments stand above it), the digest ``root`` of those, and its own digest ``pid`` with
    them. ``n`` conversations take it, ``min_conv`` is the least, and ``ends`` of them end with it.
    """
    level = F.floor((F.col("depth") - 1) / segment).cast("long").alias("level")
    marks = F.transform(F.array_sort(F.collect_list(F.struct("depth", "mark"))), lambda x: F.hex(x["mark"]))
    paths = turns.groupBy("conv_id", "length", level).agg(F.unhex(F.array_join(marks, "")).alias("path"))
    paths = paths.withColumn("ends", F.col("level") == F.floor((F.col("length") - 1) / segment))
    nothing = F.unhex(F.lit(""))
    paths = saved(paths.unionByName(turnless.select("conv_id", F.lit(0).cast("long").alias("length"), F.lit(0).cast("long").alias("level"), nothing.alias("path"), F.lit(True).alias("ends"))))
    short = paths.where(F.col("length") <= segment).withColumn("root", nothing)
    long = paths.where(F.col("length") > segment)
    each = long.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("level", _sha("path").alias("own")))).alias("each"))
    chain = F.aggregate("each", F.array(F.lit(nothing)), lambda acc, x: F.concat(acc, F.array(_sha(F.concat(F.element_at(acc, -1), x["own"])))))
    roots = each.select("conv_id", F.posexplode(chain).alias("level", "root")).withColumn("level", F.col("level").cast("long"))
    paths = short.unionByName(long.join(roots, ["conv_id", "level"]))
    paths = saved(paths.withColumn("pid", _sha(F.concat("root", _sha("path")))).select("level", "root", "path", "pid", "conv_id", "ends"))
    groups = paths.groupBy("level", "pid").agg(F.first("root").alias("root"), F.first("path").alias("path"), F.count(F.lit(1)).alias("n"),
                                               F.min("conv_id").alias("min_conv"), F.sum(F.col("ends").cast("long")).alias("ends"))
    return saved(groups), paths.where("ends").select("pid", "conv_id")


def end_digests(ended: DataFrame) -> DataFrame:
    """(pid, ends_sha256): SHA-256 of each group's decimal conv_ids, rising, joined by commas.

    Ids of a range of 65,536 make one piece of text; a group's pieces pass a running digest in order, one at a time.
    """
    pieces = ended.groupBy("pid", F.shiftright("conv_id", 16).alias("piece")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))
    tasks = int(ended.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        last, digest = None, None
        for batch in batches:
            done = []
            for pid, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if pid != last:
                    if digest is not None:
                        done.append((last, digest.hexdigest()))
                    last, digest = pid, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            yield pa.RecordBatch.from_pydict({"pid": [d[0] for d in done], "ends_sha256": [d[1] for d in done]}, schema=schema)
        if digest is not None:
            yield pa.RecordBatch.from_pydict({"pid": [last], "ends_sha256": [digest.hexdigest()]}, schema=schema)
    schema = pa.schema([("pid", pa.binary()), ("ends_sha256", pa.string())])
    return pieces.repartition(tasks, "pid").sortWithinPartitions("pid", "piece").select("pid", "ids").mapInArrow(run, "pid binary, ends_sha256 string")


@dataclass
class Skeleton:
    """Trie of all prefixes of the splitters; node 0 is the top, and every node comes after its parent."""
    splitters: list[bytes]
    children: list[dict[bytes, int]] = field(default_factory=lambda: [{}])
    parent: list[int] = field(default_factory=lambda: [-1])
    depth: list[int] = field(default_factory=lambda: [0])
    size: list[int] = field(default_factory=lambda: [0])

    def __post_init__(self) -> None:
        for path in self.splitters:
            at = 0
            for i in range(0, len(path), MARK):
                mark = path[i:i + MARK]
                if mark not in self.children[at]:
                    self.children[at][mark] = len(self.parent)
                    self.children.append({})
                    self.parent.append(at)
                    self.depth.append(self.depth[at] + 1)
                    self.size.append(int.from_bytes(mark[-8:], "big"))
                at = self.children[at][mark]

    def shard(self, path: bytes) -> int:
        return bisect_right(self.splitters, path)


def skeleton_of(paths: DataFrame, shard_bytes: int = SHARD_BYTES, most_bytes: int = SKELETON_BYTES) -> Skeleton:
    """Splitters from a sample of ``key``; fewer where paths are long, so that all together stay below ``most_bytes``."""
    told = paths.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.length("key") + MARK).alias("bytes"), F.max(F.length("key") + MARK).alias("most")).first()
    if not told.rows:
        return Skeleton([])
    least = int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = min(max(least, -(-told.bytes // shard_bytes)), told.rows, max(1, most_bytes // told.most))
    wanted = min(shards * SAMPLED, told.rows)
    place = F.conv(F.substring(F.hex("pid"), 1, 13), 16, 10).cast("long")
    sample = paths.where(place <= F.lit(int(min(1.0, 2 * wanted / told.rows) * 16 ** 13))).select("key", place.alias("at")).orderBy("at", "key").limit(wanted)
    keys = sorted({bytes(r.key) for r in sample.collect()})
    return Skeleton(sorted({keys[i * len(keys) // shards] for i in range(1, shards)} - {b""}) if keys else [])


class _Open:
    """A node whose subtree is being read."""
    __slots__ = ("n", "conv", "children", "leaves", "saved", "size", "pid", "skeleton", "kids", "above")

    def __init__(self, size: int, skeleton: int, above: int | None) -> None:
        self.n = self.children = self.leaves = self.saved = 0
        self.conv = None
        self.size, self.skeleton, self.pid, self.above = size, skeleton, None, above
        self.kids: list[tuple] = []

    def meet(self, n: int, conv: int) -> None:
        self.n += n
        self.conv = conv if self.conv is None or conv < self.conv else self.conv


def shared_marks(a: bytes, b: bytes) -> int:
    """Marks at the start that two paths share."""
    low, high = 0, min(len(a), len(b)) // MARK
    while low < high:
        middle = (low + high + 1) // 2
        if a[:middle * MARK] == b[:middle * MARK]:
            low = middle
        else:
            high = middle - 1
    return low


@dataclass
class Shard:
    """Reads the paths of one shard in order; ``rows`` gets what is finished.

    Kinds: 0 a node, 1 a node whose parent is a node of the skeleton, 2 a part of a skeleton node, 3 the sums of a
    segment's root. ``lead`` marks stand above the first turn (1 for deeper segments: their root).
    """
    trie: Skeleton
    lead: int
    start: int
    rows: list[tuple] = field(default_factory=list)
    open: list[_Open] = field(default_factory=list)
    path: bytes = b""

    def take(self, path: bytes, pid: bytes, n: int, conv: int, ends: int, above: int | None, below: tuple[int, int, int]) -> None:
        if not self.open:
            self.open.append(_Open(0, 0, None))
        keep = shared_marks(self.path, path) if len(self.open) > 1 else 0
        while len(self.open) > keep + 1:
            self.close()
        for i in range(keep * MARK, len(path), MARK):
            mark, parent = path[i:i + MARK], self.open[-1]
            known = self.trie.children[parent.skeleton].get(mark, -1) if parent.skeleton >= 0 else -1
            self.open.append(_Open(int.from_bytes(mark[-8:], "big"), known, above))
        own = self.open[-1]
        own.meet(n, conv)
        own.pid = pid if ends else own.pid
        own.children, own.leaves, own.saved = own.children + below[0], own.leaves + below[1], own.saved + below[2]
        self.path = path

    def close(self) -> None:
        own = self.open.pop()
        place = len(self.open)
        root = self.path[:32] if self.lead and place == 1 else None
        above = own.above if self.lead and place == 2 else None
        if own.skeleton >= 0:
            self.rows.append((2, own.conv, 0, above, own.n, own.children, own.leaves, own.saved, root or own.pid, own.skeleton))
        elif root is None:
            own.leaves += own.children == 0
            own.saved += (own.n - 1) * own.size
        for kid in own.kids:
            self.rows.append((0, *kid[:2], own.conv, *kid[2:], None))
        if not self.open:
            return
        parent = self.open[-1]
        parent.meet(own.n, own.conv)
        parent.leaves, parent.saved = parent.leaves + own.leaves, parent.saved + own.saved
        if own.skeleton >= 0:
            return
        parent.children += 1
        node = (own.conv, self.start + place - self.lead, own.n, own.children, own.leaves, own.saved, own.pid)
        if root is not None:
            self.rows.append((3, own.conv, 0, None, own.n, own.children, own.leaves, own.saved, root, None))
        elif self.lead and place == 2:
            self.rows.append((0, *node[:2], above, *node[2:], None))
        elif parent.skeleton >= 0:
            self.rows.append((1, *node[:2], None, *node[2:], parent.skeleton))
        else:
            parent.kids.append(node)

    def end(self) -> None:
        while self.open:
            self.close()
        self.path = b""


_OUT = pa.schema([("kind", pa.int32()), *[(c, pa.int64()) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")],
                  ("pid", pa.binary()), ("skeleton", pa.int64())])


def level_nodes(paths: DataFrame, level: int, segment: int = SEGMENT, shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, DataFrame]:
    """(nodes, sums of roots) of one level of segments.

    ``paths``: key (root mark and marks, in level 0 marks alone), pid, n, min_conv, ends, above (least conversation of
    the root's node), and children, leaves and savings of deeper segments at the path's last node.
    """
    spark, lead = paths.sparkSession, int(level > 0)
    trie = skeleton_of(paths, shard_bytes)
    told = spark.sparkContext.broadcast(trie)
    columns = ["key", "pid", "n", "min_conv", "ends", "above", "b_children", "b_leaves", "b_saved"]

    def deal(batches):
        for batch in batches:
            shards = [told.value.shard(k) for k in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shards, pa.int32())], names=[*columns, "shard"])

    def run(batches):
        now, at = Shard(told.value, lead, level * segment), None
        for batch in batches:
            for key, pid, n, conv, ends, above, b1, b2, b3, shard in zip(*(c.to_pylist() for c in batch.columns)):
                if shard != at:
                    now.end()
                    at = shard
                now.take(key, pid, n, conv, ends, above, (b1, b2, b3))
                if len(now.rows) >= 10_000:
                    yield _batch(now.rows)
            yield _batch(now.rows)
        now.end()
        yield _batch(now.rows)

    kind = "key binary, pid binary, n long, min_conv long, ends long, above long, b_children long, b_leaves long, b_saved long, shard int"
    dealt = paths.select(*columns).mapInArrow(deal, kind).repartition(len(trie.splitters) + 1, "shard").sortWithinPartitions("shard", "key")
    out_kind = _NODE.replace(", pid binary", "")
    out = saved(dealt.mapInArrow(run, f"kind int, {out_kind}, pid binary, skeleton long"))
    finished, roots = _finish(out, trie, lead, level * segment)
    names = [c.split()[0] for c in _NODE.split(", ")]
    known = spark.createDataFrame([(i, r[0]) for i, r in finished.items()], "skeleton long, of_parent long")
    below = out.where("kind = 1").join(F.broadcast(known), "skeleton").withColumn("parent_conv_id", F.col("of_parent"))   # bounded by SKELETON_BYTES
    own = spark.createDataFrame([r for i, r in finished.items() if trie.depth[i] >= 2 * lead], _NODE)
    nodes = out.where("kind = 0").select(*names).unionByName(below.select(*names)).unionByName(own)
    sums = out.where("kind = 3").select(F.col("pid").alias("root"), "n_children", "n_leaves", "saved_tokens")
    if roots:
        sums = sums.unionByName(spark.createDataFrame(roots, "root binary, n_children long, n_leaves long, saved_tokens long"))
    return nodes, sums


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    out = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_OUT)], schema=_OUT)
    rows.clear()
    return out


def _finish(out: DataFrame, trie: Skeleton, lead: int, start: int) -> tuple[dict[int, tuple], list[tuple]]:
    """Rows of the skeleton's nodes by number, and sums of those that are roots of segments.

    The parts are added up in Spark; the driver gets one row per node of the skeleton, which SKELETON_BYTES bounds.
    """
    parts = out.where("kind = 2").groupBy("skeleton").agg(F.sum("n_convs").alias("n"), F.min("conv_id").alias("conv"), F.sum("n_children").alias("children"), F.sum("n_leaves").alias("leaves"),
                                                          F.sum("saved_tokens").alias("saved"), F.max("pid").alias("pid"), F.max("parent_conv_id").alias("above"))
    got = {r.skeleton: r for r in parts.collect()}
    leaves, savings = {i: 0 for i in got}, {i: 0 for i in got}
    rows, roots = {}, []
    for i in sorted(got, reverse=True):
        r, kids = got[i], len(trie.children[i])
        is_root, depth = lead == 1 and trie.depth[i] == 1, trie.depth[i]
        if not is_root and depth >= lead:
            leaves[i] += r.children + kids == 0
            savings[i] += (r.n - 1) * trie.size[i]
        if depth:
            leaves[trie.parent[i]] += leaves[i]
            savings[trie.parent[i]] += savings[i]
        above = r.above if lead and depth == 2 else got[trie.parent[i]].conv if depth else None
        pid = bytes(r.pid) if r.pid is not None and not is_root else None
        rows[i] = (r.conv, start + depth - lead, above, r.n, r.children + kids, r.leaves + leaves[i], r.saved + savings[i], pid)
        if is_root:
            roots.append((bytes(r.pid), *rows[i][4:7]))
    return rows, roots


def prefix_nodes(turns: DataFrame, turnless: DataFrame, segment: int = SEGMENT, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row per distinct prefix of the given sequences; see :func:`conversation_trie` for the columns.

    ``turns``: conv_id, depth from 1, mark (digest of the turn and 8 bytes of its weight), length of the sequence.
    """
    spark = turns.sparkSession
    groups, ended = path_groups(turns, turnless, segment)
    digests = end_digests(ended)
    deepest = groups.agg(F.max("level")).first()[0]
    if deepest is None:
        return _with_ends(spark.createDataFrame([], _NODE), digests)
    nodes, sums, shared = [], None, 0
    if deepest:
        above = groups.select((F.col("level") + 1).alias("level"), F.col("pid").alias("root"), F.col("n").alias("n_above"), F.col("min_conv").alias("above"))
        deep = saved(groups.join(above, ["level", "root"]))
        nodes.append(_lonely(deep.where("n_above = 1"), segment))
        deep = deep.where("n_above > 1").withColumn("key", F.concat("root", F.unhex(F.lit("00" * 8)), "path"))
        shared = deep.agg(F.max("level")).first()[0] or 0
    for level in range(shared, -1, -1):
        if level:
            own = deep.where(F.col("level") == level)
        else:
            own = groups.where("level = 0").withColumn("above", F.lit(None).cast("long")).withColumn("key", F.col("path"))
        if sums is not None:
            own = own.join(sums.withColumnsRenamed({"root": "pid", "n_children": "s1", "n_leaves": "s2", "saved_tokens": "s3"}), "pid", "left")
        else:
            own = own.withColumns({c: F.lit(None).cast("long") for c in ("s1", "s2", "s3")})
        goes_on = (F.col("n") > F.col("ends")).cast("long")
        own = own.withColumns({"b_children": F.coalesce("s1", goes_on), "b_leaves": F.coalesce("s2", goes_on), "b_saved": F.coalesce("s3", F.lit(0))})
        found, sums = level_nodes(saved(own), level, segment, shard_bytes)
        nodes.append(found)
    out = nodes[0]
    for more in nodes[1:]:
        out = out.unionByName(more)
    return _with_ends(out, digests)


def _lonely(paths: DataFrame, segment: int) -> DataFrame:
    """Nodes of segments whose root one conversation alone reaches: a chain, whatever its length."""
    count = F.length("path") / MARK
    each = paths.withColumn("i", F.explode(F.sequence(F.lit(1), count.cast("int"))))
    last = (F.col("i") == count) & (F.col("ends") > 0)
    return each.select(F.col("min_conv").alias("conv_id"), (F.col("level") * segment + F.col("i")).alias("depth"), F.col("min_conv").alias("parent_conv_id"), F.lit(1).cast("long").alias("n_convs"),
                       F.when(last, 0).otherwise(1).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), F.when(last, F.col("pid")).alias("pid"))


def _with_ends(nodes: DataFrame, digests: DataFrame) -> DataFrame:
    ended = nodes.where("pid is not null").join(digests, "pid").drop("pid")
    none = nodes.where("pid is null").drop("pid").withColumn("ends_sha256", F.lit(hashlib.sha256().hexdigest()))
    return ended.unionByName(none)


def conversation_trie(conversations: DataFrame, segment: int = SEGMENT, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row per node of the trie of rebuilt conversations: each distinct sequence of their first d turns.

    ``conversations`` has conv_id, turn, role and text; other columns are ignored. Null roles and texts are empty; rows
    with a null conv_id are left out. Turns of one number are ordered by role and text, a null number first; repeated
    rows are turns of their own. The root has depth 0 and no parent; an empty table has no nodes at all.
    """
    return prefix_nodes(*rebuilt_turns(conversations), segment, shard_bytes)
