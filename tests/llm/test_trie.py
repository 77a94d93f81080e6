"""The trie against a plain one of all prefixes."""
import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tabred.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def plain(rows):
    turns = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            turns[c].append((t is not None, t or 0, r or "", x or ""))
    turns = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in turns.items()}
    members = defaultdict(list)
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        path = tuple(turns.get(c - c % 5, [])[:h] + own[h:])
        for d in range(len(path) + 1):
            members[path[:d]].append((c, len(path)))
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p in members:
        weight = (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            saved[p[:d]] += weight
    return {(min(m)[0], len(p), min(members[p[:-1]])[0] if p else None, len(m), children[p], leaves[p], saved[p],
             hashlib.sha256(",".join(str(c) for c, n in sorted(m) if n == len(p)).encode()).hexdigest()) for p, m in members.items()}


def check(spark, rows, **sizes):
    got = trie.conversation_trie(spark.createDataFrame(rows, SCHEMA).withColumn("n_convs", F.lit("x")), **sizes).select(*COLUMNS).collect()
    want = plain(rows)
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def made(seed, convs=120):
    r = random.Random(seed)
    texts, rows = ["a", "bb", "ccc", "é", ""], []
    for c in r.sample(range(3 * convs), convs):
        length = r.choice([1, 1, 2, 3, 5, 9, 14])
        kind = r.random()
        for t in range(length):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", "same" if kind < 0.35 else texts[r.randrange(5)] if kind < 0.8 else f"own {c} {t}"))
    return rows


@pytest.mark.parametrize("segment,shard_bytes", [(4096, 4_000_000), (5, 200)])
def test_trie_matches_brute_force(spark, segment, shard_bytes):
    check(spark, made(segment), segment=segment, shard_bytes=shard_bytes)


def test_given_conversations(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    check(spark, rows)


def test_odd_turns(spark):
    rows = [(5, 0, "user", "hi"), (5, None, "user", "first"), (5, 1, None, "x"), (5, 1, None, "x"), (5, 1, "a", None), (6, 0, "user", "hi"), (7, None, None, None),
            (None, 0, "user", "nobody"), (8, 3, "user", "ab" * 40_000), (8, 3, "user", "ab" * 40_000), (9, 3, "user", "ab" * 40_000), (-3, 0, "user", "hi"), (-3, 0, "user", "hi")]
    rows = [r for r in rows if r[0] != -3]
    check(spark, rows)
    check(spark, rows, segment=2, shard_bytes=50)
    empty = spark.createDataFrame(rows, SCHEMA).limit(0)
    assert trie.conversation_trie(empty).count() == 0


def test_one_conversation_holds_most_rows(spark):
    rows = [(40, t % 700, "user", f"t{t % 900}") for t in range(1500)] + [(c, t, "user", f"t{t}") for c in range(10, 22) for t in range(4)]
    rows += [(c, t, "user", f"long {t}") for c in (100, 105, 110) for t in range(60)]
    check(spark, rows, segment=25, shard_bytes=1500)


def test_shards_tell_prefixes_apart():
    a, b = b"x" * 80, b"x" * 40 + b"y" * 40
    assert trie.shared_marks(a, b) == 1 and trie.shared_marks(a, a + b) == 2 and trie.shared_marks(b"", a) == 0
    skeleton = trie.Skeleton([a, b])
    assert len(skeleton.parent) == 4 and [skeleton.shard(x) for x in (b"", a, a + b, b, b"z" * 40)] == [0, 1, 1, 2, 2]
