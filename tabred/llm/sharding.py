"""Sharding by weighted rendezvous hashing, in DataFrame functions only."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tabred.llm.tables import digits52, numbered

SHARDS = 24


def _score(key: Column, shard: int, weight: float) -> Column:
    """Waiting time of a shard for a key: exponential with the weight as rate."""
    draw = (digits52(F.concat(key, F.lit(f"/{shard}"))) + 0.5) / float(2 ** 52)
    return -F.log(draw) / F.lit(float(weight))


def rendezvous(key: Column, weights: list[float]) -> Column:
    """Shard of a key: the one with the shortest waiting time, the lower number on a tie.

    The key and the weights decide alone. A shard gets a share of keys in proportion to its weight. With one more
    shard a key stays or goes to the new one; when a weight changes, keys only move to or from that shard.
    """
    if not weights or any(not w > 0 for w in weights):
        raise ValueError("weights must be positive")
    key = F.coalesce(key.cast("string"), F.lit("null"))
    best = F.array_min(F.array(*[F.struct(_score(key, i, w).alias("score"), F.lit(i).alias("shard")) for i, w in enumerate(weights)]))
    return best["shard"]


def shard_rows(df: DataFrame, keys: list[str], weights: list[float], name: str = "shard") -> DataFrame:
    """``df`` with a shard number per row, all its columns kept; ``name`` must be new.

    Several key columns are joined with their lengths, so that ("a", "bc") and ("ab", "c") differ. Null keys count
    as one key of their own. Equal keys share a shard; an empty table stays empty.
    """
    if name in df.columns:
        raise ValueError(f"column {name} exists")
    text = [F.col(f"`{k}`").cast("string") for k in keys]
    key = text[0] if len(text) == 1 else F.concat_ws(",", *[F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("null")) for t in text])
    return df.withColumn(name, rendezvous(key, weights))


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Every document's shard, its place there, and its shard after one more shard of equal weight is added.

    Sizes count UTF-8 bytes plus 8, nothing for a null text. Only sizes and checksums are moved, never texts.
    """
    narrow = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
                         F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"))
    placed = shard_rows(narrow, ["doc_id"], [1.0] * shards)
    old = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    best, new = F.least(*[_score(old, i, 1.0) for i in range(shards)]), _score(old, shards, 1.0)
    placed = placed.withColumn("grown_shard", F.when(new < best, F.lit(shards)).otherwise(F.col("shard")))
    return (numbered(placed, ["shard"], "slot")
            .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"))


def oracle_sql(shards: int = SHARDS) -> str:
    """The same rows in DuckDB; the checksum goes byte by byte through a table made from its polynomial."""
    score = "-ln((('0x' || substr(md5(k || '/' || {i}), 1, 13))::bigint + 0.5) / 4503599627370496.0)"
    step = "list_reduce(list_prepend(i, range(8)), lambda c, j: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)"
    return f"""
with crc as (select list({step} order by i) as crc_table from range(256) r(i)),
base as (select doc_id, coalesce(strlen(text), 0) + 8 as size,
    regexp_extract_all(hex(encode(coalesce(text, ''))), '..') as bytes,
    coalesce(doc_id::varchar, 'null') as k from documents),
sums as (select doc_id, size, k, xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(bytes, lambda b: ('0x' || b)::bigint)),
    lambda c, b: xor(c >> 8, crc_table[(xor(c, b) & 255) + 1]))) as text_crc32 from base, crc),
scored as (select *, list_transform(range({shards + 1}), lambda i: {score.format(i='i')}) as s from sums),
placed as (select doc_id, size, text_crc32, list_position(s[1:{shards}], list_min(s[1:{shards}])) - 1 as shard,
    list_position(s, list_min(s)) - 1 as grown_shard from scored)
select doc_id, size, text_crc32, 'key' as law, shard::int as shard,
    row_number() over (partition by shard order by ('0x' || substr(md5(concat_ws('|', doc_id, size, text_crc32, shard, grown_shard)), 1, 13))::bigint, doc_id) - 1 as slot,
    grown_shard::int as grown_shard
from placed"""
