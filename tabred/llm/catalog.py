"""Registered queries of the training-data operators and their DuckDB texts."""
from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tabred.llm import bpe, html, jaccard, licenses, neighbours, packing, pii, quality, secrets, sharding, toxicity, trie, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def put(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return put


@query("op1_rendezvous_shards", sharding.oracle_sql())
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard_documents(table(spark, folder, "documents"))


@query("op9_byte_bpe")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.round_trip(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query("op7_packed_sequences")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op5_secret_ownership")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    """A source owns what it publishes; its texts of one language count as one repository."""
    docs = table(spark, folder, "documents")
    return secrets.find_secrets(docs, F.col("source"), F.concat_ws("/", "source", "lang"))


@query("op10_line_field")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality_rules(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op6_weak_labels")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return pii.find_private(table(spark, folder, "documents"))


@query("op8_tag_path_ratios")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return html.extract_pages(table(spark, folder, "pages"))


@query("op4_near_vectors")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.near_vectors(table(spark, folder, "embeddings"))


@query("op3_license_compression")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, folder, "documents"))


@query("op2_adaptive_prefixes")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.similar_documents(table(spark, folder, "documents"))


@query("op11_splitter_skeleton")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return trie.conversation_trie(table(spark, folder, "conversations"))


@query("op12_incremental_whitening")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whitened_vectors(table(spark, folder, "embeddings"))


@query("op13_toxic_spans")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.score_documents(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    return corpus_pipeline.run(spark, folder)
