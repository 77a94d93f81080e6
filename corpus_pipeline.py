"""From raw documents to packed training sequences, each stage written as Parquet and read again by the next.

Quality rules drop what they reject, of each group of near duplicates (five-word shingles, 0.8 or more) one document
stays, personal data is masked, and the rest is packed into sequences of at most 1024 tokens. All stages but the last
return the columns of documents.
"""
from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tabred.llm import jaccard, packing, pii, quality
from tabred.session import shared_folder

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def _few_rows(spark: SparkSession) -> None:
    """Python tasks of this session get 1,000 rows at a time from here on, so that few long texts are held at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; the line field is fitted to labelled ones among them.

    Null and empty texts fail (fewer than 20 words). Repeated rows stay repeated, all columns stay as they are, very long
    texts are judged whole, and an empty table stays empty.
    """
    _few_rows(spark)
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the smallest doc_id, a null one last; of repeated rows one.

    Null texts and texts without words are in no group and all stay. All columns stay; an empty table stays empty.
    """
    return jaccard.one_of_each(docs, k=5, percent=80)


def mask_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind; null texts stay null, repeated rows and all columns stay."""
    return pii.mask_private(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document: its sequence and place there. Null and empty texts are one piece of the end id alone."""
    _few_rows(spark)
    return packing.pack_documents(docs, TOKENIZER)


STAGES = [("quality rules", keep_good), ("near duplicates", one_of_each), ("personal data", mask_private), ("packing", pack)]

#: Training, similarity over whole sets and tokenizers have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/corpus-pipeline/{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
