"""Intermediate tables in the shared folder, and numbering without gaps."""
from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tabred.session import shared_folder

#: Rows that one numbering task sorts, about.
ROWS_PER_BIN = 50_000
#: Copies of one row that are written out by one task.
COPIES_PER_TASK = 50_000


def saved(df: DataFrame) -> DataFrame:
    """Write ``df`` as parquet in the shared folder and read it back: its lineage ends there.

    The folder goes when the application ends, or earlier by :func:`drop`.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tabred-llm/{uuid.uuid4().hex}"
    df.write.parquet(path)
    fs, target = _file_system(spark, path)
    fs.deleteOnExit(target)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_path = path
    return out


def drop(*frames: DataFrame) -> None:
    """Remove tables of :func:`saved` that no later plan reads."""
    for df in frames:
        fs, target = _file_system(df.sparkSession, df.saved_path)
        fs.delete(target, True)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000):
    """Batches of few rows for what is written or collected inside, so that Python tasks hold few texts or sets at a time."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def giving_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run`` for mapInArrow; as its task ends, the Python worker, which Spark keeps for later tasks, frees what it holds."""
    def whole(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)
    return whole


def tidy(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of finished steps now; it does so when their plans are collected as garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _file_system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def digits52(text: Column) -> Column:
    """The first 52 bits of a text's md5 as a number; null text counts as empty."""
    return F.conv(F.substring(F.md5(F.coalesce(text, F.lit(""))), 1, 13), 16, 10).cast("long")


def numbered(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Add ``name``: 0, 1, 2, ... within ``keys`` (never null), in the order of a hash of the whole row.

    No task sees a whole group: equal rows are counted before they are moved, the hash range is cut into bins, a
    group's bins are added up, and each bin is numbered alone, beginning at its running total. Equal rows get
    neighbouring numbers. The result does not depend on bins or partitions; an empty table stays empty.
    """
    spark, columns = df.sparkSession, df.columns
    text = F.concat_ws("|", *[F.col(c).cast("string") for c in columns])
    rows = saved(df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n__")).withColumn("h__", digits52(text)))
    bins = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // ROWS_PER_BIN))
    rows = rows.withColumn("bin__", F.shiftright(F.col("h__"), 26) * bins / 2 ** 26).withColumn("bin__", F.col("bin__").cast("int"))
    sums = rows.groupBy(*keys, "bin__").agg(F.sum("n__").alias("of_bin__"))
    sums = sums.select(*keys, "bin__", (F.sum("of_bin__").over(Window.partitionBy(*keys).orderBy("bin__")) - F.col("of_bin__")).alias("first__"))
    order = Window.partitionBy(*keys, "bin__").orderBy("h__", *columns)
    placed = rows.withColumn("place__", F.sum("n__").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n__"))
    placed = placed.join(sums, [*keys, "bin__"]).withColumn("from__", F.col("first__") + F.col("place__"))
    once = placed.where("n__ = 1").select(*columns, F.col("from__").alias(name))
    many = placed.where("n__ > 1").withColumn("part__", F.explode(F.sequence(F.lit(0), ((F.col("n__") - 1) / COPIES_PER_TASK).cast("int"))))
    many = many.repartition(bins, "from__", "part__")
    low = F.col("from__") + F.col("part__") * COPIES_PER_TASK
    high = F.least(low + COPIES_PER_TASK, F.col("from__") + F.col("n__")) - 1
    return once.unionByName(many.select(*columns, F.explode(F.sequence(low, high)).alias(name)))
