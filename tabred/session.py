"""Session settings, the shared folder, and tables written there once per application."""
from __future__ import annotations

import hashlib
import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_written: dict[tuple[str, str], DataFrame] = {}
_scans: dict[tuple[str, str], DataFrame] = {}
_local_folder: dict[str, str] = {}


def build_session(name: str = "tabred", cores: str = "*") -> SparkSession:
    """Local session for tests and the benchmark; a cluster brings its own."""
    shuffles = str(os.cpu_count() if cores == "*" else cores)
    return (SparkSession.builder.master(f"local[{cores}]").appName(name)
            .config("spark.sql.shuffle.partitions", shuffles)
            .config("spark.sql.session.timeZone", "UTC")
            .config("spark.driver.memory", "12g")
            .config("spark.ui.enabled", "false")
            .config("spark.ui.showConsoleProgress", "false")
            .getOrCreate())


def shared_folder(spark: SparkSession) -> str:
    """Folder that every executor reaches: ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors reach")
    if sc.applicationId not in _local_folder:
        _local_folder[sc.applicationId] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _local_folder[sc.applicationId]


def stored(spark: SparkSession, name: str, source: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Write ``build()`` once per application as parquet in the shared folder, then read it.

    ``source`` tells apart the inputs (for example the data folder) that the table is built from.
    """
    app = spark.sparkContext.applicationId
    tag = hashlib.sha256(source.encode()).hexdigest()[:12]
    path = f"{shared_folder(spark)}/tabred/{app}/{tag}/{name}"
    if (app, path) not in _written:
        build().write.mode("overwrite").parquet(path)
        _written[app, path] = spark.read.parquet(path)
    return _written[app, path]


def scan(spark: SparkSession, path: str) -> DataFrame:
    """Lazy parquet scan; the schema is read from the files once per application."""
    key = (spark.sparkContext.applicationId, path)
    if key not in _scans:
        _scans[key] = spark.read.parquet(path)
    return _scans[key]


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage with a parquet table in the shared folder: smaller than a checkpoint, and read column by column."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tabred/{spark.sparkContext.applicationId}/once/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
