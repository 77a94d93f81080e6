"""Two of the batch jobs as streams: corrections to a folded table, and a monitor of conflicting groups."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery


def latest_changes(feed: DataFrame, keys: list[str], value: str, time: str) -> DataFrame:
    """Last change per key of a batch: [keys..., a1, changed_at]."""
    return feed.groupBy(*keys).agg(F.max_by(value, F.struct(time, value)).alias("a1"), F.max(time).alias("changed_at"))


class FoldedTable:
    """A folded table under ``path`` that takes corrections in proportion to their number.

    ``base/version=v/bucket=b`` holds rows, dealt to buckets by the key that corrections name; ``log/batch=n`` holds one
    row per key that micro-batch n corrects; ``state/seq=k`` names the version of every bucket and the batches that are
    in it already. Readers take the last state and put the younger log on top. ``compact`` rewrites the buckets that the
    log touches and no others. Each file set is written once, so a step that is repeated after a failure changes nothing.
    Every row remembers when it last changed, so a change that arrives late does not undo a newer one.
    """

    def __init__(self, spark: SparkSession, path: str, locator: dict[str, str], column: str, time_type: str) -> None:
        """``locator``: columns of the feed and the columns of the table that they name; ``column`` is corrected."""
        self.spark, self.path, self.locator, self.column, self.time_type = spark, path, locator, column, time_type

    def create(self, df: DataFrame, buckets: int) -> None:
        """Version 0 of every bucket. Large buckets get several files, whatever key they hold."""
        marked = df.withColumn("changed_at", F.lit(None).cast(self.time_type)).withColumn("bucket", self._bucket(list(self.locator.values()), buckets))
        marked.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.path}/base/version=0")
        self._put(self.spark.range(buckets).select(F.col("id").cast("int").alias("bucket"), F.lit(0).alias("version"), F.lit(-1).cast("long").alias("upto")), 0)

    def _bucket(self, columns: list[str], buckets: int) -> Column:
        return F.pmod(F.xxhash64(*[F.col(c).cast("string") for c in columns]), F.lit(buckets)).cast("int")

    def _put(self, state: DataFrame, seq: int) -> None:
        state.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/state/seq={seq}")

    def state(self) -> tuple[int, DataFrame]:
        """(number, [bucket, version, upto]) of the last state; one row per bucket."""
        every = self.spark.read.parquet(f"{self.path}/state")
        last = every.agg(F.max("seq")).first()[0]
        return last, every.where(F.col("seq") == last).drop("seq")

    def write_changes(self, batch: DataFrame, batch_id: int, value: str, time: str) -> None:
        """The last change per key of a micro-batch; a repeated batch writes the same files again."""
        changes = latest_changes(batch, list(self.locator), value, time)
        changes.write.mode("overwrite").parquet(f"{self.path}/log/batch={batch_id}")

    def _log(self) -> DataFrame | None:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/log")
        if not hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop):
            return None
        return self.spark.read.parquet(f"{self.path}/log")

    def _base(self, state: DataFrame) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/base").join(F.broadcast(state), ["bucket", "version"])      # one row per bucket

    def _merged(self, base: DataFrame, log: DataFrame) -> DataFrame:
        """Base rows [.., upto] with the log's last change of their key, where that is younger than theirs."""
        last = log.groupBy(*self.locator).agg(F.max_by("a1", F.struct("changed_at", "a1")).alias("_a1"), F.max("changed_at").alias("_at"), F.max("batch").alias("_batch"))
        last = last.withColumnsRenamed({k: f"_u_{k}" for k in self.locator})
        same = reduce(lambda a, b: a & b, [F.col(place) == F.col(f"_u_{k}") for k, place in self.locator.items()])
        newer = F.col("_at").isNotNull() & (F.col("_batch") > F.col("upto")) & (F.col("changed_at").isNull() | (F.col("_at") >= F.col("changed_at")))
        return base.join(last, same, "left").withColumns({
            self.column: F.when(newer, F.col("_a1")).otherwise(F.col(self.column)),
            "changed_at": F.when(newer, F.col("_at")).otherwise(F.col("changed_at"))}).select(*base.columns)

    def read(self) -> DataFrame:
        """The table as of the last micro-batch."""
        _, state = self.state()
        base, log = self._base(state), self._log()
        merged = base if log is None else self._merged(base, log)
        return merged.drop("bucket", "version", "upto")

    def compact(self) -> int:
        """Take the log into the buckets that it touches; returns how many were rewritten."""
        seq, state = self.state()
        log = self._log()
        if log is None:
            return 0
        buckets = state.count()
        young = log.withColumn("bucket", self._bucket(list(self.locator), buckets)).join(F.broadcast(state), "bucket").where("batch > upto")
        touched = young.groupBy("bucket").agg(F.max("batch").cast("long").alias("newest")).collect()          # at most one row per bucket
        if not touched:
            return 0
        numbers, newest = [r.bucket for r in touched], max(r.newest for r in touched)
        base = self._base(state.where(F.col("bucket").isin(numbers)))
        merged = self._merged(base, log.where(F.col("batch") <= newest)).drop("version", "upto")
        merged.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/base/version={seq + 1}")
        hit = F.col("bucket").isin(numbers)
        self._put(state.select("bucket", F.when(hit, seq + 1).otherwise(F.col("version")).alias("version"), F.when(hit, newest).otherwise(F.col("upto")).alias("upto")), seq + 1)
        return len(numbers)


def stream_updates(feed: DataFrame, table: FoldedTable, checkpoint: str, value: str, time: str) -> StreamingQuery:
    """Apply a feed of corrections to a folded table: each micro-batch appends its last change per key to the log."""
    def apply(batch: DataFrame, batch_id: int) -> None:
        table.write_changes(batch, batch_id, value, time)

    return (feed.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def windowed_conflicts(df: DataFrame, x: str, y: str, time: str, length: str, delay: str) -> DataFrame:
    """Per time window and X value: rows, least and greatest Y value, and whether two Y values occur.

    In a stream, a window's state ends once the watermark has passed it; rows later than ``delay`` are dropped.
    """
    return (df.withWatermark(time, delay).where(F.col(x).isNotNull()).groupBy(F.window(time, length).alias("w"), x)
            .agg(F.count(F.lit(1)).alias("rows"), F.min(y).alias("low"), F.max(y).alias("high"))
            .select(F.col("w.start").alias("start"), x, "rows", "low", "high", (F.col("low") != F.col("high")).alias("conflicting")))


def stream_fd_monitor(feed: DataFrame, x: str, y: str, time: str, path: str, checkpoint: str, length: str = "1 day", delay: str = "1 hour") -> StreamingQuery:
    """Running state of the open windows; each micro-batch writes the windows that it changed under ``path/batch=n``."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (windowed_conflicts(feed, x, y, time, length, delay).writeStream.outputMode("update").foreachBatch(write)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def monitored_windows(spark: SparkSession, path: str, x: str) -> DataFrame:
    """The last state written of every window: [start, x, rows, low, high, conflicting]."""
    written = spark.read.parquet(path)
    fields = ("rows", "low", "high", "conflicting")
    return written.groupBy("start", x).agg(F.max_by(F.struct(*fields), "batch").alias("s")).select("start", x, "s.*")


def monitored_groups(windows: DataFrame, x: str) -> DataFrame:
    """Windows put together per X value: [x, rows, conflicting]."""
    return windows.groupBy(x).agg(F.sum("rows").alias("rows"), (F.min("low") != F.max("high")).alias("conflicting"))
