"""Streams: what a batch writes, late and repeated batches, and how much state stays."""
import os
import tempfile
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tabred.streaming import feeds


def size(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet"))


def test_folded_table_takes_late_and_repeated_batches(spark):
    root = tempfile.mkdtemp(prefix="feeds-", dir="/tmp")
    table = feeds.FoldedTable(spark, root, {"k": "key"}, "v", "long")
    rows = spark.range(30_000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 200).cast("int").alias("key"), F.lit("old").alias("v"))
    table.create(rows, 16)
    assert table.read().where("v = 'old'").count() == 30_000 and table.compact() == 0
    batches = [[(0, "b0", 5), (7, "b0", 5), (7, "early", 1)], [(0, "late", 3), (9, "b1", 6)], [(7, "b2", 8)], [(0, "b3", 5)]]
    want = {}
    for n, batch in enumerate(batches):
        df = spark.createDataFrame(batch, "k int, new string, at long")
        before = size(f"{root}/base")
        for _ in range(2):
            table.write_changes(df, n, "new", "at")
        assert size(f"{root}/base") == before and size(f"{root}/log/batch={n}") < before / 20
        for k, v, at in batch:
            want[k] = max(want.get(k, (0, "")), (at, v))
        if n == 1:
            assert table.compact() == len({r.b for r in df.sparkSession.createDataFrame([(0,), (7,), (9,)], "k int").select(table._bucket(["k"], 16).alias("b")).collect()})
            assert table.compact() == 0
        got = {r.key: r.v for r in table.read().groupBy("key").agg(F.max("v").alias("v"), F.count_distinct("v").alias("n")).collect() if r.n == 1}
        assert len(got) == 200 and got == {k: want[k][1] if k in want else "old" for k in got}
    rewritten = table.compact()
    assert 1 <= rewritten <= 2 and table.read().count() == 30_000
    assert {r.key: r.v for r in table.read().select("key", "v").distinct().collect()} == {k: want[k][1] if k in want else "old" for k in range(200) if k in got}


def test_monitor_state_ends(spark):
    root = tempfile.mkdtemp(prefix="feeds-", dir="/tmp")
    start = datetime(2024, 1, 1)
    for day in range(8):
        rows = [(u, "a" if u % 2 or h < 20 else "b", start + timedelta(days=day, hours=h)) for u in range(20) for h in range(24)]
        if day == 6:
            rows += [(3, "late", start + timedelta(hours=1))]          # six days late: its window is closed
        spark.createDataFrame(rows, "u int, y string, ts timestamp").coalesce(1).write.mode("append").parquet(f"{root}/in")
    feed = spark.readStream.schema("u int, y string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    q = feeds.stream_fd_monitor(feed, "u", "y", "ts", f"{root}/out", f"{root}/check")
    q.awaitTermination()
    assert q.exception() is None
    held = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert len(held) >= 8 and max(held) <= 3 * 20
    windows = feeds.monitored_windows(spark, f"{root}/out", "u")
    assert windows.count() == 8 * 20 and windows.where("rows <> 24").count() == 0
    groups = {r.u: (r.rows, r.conflicting) for r in feeds.monitored_groups(windows, "u").collect()}
    assert groups == {u: (8 * 24, u % 2 == 0) for u in range(20)}
