"""The stream of saves: bursts, restarts, buckets that are touched."""

import os
import time

from pyspark.sql import functions as F

from kursbuch.streaming import sync


def put(spark, folder, name, rows):
    spark.createDataFrame(rows, sync.SAVE).coalesce(1).write.parquet(f"{folder}/{name}")


def test_only_touched_buckets_are_written(spark, tmp_path):
    at = {n: str(tmp_path / n) for n in ("in", "out", "ck")}
    everything = [("u", f"k{i}", 10, False, "x") for i in range(40)]
    put(spark, at["in"], "1", everything)
    source = lambda: spark.readStream.schema(sync.SAVE).option("maxFilesPerTrigger", 1).parquet(at["in"] + "/*")
    sync.sync(spark, source(), at["out"], at["ck"], buckets=8)
    put(spark, at["in"], "2", [("u", "k3", 11, True, None), ("u", "k4", 9, False, "late")])
    sync.sync(spark, source(), at["out"], at["ck"], buckets=8)
    epochs = {d: {b for b in os.listdir(f"{at['out']}/{d}") if b.startswith("bucket=")} for d in os.listdir(at["out"]) if d.startswith("epoch=")}
    assert len(epochs["epoch=0"]) > 4 and 1 <= len(epochs["epoch=1"]) <= 2
    want = {(k, a, d) for _, k, a, d, _ in everything} - {("k3", 10, False)} | {("k3", 11, True)}
    state = lambda e: {(r["key"], r["at"], r["deleted"]) for r in sync.current(spark, at["out"], e).collect()}
    assert state(1) == want and len(state(0)) == 40 and ("k3", 10, False) in state(0)
    assert sync.vacuum(spark, at["out"], 1) == len(epochs["epoch=1"]) and state(1) == want
    assert sync.current(spark, str(tmp_path / "nothing"), 5).count() == 0


def test_a_burst_gives_one_row_also_over_a_restart(spark, tmp_path):
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        folder, ck = str(tmp_path / "in"), str(tmp_path / "ck")
        put(spark, folder, "1", [("u", "a", t, False, f"v{t}") for t in range(1, 6)] + [("u", "b", 1, False, "only"), (None, "b", 9, False, "nobody")])

        def start(name, wait):
            rows = sync.settled(spark.readStream.schema(sync.SAVE).option("maxFilesPerTrigger", 1).parquet(folder + "/*"), wait)
            write = lambda b, _: b.withColumn("by", F.lit(name)).write.mode("append").parquet(str(tmp_path / "out"))
            return rows.writeStream.foreachBatch(write).option("checkpointLocation", ck).trigger(processingTime="200 milliseconds").start()

        def read():
            return sorted((r["key"], r["at"], r["data"], r["by"]) for r in spark.read.schema(sync.SAVE + ", by string").parquet(str(tmp_path / "out")).collect())

        q = start("first", 3_600_000)  # an hour: nothing is given before the stop
        # a query with timers is never idle, so what it has read tells when to stop
        until = time.time() + 60
        while time.time() < until and sum(p["numInputRows"] for p in q.recentProgress) < 7 and q.exception() is None:
            time.sleep(0.5)
        q.stop()
        assert q.exception() is None and read() == []
        put(spark, folder, "2", [("u", "a", 7, True, None), ("u", "a", 6, False, "v6")])
        q = start("second", 500)
        until = time.time() + 60
        while time.time() < until and not read() and q.exception() is None:
            time.sleep(0.5)
        q.stop()
        assert read() == [("a", 7, None, "second")]  # one row of both bursts; b's hour is not over
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
