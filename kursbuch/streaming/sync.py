"""Saved items as a stream: bursts settled by keyed timers, micro-batches merged into a last-writer-wins table."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.saves import last_writer_wins
from ..shipping import ship

#: Milliseconds without another change after which a save is sent, and a query is searched. Fixed values.
SETTLE_MS, TYPING_MS = 800, 380
SAVE = "user string, key string, at long, deleted boolean, data string"


class Settle(StatefulProcessor):
    """Keeps the latest row of each key and gives it when no other has come for a while.

    Every row starts the key's timer anew. State and timers are the stream's checkpoint, so a restart loses neither."""

    def __init__(self, wait_ms: int):
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long, deleted boolean, data string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        best = self.last.get() if self.last.exists() else None
        for pdf in rows:
            for row in zip(pdf["at"], pdf["deleted"], pdf["data"], strict=True):
                row = (int(row[0]), bool(row[1]), row[2])
                best = row if best is None or (row[0], row[1], row[2] or "") > (best[0], best[1], best[2] or "") else best
        self.last.update(tuple(best))
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait_ms)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.last.exists():
            at, deleted, data = self.last.get()
            self.last.clear()
            yield pd.DataFrame({"user": [key[0]], "key": [key[1]], "at": [at], "deleted": [deleted], "data": [data]})

    def close(self) -> None:
        pass


def settled(saves: DataFrame, wait_ms: int = SETTLE_MS) -> DataFrame:
    """A stream of saves (user, key, at, deleted, data) with one row for each burst of a key: its latest, once
    ``wait_ms`` have passed without another. Rows without a user, key or time are left out.

    Needs RocksDB as the session's state store (spark.sql.streaming.stateStore.providerClass)."""
    ship(saves.sparkSession)
    rows = saves.filter("user is not null and key is not null and at is not null").select("user", "key", "at", F.coalesce("deleted", F.lit(False)).alias("deleted"), "data")
    return rows.groupBy("user", "key").transformWithStateInPandas(Settle(wait_ms), SAVE, "append", "processingTime")


def _path(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _before(spark: SparkSession, folder: str, epoch: int, buckets: list[int] | None = None) -> DataFrame | None:
    """The newest version of each bucket (or of these) from before an epoch; None if there is no table yet."""
    path, fs = _path(spark, folder)
    if not fs.exists(path) or not any(s.getPath().getName().startswith("epoch=") for s in fs.listStatus(path)):
        return None
    rows = spark.read.schema(SAVE + ", epoch int, bucket int").option("basePath", folder).parquet(folder).filter(F.col("epoch") < epoch)
    if buckets is not None:
        rows = rows.filter(F.col("bucket").isin(buckets))
    newest = rows.groupBy("bucket").agg(F.max("epoch").alias("epoch"))
    return rows.join(F.broadcast(newest), ["bucket", "epoch"], "left_semi").select("user", "key", "at", "deleted", "data")


def sync(spark: SparkSession, source: DataFrame, folder: str, checkpoint: str, now_ms: int | None = None, ttl_ms: int | None = None, buckets: int = 64) -> None:
    """Merges a stream of saves (user, key, at, deleted, data) into folder until what is there now is through.

    The table lies in ``buckets`` by hash of user and key (a number that stays). A batch reads and writes only the buckets
    that its rows fall in, as a version beside the older ones, and reads only versions from before its own, so a
    batch that is repeated after a failure gives the same state. Late rows are harmless: their time decides. Rows older
    than the ttl are dropped, they could bring back what a purged tombstone deleted. ``vacuum`` removes old
    versions."""
    if now_ms is not None and ttl_ms is not None:
        source = source.filter(now_ms - F.col("at") < ttl_ms)

    def merge(batch: DataFrame, epoch: int) -> None:
        bucket = F.pmod(F.xxhash64("user", "key"), F.lit(buckets)).cast("int").alias("bucket")
        new = last_writer_wins(batch).persist()
        touched = [r["bucket"] for r in new.select(bucket).distinct().collect()]  # at most ``buckets`` numbers
        if touched:
            old = _before(spark, folder, epoch, touched)
            rows = new if old is None else last_writer_wins(old.unionByName(new))
            rows.select("*", bucket).write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/epoch={epoch}")
        new.unpersist()

    q = source.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def current(spark: SparkSession, folder: str, last_epoch: int) -> DataFrame:
    """The table after an epoch."""
    found = _before(spark, folder, last_epoch + 1)
    return spark.createDataFrame([], SAVE) if found is None else found


def vacuum(spark: SparkSession, folder: str, last_epoch: int) -> int:
    """Removes versions of buckets that a later one, up to an epoch, has replaced; how many. No batch up to that epoch may
    still be repeated."""
    path, fs = _path(spark, folder)
    seen, gone = set(), 0
    names = lambda p, what: {int(s.getPath().getName().removeprefix(what)): s.getPath() for s in fs.listStatus(p) if s.getPath().getName().startswith(what)}
    for epoch, versions in sorted(names(path, "epoch=").items(), reverse=True):
        for bucket, at in names(versions, "bucket=").items() if epoch <= last_epoch else ():
            if bucket in seen:
                fs.delete(at, True)
                gone += 1
            seen.add(bucket)
    return gone
