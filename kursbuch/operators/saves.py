"""Saved items: last writer wins, tombstones, expiry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TTL_MS = 90 * 24 * 3600 * 1000


def last_writer_wins(saves: DataFrame, keys: tuple[str, ...] = ("user", "key")) -> DataFrame:
    """One row for each key: the latest; at equal times a tombstone before a save, then the larger
    data. An aggregation with partial sums, so a key with very many writes is no hot task."""
    order = F.struct("at", "deleted", "data")
    return saves.groupBy(*keys).agg(F.max(order).alias("w")).select(*keys, "w.at", "w.deleted", "w.data")


def prune(saves: DataFrame, now_ms: int, ttl_ms: int = TTL_MS) -> DataFrame:
    """Without the tombstones that are as old as ttl or older."""
    return saves.filter(~F.col("deleted") | (now_ms - F.col("at") < ttl_ms))


def valid(saves: DataFrame) -> DataFrame:
    """Saves whose key is of their kind and whose data is JSON with a title."""
    ok = F.col("kind").isin("place", "route", "trip") & F.col("key").rlike("^[a-z]+:[a-z0-9-]+$")
    ok = ok & F.startswith(F.col("key"), F.concat("kind", F.lit(":"))) & F.get_json_object("data", "$.title").isNotNull()
    return saves.filter(F.coalesce(ok, F.lit(False)))
