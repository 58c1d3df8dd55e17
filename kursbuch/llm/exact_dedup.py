"""Exact deduplication: a tree merge of sorted digest runs, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, fresh, shuffle_partitions, stage

#: Runs that one step of the tree merges.
RADIX = 8


def normalised(text: Column) -> Column:
    """The text with each run of ASCII white space as one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), SPACE, " ")


def _slot(place: Column, digit: Column, width: int) -> Column:
    """place with its digits below ``width`` taken from digit."""
    return (F.floor(place / F.lit(width)) * width + F.pmod(digit, F.lit(width))).cast("long")


def digest_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radix: int = RADIX) -> DataFrame:
    """One row for each document: id, keep_id, group_size, kept, text_sha256.

    Documents are equal when their texts are identical after white-space runs became one
    space. Of equal ones the row with the smallest id stays (ids that are null come last,
    and of rows that repeat the same id and text exactly one stays).

    Every input partition is a run. The digests are sorted and merged within a run first, so
    copies inside it become one entry. Then, in rounds, ``radix`` neighbouring runs exchange
    parts: each takes over the entries whose digest has the digit that belongs to it, and
    merges what it received, keeping the smallest identifier and the count. After the
    last round a run's place is given by the digest alone. No round has more entries than
    the one before, and none gathers all of them in one place.

    An entry is verified by more than its SHA-256: an independent 64-bit hash and the byte
    length are part of what must agree at every level.
    """
    spark = docs.sparkSession
    rounds = 1
    while radix**rounds < shuffle_partitions(spark):
        rounds += 1
    runs = radix**rounds
    text = normalised(F.col(text_col))
    leaves = stage(
        docs.select(F.col(id_col).alias("id"), text.alias("t")).select(
            "id",
            F.unhex(F.sha2("t", 256)).alias("digest"),
            F.xxhash64("t").alias("check"),
            F.octet_length("t").alias("bytes"),
            F.pmod(F.spark_partition_id(), F.lit(runs)).cast("long").alias("run"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "digests",
    )
    key = ["digest", "check", "bytes"]
    best = F.struct(F.col("id").isNull().alias("no_id"), F.col("id"), F.col("row"))
    level = leaves.groupBy(F.col("run").alias("slot"), *key).agg(F.min(best).alias("best"), F.count("*").alias("n"))
    first = level.select("slot", *key)
    place = F.pmod(F.xxhash64("digest"), F.lit(runs))
    for r in range(1, rounds + 1):
        level = (
            level.withColumn("slot", _slot(F.col("slot"), place, radix**r))
            .groupBy("slot", *key)
            .agg(F.min("best").alias("best"), F.sum("n").alias("n"))
        )
    # Back down: the merged entry goes to each run that holds the digest, and there to its
    # rows. A digest with a third of all rows is thereby read by as many tasks as it has runs.
    down = first.join(level.drop("slot"), key).withColumnRenamed("slot", "run")
    return leaves.join(down, ["run", *key]).select(
        F.col("id").alias(id_col),
        F.col("best.id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("row") == F.col("best.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that repeat an earlier text; all columns stay.

    The rows that go are found by digest_groups. A row that has the same id as the one that
    stays (a repeated row) is told from it by a second step, run only if such rows exist.
    """
    groups = stage(digest_groups(docs, id_col, text_col), "groups")
    key, sha = fresh(docs, "_key"), fresh(docs, "_text_sha")
    gone = groups.filter(~F.col("kept")).select(F.col(id_col).alias(key))
    repeated = groups.groupBy(id_col).count().filter("count > 1").limit(1).count() > 0
    if not repeated:
        return docs.join(gone, docs[id_col].eqNullSafe(F.col(key)), "left_anti")
    keyed = docs.withColumn(sha, F.sha2(normalised(F.col(text_col)), 256))
    stays = groups.filter("kept").select(F.col(id_col).alias(key), F.col("text_sha256").alias(sha + "_")).distinct()
    on = keyed[id_col].eqNullSafe(F.col(key)) & (F.col(sha) == F.col(sha + "_"))
    return keyed.join(stays, on, "left_semi").dropDuplicates([id_col, sha]).drop(sha)


__all__ = ["digest_groups", "drop_copies", "normalised"]
