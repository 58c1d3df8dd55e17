"""Bringing an older timetable to a newer one's numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def moves(asked: DataFrame, candidates: DataFrame, present: DataFrame) -> DataFrame:
    """old, new, status of every asked trip (trip), by its candidates (old, new; at most one an old trip counts, the least).

    A candidate whose number is among ``present`` (trip), or that a lower old trip takes before, makes the old one a
    "duplicate"; another makes it "renumbered"; without a candidate it is "unlisted" and new is null. Null trips are left
    out, repeated ones asked once. The trip that takes a number is the first of its candidates by number: the least is
    found by groups that combine before the shuffle, so many candidates of one new number meet in no window."""
    old = asked.filter("trip is not null").select(F.col("trip").alias("old")).distinct()
    one = candidates.filter("new is not null").groupBy("old").agg(F.min("new").alias("new"))
    rows = old.join(one, "old", "left")
    first = rows.filter("new is not null").groupBy("new").agg(F.min("old").alias("first"))
    there = present.filter("trip is not null").select(F.col("trip").alias("new"), F.lit(True).alias("there")).distinct()
    rows = rows.join(first, "new", "left").join(there, "new", "left")
    status = F.when(F.col("new").isNull(), "unlisted").when(F.coalesce("there", F.lit(False)) | (F.col("first") != F.col("old")), "duplicate").otherwise("renumbered")
    return rows.select("old", "new", status.alias("status"))


def propagate(rows: DataFrame, moved: DataFrame, key: str = "trip") -> DataFrame:
    """rows with the key of every renumbered trip (old, new, status) as its new one; all others as they are."""
    step = moved.filter("status = 'renumbered'").select(F.col("old").alias("_old"), F.col("new").alias("_new"))
    out = rows.join(step, rows[key] == step["_old"], "left")
    return out.select(*[F.coalesce("_new", rows[c]).alias(c) if c == key else rows[c] for c in rows.columns])


def still_newer(newer: DataFrame, trips: DataFrame, key: str = "trip") -> DataFrame:
    """newer (numbers: one or several, parted by "/") without the rows of which any number is a trip.

    Numbers are compared as text. Rows with null or empty numbers stay."""
    each = newer.select("numbers").distinct().select("numbers", F.explode(F.split("numbers", "/")).alias("one"))
    known = trips.select(F.col(key).cast("string").alias("one"))
    return newer.join(each.join(known, "one", "left_semi").select("numbers"), "numbers", "left_anti").select(*newer.columns)


def collapse(halts: DataFrame, trip: str = "trip", seq: str = "seq", station: str = "station") -> DataFrame:
    """halts without those whose station is that of the halt before: the first of a run stays. A null station equals
    only another null."""
    before = Window.partitionBy(trip).orderBy(seq)
    rows = halts.withColumn("_n", F.row_number().over(before)).withColumn("_before", F.lag(station).over(before))
    return rows.filter((F.col("_n") == 1) | ~F.col(station).eqNullSafe(F.col("_before"))).select(*halts.columns)
