"""Month verdicts and circular runs of months."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def verdict(low: Column, high: Column, rain: Column) -> Column:
    """The letter of a month; the first rule that holds decides."""
    return (
        F.when((high < 10) | (low < -6), "C")
        .when(rain >= 300, "W")
        .when(high >= 39, "H")
        .when(rain >= 140, "R")
        .when(high >= 35, "M")
        .when(high.between(16, 32) & (rain < 70) & (low >= 4), "B")
        .otherwise("G")
    )


def month_runs(years: DataFrame, key: str, good: str = "BGR") -> DataFrame:
    """key, first, last: maximal runs of good months (0 to 11) on the circle of twelve.

    The year is laid out twice, islands are found on the 24 months, and of each the one that
    begins in the first year stays, without what is the tail of a run from before. A year that
    is good throughout is one run from 0 to 11."""
    twice = F.split(F.concat("letters", "letters"), "")
    rows = years.select(key, F.posexplode(twice).alias("m", "c")).filter((F.col("m") < 24) & (F.col("c") != ""))
    by = Window.partitionBy(key).orderBy("m")
    rows = rows.withColumn("good", F.col("c").isin(*good))
    rows = rows.withColumn("island", F.sum(F.when(~F.col("good"), 1).otherwise(0)).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    runs = rows.filter("good").groupBy(key, "island").agg(F.min("m").alias("a"), F.max("m").alias("b"))
    whole = F.col("b") - F.col("a") >= 23
    wraps = F.max(F.when(F.col("b") == 23, 1).otherwise(0)).over(Window.partitionBy(key)) == 1
    kept = runs.withColumn("wraps", wraps).filter(whole | ((F.col("a") < 12) & ~((F.col("a") == 0) & F.col("wraps"))))
    return kept.select(key, F.when(whole, 0).otherwise(F.col("a")).alias("first"), F.when(whole, 11).otherwise(F.col("b") % 12).alias("last"))


#: The names of the months, and what is said of a year's runs of each kind.
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
ALL_GOOD = "Good all year round: go whenever you like."
SAID = (("W", ": the monsoon pours."), ("H", ": too hot for most, carry water."), ("C", ": properly cold, pack the woollens."))


def spans(letters: Column, kinds: str) -> Column:
    """The runs of months of these kinds, as an array of (first, last) on the circle of twelve; a run that begins
    in January comes last. A year of nothing else is one run from 0 to 11; other lengths than twelve have none."""
    on = lambda i: F.substr(letters, i % 12 + 1, F.lit(1)).isin(*kinds)
    span = lambda a, b: F.struct(a.cast("int").alias("first"), b.cast("int").alias("last"))
    begins = F.filter(F.array(*[F.lit(i) for i in (*range(1, 12), 0)]), lambda i: on(i) & ~on(i + 11))
    more = F.sequence(F.lit(0), F.lit(10))
    found = F.transform(begins, lambda i: span(i, (i + F.array_min(F.filter(more, lambda k: ~on(i + k + 1)))) % 12))
    whole = F.forall(F.sequence(F.lit(0), F.lit(11)), on)
    return F.when(F.length(letters) != 12, F.filter(found, lambda x: F.lit(False))).when(whole, F.array(span(F.lit(0), F.lit(11)))).otherwise(found)


def span_words(span: Column) -> Column:
    names, a, b = F.array(*map(F.lit, MONTHS)), span["first"], span["last"]
    return F.when(b == (a + 11) % 12, "all year").when(a == b, names[a]).otherwise(F.concat(names[a], F.lit(" to "), names[b]))


def when_line(letters: Column) -> Column:
    """A line about when to go, of a year's letters."""
    said = lambda kinds: F.array_join(F.transform(spans(letters, kinds), span_words), " and ")
    best = said("BG")
    parts = [F.when(best == "all year", ALL_GOOD).when(best != "", F.concat(F.lit("Best from "), best, F.lit(".")))]
    parts += [F.when(said(k) != "", F.concat(said(k), F.lit(words))) for k, words in SAID]
    return F.concat_ws(" ", *parts)
