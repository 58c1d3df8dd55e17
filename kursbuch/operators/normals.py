"""A year's weather at a place: its own climate chart, else the estimate of the cell it lies in."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.climate import verdict
from ..functions.travel import height_corrected

#: Days of the months, and the height and width of a cell in degrees.
DAYS = (31, 28.25, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)
CELL_LAT, CELL_LON = 0.5, 0.625
#: What a chart's months may be (least low, most low, least high, most high, most rain).
LIMITS = (-40, 40, -30, 50, 3000)
_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of the value, which is worked out once however often f names it: a column that is used in an array's function
    is worked out again at each place and for each element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def chart(text: Column) -> Column:
    """The twelve months of a text's first climate chart, an array of (low, high, rain); null without one, with
    other units, with a part that is neither a number nor a setting, fewer than 36 numbers or months that cannot be.

    Links stand for their words, empty parts for nothing, numbers beyond the 36th are ignored. A null text has none."""
    body = F.regexp_extract(text, r"(?is)\{\{\s*climate chart\s*\|(.*?)\}\}", 1)
    body = F.regexp_replace(body, r"\[\[(?:[^\]|]*\|)?([^\]]*)\]\]", "$1")
    return _let(body, lambda b: F.when(~b.rlike(r"(?i)\|\s*(imperial|units)\s*=\s*(yes|imperial|F)"), _let(_numbers(b), _likely_months)))


def _numbers(body: Column) -> Column:
    """A chart's parts as numbers, null for what is none; without settings and empty parts."""
    parts = _let(F.split(body, r"\|", -1), lambda p: F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))))
    parts = F.filter(parts, lambda p: ~p.contains("="))
    parts = F.transform(parts, lambda p: F.regexp_replace(F.regexp_replace(p, r"(?U)^\s+|\s+$|,", ""), "−", "-"))
    parts = F.filter(parts, lambda p: p != "")
    return F.transform(parts, lambda p: F.when(p.rlike(_NUMBER), p.try_cast("double")))


def _likely_months(numbers: Column) -> Column:
    sound = F.forall(numbers, lambda x: x.isNotNull()) & (F.size(numbers) >= 36)
    at = lambda i, k: F.get(numbers, 3 * i + k)
    months = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: F.struct(at(i, 0).alias("low"), at(i, 1).alias("high"), at(i, 2).alias("rain")))
    a, b, c, d, wet = LIMITS
    likely = lambda m: m["low"].between(a, b) & m["high"].between(c, d) & (m["low"] <= m["high"]) & m["rain"].between(0, wet)
    return F.when(sound, _let(months, lambda all_: F.when(F.forall(all_, likely), all_)))


def estimates(points: DataFrame, cells: DataFrame) -> DataFrame:
    """points (point, lat, lon, height) with ``estimate``: the months of the cell (lat, lon, elev, and low, high, rain as
    arrays by month, rain a day) that the point lies in, at the point's height, rain a month; null where no cell is.

    Temperatures fall with height where both heights are known. A join on the rounded cell; of repeated cells one
    counts, the least. Points are often many to a cell: the cells are the smaller side and may be broadcast by Spark."""
    row, column = (lambda c: F.bround(c / CELL_LAT).cast("long")), (lambda c: F.bround(c / CELL_LON).cast("long"))
    one = cells.groupBy(row(F.col("lat")).alias("cy"), column(F.col("lon")).alias("cx")).agg(F.min(F.struct("elev", "low", "high", "rain")).alias("c"))
    at = points.withColumn("cy", row(F.col("lat"))).withColumn("cx", column(F.col("lon"))).join(one, ["cy", "cx"], "left")
    warm = lambda name, i: height_corrected(F.get(F.col(f"c.{name}"), i), F.col("height"), F.col("c.elev"))
    days = F.array(*[F.lit(float(d)) for d in DAYS])
    months = F.transform(
        F.sequence(F.lit(0), F.lit(11)),
        lambda i: F.struct(warm("low", i).alias("low"), warm("high", i).alias("high"), (F.get(F.col("c.rain"), i) * F.get(days, i)).alias("rain")),
    )
    return at.withColumn("estimate", F.when(F.col("c").isNotNull(), months)).drop("cy", "cx", "c")


def normals(points: DataFrame, cells: DataFrame) -> DataFrame:
    """points (point, lat, lon, height, text) with months and source: "imd" of the text's chart, "est" of the cell, else
    null and empty."""
    rows = estimates(points, cells).withColumn("chart", chart(F.col("text")))
    source = F.when(F.col("chart").isNotNull(), "imd").when(F.col("estimate").isNotNull(), "est").otherwise("")
    return rows.withColumn("months", F.coalesce("chart", "estimate")).withColumn("source", source).drop("chart", "estimate")


def letters(months: Column) -> Column:
    """Twelve verdicts; empty without months."""
    return F.coalesce(F.array_join(F.transform(months, lambda m: verdict(m["low"], m["high"], m["rain"])), ""), F.lit(""))


def flat(months: Column) -> Column:
    """36 whole numbers, halves to even; null without months."""
    whole = lambda c: F.bround(c).cast("long")
    return F.flatten(F.transform(months, lambda m: F.array(whole(m["low"]), whole(m["high"]), whole(m["rain"]))))
