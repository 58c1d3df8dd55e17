"""Which region a point is in, and how far it is from a region's edge, by a grid of the polygons' edges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Km to the source's region within which a point keeps it, and to any region for one in none;
#: pairs of regions that were divided since.
BORDER_KM, COAST_KM = 1.2, 3.0
SPLIT = (("Andhra Pradesh", "Telangana"), ("Jammu and Kashmir", "Ladakh"))
DEGREE_KM = 111.32


def _cell(c: Column, size: float) -> Column:
    return F.floor(c / size).cast("long")


def _cells(a: str, b: str, size: float) -> Column:
    return F.explode(F.sequence(_cell(F.least(a, b), size), _cell(F.greatest(a, b), size)))


def edges(rings: DataFrame) -> DataFrame:
    """shape, name, x0, y0, x1, y1 of rings (shape, name, ring, pos, x, y): each point with the one before, the first
    with the last."""
    ring = Window.partitionBy("shape", "ring").orderBy("pos")
    last = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = lambda c: F.coalesce(F.lag(c).over(ring), F.last(c).over(last))
    rows = rings.select("shape", "name", before("x").alias("x0"), before("y").alias("y0"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    return rows.filter("x0 != x1 or y0 != y1")


def containing(points: DataFrame, drawn: DataFrame, coarse: float = 1.0, band: float = 0.05) -> DataFrame:
    """point, shape, name of all shapes whose edges hold the point (lat, lon), by the even-odd rule.

    Edges are repeated by what they touch, so how many rows they give is not known before: they are never sent to all
    tasks. A point meets the shapes whose boxes touch its cell, and of each only the edges that stand in its band of
    latitude: equal keys, no test of all pairs; crossings are added up by point and shape."""
    box = drawn.groupBy("shape").agg(F.min(F.least("x0", "x1")).alias("w"), F.max(F.greatest("x0", "x1")).alias("e"), F.min(F.least("y0", "y1")).alias("s"), F.max(F.greatest("y0", "y1")).alias("n"))
    box = box.withColumn("cx", _cells("w", "e", coarse)).withColumn("cy", _cells("s", "n", coarse))
    at = points.filter("lat is not null and lon is not null").select("point", F.col("lon").alias("x"), F.col("lat").alias("y"))
    at = at.withColumn("cx", _cell(F.col("x"), coarse)).withColumn("cy", _cell(F.col("y"), coarse))
    maybe = at.join(box.hint("merge"), ["cx", "cy"]).filter("x between w and e and y between s and n").select("point", "shape", "x", "y", _cell(F.col("y"), band).alias("band"))
    # a level edge is never crossed
    bands = drawn.filter("y0 != y1").withColumn("band", _cells("y0", "y1", band))
    met = maybe.join(bands.hint("merge"), ["shape", "band"])
    crossed = ((F.col("y0") > F.col("y")) != (F.col("y1") > F.col("y"))) & (F.col("x") < (F.col("x1") - F.col("x0")) * (F.col("y") - F.col("y0")) / (F.col("y1") - F.col("y0")) + F.col("x0"))
    return met.filter(crossed).groupBy("point", "shape", "name").agg(F.count("*").alias("n")).filter("n % 2 = 1").drop("n")


def edge_km(points: DataFrame, drawn: DataFrame, km: float = COAST_KM, max_lat: float = 60.0) -> DataFrame:
    """point, name, km: each region with an edge within km of the point, and the distance, in a flat frame around
    the point. Edges stand in the cells that they cross, points look into nine, which cover km up to max_lat."""
    tall = km / DEGREE_KM
    wide = tall / F.cos(F.radians(F.lit(max_lat)))
    size = lambda axis: tall if axis == "y" else wide
    rows = drawn.select("name", "x0", "y0", "x1", "y1").distinct().withColumn("cy", _cells("y0", "y1", size("y")))
    # where the edge enters and leaves the row of cells; a little more, as the quotient is rounded
    within = lambda y: F.least(F.greatest(y * size("y"), F.least("y0", "y1")), F.greatest("y0", "y1"))
    cross = lambda y, level: F.when(F.col("y0") == F.col("y1"), F.col(level)).otherwise(F.col("x0") + (F.col("x1") - F.col("x0")) * ((within(y) - F.col("y0")) / F.nullif(F.col("y1") - F.col("y0"), F.lit(0.0))))
    rows = rows.withColumn("u", cross(F.col("cy"), "x0")).withColumn("v", cross(F.col("cy") + 1, "x1"))
    rows = rows.withColumn("w", F.least("u", "v") - size("x") * 1e-6).withColumn("e", F.greatest("u", "v") + size("x") * 1e-6)
    boxes = rows.withColumn("cx", _cells("w", "e", size("x"))).drop("u", "v", "w", "e")
    around = F.array(*[F.lit(i).cast("long") for i in (-1, 0, 1)])
    at = points.filter("lat is not null and lon is not null").select("point", F.col("lon").alias("x"), F.col("lat").alias("y"))
    at = at.withColumn("i", F.explode(around)).withColumn("j", F.explode(around))
    at = at.select("point", "x", "y", (_cell(F.col("x"), size("x")) + F.col("i")).alias("cx"), (_cell(F.col("y"), size("y")) + F.col("j")).alias("cy"))
    k = DEGREE_KM * F.cos(F.radians("y"))
    rows = at.join(boxes.hint("merge"), ["cx", "cy"])
    rows = rows.select("point", "name", ((F.col("x0") - F.col("x")) * k).alias("ax"), ((F.col("y0") - F.col("y")) * DEGREE_KM).alias("ay"), ((F.col("x1") - F.col("x0")) * k).alias("dx"), ((F.col("y1") - F.col("y0")) * DEGREE_KM).alias("dy"))
    t = -(F.col("ax") * F.col("dx") + F.col("ay") * F.col("dy")) / (F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))
    rows = rows.withColumn("t", F.least(F.lit(1.0), F.greatest(F.lit(0.0), t)))
    far = F.hypot(F.col("ax") + F.col("t") * F.col("dx"), F.col("ay") + F.col("t") * F.col("dy"))
    return rows.withColumn("km", far).filter(F.col("km") <= km).groupBy("point", "name").agg(F.min("km").alias("km"))


def settle(points: DataFrame, rings: DataFrame, border: float = BORDER_KM, coast: float = COAST_KM, split: Sequence[tuple[str, str]] = SPLIT) -> DataFrame:
    """point, state, why of points (point, lat, lon, current), from rings (shape, name, ring, pos, x, y).

    A point in a region is of that region (the shape of the lowest number), why is empty; but it keeps another
    current one whose edge is within ``border`` km ("border"), unless the two were divided since. One in no region takes
    the nearest within ``coast`` km ("coast"), the first name of equals, or keeps the current one ("outside"), as do
    points without a position. Ids are those of rows: a repeated point is settled as one. Points of one position are
    looked for on the map once."""
    drawn = edges(rings).checkpoint()
    placed = points.filter("lat is not null and lon is not null").select("point", "lat", "lon")
    spots = placed.select("lat", "lon").distinct().withColumn("point", F.monotonically_increasing_id()).checkpoint()
    on = placed.join(spots.withColumnRenamed("point", "spot"), ["lat", "lon"]).select("point", "spot").distinct()
    first = F.min(F.struct("shape", "name")).alias("first")
    held = containing(spots, drawn).groupBy("point").agg(first).withColumnRenamed("point", "spot")
    within = on.join(held, "spot").groupBy("point").agg(F.min("first")["name"].alias("here"))
    close = edge_km(spots, drawn, max(border, coast)).withColumnRenamed("point", "spot")
    by_name = on.join(close, "spot").groupBy("point", "name").agg(F.min("km").alias("km"))
    own = points.select("point", F.col("current").alias("name")).distinct()
    kept = by_name.join(own, ["point", "name"], "left_semi").filter(F.col("km") <= border).select("point", F.col("name").alias("mine"))
    closest = by_name.filter(F.col("km") <= coast).groupBy("point").agg(F.min(F.struct("km", "name"))["name"].alias("closest"))
    rows = points.join(within, "point", "left").join(kept, "point", "left").join(closest, "point", "left")
    divided = F.lit(False)
    for old, new in split:
        divided = divided | ((F.col("current") == old) & (F.col("here") == new))
    stays = (F.col("mine") != F.col("here")) & ~divided
    case = F.when(F.col("here").isNotNull() & F.coalesce(stays, F.lit(False)), F.struct(F.col("mine").alias("state"), F.lit("border").alias("why")))
    case = case.when(F.col("here").isNotNull(), F.struct(F.col("here").alias("state"), F.lit("").alias("why")))
    case = case.when(F.col("closest").isNotNull(), F.struct(F.col("closest").alias("state"), F.lit("coast").alias("why")))
    case = case.otherwise(F.struct(F.col("current").alias("state"), F.lit("outside").alias("why")))
    return rows.select("point", case.alias("s")).select("point", "s.state", "s.why")
