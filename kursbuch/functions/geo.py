"""Distances, roads and the grid join."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def is_hilly(lat: Column, lon: Column) -> Column:
    """Regions of slower roads. Fixed values."""
    himalaya = (lat > 29.8) & (lon < 81.5)
    north_east = (lat > 26.4) & (lon > 88)
    southern_ghats = (lat > 9) & (lat < 13) & (lon > 75.4) & (lon < 77.8)
    return himalaya | north_east | southern_ghats


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def road_km(straight: Column, hills: Column) -> Column:
    """An estimate: roads wind, more so in the hills."""
    return half_up(straight * F.when(hills, 1.45).otherwise(1.3) + 2)


def road_minutes(straight: Column, hills: Column) -> Column:
    """Driving minutes of a straight distance in steps of five, and ten to get going."""
    return half_up(road_km(straight, hills) / F.when(hills, 32.0).otherwise(45.0) * 60 / 5) * 5 + 10


def real_road_minutes(km: Column, minutes: Column, hills: Column) -> Column:
    """A routed road: a third more than the router says, and never above a believable speed."""
    slow = F.greatest(minutes * 1.3, km / F.when(hills, 34.0).otherwise(50.0) * 60)
    return half_up(slow / 5) * 5 + 10


def near(left: DataFrame, right: DataFrame, km: float, keep_left: list[str], keep_right: list[str], max_lat: float = 60.0) -> DataFrame:
    """Pairs within km of each other, with their distance.

    Both sides have lat and lon. Cells are as wide as km in latitude, and in longitude as km is
    at max_lat; the left side goes to its own row of cells and the two beside it, and in each to as many
    columns as km spans at its latitude: three up to max_lat, more towards the poles, and around the
    180th meridian. So the join is on equal cells and never compares points that are far apart."""
    dlat = km / 111.0
    columns = max(1, math.floor(360 / (km / (111.0 * math.cos(math.radians(max_lat))))))
    width = 360 / columns
    row = lambda c: F.floor(c / dlat).cast("long")
    column = lambda c: F.pmod(F.floor((c + 180) / width).cast("long"), F.lit(columns))
    furthest = F.least(F.abs(F.col("a_lat")) + dlat, F.lit(89.99))
    span = F.ceil(km / (111.0 * F.cos(F.radians(furthest))) / width).cast("long")
    some = F.transform(F.sequence(-F.col("span"), F.col("span")), lambda j: F.pmod(F.col("at") + j, F.lit(columns)))
    every = F.sequence(F.lit(0).cast("long"), F.lit(columns - 1).cast("long"))
    a = left.select(*keep_left, F.col("lat").alias("a_lat"), F.col("lon").alias("a_lon")).filter("a_lat is not null and a_lon is not null")
    a = a.withColumn("span", span).withColumn("at", column(F.col("a_lon"))).withColumn("i", F.explode(F.array(*[F.lit(i) for i in (-1, 0, 1)])))
    a = a.withColumn("cx", F.explode(F.when(2 * F.col("span") + 1 >= columns, every).otherwise(some))).withColumn("cy", row(F.col("a_lat")) + F.col("i"))
    b = right.select(*keep_right, F.col("lat").alias("b_lat"), F.col("lon").alias("b_lon"), row(F.col("lat")).alias("cy"), column(F.col("lon")).alias("cx"))
    d = haversine(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon"))
    return a.join(b, ["cy", "cx"]).withColumn("km", d).filter(F.col("km") <= km).select(*keep_left, *keep_right, "km")
