"""Distance to a line that is drawn as many short segments: the coast."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def segments(line: DataFrame) -> DataFrame:
    """x0, y0, x1, y1 of neighbouring points of each line (line, pos, lat, lon)."""
    order = Window.partitionBy("line").orderBy("pos")
    rows = line.select(F.lag("lon").over(order).alias("x0"), F.lag("lat").over(order).alias("y0"), F.col("lon").alias("x1"), F.col("lat").alias("y1"))
    return rows.filter("x0 is not null and y0 is not null and x1 is not null and y1 is not null")


def coast_km(points: DataFrame, coast: DataFrame, cell: float = 0.5) -> DataFrame:
    """point, km: how far each point (point, lat, lon) is from the nearest of the segments (x0, y0, x1, y1); infinite
    where none touches the point's cell or one of the eight around, and null for a point without a position.

    Segments stand in all cells of their box, points look into nine: a join on equal cells. The distance is to the
    nearest place on a segment, in a flat frame around the point of 111 km a degree. The least distance of a
    point is taken before the shuffle where that is possible."""
    at = lambda c: F.floor(c / cell).cast("long")
    span = lambda a, b: F.sequence(at(F.least(a, b)), at(F.greatest(a, b)))
    boxes = coast.withColumn("cx", F.explode(span(F.col("x0"), F.col("x1")))).withColumn("cy", F.explode(span(F.col("y0"), F.col("y1"))))
    around = F.array(*[F.lit(i).cast("long") for i in (-1, 0, 1)])
    looks = points.filter("lat is not null and lon is not null").select("point", "lat", "lon").withColumn("i", F.explode(around)).withColumn("j", F.explode(around))
    looks = looks.select("point", "lat", "lon", (at(F.col("lon")) + F.col("i")).alias("cx"), (at(F.col("lat")) + F.col("j")).alias("cy"))
    wide = 111 * F.cos(F.radians("lat"))
    rows = looks.join(boxes, ["cx", "cy"])
    rows = rows.withColumns({"ax": (F.col("x0") - F.col("lon")) * wide, "ay": (F.col("y0") - F.col("lat")) * 111, "vx": (F.col("x1") - F.col("x0")) * wide, "vy": (F.col("y1") - F.col("y0")) * 111})
    along = F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy")
    t = F.when(along == 0, 0.0).otherwise(-(F.col("ax") * F.col("vx") + F.col("ay") * F.col("vy")) / F.when(along != 0, along))
    rows = rows.withColumn("t", F.least(F.lit(1.0), F.greatest(F.lit(0.0), t)))
    km = F.hypot(F.col("ax") + F.col("t") * F.col("vx"), F.col("ay") + F.col("t") * F.col("vy"))
    best = rows.groupBy("point").agg(F.min(km).alias("km"))
    out = points.join(best, "point", "left")
    return out.select("point", F.when(F.col("lat").isNotNull() & F.col("lon").isNotNull(), F.coalesce("km", F.lit(float("inf")))).alias("km"))
