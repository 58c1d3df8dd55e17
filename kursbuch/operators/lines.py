"""Operators along a trip: codecs, checks, gaps, distances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.geo import haversine

MOD = 65536


def by_trip() -> WindowSpec:
    return Window.partitionBy("trip").orderBy("seq")


def so_far() -> WindowSpec:
    return by_trip().rowsBetween(Window.unboundedPreceding, 0)


def edges(halts: DataFrame) -> DataFrame:
    """a, b, trips: pairs of neighbouring stations, either way, by how often they are run."""
    pairs = halts.select("station", F.lead("station").over(by_trip()).alias("then")).filter("then is not null and then <> station")
    return pairs.groupBy(F.least("station", "then").alias("a"), F.greatest("station", "then").alias("b")).agg(F.count("*").alias("trips"))


def station_counts(halts: DataFrame) -> DataFrame:
    """station, halts (rows), trips (distinct): they differ where a trip calls twice."""
    per_trip = halts.groupBy("station", "trip").agg(F.count("*").alias("n"))
    return per_trip.groupBy("station").agg(F.sum("n").alias("halts"), F.count("*").alias("trips"))


def delta_encode(halts: DataFrame) -> DataFrame:
    """trip, seq, d_arr, d_dep, d_km: differences to the value before, modulo 2^16."""
    m = lambda x: F.pmod(x, F.lit(MOD))
    before = F.lag("dep").over(by_trip())
    return halts.select(
        "trip",
        "seq",
        m(F.coalesce(F.col("arr") - before, F.lit(0))).alias("d_arr"),
        m(F.coalesce(F.col("dep") - F.col("arr"), F.when(F.col("arr").isNull(), F.col("dep")), F.lit(0))).alias("d_dep"),
        m(F.col("km") - F.coalesce(F.lag("km").over(by_trip()), F.lit(0))).alias("d_km"),
    )


def delta_decode(coded: DataFrame) -> DataFrame:
    """arr, dep and km again, by running sums; the first halt has no arrival, the last no departure."""
    m = lambda x: F.pmod(x, F.lit(MOD))
    last = F.max("seq").over(Window.partitionBy("trip"))
    total = F.sum(F.col("d_arr") + F.col("d_dep")).over(so_far())
    return coded.select(
        "trip",
        "seq",
        F.when(F.col("seq") > 0, m(total - F.col("d_dep"))).alias("arr"),
        F.when(F.col("seq") < last, m(total)).alias("dep"),
        m(F.sum("d_km").over(so_far())).alias("km"),
    )


def roll_forward(halts: DataFrame) -> DataFrame:
    """trip, seq, arr, dep from clock times alone: a time below the one before begins a new day."""
    at = Window.partitionBy("trip").orderBy("seq", "which")
    long = halts.select("trip", "seq", F.explode(F.array(F.struct(F.lit(0).alias("which"), (F.col("arr") % 1440).alias("v")), F.struct(F.lit(1).alias("which"), (F.col("dep") % 1440).alias("v")))).alias("e"))
    long = long.select("trip", "seq", "e.which", "e.v").filter("v is not null")
    turn = F.when(F.col("v") < F.lag("v").over(at), 1).otherwise(0)
    long = long.withColumn("turn", turn).withColumn("m", F.col("v") + 1440 * F.sum("turn").over(at.rowsBetween(Window.unboundedPreceding, 0)))
    return long.groupBy("trip", "seq").agg(F.max(F.when(F.col("which") == 0, F.col("m"))).alias("arr"), F.max(F.when(F.col("which") == 1, F.col("m"))).alias("dep"))


def validate(halts: DataFrame) -> DataFrame:
    """reason, halts: what breaks the rules of a trip; no row where all is well."""
    first, last = F.col("seq") == 0, F.col("seq") == F.max("seq").over(Window.partitionBy("trip"))
    before = F.last(F.coalesce("dep", "arr"), True).over(by_trip().rowsBetween(Window.unboundedPreceding, -1))
    reason = (
        F.when(first & (F.col("arr").isNotNull() | F.col("dep").isNull()), "first halt must only depart")
        .when(last & (F.col("dep").isNotNull() | F.col("arr").isNull()), "last halt must only arrive")
        .when(F.coalesce("arr", "dep") < before, "time goes back")
        .when(F.col("dep") < F.col("arr"), "leaves before it arrives")
        .when(F.col("km") < F.lag("km").over(by_trip()), "distance goes back")
    )
    return halts.withColumn("reason", reason).filter("reason is not null").groupBy("reason").agg(F.count("*").alias("halts"))


def gaps(halts: DataFrame) -> DataFrame:
    """trip, seq, minutes, km, day_change to the next halt."""
    nxt = lambda c: F.lead(c).over(by_trip())
    return halts.select(
        "trip", "seq", (nxt("arr") - F.col("dep")).alias("minutes"), (nxt("km") - F.col("km")).alias("gap_km"),
        (F.floor(nxt("arr") / 1440) > F.floor(F.col("dep") / 1440)).alias("day_change"),
    ).filter("minutes is not null")


def line_distance(halts: DataFrame, stations: DataFrame) -> DataFrame:
    """trip, halts, straight_km: the sum of the hops' great-circle distances."""
    at = halts.join(stations.select("station", "lat", "lon"), "station")
    prev = lambda c: F.lag(c).over(by_trip())
    hop = haversine(prev("lat"), prev("lon"), F.col("lat"), F.col("lon"))
    return at.withColumn("hop", hop).groupBy("trip").agg(F.count("*").alias("halts"), F.sum("hop").alias("straight_km"))


def zigzag(halts: DataFrame, stations: DataFrame, share: float = 0.5) -> DataFrame:
    """station, seen, flagged: stations that most often make the line turn back between neighbours."""
    at = halts.join(stations.select("station", "lat", "lon"), "station")
    p, n = (lambda c: F.lag(c).over(by_trip())), (lambda c: F.lead(c).over(by_trip()))
    ab = haversine(p("lat"), p("lon"), F.col("lat"), F.col("lon"))
    bc = haversine(F.col("lat"), F.col("lon"), n("lat"), n("lon"))
    ac = haversine(p("lat"), p("lon"), n("lat"), n("lon"))
    rows = at.select("station", ab.alias("ab"), bc.alias("bc"), ac.alias("ac")).filter("ab is not null and bc is not null")
    flag = F.when(F.col("ab") + F.col("bc") > 2.5 * F.col("ac") + 40, 1).otherwise(0)
    out = rows.groupBy("station").agg(F.count("*").alias("seen"), F.sum(flag).alias("flagged"))
    return out.filter(F.col("flagged") / F.col("seen") > share)


def islands(halts: DataFrame, inside: Column) -> DataFrame:
    """trip, first, last, n: maximal runs of halts for which ``inside`` holds."""
    rows = halts.withColumn("inside", inside).withColumn("g", F.sum(F.when(inside, 0).otherwise(1)).over(so_far()))
    return rows.filter("inside").groupBy("trip", "g").agg(F.min("seq").alias("first"), F.max("seq").alias("last"), F.count("*").alias("n")).drop("g")


def minute_at(halts: DataFrame, km: int) -> DataFrame:
    """trip, minute: when a trip is at this distance, linear between the halts around it."""
    nxt = lambda c: F.lead(c).over(by_trip())
    rows = halts.select("trip", "km", "dep", nxt("km").alias("km2"), nxt("arr").alias("arr2"))
    rows = rows.filter((F.col("km") <= km) & (F.col("km2") > km))
    return rows.select("trip", (F.col("dep") + (F.col("arr2") - F.col("dep")) * ((km - F.col("km")) / (F.col("km2") - F.col("km")))).alias("minute"))


def records(halts: DataFrame) -> DataFrame:
    """trip, halts, km, minutes of whole trips that have both."""
    first, last = F.min(F.struct("seq", "dep", "km")), F.max(F.struct("seq", "arr", "km"))
    t = halts.groupBy("trip").agg(first.alias("a"), last.alias("b"), F.count("*").alias("halts"))
    t = t.select("trip", "halts", (F.col("b.km") - F.col("a.km")).alias("km"), (F.col("b.arr") - F.col("a.dep")).alias("minutes"))
    return t.filter("km > 0 and minutes > 0")
