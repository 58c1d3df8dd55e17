"""Reachability: everywhere a place has direct trains to or from, and filters on the rides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import calendar as cal


def departures(placed: DataFrame, origin: int | Column) -> DataFrame:
    """trip, place, from_seq, to_seq, dep_abs, dep, dur, km, halts: rides out of a place.

    A trip is boarded at its first halt in the origin that it leaves from; each other place counts
    where the trip first reaches it. ``halts`` are those on the way that are not in the
    origin. One pass by trip: windows over the halts, no self-join."""
    here = F.col("place") == origin
    trip = Window.partitionBy("trip")
    ride = trip.orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    board = F.min(F.when(here & F.col("dep").isNotNull(), F.struct("seq", "dep", "km"))).over(trip)
    rows = placed.withColumn("b", board).filter(F.col("seq") > F.col("b.seq"))
    rows = rows.withColumn("halts", F.coalesce(F.sum(F.when(~here, 1).otherwise(0)).over(ride), F.lit(0)))
    rows = rows.filter(~here).withColumn("nth", F.row_number().over(Window.partitionBy("trip", "place").orderBy("seq"))).filter("nth = 1")
    return rows.select(
        "trip", "place", F.col("b.seq").alias("from_seq"), F.col("seq").alias("to_seq"), F.col("b.dep").alias("dep_abs"),
        cal.clock(F.col("b.dep")).alias("dep"), (F.col("arr") - F.col("b.dep")).alias("dur"), (F.col("km") - F.col("b.km")).alias("km"), "halts",
        F.col("station").alias("far_station"),
    )


def arrivals(placed: DataFrame, dest: int | Column) -> DataFrame:
    """The mirror: rides into a place. Each ends at the trip's first halt there that it reaches
    (not the trip's first halt) and begins where the trip first leaves the other place.
    ``halts`` are those on the way outside of the boarding place."""
    here = F.col("place") == dest
    trip = Window.partitionBy("trip")
    end = F.min(F.when(here & F.col("arr").isNotNull() & (F.col("seq") >= 1), F.struct("seq", "arr", "km"))).over(trip)
    rows = placed.withColumn("e", end).filter(F.col("seq") < F.col("e.seq"))
    same = Window.partitionBy("trip", "place").orderBy("seq")
    left = F.count("*").over(Window.partitionBy("trip", "place")) - F.row_number().over(same)
    rows = rows.withColumn("later_here", left).filter(~here & F.col("dep").isNotNull())
    rows = rows.withColumn("nth", F.row_number().over(same)).filter("nth = 1")
    return rows.select(
        "trip", "place", F.col("seq").alias("from_seq"), F.col("e.seq").alias("to_seq"), F.col("dep").alias("dep_abs"),
        cal.clock(F.col("dep")).alias("dep"), (F.col("e.arr") - F.col("dep")).alias("dur"), (F.col("e.km") - F.col("km")).alias("km"),
        (F.col("e.seq") - F.col("seq") - 1 - F.col("later_here")).alias("halts"), F.col("station").alias("far_station"),
    )


def destinations(legs: DataFrame) -> DataFrame:
    """place, legs, fastest, first_km (the least, whatever its name says)."""
    return legs.groupBy("place").agg(F.count("*").alias("legs"), F.min("dur").alias("fastest"), F.min("km").alias("first_km"))


def passing(legs: DataFrame, within: int, kind: str = "all", leave: str = "any", now: int = 0) -> DataFrame:
    """The legs that a filter lets through; legs carry days and type."""
    ok = F.col("dur") <= within
    if kind != "all":
        ok = ok & (cal.kind_of(F.col("type")) == kind)
    if leave in ("2h", "6h"):
        ok = ok & (cal.wait_for(F.col("days"), F.col("dep_abs"), now) <= int(leave[0]) * 60)
    elif leave == "overnight":
        ok = ok & cal.overnight(F.col("dep"), F.col("dur"))
    elif leave == "weekend":
        ok = ok & cal.weekend(F.col("days"), F.col("dep_abs"), F.col("dur"))
    return legs.filter(ok)


def reachable(legs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """By place: legs and the fastest; by trip: the furthest that it is useful."""
    by_place = legs.groupBy("place").agg(F.count("*").alias("legs"), F.min("dur").alias("fastest"))
    by_trip = legs.groupBy("trip").agg(F.min("from_seq").alias("from_seq"), F.max("to_seq").alias("to_seq"))
    return by_place, by_trip


def soonest(legs: DataFrame, now: int) -> DataFrame:
    return legs.withColumn("wait", cal.wait_for(F.col("days"), F.col("dep_abs"), now))


def connections(out: DataFrame, into: DataFrame, origin: int, dest: int, via_halts: DataFrame, limit: int = 6) -> DataFrame:
    """The quickest ways with one change: one row for each place to change at, best first.

    ``out`` and ``into`` are departures of the origin and arrivals of the destination with days.
    For each place the 24 quickest rides of either side are paired on the place. The wait after
    a first ride that boards on weekday x is found on the week's circle: the least distance from
    being ready to the second ride's boarding weekdays. A change takes 45 minutes at the
    same station, 120 across town."""
    quick = Window.partitionBy("place").orderBy("dur", "trip", "from_seq")
    side = lambda legs: legs.filter(~F.col("place").isin(origin, dest)).withColumn("nth", F.row_number().over(quick)).filter("nth <= 24")
    cols = ("trip", "dep", "dep_abs", "dur", "days", "far_station", "nth")
    a = side(out).select("place", *[F.col(c).alias(f"a_{c}") for c in cols])
    b = side(into).select("place", *[F.col(c).alias(f"b_{c}") for c in cols])
    pairs = a.join(b, "place").filter("a_trip <> b_trip")
    pairs = pairs.withColumn("cross", F.col("a_far_station") != F.col("b_far_station"))
    change = F.when(F.col("cross"), 120).otherwise(45)
    first, second = cal.boards_on(F.col("a_days"), F.col("a_dep_abs")), cal.boards_on(F.col("b_days"), F.col("b_dep_abs"))
    pairs = pairs.withColumn("on", second).withColumn("x", F.explode(F.array(*[F.when(cal.has_day(first, d), d) for d in range(7)])))
    ready = F.col("x") * cal.DAY + F.col("a_dep") + F.col("a_dur") + change
    gaps = [F.when(cal.has_day(F.col("on"), d), F.pmod(F.lit(d * cal.DAY) + F.col("b_dep") - ready, F.lit(cal.WEEK))) for d in range(7)]
    pairs = pairs.filter("x is not null").withColumn("wait", change + F.least(*gaps)).filter("wait is not null")
    key = ["place", "a_trip", "b_trip", "a_nth", "b_nth", "cross"]
    known = (F.col("a_days") != 0) & (F.col("b_days") != 0)
    per_day = pairs.select(*key, "x", "wait", known.alias("known"), (F.col("a_dur") + F.col("wait") + F.col("b_dur")).alias("total"))
    # The best total of a pair, and the weekdays that reach it, in one aggregation: days are added
    # up by total first.
    by_total = per_day.groupBy(*key, "total").agg(F.bit_or(F.pow(F.lit(2), F.col("x")).cast("int")).alias("days"), F.min("wait").alias("wait"), F.first("known").alias("known"))
    pair = by_total.groupBy(*key).agg(F.min(F.struct("total", "days", "wait", "known")).alias("p")).select(*key, "p.*")
    best = Window.partitionBy("place").orderBy("total", "a_nth", "b_nth")
    pair = pair.withColumn("nth", F.row_number().over(best)).withColumn("top", F.min("total").over(Window.partitionBy("place")))
    others = F.sum(F.when(F.col("total") <= F.col("top") + 180, 1).otherwise(0)).over(Window.partitionBy("place")) - 1
    via = pair.withColumn("others", others).filter("nth = 1").join(via_halts, "place", "left")
    score = F.col("total") + F.when(F.col("cross"), 60).otherwise(0) + F.greatest(F.lit(0), F.col("wait") - 360) / 2.0
    ranked = via.withColumn("score", score)
    # One row for each place: a bounded dimension.
    order = Window.partitionBy().orderBy("score", F.col("halts").desc(), "place")
    ranked = ranked.withColumn("best_total", F.first("total").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    ranked = ranked.filter(F.col("total") <= F.col("best_total") * 1.6 + 240).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
    return ranked.select("rank", F.col("place").alias("via"), "a_trip", "b_trip", "wait", "total", "days", "known", F.col("cross").alias("cross_town"), "others")
