"""Trips of several stops: each leg takes the ride that arrives first."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import calendar as cal
from . import reach


def rides_on(placed: DataFrame, trips: DataFrame, via_halts: DataFrame, a: int, b: int, ready: int, start_day: int, limit: int = 6) -> list[dict]:
    """Rides from a to b that leave at or after ``ready`` (minutes since day one, which is weekday
    start_day), earliest arrival first, the shorter of equals; with a change only if no train is direct.
    """
    now = (start_day * cal.DAY + ready) % cal.WEEK
    out = reach.departures(placed, a).join(trips, "trip")
    direct = reach.soonest(out.filter(F.col("place") == b), now)
    rides = direct.select(F.array("trip").alias("trips"), (ready + F.col("wait")).alias("depart"), (ready + F.col("wait") + F.col("dur")).alias("arrive"), "km")
    first = rides.orderBy("arrive", F.col("arrive") - F.col("depart"), "trips").limit(limit).collect()
    if not first:
        into = reach.arrivals(placed, b).join(trips, "trip")
        found = reach.connections(out, into, a, b, via_halts, limit=4)
        board = out.select(F.col("trip").alias("a_trip"), F.col("place").alias("via"), "dep", F.col("km").alias("km_a"))
        onward = into.select(F.col("trip").alias("b_trip"), F.col("place").alias("via"), F.col("km").alias("km_b"))
        found = found.join(board, ["a_trip", "via"]).join(onward, ["b_trip", "via"])
        found = found.withColumn("wait_first", cal.wait_for(F.col("days"), F.col("dep"), now))
        rides = found.select(
            F.array("a_trip", "b_trip").alias("trips"), (ready + F.col("wait_first")).alias("depart"),
            (ready + F.col("wait_first") + F.col("total")).alias("arrive"), (F.col("km_a") + F.col("km_b")).alias("km"),
        )
        first = rides.orderBy("arrive", F.col("arrive") - F.col("depart"), "trips").limit(limit).collect()
    return [r.asDict() for r in first]


def plan_trip(
    placed: DataFrame, trips: DataFrame, via_halts: DataFrame, stops: Sequence[tuple[int, int]], start_day: int, start: int = 360, choice: Sequence[int] = ()
) -> list[dict]:
    """One row for each leg between the stops (place, nights): leg, a, b, ready, depart, arrive, trips, km.

    One leaves a stop after its nights, from six in the morning and an hour after arriving at the
    earliest. ``choice`` takes another of a leg's rides than the first. Without a ride the plan
    goes on twelve hours later. Legs depend on the one before: a loop over at most a dozen stops."""
    legs, arrived = [], start
    for i, ((a, _), (b, _)) in enumerate(zip(stops, stops[1:], strict=False)):
        ready = start if i == 0 else max(arrived + 60, (arrived // cal.DAY + max(0, stops[i][1])) * cal.DAY + 360)
        rides = rides_on(placed, trips, via_halts, a, b, ready, start_day)
        k = choice[i] if i < len(choice) else 0
        ride = rides[k if k < len(rides) else 0] if rides else {"trips": [], "depart": ready, "arrive": ready + 720, "km": 0}
        legs.append({"leg": i, "a": a, "b": b, "ready": ready, **ride})
        arrived = ride["arrive"]
    return legs
