"""Re-timing along a trip, and geometry that needs loops."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship


def retime(halts: DataFrame) -> DataFrame:
    """trip, seq, arr, dep of halts (trip, seq, arr, dep, km, estimated): times of estimated halts between
    printed ones, by distance, where the present ones cannot be.

    A run of estimated halts is done anew if some stretch of it of more than 3 km takes no time, or
    is faster than 110 km/h and than one and a half times the run's own speed. Every halt stops
    for a minute if the run has two minutes for each. A halt's time is its share of the moving
    time, but not before the one ahead of it has left, which over the run is a running maximum,
    and not so late that those behind it find no room. Windows by trip, no loop."""
    trip = Window.partitionBy("trip").orderBy("seq")
    printed = ~F.col("estimated")
    seen = trip.rowsBetween(Window.unboundedPreceding, 0)
    ahead = trip.rowsBetween(1, Window.unboundedFollowing)
    rows = halts.select("trip", "seq", "arr", "dep", "km", "estimated").withColumn("run", F.sum(printed.cast("int")).over(seen))
    rows = rows.withColumn("a", F.last(F.when(printed, F.struct("dep", "km")), True).over(seen))
    rows = rows.withColumn("b", F.first(F.when(printed, F.struct("arr", "km")), True).over(ahead))
    whole = Window.partitionBy("trip", "run")
    within = whole.orderBy("seq")
    span = F.col("b.arr") - F.col("a.dep")
    way, took = F.lead("km").over(trip) - F.col("km"), F.coalesce(F.lead("arr").over(trip) - F.col("dep"), F.lit(0))
    fast = F.greatest(F.lit(110.0), 1.5 * (F.col("b.km") - F.col("a.km")) / (span / 60))
    rows = rows.withColumn("quick", (way > 3) & F.when(took <= 0, True).otherwise(way / (took / 60) > fast))
    rows = rows.withColumn("redo", (F.max(F.when(F.col("quick"), 1).otherwise(0)).over(whole) == 1) & (span > 0))
    rows = rows.withColumn("n", F.sum(F.col("estimated").cast("int")).over(whole)).withColumn("i", F.row_number().over(within) - 2)
    rows = rows.withColumn("stop", F.when(span >= 2 * F.col("n") + 1, 1).otherwise(0))
    fits = (F.col("b.km") > F.col("a.km")) & F.col("km").between(F.col("a.km"), F.col("b.km"))
    share = F.when(fits, (F.col("km") - F.col("a.km")) / (F.col("b.km") - F.col("a.km"))).otherwise((F.col("i") + 1) / (F.col("n") + 1))
    own = F.col("a.dep") + F.bround(share * (span - F.col("n") * F.col("stop"))) + F.col("i") * F.col("stop")
    step = 2 * F.col("stop") * F.col("i")
    rows = rows.withColumn("lead", F.when(F.col("estimated"), own - step))
    pushed = step + F.greatest(F.col("a.dep") + F.col("stop"), F.max("lead").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    latest = F.col("b.arr") - (F.col("n") - F.col("i") + 1) * F.col("stop")
    change = F.col("estimated") & F.coalesce(F.col("redo"), F.lit(False))
    rows = rows.withColumn("new", F.least(pushed, latest).cast("long"))
    return rows.select(
        "trip", "seq", F.when(change, F.col("new")).otherwise(F.col("arr")).alias("arr"), F.when(change, F.col("new") + F.col("stop")).otherwise(F.col("dep")).alias("dep")
    )


def inside(x: np.ndarray, y: np.ndarray, rings: Sequence[Sequence[tuple[float, float]]]) -> np.ndarray:
    """Even-odd rule for many points at once."""
    hit = np.zeros(len(x), bool)
    for ring in rings:
        p = np.asarray(ring, float)
        q = np.roll(p, 1, axis=0)
        for (xi, yi), (xj, yj) in zip(p, q, strict=True):
            cross = (yi > y) != (yj > y)
            if cross.any():
                hit[cross] ^= x[cross] < (xj - xi) * (y[cross] - yi) / (yj - yi) + xi
    return hit


def state_of(points: DataFrame, states: dict[str, Sequence[Sequence[tuple[float, float]]]]) -> DataFrame:
    """points (lat, lon) with ``in_state``: the first state, by name, whose polygon holds the point; else null."""
    ship(points.sparkSession)
    named = sorted(states.items())

    @F.pandas_udf("string")
    def find(lat: pd.Series, lon: pd.Series) -> pd.Series:
        x, y = lon.to_numpy(float), lat.to_numpy(float)
        out = pd.Series([None] * len(x), dtype=object)
        for name, rings in reversed(named):
            out[inside(x, y, rings)] = name
        return out

    return points.withColumn("in_state", find("lat", "lon"))
