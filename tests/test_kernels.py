"""Kernels that carry state, and the planner on a network small enough to think through."""

import numpy as np

from kursbuch.operators import plan, repair


def retimed(spark, trips):
    rows = [(t, i, a, d, k, e) for t, halts in enumerate(trips) for i, (a, d, k, e) in enumerate(halts)]
    df = spark.createDataFrame(rows, "trip long, seq long, arr long, dep long, km double, estimated boolean")
    out = {}
    for r in repair.retime(df).orderBy("trip", "seq").collect():
        out.setdefault(r["trip"], []).append((r["arr"], r["dep"]))
    return [out[t] for t in range(len(trips))]


def test_retiming_by_distance(spark):
    quick = [(None, 0, 0.0, False), (1, 1, 50.0, True), (2, 2, 100.0, True), (100, None, 150.0, False)]
    fine = [(None, 0, 0.0, False), (50, 51, 50.0, True), (100, None, 100.0, False)]
    open_end = [(None, 0, 0.0, False), (5, 6, 90.0, True)]
    got = retimed(spark, [quick, fine, open_end])
    assert got == [[(None, 0), (33, 34), (66, 67), (100, None)], [(None, 0), (50, 51), (100, None)], [(None, 0), (5, 6)]]


def test_times_never_go_back(spark):
    rng = np.random.default_rng(0)
    trips = []
    for _ in range(60):
        n = int(rng.integers(1, 6))
        km = sorted(rng.uniform(0, 300, n).tolist())
        trips.append([(None, 0, 0.0, False), *[(0, 0, k, True) for k in km], (int(rng.integers(n, 60)), None, 300.0, False)])
    for halts in retimed(spark, trips):
        times = [x for pair in halts for x in pair if x is not None]
        assert times == sorted(times)


def test_polygon_with_a_hole():
    outer, hole = [(0, 0), (10, 0), (10, 10), (0, 10)], [(4, 4), (6, 4), (6, 6), (4, 6)]
    x, y = np.array([5.0, 1.0, 11.0, 4.5]), np.array([5.0, 1.0, 5.0, 9.0])
    assert repair.inside(x, y, [outer, hole]).tolist() == [False, True, False, True]


def test_plan_with_a_change_and_nights(spark):
    halts = [
        (1, 0, 10, None, 480, 0, 1), (1, 1, 20, 600, None, 100, 2),
        (2, 0, 20, None, 700, 0, 2), (2, 1, 30, 800, None, 50, 3),
        (3, 0, 30, None, 420, 0, 3), (3, 1, 10, 900, None, 120, 1),
    ]
    placed = spark.createDataFrame(halts, "trip long, seq long, station long, arr long, dep long, km long, place long")
    trips = spark.createDataFrame([(1, 127, "Pass"), (2, 127, "Toy"), (3, 1, "Pass")], "trip long, days int, type string")
    served = placed.groupBy("place").count().withColumnRenamed("count", "halts")
    legs = plan.plan_trip(placed, trips, served, [(1, 0), (3, 1), (1, 0), (2, 0)], start_day=4)
    assert [x["trips"] for x in legs] == [[1, 2], [3], [1]]
    assert legs[0]["depart"] == 480 and legs[0]["arrive"] == 800 and legs[0]["km"] == 150
    assert legs[1]["ready"] == 1440 + 360 and legs[1]["depart"] == 3 * 1440 + 420  # trip 3 runs on Mondays only
    assert legs[2]["ready"] == legs[1]["arrive"] + 60 and legs[2]["depart"] == 4 * 1440 + 480
