"""New numbers for old trips, against plain loops."""

import random

from kursbuch.operators import merge


def test_moves_and_their_propagation(spark):
    rnd = random.Random(8)
    asked = sorted({rnd.randrange(200) for _ in range(80)})
    present = set(range(1000, 1010))
    candidates = [(o, rnd.randrange(1000, 1040)) for o in range(0, 200, 2)] + [(2, 1500), (4, None)]
    want, taken, least = {}, set(present), {}
    for o, n in candidates:
        if n is not None:
            least[o] = min(n, least.get(o, n))
    for o in asked:
        n = least.get(o)
        want[o] = (n, "unlisted" if n is None else "duplicate" if n in taken else "renumbered")
        taken.add(n)
    moved = merge.moves(spark.createDataFrame([(x,) for x in [*asked, asked[0], None]], "trip long"), spark.createDataFrame(candidates, "old long, new long"), spark.createDataFrame([(x,) for x in [*present, None]], "trip long"))
    assert {r["old"]: (r["new"], r["status"]) for r in moved.collect()} == want and moved.count() == len(want)
    assert {s for _, s in want.values()} == {"unlisted", "duplicate", "renumbered"}
    rows = [(o, i, "clash") for o in [*range(200), None] for i in range(2)]
    got = merge.propagate(spark.createDataFrame(rows, "trip long, seq int, status string"), moved)
    new = lambda o: want[o][0] if o in want and want[o][1] == "renumbered" else o
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(str((new(o), i, s)) for o, i, s in rows) and got.columns == ["trip", "seq", "status"]
    none = spark.createDataFrame([], "old long, new long")
    assert {r["status"] for r in merge.moves(spark.createDataFrame([(1,)], "trip long"), none, spark.createDataFrame([], "trip long")).collect()} == {"unlisted"}


def test_newer_without_known_numbers(spark):
    newer = [("1/2", "a"), ("1/2", "b"), ("3", "c"), ("4/5/6", "d"), ("", "e"), (None, "f"), ("11", "g")]
    trips = spark.createDataFrame([(2,), (2,), (6,), (None,)], "trip long")
    got = merge.still_newer(spark.createDataFrame(newer, "numbers string, one string"), trips)
    assert sorted(r["one"] for r in got.collect()) == ["c", "e", "f", "g"] and got.columns == ["numbers", "one"]


def test_runs_of_one_station(spark):
    rows = [(1, i, s, i) for i, s in enumerate([5, 5, 6, 5, None, None, 5, 5, 5])] + [(2, 0, 5, 0), (2, 3, 5, 9)]
    got = merge.collapse(spark.createDataFrame(rows, "trip long, seq long, station long, _x long"))
    assert sorted((r["trip"], r["seq"]) for r in got.collect()) == [(1, 0), (1, 2), (1, 3), (1, 4), (1, 6), (2, 0)]
