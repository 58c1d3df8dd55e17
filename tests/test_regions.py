"""Shapefiles and regions against plain loops."""

import math
import random

import numpy as np

from kursbuch.operators import regions
from kursbuch.operators.repair import inside
from kursbuch.sources import shapes

RINGS = "file string, shape long, name string, ring int, pos int, x double, y double"


def drawn():
    """Squares, one with a hole, one of two parts, an L; shared borders; a repeated name."""
    square = lambda x, y, a: [(x, y), (x + a, y), (x + a, y + a), (x, y + a), (x, y)]
    figures = [("A", [square(70, 10, 2), square(70.5, 10.5, 0.5)]), ("B", [square(72, 10, 1), square(74, 10, 1)]), ("A", [square(70, 12, 1)]), ("Ç", [[(76, 10), (78, 10), (78, 11), (77, 11), (77, 12), (76, 12), (76, 10)]])]
    return figures, [("one", s, name, r, i, float(x), float(y)) for s, (name, rings) in enumerate(figures) for r, ring in enumerate(rings) for i, (x, y) in enumerate(ring)]


def far(x, y, rings):
    k, best = 111.32 * math.cos(math.radians(y)), math.inf
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:], strict=False):
            p, v = np.array([(ax - x) * k, (ay - y) * 111.32]), np.array([(bx - ax) * k, (by - ay) * 111.32])
            best = min(best, float(np.hypot(*(p + min(1, max(0, -(p @ v) / (v @ v))) * v))))
    return best


def test_files_read_back(spark, tmp_path):
    _, rows = drawn()
    two = rows + [("two", 0, None, 0, i, 1.5 * i, 2.0 * (i % 2)) for i in range(4)]
    files = shapes.encode(spark.createDataFrame(two, RINGS)).collect()
    for f in files:
        (tmp_path / f"{f['file']}.shp").write_bytes(f["shp"])
        if f["file"] == "one":
            (tmp_path / f"{f['file']}.dbf").write_bytes(f["dbf"])
    got = sorted(tuple(r)[1:] + (tuple(r)[0].rsplit("/", 1)[1],) for r in shapes.read(spark, str(tmp_path)).collect() if r["name"] is not None)
    assert got == sorted(r[1:] + (r[0],) for r in rows)
    unnamed = [r for r in shapes.read(spark, str(tmp_path)).collect() if r["name"] is None]
    assert sorted((r["pos"], r["x"]) for r in unnamed) == [(i, 1.5 * i) for i in range(4)]


def test_a_record_that_is_no_polygon_counts(spark):
    _, rows = drawn()
    (f,) = shapes.encode(spark.createDataFrame(rows, RINGS)).collect()
    point = b"\0\0\0\1\0\0\0\2\0\0\0\0"  # a null shape of two words
    kept = shapes.rings_of(bytes(f["shp"][:100]) + point + bytes(f["shp"][100:]))
    assert kept[0] is None and len(kept) == 5 and len(kept[1]) == 2
    none = spark.createDataFrame([("x", None, None)], "file string, shp binary, dbf binary")
    assert shapes.decode(none).count() == 0


def test_settled_as_by_loops(spark):
    figures, rows = drawn()
    rnd = random.Random(4)
    points = [(i, rnd.uniform(9.9, 13.1), rnd.uniform(69.9, 78.1), rnd.choice(["A", "B", "Ç", "Z", None])) for i in range(1500)]
    points += [(1500 + i, 10 + rnd.uniform(0, 2), 72 + rnd.uniform(-0.02, 0.02), rnd.choice("AB")) for i in range(300)]
    points += [(9000, None, 71.0, "A"), (9001, 10.0, None, None), (9002, 88.0, 10.0, "Z")]
    rings = spark.createDataFrame(rows, RINGS).withColumnRenamed("file", "state")
    got = {r["point"]: (r["state"], r["why"]) for r in regions.settle(spark.createDataFrame(points, "point long, lat double, lon double, current string"), rings, split=(("B", "A"),)).collect()}
    seen = set()
    for i, y, x, current in points:
        want = (current, "outside")
        if x is not None and y is not None:
            here = [n for n, rings_ in figures if inside(np.array([x]), np.array([y]), rings_)[0]]
            least = sorted((far(x, y, r), n) for n, r in figures)
            mine = min((d for d, n in least if n == current), default=math.inf)
            if here:
                keep = current is not None and current != here[0] and (current, here[0]) != ("B", "A") and mine <= 1.2
                want = (current, "border") if keep else (here[0], "")
            elif least[0][0] <= 3:
                want = (least[0][1], "coast")
        assert got[i] == want, (i, y, x, current)
        seen.add(want[1])
    assert seen == {"", "border", "coast", "outside"} and len(got) == len(points)


def test_no_points_and_no_shapes(spark):
    _, rows = drawn()
    kind = "point long, lat double, lon double, current string"
    assert regions.settle(spark.createDataFrame([], kind), spark.createDataFrame(rows, RINGS)).count() == 0
    got = regions.settle(spark.createDataFrame([(1, 10.0, 70.0, "A")], kind), spark.createDataFrame([], RINGS)).collect()
    assert [tuple(r) for r in got] == [(1, "A", "outside")]


def test_repeated_edges_are_not_sent_to_all_tasks(spark):
    """Slanted, level and upright edges: what small tables stand for may be large. Distances as by loops, far from the ends too."""
    rnd = random.Random(9)
    rings = {f"s{i}": [(rnd.uniform(70, 71), rnd.uniform(10, 11)) for _ in range(4)] for i in range(6)}
    rings |= {"box": [(70.2, 10.2), (70.9, 10.2), (70.9, 10.8), (70.2, 10.8)], "sliver": [(70.0, 10.4), (71.0, 10.4 + 1e-12), (70.5, 10.4)]}
    rows = [(s, n, 0, i, x, y) for s, (n, ring) in enumerate(rings.items()) for i, (x, y) in enumerate(ring)]
    drawn = regions.edges(spark.createDataFrame(rows, "shape long, name string, ring int, pos int, x double, y double"))
    points = [(i, rnd.uniform(9.9, 11.1), rnd.uniform(69.9, 71.1)) for i in range(300)]
    df = spark.createDataFrame(points, "point long, lat double, lon double")
    found = regions.edge_km(df, drawn)
    got = {(r["point"], r["name"]): r["km"] for r in found.collect()}
    want = {(i, n): d for i, y, x in points for n, ring in rings.items() if (d := far(x, y, [[*ring, ring[0]]])) <= 3}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want) and len(want) > 100
    assert all("BroadcastHashJoin" not in x._jdf.queryExecution().executedPlan().toString() for x in (found, regions.containing(df, drawn)))
