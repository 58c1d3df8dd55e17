"""The timetable queries against DuckDB on the smallest tables, and the golden examples."""

import math
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from kursbuch.functions import calendar as cal
from kursbuch.functions import climate, geo
from kursbuch.functions import text as tx
from kursbuch.operators import graph, lines, reach, resolve, saves, spatial
from kursbuch.plans import oracle
from kursbuch.plans import queries as plans
from kursbuch.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows_of(records):
    def plain(x):
        if x is None or isinstance(x, float) and math.isnan(x):
            return None
        if isinstance(x, bool) or isinstance(x, str):
            return x
        return round(float(x), 6)

    return sorted((tuple(plain(x) for x in r) for r in records), key=repr)


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(oracle.ORACLE_SQL))
def test_against_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    names = sorted(df.columns)
    mine = rows_of(df.select(*names).collect())
    rel = duck.sql(oracle.ORACLE_SQL[name])
    assert sorted(rel.columns) == names
    theirs = rows_of(rel.select(*[duckdb.ColumnExpression(c) for c in names]).fetchall())
    assert mine == theirs


def test_every_query_is_offered(spark):
    assert set(QUERIES) <= set(entry.queries())
    assert set(oracle.ORACLE_SQL) <= set(QUERIES)


def one(spark, **columns):
    row = spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()
    return row.asDict()


def test_waiting_by_running_days(spark):
    mon_thu, w = F.lit(0b0001001), lambda mask, dep, now: cal.wait_for(mask, F.lit(dep), now)
    at = lambda day, hour: day * 1440 + hour * 60
    got = one(
        spark,
        a=w(mon_thu, 1320, at(0, 21)), b=w(mon_thu, 1320, at(0, 23)), c=w(mon_thu, 1320, at(4, 12)),
        d=w(mon_thu, 1560, at(1, 1)), e=w(mon_thu, 1560, at(0, 1)), f=w(mon_thu, 1560, at(1, 3)), g=w(F.lit(0), 1320, at(0, 23)),
    )
    assert got == {"a": 60, "b": 4260, "c": 4920, "d": 60, "e": 1500, "f": 4260, "g": 1380}


def test_days_and_times(spark):
    got = one(
        spark,
        daily=cal.days_label(F.lit(127)), but=cal.days_label(F.lit(123)), two=cal.days_label(F.lit(9)), none=cal.days_label(F.lit(0)),
        shifted=cal.shift_days(F.lit(64), F.lit(1)), t=cal.parse_time(F.lit("01:30+1")), bad=cal.parse_time(F.lit("1h")), shown=cal.format_time(F.lit(1530)),
        mask=cal.days_mask(F.lit("Mon, Thu")), empty=cal.days_mask(F.lit("")), wrong=cal.days_mask(F.lit("Mon,Foo")),
    )
    assert got == {
        "daily": "Daily", "but": "Except Wed", "two": "Mon, Thu", "none": "", "shifted": 1, "t": 1530, "bad": None, "shown": "01:30+1",
        "mask": 9, "empty": 0, "wrong": None,
    }


def test_overnight(spark):
    o = lambda dep, dur: cal.overnight(F.lit(dep), F.lit(dur))
    assert one(spark, a=o(1320, 480), b=o(1280, 360), c=o(900, 900), d=o(1200, 1200)) == {"a": True, "b": False, "c": False, "d": False}


def test_month_runs(spark):
    years = [("a", "GGGGRWWWWGBG"), ("b", "BBGMHMRRGGBB"), ("c", "BBBBBBBBBBBB"), ("d", "WWWWWWWWWWWW")]
    df = spark.createDataFrame(years, "key string, letters string")
    wet = climate.month_runs(df, "key", good="W").filter("key = 'a'").collect()
    assert [(r["first"], r["last"]) for r in wet] == [(5, 8)]
    lovely = {(r["key"], r["first"], r["last"]) for r in climate.month_runs(df, "key", good="BG").collect()}
    assert ("c", 0, 11) in lovely and not any(k == "d" for k, _, _ in lovely) and ("b", 8, 2) in lovely


def test_fnv(spark):
    golden = {"Mysore": 1871456744, "Hampi": 298557722, "Kolkata/East": 841528054, "Śrīraṅgapaṭṭaṇa": 3148583877, "मैसूरु": 1821753979, "": 2166136261}
    df = spark.createDataFrame([(k,) for k in golden], "t string")
    assert {r["t"]: r["h"] for r in df.select("t", tx.fnv1a(F.col("t")).alias("h")).collect()} == golden


def brute_edits(a, b):
    """By definition: the least of all ways to take the last letters off."""
    memo = {}

    def d(i, j):
        if (i, j) not in memo:
            ways = [d(i - 1, j) + 1] if i else []
            ways += [d(i, j - 1) + 1] if j else []
            ways += [d(i - 1, j - 1) + (a[i - 1] != b[j - 1])] if i and j else []
            ways += [d(i - 2, j - 2) + 1] if i > 1 and j > 1 and a[i - 2 : i] == b[j - 2 : j][::-1] else []
            memo[i, j] = min(ways) if ways else 0
        return memo[i, j]

    return d(len(a), len(b))


def test_forgiving_names(spark):
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abc") for _ in range(rnd.randint(1, 7)))
    pairs = [(word(), word()) for _ in range(600)] + [("dehli", "delhi"), ("ca", "abc"), ("abcdef", "badcfe"), ("abcdef", "badcef")]
    df = spark.createDataFrame(pairs, "a string, b string")
    for most in (1, 2):
        got = df.select("a", "b", tx.edits(F.col("a"), F.col("b"), most).alias("d")).collect()
        for r in got:
            want = brute_edits(r["a"], r["b"])
            assert r["d"] == (want if want <= most else None), (r, want)
    names = spark.createDataFrame([("bangalore",), ("agra",), ("delhi",), ("bangkok",)], "name string")
    s = lambda q, most: {r["name"]: r["s"] for r in names.select("name", tx.slips(q, F.col("name"), most).alias("s")).collect() if r["s"] is not None}
    assert s("banglore", 2) == {"bangalore": 1.0} and s("banglo", 1) == {"bangalore": 1.5, "bangkok": 1.5} and s("dehli", 1) == {"delhi": 1.0}
    assert tx.fold_text("Élan") == "elan"
    q = spark.createDataFrame([("jaipur jn",), (" pune, rly stn ",), ("jnu",)], "q string").select(tx.tidy(F.col("q")).alias("t")).collect()
    assert [r["t"] for r in q] == ["jaipur", "pune", "jnu"]


def test_saves(spark):
    now = 10**12
    rows = [("u", "hampi", 10, False, "a"), ("u", "goa", 30, True, ""), ("u", "goa", 20, False, "b"), ("u", "ooty", 25, False, "c"), ("u", "tie", 5, False, "x"), ("u", "tie", 5, True, "")]
    df = spark.createDataFrame(rows, "user string, key string, at long, deleted boolean, data string")
    got = {r["key"]: (r["at"], r["deleted"]) for r in saves.last_writer_wins(df).collect()}
    assert got == {"hampi": (10, False), "goa": (30, True), "ooty": (25, False), "tie": (5, True)}
    old = spark.createDataFrame([("a", now - saves.TTL_MS, True), ("b", now - saves.TTL_MS + 1, True), ("c", 0, False)], "key string, at long, deleted boolean")
    assert {r["key"] for r in saves.prune(old, now).collect()} == {"b", "c"}


def test_saves_stream(spark, tmp_path):
    from kursbuch.streaming import sync

    schema = "user string, key string, at long, deleted boolean, data string"
    spark.createDataFrame([("u", "a", 1, False, "x"), ("u", "b", 9, False, "y")], schema).coalesce(1).write.parquet(str(tmp_path / "in/1"))
    spark.createDataFrame([("u", "a", 3, True, ""), ("u", "b", 4, False, "late")], schema).coalesce(1).write.parquet(str(tmp_path / "in/2"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    sync.sync(spark, source, str(tmp_path / "out"), str(tmp_path / "ck"))
    got = {(r["key"], r["at"], r["deleted"]) for r in sync.current(spark, str(tmp_path / "out"), 1).collect()}
    assert got == {("a", 3, True), ("b", 9, False)}


def test_shortest_way(spark):
    e = spark.createDataFrame([(1, 2, 5.0), (2, 3, 5.0), (1, 3, 20.0), (3, 4, 1.0), (8, 9, 1.0)], "a long, b long, km double")
    assert {(r["node"], r["km"]) for r in graph.shortest(e, 1, 100.0).collect()} == {(1, 0.0), (2, 5.0), (3, 10.0), (4, 11.0)}


def test_renames_in_a_chain(spark):
    df = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "y")], "old string, new string")
    assert {(r["old"], r["current"]) for r in resolve.rename_closure(df).collect()} == {("a", "d"), ("b", "d"), ("c", "d"), ("x", "y")}


def test_codec_and_checks_on_empty_tables(spark):
    none = spark.createDataFrame([], "trip long, seq long, station long, arr long, dep long, km long, place long")
    assert lines.validate(none).count() == 0 and lines.edges(none).count() == 0
    assert reach.departures(none, 1).count() == 0 and lines.delta_decode(lines.delta_encode(none)).count() == 0


def test_boarding_and_first_reach(spark):
    """A trip that calls twice in the origin is boarded at the first halt it leaves from."""
    halts = [(1, 0, 10, None, 100, 0, 1), (1, 1, 11, 150, 151, 5, 1), (1, 2, 20, 200, 205, 9, 2), (1, 3, 21, 300, 301, 12, 2), (1, 4, 30, 400, None, 20, 3)]
    df = spark.createDataFrame(halts, "trip long, seq long, station long, arr long, dep long, km long, place long")
    out = {(r["place"], r["from_seq"], r["to_seq"], r["dur"], r["halts"]) for r in reach.departures(df, 1).collect()}
    assert out == {(2, 0, 2, 100, 0), (3, 0, 4, 300, 2)}
    into = {(r["place"], r["from_seq"], r["to_seq"], r["dur"], r["halts"]) for r in reach.arrivals(df, 3).collect()}
    assert into == {(1, 0, 4, 300, 2), (2, 2, 4, 195, 0)}


def test_diverse_choice(spark):
    rows = [(1, 100, 0.0, 20.0, 75.0, 20, 20), (1, 101, 0.1, 20.01, 75.0, 25, 25), (1, 102, 9.0, 20.5, 75.0, 60, 60), (1, 103, 9.0, 22.0, 75.0, 500, 500)]
    df = spark.createDataFrame(rows, "point long, station long, km double, s_lat double, s_lon double, minutes long, score long")
    assert [(r["rank"], r["station"]) for r in spatial.diverse(df).orderBy("rank").collect()] == [(1, 100), (2, 102)]


def test_surface_of_all_samples(spark):
    """Samples in several partitions, and the query on every station and cell."""
    samples = [(float(i % 11), float(i % 7), float(i % 45)) for i in range(150)]
    df = spark.createDataFrame(samples, "lat double, lon double, v double").repartition(3)
    grid = spark.range(12).selectExpr("id as cell", "id div 4 as g_lat", "id % 4 as g_lon")
    got = {r["cell"]: r["value"] for r in spatial.surface(grid, df).collect()}
    for c in range(12):
        w = [1 / ((c // 4 - a) ** 2 + (c % 4 - o) ** 2 + 1) ** 2 for a, o, _ in samples]
        assert got[c] == pytest.approx(sum(x * s[2] for x, s in zip(w, samples, strict=True)) / sum(w))
    assert spatial.surface(grid, df.limit(0)).count() == 0
    assert "CartesianProduct" not in (plan := spatial.surface(grid, df)._jdf.queryExecution().toString()) and "NestedLoop" not in plan


def test_nearest_at_any_distance(spark):
    at = "point long, lat double, lon double"
    points = spark.createDataFrame([(1, 20.0, 75.0), (2, 30.0, 75.0), (3, -40.0, 170.0), (4, None, 75.0)], at)
    stations = spark.createDataFrame([(10, 20.1, 75.0), (11, 24.0, 75.0), (12, 37.0, 75.0)], at.replace("point", "station"))
    assert {(r["point"], r["station"]) for r in spatial.nearest_any(points, stations).collect()} == {(1, 10), (2, 11), (3, 10)}


def test_choices_within_350_km(spark):
    """One station 200 km off: the registered queries gave the point no row."""

    class Small:
        def table(self, name):
            return spark.range(1).selectExpr("0L as c_custkey")

        stations = spark.createDataFrame([(7, 1, 9.8, 68.0)], "station long, place int, lat double, lon double")
        halts = spark.createDataFrame([(7,)] * 5, "station long")

    assert [f(Small()).count() for f in (plans.nearest_stations_scored_whole, plans.nearest_stations_diverse)] == [1, 1]


def test_shortest_way_of_many_edges(spark):
    e = spark.createDataFrame([(i, i + 1, 1.0) for i in range(36)] + [(0, 36, 50.0)], "a long, b long, km double")
    assert {(r["node"], r["km"]) for r in graph.shortest(e, 0, 100.0).collect()} == {(i, float(i)) for i in range(37)}


def test_renumbered_services(spark):
    """A neighbouring end station, the way back, a tie by name, a tie that stays, and one too far."""
    st = [(1, 20.0, 75.0), (2, 20.2, 75.0), (3, 25.0, 80.0), (4, 25.1, 80.1), (5, 10.0, 77.0), (6, 12.0, 77.0), (7, 10.5, 77.0), (8, 15.0, 70.0)]
    stations = spark.createDataFrame([*st, (9, None, None)], "station long, lat double, lon double")
    schema = "trip long, name string, a long, b long"
    gone = [(100, "Deccan Express", 1, 3), (101, "Konkan Mail", 5, 6), (102, "Express", 6, 5), (103, None, 7, 6), (104, "Hill", 8, 9)]
    new = [(200, "Other", 4, 2), (201, "Konkan Special", 5, 6), (202, "Malabar Express", 6, 5), (203, "x", 9, 8)]
    got = resolve.renumber_resolution(spark.createDataFrame(gone, schema), spark.createDataFrame(new, schema), stations)
    assert {(r["old"], r["new"]) for r in got.collect()} == {(100, 200), (101, 201), (104, 203)}


@pytest.mark.parametrize("km", [50.0, 900.0, 5000.0])
def test_near_at_any_place_of_the_earth(spark, km):
    rnd = random.Random(5)
    at = [(i, rnd.choice([rnd.uniform(-90, 90), rnd.uniform(79, 90), rnd.uniform(-1, 1)]), rnd.choice([rnd.uniform(-180, 180), rnd.uniform(178, 180), rnd.uniform(-180, -178)])) for i in range(150)]
    at += [(200, 80.0, 10.0), (201, 80.0, 12.2), (202, 0.0, 179.9), (203, 0.0, -179.9), (204, None, 1.0)]
    df = spark.createDataFrame(at, "id long, lat double, lon double")
    got = geo.near(df, df.withColumnRenamed("id", "other"), km, ["id"], ["other"]).collect()
    rad = math.radians

    def apart(a, b):
        h = math.sin(rad(b[1] - a[1]) / 2) ** 2 + math.cos(rad(a[1])) * math.cos(rad(b[1])) * math.sin(rad(b[2] - a[2]) / 2) ** 2
        return 2 * 6371 * math.asin(math.sqrt(min(1.0, h)))

    known = [x for x in at if x[1] is not None]
    want = sorted((a[0], b[0]) for a in known for b in known if apart(a, b) <= km)
    assert sorted((r["id"], r["other"]) for r in got) == want
