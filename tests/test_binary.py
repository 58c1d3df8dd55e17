"""The app's binary layout: round trips, real files, what does not fit."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from kursbuch.sources import binary

HALTS = "trip long, seq long, station long, arr long, dep long, km long, approx int"


@pytest.fixture(scope="module")
def tables(spark):
    rnd = random.Random(6)
    halts, trips, paths = [], [], []
    for t in rnd.sample(range(-500, 10**12), 70):
        n, now, km = rnd.randint(2, 9), rnd.randint(0, 60_000), rnd.choice([0, 64_000])
        for i in range(n):
            # also times that run backwards and distances that start anew: the layout counts modulo 2^16
            now, km = rnd.choice([min(65_000, now + rnd.randint(0, 900)), rnd.randint(0, 65_534)]), rnd.choice([min(65_000, km + 7), rnd.randint(0, 65_534)])
            halts.append((t, i, rnd.randint(0, 65_534), None if i == 0 else now, None if i == n - 1 else min(65_534, now + 5), km, i % 2))
            if rnd.random() < 0.3:
                paths.append((t, i, [rnd.randint(0, 65_000) for _ in range(rnd.randint(1, 4))]))
        trips.append((t, rnd.randint(0, 255), rnd.randint(0, 127)))
    make = spark.createDataFrame
    return make(halts, HALTS), make([*trips, (10**13, 1, 1)], "trip long, type int, days int"), make(paths, "trip long, after long, stations array<long>")


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


@pytest.mark.parametrize("shards", [1, 5])
def test_round_trip(spark, tables, shards):
    halts, trips, paths = tables
    packed = binary.pack(halts, trips, paths, shards).cache()
    columns = ["trip", "seq", "station", "arr", "dep", "km", "approx", "type", "days"]
    assert rows(binary.unpack(packed), *columns) == rows(halts.join(trips, "trip"), *columns)
    assert rows(binary.unpack_paths(packed), "trip", "after", "stations") == rows(paths, "trip", "after", "stations")
    ranges = sorted((r["lo"], r["hi"]) for r in packed.collect())
    assert all(a[1] < b[0] for a, b in zip(ranges, ranges[1:], strict=False)) and len(ranges) == shards


def test_files_as_the_app_reads_them(spark, tables, tmp_path):
    halts, trips, paths = tables
    packed = binary.pack(halts, trips, paths, 3).select("*", binary.timetable_file().alias("file"), binary.paths_file().alias("more")).collect()
    for r in packed:
        (tmp_path / f"{r['lo']}.bin").write_bytes(r["file"])
        mark, version, n_trips, n_halts = struct.unpack_from("<4sIII", r["file"])
        assert (mark, version, n_trips, n_halts) == (b"RGTT", 4, r["trips"], r["halts"])
        assert len(r["file"]) == 16 + 4 * (n_trips + 1) + 8 * n_halts + 2 * n_trips + n_halts
        start = struct.unpack_from(f"<{n_trips + 1}I", r["file"], 16)
        first = struct.unpack_from("<H", r["file"], 16 + 4 * (n_trips + 1) + 2 * n_halts)[0]
        assert start[0] == 0 and start[-1] == n_halts and first == 0
        assert struct.unpack_from("<4sIII", r["more"]) == (b"RGTP", 1, r["halts"], r["passes"])
    files = spark.read.format("binaryFile").load(str(tmp_path))
    named = files.withColumn("lo", F.regexp_extract("path", r"(-?\d+)\.bin", 1).cast("long"))
    trip = spark.createDataFrame([(r["lo"], r["trip"]) for r in packed], "lo long, trip binary")
    back = binary.unpack(binary.open_timetable(named).join(trip, "lo"), ["dep", "station"])
    assert back.columns == ["trip", "seq", "dep", "station"] and rows(back, "trip", "seq", "dep", "station") == rows(halts, "trip", "seq", "dep", "station")


def test_only_the_arrays_asked_for_are_read(spark, tables, tmp_path):
    binary.pack(*tables, 4).write.parquet(str(tmp_path / "packed"))
    shards = spark.read.parquet(str(tmp_path / "packed"))
    some = binary.unpack(shards.filter("hi >= 0"), ["station"])
    plan = some._jdf.queryExecution().executedPlan().toString()
    read = plan[plan.index("ReadSchema") :]
    assert "station" in read and "start" in read and "days" not in read and "pass_station" not in read and "GreaterThanOrEqual(hi,0)" in plan


@pytest.mark.parametrize("content", [b"", b"RGTT", b"RGTP" + bytes(40), struct.pack("<4sIII", b"RGTT", 3, 0, 0) + bytes(4), struct.pack("<4sIII", b"RGTT", 4, 1, 1) + bytes(9), None])
def test_other_files_are_errors(spark, content):
    df = spark.createDataFrame([(content,)], "content binary")
    with pytest.raises(Exception, match="no RGTT file"):
        binary.open_timetable(df).collect()


@pytest.mark.parametrize("row", [(1, 0, 70_000, None, 5, 1, 0), (1, 0, 5, 3, 5, 1, 0), (1, 0, 5, None, None, 1, 0), (1, 0, 5, None, 65_535, 1, 0), (2, 0, 5, None, 1, 1, 0)])
def test_what_does_not_fit_is_an_error(spark, row):
    halts = spark.createDataFrame([row, (row[0], 1, 6, 9, None, 2, 0)], HALTS)
    with pytest.raises(Exception, match="does not fit"):
        binary.pack(halts, spark.createDataFrame([(1, 0, 0)], "trip long, type int, days int"), spark.createDataFrame([], "trip long, after long, stations array<long>"), 1).collect()


def test_nothing(spark):
    none = binary.pack(spark.createDataFrame([], HALTS), spark.createDataFrame([], "trip long, type int, days int"), spark.createDataFrame([], "trip long, after long, stations array<long>"), 2)
    assert binary.unpack(none).count() == 0 and binary.unpack_paths(none).count() == 0
