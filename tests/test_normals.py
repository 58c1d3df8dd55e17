"""Climate charts and estimates against plain loops."""

import random

from pyspark.sql import functions as F

from kursbuch.operators import normals

GOOD = "|".join(f"{m}|{m + 9}|{m * 20.5}" for m in range(12))


def charted(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    return {r["i"]: r["c"] for r in df.select("i", normals.chart(F.col("text")).alias("c")).collect()}


def test_charts(spark):
    year = [(float(m), m + 9.0, m * 20.5) for m in range(12)]
    sound = [
        f"{{{{climate chart|T|{GOOD}}}}}",
        f"before {{{{Climate  chart|T|1}}}} {{{{ Climate chart |T\n|{GOOD.replace('|', ' |\n ')}|}}}} after {{{{climate chart|T|1}}}}",
        f"{{{{climate chart|[[a|b]] T|source=[[w:x#y|z]]|{GOOD}|7|8|float=right}}}}",
        f"{{{{climate chart|T|{GOOD}|units=metric}}}}",
    ]
    unsound = [
        None, "", "no chart", "{{climate chart}}", "{{climate chart|T}}", f"{{{{climate chart|T|{GOOD}", f"{{{{climate chart|T|{GOOD}|imperial=yes}}}}", f"{{{{climate chart|T|{GOOD}|x}}}}",
        "{{climate chart|T|" + "|".join(["1|2|3"] * 11) + "|1|2}}", "{{climate chart|T|" + "|".join(["3|2|1"] * 12) + "}}", "{{climate chart|T|" + "|".join(["1|2|3001"] * 12) + "}}", "{{climate chart|T|" + "|".join(["-41|2|1"] * 12) + "}}",
    ]
    got = charted(spark, [*sound, *unsound, "x" * 300_000 + sound[0]])
    for i in [*range(len(sound)), len(sound) + len(unsound)]:
        assert [tuple(m) for m in got[i]] == year, i
    assert all(got[len(sound) + i] is None for i in range(len(unsound)))
    signs = charted(spark, ["{{climate chart|T|" + "|".join(["−5|1,0|1,200"] * 12) + "}}"])[0]
    assert {tuple(m) for m in signs} == {(-5.0, 10.0, 1200.0)}


def test_estimates_by_loops(spark):
    rnd = random.Random(2)
    cells = {(y, x): (rnd.choice([None, 100.0, 900.0]), [float(rnd.randrange(30)) for _ in range(12)], [float(rnd.randrange(30, 50)) for _ in range(12)], [rnd.random() for _ in range(12)]) for y in range(20, 24) for x in range(112, 116) if (y, x) != (21, 113)}
    points = [(i, rnd.choice([None, 9.75, 10.25, rnd.uniform(9.8, 12)]), rnd.uniform(69.7, 72.5), rnd.choice([None, 0.0, 1500.0]), f"{{{{climate chart|T|{GOOD}}}}}" if i % 7 == 0 else None) for i in range(200)]
    rows = [(y * 0.5, x * 0.625, *v) for (y, x), v in cells.items()]
    kinds = "lat double, lon double, elev double, low array<double>, high array<double>, rain array<double>"
    frame = spark.createDataFrame(points, "point long, lat double, lon double, height double, text string")
    table = spark.createDataFrame([*rows, rows[0]], kinds)
    got = {r["point"]: r for r in normals.normals(frame, table).withColumn("flat", normals.flat(F.col("months"))).withColumn("letters", normals.letters(F.col("months"))).collect()}
    assert len(got) == len(points)
    for i, lat, lon, height, text in points:
        r = got[i]
        cell = None if lat is None else cells.get((round(lat / 0.5), round(lon / 0.625)))
        if text:
            assert r["source"] == "imd" and r["months"][3] == (3.0, 12.0, 61.5)
        elif cell is None:
            assert r["source"] == "" and r["months"] is None and r["flat"] is None and r["letters"] == ""
        else:
            elev, low, high, rain = cell
            shift = (height - elev) * 0.0065 if height is not None and elev is not None else 0.0
            want = [(low[m] - shift, high[m] - shift, rain[m] * normals.DAYS[m]) for m in range(12)]
            assert r["source"] == "est" and [tuple(m) for m in r["months"]] == want and r["flat"] == [round(v) for m in want for v in m] and len(r["letters"]) == 12
    assert normals.normals(frame.limit(0), table).count() == 0
    assert {r["source"] for r in normals.normals(frame, table.limit(0)).collect()} == {"imd", ""}


def test_a_text_is_read_once(spark):
    df = spark.createDataFrame([("x",)], "text string").select(normals.chart(F.col("text")).alias("c"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert [plan.count(word) for word in ("regexp_extract(", "split(", "try_cast(")] == [1, 1, 1]
