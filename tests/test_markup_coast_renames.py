"""Templates, the coast, chains of renames and growing searches against plain loops."""

import math
import random

import pytest
from pyspark.sql import functions as F

from kursbuch.operators import coast, markup, resolve, spatial
from kursbuch.operators.book import km_between

TEXTS = [
    "a {{See| name = X | content={{convert|1|km|abbr=on}} [[A|B]] | alt}} b {{do|name=Y}}",
    "{{see|name={{do|name=inner}}|x=1=2|x=3}}", "{{see|name=open {{do|name=shut}} ", "}} ]] {{Seeing|name=no}} {{see}}",
    "{{see|a=[[x|b=1}} {{do|c=2]]|d=3}}", "{ {see|name=no}} {{{see|name=three}}}", "", None, "{{infobox  rail service|name=R}}",
]


def brute(text):
    """Every opening, its end by counting, parts by counting again."""
    out = []
    for at in range(len(text) - 1):
        if text[at : at + 2] != "{{":
            continue
        depth, j, parts, cur, links = 0, at, [], "", 0
        while j < len(text):
            two = text[j : j + 2]
            if two == "{{":
                depth, j, cur = depth + 1, j + 2, cur + two
            elif two == "}}":
                depth, j = depth - 1, j + 2
                if not depth:
                    break
                cur += two
            elif two == "[[":
                links, j, cur = links + 1, j + 2, cur + two
            elif two == "]]":
                links, j, cur = max(0, links - 1), j + 2, cur + two
            elif text[j] == "|" and depth == 1 and not links:
                parts, cur, j = [*parts, cur], "", j + 1
            else:
                cur, j = cur + text[j], j + 1
        parts.append(cur)
        out.append((" ".join(parts[0][2:].split()).lower(), {p.split("=", 1)[0].strip().lower(): p.split("=", 1)[1].strip() for p in parts[1:] if "=" in p}))
    return out


def well_formed(rnd, depth=0):
    inner = lambda: "".join(rnd.choice([lambda: rnd.choice("ab =\n"), lambda: well_formed(rnd, depth + 1) if depth < 3 else "z", lambda: "[[p|q]]"])() for _ in range(rnd.randint(0, 4)))
    return "{{" + rnd.choice(["see", "Do ", "eat x"]) + "".join(f"|{rnd.choice(['name', 'k', ''])}{rnd.choice(['=', ''])}{inner()}" for _ in range(rnd.randint(0, 3))) + "}}"


def test_parse_as_by_counting():
    rnd = random.Random(9)
    for _ in range(300):
        text = "x".join(well_formed(rnd) for _ in range(rnd.randint(0, 3)))
        assert [(n, p) for _, n, p in markup.parse(text)] == brute(text), text


def test_listings(spark):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)] + [(0, TEXTS[0], 1)], "doc_id long, text string, nth int")
    found = sorted((r["doc_id"], r["nth"], r["kind"], sorted(r["params"].items())) for r in markup.listings(df, ["see", "do", "Infobox rail service"]).collect())
    first = [(0, 0, "see", [("content", "{{convert|1|km|abbr=on}} [[A|B]]"), ("name", "X")]), (0, 1, "do", [("name", "Y")])]
    assert found[:4] == sorted(first * 2)
    assert [f[1:] for f in found if f[0] == 1] == [(0, "see", [("name", "{{do|name=inner}}"), ("x", "3")]), (1, "do", [("name", "inner")])]
    assert [f[1:] for f in found if f[0] == 2] == [(0, "see", [("name", "open {{do|name=shut}}")]), (1, "do", [("name", "shut")])]
    assert [f[1:] for f in found if f[0] == 3] == [(0, "see", [])]
    assert [f[1:] for f in found if f[0] == 4] == [(0, "see", [("a", "[[x|b=1")]), (1, "do", [("c", "2]]"), ("d", "3")])]
    assert [f[1:] for f in found if f[0] == 8] == [(0, "infobox rail service", [("name", "R")])]
    assert markup.listings(df.limit(0), ["see"]).count() == 0


def test_clean_and_shorten(spark):
    told = ["#3. A ''b'' {{x|{{y}}}} [[C|d]] &amp; [https://e.f g] [http://h] <b>i</b><ref name=q>no\nno</ref>  j<ref n/>", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(told)], "i int, t string")
    assert [r[0] for r in df.orderBy("i").select(markup.clean(F.col("t"))).collect()] == ["A b d & g i j", ""]
    long = "A sentence of some length that goes on for more than seventy letters, as it must. Then another one that is cut somewhere " + "word " * 20
    df = spark.createDataFrame([(0, long), (1, "short"), (2, "word " * 60)], "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(markup.shorten(F.col("t"))).collect()]
    assert got == [long[:81], "short", ("word " * 60)[:169] + "…"]


def test_coast_by_force(spark):
    rnd = random.Random(2)
    line = [(w, i, 10 + rnd.uniform(0, 2), 75 + w + 0.15 * i + rnd.uniform(0, 0.1)) for w in range(3) for i in range(rnd.randint(1, 8))] + [(9, 0, 11.0, 75.2), (9, 1, 11.0, 75.2)]
    points = [(i, rnd.uniform(9, 13), rnd.uniform(74, 79)) for i in range(150)] + [(900, None, 75.0), (901, 60.0, 10.0)]
    cut = coast.segments(spark.createDataFrame(line, "line int, pos int, lat double, lon double"))
    pieces = [tuple(r) for r in cut.collect()]
    found = {r["point"]: r["km"] for r in coast.coast_km(spark.createDataFrame(points, "point long, lat double, lon double"), cut).collect()}
    assert found.pop(900) is None and found[901] == math.inf and len(found) == 151
    for i, lat, lon in points[:150]:
        best = math.inf
        for x0, y0, x1, y1 in pieces:
            sees = lambda p, a, b: math.floor(min(a, b) / 0.5) - 1 <= math.floor(p / 0.5) <= math.floor(max(a, b) / 0.5) + 1
            if sees(lon, x0, x1) and sees(lat, y0, y1):
                steps = [k / 4000 for k in range(4001)]
                best = min(best, *(math.hypot((x0 + t * (x1 - x0) - lon) * 111 * math.cos(math.radians(lat)), (y0 + t * (y1 - y0) - lat) * 111) for t in steps))
        assert found[i] == best or abs(found[i] - best) < 0.05


def test_renames_to_the_end(spark):
    chain = [(i, i + 1) for i in range(60)]
    circle = [(100 + i, 100 + (i + 1) % 7) for i in range(7)] + [(200, 201), (201, 103), (300, 300), (301, 300), (None, 1), (5000, None), (0, 40)]
    df = spark.createDataFrame(chain + circle, "old long, new long")
    got = {r["old"]: r["current"] for r in resolve.rename_closure(df).collect()}
    want = {i: 60 for i in range(60)} | {100 + i: 100 + i for i in range(7)} | {200: 103, 201: 103, 300: 300, 301: 300}
    assert got == want
    assert resolve.rename_closure(df.limit(0)).count() == 0


@pytest.mark.parametrize("k,km", [(2, 3000.0), (3, 150.0)])
def test_nearest_k_by_force(spark, k, km):
    rnd = random.Random(4)
    at = lambda n: [(i, rnd.uniform(8, 30), rnd.uniform(70, 90)) for i in range(n)]
    points, stations = at(40), at(15)
    found = spatial.nearest_k(spark.createDataFrame(points, "point long, lat double, lon double"), spark.createDataFrame(stations, "station long, lat double, lon double"), k, km)
    got = {(r["point"], r["rank"]): r["station"] for r in found.collect()}
    want = {}
    for p, y, x in points:
        close = sorted((km_between((y, x), (b, a)), s) for s, b, a in stations)
        want |= {(p, i + 1): s for i, (d, s) in enumerate(close[:k]) if d <= km}
    assert got == want
