"""Guides, towns without a station and small sentences, by hand-made cases."""

from pyspark.sql import functions as F

from kursbuch.functions import climate, labels
from kursbuch.operators import guides

PLACES = "place int, name string, is_city boolean"
CITIES = "place int, title string"
LINKS = "place int, pos int, title string, nearby array<string>"
ARTICLES = "title string, appeal int, icon boolean"


def index(spark, places, cities, links, articles):
    got = guides.guide_index(spark.createDataFrame(places, PLACES), spark.createDataFrame(cities, CITIES), spark.createDataFrame(links, LINKS), spark.createDataFrame(articles, ARTICLES))
    return {r["place"]: (r["title"], r["featured"], list(r["nearby"])) for r in got.collect()}


def test_a_sight_stands_for_the_place_beside_it(spark):
    places = [(1, "Hosapete", False), (2, "Kalka", False), (3, "Big City", True), (4, "Nowhere", False), (5, "Hampi Halt", False)]
    links = [
        (1, 0, "Hosapete", ["Hampi", "Far"]), (2, 0, "Kalka", ["Hampi"]), (3, 0, "Hosapete", ["Hampi"]), (4, 0, "Unknown", []), (5, 0, None, ["Hampi", "Hampi"]),
    ]
    articles = [("Hosapete", 3, True), ("Hampi", 30, True), ("Kalka", 9, True), ("Big City", 90, True), ("Far", 1, False)]
    got = index(spark, places, [(3, "Big City"), (1, "Big City")], links, articles)
    # 3 * 3.5 + 10 is below 30; 9 * 3.5 + 10 is above
    assert got[1] == ("Hampi", True, ["Far"]) and got[2] == ("Kalka", False, ["Hampi"])
    assert got[3] == ("Big City", False, ["Hampi"]) and 4 not in got and got[5] == ("Hampi", False, [])


def test_a_place_s_own_guide_is_not_borrowed(spark):
    places, links = [(1, "A", False), (2, "Star", False)], [(1, 0, "A", ["Star"]), (2, 0, "Star", None)]
    assert index(spark, places, [], links, [("A", 0, True), ("Star", 40, True)])[1] == ("A", False, ["Star"])
    assert index(spark, [], [], [], []) == {}


def test_stationless(spark):
    towns = spark.createDataFrame(
        [(1, "Ooty!", 1, 5, 11.0, 76.0), (2, "Ooty", 1, 9, 12.0, 76.0), (3, "Near", 1, 1, 20.0, 75.01), (4, "Hill", 2, 7, 25.0, 80.0), (5, "Ooty", 2, 1, 13.0, 76.0), (6, None, 1, 1, 14.0, 76.0)],
        "town long, name string, state int, population long, lat double, lon double",
    )
    at = "lat double, lon double"
    stations = spark.createDataFrame([(20.0, 75.0), (None, None)], at)
    own = spark.createDataFrame([("HILL", 25.1, 80.0), ("Ooty", 40.0, 76.0)], "name string, " + at)
    assert {r["town"] for r in guides.stationless(towns, stations, own).collect()} == {2, 5, 6}


def test_nearest_start(spark):
    points = spark.createDataFrame([(1, 20.0, 75.0), (2, 21.0, 75.0), (3, 50.0, 0.0), (4, None, 1.0)], "point long, lat double, lon double")
    starts = spark.createDataFrame([(10, 5, 20.01, 75.0), (11, 90, 20.1, 75.0), (12, 900, 20.3, 75.0)], "station long, halts long, lat double, lon double")
    assert {(r["point"], r["station"]) for r in guides.nearest_start(points, starts).collect()} == {(1, 11), (2, 12)}


def test_changes_shown(spark):
    changes = spark.createDataFrame([(1, 300, 7), (2, 200, 7), (2, 250, 8), (2, 100, 9), (2, 110, 9), (2, 261, 1), (3, 900, 2)], "place int, total int, via int")
    direct = spark.createDataFrame([(1, 359), (2, 400)], "place int, fastest int")
    got = {(r["place"], r["total"]) for r in guides.changes_shown(changes, direct).collect()}
    assert got == {(2, 100), (2, 110), (2, 200), (3, 900)}


def test_when_line(spark):
    years = [("BBBBBBBBGGGG",), ("BBRMHHWWWRBB",), ("GMMMMMMMMMMG",), ("BMMMMMMMMMMM",), ("BMBMMMMMMMMM",), ("",), (None,), ("CCC",)]
    df = spark.createDataFrame(years, "letters string")
    assert [r[0] for r in df.select(climate.when_line(F.col("letters"))).collect()] == [
        "Good all year round: go whenever you like.",
        "Best from November to February. July to September: the monsoon pours. May to June: too hot for most, carry water.",
        "Best from December to January.", "Best from January.", "Best from March and January.", "", "", "",
    ]


def test_photos(spark):
    rows = [("http://x/330px-a.jpg", 1000, 400), ("http://x/330px-a.jpg", 100, 400), ("http://x/330px-a.jpg", None, 5000), ("http://x/a.jpg", 900, 10), ("http://x/330px-a.jpg", 500, 500)]
    df = spark.createDataFrame(rows, "t string, w int, want int")
    got = [r[0] for r in df.select(labels.photo_url(F.col("t"), F.col("w"), F.col("want"))).collect()]
    assert got == ["http://x/500px-a.jpg", "http://x/330px-a.jpg", "http://x/1920px-a.jpg", "http://x/a.jpg", "http://x/330px-a.jpg"]
    who = spark.createDataFrame([("Ann", None, None), ("unknown", "CC0", None), (None, None, "A_b.jpg"), ("", "", None)], "by string, lic string, file string")
    assert [r[0] for r in who.select(labels.credit(F.col("by"), F.col("lic"), F.col("file"))).collect()] == ["Ann", "Unknown author, CC0", "A b · Wikimedia Commons", "photo · Wikimedia Commons"]
