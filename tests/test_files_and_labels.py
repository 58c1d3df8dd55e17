"""Files in their fixed formats, and the naming columns by example."""

from pyspark.sql import functions as F

from kursbuch.functions import labels
from kursbuch.sources import files


def test_tables_round_trip(spark, tmp_path):
    folder = str(tmp_path)
    assert files.read_table(spark, folder, "halts").count() == 0
    df = spark.createDataFrame([("00001", 1, "10:00", None)], "number string, seq int, dep string, km double")
    files.write_table(df, folder, "halts")
    back = files.read_table(spark, folder, "halts")
    assert back.columns == files.TABLES["halts"].split()
    row = back.first()
    assert row["number"] == "00001" and row["seq"] == "1" and row["dep"] == "10:00" and not row["km"] and not row["arr"]


def test_feed_drops_malformed_rows(spark, tmp_path):
    (tmp_path / "f.csv").write_text("Train No,SEQ,name\n 107 ,1,a\nxx,2,b\n12627,z,c\n12627,3,d\n")
    got = files.read_feed(spark, str(tmp_path / "f.csv"), "Train No", "SEQ").collect()
    assert [(r["Train No"], r["SEQ"], r["name"]) for r in got] == [("00107", 1, "a"), ("12627", 3, "d")]


def test_features_and_codes(spark, tmp_path):
    (tmp_path / "g.json").write_text('{"features": [{"properties": {"ref": "ab; c"}, "geometry": {"type": "Point", "coordinates": [77.5, 12.9]}}, {"properties": {"ref": ""}, "geometry": null}]}')
    f = files.read_features(spark, str(tmp_path / "g.json")).select(F.col("properties")["ref"].alias("ref"), "lat", "lon")
    assert [tuple(r) for r in files.split_codes(f, "ref").collect()] == [("AB", 12.9, 77.5), ("C", 12.9, 77.5)]


def test_gazetteer(spark, tmp_path):
    (tmp_path / "g.tsv").write_text("1\tOoty\tIN\n2\tKandy\tLK\n")
    assert [tuple(r) for r in files.read_gazetteer(spark, str(tmp_path / "g.tsv"), {"name": 1}, 2, "IN").collect()] == [("Ooty",)]


def test_shards_are_pruned(spark, tmp_path):
    df = spark.createDataFrame([("Mysore", 1), ("Hampi", 2), ("मैसूरु", 3)], "title string, n int")
    files.write_shards(df, str(tmp_path / "s"), "title")
    got = files.lookup(spark, str(tmp_path / "s"), "title string, n int", "title", "मैसूरु")
    assert [r["n"] for r in got.collect()] == [3]
    assert "PartitionFilters: [isnotnull(shard" in got._jdf.queryExecution().toString()
    files.write_urls(df, "title", str(tmp_path / "u"))
    assert spark.read.text(str(tmp_path / "u")).count() == 3


def test_labels(spark):
    row = spark.range(1).select(
        labels.infer_type(F.lit("12007"), F.lit("Jan Shatabdi Exp")).alias("a"),
        labels.infer_type(F.lit("06001"), F.lit("Special")).alias("b"),
        labels.infer_type(F.lit("12627"), F.lit("Karnataka")).alias("c"),
        labels.is_suburban(F.lit("12345"), F.lit("Howrah MEMU")).alias("d"),
        labels.is_suburban(F.lit("12345"), F.lit("Andheri LOCAL")).alias("e"),
        labels.weather(F.lit(63)).alias("f"),
        labels.weather(F.lit(95)).alias("g"),
        labels.minutes_text(F.lit(520)).alias("h"),
        labels.indian_number(F.lit(12345678)).alias("i"),
        labels.indian_number(F.lit(999)).alias("j"),
        labels.parse_roads(F.lit("SBC 12 30;@BLR 40 55")).alias("k"),
        labels.parse_roads(F.lit("")).alias("l"),
        labels.parse_roads(F.lit(None).cast("string")).alias("m"),
        labels.told_in(F.lit("In 1853, 34 km"), F.lit("34 kilometres in 1853")).alias("n"),
        labels.told_in(F.lit("no numbers"), F.lit("x")).alias("o"),
        labels.strip_html(F.lit("<b>a</b>  b\n")).alias("p"),
        labels.thumbnail(F.lit("Taj Mahal.svg")).alias("q"),
        labels.same_ends(F.lit("a"), F.lit("b"), F.lit("b"), F.lit("a")).alias("r"),
    ).first()
    assert (row["a"], row["b"], row["c"], row["d"], row["e"], row["f"], row["g"]) == ("JShtb", "Spl", "SF", False, True, "Rain", "Thunderstorms")
    assert (row["h"], row["i"], row["j"]) == ("8h 40m", "1,23,45,678", "999")
    assert {k: tuple(v) for k, v in row["k"].items()} == {"SBC": (12, 30), "@BLR": (40, 55)} and row["l"] == {} and row["m"] is None
    assert (row["n"], row["o"], row["p"], row["r"]) == (True, False, "a b", True)
    assert row["q"].endswith("/Taj_Mahal.svg/330px-Taj_Mahal.svg.png")
