"""Files of the curated database: CSV tables, feeds, and sharded output."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import fnv1a

#: Fixed formats: the columns of each table, in order. Cells are text; readers cast at use.
TABLES = {
    "stations": "code name state lat lon coord hi local",
    "trains": "number name type days days_src src",
    "halts": "number seq station arr dep km approx",
    "paths": "number after via",
    "newer_trains": "numbers name type from to days per_week minutes km stops src",
    "overrides": "number field value reason",
    "renames": "old new old_name since",
    "station_overrides": "code field value reason",
    "retired": "number name status reason",
    "renumbered": "old new name since",
}
#: Parts of a sharded output.
SHARDS = 32


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table as text columns; a missing file is an empty table, a malformed row an error."""
    schema = ", ".join(f"`{c}` string" for c in TABLES[name].split())
    try:
        return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(f"{folder}/{name}.csv")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def write_table(df: DataFrame, folder: str, name: str) -> None:
    """The table's columns in their order; columns that df lacks and nulls are empty cells."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) if c in df.columns else F.lit("") for c in TABLES[name].split()]
    named = [x.alias(c) for x, c in zip(cells, TABLES[name].split(), strict=True)]
    df.select(*named).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(f"{folder}/{name}.csv")


def read_feed(spark: SparkSession, path: str, number: str, order: str) -> DataFrame:
    """A public schedule feed: rows whose train number and order are digits, numbers filled to five."""
    raw = spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path)
    digits = F.trim(F.col(number)).rlike(r"^\d+$") & F.trim(F.col(order)).rlike(r"^\d+$")
    return raw.filter(digits).withColumn(number, F.lpad(F.trim(F.col(number)), 5, "0")).withColumn(order, F.trim(F.col(order)).cast("int"))


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """One row for each feature of a GeoJSON file: its properties as text, lon and lat of points."""
    schema = "features array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:array<double>>>>"
    f = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    at = F.col("f.geometry.coordinates")
    return f.select(F.col("f.properties").alias("properties"), F.try_element_at(at, F.lit(1)).alias("lon"), F.try_element_at(at, F.lit(2)).alias("lat"))


def read_gazetteer(spark: SparkSession, path: str, fields: dict[str, int], country: int, code: str) -> DataFrame:
    """Positions of a headless tab-separated file as named columns, of one country."""
    raw = spark.read.option("sep", "\t").option("quote", "").csv(path)
    return raw.filter(F.col(f"_c{country}") == code).select(*[F.col(f"_c{i}").alias(n) for n, i in fields.items()])


def split_codes(df: DataFrame, column: str) -> DataFrame:
    """One row for each code of a cell like 'a;b'."""
    codes = F.transform(F.split(F.upper(F.col(column)), ";"), lambda x: F.trim(x))
    return df.withColumn(column, F.explode(F.filter(codes, lambda x: x != "")))


def write_shards(df: DataFrame, path: str, key: str, shards: int = SHARDS) -> None:
    """JSON lines in folders shard=0 to shard=31 by the key's FNV-1a hash."""
    sharded = df.withColumn("shard", (fnv1a(F.col(key)) % shards).cast("int"))
    sharded.repartition("shard").write.mode("overwrite").partitionBy("shard").json(path)


def lookup(spark: SparkSession, path: str, schema: str, key: str, value: str, shards: int = SHARDS) -> DataFrame:
    """The rows of one key; only its shard is read."""
    h = 2166136261
    for b in value.encode():
        h = (h ^ b) * 16777619 % 4294967296
    rows = spark.read.schema(f"{schema}, shard int").json(path)
    return rows.filter((F.col("shard") == h % shards) & (F.col(key) == value)).drop("shard")


def write_urls(df: DataFrame, column: str, path: str) -> None:
    df.select(F.col(column).cast("string").alias("value")).write.mode("overwrite").text(path)
