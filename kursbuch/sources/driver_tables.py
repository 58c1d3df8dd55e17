"""The driver's tables read as a timetable.

An order is a trip, its lines the halts, suppliers are stations, nations places, regions states.
All rules are integer arithmetic, so every engine gets the same rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The train type that stands for each order priority.
TYPES = {"1-URGENT": "Superfast", "2-HIGH": "Express", "3-MEDIUM": "Pass", "4-NOT SPECIFIED": "MEMU", "5-LOW": "Toy"}


@dataclass
class Network:
    """Canonical tables: halts, trips, stations, places. Plans are built once and stay lazy."""

    spark: SparkSession
    path: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    @cached_property
    def halts(self) -> DataFrame:
        """trip, seq, station, arr, dep, km: one shuffle by trip; every trip has two halts or more."""
        return self._halts(self.table("lineitem"))

    @staticmethod
    def _halts(lines: DataFrame) -> DataFrame:
        order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_shipdate", "l_partkey", "l_suppkey")
        run = order.rowsBetween(Window.unboundedPreceding, 0)
        q = F.col("l_quantity").cast("long")
        cents = F.round(F.col("l_extendedprice") * 100).cast("long")
        rows = lines.select(
            F.col("l_orderkey").alias("trip"),
            (F.row_number().over(order) - 1).cast("long").alias("seq"),
            F.col("l_suppkey").alias("station"),
            (17 * F.sum(q).over(run)).alias("at"),
            (q % 6).alias("dwell"),
            F.floor(F.sum(cents).over(run) / 100000).alias("km"),
            F.count("*").over(Window.partitionBy("l_orderkey")).alias("n"),
        )
        return rows.filter("n >= 2").select(
            "trip",
            "seq",
            "station",
            F.when(F.col("seq") > 0, F.col("at")).alias("arr"),
            F.when(F.col("seq") < F.col("n") - 1, F.col("at") + F.col("dwell")).alias("dep"),
            "km",
        )

    @cached_property
    def trips(self) -> DataFrame:
        """trip, days (bit 0 = Monday; 0 = unknown), type."""
        kinds = F.create_map(*[F.lit(x) for pair in TYPES.items() for x in pair])
        return self.table("orders").select(
            F.col("o_orderkey").alias("trip"),
            (F.col("o_orderkey") % 128).cast("int").alias("days"),
            kinds[F.col("o_orderpriority")].alias("type"),
        )

    @cached_property
    def stations(self) -> DataFrame:
        """station, place, state, lat, lon."""
        nation = self.table("nation").select(F.col("n_nationkey").alias("place"), F.col("n_regionkey").alias("state"))
        key = F.col("s_suppkey")
        return (
            self.table("supplier")
            .select(
                key.alias("station"),
                F.col("s_nationkey").alias("place"),
                (8 + (key * 37 % 290) / 10.0).alias("lat"),
                (68 + (key * 53 % 290) / 10.0).alias("lon"),
            )
            .join(nation, "place")
            .select("station", "place", "state", "lat", "lon")
        )

    @cached_property
    def placed(self) -> DataFrame:
        """halts with their place."""
        return self.halts.join(self.stations.select("station", "place"), "station")

    @cached_property
    def ends(self) -> DataFrame:
        """trip, a, b: the stations of the first and the last of the placed halts, without numbering them."""
        here = self.stations.select(F.col("station").alias("l_suppkey")).distinct()
        lines = self.table("lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey")
        at = F.struct("l_linenumber", "l_shipdate", "l_partkey", "l_suppkey")
        # lines of unknown stations are rare: only if there are any, all lines are joined
        if not lines.select("l_suppkey").distinct().join(here, "l_suppkey", "left_anti").isEmpty():
            lines = lines.join(here.withColumn("known", F.lit(True)), "l_suppkey", "left")
            at = F.when(F.col("known"), at)
        # by trip at once: hardly any rows of a trip meet before, and two places a row would be shuffled for one
        rows = lines.repartition("l_orderkey").groupBy(F.col("l_orderkey").alias("trip")).agg(F.min(at).alias("a"), F.max(at).alias("b"), F.count("*").alias("n"))
        return rows.filter("n >= 2 and a is not null").select("trip", F.col("a.l_suppkey").alias("a"), F.col("b.l_suppkey").alias("b"))

    def through(self, place: int) -> DataFrame:
        """placed, of the trips that call at the place: found first, so only these are sorted and numbered."""
        key = f"_through_{place}"
        if key not in self.__dict__:
            lines = self.table("lineitem")
            here = self.stations.filter(F.col("place") == place).select(F.col("station").alias("l_suppkey"))
            trips = lines.select("l_orderkey", "l_suppkey").join(here, "l_suppkey", "left_semi").select("l_orderkey").distinct()
            halts = self._halts(lines.join(trips, "l_orderkey", "left_semi"))
            self.__dict__[key] = halts.join(self.stations.select("station", "place"), "station")
        return self.__dict__[key]

    @cached_property
    def trains_at(self) -> DataFrame:
        """place, halts: halts of all its stations."""
        # counted by station first; a trip of one line is no trip
        lines = self.table("lineitem").select("l_orderkey", "l_suppkey")
        single = lines.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.min("l_suppkey").alias("station")).filter("n = 1").groupBy("station").agg(F.count("*").alias("less"))
        counts = lines.groupBy(F.col("l_suppkey").alias("station")).agg(F.count("*").alias("n")).join(single, "station", "left")
        counts = counts.withColumn("halts", F.col("n") - F.coalesce("less", F.lit(0))).filter("halts > 0")
        return counts.join(self.stations.select("station", "place"), "station").groupBy("place").agg(F.sum("halts").alias("halts"))

    @cached_property
    def hub(self) -> int:
        """The place with the most halts, the lowest of equals."""
        return self._nth_place(0)

    @cached_property
    def second(self) -> int:
        return self._nth_place(1)

    def _nth_place(self, n: int) -> int:
        # Places are a bounded dimension; only the first rows of their order come to the driver.
        rows = self.trains_at.orderBy(F.col("halts").desc(), "place").limit(n + 1).collect()
        return rows[min(n, len(rows) - 1)]["place"] if rows else -1
