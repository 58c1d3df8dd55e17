"""Guides of places, towns without a station, and ways to reach them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from . import spatial

#: Fame from which a sight may stand for the place beside it, and how far it must lead.
STAR_FAME = 12
OWN_TOWN, OTHER_TOWN = (3.5, 10), (1.8, 4)
#: A town within 8 km of a station has one; a guide of its name within 30 km is its own.
STATION_KM, GUIDE_KM = 8.0, 30.0
#: Minutes to leave a train for a car; how far behind the best a way by road may be.
TRANSFER, BEHIND, SLACK = 30, 1.4, 120


def guide_index(places: DataFrame, city_guides: DataFrame, links: DataFrame, articles: DataFrame) -> DataFrame:
    """place, title, featured, nearby: the guide that each place shows.

    places: place, name, is_city. city_guides: place, title. links, one for each station: place, pos,
    title (may be null), nearby (array). articles: title, appeal, icon. A place shows its city's guide or the
    first of its stations'; a famous sight nearby, which is no place's own guide, takes its place
    when its appeal leads by the margin. Titles without an article do not count."""
    known = articles.select("title", "appeal", "icon")
    city = city_guides.join(places.filter("is_city").select("place"), "place", "left_semi").select("place", F.lit(-1).cast("long").alias("pos"), "title")
    own = city.union(links.select("place", F.col("pos").cast("long"), "title")).join(known, "title")
    own = own.groupBy("place").agg(F.min(F.struct("pos", "title", "appeal")).alias("own")).select("place", F.col("own.title").alias("own"), F.col("own.appeal").alias("own_appeal"))
    near = links.select("place", F.col("pos").cast("long").alias("pos"), F.posexplode("nearby").alias("nth", "title"))
    near = near.groupBy("place", "title").agg(F.min(F.struct("pos", "nth")).alias("at")).join(known, "title")
    near = near.join(own.select("place", "own"), "place", "left").filter(~F.col("title").eqNullSafe(F.col("own"))).drop("own")
    star = near.filter("icon").join(own.select(F.col("own").alias("title")).distinct(), "title", "left_anti")
    star = star.groupBy("place").agg(F.min(F.struct((-F.col("appeal")).alias("fame"), "at", "title")).alias("s"))
    star = star.select("place", F.col("s.title").alias("star"), (-F.col("s.fame")).alias("star_appeal"))
    rows = places.join(own, "place", "left").join(star, "place", "left")
    names = lambda title: F.contains(F.lower("name"), F.lower(title))
    mine = F.coalesce("own_appeal", F.lit(0))
    margin = F.when(F.coalesce(names("own"), F.lit(False)), mine * OWN_TOWN[0] + OWN_TOWN[1]).otherwise(mine * OTHER_TOWN[0] + OTHER_TOWN[1])
    wins = F.coalesce(~F.col("is_city") & (F.col("star_appeal") >= STAR_FAME) & (F.col("star_appeal") > margin), F.lit(False))
    rows = rows.select("place", F.when(wins, F.col("star")).otherwise(F.col("own")).alias("title"), (wins & (F.col("own").isNotNull() | ~names("star"))).alias("featured"))
    rows = rows.filter("title is not null")
    others = near.select("place", "at", F.col("title").alias("other")).join(rows.select("place", "title"), "place").filter("other <> title")
    nth = F.row_number().over(Window.partitionBy("place").orderBy("at"))
    # no more than four of a place are gathered
    others = others.withColumn("n", nth).filter("n <= 4").groupBy("place").agg(F.sort_array(F.collect_list(F.struct("n", "other"))).alias("o"))
    rows = rows.join(others, "place", "left")
    return rows.select("place", "title", "featured", F.coalesce(F.col("o.other"), F.array().cast("array<string>")).alias("nearby"))


def letters_of(name: Column) -> Column:
    """A name's letters, for comparison."""
    return F.regexp_replace(F.lower(name), "[^a-z]", "")


def stationless(towns: DataFrame, stations: DataFrame, guides: DataFrame) -> DataFrame:
    """Towns that no station serves and no guide of the same name covers; of the same name in a state
    the most populous, after the others have left.

    towns: town, name, state, population, lat, lon. stations: lat, lon. guides: name, lat, lon."""
    served = geo.near(towns, stations, STATION_KM, ["town"], []).select("town").distinct()
    rows = towns.join(served, "town", "left_anti").withColumn("key", letters_of(F.col("name")))
    covers = guides.select(letters_of(F.col("name")).alias("key"), F.col("lat").alias("g_lat"), F.col("lon").alias("g_lon"))
    close = geo.haversine(F.col("lat"), F.col("lon"), F.col("g_lat"), F.col("g_lon")) < GUIDE_KM
    covered = rows.join(covers, "key").filter(close).select("town").distinct()
    order = Window.partitionBy("key", "state").orderBy(F.col("population").desc(), "town")
    rows = rows.join(covered, "town", "left_anti").withColumn("nth", F.row_number().over(order))
    return rows.filter("nth = 1").select("town", "name", "state", "population", "lat", "lon")


def nearest_start(points: DataFrame, starts: DataFrame) -> DataFrame:
    """point, station, km: of the stations within 25 km the busiest, else the closest within 150 km.

    points: point, lat, lon. starts: station, halts, lat, lon. Distances are measured on a plane at the
    point's latitude. Points with none have no row. Points of one position are asked once; unless all are few, they look close by
    first and twice as far where that leaves them without."""
    left, out = spatial.positions(points), None
    # of the stations of a position the busiest counts where it is close, and else the lowest
    least = lambda *keys: F.min(F.struct(*keys))
    both = starts.groupBy("lat", "lon").agg(least((-F.col("halts")).alias("busy"), "station").alias("busiest"), F.min("station").alias("lowest"))
    to = both.withColumn("s_lat", F.col("lat")).withColumn("s_lon", F.col("lon")).checkpoint()
    reach = spatial.first_reach(left, to, 27.5, 160.0)
    while True:
        pairs = geo.near(left, to, reach, ["y", "x"], ["busiest", "lowest", "s_lat", "s_lon"])
        dy = (F.col("s_lat") - F.col("y")) * 111
        dx = (F.col("s_lon") - F.col("x")) * 111 * F.cos(F.radians("y"))
        pairs = pairs.withColumn("d", F.sqrt(dx * dx + dy * dy)).filter("d <= 150")
        close = F.struct(F.lit(0).alias("tier"), F.col("busiest.busy").alias("busy"), "d", F.col("busiest.station").alias("station"))
        other = F.struct(F.lit(1).alias("tier"), F.lit(0).cast("long").alias("busy"), "d", F.col("lowest").alias("station"))
        kind = "struct<tier:int,busy:bigint,d:double,station:bigint>"
        best = pairs.groupBy("y", "x").agg(F.min(F.when(F.col("d") < 25, close.cast(kind)).otherwise(other.cast(kind))).alias("best"))
        if reach < 160:
            # the plane is true to a fifteenth up to 60 degrees: what is within reach/1.067 of it has been met
            best = best.filter((F.abs("y") <= 60) & (F.col("best.d") <= reach / 1.067))
        best = best.checkpoint()
        out = best if out is None else out.union(best)
        if reach >= 160:
            break
        left = left.join(best, ["y", "x"], "left_anti").checkpoint()
        if left.isEmpty():
            break
        reach = min(2 * reach, 160.0)
    found = spatial.at_positions(points, out).groupBy("point").agg(F.min("best").alias("best"))
    return found.select("point", F.col("best.station").alias("station"), F.col("best.d").alias("km"))


def ways_by_road(spots: DataFrame, stations: DataFrame, rides: DataFrame, km: float = 350.0) -> DataFrame:
    """spot, station, train, road, total: ways to places without a station, by train to one nearby and on by
    road: the three best, none of them far behind the best.

    spots: spot, lat, lon. stations: station, place, lat, lon. rides: place, fastest. Of the stations of one place
    the one with the least total stands for it. Spots of one position are asked once; unless all are few, they look close by first,
    and twice as far until what is farther away cannot be among the three."""
    # stations of a place and a position have the same total: the lowest counts
    to = stations.join(rides, "place").groupBy("place", "fastest", "lat", "lon").agg(F.min("station").alias("station")).checkpoint()
    left, out, quickest = spatial.positions(spots), None, to.agg(F.min("fastest")).first()[0]
    hills, reach = geo.is_hilly(F.col("y"), F.col("x")), spatial.first_reach(left, to, 45.0, km) if quickest is not None else km
    way, at = F.min(F.struct("total", "station", "train", "road")).alias("w"), Window.partitionBy("y", "x")

    def three(one: DataFrame, *key: str) -> DataFrame:
        of = Window.partitionBy(*key)
        one = one.withColumn("nth", F.row_number().over(of.orderBy("total", "station"))).withColumn("best", F.min("total").over(of))
        return one.filter((F.col("nth") <= 3) & (F.col("total") <= F.col("best") * BEHIND + SLACK))

    while True:
        pairs = geo.near(left, to, reach, ["y", "x"], ["station", "place", "fastest"])
        ways = pairs.select("y", "x", "station", "place", F.col("fastest").alias("train"), geo.road_minutes(F.col("km"), hills).cast("long").alias("road"))
        ways = ways.withColumn("total", F.col("train") + TRANSFER + F.col("road"))
        found = three(ways.groupBy("y", "x", "place").agg(way).select("y", "x", "place", "w.*"), "y", "x")
        if reach < km:
            # stations farther away have a total of this at least, and cannot come before the third or are too far behind
            beyond = geo.road_minutes(F.lit(reach), F.lit(False)) + F.lit(quickest + TRANSFER)
            third = F.max(F.when(F.col("nth") == 3, F.col("total"))).over(at)
            found = found.withColumn("enough", F.least(third, F.col("best") * BEHIND + SLACK)).filter(beyond > F.col("enough")).drop("enough")
        found = found.drop("nth", "best").checkpoint()
        out = found if out is None else out.union(found)
        if reach >= km:
            break
        left = left.join(found, ["y", "x"], "left_anti").checkpoint()
        if left.isEmpty():
            break
        reach = min(2 * reach, km)
    each = spatial.at_positions(spots, out, "spot").repartition("spot").groupBy("spot", "place").agg(way).select("spot", "w.*")
    return three(each, "spot").select("spot", "station", "train", "road", "total")


def changes_shown(changes: DataFrame, direct: DataFrame) -> DataFrame:
    """The one-change rides worth showing beside a direct train: none where that takes under six hours, else
    the three quickest that save a fifth and an hour. Places without a direct train keep all.

    changes: place, total and more. direct: place, fastest."""
    d = direct.select("place", F.col("fastest").alias("_direct"))
    rows = changes.join(d, "place", "left")
    quick = rows.filter(F.col("_direct").isNull() | ((F.col("_direct") >= 360) & (F.col("total") < F.col("_direct") * 0.8 - 60)))
    nth = F.row_number().over(Window.partitionBy("place").orderBy("total", *[c for c in changes.columns if c not in ("place", "total")]))
    return quick.withColumn("_nth", nth).filter("_direct is null or _nth <= 3").drop("_nth", "_direct")


def surprise(pool: DataFrame, seed: int) -> DataFrame:
    """One place, at random by the root of its appeal: the least exponential key wins, so a seed gives the
    same place however the rows lie. pool: place, appeal."""
    digits = F.substring(F.md5(F.concat_ws(":", F.col("place").cast("string"), F.lit(str(seed)))), 1, 13)
    u = (F.conv(digits, 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))
    key = -F.log(u) / F.sqrt(1.0 + F.col("appeal"))
    return pool.withColumn("_key", key).orderBy("_key", "place").limit(1).select("place", "appeal")
