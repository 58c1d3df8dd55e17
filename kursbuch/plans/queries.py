"""The timetable queries of __spark_entry__.py, over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions import climate, geo, labels, travel
from ..functions import text as tx
from ..operators import book, coast, graph, guides, lines, markup, merge, names, normals, plan, ranking, reach, regions, repair, resolve, saves, spatial, track
from ..sources import binary, shapes
from ..sources.driver_tables import TYPES, Network

#: Week minute of the questions that ask from now on: Thursday 14:05.
NOW = 3 * 1440 + 845
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[Network], DataFrame]) -> Callable[[Network], DataFrame]:
    QUERIES[f.__name__] = lambda spark, sf_dir: f(Network(spark, sf_dir))
    return f


def _legs_out(n: Network) -> DataFrame:
    return reach.departures(n.through(n.hub), n.hub).join(n.trips, "trip")


def _legs_in(n: Network, dest: int) -> DataFrame:
    return reach.arrivals(n.through(dest), dest).join(n.trips, "trip")


@query
def departures_from_place(n: Network) -> DataFrame:
    return reach.destinations(reach.departures(n.through(n.hub), n.hub))


@query
def departure_legs(n: Network) -> DataFrame:
    return reach.departures(n.through(n.hub), n.hub).select("trip", "place", "from_seq", "to_seq", "dep", "dur", "km", "halts")


@query
def arrivals_to_place(n: Network) -> DataFrame:
    return reach.destinations(reach.arrivals(n.through(n.hub), n.hub))


@query
def arrival_legs(n: Network) -> DataFrame:
    return reach.arrivals(n.through(n.hub), n.hub).select("trip", "place", "from_seq", "to_seq", "dep", "dur", "km", "halts")


@query
def arrivals_mirror_departures(n: Network) -> DataFrame:
    """The fastest ride between hub and second place, from both ends."""
    out = reach.departures(n.through(n.hub), n.hub).filter(F.col("place") == n.second).agg(F.min("dur").alias("by_departures"))
    into = reach.arrivals(n.through(n.second), n.second).filter(F.col("place") == n.hub).agg(F.min("dur").alias("by_arrivals"))
    return out.join(into, F.lit(True)).withColumn("same", F.col("by_departures") == F.col("by_arrivals"))


@query
def reach_within_kind(n: Network) -> DataFrame:
    return reach.reachable(reach.passing(_legs_out(n), within=2000, kind="local"))[0]


@query
def reach_trips(n: Network) -> DataFrame:
    return reach.reachable(reach.passing(_legs_out(n), within=3000, leave="6h", now=NOW))[1]


@query
def wait_next_departure(n: Network) -> DataFrame:
    legs = reach.soonest(_legs_out(n), NOW)
    return legs.groupBy("trip", "from_seq").agg(F.min("wait").alias("wait"))


@query
def overnight_legs(n: Network) -> DataFrame:
    return reach.passing(_legs_out(n), 10**6, leave="overnight").select("trip", "place", "dep", "dur")


@query
def weekend_legs(n: Network) -> DataFrame:
    return reach.passing(_legs_out(n), 10**6, leave="weekend").select("trip", "place", "dep", "dur", "days")


@query
def running_days_shifted(n: Network) -> DataFrame:
    first = n.halts.groupBy("trip").agg(F.max("dep").alias("dep"))
    rows = first.join(n.trips, "trip").withColumn("on", cal.boards_on(F.col("days"), F.col("dep")))
    return rows.groupBy("days", "on", cal.days_label(F.col("on")).alias("label")).agg(F.count("*").alias("trips"))


@query
def soonest_departures(n: Network) -> DataFrame:
    legs = reach.soonest(_legs_out(n), NOW)
    return legs.orderBy("wait", "trip", "place").limit(50).select("trip", "place", "wait", "dur")


@query
def direct_trip_counts(n: Network) -> DataFrame:
    return reach.arrivals(n.through(n.hub), n.hub).groupBy("place").agg(F.countDistinct("trip").alias("trips"), F.min("dur").alias("fastest"))


@query
def network_edges(n: Network) -> DataFrame:
    return lines.edges(n.halts)


@query
def station_halt_counts(n: Network) -> DataFrame:
    return lines.station_counts(n.halts)


@query
def delta_encode(n: Network) -> DataFrame:
    return lines.delta_encode(n.halts)


@query
def delta_decode_roundtrip(n: Network) -> DataFrame:
    back = lines.delta_decode(lines.delta_encode(n.halts))
    both = n.halts.join(back.select("trip", "seq", F.col("arr").alias("a2"), F.col("dep").alias("d2"), F.col("km").alias("k2")), ["trip", "seq"])
    same = F.col("arr").eqNullSafe(F.col("a2")) & F.col("dep").eqNullSafe(F.col("d2")) & F.col("km").eqNullSafe(F.col("k2"))
    return both.agg(F.count("*").alias("halts"), F.sum(F.when(same, 0).otherwise(1)).alias("wrong"))


@query
def day_roll_forward(n: Network) -> DataFrame:
    return lines.roll_forward(n.halts)


@query
def validate_halts(n: Network) -> DataFrame:
    broken = n.halts.withColumn("km", F.when(F.col("trip") % 97 == 0, -F.col("km")).otherwise(F.col("km")))
    broken = broken.withColumn("arr", F.when((F.col("trip") % 89 == 0) & (F.col("seq") == 0), F.lit(0)).otherwise(F.col("arr")))
    return lines.validate(broken)


@query
def apply_overrides(n: Network) -> DataFrame:
    s = n.stations.select("station", "state", "lat")
    changes = n.stations.filter("station % 7 = 0").select("station", F.lit("lat").alias("field"), (F.col("lat") + 0.5).cast("string").alias("value"), F.lit(1).alias("pos"))
    more = n.stations.filter("station % 14 = 0").select("station", F.lit("state").alias("field"), F.lit("9").alias("value"), F.lit(2).alias("pos"))
    return resolve.apply_overrides(s, changes.union(more), "station", ["state", "lat"])


@query
def rename_closure(n: Network) -> DataFrame:
    renames = n.stations.filter("station % 5 <> 0").select(F.col("station").alias("old"), (F.col("station") + 1).alias("new"))
    return resolve.rename_closure(renames)


@query
def retired_anti_join(n: Network) -> DataFrame:
    retired = n.trips.filter("days = 5").select("trip")
    return resolve.without_retired(n.trips, retired).groupBy("type").agg(F.count("*").alias("trips"))


@query
def line_distance_running(n: Network) -> DataFrame:
    out = lines.line_distance(n.halts, n.stations)
    return out.select("trip", "halts", F.round("straight_km", 6).alias("straight_km"))


@query
def zigzag_outliers(n: Network) -> DataFrame:
    return lines.zigzag(n.halts, n.stations, share=0.3)


@query
def approx_islands(n: Network) -> DataFrame:
    return lines.islands(n.halts, F.col("station") % 3 == 0)


@query
def minute_at_km(n: Network) -> DataFrame:
    return lines.minute_at(n.halts, 100).select("trip", F.round("minute", 6).alias("minute"))


@query
def gap_rows(n: Network) -> DataFrame:
    return lines.gaps(n.halts)


@query
def haversine_pairs(n: Network) -> DataFrame:
    e = lines.edges(n.halts)
    s = n.stations.select("station", "lat", "lon")
    a, b = s.toDF("a", "lat1", "lon1"), s.toDF("b", "lat2", "lon2")
    d = geo.haversine(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"))
    return e.join(a, "a").join(b, "b").select("a", "b", F.round(d, 6).alias("km"))


def _points(n: Network) -> DataFrame:
    """Customers as places off the network."""
    k = F.col("c_custkey")
    return n.table("customer").select(k.alias("point"), (8 + (k * 41 % 2900) / 100.0).alias("lat"), (68 + (k * 67 % 2900) / 100.0).alias("lon"))


@query
def nearest_station(n: Network) -> DataFrame:
    return spatial.nearest(_points(n), n.stations, 350.0).select("point", "station", F.round("km", 6).alias("km"))


@query
def nearest_station_any(n: Network) -> DataFrame:
    """At any distance; ``nearest_station`` asks for those within 350 km."""
    return spatial.nearest_any(_points(n), n.stations).select("point", "station", F.round("km", 6).alias("km"))


@query
def range_join_grid(n: Network) -> DataFrame:
    found = geo.near(_points(n), n.stations, 25.0, ["point"], ["station"])
    return found.select("point", "station", F.round("km", 6).alias("km"))


@query
def idw_surface(n: Network) -> DataFrame:
    """All stations on a coarse lattice of 20 x 20, distances in degrees."""
    grid = n.spark.range(400).select(F.col("id").alias("cell"), (8 + F.floor(F.col("id") / 20) * 1.5).alias("g_lat"), (68 + (F.col("id") % 20) * 1.5).alias("g_lon"))
    samples = n.stations.select("lat", "lon", (F.col("station") % 45).cast("double").alias("v"))
    return spatial.surface(grid, samples).select("cell", F.round("value", 6).alias("value"))


@query
def idw_surface_whole(n: Network) -> DataFrame:
    """All stations on the lattice of 125 x 138, distances in cells. The map's conic projection is
    replaced by equal steps of degrees."""
    across, down = 29 / 125, 29 / 138
    grid = n.spark.range(125 * 138).select(F.col("id").alias("cell"), F.floor(F.col("id") / 125).alias("g_lat"), (F.col("id") % 125).alias("g_lon"))
    samples = n.stations.select(((F.col("lat") - 8) / down).alias("lat"), ((F.col("lon") - 68) / across).alias("lon"), (F.col("station") % 45).cast("double").alias("v"))
    return spatial.surface(grid, samples).select("cell", F.round("value", 6).alias("value"))


def _centres(n: Network) -> DataFrame:
    first = Window.partitionBy("place").orderBy("station")
    return n.stations.withColumn("nth", F.row_number().over(first)).filter("nth = 1").select("place", "lat", "lon")


@query
def same_town_places(n: Network) -> DataFrame:
    near = spatial.same_town(_centres(n), n.hub, n.stations)
    return near


def _served(n: Network) -> DataFrame:
    counts = n.halts.groupBy("station").agg(F.count("*").alias("halts"))
    return n.stations.join(counts, "station").withColumn("s_lat", F.col("lat")).withColumn("s_lon", F.col("lon"))


@query
def nearest_stations_scored(n: Network) -> DataFrame:
    return spatial.scored(_points(n), _served(n), 120.0).select("point", "station", "minutes", "score")


@query
def nearest_stations_scored_whole(n: Network) -> DataFrame:
    """Within 350 km, the operator's own reach; ``nearest_stations_scored`` asks for 120."""
    return spatial.scored(_points(n), _served(n)).select("point", "station", "minutes", "score")


@query
def nearest_stations_diverse(n: Network) -> DataFrame:
    return spatial.nearest_diverse(_points(n), _served(n))


@query
def nearest_two_airports(n: Network) -> DataFrame:
    airports = n.stations.filter("station % 10 = 3")
    return spatial.nearest_k(_points(n), airports, 2).select("point", "station", "rank", F.round("km", 6).alias("km"))


@query
def connections_one_change(n: Network) -> DataFrame:
    a, b = n.hub, n.second
    halts = n.trains_at
    return reach.connections(_legs_out(n), _legs_in(n, b), a, b, halts)


@query
def rides_on_date(n: Network) -> DataFrame:
    """Direct rides of the hub to the second place from Friday 20:00 on, first to arrive."""
    legs = _legs_out(n).filter(F.col("place") == n.second)
    ready = 4 * 1440 + 1200
    rides = reach.soonest(legs, ready).select("trip", (ready + F.col("wait")).alias("leave"), (ready + F.col("wait") + F.col("dur")).alias("arrive"), "dur")
    return rides.orderBy("arrive", "dur", "trip").limit(6)


@query
def plan_trip(n: Network) -> DataFrame:
    """Hub, second place for two nights, third place and home again, from a Friday on."""
    third = n._nth_place(2)
    legs = plan.plan_trip(n.placed, n.trips, n.trains_at, [(n.hub, 0), (n.second, 2), (third, 0), (n.hub, 0)], start_day=4)
    return n.spark.createDataFrame(legs, "leg int, a int, b int, ready long, depart long, arrive long, trips array<long>, km long")


@query
def retimed_halts(n: Network) -> DataFrame:
    """Halts whose times are taken as estimates where the station's number ends on 3, and made too quick."""
    rough = n.halts.withColumn("estimated", (F.col("station") % 10 == 3) & F.col("arr").isNotNull() & F.col("dep").isNotNull())
    rough = rough.withColumn("km", F.when(F.col("estimated"), F.col("km") + F.col("seq") * 400).otherwise(F.col("km")))
    return repair.retime(rough)


@query
def stations_in_boxes(n: Network) -> DataFrame:
    box = lambda y, x, d: [[(x, y), (x + d, y), (x + d, y + d), (x, y + d)]]
    states = {"north": box(25.0, 70.0, 12.0), "south": box(8.0, 74.0, 9.0), "hole": [*box(12.0, 76.0, 6.0), *box(13.0, 77.0, 2.0)]}
    return repair.state_of(n.stations, states).select("station", "in_state")


@query
def records_longest(n: Network) -> DataFrame:
    return lines.records(n.halts).orderBy(F.col("km").desc(), "trip").limit(1)


@query
def records_fastest(n: Network) -> DataFrame:
    r = lines.records(n.halts).filter("km >= 20").withColumn("speed", F.col("km") * 60.0 / F.col("minutes"))
    return r.orderBy(F.col("speed").desc(), "trip").limit(1).select("trip", "km", "minutes", F.round("speed", 6).alias("speed"))


@query
def records_busiest(n: Network) -> DataFrame:
    return lines.station_counts(n.halts).orderBy(F.col("halts").desc(), "station").limit(1)


def _guides(n: Network) -> DataFrame:
    return n.trains_at.select("place", (F.col("place") % 11).alias("guide"), ((F.col("place") * 7) % 40).alias("appeal"), (F.col("place") % 4 == 0).alias("is_city"), "halts")


@query
def rank_places(n: Network) -> DataFrame:
    found = reach.reachable(_legs_out(n))[0]
    own = spatial.same_town(_centres(n), n.hub, n.stations).select("place")
    out = ranking.rank_places(found, _guides(n), own)
    return out.select("guide", "place", "minutes", F.round("score", 6).alias("score"))


@query
def explore_list(n: Network) -> DataFrame:
    """One row for each guide: city before others, then fewer minutes."""
    rows = reach.reachable(_legs_out(n))[0].join(_guides(n), "place")
    order = Window.partitionBy("guide").orderBy(F.col("is_city").desc(), "fastest", "place")
    return rows.withColumn("nth", F.row_number().over(order)).filter("nth = 1").select("guide", "place", "fastest", "appeal")


@query
def slug_assignment(n: Network) -> DataFrame:
    p = n.table("part")
    places = p.select(F.concat(F.lit("P"), "p_partkey").alias("id"), F.col("p_name").alias("name"), (F.col("p_size") % 10 == 0).alias("is_city"), F.col("p_size").alias("halts"))
    return ranking.slugs(places)


def _names(n: Network) -> DataFrame:
    p = n.table("part")
    return p.select(F.col("p_partkey").alias("id"), F.lower("p_name").alias("name"), F.lower(F.concat(F.lit("p"), "p_partkey")).alias("code"), F.col("p_size").alias("halts"))


@query
def search_ladder(n: Network) -> DataFrame:
    return ranking.search_ladder(_names(n), "bl").select("id", "name", F.round("score", 6).alias("score"))


@query
def fuzzy_candidates(n: Network) -> DataFrame:
    nations = n.table("nation").select(F.col("n_nationkey").alias("id"), F.lower("n_name").alias("name"))
    return ranking.fuzzy(nations, "nation_33").select("id", "name", "slips")


@query
def train_search(n: Network) -> DataFrame:
    trains = n.table("part").select(F.lpad(F.col("p_partkey").cast("string"), 5, "0").alias("no"), F.lower("p_name").alias("name"), (F.col("p_size") > 40).alias("premium"))
    return ranking.train_search(trains, "001").union(ranking.train_search(trains, "part"))


@query
def folded_names(n: Network) -> DataFrame:
    """All words of the documents, folded."""
    words = n.table("documents").select(F.explode(F.split("text", r"[^\p{L}]+")).alias("word")).filter("word <> ''").distinct()
    return words.select("word", tx.fold(n.spark)(F.col("word")).alias("folded"))


@query
def fnv_shard(n: Network) -> DataFrame:
    h = tx.fnv1a(F.col("p_name"))
    return n.table("part").select("p_partkey", h.alias("hash"), (h % 32).alias("shard"))


def _climate(n: Network) -> DataFrame:
    """Twelve months of a made-up climate for each station."""
    m = n.stations.select("station", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("month"))
    k = F.col("station") * 13 + F.col("month") * 29
    return m.select("station", "month", (k % 31 - 8).alias("low"), (k % 31 + 6 + F.col("month")).alias("high"), (k * 7 % 340).alias("rain"))


@query
def month_letters(n: Network) -> DataFrame:
    c = _climate(n).withColumn("letter", climate.verdict(F.col("low"), F.col("high"), F.col("rain")))
    return c.select("station", "month", "letter")


@query
def month_runs(n: Network) -> DataFrame:
    c = _climate(n).withColumn("letter", climate.verdict(F.col("low"), F.col("high"), F.col("rain")))
    ordered = F.array_sort(F.collect_list(F.struct("month", "letter")))
    years = c.groupBy("station").agg(F.array_join(F.transform(ordered, lambda x: x["letter"]), "").alias("letters"))
    return climate.month_runs(years, "station")


@query
def mood_bits(n: Network) -> DataFrame:
    t = F.lower("text")
    bits = [(1, " the "), (2, " und "), (4, " les "), (8, r"[0-9]{4}"), (16, r"@")]
    total = sum((F.when(F.regexp_count(t, F.lit(p)) >= 3, b).otherwise(0) for b, p in bits), F.lit(0))
    d = n.table("documents").withColumn("moods", total)
    return d.groupBy("moods").agg(F.count("*").alias("documents"))


@query
def state_label_median(n: Network) -> DataFrame:
    """The upper median of the stations' positions by state, of states with six stations or more."""
    g = n.stations.groupBy("state").agg(F.count("*").alias("n"))
    mid = lambda c: F.row_number().over(Window.partitionBy("state").orderBy(c)) == F.floor(F.col("n") / 2) + 1
    rows = n.stations.join(g.filter("n >= 6"), "state")
    x = rows.withColumn("ok", mid("lon")).filter("ok").select("state", F.col("lon").alias("x"))
    return x.join(rows.withColumn("ok", mid("lat")).filter("ok").select("state", F.col("lat").alias("y")), "state")


@query
def sqrt_time_buckets(n: Network) -> DataFrame:
    legs = reach.departures(n.through(n.hub), n.hub)
    return legs.groupBy(cal.bucket_of(F.col("dur")).alias("bucket")).agg(F.count("*").alias("legs"), F.min("dur").alias("least"), F.max("dur").alias("most"))


@query
def symmetric_pair_lookup(n: Network) -> DataFrame:
    ends = n.placed.groupBy("trip").agg(F.min(F.struct("seq", "place")).alias("a"), F.max(F.struct("seq", "place")).alias("b"))
    pair = ends.groupBy(F.least("a.place", "b.place").alias("lo"), F.greatest("a.place", "b.place").alias("hi"))
    return pair.agg(F.count("*").alias("trips"))


@query
def places_served_by_kind(n: Network) -> DataFrame:
    """Places with a train that is no toy train, and with one that is."""
    served = n.placed.join(n.trips, "trip").groupBy("place").agg(F.max((F.col("type") != "Toy").cast("int")).alias("main_line"), F.max((F.col("type") == "Toy").cast("int")).alias("toy"))
    return served


@query
def consensus_mask(n: Network) -> DataFrame:
    claims = n.table("orders").select((F.col("o_custkey") % 50).alias("key"), (F.col("o_custkey") % 50 % 7 + F.when(F.col("o_orderkey") % 1000 == 0, 1).otherwise(0)).alias("value"))
    return resolve.consensus(claims)


@query
def renumber_match(n: Network) -> DataFrame:
    ends = n.placed.groupBy("trip").agg(F.min(F.struct("seq", "station")).alias("a"), F.max(F.struct("seq", "station")).alias("b"), F.count("*").alias("halts"))
    ends = ends.select("trip", F.col("a.station").alias("a"), F.col("b.station").alias("b"), "halts")
    return resolve.renumbered(ends.filter("trip % 2 = 0"), ends.filter("trip % 2 = 1"))


@query
def renumber_resolution(n: Network) -> DataFrame:
    """Ends within 30 km and ties by name; ``renumber_match`` and its SQL ask for equal ends and halts.
    The driver's trips have no name, so their type stands for it."""
    trips = n.ends.join(n.trips, "trip").select("trip", F.col("type").alias("name"), "a", "b")
    return resolve.renumber_resolution(trips.filter("trip % 2 = 0"), trips.filter("trip % 2 = 1"), n.stations.select("station", "lat", "lon"))


@query
def staleness_check(n: Network) -> DataFrame:
    now = n.trips.select("trip", "days")
    then = n.trips.select("trip", F.when(F.col("trip") % 50 == 0, 0).otherwise(F.col("days")).alias("days")).filter("trip % 77 <> 0")
    return resolve.stale(then, now)


def _saves(n: Network) -> DataFrame:
    e = n.table("events")
    return e.select(
        F.col("user_id").alias("user"), F.get_json_object("props", "$.k").alias("key"), F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)").alias("at"),
        (F.col("event_type") == "error").alias("deleted"), F.col("event_id").alias("data"),
    )


@query
def saves_last_writer_wins(n: Network) -> DataFrame:
    return saves.last_writer_wins(_saves(n))


@query
def saves_prune(n: Network) -> DataFrame:
    rows = _saves(n)
    now = rows.agg(F.max("at")).first()[0] or 0
    return saves.prune(saves.last_writer_wins(rows), now, ttl_ms=10 * 24 * 3600 * 1000)


@query
def track_shortest_path(n: Network) -> DataFrame:
    e = lines.edges(n.halts).join(n.stations.select(F.col("station").alias("a"), F.col("lat").alias("y1"), F.col("lon").alias("x1")), "a")
    e = e.join(n.stations.select(F.col("station").alias("b"), F.col("lat").alias("y2"), F.col("lon").alias("x2")), "b")
    e = e.select("a", "b", geo.haversine(F.col("y1"), F.col("x1"), F.col("y2"), F.col("x2")).alias("km")).filter("km <= 300")
    return graph.shortest(e, 1, 2500.0).select("node", F.round("km", 6).alias("km"))


@query
def sitemap_urls(n: Network) -> DataFrame:
    """A page for each pair of places with a direct ride, at most 30 by origin, quickest first."""
    first = n.placed.select("trip", F.col("place").alias("a"), F.col("seq").alias("s1"), "dep").filter("dep is not null")
    first = first.groupBy("trip", "a").agg(F.min(F.struct("s1", "dep")).alias("f")).select("trip", "a", "f.s1", "f.dep")
    then = n.placed.select("trip", F.col("place").alias("b"), F.col("seq").alias("s2"), "arr")
    rides = first.join(then, "trip").filter("s2 > s1 and a <> b").groupBy("a", "b").agg(F.min(F.col("arr") - F.col("dep")).alias("fastest"))
    order = Window.partitionBy("a").orderBy("fastest", "b")
    top = rides.withColumn("nth", F.row_number().over(order)).filter("nth <= 30")
    return top.select(F.concat(F.lit("/from/"), "a", F.lit("/to/"), "b").alias("url"), "fastest")


@query
def place_lenses(n: Network) -> DataFrame:
    """Places of the parts table under the mood and good-month lenses, with what makes them worth a visit."""
    k = F.col("p_partkey").cast("int")
    rows = n.table("part").select(
        F.col("p_partkey").alias("place"), (k % 32).alias("moods"), F.concat(*[F.substring(F.lit("BGRMHWC"), (k * (i + 3) % 7) + 1, F.lit(1)) for i in range(12)]).alias("letters"),
        (k % 12).alias("month"), F.when(k % 5 == 0, "wd").alias("source"), (k % 6).alias("sights"), (k * 37 % 60_000).alias("population"), (k % 3 == 0).alias("hilly"),
    )
    return rows.select(
        "place", travel.fits(F.lit(2), F.col("moods"), F.col("letters"), F.col("month"), F.lit(True)).alias("fits"), travel.good_month(F.col("letters"), F.col("month")).alias("good"),
        travel.worthwhile(F.col("source"), F.col("sights")).alias("worthwhile"), travel.wants_roads(F.col("population"), F.col("hilly")).alias("roads"),
        travel.population_doubtful(F.col("population") * 5, F.when(F.col("hilly"), "PPLA").otherwise("PPL")).alias("doubtful"),
        travel.guide_appeal(F.col("sights"), F.col("moods") % 4, F.col("hilly")).alias("appeal"),
        travel.landmark_appeal(F.array(*[(F.col("population") * i) % 61 for i in range(1, 8)])).alias("fame"),
        F.round(travel.search_lift(F.col("sights"), F.col("hilly")), 6).alias("lift"),
    )


@query
def trip_calendar(n: Network) -> DataFrame:
    """Events as moments of a trip: the week's clock, the word for the day, the date, the forecast."""
    e = n.table("events").select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), (F.col("event_id") * 61 % 4000).cast("int").alias("wait"))
    at = e.withColumn("now", F.weekday("ts") * 1440 + F.hour("ts") * 60 + F.minute("ts"))
    return at.select(
        "event_id", "now", travel.day_word(F.col("now"), F.col("wait")).alias("word"), travel.trip_day(F.to_date("ts"), F.col("wait") * 7).cast("string").alias("day"),
        travel.forecast_reaches(travel.trip_day(F.to_date("ts"), F.col("wait") * 7), F.to_date("ts")).alias("forecast"),
    )


@query
def from_places(n: Network) -> DataFrame:
    """Places with a direct train to the hub: cities first, then the quickest."""
    legs = reach.arrivals(n.through(n.hub), n.hub).groupBy("place").agg(F.min("dur").alias("fastest"), F.countDistinct("trip").alias("trips"))
    order = [(F.col("place") % 4 == 0).desc(), F.col("fastest"), F.col("place")]
    first = legs.orderBy(*order).limit(8)  # the window numbers these rows alone
    return first.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("int")).select("rank", "place", "fastest", "trips")


@query
def halts_of_note(n: Network) -> DataFrame:
    """Halts that a short view of a train shows: its ends, stays of five minutes or more, and busy stations."""
    busy = lines.station_counts(n.halts).select("station", F.col("halts").alias("at"))
    stay = F.coalesce(F.col("dep") - F.col("arr"), F.lit(0))
    rows = n.halts.join(busy, "station").filter(F.col("arr").isNull() | F.col("dep").isNull() | (stay >= 5) | (F.col("at") >= 90))
    return rows.select("trip", "seq", "station")


@query
def search_places(n: Network) -> DataFrame:
    """A misspelt query over all names: the first rules, and names with slips where fewer than three read as typed."""
    return ranking.search_forgiving(_names(n), "smlal gizmo").select("id", "name", F.round("score", 6).alias("score"), "slip")


@query
def when_lines(n: Network) -> DataFrame:
    """When to go, for each station, in words."""
    c = _climate(n).withColumn("letter", climate.verdict(F.col("low"), F.col("high"), F.col("rain")))
    ordered = F.array_sort(F.collect_list(F.struct("month", "letter")))
    years = c.groupBy("station").agg(F.array_join(F.transform(ordered, lambda x: x["letter"]), "").alias("letters"))
    return years.select("station", climate.when_line(F.col("letters")).alias("line"))


def _title(k: Column) -> Column:
    return F.concat(F.lit("g"), k.cast("string"))


@query
def guide_index(n: Network) -> DataFrame:
    """The guide of each place; suppliers are its stations, what they supply gives the articles."""
    k = F.col("n_nationkey")
    places = n.table("nation").select(k.alias("place"), F.concat(F.lit("Town G"), k * 3 % 60).alias("name"), (k % 4 == 0).alias("is_city"))
    cities = n.table("nation").select(k.alias("place"), _title(k * 3 % 60).alias("title"))
    s = F.col("s_suppkey")
    links = n.table("supplier").select(
        F.col("s_nationkey").alias("place"), s.alias("pos"), F.when(s % 3 == 0, _title(s * 7 % 60)).alias("title"), F.array(_title(s * 11 % 70), _title(s * 13 % 60), _title(s * 17 % 80)).alias("nearby")
    )
    a = n.table("part").groupBy((F.col("p_partkey") % 50).alias("k")).agg(F.count("*"))
    articles = a.select(_title(F.col("k")).alias("title"), (F.col("k") * 37 % 45).alias("appeal"), (F.col("k") % 3 != 0).alias("icon"))
    return guides.guide_index(places, cities, links, articles).select("place", "title", "featured", F.array_join("nearby", "|").alias("nearby"))


def _spelt(k: Column) -> Column:
    return F.translate(k.cast("string"), "0123456789", "abcdefghij")


def _towns(n: Network) -> DataFrame:
    k = F.col("c_custkey")
    return n.table("customer").select(
        k.alias("town"), F.concat(F.lit("Town "), _spelt(k % 97)).alias("name"), (F.col("c_nationkey") % 5).alias("state"), (k * 37 % 9000).alias("population"),
        (8 + (k * 41 % 2900) / 100.0).alias("lat"), (68 + (k * 59 % 2900) / 100.0).alias("lon"),
    )


@query
def stationless_towns(n: Network) -> DataFrame:
    """Customers as towns that no station and no guide of their name covers."""
    own = n.stations.select(F.concat(F.lit("town-"), _spelt(F.col("station") % 97)).alias("name"), "lat", "lon")
    return guides.stationless(_towns(n), n.stations.select("lat", "lon"), own).select("town", "name", "state", "population")


@query
def nearest_start(n: Network) -> DataFrame:
    """Where each customer would start: the busiest station close by, else the closest."""
    starts = n.stations.join(lines.station_counts(n.halts).select("station", "halts"), "station")
    found = guides.nearest_start(_towns(n).withColumnRenamed("town", "point"), starts)
    return found.select("point", "station", F.round("km", 6).alias("km"))


@query
def ways_by_road(n: Network) -> DataFrame:
    """From the hub to every town by train and road."""
    rides = reach.destinations(reach.departures(n.through(n.hub), n.hub)).select("place", "fastest")
    spots = _towns(n).withColumnRenamed("town", "spot")
    return guides.ways_by_road(spots, n.stations.select("station", "place", "lat", "lon"), rides)


@query
def surprise_place(n: Network) -> DataFrame:
    """A place with a guide, at random by its appeal."""
    return guides.surprise(_guides(n).select("place", "appeal"), 7)


@query
def photo_widths(n: Network) -> DataFrame:
    """Thumbnails and credits of the parts' photos, and how fast a train of that distance may be."""
    k = F.col("p_partkey")
    rows = n.table("part").select(k, (k * 29 % 2100).alias("w"), (k * 43 % 2300).alias("want"), F.when(k % 3 == 0, "Unknown photographer").when(k % 3 == 1, "Ann").alias("by"), F.when(k % 4 == 0, "CC BY").alias("lic"))
    thumb = F.when(k % 5 != 0, F.concat(F.lit("https://x/a/330px-P"), k, F.lit(".jpg"))).otherwise("https://x/a/P.jpg")
    return rows.select(
        "p_partkey", labels.photo_width(F.col("w"), F.col("want")).alias("step"), labels.photo_url(thumb, F.col("w"), F.col("want")).alias("url"),
        labels.credit(F.col("by"), F.col("lic"), F.concat(F.lit("A_file_"), k, F.lit(".png"))).alias("credit"), labels.believable_speed(k % 400).alias("speed"),
    )


def _track(n: Network) -> DataFrame:
    """Orders as ways between neighbouring points of a lattice of half a degree, their lines as the points between; some
    ways stop 130 m short of their end."""
    o, i, q = F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_quantity").cast("long")
    # by way at once: what follows is by way too, and all points are shuffled once for it
    rows = n.table("lineitem").select(o.alias("way"), i.cast("long").alias("i"), q.alias("q")).repartition("way").groupBy("way", "i").agg(F.min("q").alias("q"))
    rows = rows.withColumn("n", F.max("i").over(Window.partitionBy("way")))
    w = F.col("way")
    y, x = w % 60, F.floor(w / 60).cast("long") % 60
    up = (F.floor(w / 3600).cast("long") + w) % 2
    part = (F.col("i") - 1) / F.greatest(F.col("n") - 1, F.lit(1))
    short = (w % 11 == 0) & (F.col("i") == F.col("n"))
    part = F.when(short, part * 0.9976).otherwise(part)
    inner = (F.col("i") > 1) & (F.col("i") < F.col("n"))
    wiggle = F.when(inner, (F.col("q") - 25) / 1000.0).otherwise(0.0)
    node = F.when(F.col("i") == 1, y * 60 + x).when((F.col("i") == F.col("n")) & ~short, (y + up) * 60 + x + 1 - up).otherwise(10000 + w * 8 + F.col("i"))
    return rows.filter("n >= 2").select(
        "way", F.col("i").alias("pos"), node.alias("node"),
        (8 + 0.5 * (y + part * up) + wiggle * (1 - up)).alias("lat"), (68 + 0.5 * (x + part * (1 - up)) + wiggle * up).alias("lon"),
    )


def _track_stations(n: Network) -> DataFrame:
    k = F.col("s_suppkey")
    return n.table("supplier").select(k.alias("station"), (8 + 0.5 * (k * 37 % 60) + (k % 6) * 0.0021).alias("lat"), (68 + 0.5 * (k * 23 % 60)).alias("lon"))


def _small(n: Network) -> Callable[[DataFrame], DataFrame]:
    """A mark for tables of a row for each station: sent to all tasks where these are few."""
    return F.broadcast if n.table("supplier").count() <= resolve.FEW_STATIONS else lambda df: df


@query
def track_snap(n: Network) -> DataFrame:
    """The track's node of each station within a kilometre."""
    found = track.snap(_track_stations(n), track.node_uses(_track(n)))
    return found.select("station", "node", F.round("km", 6).alias("km"))


@query
def track_bridges(n: Network) -> DataFrame:
    """Loose ends of ways and the nearest other line."""
    points = _track(n)
    return track.bridges(points, track.node_uses(points)).select("a", "b", F.round("km", 6).alias("km"))


@query
def track_contract(n: Network) -> DataFrame:
    """The track as a graph of junctions, stations and bridges."""
    points = _track(n)
    nodes = track.node_uses(points)
    graph = track.contract(points, nodes, track.snap(_track_stations(n), nodes), track.bridges(points, nodes))
    return graph.select("a", "b", F.round("km", 6).alias("km"))


@query
def track_routes(n: Network) -> DataFrame:
    """Ways along the track between the stations of all neighbouring halts up to 250 km apart."""
    points = _track(n)
    nodes = track.node_uses(points)
    snapped = track.snap(_track_stations(n), nodes)
    graph = track.contract(points, nodes, snapped, track.bridges(points, nodes))
    small = _small(n)
    on = snapped.select("station", "node").join(_track_stations(n), "station")
    steps = n.halts.select("station", F.lead("station").over(lines.by_trip()).alias("then")).filter("then is not null and then <> station")
    pairs = steps.select(F.least("station", "then").alias("a"), F.greatest("station", "then").alias("b"))
    # many stations have the same node: pairs of nodes are made before they are shuffled
    pairs = pairs.join(small(on.toDF("a", "n", "y1", "x1")), "a").join(small(on.toDF("b", "m", "y2", "x2")), "b")
    pairs = pairs.filter(geo.haversine(F.col("y1"), F.col("x1"), F.col("y2"), F.col("x2")).between(15, 250)).select("n", "m").distinct()
    ways = track.routes(pairs.select(F.col("n").alias("a"), F.col("m").alias("b")), graph, nodes)
    return ways.select("a", "b", F.round("km", 6).alias("km"), F.array_join(F.col("way").cast("array<string>"), " ").alias("way"))


@query
def track_paths(n: Network) -> DataFrame:
    """Stretches of 15 km or more without a recorded path: the stations passed on the track between them."""
    order = Window.partitionBy("trip").orderBy("seq")
    s = n.halts.select("trip", "seq", F.col("station").alias("a"), F.lead("station").over(order).alias("b")).filter("b is not null and a <> b")
    recorded = s.filter("trip % 4 = 0 and seq % 2 = 0").select("trip", "seq")
    at = _track_stations(n)
    small = _small(n)
    close = s.join(small(at.toDF("a", "y1", "x1")), "a").join(small(at.toDF("b", "y2", "x2")), "b").filter(geo.haversine(F.col("y1"), F.col("x1"), F.col("y2"), F.col("x2")) <= 250)
    found = track.fill_paths(close.select("trip", "seq", "a", "b"), recorded, at, _track(n))
    return found.select("trip", "seq", F.array_join(F.col("via").cast("array<string>"), " ").alias("via"))


def _book_names(n: Network) -> DataFrame:
    """Stations named by the first three words of documents, one for each such name."""
    words = F.slice(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[A-Za-z]{3,}"), F.lit(0)), 1, 3)
    k = F.col("code")
    named = n.table("documents").groupBy(words.alias("w")).agg(F.min("doc_id").alias("code"))
    return named.select("code", "w", (8 + (k * 37 % 2900) / 100.0).alias("lat"), (68 + (k * 53 % 2900) / 100.0).alias("lon"))


@query
def resolved_names(n: Network) -> DataFrame:
    """Names as a book prints them, with words left out, added or in another order, and the stations meant."""
    s = _book_names(n)
    k, w = F.col("code"), F.col("w")
    printed = (
        F.when(k % 5 == 1, F.array_compact(F.array(F.get(w, F.lit(0)), F.get(w, F.lit(2))))).when(k % 5 == 2, F.concat(F.array(F.lit("Old")), w, F.array(F.lit("Extra"))))
        .when(k % 5 == 3, F.concat(w, F.array(F.lit("Jn")))).when(k % 5 == 4, F.reverse(w)).otherwise(w)
    )
    asks = s.select(
        k.alias("ask"), F.array_join(printed, " ").alias("name"), F.when(k % 3 == 1, k).when(k % 3 == 2, k - 1).alias("anchor"),
        F.when(k % 2 == 0, F.lit(30.0)).alias("rail_km"), F.when(k % 4 == 0, F.array(k)).otherwise(F.array().cast("array<bigint>")).alias("expected"),
    )
    return names.resolve(asks, s.select("code", F.array_join("w", " ").alias("name")), s.select("code", "lat", "lon"), close=False)


@query
def resolved_misprints(n: Network) -> DataFrame:
    """A search: the stations whose number 100 divides, by names with a letter left out, among all."""
    s = _book_names(n).withColumn("name", F.array_join("w", " "))
    k = F.col("code")
    cut = F.concat(F.substr("name", F.lit(1), F.lit(1)), F.substr("name", F.lit(3), F.length("name")))
    asks = s.filter(k % 100 == 0).select(k.alias("ask"), cut.alias("name"), k.alias("anchor"), F.lit(None).cast("double").alias("rail_km"), F.array().cast("array<bigint>").alias("expected"))
    return names.resolve(asks, s.select("code", "name"), s.select("code", "lat", "lon"))


@query
def placed_segments(n: Network) -> DataFrame:
    """Pages with names of documents' first words, placed by their names and printed distances."""
    s = _book_names(n)
    count = n.table("documents").agg(F.max("doc_id").alias("most"))
    h = n.halts.join(F.broadcast(count)).withColumn("code", (F.col("trip") * 13 + F.col("seq")) % (F.col("most") + 1))
    rows = h.join(s.select("code", F.array_join("w", " ").alias("name")), "code")
    halts = rows.select("trip", F.col("trip").alias("segment"), F.col("seq").alias("pos"), "name", F.when(F.col("trip") % 3 > 0, 100.0 * F.col("seq")).alias("km"))
    expected = rows.filter("trip % 2 = 0").select("trip", "code")
    return book.place_segments(halts, s.select("code", F.array_join("w", " ").alias("name")), s.select("code", "lat", "lon"), expected)


@query
def stitched_trips(n: Network) -> DataFrame:
    """Trips cut into pages, printed out of order and by the clock, and put together again."""
    whole = Window.partitionBy("trip")
    h = n.halts.select("trip", "seq", (F.col("station") * 100 + F.col("seq")).alias("code"), "arr", "dep").withColumn("n", F.count("*").over(whole))
    m = F.floor(F.col("n") / 2)
    left, right = F.col("seq") <= F.when(F.col("n") >= 4, m).otherwise(99), (F.col("n") >= 4) & (F.col("seq") >= m + (F.col("trip") % 3 == 0).cast("int"))
    page = lambda first: F.when((F.col("trip") % 2 == 0) == F.lit(first), 1).otherwise(2)
    a = h.filter(left).withColumn("page", page(True)).withColumn("move", F.lit(0).cast("long"))
    b = h.filter(right).withColumn("page", page(False)).withColumn("arr", F.when(F.col("seq") > m, F.col("arr")))
    b = b.withColumn("begin", F.min(F.coalesce("arr", "dep")).over(whole)).withColumn("move", F.col("begin") - F.col("begin") % 1440)
    both = a.select("trip", "page", "seq", "code", "arr", "dep", "move").union(b.select("trip", "page", "seq", "code", "arr", "dep", "move"))
    halts = both.select("trip", "page", F.col("seq").alias("pos"), "code", F.lit(False).alias("unsure"), (F.col("arr") - F.col("move")).alias("arr"), (F.col("dep") - F.col("move")).alias("dep"))
    table = F.when((F.col("trip") % 2 == 0) == (F.col("page") == 1), "10").otherwise("20")
    pages = halts.select("trip", "page").distinct().withColumn("table", table)
    pages = pages.select("trip", "page", "table", (F.col("table") == "20").alias("comes_from"), F.when(F.col("table") == "10", F.array(F.lit("20"))).otherwise(F.array().cast("array<string>")).alias("goes_to"))
    return book.stitch(halts, pages)


def _read_trips(n: Network) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Trips along a line, some misread: a day too much, a row of another train, a halt a day long, a halt unplaced."""
    whole = Window.partitionBy("trip")
    t, s = F.col("trip"), F.col("seq")
    h = n.halts.select("trip", "seq", (t * 100 + s).alias("code"), "arr", "dep").withColumn("n", F.count("*").over(whole)).withColumn("p", F.floor(F.col("n") / 2))
    pos = h.select("code", (8 + F.coalesce("arr", "dep") * 0.01).alias("lat"), F.lit(75.0).alias("lon")).union(n.spark.range(1).select(F.lit(-1).cast("long"), F.lit(-40.0), F.lit(75.0)))
    kind = F.when(F.col("n") >= 3, t % 10)
    gap = F.col("arr") - F.lag("dep").over(whole.orderBy("seq"))
    h = h.withColumn("kind", kind).withColumn("short", F.max(F.when((s == F.col("p")) & (gap <= 300), 1).otherwise(0)).over(whole) == 1)
    late = (F.col("kind") == 1) & F.col("short") & (s >= F.col("p")) | (F.col("kind") == 3) & (s > F.col("p"))
    day = lambda c, more: F.col(c) + F.when(more, 1440).otherwise(0)
    rows = h.select(
        "trip", (s * 10).alias("seq"), F.when(~((F.col("kind") == 4) & (s == F.col("p"))) | F.col("kind").isNull(), F.col("code")).alias("code"),
        day("arr", F.coalesce(late, F.lit(False))).alias("arr"), day("dep", F.coalesce(late | (F.col("kind") == 3) & (s == F.col("p")) & F.col("arr").isNotNull(), F.lit(False))).alias("dep"),
    )
    stray = h.filter((F.col("kind") == 2) & (s == F.col("p") - 1)).select("trip", (s * 10 + 5).alias("seq"), F.lit(-1).cast("long").alias("code"), (F.col("dep") + 1).alias("arr"), (F.col("dep") + 1).alias("dep"))
    kinds = n.trips.select("trip", (F.col("trip") % 2 == 0).alias("nonstop"), (F.col("trip") % 3 == 0).alias("premium"))
    return rows.union(stray), pos, kinds


@query
def book_faults(n: Network) -> DataFrame:
    """Why a trip as read cannot be trusted, the first reason."""
    return book.check(*_read_trips(n))


@query
def repaired_trips(n: Network) -> DataFrame:
    """Trips as read, with their reading faults mended, where that leaves a trip that can be trusted."""
    return book.repair(*_read_trips(n))


@query
def threaded_halts(n: Network) -> DataFrame:
    """Halts threaded through the stations of a full path, of which trips call at every second or so."""
    code = (F.col("station") * 100 + F.col("seq")).alias("code")
    path = n.halts.select("trip", F.col("seq").alias("at"), code)
    halts = n.halts.filter("seq % 3 <> 1 or (trip + seq) % 4 = 0").select("trip", "seq", code)
    return book.thread(halts, path)


@query
def rename_chains(n: Network) -> DataFrame:
    """Chains of 99 renames, a third of which run into a circle of 50."""
    k = F.col("p_partkey")
    circle = F.floor(k / 100) % 3 == 0
    rows = n.table("part").filter((k % 100 != 0) & ((k % 100 != 99) | circle))
    return resolve.rename_closure(rows.select(k.alias("old"), F.when(circle & (k % 100 == 99), k - 49).otherwise(k + 1).alias("new")))


@query
def coast_distance(n: Network) -> DataFrame:
    """How far customers are from coasts, of fifty points each."""
    k = F.col("p_partkey")
    c, i = F.floor(k / 50), k % 50
    line = n.table("part").select(c.alias("line"), i.alias("pos"), (8 + c * 53 % 290 / 10.0 + (k * 7 % 5) * 0.03).alias("lat"), (68 + c * 37 % 290 / 10.0 + i * 0.05).alias("lon"))
    points = _towns(n).select(F.col("town").alias("point"), "lat", "lon")
    return coast.coast_km(points, coast.segments(line)).select("point", F.round("km", 6).alias("km"))


@query
def listing_templates(n: Network) -> DataFrame:
    """The listings in documents, each behind the document's own text, with a template and a link inside and one
    that is never closed."""
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[A-Za-z]{3,}"), F.lit(0))
    w = [F.coalesce(F.get(words, F.lit(i)), F.lit("none")) for i in range(3)]
    parts = ["\n{{See | Name = ", w[0], " | content = {{x|", w[1], "|do=1}} and [[", w[2], "|", w[0], "]], ''fine''|Name2=", w[2], "}} {{ do|name=", w[1], "|alt}} {{eat|name=", w[2], " "]
    text = F.concat(F.coalesce("text", F.lit("")), *[F.lit(p) if isinstance(p, str) else p for p in parts])
    rows = markup.listings(n.table("documents").select("doc_id", text.alias("text")), ["see", "do", "eat"])
    value = lambda c: F.coalesce(F.col("params")[c], F.lit(""))
    return rows.select("doc_id", "nth", "kind", value("name").alias("name"), value("content").alias("content"), markup.clean(value("content")).alias("words"), value("name2").alias("name2"))


def _packed(n: Network) -> DataFrame:
    """All trips in the app's binary layout, by shards."""
    known = F.create_map(*[F.lit(x) for i, t in enumerate(TYPES.values()) for x in (t, i)])
    # a trip without an order has no type and runs on unknown days
    trips = n.halts.select("trip").distinct().join(n.trips, "trip", "left").select("trip", F.coalesce(known[F.col("type")], F.lit(9)).alias("type"), F.coalesce("days", F.lit(0)).alias("days"))
    halts = n.halts.withColumn("approx", (F.col("seq") % 2).cast("int"))
    paths = n.halts.filter("station % 3 = 0").select("trip", F.col("seq").alias("after"), F.array(F.col("station") + 1, F.lit(7)).alias("stations"))
    return binary.pack(halts, trips, paths, shards=max(8, int(n.spark.conf.get("spark.sql.shuffle.partitions", "200"))))


@query
def timetable_file_roundtrip(n: Network) -> DataFrame:
    """Halts written as timetable files, opened and read back."""
    files = _packed(n).select("trip", binary.timetable_file().alias("content"))
    return binary.unpack(binary.open_timetable(files))


@query
def paths_file_roundtrip(n: Network) -> DataFrame:
    """The stations passed behind halts, written as paths files and read back."""
    files = _packed(n).select("trip", "start", binary.paths_file().alias("content"))
    found = binary.unpack_paths(binary.open_paths(files))
    return found.select("trip", "after", F.array_join(F.col("stations").cast("array<string>"), " ").alias("stations"))


def _drawn_shapes(n: Network) -> DataFrame:
    """Twenty parts after each other as a diamond with teeth, in four files."""
    k = F.col("p_partkey")
    c, i = F.floor(k / 20), k % 20
    reach = (k * 7 % 5) * 0.02 + 0.2
    return n.table("part").select(
        (c % 4).cast("string").alias("file"), c.alias("shape"), F.concat(F.lit("s"), c % 7).alias("name"), F.lit(0).alias("ring"), i.cast("int").alias("pos"),
        (68 + c * 37 % 290 / 10.0 + (F.abs((i + 5) % 20 - 10) - 5) * reach).alias("x"), (8 + c * 53 % 290 / 10.0 + (F.abs(i - 10) - 5) * reach).alias("y"),
    )


@query
def states_on_map(n: Network) -> DataFrame:
    """The state of each customer by shapes written to shapefiles and read back."""
    rings = shapes.decode(shapes.encode(_drawn_shapes(n)))
    rings = rings.withColumn("shape", F.col("file").cast("long") * 1_000_000_000 + F.col("shape"))
    points = _towns(n).select(F.col("town").alias("point"), "lat", "lon", F.concat(F.lit("s"), F.col("town") % 7).alias("current"))
    return regions.settle(points, rings, split=(("s1", "s2"),))


@query
def edges_nearby(n: Network) -> DataFrame:
    """The states with an edge within three kilometres of a customer, and how far it is."""
    points = _towns(n).select(F.col("town").alias("point"), "lat", "lon")
    return regions.edge_km(points, regions.edges(_drawn_shapes(n))).select("point", "name", F.round("km", 6).alias("km"))


def _year(out: DataFrame, key: str, months: str) -> DataFrame:
    return out.select(key, "source", normals.letters(F.col(months)).alias("letters"), F.array_join(normals.flat(F.col(months)), ",").alias("flat"))


@query
def chart_years(n: Network) -> DataFrame:
    """The climate charts behind the texts of documents: sound ones, with links and signs, in other units, too short."""
    k = F.col("doc_id")
    months = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda m: F.concat_ws("|", ((k + m) % 50 - 20).cast("string"), ((k + m) % 50 - 12).cast("string"), F.concat(((k * 7 + m) % 400).cast("string"), F.lit(".5"))))
    numbers = F.array_join(months, " |\n ")
    kind = k % 5
    numbers = F.when(kind == 1, F.regexp_replace(numbers, "-", "−")).when(kind == 2, F.regexp_replace(numbers, r"\|[^|]*$", "")).otherwise(numbers)
    more = F.when(kind == 0, "| units = imperial").when(kind == 1, "| source = [[w:X#Climate|Wikipedia]] | ").otherwise("")
    text = F.concat(F.coalesce("text", F.lit("")), F.lit("\n{{ Climate  chart|x}}{{Climate chart\n| [[Title|of it]] | "), numbers, more, F.lit("}} {{climate chart|a|1}}"))
    rows = n.table("documents").select("doc_id", normals.chart(text).alias("months"))
    return _year(rows.withColumn("source", F.when(F.col("months").isNotNull(), "imd").otherwise("")), "doc_id", "months")


@query
def climate_normals(n: Network) -> DataFrame:
    """The year of each customer's town: of a chart for every third, else of the cell at the town's height."""
    k, m12 = F.col("p_partkey"), F.sequence(F.lit(0), F.lit(11))
    per_month = lambda f: F.transform(m12, lambda m: f(m).cast("double"))
    low = lambda m: 5 + (F.col("k") * 7 + m * 3) % 20
    cells = n.table("part").groupBy((16 + k % 59).alias("cy"), (108 + F.floor(k / 59) % 48).alias("cx")).agg(F.max("p_partkey").alias("k"))
    cells = cells.select(
        (F.col("cy") * 0.5).alias("lat"), (F.col("cx") * 0.625).alias("lon"), F.when(F.col("k") % 9 != 0, F.col("k") * 11 % 2000).alias("elev"),
        per_month(low).alias("low"), per_month(lambda m: low(m) + 5 + (F.col("k") + m) % 12).alias("high"), per_month(lambda m: F.col("k") * m % 13).alias("rain"),
    )
    t = F.col("town")
    said = F.concat(F.lit("{{climate chart|t|"), F.array_join(F.transform(m12, lambda m: F.concat_ws("|", (t % 30 - m).cast("string"), (t % 30 + m).cast("string"), (t * m % 350).cast("string"))), "|"), F.lit("}}"))
    points = _towns(n).select(t.alias("point"), "lat", "lon", F.when(t % 10 != 0, t * 13 % 2500).alias("height"), F.when(t % 3 == 0, said).alias("text"))
    return _year(normals.normals(points, cells), "point", "months")


@query
def renumber_moves(n: Network) -> DataFrame:
    """Even trips brought to the numbers of odd ones, a third of which has halts of its own already."""
    found = QUERIES["renumber_resolution"](n.spark, n.path)
    return merge.moves(n.trips.filter("trip % 2 = 0").select("trip"), found, n.trips.filter("trip % 3 = 0").select("trip"))


@query
def renumbered_halts(n: Network) -> DataFrame:
    """The halts of even trips under their new numbers, runs of one place as one halt."""
    moved = QUERIES["renumber_moves"](n.spark, n.path)
    halts = n.placed.filter("trip % 2 = 0").select("trip", "seq", "place", "arr", "dep")
    return merge.propagate(merge.collapse(halts, station="place"), moved)


@query
def newer_without_known(n: Network) -> DataFrame:
    """Pairs of numbers of which none is a trip, every fourth being one."""
    k = F.col("o_orderkey")
    newer = n.table("orders").select(F.concat_ws("/", (k + 1).cast("string"), (k + 5).cast("string")).alias("numbers"), k.alias("after"))
    return merge.still_newer(newer, n.trips.filter("trip % 4 = 0"))
