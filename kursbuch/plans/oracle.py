"""For DuckDB: the SQL that says the same as each timetable query.

Written apart from the DataFrame code, with self-joins where that uses windows, so that the two
check each other. Queries without an entry (greedy choice, edit distance, folding, hashing,
shortest ways) are tested in Python.
"""

from __future__ import annotations

#: Common table expressions: the driver's tables as a timetable.
BASE = """
WITH li AS (
  SELECT l_orderkey AS trip, row_number() OVER w - 1 AS seq, l_suppkey AS station, l_quantity::BIGINT AS q,
    (17 * sum(l_quantity::BIGINT) OVER (w ROWS UNBOUNDED PRECEDING))::BIGINT AS mins,
    floor(sum(round(l_extendedprice * 100)::BIGINT) OVER (w ROWS UNBOUNDED PRECEDING) / 100000)::BIGINT AS km,
    count(*) OVER (PARTITION BY l_orderkey) AS n
  FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_shipdate, l_partkey, l_suppkey)),
h AS (
  SELECT trip, seq, station, CASE WHEN seq > 0 THEN mins END AS arr, CASE WHEN seq < n - 1 THEN mins + q % 6 END AS dep, km, n
  FROM li WHERE n >= 2),
t AS (
  SELECT o_orderkey AS trip, (o_orderkey % 128)::INT AS days,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'Superfast' WHEN '2-HIGH' THEN 'Express' WHEN '3-MEDIUM' THEN 'Pass'
      WHEN '4-NOT SPECIFIED' THEN 'MEMU' WHEN '5-LOW' THEN 'Toy' END AS type
  FROM orders),
s AS (
  SELECT s_suppkey AS station, s_nationkey AS place, n_regionkey AS state,
    (8 + (s_suppkey * 37 % 290) / 10.0::DOUBLE) AS lat, (68 + (s_suppkey * 53 % 290) / 10.0::DOUBLE) AS lon
  FROM supplier JOIN nation ON s_nationkey = n_nationkey),
hp AS (SELECT h.*, place FROM h JOIN s USING (station)),
served AS (SELECT place, count(*) AS halts FROM hp GROUP BY place),
hub AS (SELECT place FROM served ORDER BY halts DESC, place LIMIT 1),
snd AS (SELECT place FROM served ORDER BY halts DESC, place LIMIT 1 OFFSET 1)"""

_OUT_BOARD = """
ob AS (SELECT trip, min(seq) AS from_seq FROM hp WHERE place = (FROM hub) AND dep IS NOT NULL GROUP BY trip),
of AS (
  SELECT trip, place, min(hp.seq) AS to_seq, any_value(from_seq) AS from_seq FROM hp JOIN ob USING (trip)
  WHERE seq > from_seq AND place <> (FROM hub) GROUP BY trip, place),
out_legs AS (
  SELECT of.trip, of.place, of.from_seq, of.to_seq, a.dep AS dep_abs, a.dep % 1440 AS dep, b.arr - a.dep AS dur, b.km - a.km AS km,
    (SELECT count(*) FROM hp m WHERE m.trip = of.trip AND m.seq > of.from_seq AND m.seq < of.to_seq AND m.place <> (FROM hub)) AS halts,
    b.station AS far_station, t.days, t.type
  FROM of JOIN hp a ON a.trip = of.trip AND a.seq = of.from_seq JOIN hp b ON b.trip = of.trip AND b.seq = of.to_seq LEFT JOIN t ON t.trip = of.trip)"""


def _into(dest: str, name: str) -> str:
    return f"""
{name}_e AS (SELECT trip, min(seq) AS to_seq FROM hp WHERE place = (FROM {dest}) AND arr IS NOT NULL AND seq >= 1 GROUP BY trip),
{name}_f AS (
  SELECT trip, place, min(seq) AS from_seq, any_value(to_seq) AS to_seq FROM hp JOIN {name}_e USING (trip)
  WHERE seq < to_seq AND place <> (FROM {dest}) AND dep IS NOT NULL GROUP BY trip, place),
{name} AS (
  SELECT f.trip, f.place, f.from_seq, f.to_seq, a.dep AS dep_abs, a.dep % 1440 AS dep, b.arr - a.dep AS dur, b.km - a.km AS km,
    (SELECT count(*) FROM hp m WHERE m.trip = f.trip AND m.seq > f.from_seq AND m.seq < f.to_seq AND m.place <> f.place) AS halts,
    a.station AS far_station, t.days
  FROM {name}_f f JOIN hp a ON a.trip = f.trip AND a.seq = f.from_seq JOIN hp b ON b.trip = f.trip AND b.seq = f.to_seq LEFT JOIN t ON t.trip = f.trip)"""


_IN_LEGS = _into("hub", "in_legs")
_DEST = "SELECT place, count(*) AS legs, min(dur) AS fastest, min(km) AS first_km FROM {} GROUP BY place"
_LEG = "SELECT trip, place, from_seq, to_seq, dep, dur, km, halts FROM {}"


def _on(mask: str, dep: str) -> str:
    """Boarding weekdays, by moving each bit by the days on the way."""
    k = f"((floor({dep} / 1440)::INT) % 7)"
    return f"(CASE WHEN {mask} = 0 THEN 127 ELSE ((({mask} << {k}) | ({mask} >> (7 - {k}))) & 127) END)"


def _wait(mask: str, dep: str, now: int) -> str:
    """As told: try this clock time on each of the next eight days."""
    first = f"((({dep} % 1440) - {now % 1440} + 1440) % 1440)"
    weekday = f"(({now // 1440} + floor(({now % 1440} + {first} + n * 1440) / 1440)::INT) % 7)"
    bit = f"((({weekday} - floor({dep} / 1440)::INT) % 7 + 7) % 7)"
    tried = f"(SELECT min({first} + n * 1440) FROM range(0, 8) r(n) WHERE (({mask} >> {bit}) & 1) = 1)"
    return f"(CASE WHEN {mask} IN (0, 127) THEN {first} ELSE coalesce({tried}, {first}) END)"


def _hav(a: str, b: str, c: str, d: str) -> str:
    return (
        f"(2 * 6371.0 * asin(sqrt(least(1.0, power(sin(radians({c} - {a}) / 2), 2) + "
        f"cos(radians({a})) * cos(radians({c})) * power(sin(radians({d} - {b}) / 2), 2)))))"
    )


NOW = 3 * 1440 + 845
_HOPS = """
hop AS (
  SELECT h.trip, h.seq, h.station, s.lat, s.lon, lag(s.lat) OVER w AS plat, lag(s.lon) OVER w AS plon, lead(s.lat) OVER w AS nlat, lead(s.lon) OVER w AS nlon
  FROM h JOIN s USING (station) WINDOW w AS (PARTITION BY h.trip ORDER BY h.seq))"""
_EDGES = """
e AS (
  SELECT least(x.station, y.station) AS a, greatest(x.station, y.station) AS b, count(*) AS trips
  FROM h x JOIN h y ON x.trip = y.trip AND y.seq = x.seq + 1 WHERE x.station <> y.station GROUP BY ALL)"""
_POINTS = """
p AS (
  SELECT c_custkey AS point, 8 + (c_custkey * 41 % 2900) / 100.0::DOUBLE AS lat, 68 + (c_custkey * 67 % 2900) / 100.0::DOUBLE AS lon FROM customer)"""
_PAIRS = f"pp AS (SELECT point, station, {_hav('p.lat', 'p.lon', 's.lat', 's.lon')} AS km, p.lat, p.lon FROM p, s)"
_HILLS = "((lat > 29.8 AND lon < 81.5) OR (lat > 26.4 AND lon > 88) OR (lat > 9 AND lat < 13 AND lon > 75.4 AND lon < 77.8))"
_CHOICE = "struct_pack(station := z.station, minutes := z.minutes, score := z.score, lat := z.lat, lon := z.lon)"
_CENTRES = "c AS (SELECT place, arg_min(lat, station) AS lat, arg_min(lon, station) AS lon FROM s GROUP BY place)"
_TOWN = f"""
town AS (
  SELECT c.place FROM c, (SELECT * FROM c WHERE place = (FROM hub)) o WHERE {_hav("o.lat", "o.lon", "c.lat", "c.lon")} < 20
  UNION
  SELECT c.place FROM c, s WHERE s.place = (FROM hub) AND (SELECT count(*) FROM s WHERE place = (FROM hub)) > 1
    AND {_hav("c.lat", "c.lon", "s.lat", "s.lon")} <= 12)"""
_GUIDES = "g AS (SELECT place, place % 11 AS guide, (place * 7) % 40 AS appeal, place % 4 = 0 AS is_city, halts FROM served)"
_REACH = "r AS (SELECT place, count(*) AS legs, min(dur) AS fastest FROM out_legs GROUP BY place)"
_CLIMATE = """
k AS (SELECT s_suppkey AS station, month, s_suppkey * 13 + month * 29 AS k FROM supplier, range(0, 12) m(month)),
cl AS (SELECT station, month, k % 31 - 8 AS low, k % 31 + 6 + month AS high, k * 7 % 340 AS rain FROM k),
le AS (
  SELECT station, month, CASE WHEN high < 10 OR low < -6 THEN 'C' WHEN rain >= 300 THEN 'W' WHEN high >= 39 THEN 'H' WHEN rain >= 140 THEN 'R'
    WHEN high >= 35 THEN 'M' WHEN high >= 16 AND high <= 32 AND rain < 70 AND low >= 4 THEN 'B' ELSE 'G' END AS letter FROM cl)"""
_SAVES = """
sv AS (
  SELECT user_id AS "user", props ->> '$.k' AS key, epoch_us(ts) // 1000 AS "at", event_type = 'error' AS deleted, event_id AS data FROM events),
w AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY "user", key ORDER BY "at" DESC, deleted DESC, data DESC) AS nth FROM sv) WHERE nth = 1)"""
_TIMES = """
ev AS (
  SELECT trip, seq, 0 AS which, arr % 1440 AS v FROM h WHERE arr IS NOT NULL UNION ALL
  SELECT trip, seq, 1, dep % 1440 FROM h WHERE dep IS NOT NULL),
tu AS (SELECT *, CASE WHEN v < lag(v) OVER w THEN 1 ELSE 0 END AS turn FROM ev WINDOW w AS (PARTITION BY trip ORDER BY seq, which)),
ru AS (SELECT *, (v + 1440 * sum(turn) OVER (PARTITION BY trip ORDER BY seq, which ROWS UNBOUNDED PRECEDING))::BIGINT AS m FROM tu)"""


def _scored(km: int) -> str:
    return f"""
n AS (SELECT station, count(*) AS halts FROM h GROUP BY station),
q AS (SELECT point, station, halts, {_HILLS} AS hills, km FROM pp JOIN n USING (station) WHERE km <= {km} AND halts >= 2),
m AS (
  SELECT point, station, halts, floor(floor(km * (CASE WHEN hills THEN 1.45 ELSE 1.3 END)::DOUBLE + 2 + 0.5) / (CASE WHEN hills THEN 32.0 ELSE 45.0 END)::DOUBLE * 60 / 5 + 0.5)::BIGINT * 5 + 10 AS minutes FROM q),
sc AS (
  SELECT point, station, minutes,
    minutes + CASE WHEN halts < 6 THEN 180 WHEN halts < 20 THEN 100 WHEN halts < 60 THEN 50 WHEN halts < 120 THEN 15 ELSE 0 END AS score FROM m)"""


def _sql(*parts: str) -> str:
    *ctes, body = parts
    return ",\n".join([BASE, *ctes]) + "\n" + body


def _alone(*parts: str) -> str:
    *ctes, body = parts
    return "WITH " + ",".join(ctes) + "\n" + body

_TRACK = f"""
ti AS (SELECT l_orderkey AS way, l_linenumber::BIGINT AS i, min(l_quantity::BIGINT) AS q FROM lineitem GROUP BY ALL),
tn AS (
  SELECT *, max(i) OVER (PARTITION BY way) AS n, way % 60 AS y, (way // 60) % 60 AS x, (way // 3600 + way) % 2 AS up FROM ti),
tm AS (
  SELECT *, (way % 11 = 0 AND i = n) AS short, (i - 1)::DOUBLE / greatest(n - 1, 1) * (CASE WHEN way % 11 = 0 AND i = n THEN 0.9976::DOUBLE ELSE 1::DOUBLE END) AS part,
    CASE WHEN i > 1 AND i < n THEN (q - 25) / 1000.0::DOUBLE ELSE 0 END AS wiggle FROM tn WHERE n >= 2),
tp AS (
  SELECT way, i AS pos, CASE WHEN i = 1 THEN y * 60 + x WHEN i = n AND NOT short THEN (y + up) * 60 + x + 1 - up ELSE 10000 + way * 8 + i END AS node,
    8 + 0.5::DOUBLE * (y + part * up) + wiggle * (1 - up) AS lat, 68 + 0.5::DOUBLE * (x + part * (1 - up)) + wiggle * up AS lon FROM tm),
te AS (SELECT way, arg_min(node, pos) AS first, arg_max(node, pos) AS last, min(pos) AS lo, max(pos) AS hi FROM tp GROUP BY way),
tu AS (
  SELECT node, sum(CASE WHEN pos = lo OR pos = hi THEN 2 ELSE 1 END) AS uses, min(way) AS way, min(struct_pack(lat, lon)) AS p
  FROM tp JOIN te USING (way) GROUP BY node),
tk AS (SELECT node, uses, way, p.lat AS lat, p.lon AS lon FROM tu),
ts AS (
  SELECT s_suppkey AS station, 8 + 0.5::DOUBLE * (s_suppkey * 37 % 60) + (s_suppkey % 6) * 0.0021::DOUBLE AS lat, 68 + 0.5::DOUBLE * (s_suppkey * 23 % 60) AS lon FROM supplier),
tsn AS (
  SELECT station, node, {_hav('ts.lat', 'ts.lon', 'tk.lat', 'tk.lon')} AS km FROM ts JOIN tk ON abs(ts.lat - tk.lat) < 0.01 AND abs(ts.lon - tk.lon) < 0.02),
snapped AS (SELECT station, min(struct_pack(km, node)) AS b FROM tsn WHERE km < 1 GROUP BY station),
loose AS (SELECT te.way, k.node, k.lat, k.lon FROM te JOIN tk k ON k.node = te.first OR k.node = te.last WHERE k.uses = 2),
tb AS (
  SELECT l.node AS a, k.node AS b, {_hav('l.lat', 'l.lon', 'k.lat', 'k.lon')} AS km
  FROM loose l JOIN tk k ON abs(l.lat - k.lat) < 0.01 AND abs(l.lon - k.lon) < 0.02 AND k.way <> l.way),
bridged AS (SELECT a, min(struct_pack(km, b)) AS t FROM tb WHERE km < 0.25 GROUP BY a),
kept AS (SELECT node FROM tk WHERE uses >= 2 UNION SELECT b.node FROM snapped UNION SELECT t.b FROM bridged),
tq AS (SELECT *, row_number() OVER (PARTITION BY way ORDER BY pos) AS nth FROM tp),
steps AS (
  SELECT y.way, y.nth AS pos, x.node AS was, y.node, {_hav('x.lat', 'x.lon', 'y.lat', 'y.lon')} AS km FROM tq x JOIN tq y ON y.way = x.way AND y.nth = x.nth + 1),
walk AS (
  SELECT way, pos, was AS a, node, km FROM steps WHERE was IN (FROM kept)
  UNION ALL
  SELECT s.way, s.pos, w.a, s.node, w.km + s.km FROM walk w JOIN steps s ON s.way = w.way AND s.pos = w.pos + 1 WHERE w.node NOT IN (FROM kept)),
tg AS (
  SELECT least(a, node) AS a, greatest(a, node) AS b, min(km) AS km FROM (
    SELECT a, node, km FROM walk WHERE node IN (FROM kept) AND a <> node UNION ALL SELECT a, t.b, t.km FROM bridged) GROUP BY ALL)"""
_ROUTES = f"""
ge AS (SELECT a, b, km FROM tg UNION ALL SELECT b, a, km FROM tg),
ask AS (
  SELECT DISTINCT p.a, p.b, k.lat, k.lon, 1.5::DOUBLE * {_hav('j.lat', 'j.lon', 'k.lat', 'k.lon')} + 25 AS most
  FROM asked p JOIN tk j ON j.node = p.a JOIN tk k ON k.node = p.b),
found AS (
  SELECT a, b, a AS node, 0::DOUBLE AS km, [a] AS way, lat, lon, most FROM ask
  UNION ALL
  SELECT f.a, f.b, e.b AS node, min(f.km + e.km) AS km, arg_min(list_append(f.way, e.b), f.km + e.km) AS way, any_value(f.lat), any_value(f.lon), any_value(most)
  FROM found f JOIN ge e ON e.a = f.node JOIN tk k ON k.node = e.b
  WHERE f.node <> f.b AND NOT list_contains(f.way, e.b) AND f.km + e.km + {_hav('k.lat', 'k.lon', 'f.lat', 'f.lon')} <= most * 1.000000001 GROUP BY f.a, f.b, e.b, len(f.way)),
ways AS (SELECT a, b, min(struct_pack(km, way)) AS w FROM found WHERE node = b AND km <= most GROUP BY a, b)"""


def _recursive(*parts: str) -> str:
    return _sql(*parts).replace("WITH li", "WITH RECURSIVE li", 1)

_READ = f"""
rh AS (SELECT trip, seq, trip * 100 + seq AS code, arr, dep, n, n // 2 AS p, CASE WHEN n >= 3 THEN trip % 10 END AS kind FROM h),
rp AS (SELECT code, 8 + coalesce(arr, dep) * 0.01::DOUBLE AS lat, 75::DOUBLE AS lon FROM rh UNION ALL SELECT -1, -40, 75),
rs AS (SELECT x.trip FROM rh x JOIN rh y ON y.trip = x.trip AND y.seq = x.p - 1 AND x.seq = x.p WHERE x.arr - y.dep <= 300),
rr AS (
  SELECT trip, seq * 10 AS seq, CASE WHEN kind IS NOT DISTINCT FROM 4 AND seq = p THEN NULL ELSE code END AS code,
    arr + CASE WHEN kind = 1 AND trip IN (FROM rs) AND seq >= p OR kind = 3 AND seq > p THEN 1440 ELSE 0 END AS arr,
    dep + CASE WHEN kind = 1 AND trip IN (FROM rs) AND seq >= p OR kind = 3 AND seq >= p AND arr IS NOT NULL THEN 1440 ELSE 0 END AS dep FROM rh
  UNION ALL SELECT trip, seq * 10 + 5, -1, dep + 1, dep + 1 FROM rh WHERE kind = 2 AND seq = p - 1)"""


def _stretches(rows: str, name: str) -> str:
    """Neighbouring rows of a trip, with the way between them and why it cannot be."""
    return f"""
{name}_o AS (SELECT *, row_number() OVER (PARTITION BY trip ORDER BY seq) AS i FROM {rows}),
{name}_k AS (
  SELECT y.trip, y.seq, x.code AS c0, y.code AS c1, {_hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS km, y.arr - x.dep AS mins
  FROM {name}_o x JOIN {name}_o y ON y.trip = x.trip AND y.i = x.i + 1 LEFT JOIN rp a ON a.code = x.code LEFT JOIN rp b ON b.code = y.code),
{name} AS (
  SELECT trip, seq, CASE WHEN c0 = c1 THEN 'same station twice'
    WHEN mins <= 0 OR km * 60 / mins > CASE WHEN km >= 300 THEN 105 WHEN km >= 40 THEN 135 ELSE 160 END THEN 'impossible speed'
    WHEN mins > 720 AND km < 400 THEN 'long gap'
    WHEN trip % 2 <> 0 AND (km > CASE WHEN trip % 3 = 0 THEN 650 ELSE 450 END OR mins > 600 AND km * 60 / mins < 55) THEN 'halts missing' END AS fault
  FROM {name}_k)"""


_BOOK = """
bw AS (SELECT min(doc_id) AS code, w FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[A-Za-z]{3,}')[1:3] AS w FROM documents) GROUP BY w),
bp AS (SELECT code, 8 + (code * 37 % 2900) / 100.0::DOUBLE AS lat, 68 + (code * 53 % 2900) / 100.0::DOUBLE AS lon FROM bw),
ba AS (
  SELECT code, CASE code % 5 WHEN 1 THEN list_filter([w[1], w[3]], lambda x: x IS NOT NULL) WHEN 2 THEN list_concat(['Old'], w, ['Extra']) WHEN 3 THEN list_concat(w, ['Jn'])
    WHEN 4 THEN list_reverse(w) ELSE w END AS w FROM bw),
bu AS (SELECT 0 AS side, code, list_filter(list_transform(w, lambda x: upper(x)), lambda x: x NOT IN ('JN', 'JUNCTION', 'RLY', 'RAILWAY', 'STATION', 'HALT')) AS w FROM bw
  UNION ALL SELECT 1, code, list_filter(list_transform(w, lambda x: upper(x)), lambda x: x NOT IN ('JN', 'JUNCTION', 'RLY', 'RAILWAY', 'STATION', 'HALT')) FROM ba),
bk AS (SELECT side, code, list_filter(w, lambda x, i: list_position(w, x) = i) AS w FROM bu),
bc AS (
  SELECT a.code AS ask, b.code, a.w = b.w AS exact, list_has_all(b.w, a.w) AS loose,
    CASE WHEN len(b.w) >= 2 AND list_has_all(a.w, b.w) THEN len(b.w) END AS inside
  FROM bk a JOIN bk b ON a.side = 1 AND b.side = 0 AND len(a.w) > 0 AND len(b.w) > 0 AND list_has_any(a.w, b.w)),
br AS (
  SELECT ask, code, unnest(list_concat(CASE WHEN exact THEN [1] ELSE [] END, CASE WHEN loose THEN [2] ELSE [] END,
    CASE WHEN inside = max(inside) OVER (PARTITION BY ask) THEN [3] ELSE [] END)) AS rule FROM bc)"""


#: Shapes drawn from parts (v, w), their edges (e), customers (p), and regions with an edge near a customer (d).
_SHAPES = """
WITH s AS (
  SELECT p_partkey // 20 AS c, p_partkey % 20 AS i, 's' || p_partkey // 20 % 7 AS name, (p_partkey * 7 % 5) * 0.02::DOUBLE + 0.2::DOUBLE AS r FROM part),
v AS (
  SELECT c, i, name, 68 + c * 37 % 290 / 10.0::DOUBLE + (abs((i + 5) % 20 - 10) - 5) * r AS x, 8 + c * 53 % 290 / 10.0::DOUBLE + (abs(i - 10) - 5) * r AS y FROM s),
w AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY i) AS nth, count(*) OVER (PARTITION BY c) AS n FROM v),
e AS (
  SELECT b.c, b.name, a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1 FROM w a JOIN w b ON a.c = b.c AND b.nth = a.nth % a.n + 1 WHERE a.x <> b.x OR a.y <> b.y),
p AS (
  SELECT c_custkey AS point, 's' || c_custkey % 7 AS current, (8 + (c_custkey * 41 % 2900) / 100.0::DOUBLE) AS lat, (68 + (c_custkey * 59 % 2900) / 100.0::DOUBLE) AS lon FROM customer),
f AS (
  SELECT point, name, (x0 - lon) * 111.32::DOUBLE * cos(radians(lat)) AS ax, (y0 - lat) * 111.32::DOUBLE AS ay,
    (x1 - x0) * 111.32::DOUBLE * cos(radians(lat)) AS dx, (y1 - y0) * 111.32::DOUBLE AS dy
  FROM p JOIN e ON lon BETWEEN least(x0, x1) - 0.1 AND greatest(x0, x1) + 0.1 AND lat BETWEEN least(y0, y1) - 0.1 AND greatest(y0, y1) + 0.1),
t AS (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, -(ax * dx + ay * dy) / (dx * dx + dy * dy))) AS t FROM f),
d AS (
  SELECT point, name, min(sqrt((ax + t * dx) * (ax + t * dx) + (ay + t * dy) * (ay + t * dy))) AS km FROM t GROUP BY point, name HAVING km <= 3.0)"""

ORACLE_SQL: dict[str, str] = {
    "departures_from_place": _sql(_OUT_BOARD, _DEST.format("out_legs")),
    "departure_legs": _sql(_OUT_BOARD, _LEG.format("out_legs")),
    "arrivals_to_place": _sql(_IN_LEGS, _DEST.format("in_legs")),
    "arrival_legs": _sql(_IN_LEGS, _LEG.format("in_legs")),
    "arrivals_mirror_departures": _sql(
        _OUT_BOARD,
        _into("snd", "snd_legs"),
        """SELECT by_departures, by_arrivals, by_departures = by_arrivals AS same
FROM (SELECT min(dur) AS by_departures FROM out_legs WHERE place = (FROM snd)), (SELECT min(dur) AS by_arrivals FROM snd_legs WHERE place = (FROM hub))""",
    ),
    "reach_within_kind": _sql(
        _OUT_BOARD,
        "SELECT place, count(*) AS legs, min(dur) AS fastest FROM out_legs WHERE dur <= 2000 AND type IN ('Pass', 'MEMU', 'DEMU') GROUP BY place",
    ),
    "reach_trips": _sql(
        _OUT_BOARD,
        f"""SELECT trip, min(from_seq) AS from_seq, max(to_seq) AS to_seq FROM out_legs
WHERE dur <= 3000 AND {_wait("days", "dep_abs", NOW)} <= 360 GROUP BY trip""",
    ),
    "wait_next_departure": _sql(
        _OUT_BOARD, f"SELECT trip, from_seq, min(w) AS wait FROM (SELECT trip, from_seq, {_wait('days', 'dep_abs', NOW)} AS w FROM out_legs) GROUP BY trip, from_seq"
    ),
    "overnight_legs": _sql(
        _OUT_BOARD,
        """SELECT trip, place, dep, dur FROM out_legs
WHERE (dep >= 1020 OR dep < 60) AND dur >= 300 AND dur <= 960 AND (dep + dur) % 1440 >= 270 AND (dep + dur) % 1440 <= 690""",
    ),
    "weekend_legs": _sql(
        _OUT_BOARD,
        f"""SELECT trip, place, dep, dur, days FROM (SELECT *, {_on("days", "dep_abs")} AS on_days FROM out_legs)
WHERE CASE WHEN dep >= 960 AND (on_days >> 4) & 1 = 1 THEN dep + dur <= 1410 OR (dep + dur - 1440 BETWEEN 270 AND 690)
  WHEN dep < 60 AND (on_days >> 5) & 1 = 1 THEN dep + dur BETWEEN 270 AND 690
  ELSE dep >= 240 AND dep <= 720 AND (on_days >> 5) & 1 = 1 AND dur <= 360 END""",
    ),
    "running_days_shifted": _sql(
        f"""x AS (SELECT days, {_on("days", "dep")}::INT AS "on" FROM (SELECT trip, max(dep) AS dep FROM h GROUP BY trip) JOIN t USING (trip)),
y AS (
  SELECT days, "on", list_filter([0, 1, 2, 3, 4, 5, 6], lambda i: ("on" >> i) & 1 = 1) AS d, list_filter([0, 1, 2, 3, 4, 5, 6], lambda i: ("on" >> i) & 1 = 0) AS no FROM x)""",
        """SELECT days, "on", CASE WHEN "on" = 0 THEN '' WHEN "on" = 127 THEN 'Daily'
  WHEN len(d) = 6 THEN 'Except ' || ['Mon', 'Tue', 'Wed', 'Thu', 'Fri', 'Sat', 'Sun'][no[1] + 1]
  ELSE array_to_string(list_transform(d, lambda i: ['Mon', 'Tue', 'Wed', 'Thu', 'Fri', 'Sat', 'Sun'][i + 1]), ', ') END AS label, count(*) AS trips
FROM y GROUP BY ALL""",
    ),
    "soonest_departures": _sql(
        _OUT_BOARD, f"SELECT trip, place, {_wait('days', 'dep_abs', NOW)} AS wait, dur FROM out_legs ORDER BY wait, trip, place LIMIT 50"
    ),
    "direct_trip_counts": _sql(_IN_LEGS, "SELECT place, count(DISTINCT trip) AS trips, min(dur) AS fastest FROM in_legs GROUP BY place"),
    "network_edges": _sql(_EDGES, "SELECT a, b, trips FROM e"),
    "station_halt_counts": _sql("SELECT station, count(*) AS halts, count(DISTINCT trip) AS trips FROM h GROUP BY station"),
    "delta_encode": _sql(
        """SELECT x.trip, x.seq, ((coalesce(x.arr - y.dep, 0)) % 65536 + 65536) % 65536 AS d_arr,
  CASE WHEN x.arr IS NULL THEN x.dep ELSE coalesce(x.dep - x.arr, 0) END % 65536 AS d_dep, (x.km - coalesce(y.km, 0)) % 65536 AS d_km
FROM h x LEFT JOIN h y ON y.trip = x.trip AND y.seq = x.seq - 1""",
    ),
    "delta_decode_roundtrip": _sql("SELECT count(*) AS halts, 0::BIGINT AS wrong FROM h"),
    "day_roll_forward": _sql(
        _TIMES, "SELECT trip, seq, max(m) FILTER (which = 0) AS arr, max(m) FILTER (which = 1) AS dep FROM ru GROUP BY trip, seq"
    ),
    "validate_halts": _sql(
        """b AS (SELECT trip, seq, n, CASE WHEN trip % 89 = 0 AND seq = 0 THEN 0 ELSE arr END AS arr, dep, CASE WHEN trip % 97 = 0 THEN -km ELSE km END AS km FROM h),
c AS (
  SELECT x.*, (SELECT arg_max(coalesce(y.dep, y.arr), y.seq) FROM b y WHERE y.trip = x.trip AND y.seq < x.seq) AS before,
    (SELECT km FROM b y WHERE y.trip = x.trip AND y.seq = x.seq - 1) AS km_before FROM b x),
d AS (
  SELECT CASE WHEN seq = 0 AND (arr IS NOT NULL OR dep IS NULL) THEN 'first halt must only depart'
    WHEN seq = n - 1 AND (dep IS NOT NULL OR arr IS NULL) THEN 'last halt must only arrive'
    WHEN coalesce(arr, dep) < before THEN 'time goes back' WHEN dep < arr THEN 'leaves before it arrives'
    WHEN km < km_before THEN 'distance goes back' END AS reason FROM c)""",
        "SELECT reason, count(*) AS halts FROM d WHERE reason IS NOT NULL GROUP BY reason",
    ),
    "apply_overrides": _sql(
        "SELECT station, CASE WHEN station % 14 = 0 THEN 9 ELSE state END::INT AS state, CASE WHEN station % 7 = 0 THEN lat + 0.5 ELSE lat END AS lat FROM s"
    ),
    "rename_closure": """
WITH RECURSIVE x AS (SELECT s_suppkey AS old, s_suppkey + 1 AS new FROM supplier WHERE s_suppkey % 5 <> 0),
c(old, current) AS (SELECT old, new FROM x UNION ALL SELECT c.old, x.new FROM c JOIN x ON c.current = x.old)
SELECT old, max(current) AS current FROM c GROUP BY old""",
    "retired_anti_join": _sql("SELECT type, count(*) AS trips FROM t WHERE days <> 5 GROUP BY type"),
    "line_distance_running": _sql(
        _HOPS, f"SELECT trip, count(*) AS halts, round(sum({_hav('plat', 'plon', 'lat', 'lon')}), 6) AS straight_km FROM hop GROUP BY trip"
    ),
    "zigzag_outliers": _sql(
        _HOPS,
        f"""z AS (SELECT station, {_hav("plat", "plon", "lat", "lon")} AS ab, {_hav("lat", "lon", "nlat", "nlon")} AS bc, {_hav("plat", "plon", "nlat", "nlon")} AS ac FROM hop)""",
        """SELECT station, count(*) AS seen, sum(CASE WHEN ab + bc > 2.5 * ac + 40 THEN 1 ELSE 0 END)::BIGINT AS flagged FROM z
WHERE ab IS NOT NULL AND bc IS NOT NULL GROUP BY station HAVING flagged / seen > 0.3""",
    ),
    "approx_islands": _sql(
        "i AS (SELECT trip, seq, seq - row_number() OVER (PARTITION BY trip ORDER BY seq) AS g FROM h WHERE station % 3 = 0)",
        "SELECT trip, min(seq) AS first, max(seq) AS last, count(*) AS n FROM i GROUP BY trip, g",
    ),
    "minute_at_km": _sql(
        """SELECT x.trip, round(x.dep + (y.arr - x.dep) * ((100 - x.km)::DOUBLE / (y.km - x.km)), 6) AS minute
FROM h x JOIN h y ON y.trip = x.trip AND y.seq = x.seq + 1 WHERE x.km <= 100 AND y.km > 100""",
    ),
    "gap_rows": _sql(
        """SELECT x.trip, x.seq, y.arr - x.dep AS minutes, y.km - x.km AS gap_km, floor(y.arr / 1440) > floor(x.dep / 1440) AS day_change
FROM h x JOIN h y ON y.trip = x.trip AND y.seq = x.seq + 1""",
    ),
    "haversine_pairs": _sql(
        _EDGES, f"SELECT a, b, round({_hav('x.lat', 'x.lon', 'y.lat', 'y.lon')}, 6) AS km FROM e JOIN s x ON x.station = a JOIN s y ON y.station = b"
    ),
    "nearest_station": _sql(
        _POINTS,
        _PAIRS,
        """SELECT point, station, round(km, 6) AS km FROM (SELECT *, row_number() OVER (PARTITION BY point ORDER BY km, station) AS nth FROM pp WHERE km <= 350)
WHERE nth = 1""",
    ),
    "range_join_grid": _sql(_POINTS, _PAIRS, "SELECT point, station, round(km, 6) AS km FROM pp WHERE km <= 25"),
    "nearest_station_any": _sql(
        _POINTS, _PAIRS, "SELECT point, station, round(km, 6) AS km FROM (SELECT *, row_number() OVER (PARTITION BY point ORDER BY km, station) AS nth FROM pp) WHERE nth = 1"
    ),
    "idw_surface_whole": _sql(
        "g AS (SELECT cell, cell // 125 AS y, cell % 125 AS x FROM range(0, 125 * 138) r(cell))",
        "v AS (SELECT station % 45 AS v, (lat - 8) / (29::DOUBLE / 138) AS sy, (lon - 68) / (29::DOUBLE / 125) AS sx FROM s)",
        "SELECT cell, round(sum(v / power(power(y - sy, 2) + power(x - sx, 2) + 1, 2)) / sum(1 / power(power(y - sy, 2) + power(x - sx, 2) + 1, 2)), 6) AS value FROM g, v GROUP BY cell",
    ),
    "idw_surface": _sql(
        "g AS (SELECT cell, 8 + (cell // 20) * 1.5::DOUBLE AS g_lat, 68 + (cell % 20) * 1.5::DOUBLE AS g_lon FROM range(0, 400) r(cell))",
        """SELECT cell, round(sum((station % 45) / power(power(g_lat - lat, 2) + power(g_lon - lon, 2) + 1, 2)) / sum(1 / power(power(g_lat - lat, 2) + power(g_lon - lon, 2) + 1, 2)), 6) AS value
FROM g, s GROUP BY cell""",
    ),
    "same_town_places": _sql(_CENTRES, _TOWN, "SELECT place FROM town"),
    "nearest_stations_scored": _sql(_POINTS, _PAIRS, _scored(120), "SELECT point, station, minutes, score FROM sc"),
    "nearest_stations_scored_whole": _sql(_POINTS, _PAIRS, _scored(350), "SELECT point, station, minutes, score FROM sc"),
    "nearest_stations_diverse": _sql(
        _POINTS,
        _PAIRS,
        _scored(350),
        "z AS (SELECT *, row_number() OVER (PARTITION BY point ORDER BY score, station) AS nth FROM (SELECT sc.*, lat, lon FROM sc JOIN s USING (station)))",
        f"""fo AS (
  SELECT point, nth, [{_CHOICE}] AS chosen, false AS ended FROM z WHERE nth = 1
  UNION ALL
  SELECT point, nth, CASE WHEN ended OR crowded THEN chosen ELSE list_append(chosen, choice) END, ended FROM (
    SELECT z.point, z.nth, chosen, {_CHOICE} AS choice, ended OR len(chosen) >= 4 OR z.minutes > 2.2::DOUBLE * chosen[1].minutes + 60 AS ended,
      {" OR ".join(f"coalesce({_hav(f'chosen[{i}].lat', f'chosen[{i}].lon', 'z.lat', 'z.lon')} < 6, false)" for i in range(1, 5))} AS crowded
    FROM fo JOIN z ON z.point = fo.point AND z.nth = fo.nth + 1))""",
        "la AS (SELECT point, arg_max(chosen, nth) AS chosen FROM fo GROUP BY point)",
        "SELECT point, i::INT AS rank, chosen[i].station AS station, chosen[i].score::DOUBLE AS score FROM la, range(1, 5) r(i) WHERE i <= len(chosen)",
    ).replace("WITH li", "WITH RECURSIVE li", 1),
    "nearest_two_airports": _sql(
        _POINTS,
        _PAIRS,
        """SELECT point, station, rank, round(km, 6) AS km FROM (
  SELECT *, row_number() OVER (PARTITION BY point ORDER BY km, station)::INT AS rank FROM pp WHERE station % 10 = 3 AND km <= 3000) WHERE rank <= 2""",
    ),
    "connections_one_change": _sql(
        _OUT_BOARD,
        _into("snd", "snd_legs"),
        f"""a AS (
  SELECT *, {_on("days", "dep_abs")} AS on_days, row_number() OVER (PARTITION BY place ORDER BY dur, trip, from_seq) AS nth FROM out_legs
  WHERE place NOT IN (SELECT place FROM hub UNION SELECT place FROM snd)),
b AS (
  SELECT *, {_on("days", "dep_abs")} AS on_days, row_number() OVER (PARTITION BY place ORDER BY dur, trip, from_seq) AS nth FROM snd_legs
  WHERE place NOT IN (SELECT place FROM hub UNION SELECT place FROM snd)),
pr AS (
  SELECT a.place, a.trip AS a_trip, b.trip AS b_trip, a.nth AS a_nth, b.nth AS b_nth, a.far_station <> b.far_station AS cross_town,
    CASE WHEN a.far_station <> b.far_station THEN 120 ELSE 45 END AS change, a.dep + a.dur AS arrive, a.dur AS a_dur, b.dur AS b_dur, b.dep AS b_dep,
    a.on_days AS a_on, b.on_days AS b_on, a.days <> 0 AND b.days <> 0 AS known
  FROM a JOIN b USING (place) WHERE a.nth <= 24 AND b.nth <= 24 AND a.trip <> b.trip),
dy AS (SELECT pr.*, d, d * 1440 + arrive AS got, d * 1440 + arrive + change AS ready FROM pr, range(0, 7) r(d) WHERE (a_on >> d) & 1 = 1),
wt AS (
  SELECT dy.*, (SELECT min((ready // 1440 + k) * 1440 + b_dep) FROM range(0, 9) r(k)
    WHERE (ready // 1440 + k) * 1440 + b_dep >= ready AND (b_on >> ((ready // 1440 + k) % 7)) & 1 = 1) - got AS wait FROM dy),
tt AS (SELECT *, a_dur + wait + b_dur AS total FROM wt WHERE wait IS NOT NULL),
pb AS (
  SELECT *, min(total) OVER (PARTITION BY place, a_trip, b_trip, a_nth, b_nth) AS least FROM tt),
pd AS (
  SELECT place, a_trip, b_trip, a_nth, b_nth, cross_town, known, least AS total, min(wait) AS wait, bit_or(1 << d)::INT AS days FROM pb WHERE total = least GROUP BY ALL),
vi AS (
  SELECT *, row_number() OVER (PARTITION BY place ORDER BY total, a_nth, b_nth) AS nth, min(total) OVER (PARTITION BY place) AS top FROM pd),
v2 AS (SELECT vi.*, (SELECT count(*) FROM vi o WHERE o.place = vi.place AND o.total <= vi.top + 180) - 1 AS others FROM vi WHERE nth = 1),
sc AS (
  SELECT v2.*, halts, total + CASE WHEN cross_town THEN 60 ELSE 0 END + greatest(0, wait - 360) / 2.0 AS score FROM v2 LEFT JOIN served USING (place)),
fi AS (
  SELECT *, first_value(total) OVER (ORDER BY score, halts DESC, place) AS best FROM sc),
rk AS (SELECT *, row_number() OVER (ORDER BY score, halts DESC, place)::INT AS rank FROM fi WHERE total <= best * 1.6 + 240)""",
        "SELECT rank, place AS via, a_trip, b_trip, wait, total, days, known, cross_town, others FROM rk WHERE rank <= 6",
    ),
    "rides_on_date": _sql(
        _OUT_BOARD,
        f"""SELECT trip, {4 * 1440 + 1200} + w AS leave, {4 * 1440 + 1200} + w + dur AS arrive, dur
FROM (SELECT *, {_wait("days", "dep_abs", 4 * 1440 + 1200)} AS w FROM out_legs WHERE place = (FROM snd)) ORDER BY arrive, dur, trip LIMIT 6""",
    ),
    "records_longest": _sql(
        "r AS (SELECT trip, count(*) AS halts, max(km) - min(km) AS km, max(arr) - min(dep) AS minutes FROM h GROUP BY trip)",
        "SELECT trip, halts, km, minutes FROM r WHERE km > 0 AND minutes > 0 ORDER BY km DESC, trip LIMIT 1",
    ),
    "records_fastest": _sql(
        "r AS (SELECT trip, max(km) - min(km) AS km, max(arr) - min(dep) AS minutes FROM h GROUP BY trip)",
        "SELECT trip, km, minutes, round(km * 60.0::DOUBLE / minutes, 6) AS speed FROM r WHERE km >= 20 AND minutes > 0 ORDER BY km * 60.0::DOUBLE / minutes DESC, trip LIMIT 1",
    ),
    "records_busiest": _sql("SELECT station, count(*) AS halts, count(DISTINCT trip) AS trips FROM h GROUP BY station ORDER BY halts DESC, station LIMIT 1"),
    "rank_places": _sql(
        _OUT_BOARD,
        _REACH,
        _GUIDES,
        _CENTRES,
        _TOWN,
        """x AS (
  SELECT guide, place, fastest, ln(1 + appeal) + 0.35 * ln(1 + legs) + CASE WHEN is_city THEN 0.4 ELSE 0 END AS score, is_city, halts
  FROM r JOIN g USING (place) WHERE fastest >= 30 AND place NOT IN (FROM town)),
y AS (SELECT *, row_number() OVER (PARTITION BY guide ORDER BY score + CASE WHEN is_city THEN 1 ELSE 0 END + halts * 1e-6 DESC, place) AS nth FROM x)""",
        "SELECT guide, place, fastest AS minutes, round(score, 6) AS score FROM y WHERE nth = 1",
    ),
    "explore_list": _sql(
        _OUT_BOARD,
        _REACH,
        _GUIDES,
        """SELECT guide, place, fastest, appeal FROM (
  SELECT *, row_number() OVER (PARTITION BY guide ORDER BY is_city DESC, fastest, place) AS nth FROM r JOIN g USING (place)) WHERE nth = 1""",
    ),
    "slug_assignment": _alone(
        """b AS (
  SELECT 'P' || p_partkey AS id, p_size % 10 = 0 AS is_city, p_size AS halts,
    regexp_replace(regexp_replace(lower(replace(p_name, '&', ' and ')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS raw FROM part),
c AS (SELECT *, CASE WHEN raw = '' THEN lower(id) ELSE raw END AS base FROM b)""",
        """SELECT id, CASE WHEN row_number() OVER (PARTITION BY base ORDER BY is_city DESC, halts DESC, id) = 1 THEN base ELSE base || '-' || lower(id) END AS slug FROM c""",
    ),
    "search_ladder": _alone(
        """x AS (
  SELECT p_partkey AS id, lower(p_name) AS name, CASE WHEN lower('p' || p_partkey) = 'bl' THEN 5.0 WHEN lower(p_name) = 'bl' THEN 4.6
    WHEN starts_with(lower(p_name), 'bl') THEN 4.0 WHEN regexp_matches(lower(p_name), '(^|[^a-z0-9])bl') THEN 3.0 WHEN contains(lower(p_name), 'bl') THEN 2.0 END AS rule, p_size
  FROM part)""",
        "SELECT id, name, round(rule::DOUBLE + 0.3 * log10(1 + p_size), 6) AS score FROM x WHERE rule IS NOT NULL ORDER BY rule::DOUBLE + 0.3 * log10(1 + p_size) DESC, id LIMIT 8",
    ),
    "train_search": """
(SELECT lpad(p_partkey::VARCHAR, 5, '0') AS no, lower(p_name) AS name FROM part WHERE starts_with(lpad(p_partkey::VARCHAR, 5, '0'), '001') ORDER BY no LIMIT 6)
UNION ALL
(SELECT lpad(p_partkey::VARCHAR, 5, '0') AS no, lower(p_name) AS name FROM part WHERE contains(lower(p_name), 'part')
 ORDER BY CASE WHEN regexp_matches(lower(p_name), '^part') OR strpos(lower(p_name), 'part') = 1 OR substr(lower(p_name), strpos(lower(p_name), 'part') - 1, 1) IN (' ', '(', '-', '–') THEN 2 ELSE 0 END
   + CASE WHEN p_size > 40 THEN 1 ELSE 0 END DESC, no LIMIT 3)""",
    "month_letters": _alone(_CLIMATE, "SELECT station, month::INT AS month, letter FROM le"),
    "month_runs": _alone(
        _CLIMATE,
        """o AS (SELECT station, month, letter IN ('B', 'G', 'R') AS good FROM le),
al AS (SELECT station, bool_and(good) AS everything FROM o GROUP BY station),
st AS (
  SELECT a.station, a.month AS first FROM o a JOIN o b ON a.station = b.station AND b.month = (a.month + 11) % 12 WHERE a.good AND NOT b.good)""",
        """SELECT st.station, first::INT AS first, ((first + (SELECT min(k) FROM range(1, 13) r(k) JOIN o ON o.station = st.station AND o.month = (st.first + k) % 12 WHERE NOT good) - 1) % 12)::INT AS last FROM st
UNION ALL SELECT station, 0, 11 FROM al WHERE everything""",
    ),
    "mood_bits": r"""
SELECT (CASE WHEN len(regexp_extract_all(lower(text), ' the ')) >= 3 THEN 1 ELSE 0 END + CASE WHEN len(regexp_extract_all(lower(text), ' und ')) >= 3 THEN 2 ELSE 0 END
  + CASE WHEN len(regexp_extract_all(lower(text), ' les ')) >= 3 THEN 4 ELSE 0 END + CASE WHEN len(regexp_extract_all(text, '[0-9]{4}')) >= 3 THEN 8 ELSE 0 END
  + CASE WHEN len(regexp_extract_all(text, '@')) >= 3 THEN 16 ELSE 0 END)::INT AS moods, count(*) AS documents FROM documents GROUP BY moods""",
    "state_label_median": _sql(
        """SELECT state, list_sort(list(lon))[count(*) // 2 + 1] AS x, list_sort(list(lat))[count(*) // 2 + 1] AS y FROM s GROUP BY state HAVING count(*) >= 6""",
    ),
    "sqrt_time_buckets": _sql(
        _OUT_BOARD,
        "SELECT least(27, floor(sqrt(greatest(0, dur) / 2160.0::DOUBLE) * 28))::INT AS bucket, count(*) AS legs, min(dur) AS least, max(dur) AS most FROM out_legs GROUP BY bucket",
    ),
    "symmetric_pair_lookup": _sql(
        "x AS (SELECT trip, arg_min(place, seq) AS a, arg_max(place, seq) AS b FROM hp GROUP BY trip)",
        "SELECT least(a, b) AS lo, greatest(a, b) AS hi, count(*) AS trips FROM x GROUP BY lo, hi",
    ),
    "places_served_by_kind": _sql(
        "SELECT place, max((type <> 'Toy')::INT) AS main_line, max((type = 'Toy')::INT) AS toy FROM hp JOIN t USING (trip) GROUP BY place"
    ),
    "consensus_mask": """
WITH c AS (SELECT o_custkey % 50 AS key, o_custkey % 50 % 7 + CASE WHEN o_orderkey % 1000 = 0 THEN 1 ELSE 0 END AS value FROM orders)
SELECT key, any_value(value) AS value, count(*) AS claims FROM c GROUP BY key HAVING count(DISTINCT value) = 1""",
    "renumber_match": _sql(
        "x AS (SELECT trip, arg_min(station, seq) AS a, arg_max(station, seq) AS b, count(*) AS halts FROM hp GROUP BY trip)",
        """y AS (
  SELECT o.trip AS old, n.trip AS new FROM x o JOIN x n ON o.trip % 2 = 0 AND n.trip % 2 = 1 AND o.halts = n.halts AND ((o.a = n.a AND o.b = n.b) OR (o.a = n.b AND o.b = n.a)))""",
        "SELECT old, new FROM y WHERE old IN (SELECT old FROM y GROUP BY old HAVING count(*) = 1) AND new IN (SELECT new FROM y GROUP BY new HAVING count(*) = 1)",
    ),
    "renumber_resolution": _sql(
        """x AS (
  SELECT trip, a, b, CASE WHEN type IN ('Pass', 'MEMU') THEN type END AS word
  FROM (SELECT trip, arg_min(station, seq) AS a, arg_max(station, seq) AS b FROM hp GROUP BY trip) JOIN t USING (trip))""",
        f"cl AS (SELECT x.station AS s, y.station AS t FROM s x, s y WHERE x.station = y.station OR {_hav('x.lat', 'x.lon', 'y.lat', 'y.lon')} < 30)",
        "w AS (SELECT trip, word, a AS f, b AS g FROM x WHERE trip % 2 = 1 UNION SELECT trip, word, b, a FROM x WHERE trip % 2 = 1)",
        """m AS (
  SELECT o.trip AS old, w.trip AS new, coalesce(max((o.word = w.word)::INT), 0) AS named
  FROM x o JOIN cl p ON p.s = o.a JOIN cl q ON q.s = o.b JOIN w ON w.f = p.t AND w.g = q.t WHERE o.trip % 2 = 0 GROUP BY ALL)""",
        "r AS (SELECT old, CASE WHEN count(*) = 1 THEN min(new) WHEN sum(named) = 1 THEN max(CASE WHEN named = 1 THEN new END) END AS new FROM m GROUP BY old)",
        "SELECT old, new FROM r WHERE new IS NOT NULL",
    ),
    "track_shortest_path": _sql(
        _EDGES,
        f"tr AS (SELECT a, b, {_hav('x.lat', 'x.lon', 'y.lat', 'y.lon')} AS km FROM e JOIN s x ON x.station = a JOIN s y ON y.station = b)",
        "bo AS (SELECT a, b, km FROM tr WHERE km <= 300 UNION ALL SELECT b, a, km FROM tr WHERE km <= 300)",
        """wa AS (
  SELECT 1::BIGINT AS node, 0::DOUBLE AS km, 0 AS steps
  UNION ALL
  SELECT b, min(wa.km + bo.km), steps + 1 FROM wa JOIN bo ON bo.a = wa.node
  WHERE wa.km + bo.km <= 2500 AND steps < (SELECT count(*) FROM s) GROUP BY b, steps)""",
        "SELECT node, round(min(km), 6) AS km FROM wa GROUP BY node",
    ).replace("WITH li", "WITH RECURSIVE li", 1),
    "staleness_check": _sql(
        "th AS (SELECT trip, CASE WHEN trip % 50 = 0 THEN 0 ELSE days END AS days FROM t WHERE trip % 77 <> 0)",
        """u AS (SELECT 'published' AS side FROM (SELECT trip, days FROM th EXCEPT ALL SELECT trip, days FROM t)
  UNION ALL SELECT 'built' FROM (SELECT trip, days FROM t EXCEPT ALL SELECT trip, days FROM th))""",
        "SELECT side, count(*) AS rows FROM u GROUP BY side",
    ),
    "folded_names": """
WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '\\p{L}+')) AS word FROM documents)
SELECT word, lower(strip_accents(word)) AS folded FROM w""",
    "saves_last_writer_wins": _alone(_SAVES, 'SELECT "user", key, "at", deleted, data FROM w'),
    "saves_prune": _alone(_SAVES, f'SELECT "user", key, "at", deleted, data FROM w WHERE NOT deleted OR (SELECT max("at") FROM sv) - "at" < {10 * 24 * 3600 * 1000}'),
    "stations_in_boxes": _sql(
        """SELECT station, CASE
  WHEN lat >= 12 AND lat < 18 AND lon >= 76 AND lon < 82 AND NOT (lat >= 13 AND lat < 15 AND lon >= 77 AND lon < 79) THEN 'hole'
  WHEN lat >= 25 AND lat < 37 AND lon >= 70 AND lon < 82 THEN 'north' WHEN lat >= 8 AND lat < 17 AND lon >= 74 AND lon < 83 THEN 'south' END AS in_state FROM s""",
    ),
    "sitemap_urls": _sql(
        """f AS (SELECT trip, place AS a, min(seq) AS s1, arg_min(dep, seq) AS dep FROM hp WHERE dep IS NOT NULL GROUP BY trip, place),
r AS (
  SELECT a, place AS b, min(arr - f.dep) AS fastest FROM f JOIN hp ON hp.trip = f.trip AND hp.seq > s1 AND place <> a GROUP BY a, place)""",
        """SELECT '/from/' || a || '/to/' || b AS url, fastest FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY fastest, b) AS nth FROM r) WHERE nth <= 30""",
    ),
}

_BGR = "BGRMHWC"
_LETTERS = " || ".join(f"substr('{_BGR}', ((k * {i + 3}) % 7 + 1)::INT, 1)" for i in range(12))
_FAME = ", ".join(f"(population * {i}) % 61" for i in range(1, 8))
_GOOD = "substr(letters, month + 1, 1) IN ('B', 'G', 'R')"
ORACLE_SQL |= {
    "place_lenses": f"""
WITH p AS (
  SELECT p_partkey AS place, p_partkey::INT AS k, {_LETTERS.replace("k *", "p_partkey::INT *")} AS letters, (p_partkey % 12)::INT AS month,
    (p_partkey % 32)::INT AS moods, CASE WHEN p_partkey % 5 = 0 THEN 'wd' END AS source, (p_partkey % 6)::INT AS sights,
    (p_partkey * 37 % 60000)::INT AS population, p_partkey % 3 = 0 AS hilly FROM part)
SELECT place, (moods & 2) <> 0 AND {_GOOD} AS fits, {_GOOD} AS good, source IS NULL OR sights >= 3 AS worthwhile,
  population = 0 OR population >= 20000 OR (hilly AND population >= 5000) AS roads, population * 5 >= 150000 AND NOT hilly AS doubtful,
  sights + 3 * (moods % 4) + CASE WHEN hilly THEN 6 ELSE 0 END AS appeal,
  round(list_sum(list_transform(list_reverse_sort([{_FAME}])[1:5], lambda x: least(x, 40)))::DOUBLE / 8 + 7, 1) AS fame,
  round(0.3::DOUBLE * log10(1 + sights) + CASE WHEN hilly THEN 0.6::DOUBLE ELSE 0 END, 6) AS lift
FROM p""",
    "trip_calendar": """
WITH e AS (
  SELECT event_id, ts, (event_id * 61 % 4000)::INT AS wait, ((isodow(ts) - 1) * 1440 + hour(ts) * 60 + minute(ts))::INT AS now FROM events),
d AS (SELECT *, ((now % 1440 + wait) // 1440)::INT AS days, (ts::DATE + (wait * 7 // 1440)::INT)::DATE AS day FROM e)
SELECT event_id, now,
  CASE days WHEN 0 THEN 'today' WHEN 1 THEN 'tomorrow'
    ELSE ['Monday', 'Tuesday', 'Wednesday', 'Thursday', 'Friday', 'Saturday', 'Sunday'][(now // 1440 + days) % 7 + 1] END AS word,
  day::VARCHAR AS day, (day - ts::DATE) BETWEEN 0 AND 15 AS forecast
FROM d""",
    "from_places": BASE + "," + _IN_LEGS + """,
l AS (SELECT place, min(dur) AS fastest, count(DISTINCT trip) AS trips FROM in_legs GROUP BY place)
SELECT * FROM (SELECT row_number() OVER (ORDER BY place % 4 = 0 DESC, fastest, place)::INT AS rank, place, fastest, trips FROM l) WHERE rank <= 8""",
    "halts_of_note": BASE + """,
b AS (SELECT station, count(*) AS at_station FROM h GROUP BY station)
SELECT trip, seq, station FROM h JOIN b USING (station) WHERE arr IS NULL OR dep IS NULL OR dep - arr >= 5 OR at_station >= 90""",
    "fuzzy_candidates": """
SELECT n_nationkey AS id, lower(n_name) AS name, damerau_levenshtein(lower(n_name), 'nation_33')::DOUBLE AS slips
FROM nation WHERE lower(n_name) LIKE 'n%' AND damerau_levenshtein(lower(n_name), 'nation_33') <= 2""",
    "fnv_shard": """
WITH f AS (
  SELECT p_partkey, list_reduce(list_prepend(2166136261::HUGEINT, list_transform(range(1, length(p_name) + 1), lambda i: ascii(substr(p_name, i, 1))::HUGEINT)),
    lambda h, b: (xor(h, b) * 16777619::HUGEINT) % 4294967296::HUGEINT)::BIGINT AS hash FROM part)
SELECT p_partkey, hash, hash % 32 AS shard FROM f""",
}

_TO_WORDS = "translate(({k})::VARCHAR, '0123456789', 'abcdefghij')"
_TOWNS = f"""
tw AS (
  SELECT c_custkey AS town, 'Town ' || {_TO_WORDS.format(k="c_custkey % 97")} AS name, c_nationkey % 5 AS state, c_custkey * 37 % 9000 AS population,
    (8 + (c_custkey * 41 % 2900) / 100.0::DOUBLE) AS lat, (68 + (c_custkey * 59 % 2900) / 100.0::DOUBLE) AS lon FROM customer)"""
_MONTHS = "['January', 'February', 'March', 'April', 'May', 'June', 'July', 'August', 'September', 'October', 'November', 'December']"


def _said(kinds: str) -> str:
    """The runs of these letters in words: each month that begins one, and how far the letters behind it go on."""
    on = f"regexp_replace(regexp_replace(letters, '[^{kinds}]', '0', 'g'), '[{kinds}]', '1', 'g')"
    begins = f"list_filter([1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 0], lambda i: substr({on}, i + 1, 1) = '1' AND substr({on}, (i + 11) % 12 + 1, 1) = '0')"
    more = f"(11 - length(ltrim(substr({on} || {on}, i + 1, 12), '1')))"
    words = f"CASE WHEN {more} = 0 THEN {_MONTHS}[i + 1] ELSE {_MONTHS}[i + 1] || ' to ' || {_MONTHS}[(i + {more}) % 12 + 1] END"
    return f"CASE WHEN {on} = '111111111111' THEN 'all year' ELSE array_to_string(list_transform({begins}, lambda i: {words}), ' and ') END"


_STEPS = "[120, 250, 330, 500, 960, 1280, 1920]"
ORACLE_SQL |= {
    "when_lines": _alone(
        _CLIMATE,
        "y AS (SELECT station, string_agg(letter, '' ORDER BY month) AS letters FROM le GROUP BY station)",
        f"z AS (SELECT station, {_said('BG')} AS best, {_said('W')} AS wet, {_said('H')} AS hot, {_said('C')} AS cold FROM y)",
        """SELECT station, concat_ws(' ',
  CASE WHEN best = 'all year' THEN 'Good all year round: go whenever you like.' WHEN best <> '' THEN 'Best from ' || best || '.' END,
  CASE WHEN wet <> '' THEN wet || ': the monsoon pours.' END, CASE WHEN hot <> '' THEN hot || ': too hot for most, carry water.' END,
  CASE WHEN cold <> '' THEN cold || ': properly cold, pack the woollens.' END) AS line FROM z""",
    ),
    "guide_index": """
WITH p AS (SELECT n_nationkey AS place, 'Town G' || (n_nationkey * 3 % 60) AS name, n_nationkey % 4 = 0 AS is_city, 'g' || (n_nationkey * 3 % 60) AS city FROM nation),
a AS (SELECT 'g' || k AS title, k * 37 % 45 AS appeal, k % 3 <> 0 AS icon FROM (SELECT DISTINCT p_partkey % 50 AS k FROM part)),
l AS (
  SELECT s_nationkey AS place, s_suppkey AS pos, CASE WHEN s_suppkey % 3 = 0 THEN 'g' || (s_suppkey * 7 % 60) END AS title,
    ['g' || (s_suppkey * 11 % 70), 'g' || (s_suppkey * 13 % 60), 'g' || (s_suppkey * 17 % 80)] AS near FROM supplier),
o AS (
  SELECT place, name, is_city, CASE WHEN is_city AND city IN (SELECT title FROM a) THEN city
    ELSE (SELECT title FROM l WHERE l.place = p.place AND title IN (SELECT title FROM a) ORDER BY pos LIMIT 1) END AS own FROM p),
n AS (
  SELECT place, title, row_number() OVER (PARTITION BY place ORDER BY min(pos * 10 + i)) AS ord
  FROM (SELECT place, pos, i, near[i] AS title FROM l, range(1, 4) r(i)) WHERE title IN (SELECT title FROM a) GROUP BY place, title),
m AS (SELECT n.* FROM n JOIN o USING (place) WHERE own IS NULL OR n.title <> own),
st AS (
  SELECT place, title AS star, appeal FROM (
    SELECT m.place, m.title, a.appeal, row_number() OVER (PARTITION BY m.place ORDER BY a.appeal DESC, m.ord) AS nth
    FROM m JOIN a USING (title) WHERE icon AND title NOT IN (SELECT own FROM o WHERE own IS NOT NULL)) WHERE nth = 1),
j AS (
  SELECT o.*, star, st.appeal AS fame, coalesce(a.appeal, 0) AS mine FROM o LEFT JOIN st USING (place) LEFT JOIN a ON a.title = own),
w AS (
  SELECT *, coalesce(NOT is_city AND fame >= 12 AND fame > CASE WHEN contains(lower(name), lower(own)) THEN mine * 3.5 + 10 ELSE mine * 1.8 + 4 END, false) AS wins FROM j),
f AS (
  SELECT place, CASE WHEN wins THEN star ELSE own END AS title, wins AND (own IS NOT NULL OR NOT contains(lower(name), lower(star))) AS featured FROM w)
SELECT place, title, featured, coalesce((
  SELECT string_agg(other, '|' ORDER BY ord) FROM (SELECT m.title AS other, ord FROM m WHERE m.place = f.place AND m.title <> f.title ORDER BY ord LIMIT 4)), '') AS nearby
FROM f WHERE title IS NOT NULL""",
    "stationless_towns": _sql(
        _TOWNS,
        f"g AS (SELECT 'town' || {_TO_WORDS.format(k='station % 97')} AS key, lat, lon FROM s)",
        f"""r AS (
  SELECT *, regexp_replace(lower(name), '[^a-z]', '', 'g') AS key FROM tw
  WHERE NOT EXISTS (SELECT 1 FROM s WHERE {_hav("tw.lat", "tw.lon", "s.lat", "s.lon")} <= 8))""",
        f"k AS (SELECT * FROM r WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.key = r.key AND {_hav('r.lat', 'r.lon', 'g.lat', 'g.lon')} < 30))",
        """SELECT town, name, state, population FROM (
  SELECT *, row_number() OVER (PARTITION BY key, state ORDER BY population DESC, town) AS nth FROM k) WHERE nth = 1""",
    ),
    "nearest_start": _sql(
        _TOWNS,
        "b AS (SELECT station, count(*) AS halts FROM h GROUP BY station)",
        """d AS (
  SELECT town AS point, station, halts, sqrt(power((s.lat - tw.lat) * 111, 2) + power((s.lon - tw.lon) * 111 * cos(radians(tw.lat)), 2)) AS km
  FROM tw, s JOIN b USING (station))""",
        """SELECT point, station, round(km, 6) AS km FROM (
  SELECT *, row_number() OVER (PARTITION BY point ORDER BY km >= 25, CASE WHEN km < 25 THEN -halts ELSE 0 END, km, station) AS nth
  FROM d WHERE km <= 150) WHERE nth = 1""",
    ),
    "ways_by_road": _sql(
        _OUT_BOARD,
        _TOWNS,
        "ri AS (SELECT place, min(dur) AS train FROM out_legs GROUP BY place)",
        f"""pr AS (
  SELECT town AS spot, station, place, train, {_HILLS.replace("lat", "tw.lat").replace("lon", "tw.lon")} AS hills, {_hav("tw.lat", "tw.lon", "s.lat", "s.lon")} AS km
  FROM tw, s JOIN ri USING (place))""",
        """wy AS (
  SELECT spot, station, place, train, floor(floor(km * (CASE WHEN hills THEN 1.45 ELSE 1.3 END)::DOUBLE + 2 + 0.5)
    / (CASE WHEN hills THEN 32.0 ELSE 45.0 END)::DOUBLE * 60 / 5 + 0.5)::BIGINT * 5 + 10 AS road FROM pr WHERE km <= 350)""",
        """on1 AS (
  SELECT * FROM (SELECT *, train + 30 + road AS total, row_number() OVER (PARTITION BY spot, place ORDER BY train + 30 + road, station) AS k FROM wy) WHERE k = 1)""",
        """SELECT spot, station, train, road, total FROM (
  SELECT *, row_number() OVER (PARTITION BY spot ORDER BY total, station) AS nth, min(total) OVER (PARTITION BY spot) AS best FROM on1)
WHERE nth <= 3 AND total <= best * 1.4::DOUBLE + 120""",
    ),
    "surprise_place": _sql(
        """SELECT place, (place * 7) % 40 AS appeal FROM served
ORDER BY -ln((('0x' || substr(md5(place || ':7'), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE) / sqrt(1 + (place * 7) % 40), place LIMIT 1""",
    ),
    "photo_widths": f"""
WITH p AS (
  SELECT p_partkey, p_partkey * 29 % 2100 AS w, p_partkey * 43 % 2300 AS want, p_partkey % 3 AS who, p_partkey % 4 = 0 AS cc FROM part),
s AS (SELECT *, coalesce(list_min(list_filter({_STEPS}, lambda x: x >= want)), 1920) AS first FROM p),
t AS (SELECT *, CASE WHEN w = 0 OR first < w THEN first ELSE coalesce(list_max(list_filter({_STEPS}, lambda x: x < w)), 0) END::INT AS step FROM s)
SELECT p_partkey, step,
  CASE WHEN p_partkey % 5 = 0 THEN 'https://x/a/P.jpg' ELSE 'https://x/a/' || CASE WHEN step > 0 THEN step ELSE 330 END || 'px-P' || p_partkey || '.jpg' END AS url,
  CASE WHEN who = 2 AND NOT cc THEN 'A file ' || p_partkey || ' · Wikimedia Commons'
    ELSE CASE WHEN who = 1 THEN 'Ann' ELSE 'Unknown author' END || CASE WHEN cc THEN ', CC BY' ELSE '' END END AS credit,
  CASE WHEN p_partkey % 400 >= 300 THEN 105 WHEN p_partkey % 400 >= 40 THEN 135 ELSE 160 END AS speed
FROM t""",
    "track_snap": _recursive(_TRACK, "SELECT station, b.node AS node, round(b.km, 6) AS km FROM snapped"),
    "track_bridges": _recursive(_TRACK, "SELECT a, t.b AS b, round(t.km, 6) AS km FROM bridged"),
    "track_contract": _recursive(_TRACK, "SELECT a, b, round(km, 6) AS km FROM tg"),
    "track_routes": _recursive(
        _EDGES,
        _TRACK,
        f"""asked AS (
  SELECT x.b.node AS a, y.b.node AS b FROM e JOIN snapped x ON x.station = e.a JOIN snapped y ON y.station = e.b
  JOIN ts u ON u.station = e.a JOIN ts v ON v.station = e.b WHERE {_hav('u.lat', 'u.lon', 'v.lat', 'v.lon')} BETWEEN 15 AND 250)""",
        _ROUTES,
        "SELECT a, b, round(w.km, 6) AS km, array_to_string(w.way, ' ') AS way FROM ways",
    ),
    "track_paths": _recursive(
        _TRACK,
        f"""str AS (
  SELECT x.trip, x.seq, x.station AS sa, y.station AS sb FROM h x JOIN h y ON y.trip = x.trip AND y.seq = x.seq + 1
  JOIN ts u ON u.station = x.station JOIN ts v ON v.station = y.station
  WHERE x.station <> y.station AND NOT (x.trip % 4 = 0 AND x.seq % 2 = 0) AND {_hav('u.lat', 'u.lon', 'v.lat', 'v.lon')} BETWEEN 15 AND 250),
asked AS (SELECT DISTINCT x.b.node AS a, y.b.node AS b FROM str JOIN snapped x ON x.station = sa JOIN snapped y ON y.station = sb)""",
        _ROUTES,
        """on_way AS (SELECT a, b, unnest(w.way) AS node, unnest(range(1, len(w.way) + 1)) AS pos FROM ways),
via AS (
  SELECT a, b, array_to_string(list(station ORDER BY pos, station), ' ') AS via FROM (
    SELECT o.a, o.b, s.station, min(o.pos) AS pos FROM on_way o JOIN snapped s ON s.b.node = o.node WHERE o.node <> o.a AND o.node <> o.b GROUP BY ALL) GROUP BY ALL)""",
        "SELECT trip, seq, via FROM str JOIN snapped x ON x.station = sa JOIN snapped y ON y.station = sb JOIN via ON via.a = x.b.node AND via.b = y.b.node",
    ),
    "stitched_trips": _sql("SELECT trip, seq, station * 100 + seq AS code, arr, dep FROM h"),
    "book_faults": _sql(
        _READ,
        _stretches("rr", "st"),
        """cl AS (SELECT trip, seq, unnest([arr, dep]) AS tm, unnest([0, 1]) AS k FROM rr),
cb AS (SELECT trip FROM (SELECT trip, tm, lag(tm) OVER (PARTITION BY trip ORDER BY seq, k) AS b FROM cl WHERE tm IS NOT NULL) WHERE tm < b),
ce AS (SELECT trip, arg_min(struct_pack(d := dep), seq).d AS dep, arg_max(struct_pack(d := arr), seq).d AS arr, bool_or(code IS NULL) AS none, bool_or(coalesce(dep - arr > 360, false)) AS long FROM rr GROUP BY trip),
cs AS (SELECT trip, arg_min(fault, seq) AS fault FROM st WHERE fault IS NOT NULL GROUP BY trip),
cf AS (SELECT trip, count(*) AS n, max(abs(lat - first)) * 111.19492664455873 AS reach, any_value(abs(last - first)) * 111.19492664455873 AS across FROM (
  SELECT trip, lat, first_value(lat) OVER w AS first, last_value(lat) OVER w AS last FROM rr JOIN rp USING (code) WINDOW w AS (PARTITION BY trip ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) GROUP BY trip)""",
        """SELECT trip, CASE WHEN none THEN 'station not identified' WHEN ce.dep IS NULL OR ce.arr IS NULL THEN 'no start or end time' WHEN trip IN (FROM cb) THEN 'time runs backwards'
  WHEN long THEN 'halt of more than 6 hours' WHEN fault IS NOT NULL THEN fault WHEN cf.n >= 3 AND reach > 1.35 * across + 350 THEN 'doubles back' ELSE '' END AS reason
FROM ce LEFT JOIN cs USING (trip) LEFT JOIN cf USING (trip)""",
    ),
    "repaired_trips": _sql(
        _READ,
        "go AS (SELECT trip, seq, code, arr, dep, kind FROM rh WHERE NOT (kind IS NOT DISTINCT FROM 4 AND seq = p AND n > 2))",
        _stretches("go", "st"),
        """SELECT trip, seq * 10 AS seq, code, arr, dep, (CASE WHEN kind IN (2, 4) THEN 1 ELSE 0 END)::INT AS dropped,
  (CASE WHEN kind = 3 OR kind = 1 AND trip IN (FROM rs) THEN 1 ELSE 0 END)::INT AS days
FROM go WHERE trip NOT IN (SELECT trip FROM st WHERE fault IS NOT NULL)""",
    ),
    "resolved_names": _alone(
        _BOOK,
        f"""bh AS (
  SELECT ask, br.code, rule, a.lat IS NULL AS free, {_hav('a.lat', 'a.lon', 'p.lat', 'p.lon')} AS km, ask % 4 = 0 AND br.code = ask AS known,
    CASE WHEN ask % 2 = 0 THEN 30 * 1.08::DOUBLE + 6 ELSE 400 END AS reach
  FROM br JOIN bp p ON p.code = br.code LEFT JOIN bp a ON a.code = CASE ask % 3 WHEN 1 THEN ask WHEN 2 THEN ask - 1 END),
bf AS (SELECT * FROM bh WHERE free OR km <= reach),
b1 AS (SELECT bf.* FROM bf JOIN (SELECT ask, min(rule) AS rule FROM bf GROUP BY ask) USING (ask, rule)),
b2 AS (SELECT * FROM b1 WHERE known OR ask NOT IN (SELECT ask FROM b1 WHERE known)),
b3 AS (SELECT ask, any_value(rule) AS rule, CASE WHEN NOT any_value(free) OR count(*) = 1 THEN min(struct_pack(km, code)).code END AS code FROM b2 GROUP BY ask)""",
        "SELECT bw.code AS ask, b3.code AS code, b3.rule::INT AS rule FROM bw LEFT JOIN b3 ON b3.ask = bw.code",
    ),
    "threaded_halts": _sql(
        """pu AS (SELECT trip, seq, station, seq % 3 <> 1 OR (trip + seq) % 4 = 0 AS calls FROM h),
fi AS (SELECT trip, min(seq) AS first, max(seq) AS last FROM pu WHERE calls GROUP BY trip)""",
        "SELECT trip, seq - first AS pos, station * 100 + seq AS code, CASE WHEN calls THEN seq END AS seq FROM pu JOIN fi USING (trip) WHERE seq BETWEEN first AND last",
    ),
    "rename_chains": """
WITH RECURSIVE x AS (
  SELECT p_partkey AS old, CASE WHEN p_partkey // 100 % 3 = 0 AND p_partkey % 100 = 99 THEN p_partkey - 49 ELSE p_partkey + 1 END AS new
  FROM part WHERE p_partkey % 100 <> 0 AND (p_partkey % 100 <> 99 OR p_partkey // 100 % 3 = 0)),
c(old, current, seen) AS (
  SELECT old, old, []::BIGINT[] FROM x
  UNION ALL SELECT c.old, x.new, list_append(seen, c.current) FROM c JOIN x ON c.current = x.old WHERE NOT list_contains(seen, c.current))
SELECT old, arg_max(current, len(seen)) AS current FROM c GROUP BY old""",
    "coast_distance": f"""
WITH k AS (
  SELECT p_partkey // 50 AS line, p_partkey % 50 AS pos, 8 + p_partkey // 50 * 53 % 290 / 10.0::DOUBLE + (p_partkey * 7 % 5) * 0.03::DOUBLE AS lat,
    68 + p_partkey // 50 * 37 % 290 / 10.0::DOUBLE + p_partkey % 50 * 0.05::DOUBLE AS lon FROM part),
g AS (
  SELECT a.lon AS x0, a.lat AS y0, b.lon AS x1, b.lat AS y1 FROM (SELECT *, row_number() OVER (PARTITION BY line ORDER BY pos) AS i FROM k) a
  JOIN (SELECT *, row_number() OVER (PARTITION BY line ORDER BY pos) AS i FROM k) b ON b.line = a.line AND b.i = a.i + 1),
p AS (SELECT c_custkey AS point, (8 + (c_custkey * 41 % 2900) / 100.0::DOUBLE) AS lat, (68 + (c_custkey * 59 % 2900) / 100.0::DOUBLE) AS lon FROM customer),
f AS (
  SELECT point, (x0 - lon) * 111 * cos(radians(lat)) AS ax, (y0 - lat) * 111 AS ay, (x1 - x0) * 111 * cos(radians(lat)) AS vx, (y1 - y0) * 111 AS vy
  FROM p JOIN g ON floor(lon / 0.5) BETWEEN floor(least(x0, x1) / 0.5) - 1 AND floor(greatest(x0, x1) / 0.5) + 1
    AND floor(lat / 0.5) BETWEEN floor(least(y0, y1) / 0.5) - 1 AND floor(greatest(y0, y1) / 0.5) + 1),
t AS (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, -(ax * vx + ay * vy) / (vx * vx + vy * vy))) AS t FROM f),
d AS (SELECT point, min(sqrt((ax + t * vx) * (ax + t * vx) + (ay + t * vy) * (ay + t * vy))) AS km FROM t GROUP BY point)
SELECT point, coalesce(round(km, 6), 'inf'::DOUBLE) AS km FROM p LEFT JOIN d USING (point)""",
    "listing_templates": """
WITH w AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[A-Za-z]{3,}')[1], 'none') AS a, coalesce(regexp_extract_all(text, '[A-Za-z]{3,}')[2], 'none') AS b,
    coalesce(regexp_extract_all(text, '[A-Za-z]{3,}')[3], 'none') AS c FROM documents)
SELECT doc_id, 0::INT AS nth, 'see' AS kind, a AS name, '{{x|' || b || '|do=1}} and [[' || c || '|' || a || ']], ''''fine''''' AS content, 'and ' || a || ', fine' AS words, c AS name2 FROM w
UNION ALL SELECT doc_id, 1, 'do', b, '', '', '' FROM w
UNION ALL SELECT doc_id, 2, 'eat', c, '', '', '' FROM w""",
    "search_places": """
WITH q AS (SELECT 'smlal gizmo' AS q),
n AS (SELECT p_partkey AS id, lower(p_name) AS name, 'p' || p_partkey AS code, 0.3::DOUBLE * log10(1 + p_size) AS lift FROM part),
r AS (
  SELECT *, CASE WHEN code = q THEN 5.0::DOUBLE WHEN name = q THEN 4.6 WHEN starts_with(name, q) THEN 4.0
    WHEN len(list_filter(regexp_split_to_array(name, '[^a-z0-9]+'), lambda w: starts_with(w, q))) > 0 THEN 3.0 WHEN contains(name, q) THEN 2.0 END AS rule,
    CASE WHEN name[1] = q[1] THEN list_min(list_filter(list_concat([damerau_levenshtein(q, name)::DOUBLE],
      list_transform(list_filter([len(q) - 1, len(q), len(q) + 1], lambda k: len(name) > greatest(len(q), k)), lambda k: damerau_levenshtein(q, name[1:k]) + 0.5::DOUBLE)), lambda d: d <= 2.5)) END AS slip
  FROM n, q),
s AS (SELECT *, coalesce(rule, 2.4::DOUBLE - 0.5::DOUBLE * slip) + lift AS score FROM r WHERE rule IS NOT NULL OR slip IS NOT NULL)
SELECT id, name, round(score, 6) AS score, CASE WHEN rule IS NULL THEN slip ELSE 0 END AS slip FROM s
WHERE rule IS NOT NULL OR (SELECT count(*) FROM s WHERE rule IS NOT NULL AND score >= 3.3) < 3 ORDER BY s.score DESC, id LIMIT 8""",
    "timetable_file_roundtrip": _sql("""SELECT trip, seq, station, arr, dep, km, (seq % 2)::INT AS approx,
  CASE type WHEN 'Superfast' THEN 0 WHEN 'Express' THEN 1 WHEN 'Pass' THEN 2 WHEN 'MEMU' THEN 3 WHEN 'Toy' THEN 4 ELSE 9 END AS type, coalesce(days, 0) AS days
FROM h LEFT JOIN t USING (trip)"""),
    "paths_file_roundtrip": _sql("""SELECT trip, seq AS after, (station + 1) || ' 7' AS stations FROM h WHERE station % 3 = 0"""),
    "states_on_map": _SHAPES + """,
h AS (
  SELECT point, c, e.name FROM p JOIN e ON (y0 > lat) <> (y1 > lat) AND lon < (x1 - x0) * (lat - y0) / (y1 - y0) + x0 GROUP BY point, c, e.name HAVING count(*) % 2 = 1),
i AS (SELECT point, arg_min(name, (c % 4) * 1000000000 + c) AS here FROM h GROUP BY point),
m AS (SELECT point, name AS mine FROM d WHERE km <= 1.2),
o AS (SELECT point, name AS closest FROM d QUALIFY row_number() OVER (PARTITION BY point ORDER BY km, name) = 1),
j AS (
  SELECT p.point, current, here, closest, here IS NOT NULL AND mine IS NOT NULL AND mine <> here AND NOT (current = 's1' AND here = 's2') AS stays
  FROM p LEFT JOIN i USING (point) LEFT JOIN m ON m.point = p.point AND mine = current LEFT JOIN o ON o.point = p.point)
SELECT point, CASE WHEN stays THEN current ELSE coalesce(here, closest, current) END AS state,
  CASE WHEN stays THEN 'border' WHEN here IS NOT NULL THEN '' WHEN closest IS NOT NULL THEN 'coast' ELSE 'outside' END AS why FROM j""",
    "edges_nearby": _SHAPES + " SELECT point, name, round(km, 6) AS km FROM d",
    "chart_years": """
WITH m AS (
  SELECT doc_id, m, ((doc_id + m) % 50 - 20)::DOUBLE AS low, ((doc_id + m) % 50 - 12)::DOUBLE AS high, (doc_id * 7 + m) % 400 + 0.5::DOUBLE AS rain
  FROM (SELECT DISTINCT doc_id FROM documents), range(12) t(m)),
y AS (SELECT doc_id, string_agg(CASE WHEN high < 10 OR low < -6 THEN 'C' WHEN rain >= 300 THEN 'W' WHEN high >= 39 THEN 'H' WHEN rain >= 140 THEN 'R' WHEN high >= 35 THEN 'M' WHEN high BETWEEN 16 AND 32 AND rain < 70 AND low >= 4 THEN 'B' ELSE 'G' END, '' ORDER BY m) AS letters, string_agg(round_even(low, 0)::BIGINT || ',' || round_even(high, 0)::BIGINT || ',' || round_even(rain, 0)::BIGINT, ',' ORDER BY m) AS flat FROM m WHERE doc_id % 5 NOT IN (0, 2) GROUP BY doc_id)
SELECT doc_id, CASE WHEN flat IS NULL THEN '' ELSE 'imd' END AS source, coalesce(letters, '') AS letters, flat FROM documents LEFT JOIN y USING (doc_id)""",
    "climate_normals": """
WITH c AS (SELECT 16 + p_partkey % 59 AS cy, 108 + p_partkey // 59 % 48 AS cx, max(p_partkey) AS k FROM part GROUP BY ALL),
p AS (
  SELECT c_custkey AS point, CASE WHEN c_custkey % 10 <> 0 THEN c_custkey * 13 % 2500 END AS height,
    round_even((8 + (c_custkey * 41 % 2900) / 100.0::DOUBLE) / 0.5, 0)::BIGINT AS cy, round_even((68 + (c_custkey * 59 % 2900) / 100.0::DOUBLE) / 0.625::DOUBLE, 0)::BIGINT AS cx FROM customer),
g AS (SELECT p.*, k, coalesce((height - CASE WHEN k % 9 <> 0 THEN k * 11 % 2000 END) * 0.0065::DOUBLE, 0.0::DOUBLE) AS shift FROM p LEFT JOIN c USING (cy, cx)),
e AS (
  SELECT point, m, 'est' AS source, (5 + (k * 7 + m * 3) % 20)::DOUBLE - shift AS low, (5 + (k * 7 + m * 3) % 20 + 5 + (k + m) % 12)::DOUBLE - shift AS high,
    (k * m % 13)::DOUBLE * CASE WHEN m = 1 THEN 28.25::DOUBLE WHEN m IN (3, 5, 8, 10) THEN 30 ELSE 31 END AS rain
  FROM g, range(12) t(m) WHERE k IS NOT NULL AND point % 3 <> 0
  UNION ALL SELECT point, m, 'imd', (point % 30 - m)::DOUBLE, (point % 30 + m)::DOUBLE, (point * m % 350)::DOUBLE FROM p, range(12) t(m) WHERE point % 3 = 0),
y AS (SELECT point, source, string_agg(CASE WHEN high < 10 OR low < -6 THEN 'C' WHEN rain >= 300 THEN 'W' WHEN high >= 39 THEN 'H' WHEN rain >= 140 THEN 'R' WHEN high >= 35 THEN 'M' WHEN high BETWEEN 16 AND 32 AND rain < 70 AND low >= 4 THEN 'B' ELSE 'G' END, '' ORDER BY m) AS letters, string_agg(round_even(low, 0)::BIGINT || ',' || round_even(high, 0)::BIGINT || ',' || round_even(rain, 0)::BIGINT, ',' ORDER BY m) AS flat FROM e GROUP BY point, source)
SELECT point, coalesce(source, '') AS source, coalesce(letters, '') AS letters, flat FROM p LEFT JOIN y USING (point)""",
}

_MOVES = f"""WITH found AS (SELECT * FROM ({ORACLE_SQL["renumber_resolution"]})),
took AS (SELECT old, new, min(old) OVER (PARTITION BY new) AS first FROM found),
moves AS (
  SELECT o_orderkey AS old, new, CASE WHEN new IS NULL THEN 'unlisted' WHEN new % 3 = 0 OR first <> o_orderkey THEN 'duplicate' ELSE 'renumbered' END AS status
  FROM orders LEFT JOIN took ON old = o_orderkey WHERE o_orderkey % 2 = 0)"""

ORACLE_SQL |= {
    "renumber_moves": _MOVES + " SELECT old, new, status FROM moves",
    "renumbered_halts": f"""{_MOVES},
p AS (SELECT * FROM ({BASE} SELECT trip, seq, place, arr, dep FROM hp)),
c AS (SELECT *, row_number() OVER w AS i, lag(place) OVER w AS before FROM p WINDOW w AS (PARTITION BY trip ORDER BY seq))
SELECT coalesce(m.new, c.trip) AS trip, seq, place, arr, dep FROM c LEFT JOIN moves m ON m.old = c.trip AND m.status = 'renumbered'
WHERE c.trip % 2 = 0 AND (i = 1 OR place IS DISTINCT FROM before)""",
    "newer_without_known": """
SELECT (o_orderkey + 1) || '/' || (o_orderkey + 5) AS numbers, o_orderkey AS after FROM orders
WHERE o_orderkey + 1 NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 4 = 0) AND o_orderkey + 5 NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 4 = 0)""",
}
