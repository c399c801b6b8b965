"""Queries of the survey and terrain operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoanswers.functions import geom
from geoanswers.meta import to_metres
from geoanswers.operators import survey, terrain
from geoanswers.plans.attributes import rounded
from geoanswers.plans.spatial import POINTS, SITES
from geoanswers.plans.tables import cells, legs, points, sites, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
ORDER = ["l_linenumber", "l_partkey", "l_suppkey"]
_DEG = "(SELECT id, 28.9 + x / 10000 AS lon, 41 + y / 10000 AS lat FROM " + POINTS + ")"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _degrees(s, d):
    return points(s, d).select("id", "c_nationkey", (28.9 + F.col("x") / 10000).alias("lon"), (41 + F.col("y") / 10000).alias("lat"))


#: The inverse problem on WGS84, twelve rounds of the series; every pair of the query converges in fewer.
_VINCENTY = f"""WITH RECURSIVE k AS (SELECT 1 / 298.257223563 AS f, 6378137.0 AS a), p AS (SELECT id, radians(28.9 + x / 10000) AS o1, radians(41 + y / 10000) AS l1, radians(29.0) AS o2, radians(41.01) AS l2 FROM {POINTS} WHERE id % 50 <> 0),
u AS (SELECT id, f, a, o2 - o1 AS gap, sin(atan((1 - f) * tan(l1))) AS s1, cos(atan((1 - f) * tan(l1))) AS c1, sin(atan((1 - f) * tan(l2))) AS s2, cos(atan((1 - f) * tan(l2))) AS c2 FROM p, k),
r AS (SELECT *, gap AS turn, 0 AS n FROM u UNION ALL SELECT id, f, a, gap, s1, c1, s2, c2, gap + (1 - c) * f * sa * (arc + c * ss * (cm + c * cs * (2 * cm * cm - 1))), n + 1 FROM (
  SELECT *, f / 16 * (1 - sa * sa) * (4 + f * (4 - 3 * (1 - sa * sa))) AS c, cs - 2 * s1 * s2 / (1 - sa * sa) AS cm, atan2(ss, cs) AS arc FROM (
    SELECT *, c1 * c2 * sin(turn) / ss AS sa FROM (SELECT *, sqrt(power(c2 * sin(turn), 2) + power(c1 * s2 - s1 * c2 * cos(turn), 2)) AS ss, s1 * s2 + c1 * c2 * cos(turn) AS cs FROM r WHERE n < 12))) q),
e AS (SELECT *, cs - 2 * s1 * s2 / (1 - sa * sa) AS cm, atan2(ss, cs) AS arc, (1 - sa * sa) * (1 / power(1 - f, 2) - 1) AS k FROM (SELECT *, c1 * c2 * sin(turn) / ss AS sa FROM (
  SELECT *, sqrt(power(c2 * sin(turn), 2) + power(c1 * s2 - s1 * c2 * cos(turn), 2)) AS ss, s1 * s2 + c1 * c2 * cos(turn) AS cs FROM r WHERE n = 12))),
t AS (SELECT *, 1 + k / 16384 * (4096 + k * (-768 + k * (320 - 175 * k))) AS big, k / 1024 * (256 + k * (-128 + k * (74 - 47 * k))) AS small FROM e)
SELECT id, round(a * (1 - f) * big * (arc - small * ss * (cm + small / 4 * (cs * (2 * cm * cm - 1) - small / 6 * cm * (4 * ss * ss - 3) * (4 * cm * cm - 3)))), 2) AS distance_m, 'ellipsoidal' AS method FROM t
UNION ALL SELECT id, NULL, 'refused' FROM {POINTS} WHERE id % 50 = 0"""


@query("pair_distances", _VINCENTY)
def _pairs(s, d):
    lon = F.when(F.col("id") % 50 == 0, 200.0).otherwise(F.col("lon"))
    p = _degrees(s, d).select("id", lon.alias("from_lon"), F.col("lat").alias("from_lat"), F.lit(29.0).alias("to_lon"), F.lit(41.01).alias("to_lat"))
    return rounded(survey.pair_distances(p).select("id", "distance_m", "method"), 2)


@query("unit_lengths", """SELECT l_orderkey % 3 AS unit, count(*) AS legs, round(sum(l_quantity * CASE l_orderkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 1000 ELSE 0.3048 END), 4) AS metres,
  round(sum(l_quantity * CASE l_orderkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 1000 ELSE 0.3048 END) / 0.3048, 3) AS feet FROM lineitem GROUP BY 1""")
def _unit_lengths(s, d):
    """Legs in metres, kilometres and feet, in metres and in feet."""
    k, far = F.col("traverse_id") % 3, F.col("distance_m")
    metres = F.when(k == 0, to_metres(far, "m")).when(k == 1, to_metres(far, "km")).otherwise(to_metres(far, "ft"))
    out = legs(s, d).groupBy(k.alias("unit")).agg(F.count("*").alias("legs"), F.sum(metres).alias("m"))
    return out.select("unit", "legs", F.round("m", 4).alias("metres"), F.round(F.col("m") / to_metres(1, "ft"), 3).alias("feet"))


@query("set_out", f"SELECT id, round(x + 100 * sin(radians(id % 360)), 6) AS to_x, round(y + 100 * cos(radians(id % 360)), 6) AS to_y FROM {POINTS}")
def _set_out(s, d):
    p = points(s, d).select("id", "x", "y", (F.col("id") % 360).cast("double").alias("azimuth_deg"), F.lit(100.0).alias("distance_m"))
    return rounded(survey.set_out(p).select("id", "to_x", "to_y"), 6)


_STATIONS = """(SELECT l_orderkey AS traverse_id, row_number() OVER w AS seq, sum(l_quantity * sin(radians(l_partkey % 360))) OVER (w ROWS UNBOUNDED PRECEDING) AS x, sum(l_quantity * cos(radians(l_partkey % 360))) OVER (w ROWS UNBOUNDED PRECEDING) AS y, l_quantity AS distance_m
FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey))"""


@query("traverse", f"SELECT traverse_id, CAST(seq AS INTEGER) AS seq, round(x, 6) AS x, round(y, 6) AS y, distance_m FROM {_STATIONS}")
def _traverse(s, d):
    return rounded(survey.traverse(legs(s, d), ORDER), 6)


@query("closure", f"""SELECT traverse_id, count(*) AS legs, round(sum(distance_m), 6) AS perimeter, round(arg_max(sqrt(x * x + y * y), seq), 6) AS misclosure, round(abs(sum(c) / 2), 5) AS area
FROM (SELECT *, coalesce(lag(x) OVER (PARTITION BY traverse_id ORDER BY seq), 0) * y - x * coalesce(lag(y) OVER (PARTITION BY traverse_id ORDER BY seq), 0) AS c FROM {_STATIONS}) GROUP BY 1""")
def _closure(s, d):
    c = survey.closure(legs(s, d), ORDER)
    return c.select("traverse_id", "legs", F.round("perimeter", 6).alias("perimeter"), F.round("misclosure", 6).alias("misclosure"), F.round("area", 5).alias("area"))


@query("station_offset", f"""SELECT p.id, round(((p.x - 100) * 600 + (p.y - t.y) * 800) / 1000, 6) AS station, round(((p.x - 100) * 800 - (p.y - t.y) * 600) / 1000, 6) AS "offset",
CASE WHEN ((p.x - 100) * 800 - (p.y - t.y) * 600) > 0 THEN 'right' WHEN ((p.x - 100) * 800 - (p.y - t.y) * 600) < 0 THEN 'left' ELSE 'on' END AS side, CASE WHEN ((p.x - 100) * 600 + (p.y - t.y) * 800) < 0 THEN 'before' WHEN ((p.x - 100) * 600 + (p.y - t.y) * 800) > 1000000 THEN 'after' ELSE 'along' END AS position
FROM {POINTS} p JOIN (SELECT id AS line, y FROM {SITES}) t ON p.id % 50 = t.line""")
def _offset(s, d):
    p = points(s, d).select("id", (F.col("id") % 50).alias("line"), "x", "y")
    t = sites(s, d).select(F.col("id").alias("line"), F.lit(100.0).alias("x1"), F.col("y").alias("y1"), F.lit(700.0).alias("x2"), (F.col("y") + 800).alias("y2"))
    return rounded(survey.station_offset(p, t, "line").select("id", "station", "offset", "side", "position"), 6)


#: Every site is a baseline of three legs; each point against the nearest leg of all.
_BASELINES = f"""(SELECT id AS line, leg, x + [0, 30, 30, 60][leg + 1] AS x1, y + [0, 0, 40, 80][leg + 1] AS y1, x + [30, 30, 60][leg + 1] AS x2, y + [0, 40, 80][leg + 1] AS y2, [0, 30, 70][leg + 1] AS base, [30, 40, 50][leg + 1] AS size
  FROM {SITES}, (SELECT unnest([0, 1, 2]) AS leg))"""


@query("station_offset_nearest", f"""WITH m AS (SELECT p.id, p.x, p.y, t.*, ((p.x - x1) * (x2 - x1) + (p.y - y1) * (y2 - y1)) / size AS along, ((p.x - x1) * (y2 - y1) - (p.y - y1) * (x2 - x1)) / size AS across FROM {POINTS} p, {_BASELINES} t),
d AS (SELECT *, sqrt(power(x - x1 - greatest(0, least(along, size)) * (x2 - x1) / size, 2) + power(y - y1 - greatest(0, least(along, size)) * (y2 - y1) / size, 2)) AS far FROM m),
f AS (SELECT *, CASE WHEN along < 0 AND leg = 0 THEN 'before' WHEN along > size AND leg = 2 THEN 'after' ELSE 'along' END AS position FROM d
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(far, 9), line, leg) = 1)
SELECT id, line, round(base + CASE WHEN position = 'along' THEN greatest(0, least(along, size)) ELSE along END, 5) AS station,
  round(CASE WHEN position = 'along' AND (along < 0 OR along > size) THEN far * CASE WHEN across < 0 THEN -1 ELSE 1 END ELSE across END, 5) AS "offset", position FROM f""")
def _offset_nearest(s, d):
    x, y = F.col("x"), F.col("y")
    bends = F.array(*[F.struct((x + a).alias("x"), (y + b).alias("y")) for a, b in ((0, 0), (30, 0), (30, 40), (60, 80))])
    lines = sites(s, d).select("id", geom.geometry("linestring", F.array(F.array(bends))).alias("geom"))
    return rounded(survey.station_offset_nearest(points(s, d), lines).drop("side"), 5)


#: Vincenty's direct series along the legs of an order, from a start in degrees; a leg of 7 units is broken, every 50th order has no start.
_CHAINED = """WITH RECURSIVE c AS (SELECT 1 / 298.257223563 AS f, 6378137.0 AS a),
l AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS seq, radians(l_partkey % 360) AS az, CASE WHEN l_quantity <> 7 THEN l_quantity * 1000 END AS s FROM lineitem),
w AS (SELECT DISTINCT k, 0::BIGINT AS seq, radians(k % 300 - 150) AS lon, radians(k % 120 - 60) AS lat FROM l WHERE k % 50 <> 0
UNION ALL SELECT k, seq, lon + atan2(sin(g) * sin(az), c1 * cos(g) - s1 * sin(g) * cos(az)) - (1 - q) * f * sa * (g + q * sin(g) * (cos(2 * g1 + g) + q * cos(g) * (2 * power(cos(2 * g1 + g), 2) - 1))),
  atan2(s1 * cos(g) + c1 * sin(g) * cos(az), (1 - f) * sqrt(sa * sa + power(s1 * sin(g) - c1 * cos(g) * cos(az), 2)))
FROM (SELECT *, f / 16 * ca2 * (4 + f * (4 - 3 * ca2)) AS q, list_reduce([s / (b * big), 0, 0, 0, 0, 0, 0, 0], lambda v, i: s / (b * big) + small * sin(v) * (cos(2 * g1 + v)
    + small / 4 * (cos(v) * (2 * power(cos(2 * g1 + v), 2) - 1) - small / 6 * cos(2 * g1 + v) * (4 * power(sin(v), 2) - 3) * (4 * power(cos(2 * g1 + v), 2) - 3)))) AS g
  FROM (SELECT *, 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u))) AS big, u / 1024 * (256 + u * (-128 + u * (74 - 47 * u))) AS small
  FROM (SELECT *, 1 - sa * sa AS ca2, (1 - sa * sa) * (power(a, 2) - power(b, 2)) / power(b, 2) AS u, atan2(s1, c1 * cos(az)) AS g1
  FROM (SELECT *, c1 * sin(az) AS sa FROM (SELECT l.*, w.lon, f, a, a * (1 - f) AS b, sin(atan((1 - f) * tan(w.lat))) AS s1, cos(atan((1 - f) * tan(w.lat))) AS c1 FROM w JOIN l ON l.k = w.k AND l.seq = w.seq + 1, c WHERE l.s IS NOT NULL))))))
SELECT l.k AS traverse_id, l.seq, round(degrees(lon) - 360 * floor((degrees(lon) + 180) / 360), 8) AS lon, round(degrees(lat), 8) AS lat,
  CASE WHEN l.k % 50 = 0 THEN 'no_start' WHEN lat IS NULL THEN 'broken' ELSE 'ok' END AS status FROM l LEFT JOIN w ON w.k = l.k AND w.seq = l.seq"""


@query("traverse_geodesic", _CHAINED)
def _traverse_geodesic(s, d):
    l = legs(s, d).withColumn("distance_m", F.when(F.col("distance_m") != 7, F.col("distance_m") * 1000))
    k = F.col("traverse_id")
    starts = l.filter(k % 50 != 0).groupBy("traverse_id").agg(F.count("*").alias("n")).select("traverse_id", (k % 300 - 150).alias("lon"), (k % 120 - 60).alias("lat"))
    return rounded(survey.traverse_geodesic(l, starts, ORDER).select("traverse_id", "seq", "lon", "lat", "status"), 8)


@query("ground_distances", "SELECT l_orderkey AS traverse_id, round(sum(l_quantity), 4) AS grid_m, round(sum(l_quantity / (0.9996 * (6371008.8 / (6371008.8 + l_partkey % 500)))), 4) AS ground_m FROM lineitem GROUP BY 1")
def _ground(s, d):
    l = legs(s, d)
    return rounded(survey.ground_distances(l, F.lit(0.9996), (F.col("l_partkey") % 500).cast("double")).select("traverse_id", "grid_m", "ground_m"), 4)


@query("normalise_coordinates", """SELECT c_custkey AS id, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE round((c_custkey % 80 + (c_custkey % 60) / 60.0 + 30.5 / 3600) * CASE WHEN c_custkey % 2 = 0 THEN -1 ELSE 1 END, 9) END AS lat_deg, round((c_custkey % 180)::DOUBLE + 0.25, 9) AS lon_deg, c_custkey % 9 <> 0 AS ok FROM customer""")
def _normalise(s, d):
    k = F.col("c_custkey")
    text = F.concat((k % 80).cast("string"), F.lit("°"), (k % 60).cast("string"), F.lit("' 30.5\" "), F.when(k % 2 == 0, "S").otherwise("N"))
    c = table(s, d, "customer").select(k.alias("id"), F.when(k % 9 == 0, "north").otherwise(text).alias("lat"), ((k % 180) + 0.25).cast("string").alias("lon"))
    return rounded(survey.normalise_coordinates(c, "lat", "lon").select("id", "lat_deg", "lon_deg", "ok"), 9)


#: The Krueger series to third order in the third flattening, on WGS84, for positions north of the equator.
_UTM = """WITH p AS (SELECT radians(41 + y / 10000) AS phi, radians(28.9 + x / 10000 - 27) AS lam, 35 AS zone FROM {points}),
k AS (SELECT *, sqrt(f * (2 - f)) AS e, 6378137.0 / (1 + n) * (1 + n ** 2 / 4 + n ** 4 / 64) AS radius, n / 2 - 2 * n ** 2 / 3 + 5 * n ** 3 / 16 AS a1, 13 * n ** 2 / 48 - 3 * n ** 3 / 5 AS a2, 61 * n ** 3 / 240 AS a3
  FROM (SELECT 1 / 298.257223563 AS f, (1 / 298.257223563) / (2 - 1 / 298.257223563) AS n)),
t AS (SELECT p.*, k.*, sinh(atanh(sin(phi)) - e * atanh(e * sin(phi))) AS t FROM p, k),
u AS (SELECT *, atan2(t, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + t * t)) AS eta FROM t),
g AS (SELECT zone, 500000 + 0.9996 * radius * (eta + a1 * cos(2 * xi) * sinh(2 * eta) + a2 * cos(4 * xi) * sinh(4 * eta) + a3 * cos(6 * xi) * sinh(6 * eta)) AS east,
  0.9996 * radius * (xi + a1 * sin(2 * xi) * cosh(2 * eta) + a2 * sin(4 * xi) * cosh(4 * eta) + a3 * sin(6 * xi) * cosh(6 * eta)) AS north FROM u)
SELECT zone, false AS south, CAST(floor(east / 1000) AS BIGINT) AS square_e, CAST(floor(north / 1000) AS BIGINT) AS square_n, count(*) AS count FROM g GROUP BY ALL"""


@query("grid_bins", _UTM.format(points=POINTS))
def _bins(s, d):
    return survey.grid_bins(_degrees(s, d))


_CELLS = "(SELECT o_orderkey // 100 AS r, o_orderkey % 100 AS c, o_totalprice AS z FROM orders)"
_N = {n: (dr, dc) for n, (dr, dc) in zip("abcdefghi", [(-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 0), (0, 1), (1, -1), (1, 0), (1, 1)])}
_HOOD = "(SELECT e.r, e.c AS k, e.z AS e, " + ", ".join(f"coalesce({n}_.z, e.z) AS {n}" for n in _N if n != "e") + f" FROM {_CELLS} e " + " ".join(f"LEFT JOIN {_CELLS} {n}_ ON {n}_.r = e.r + {dr} AND {n}_.c = e.c + {dc}" for n, (dr, dc) in _N.items() if n != "e") + ")"
_GX, _GY = "(((c + 2 * f + i) - (a + 2 * d + g)) * 0.01 / 80)", "(((g + 2 * h + i) - (a + 2 * b + c)) * 0.01 / 80)"
_ASPECT = f"CASE WHEN {_GX} = 0 AND {_GY} = 0 THEN -1.0 ELSE (90 - degrees(atan2({_GY}, -{_GX})) + 360) - 360 * floor((90 - degrees(atan2({_GY}, -{_GX})) + 360) / 360) END"
_OUT = "0 AS raster_id, CAST(r AS INTEGER) AS row, CAST(k AS INTEGER) AS col"


@query("slope", f"SELECT {_OUT}, round(degrees(atan(sqrt(power({_GX}, 2) + power({_GY}, 2)))), 6) AS slope FROM {_HOOD}")
def _slope(s, d):
    return rounded(terrain.slope(cells(s, d), 10, 0.01), 6)


@query("aspect", f"SELECT {_OUT}, round({_ASPECT}, 5) AS aspect FROM {_HOOD}")
def _aspect(s, d):
    return rounded(terrain.aspect(cells(s, d), 10, 0.01), 5)


@query("hillshade", f"SELECT {_OUT}, round(255 * greatest(cos(radians(45)) * cos(atan(sqrt(power({_GX}, 2) + power({_GY}, 2)))) + sin(radians(45)) * sin(atan(sqrt(power({_GX}, 2) + power({_GY}, 2)))) * cos(radians(315) - radians({_ASPECT})), 0), 5) AS hillshade FROM {_HOOD}")
def _hillshade(s, d):
    return rounded(terrain.hillshade(cells(s, d), 10, 0.01), 5)


@query("ruggedness", f"SELECT {_OUT}, round(sqrt({' + '.join(f'power({n} - e, 2)' for n in _N if n != 'e')}), 4) AS ruggedness FROM {_HOOD}")
def _ruggedness(s, d):
    return rounded(terrain.ruggedness(cells(s, d)), 4)


@query("roughness", f"SELECT {_OUT}, round(greatest(a, b, c, d, e, f, g, h, i) - least(a, b, c, d, e, f, g, h, i), 4) AS roughness FROM {_HOOD}")
def _roughness(s, d):
    return rounded(terrain.roughness(cells(s, d)), 4)


def _plane(s, d):
    """cells on a plane that rises 3 a column and 1 a row, so contours are straight."""
    return cells(s, d).withColumn("z", F.col("col") * 3.0 + F.col("row"))


#: Marching squares in SQL: of each square the crossings in order around it; the plane has two or none.
_EDGES = [("z0", "z1", "c + {t}", "r"), ("z1", "z3", "c + 1", "r + {t}"), ("z3", "z2", "c + 1 - {t}", "r + 1"), ("z2", "z0", "c", "r + 1 - {t}")]
_CROSSED = ", ".join(
    f"CASE WHEN ({p} >= level) <> ({q} >= level) THEN {{'x': {x.format(t=f'(level - {p}) / ({q} - {p})')}, 'y': {y.format(t=f'(level - {p}) / ({q} - {p})')}}} END"
    for p, q, x, y in _EDGES
)


@query("contours", f"""WITH g AS (SELECT o_orderkey // 100 AS r, o_orderkey % 100 AS c FROM orders),
q AS (SELECT a.r, a.c, a.c * 3.0::DOUBLE + a.r AS z0, z0 + 3 AS z1, z0 + 1 AS z2, z0 + 4 AS z3 FROM g a JOIN g b ON b.r = a.r + 1 AND b.c = a.c + 1 JOIN g d ON d.r = a.r AND d.c = a.c + 1 JOIN g e ON e.r = a.r + 1 AND e.c = a.c),
l AS (SELECT q.*, 10.0::DOUBLE * v AS level FROM q, range(0, 100000) t(v) WHERE 10 * v > z0 AND 10 * v <= z0 + 4),
p AS (SELECT level, list_filter([{_CROSSED}], lambda x: x IS NOT NULL) AS p FROM l)
SELECT level, round(p[1].x, 6) AS x1, round(p[1].y, 6) AS y1, round(p[2].x, 6) AS x2, round(p[2].y, 6) AS y2 FROM p""")
def _contours(s, d):
    return rounded(terrain.contours(_plane(s, d), 10.0).drop("raster_id").withColumn("level", F.col("level").cast("double")), 6)


#: The steepest lower neighbour, the first of equals in reading order; every cell's way down, step by step.
_DROPS = {n: f"(e - {n})" + ("" if 0 in _N[n] else " * (1 / sqrt(2.0))") for n in _N if n != "e"}
_BEST = f"greatest({', '.join(_DROPS.values())})"
_DOWN = f"""n AS (SELECT r, k, CASE WHEN {_BEST} > 0 THEN CASE {" ".join(f"WHEN {v} = {_BEST} THEN [r + {_N[n][0]}, k + {_N[n][1]}]" for n, v in _DROPS.items())} END END AS way FROM {_HOOD}),
w AS (SELECT r AS r0, k AS k0, r, k, 0 AS steps FROM n UNION ALL SELECT w.r0, w.k0, n.way[1], n.way[2], steps + 1 FROM w JOIN n ON n.r = w.r AND n.k = w.k WHERE n.way IS NOT NULL)"""


@query("watershed", f"""WITH RECURSIVE {_DOWN} SELECT 0 AS raster_id, CAST(r0 AS INTEGER) AS row, CAST(k0 AS INTEGER) AS col,
  CAST(arg_max(r, steps) AS INTEGER) AS pit_row, CAST(arg_max(k, steps) AS INTEGER) AS pit_col FROM w GROUP BY r0, k0""")
def _watershed(s, d):
    return terrain.watershed(cells(s, d)).select("raster_id", "row", "col", F.col("pit_row").cast("int").alias("pit_row"), F.col("pit_col").cast("int").alias("pit_col"))


@query("flow_accumulation", f"""WITH RECURSIVE {_DOWN} SELECT 0 AS raster_id, CAST(r AS INTEGER) AS row, CAST(k AS INTEGER) AS col, count_if(steps > 0)::BIGINT AS upstream FROM w GROUP BY r, k""")
def _flow(s, d):
    return terrain.flow_accumulation(cells(s, d))


@query("raster_band_range", """SELECT o_orderkey::INTEGER AS band, lo AS min, hi AS max, array_to_string(list_transform([0, 1, 2, 3, 4], lambda i: format('{:.2f}', round(lo + i * (hi - lo) / 4, 4))), ',') AS stops FROM (SELECT o_orderkey % 3 AS o_orderkey, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders GROUP BY 1)""")
def _band(s, d):
    o = table(s, d, "orders").select((F.col("o_orderkey") % 3).cast("int").alias("band"), F.col("o_totalprice").alias("z"))
    return terrain.raster_band_range(o)
