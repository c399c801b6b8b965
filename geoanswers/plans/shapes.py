"""Queries of the geometry operators, and their SQL where rectangles allow it."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoanswers.functions import geom
from geoanswers.operators import sjoin, vector
from geoanswers.plans.attributes import rounded
from geoanswers.plans.spatial import BOXES, LOTS, METRES, POINTS
from geoanswers.plans.tables import boxes, cells, lots, points, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
_MEET = "l.x0 < b.x1 AND b.x0 < l.x1 AND l.y0 < b.y1 AND b.y0 < l.y1"
_AREA = "(least(l.x1, b.x1) - greatest(l.x0, b.x0)) * (least(l.y1, b.y1) - greatest(l.y0, b.y0))"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _sized(df, *ids):
    return df.select(*ids, "status", F.round(geom.area(F.col("geom")), 3).alias("area"))


@query("reproject", f"SELECT id, round(radians(28.9 + x / 10000) * 6378137.0, 3) AS x, round(ln(tan(pi() / 4 + radians(41 + y / 10000) / 2)) * 6378137.0, 3) AS y FROM {POINTS}")
def _reproject(s, d):
    p = points(s, d).withColumn("geom", geom.point(28.9 + F.col("x") / 10000, 41 + F.col("y") / 10000))
    v = F.get(geom.vertices(F.col("geom")), F.lit(0))
    return rounded(vector.reproject(p, "EPSG:4326", "EPSG:3857").select("id", v["x"].alias("x"), v["y"].alias("y")), 3)


@query("reproject_utm", f"SELECT id, round(28.9 + x / 10000, 7) AS lon, round(41 + y / 10000, 7) AS lat, true AS inside FROM {POINTS}")
def _utm(s, d):
    p = points(s, d).withColumn("geom", geom.point(28.9 + F.col("x") / 10000, 41 + F.col("y") / 10000))
    there = vector.reproject(p, "EPSG:4326", "EPSG:32635")
    e = F.get(geom.vertices(F.col("geom")), F.lit(0))
    there = there.withColumn("inside", e["x"].between(600000, 700000) & e["y"].between(4500000, 4600000))
    back = vector.reproject(there, "EPSG:32635", "EPSG:4326")
    return back.select("id", F.round(e["x"], 7).alias("lon"), F.round(e["y"], 7).alias("lat"), "inside")


@query("centroid", f"SELECT id, round(x0 + w / 2, 6) AS x, round(y0 + h / 2, 6) AS y FROM {LOTS}")
def _centroid(s, d):
    v = F.get(geom.vertices(F.col("geom")), F.lit(0))
    return rounded(vector.centroids(lots(s, d)).select("id", v["x"].alias("x"), v["y"].alias("y")), 6)


@query("buffer", f"SELECT id, 'ok' AS status, round(0.5 * 32 * 100 * sin(2 * pi() / 32), 3) AS area FROM {POINTS} UNION ALL SELECT -id - 1, 'ok', round(w * h + 2 * (w + h) * 10 + 0.5 * 32 * 100 * sin(2 * pi() / 32), 3) FROM {LOTS}")
def _buffer(s, d):
    both = points(s, d).select("id", "geom").union(lots(s, d).select((-F.col("id") - 1).alias("id"), "geom"))
    return _sized(vector.buffer(both, 10, METRES), "id")


#: A line an order: a zigzag of (lines + 2) vertices along x, its teeth 1, 5 or 20 m high; beside it a polygon with a hole.
_TEETH = "(SELECT l_orderkey AS id, count(*) + 2 AS n, CASE l_orderkey % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 5.0 ELSE 20.0 END AS h FROM lineitem GROUP BY 1)"


@query("simplify", f"""SELECT id, 'ok' AS status, n + 10 AS before, CASE WHEN h > 10 THEN n + 9 ELSE 11 END AS after, round(CASE WHEN h > 10 THEN (n - 1) * sqrt(10000 + h * h)
  ELSE sqrt(power(100 * (n - 1), 2) + power(CASE WHEN n % 2 = 0 THEN h ELSE 0 END, 2)) END + 960 + 80 * sqrt(2), 3) AS length FROM {_TEETH}""")
def _simplify(s, d):
    """Multi-part lines: the zigzag, an outline of 100 m sides with a vertex in the middle of one, and one of 40 m sides."""
    k, at = F.col("id"), lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    t = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg((F.count("*") + 2).alias("n"))
    h = F.when(k % 3 == 0, 1.0).when(k % 3 == 1, 5.0).otherwise(20.0)
    teeth = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda i: at(i * 100, (i % 2) * h))
    corners = [(0, 0), (100, 0), (200, 0), (200, 200), (0, 200), (0, 0)]
    big = F.array(*[at(F.lit(x + 1000), F.lit(y)) for x, y in corners])
    small = F.array(*[at(F.lit(x + 2000), F.lit(y)) for x, y in [(0, 0), (80, 0), (80, 80), (0, 0)]])
    lines = t.select("id", geom.geometry("multilinestring", F.array(F.array(teeth), F.array(big), F.array(small))).alias("geom"))
    out = vector.simplify(lines, 10, METRES)
    return out.select("id", "status", "before", "after", F.round(geom.length(F.col("geom")), 3).alias("length"))


#: Points on a lattice of 10 by 10: hulls of nations have closed sides.
@query("convex_hull", f"""SELECT CAST(id AS VARCHAR) AS "group", 4::BIGINT AS vertices, round(w * h, 3) AS area FROM {LOTS}
UNION ALL SELECT CAST(-id - 1 AS VARCHAR), 5::BIGINT, round(w * h + w * h / 2, 3) FROM {LOTS}""")
def _hull(s, d):
    """The corners, centre and middles of each lot; and the same with a gable on top."""
    l, x, y, w, h = lots(s, d), F.col("x0"), F.col("y0"), F.col("w"), F.col("h")
    spots = [(i, j) for i in (0.0, 0.5, 1.0) for j in (0.0, 0.5, 1.0)]
    dots = lambda more: F.explode(F.array(*[F.struct((x + i * w).alias("x"), (y + j * h).alias("y")) for i, j in spots + more])).alias("p")
    both = l.select(F.col("id"), dots([])).union(l.select((-F.col("id") - 1).alias("id"), dots([(0.5, 2.0)])))
    hulls = vector.convex_hull(both.select("id", geom.point(F.col("p.x"), F.col("p.y")).alias("geom")), "id")
    return hulls.select("group", "vertices", F.round(geom.area(F.col("geom")), 3).alias("area"))


@query("dissolve", """SELECT o_orderkey // 100 AS "group", CAST(2 * count(*) + 2 AS BIGINT) AS sides, count(*) * 100.0::DOUBLE AS area, count(*) * 20.0::DOUBLE + 20 AS perimeter,
  1::BIGINT AS rings, count(*) * 100.0::DOUBLE AS merged_area, count(*) * 20.0::DOUBLE + 20 AS merged_perimeter FROM orders GROUP BY 1""")
def _dissolve(s, d):
    c = cells(s, d)
    x, y = F.col("col") * 10.0, F.col("row") * 10.0
    grid = c.select(F.col("row").cast("long").alias("row"), geom.box(x, y, x + 10, y + 10).alias("geom"))
    merged = vector.dissolve(grid, "row")
    return rounded(merged.select("*", geom.area(F.col("geom")).alias("merged_area"), geom.length(F.col("geom")).alias("merged_perimeter")).drop("geom"), 3)


#: Lots of a brand overlap. A union's area and outline, from slabs between neighbouring sides: how much of each the lots cover,
#: and in how many stretches.
def _slabs(a, b):
    """SQL of covered (area) and open (length of the outline across the slabs) by brand; a is the axis that is cut."""
    return f"""(WITH cuts AS (SELECT brand, {a}0 AS lo, lead({a}0) OVER (PARTITION BY brand ORDER BY {a}0) AS hi
    FROM (SELECT brand, {a}0 FROM rects UNION SELECT brand, {a}1 FROM rects)),
  held AS (SELECT c.brand, lo, hi, {b}0 AS p, {b}1 AS q, max({b}1) OVER (PARTITION BY c.brand, lo ORDER BY {b}0, {b}1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
    FROM cuts c JOIN rects r ON r.brand = c.brand AND r.{a}0 <= c.lo AND r.{a}1 >= c.hi WHERE hi IS NOT NULL)
  SELECT brand, sum((hi - lo) * greatest(q - greatest(p, coalesce(before, p)), 0)) AS covered, sum(CASE WHEN before IS NULL OR p > before THEN 2 * (hi - lo) ELSE 0 END) AS open FROM held GROUP BY 1)"""


@query("dissolve_overlaps", f"""WITH rects AS (SELECT p_brand AS brand, l.id, round(x0, 1) AS x0, round(y0, 1) AS y0, round(x1, 1) AS x1, round(y1, 1) AS y1 FROM {LOTS} l JOIN part ON p_partkey = l.id)
SELECT brand AS "group", round(v.covered, 2) AS area, round(v.open + h.open, 2) AS perimeter, (SELECT min(id) FROM rects r WHERE r.brand = brand_) AS id
FROM (SELECT *, brand AS brand_ FROM {_slabs('x', 'y')}) v JOIN {_slabs('y', 'x')} h USING (brand)""")
def _dissolve_overlaps(s, d):
    merged = vector.dissolve(lots(s, d), "label", ("id",))
    return merged.select("group", F.round("area", 2).alias("area"), F.round("perimeter", 2).alias("perimeter"), "id")


_CUT = "greatest(least(l.x1, e.x1) - greatest(l.x0, e.x0), 0) * greatest(least(l.y1, e.y1) - greatest(l.y0, e.y0), 0)"


@query("clip", f"""WITH e AS (SELECT min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM {BOXES})
SELECT l.id, 'ok' AS status, round({_CUT}, 3) AS area FROM {LOTS} l, e WHERE {_CUT} > 0""")
def _clip(s, d):
    return _sized(vector.clip(lots(s, d), boxes(s, d)), "id")


@query("intersection", f"SELECT l.id, b.id AS id_2, 'ok' AS status, round({_AREA}, 3) AS area FROM {LOTS} l JOIN {BOXES} b ON {_MEET}")
def _intersection(s, d):
    return _sized(vector.intersection(lots(s, d), boxes(s, d)), "id", "id_2")


#: U-shaped yards of lots (a notch in the middle third of the top, half as deep) and two-part lots (two thirds of it).
_NOTCHED = f"(SELECT *, x0 + w / 3 AS a, x0 + 2 * w / 3 AS b, y0 + h / 2 AS m FROM {LOTS})"
_SHARE = "greatest(least({x1}, b.x1) - greatest({x0}, b.x0), 0) * greatest(least({y1}, b.y1) - greatest({y0}, b.y0), 0)"


def _shares(parts):
    return " + ".join("(" + _SHARE.format(x0=x0, y0=y0, x1=x1, y1=y1) + ")" for x0, y0, x1, y1 in parts)


_U = _shares([("l.x0", "l.y0", "l.x1", "l.m"), ("l.x0", "l.m", "l.a", "l.y1"), ("l.b", "l.m", "l.x1", "l.y1")])
_TWO = _shares([("l.x0", "l.y0", "l.a", "l.y1"), ("l.b", "l.y0", "l.x1", "l.y1")])


def _yards(s, d):
    x0, y0, x1, y1 = F.col("x0"), F.col("y0"), F.col("x0") + F.col("w"), F.col("y0") + F.col("h")
    a, b, m = x0 + F.col("w") / 3, x0 + 2 * F.col("w") / 3, y0 + F.col("h") / 2
    ring = lambda *xy: F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in [*xy, xy[0]]])
    u = geom.geometry("polygon", F.array(F.array(ring((x0, y0), (x1, y0), (x1, y1), (b, y1), (b, m), (a, m), (a, y1), (x0, y1)))))
    two = geom.geometry("multipolygon", F.array(F.array(ring((x0, y0), (a, y0), (a, y1), (x0, y1))), F.array(ring((b, y0), (x1, y0), (x1, y1), (b, y1)))))
    l = lots(s, d)
    return l.select("id", u.alias("geom")).union(l.select((-F.col("id") - 1).alias("id"), two.alias("geom")))


@query("intersection_of_yards", f"""SELECT l.id, b.id AS id_2, round({_U}, 3) AS area FROM {_NOTCHED} l, {BOXES} b WHERE {_U} > 1e-9
UNION ALL SELECT -l.id - 1, b.id, round({_TWO}, 3) FROM {_NOTCHED} l, {BOXES} b WHERE {_TWO} > 1e-9""")
def _yard_overlay(s, d):
    out = vector.intersection(_yards(s, d), boxes(s, d)).withColumn("area", geom.area(F.col("geom")))
    return out.filter("area > 1e-9").select("id", "id_2", F.round("area", 3).alias("area"))


def _relates(name, holds):
    """Yards related to boxes; holds: the share that is enough, of the yard's area."""
    whole = {"u": "w * h * 5 / 6", "two": "w * h * 2 / 3"}
    test = lambda share, of: "EXISTS (SELECT 1 FROM " + BOXES + f" b WHERE {holds.format(share=share, of=whole[of])})"
    sql = f"SELECT id FROM {_NOTCHED} l WHERE {test(_U, 'u')} UNION ALL SELECT -id - 1 FROM {_NOTCHED} l WHERE {test(_TWO, 'two')}"
    query(f"relate_{name}_yards", sql)(lambda s, d: sjoin.relate(_yards(s, d), boxes(s, d), name).select("id"))


_relates("overlaps", "{share} > 1e-9 AND {share} < {of} - 1e-9")
_relates("within", "{share} >= {of} - 1e-9")


_REST = f"SELECT l.id, w * h - coalesce((SELECT sum({_AREA}) FROM {BOXES} b WHERE {_MEET}), 0) AS rest FROM {LOTS} l"


@query("difference", f"SELECT id, round(rest, 3) AS area FROM ({_REST}) WHERE rest > 1e-6")
def _difference(s, d):
    out = vector.difference(lots(s, d), boxes(s, d)).groupBy("id").agg(F.sum(geom.area(F.col("geom"))).alias("area"))
    return rounded(out.filter("area > 1e-6"), 3)


#: A box without the lots that reach into it: the covered area of each, from slabs.
_BARE = f"""WITH rects AS (SELECT b.id AS brand, greatest(round(l.x0, 1), b.x0) AS x0, greatest(round(l.y0, 1), b.y0) AS y0, least(round(l.x1, 1), b.x1) AS x1, max(least(round(l.y1, 1), b.y1)) AS y1
  FROM {LOTS} l JOIN {BOXES} b ON {_MEET} GROUP BY 1, 2, 3, 4)
SELECT (x1 - x0) * (y1 - y0) - coalesce(covered, 0) AS rest FROM {BOXES} b LEFT JOIN {_slabs('x', 'y')} v ON v.brand = b.id"""


@query("union", f"""SELECT 'both' AS side, round(sum({_AREA}), 2) AS area FROM {LOTS} l JOIN {BOXES} b ON {_MEET} UNION ALL SELECT 'left', round(sum(rest), 2) FROM ({_REST})
UNION ALL SELECT 'right', round(sum(rest), 2) FROM ({_BARE}) WHERE rest > 1e-6 GROUP BY 1""")
def _union(s, d):
    out = vector.union(lots(s, d), boxes(s, d))
    side = F.when(F.col("id_2").isNull(), "left").when(F.col("id").isNull(), "right").otherwise("both")
    return rounded(out.groupBy(side.alias("side")).agg(F.sum(geom.area(F.col("geom"))).alias("area")), 2)


@query("split", f"SELECT id, CAST(CASE WHEN n = 0 THEN 1 ELSE n + 1 END AS BIGINT) AS pieces, round(w * h, 3) AS area FROM (SELECT *, (SELECT count(*) FROM nation WHERE l.y0 < n_nationkey * 40 AND n_nationkey * 40 < l.y1) AS n FROM {LOTS} l)")
def _split(s, d):
    y = F.col("n_nationkey") * 40.0
    lines = table(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), geom.line(F.array(geom.vertex(F.lit(-100.0), y), geom.vertex(F.lit(2000.0), y))).alias("geom"))
    out = vector.split(lots(s, d), lines)
    return rounded(out.groupBy("id").agg(F.count("*").alias("pieces"), F.sum(geom.area(F.col("geom"))).alias("area")), 3)


def _broken(s, d):
    """lots, some without a closing vertex, turned into a bow tie, flat, or clockwise with repeats."""
    o = vector.outer(F.col("geom"))
    at = lambda i: F.get(o, F.lit(i))
    k = F.col("id") % 10
    flat = F.transform(o, lambda p: F.struct(p["x"].alias("x"), F.lit(5.0).alias("y")))
    ring = F.when(k == 1, F.slice(o, 1, 4)).when(k == 2, F.array(at(0), at(2), at(1), at(3), at(0))).when(k == 3, flat).when(k == 4, F.reverse(F.concat(F.array(at(0)), o))).when(k == 5, F.slice(o, 1, 2)).otherwise(o)
    return lots(s, d).withColumn("geom", geom.geometry("polygon", F.array(F.array(ring))))


@query("validate", "SELECT p_partkey AS id, CASE p_partkey % 10 WHEN 1 THEN 'unclosed' WHEN 2 THEN 'self_crossing' WHEN 3 THEN 'zero_area' ELSE 'too_few_points' END AS problem FROM part WHERE p_partkey % 10 IN (1, 2, 3, 5)")
def _validate(s, d):
    return vector.validate(_broken(s, d))


@query("repair", f"SELECT id, id % 10 IN (1, 2, 3, 4, 5) AS fixed, CASE WHEN id % 10 IN (2, 3, 5) THEN 0 ELSE round(w * h, 3) END AS area FROM {LOTS}")
def _repair(s, d):
    return vector.repair(_broken(s, d)).select("id", "fixed", F.round(geom.area(F.col("geom")), 3).alias("area"))
