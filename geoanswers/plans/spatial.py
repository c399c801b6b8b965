"""Queries over geometry, and their SQL on rectangles and points."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoanswers.functions import geom
from geoanswers.meta import LayerMeta
from geoanswers.operators import sjoin, vector
from geoanswers.plans.attributes import rounded
from geoanswers.plans.tables import boxes, cells, lots, points, sites

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
METRES = LayerMeta("EPSG:32635", "m")

#: The same tables in SQL.
POINTS = "(SELECT c_custkey AS id, c_mktsegment AS label, c_nationkey, (c_custkey * 7919) % 10000 / 10.0 AS x, (c_custkey * 104729) % 10000 / 10.0 AS y FROM customer)"
SITES = "(SELECT s_suppkey AS id, s_name AS label, (s_suppkey * 3571 + 37) % 10000 / 10.0 AS x, (s_suppkey * 7717 + 11) % 10000 / 10.0 AS y FROM supplier)"
BOXES = "(SELECT n_nationkey::BIGINT AS id, n_name AS label, n_regionkey AS region, (n_nationkey % 5 * 200)::DOUBLE AS x0, (n_nationkey // 5 * 200)::DOUBLE AS y0, (n_nationkey % 5 * 200 + 180)::DOUBLE AS x1, (n_nationkey // 5 * 200 + 180)::DOUBLE AS y1 FROM nation)"
LOTS = "(SELECT p_partkey AS id, p_brand AS label, (p_partkey * 7919) % 10000 / 10.0 AS x0, (p_partkey * 104729) % 10000 / 10.0 AS y0, p_size::DOUBLE AS w, (p_partkey % 13 + 1)::DOUBLE AS h, (p_partkey * 7919) % 10000 / 10.0 + p_size AS x1, (p_partkey * 104729) % 10000 / 10.0 + p_partkey % 13 + 1 AS y1 FROM part)"
_MEET = "l.x0 <= b.x1 AND b.x0 <= l.x1 AND l.y0 <= b.y1 AND b.y0 <= l.y1"
_INNER = "l.x0 < b.x1 AND b.x0 < l.x1 AND l.y0 < b.y1 AND b.y0 < l.y1"
_IN = "l.x0 >= b.x0 AND l.x1 <= b.x1 AND l.y0 >= b.y0 AND l.y1 <= b.y1"
_HOLDS = "b.x0 >= l.x0 AND b.x1 <= l.x1 AND b.y0 >= l.y0 AND b.y1 <= l.y1"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _relate(name: str, predicate: str, test: str) -> None:
    QUERIES[f"relate_{name}"] = lambda s, d: sjoin.relate(lots(s, d), boxes(s, d), predicate).select("id", "label")
    ORACLES[f"relate_{name}"] = f"SELECT id, label FROM {LOTS} l WHERE {'NOT ' if name == 'disjoint' else ''}EXISTS (SELECT 1 FROM {BOXES} b WHERE {test})"


_relate("intersects", "intersects", _MEET)
_relate("within", "within", _IN)
_relate("overlaps", "overlaps", f"{_INNER} AND NOT ({_IN}) AND NOT ({_HOLDS})")
_relate("touches", "touches", f"{_MEET} AND NOT ({_INNER})")
_relate("disjoint", "disjoint", _MEET)


@query("relate_contains", f"SELECT id, label FROM {BOXES} b WHERE EXISTS (SELECT 1 FROM {LOTS} l WHERE {_IN})")
def _contains(s, d):
    return sjoin.relate(boxes(s, d), lots(s, d), "contains").select("id", "label")


_LINES = f"(SELECT id, x, y FROM {POINTS})"


@query("relate_crosses", f"SELECT id FROM {_LINES} l WHERE EXISTS (SELECT 1 FROM {BOXES} b WHERE l.y > b.y0 AND l.y < b.y1 AND l.x < b.x1 AND l.x + 100 > b.x0 AND NOT (l.x >= b.x0 AND l.x + 100 <= b.x1))")
def _crosses(s, d):
    p = points(s, d)
    lines = p.select("id", geom.line(F.array(geom.vertex(F.col("x"), F.col("y")), geom.vertex(F.col("x") + 100, F.col("y")))).alias("geom"))
    return sjoin.relate(lines, boxes(s, d), "crosses").select("id")


@query("relate_selected", f"SELECT (SELECT count(*) FROM part) AS tested, count(*) AS matched, (SELECT count(*) FROM nation WHERE n_regionkey = 2) AS reference_features, 'EPSG:32635' AS compared_in FROM {LOTS} l WHERE EXISTS (SELECT 1 FROM {BOXES} b WHERE b.region = 2 AND {_MEET})")
def _selected(s, d):
    return sjoin.relate_report(lots(s, d), boxes(s, d).filter("region = 2"), "intersects", METRES)


_GAP = "sqrt(power(greatest(b.x0 - p.x, p.x - b.x1, 0), 2) + power(greatest(b.y0 - p.y, p.y - b.y1, 0), 2))"


@query("near", f"SELECT id FROM {POINTS} p WHERE EXISTS (SELECT 1 FROM {BOXES} b WHERE {_GAP} <= 10)")
def _near(s, d):
    return sjoin.near(points(s, d), boxes(s, d), 0.01, "km", METRES).select("id")


@query("align_crs", f"SELECT p.id FROM {POINTS} p WHERE EXISTS (SELECT 1 FROM {SITES} t WHERE sqrt(power(p.x - t.x, 2) + power(p.y - t.y, 2)) <= 5)")
def _align(s, d):
    zone = LayerMeta("EPSG:32635", "m")
    ground = lambda df: df.withColumn("geom", geom.point(F.col("x") + 500000, F.col("y") + 4540000))
    degrees = ground(sites(s, d)).withColumn("geom", geom.reprojected(F.col("geom"), "EPSG:32635", "EPSG:4326"))
    return sjoin.near(ground(points(s, d)), sjoin.aligned(zone, degrees, LayerMeta("EPSG:4326", "degrees", True)), 5, "m", zone).select("id")


_NEAREST = """SELECT *, min(distance) OVER () AS nearest, max(distance) OVER () AS farthest FROM (SELECT id, round(sqrt(power(x - {x}, 2) + power(y - {y}, 2)), 6) AS distance,
  (SELECT count(*) FROM {t}) AS considered FROM {t} ORDER BY sqrt(power(x - {x}, 2) + power(y - {y}, 2)), id LIMIT {k})"""


#: Sites in degrees; every 7th lies beyond the pole, every 11th has no geometry.
@query("align_report", f"""SELECT (SELECT count(*) FROM {POINTS}) AS tested, (SELECT count(*) FROM {POINTS} p WHERE EXISTS (SELECT 1 FROM {SITES} t WHERE t.id % 7 <> 0 AND t.id % 11 <> 0 AND abs(p.x - t.x) <= 5 AND abs(p.y - t.y) <= 5)) AS matched,
  count_if(id % 7 <> 0 AND id % 11 <> 0)::BIGINT AS reference_features, count_if(id % 11 = 0)::BIGINT AS reference_empty, count_if(id % 7 = 0 AND id % 11 <> 0)::BIGINT AS reference_dropped, 'EPSG:32635' AS compared_in FROM {SITES}""")
def _align_report(s, d):
    zone = LayerMeta("EPSG:32635", "m")
    x, y = F.col("x") + 500000, F.col("y") + 4540000
    around = geom.reprojected(geom.box(x - 5, y - 5, x + 5, y + 5), "EPSG:32635", "EPSG:4326")
    beyond = geom.box(x * 0 + 20, y * 0 + 91, x * 0 + 21, y * 0 + 92)
    other = sjoin.spread(sites(s, d)).withColumn("geom", F.when(F.col("id") % 11 == 0, None).when(F.col("id") % 7 == 0, beyond).otherwise(around))
    return sjoin.relate_layers(points(s, d).withColumn("geom", geom.point(x, y)), zone, other, LayerMeta("EPSG:4326", "degrees", True), "intersects")


@query("nearest_k", _NEAREST.format(x=500, y=500, t=POINTS, k=10))
def _nearest_k(s, d):
    return rounded(sjoin.nearest_k(points(s, d), 500, 500), 6)


@query("table_nearest", _NEAREST.format(x=100, y=900, t=SITES, k=5))
def _table_nearest(s, d):
    return rounded(sjoin.nearest_k(sites(s, d), 100, 900, 5), 6)


@query("nearest_neighbor", f"SELECT id, arg_min(t, (dd, t)) AS neighbor_id, round(min(dd), 6) AS distance FROM (SELECT p.id, t.id AS t, sqrt(power(p.x - t.x, 2) + power(p.y - t.y, 2)) AS dd FROM {POINTS} p, {SITES} t) GROUP BY id")
def _nearest_neighbor(s, d):
    return rounded(sjoin.nearest_neighbor(points(s, d), sites(s, d)), 6)


_INSIDE = "p.x >= b.x0 AND p.x < b.x1 AND p.y >= b.y0 AND p.y < b.y1"


@query("count_in_polygons", f"SELECT b.label, count(p.id) AS count FROM {BOXES} b LEFT JOIN {POINTS} p ON {_INSIDE} GROUP BY 1")
def _count(s, d):
    return sjoin.count_in_polygons(boxes(s, d), points(s, d))


@query("unmatched_points", f"SELECT id FROM {POINTS} p WHERE NOT EXISTS (SELECT 1 FROM {BOXES} b WHERE {_INSIDE})")
def _unmatched(s, d):
    return sjoin.unmatched_points(boxes(s, d), points(s, d)).select("id")


@query("density", f"SELECT CAST(b.region AS VARCHAR) AS label, count(p.id) AS count, round(count(DISTINCT b.id) * 0.0324, 6) AS area_km2, round(count(p.id) / (count(DISTINCT b.id) * 0.0324), 4) AS per_km2 FROM {BOXES} b LEFT JOIN {POINTS} p ON {_INSIDE} GROUP BY 1")
def _density(s, d):
    b = boxes(s, d).withColumn("group", F.col("region").cast("string"))
    out = sjoin.density(b, points(s, d), METRES, "group")
    return out.select("label", "count", F.round("area_km2", 6).alias("area_km2"), F.round("per_km2", 4).alias("per_km2"))


@query("spatial_join", f"SELECT p.id, b.label AS label_2, b.region AS region_2 FROM {POINTS} p LEFT JOIN {BOXES} b ON p.x >= b.x0 AND p.x <= b.x1 AND p.y >= b.y0 AND p.y <= b.y1")
def _spatial_join(s, d):
    return sjoin.spatial_join(points(s, d).select("id", "geom"), boxes(s, d).select("label", "region", "geom"), "intersects", "left").select("id", "label_2", "region_2")


@query("select_by_location", f"SELECT id, label FROM {BOXES} b WHERE EXISTS (SELECT 1 FROM {SITES} p WHERE p.x >= b.x0 AND p.x <= b.x1 AND p.y >= b.y0 AND p.y <= b.y1)")
def _select_by_location(s, d):
    return sjoin.relate(boxes(s, d), sites(s, d), "intersects").select("id", "label")


@query("zonal_statistics", f"""SELECT b.label, count(*) AS count, round(sum(z), 2) AS sum, round(avg(z), 4) AS mean, min(z) AS min, max(z) AS max, round(stddev_pop(z), 4) AS std
FROM (SELECT (o_orderkey % 100) * 10 + 5.0 AS x, (o_orderkey // 100) * 10 + 5.0 AS y, o_totalprice AS z FROM orders) p JOIN {BOXES} b ON {_INSIDE} GROUP BY 1""")  # fmt: skip
def _zonal(s, d):
    centres = cells(s, d).select("z", geom.point(F.col("col") * 10 + 5.0, F.col("row") * 10 + 5.0).alias("geom"))
    out = sjoin.zonal_statistics(boxes(s, d), centres)
    return out.select("label", "count", F.round("sum", 2).alias("sum"), F.round("mean", 4).alias("mean"), "min", "max", F.round("std", 4).alias("std"))


@query("table_relationship_count", f"SELECT count(*) AS pairs, count(DISTINCT l.id) AS features FROM {LOTS} l, {BOXES} b WHERE {_MEET}")
def _relationship(s, d):
    return sjoin.relationship_count(lots(s, d), boxes(s, d), "intersects")


@query("table_join_counts", f"SELECT b.label, count(p.id) AS count FROM {BOXES} b LEFT JOIN {SITES} p ON {_INSIDE} GROUP BY 1 ORDER BY count DESC, b.label LIMIT 10")
def _join_counts(s, d):
    return sjoin.count_in_polygons(boxes(s, d), sites(s, d)).orderBy(F.desc("count"), "label").limit(10)


@query("table_bbox_count", f"SELECT count(*) AS count FROM {LOTS} WHERE x0 <= 600 AND x1 >= 250 AND y0 <= 800 AND y1 >= 400.5")
def _bbox_count(s, d):
    return sjoin.bbox_count(lots(s, d), (250, 400.5, 600, 800))


@query("scope_viewport", f"SELECT id FROM {LOTS} WHERE x0 <= 300 AND x1 >= 100 AND y0 <= 300 AND y1 >= 100")
def _viewport(s, d):
    from geoanswers.operators.scope import scope_viewport

    flat = lots(s, d).select("id", "x0", "y0", (F.col("x0") + F.col("w")).alias("x1"), (F.col("y0") + F.col("h")).alias("y1"))
    return scope_viewport(flat, (100, 100, 300, 300), "x0", "y0", "x1", "y1").select("id")


@query("read_geometry", f"SELECT id, label, x0 AS xmin, y0 AS ymin, round(x1, 6) AS xmax, round(y1, 6) AS ymax FROM {LOTS}")
def _read_geometry(s, d):
    b = geom.bbox(F.col("geom"))
    return lots(s, d).select("id", "label", b["xmin"].alias("xmin"), b["ymin"].alias("ymin"), F.round(b["xmax"], 6).alias("xmax"), F.round(b["ymax"], 6).alias("ymax"))


@query("extent", f"SELECT min(x0) AS xmin, min(y0) AS ymin, round(max(x1), 6) AS xmax, round(max(y1), 6) AS ymax FROM {LOTS}")
def _extent(s, d):
    b = geom.bbox(F.col("geom"))
    return rounded(lots(s, d).agg(F.min(b["xmin"]).alias("xmin"), F.min(b["ymin"]).alias("ymin"), F.max(b["xmax"]).alias("xmax"), F.max(b["ymax"]).alias("ymax")), 6)


_OF = "count(*) AS features, {n} AS measured, count(*) - {n} AS skipped, round(sum({v}), 2) AS sum, round(avg({v}), 4) AS mean, round(min({v}), 4) AS min, round(max({v}), 4) AS max"


@query("geometry_measure", f"""SELECT 'area' AS metric, {_OF.format(n="count(w)", v="w * h")}, 'm2' AS unit, 'map_units' AS frame FROM (SELECT w, h FROM {LOTS} UNION ALL SELECT NULL, NULL FROM {POINTS})
UNION ALL SELECT 'perimeter', {_OF.format(n="count(w)", v="2 * (w + h)")}, 'm', 'map_units' FROM {LOTS}""")
def _measure(s, d):
    mixed = lots(s, d).select("geom").union(points(s, d).select("geom"))
    one = vector.measured(mixed, METRES, "area").withColumn("metric", F.lit("area"))
    two = vector.measured(lots(s, d), METRES, "perimeter").withColumn("metric", F.lit("perimeter"))
    return one.union(two).withColumn("sum", F.round("sum", 2)).select("metric", "features", "measured", "skipped", "sum", *[F.round(c, 4).alias(c) for c in ("mean", "min", "max")], "unit", "frame")


#: Lots in degrees, spread over far more than one zone: an area is measured on the ellipsoid.
_E = "0.0818191908426215"
_Q = f"(1 - {_E} * {_E}) * (sin(radians({{y}})) / (1 - {_E} * {_E} * sin(radians({{y}})) * sin(radians({{y}}))) + ln((1 + {_E} * sin(radians({{y}}))) / (1 - {_E} * sin(radians({{y}})))) / (2 * {_E}))"


@query("geometry_measure_wide", f"""SELECT count(*) AS features, round(sum(a) / 1e6, 2) AS km2, 'ellipsoidal' AS frame FROM (SELECT 6378137.0 * radians(w / 10) * 6378137.0 / 2
  * ({_Q.format(y="(y0 + h) / 20")} - ({_Q.format(y="y0 / 20")})) AS a FROM {LOTS})""")
def _measure_wide(s, d):
    x, y = F.col("x0") / 10, F.col("y0") / 20
    wide = lots(s, d).select(geom.box(x, y, x + F.col("w") / 10, y + F.col("h") / 20).alias("geom"))
    return vector.measured(wide, LayerMeta("EPSG:4326", "degrees", True)).select("features", F.round(F.col("sum") / 1e6, 2).alias("km2"), "frame")


@query("geometry_rank", f"SELECT id, label, round(w * h, 4) AS area FROM {LOTS} ORDER BY w * h DESC, id LIMIT 5")
def _geometry_rank(s, d):
    return rounded(vector.geometry_rank(lots(s, d).withColumn("geom", geom.box(F.lit(0.0), F.lit(0.0), F.col("w"), F.col("h"))), METRES), 4)


@query("kind_filter", "SELECT c_custkey AS id FROM customer")
def _kind_filter(s, d):
    return vector.of_dimension(points(s, d).select("id", "geom").union(lots(s, d).select("id", "geom")), 0).select("id")


@query("geo_range_filter", f"SELECT id FROM {POINTS} WHERE x - 300 BETWEEN -180 AND 180 AND y - 400 BETWEEN -90 AND 90")
def _geo_range(s, d):
    from geoanswers.sources.features import on_earth

    return points(s, d).withColumn("geom", geom.point(F.col("x") - 300, F.col("y") - 400)).filter(on_earth(F.col("geom"))).select("id")


@query("table_geometry_kinds", "SELECT 'point' AS kind, count(*) AS features FROM customer UNION ALL SELECT 'polygon', count(*) FROM part")
def _kinds(s, d):
    return points(s, d).select("geom").union(lots(s, d).select("geom")).groupBy(F.col("geom.kind").alias("kind")).agg(F.count("*").alias("features"))
