"""Geometry as column expressions on ``struct<kind, parts: array<array<array<struct<x,y>>>>>`` (parts, rings, vertices)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoanswers.meta import Refused, need_crs

#: WGS84, mean earth radius, UTM scale.
A, INV_F, MEAN_R, K0 = 6378137.0, 298.257223563, 6371008.8, 0.9996
TYPE = "struct<kind:string,parts:array<array<array<struct<x:double,y:double>>>>>"
_VERTEX = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
GEOMETRY = T.StructType([T.StructField("kind", T.StringType()), T.StructField("parts", T.ArrayType(T.ArrayType(T.ArrayType(_VERTEX))))])


def vertex(x, y) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def geometry(kind: str, parts: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), parts.alias("parts"))


def point(x: Column, y: Column) -> Column:
    return geometry("point", F.array(F.array(F.array(vertex(x, y)))))


def line(vertices: Column) -> Column:
    return geometry("linestring", F.array(F.array(vertices)))


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return geometry("polygon", F.array(F.array(F.array(vertex(x0, y0), vertex(x1, y0), vertex(x1, y1), vertex(x0, y1), vertex(x0, y0)))))


def vertices(g: Column) -> Column:
    return F.flatten(F.flatten(g["parts"]))


def _ends(ring: Column) -> Column:
    """The sides of a ring as struct(p, q)."""
    return F.transform(F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(0))), lambda p, i: F.struct(p.alias("p"), F.element_at(ring, i + 2).alias("q")))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def ring_area(ring: Column) -> Column:
    """Signed area (counter-clockwise positive), relative to the first vertex."""
    o = F.get(ring, F.lit(0))
    cross = F.transform(_ends(ring), lambda s: (s["p"]["x"] - o["x"]) * (s["q"]["y"] - o["y"]) - (s["q"]["x"] - o["x"]) * (s["p"]["y"] - o["y"]))
    return _total(cross) / 2


def ring_length(ring: Column) -> Column:
    return _total(F.transform(_ends(ring), lambda s: F.hypot(s["q"]["x"] - s["p"]["x"], s["q"]["y"] - s["p"]["y"])))


def area(g: Column) -> Column:
    """Area of a polygon, holes taken off; NULL for other kinds."""
    part = lambda rings: _total(F.transform(rings, lambda r, i: F.when(i == 0, F.abs(ring_area(r))).otherwise(-F.abs(ring_area(r)))))
    return F.when(g["kind"].isin("polygon", "multipolygon"), _total(F.transform(g["parts"], part)))


def length(g: Column) -> Column:
    """Length of a line or perimeter of a polygon; NULL for points."""
    return F.when(~g["kind"].isin("point", "multipoint"), _total(F.transform(F.flatten(g["parts"]), ring_length)))


def dimension(g: Column) -> Column:
    return F.when(g["kind"].isin("point", "multipoint"), 0).when(g["kind"].isin("linestring", "multilinestring"), 1).when(g["kind"].isin("polygon", "multipolygon"), 2)


def bbox(g: Column) -> Column:
    v = vertices(g)
    x, y = F.transform(v, lambda p: p["x"]), F.transform(v, lambda p: p["y"])
    return F.struct(F.array_min(x).alias("xmin"), F.array_min(y).alias("ymin"), F.array_max(x).alias("xmax"), F.array_max(y).alias("ymax"))


def centroid(g: Column) -> Column:
    """Centroid point: area-weighted for polygons, mean vertex for the others."""
    o = F.get(vertices(g), F.lit(0))

    def moment(axis: str) -> Column:
        def ring(r: Column, i: Column) -> Column:
            m = _total(F.transform(_ends(r), lambda s: ((s["p"][axis] - o[axis]) + (s["q"][axis] - o[axis])) * ((s["p"]["x"] - o["x"]) * (s["q"]["y"] - o["y"]) - (s["q"]["x"] - o["x"]) * (s["p"]["y"] - o["y"])))) / 6
            sign = F.when(ring_area(r) < 0, -1.0).otherwise(1.0) * F.when(i == 0, 1.0).otherwise(-1.0)
            return sign * m

        return _total(F.transform(g["parts"], lambda rings: _total(F.transform(rings, ring))))

    v = vertices(g)
    mean = lambda axis: _total(F.transform(v, lambda p: p[axis])) / F.size(v)
    big = area(g) > 0
    return F.struct(F.when(big, o["x"] + moment("x") / area(g)).otherwise(mean("x")).alias("x"), F.when(big, o["y"] + moment("y") / area(g)).otherwise(mean("y")).alias("y"))


def segments(g: Column) -> Column:
    """The sides of every ring; a point is one side of no length."""
    sides = F.flatten(F.transform(F.flatten(g["parts"]), _ends))
    return F.when(F.size(sides) > 0, sides).otherwise(F.transform(vertices(g), lambda p: F.struct(p.alias("p"), p.alias("q"))))


# ---- projections -------------------------------------------------------------------------------------------------


def mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    return F.radians(lon) * A, F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)) * A


def from_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    return F.degrees(x / A), F.degrees(2 * F.atan(F.exp(y / A)) - math.pi / 2)


def _krueger() -> tuple[float, float, list[float], list[float]]:
    """e, the rectifying radius, and the forward and inverse series (Krueger 1912, order 4 in the third flattening)."""
    f = 1 / INV_F
    n = f / (2 - f)
    radius = A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    forward = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280]
    inverse = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280]
    return math.sqrt(f * (2 - f)), radius, forward, inverse


def utm(lon: Column, lat: Column, zone: int | Column, south: bool | Column) -> tuple[Column, Column]:
    """Easting and northing by the Krueger series."""
    e, radius, forward, _ = _krueger()
    zone = F.lit(zone) if isinstance(zone, int) else zone
    south = F.lit(south) if isinstance(south, bool) else south
    phi, lam = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    s = F.sin(phi)
    t = F.sinh(F.atanh(s) - e * F.atanh(e * s))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, a in enumerate(forward, 1):
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return 500000 + K0 * radius * east, F.when(south, 10000000.0).otherwise(0.0) + K0 * radius * north


def from_utm(x: Column, y: Column, zone: int, south: bool) -> tuple[Column, Column]:
    e, radius, _, inverse = _krueger()
    xi, eta = (y - (10000000.0 if south else 0.0)) / (K0 * radius), (x - 500000) / (K0 * radius)
    a, b = xi, eta
    for j, c in enumerate(inverse, 1):
        a = a - c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        b = b - c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(a) / F.cosh(b))
    # conformal to geodetic latitude by fixed-point steps, each of which leaves less than a hundredth of the error
    psi, phi = F.atanh(F.sin(chi)), chi
    for _ in range(6):
        phi = F.asin(F.tanh(psi + e * F.atanh(e * F.sin(phi))))
    return F.degrees(F.atan2(F.sinh(b), F.cos(a))) + (zone * 6 - 183), F.degrees(phi)


def _utm_code(code: str) -> tuple[int, bool] | None:
    number = code.split(":")[1]
    if len(number) == 5 and number[:3] in ("326", "327") and 1 <= int(number[3:]) <= 60:
        return int(number[3:]), number[2] == "7"
    return None


def projected(x: Column, y: Column, source: str, target: str) -> tuple[Column, Column]:
    """Coordinates in another CRS: EPSG 4326, 3857 and the UTM zones 326zz and 327zz; others are refused."""
    source, target = need_crs(source), need_crs(target)
    if source == target:
        return x, y
    for code in (source, target):
        if code not in ("EPSG:4326", "EPSG:3857") and not _utm_code(code):
            raise Refused(f"no closed form for {code}")
    if source == "EPSG:3857":
        x, y = from_mercator(x, y)
    elif source != "EPSG:4326":
        x, y = from_utm(x, y, *_utm_code(source))
    if target == "EPSG:3857":
        return mercator(x, y)
    return (x, y) if target == "EPSG:4326" else utm(x, y, *_utm_code(target))


def reprojected(g: Column, source: str, target: str) -> Column:
    def move(p: Column) -> Column:
        x, y = projected(p["x"], p["y"], source, target)
        return F.struct(x.alias("x"), y.alias("y"))

    return F.struct(g["kind"].alias("kind"), F.transform(g["parts"], lambda rings: F.transform(rings, lambda r: F.transform(r, move))).alias("parts"))


def equal_area(g: Column) -> Column:
    """Degrees on the WGS84 ellipsoid in the cylindrical frame in which every area is right, in metres."""
    e = math.sqrt(1 / INV_F * (2 - 1 / INV_F))

    def move(p: Column) -> Column:
        s = F.sin(F.radians(p["y"]))
        q = (1 - e * e) * (s / (1 - e * e * s * s) + F.atanh(e * s) / e)
        return F.struct((F.radians(p["x"]) * A).alias("x"), (q * (A / 2)).alias("y"))

    return F.struct(g["kind"].alias("kind"), F.transform(g["parts"], lambda rings: F.transform(rings, lambda r: F.transform(r, move))).alias("parts"))


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * MEAN_R * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def spherical_azimuth(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    dl = F.radians(lon2 - lon1)
    y = F.sin(dl) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(dl)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360, F.lit(360.0))
