"""Survey computations over tables of pairs, legs, stations and coordinates, as column expressions and windows."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoanswers.functions import geom
from geoanswers.functions.geodesy import direct, geodesic
from geoanswers.meta import Refused, need_columns
from geoanswers.operators import shapes
from geoanswers.operators.sjoin import nearest_neighbor
from geoanswers.sources.tables import stored

#: Digits of a distance in metres behind which legs are equally near.
NEAR_DIGITS = 9


def pair_distances(df: DataFrame, geographic: bool = True) -> DataFrame:
    """Distance, azimuth and back azimuth of each pair: on the ellipsoid, on the sphere where the ellipsoid's series does not
    converge; positions out of range have method ``refused`` and NULLs."""
    need_columns(df, "from_lon", "from_lat", "to_lon", "to_lat")
    a, b, c, d = (F.col(n) for n in ("from_lon", "from_lat", "to_lon", "to_lat"))
    if not geographic:
        azimuth = F.pmod(F.degrees(F.atan2(c - a, d - b)) + 360, F.lit(360.0))
        return df.withColumn("distance_m", F.hypot(c - a, d - b)).withColumn("azimuth_deg", azimuth).withColumn("method", F.lit("planar"))
    good = a.between(-180, 180) & c.between(-180, 180) & b.between(-90, 90) & d.between(-90, 90)
    ok = F.coalesce(good, F.lit(False)) & ~F.isnan(a) & ~F.isnan(b) & ~F.isnan(c) & ~F.isnan(d)
    known = lambda x: F.when(ok, x)
    out = df.withColumn("_g", geodesic(known(a), known(b), known(c), known(d)))
    names = ("distance_m", "azimuth_deg", "back_azimuth_deg")
    method = F.when(~ok, "refused").when(F.col("_g.converged"), "ellipsoidal").otherwise("spherical")
    return out.select(*df.columns, *[F.when(ok, F.col(f"_g.{n}")).alias(n) for n in names], method.alias("method"))


def set_out(df: DataFrame, geographic: bool = False) -> DataFrame:
    """Position from a start (x, y or lon, lat), an azimuth and a distance."""
    az = F.radians("azimuth_deg")
    if not geographic:
        return df.withColumn("to_x", F.col("x") + F.col("distance_m") * F.sin(az)).withColumn("to_y", F.col("y") + F.col("distance_m") * F.cos(az))
    d, lat = F.col("distance_m") / geom.MEAN_R, F.radians("lat")
    to_lat = F.asin(F.sin(lat) * F.cos(d) + F.cos(lat) * F.sin(d) * F.cos(az))
    to_lon = F.radians("lon") + F.atan2(F.sin(az) * F.sin(d) * F.cos(lat), F.cos(d) - F.sin(lat) * F.sin(to_lat))
    return df.withColumn("to_lat", F.degrees(to_lat)).withColumn("to_lon", F.pmod(F.degrees(to_lon) + 540, F.lit(360.0)) - 180)


def traverse(legs: DataFrame, order: list[str], key: str = "traverse_id") -> DataFrame:
    """key, seq, x, y, distance_m: the station after each leg, from (0, 0) (grid azimuths)."""
    w = Window.partitionBy(key).orderBy(*order)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    az = F.radians("azimuth_deg")
    return legs.select(key, F.row_number().over(w).alias("seq"), F.sum(F.col("distance_m") * F.sin(az)).over(run).alias("x"), F.sum(F.col("distance_m") * F.cos(az)).over(run).alias("y"), "distance_m")


def traverse_geodesic(legs: DataFrame, starts: DataFrame, order: list[str], key: str = "traverse_id", azimuths: str = "geodesic") -> DataFrame:
    """key, seq, lon, lat, azimuth_there_deg, distance_m, status: the station after each leg on the ellipsoid, from the traverse's
    start (starts: key, lon, lat). status: ok, no_start (none, or off the earth) or broken (behind a leg without a usable
    azimuth or distance). Grid azimuths don't go with positions in degrees and are refused.

    A traverse's legs stand in order in a sorted partition, and where it has come to is carried over batches; legs of the same
    rank of all traverses in a batch are solved at once."""
    if azimuths != "geodesic":
        raise Refused("grid azimuths on positions in degrees")
    need_columns(starts, key, "lon", "lat")
    need_columns(legs, key, "azimuth_deg", "distance_m", *order)
    from_ = starts.select(F.col(key).alias("_key"), F.col("lon").cast("double").alias("_lon"), F.col("lat").cast("double").alias("_lat"))
    plain = legs.select(key, F.col("azimuth_deg").cast("double").alias("azimuth_deg"), F.col("distance_m").cast("double").alias("distance_m"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)])
    line = plain.join(from_, F.col(key).eqNullSafe(F.col("_key")), "left").repartition(key).sortWithinPartitions(key, *[f"_o{i}" for i in range(len(order))])
    fields = [("seq", T.LongType()), ("lon", T.DoubleType()), ("lat", T.DoubleType()), ("azimuth_there_deg", T.DoubleType()), ("distance_m", T.DoubleType()), ("status", T.StringType())]
    schema = T.StructType([line.schema[key], *[T.StructField(n, t) for n, t in fields]])
    return line.select(key, "azimuth_deg", "distance_m", "_lon", "_lat").mapInArrow(_chained, schema)


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = None  # key, seq, lon, lat of the traverse that may go on
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        keys = batch.column(0)
        code = keys.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        size = np.diff(np.append(first, n))
        azimuth, far, lon, lat = (batch.column(k).to_numpy(zero_copy_only=False).astype(float) for k in range(1, 5))
        x, y = lon[first], lat[first]
        sound = (np.abs(x) <= 360) & (np.abs(y) <= 90)
        x, y = np.where(sound, x, np.nan), np.where(sound, y, np.nan)
        before = np.zeros(len(first), np.int64)
        if held is not None and held[0] == keys[0].as_py():
            before[0], x[0], y[0] = held[1:]
        out = np.full((n, 3), np.nan)
        for k in range(int(size.max())):
            on = np.flatnonzero(size > k)
            at = first[on] + k
            good = np.isfinite(azimuth[at]) & np.isfinite(far[at]) & (far[at] >= 0)
            with np.errstate(invalid="ignore"):
                found = direct(x[on], y[on], np.where(good, azimuth[at], np.nan), np.where(good, far[at], np.nan))
            out[at] = np.stack(found, axis=1)
            x[on], y[on] = found[0], found[1]
        seq = np.arange(n) - np.repeat(first, size) + 1 + np.repeat(before, size)
        held = (keys[n - 1].as_py(), int(seq[-1]), x[-1], y[-1])
        lost = np.isnan(out[:, 0])
        begun = np.repeat(sound, size)
        status = np.where(~begun, "no_start", np.where(lost, "broken", "ok"))
        columns = [keys, pa.array(seq), *[pa.array(out[:, k], mask=lost) for k in range(3)], batch.column(2), pa.array(status.tolist())]
        yield pa.RecordBatch.from_arrays(columns, names=[batch.schema.names[0], "seq", "lon", "lat", "azimuth_there_deg", "distance_m", "status"])


def closure_geodesic(legs: DataFrame, starts: DataFrame, order: list[str], key: str = "traverse_id") -> DataFrame:
    """key, legs, perimeter, misclosure (metres on the ellipsoid from the last station to the start), precision; NULL for
    traverses without a start or with a leg that can't be used."""
    s = traverse_geodesic(legs, starts, order, key)
    last = s.groupBy(key).agg(F.count("*").alias("legs"), F.sum("distance_m").alias("perimeter"), F.max_by(F.struct("lon", "lat"), "seq").alias("_end"), F.bool_and(F.col("status") == "ok").alias("_ok"))
    both = last.join(starts.select(F.col(key).alias("_key"), F.col("lon").alias("_lon"), F.col("lat").alias("_lat")), F.col(key).eqNullSafe(F.col("_key")), "left")
    known = lambda c: F.when(F.col("_ok"), c)
    g = geodesic(known(F.col("_end.lon")), known(F.col("_end.lat")), known(F.col("_lon")), known(F.col("_lat")))
    out = both.withColumn("misclosure", g["distance_m"])
    return out.select(key, "legs", "perimeter", "misclosure", F.try_divide("perimeter", F.when(F.col("misclosure") > 1e-3, F.col("misclosure"))).alias("precision"))


def closure(legs: DataFrame, order: list[str], key: str = "traverse_id") -> DataFrame:
    """key, legs, perimeter, misclosure, precision (perimeter over misclosure), area of the figure closed back."""
    s = traverse(legs, order, key)
    w = Window.partitionBy(key).orderBy("seq")
    px, py = F.lag("x", 1, 0.0).over(w), F.lag("y", 1, 0.0).over(w)
    parts = s.withColumn("cross", px * F.col("y") - F.col("x") * py)
    out = parts.groupBy(key).agg(F.count("*").alias("legs"), F.sum("distance_m").alias("perimeter"), F.max_by(F.hypot("x", "y"), "seq").alias("misclosure"), F.abs(F.sum("cross") / 2).alias("area"))
    return out.withColumn("precision", F.try_divide("perimeter", F.when(F.col("misclosure") > 1e-9, F.col("misclosure"))))


def station_offset(points: DataFrame, lines: DataFrame, key: str) -> DataFrame:
    """station, offset (right positive), side and position of each point against the baseline of its key."""
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    size = F.hypot(dx, dy)
    px, py = F.col("x") - F.col("x1"), F.col("y") - F.col("y1")
    out = points.join(lines, key).withColumn("station", F.try_divide(px * dx + py * dy, size)).withColumn("offset", F.try_divide(px * dy - py * dx, size))
    side = F.when(F.col("offset") > 0, "right").when(F.col("offset") < 0, "left").otherwise("on")
    where = F.when(F.col("station") < 0, "before").when(F.col("station") > size, "after").otherwise("along")
    return out.withColumn("side", side).withColumn("position", where)


def _legs_of(lines: DataFrame) -> DataFrame:
    """line, leg, legs, base (length of the legs before it), x1, y1, x2, y2 of every line's legs that have a length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for i, s in enumerate(shapes.read(batch.column("geom"))):
                if s is None or s.dim != 1 or not len(s.sides):
                    continue
                far = np.hypot(s.sides[:, 2] - s.sides[:, 0], s.sides[:, 3] - s.sides[:, 1])
                n = len(far)
                at.append(np.full(n, i))
                rows.append(np.column_stack([np.arange(n), np.full(n, n), np.cumsum(far) - far, s.sides]))
            at, rows = (np.concatenate(at), np.concatenate(rows)) if at else (np.zeros(0, np.int64), np.zeros((0, 7)))
            columns = [batch.column("id").take(pa.array(at)), *[pa.array(rows[:, k].astype(np.int64)) for k in (0, 1)], *[pa.array(rows[:, k]) for k in range(2, 7)]]
            yield pa.RecordBatch.from_arrays(columns, names=["line", "leg", "legs", "base", "x1", "y1", "x2", "y2"])

    fields = [T.StructField(n, T.LongType()) for n in ("leg", "legs")] + [T.StructField(n, T.DoubleType()) for n in ("base", "x1", "y1", "x2", "y2")]
    return lines.select("id", "geom").mapInArrow(run, T.StructType([T.StructField("line", lines.schema["id"].dataType), *fields]))


def station_offset_nearest(points: DataFrame, lines: DataFrame) -> DataFrame:
    """id, line, station, offset (right positive), side and position of each point (id, x, y) against the nearest of all
    baselines (id, geom: lines of any number of legs; equally near ones, to a nanometre: the least id, then the first leg). Stations run on over
    the legs; a point before the first or behind the last leg is measured along that leg's line, one at an inner corner stands at
    the corner's station, its offset the distance to it. Points stay where no baseline is: their columns are NULL."""
    need_columns(points, "id", "x", "y")
    need_columns(lines, "id", "geom")
    legs = stored(_legs_of(lines).withColumn("id", F.struct("line", "leg")), "legs")
    spots = stored(points.select("id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")), "spots")
    side_of = geom.geometry("linestring", F.array(F.array(F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y"))))))
    # points and legs in the same place once: they have the same answer, and the least of equal legs
    places = spots.select("x", "y").filter("x is not null and y is not null and not isnan(x) and not isnan(y)").distinct()
    alone = legs.groupBy("x1", "y1", "x2", "y2").agg(F.min("id").alias("id"))
    near = nearest_neighbor(places.select(F.struct("x", "y").alias("id"), geom.point(F.col("x"), F.col("y")).alias("geom")), alone.select("id", side_of.alias("geom")), digits=NEAR_DIGITS)
    near = near.select(F.col("id.x").alias("_x"), F.col("id.y").alias("_y"), F.col("neighbor_id").alias("_leg"), "distance")
    both = spots.join(near, (F.col("x") == F.col("_x")) & (F.col("y") == F.col("_y")), "left").join(legs.withColumnRenamed("id", "_id"), F.col("_leg") == F.col("_id"), "left")
    dx, dy, px, py = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), F.col("x") - F.col("x1"), F.col("y") - F.col("y1")
    size = F.hypot(dx, dy)
    along, across = (px * dx + py * dy) / size, (px * dy - py * dx) / size
    before, after = (along < 0) & (F.col("leg") == 0), (along > size) & (F.col("leg") == F.col("legs") - 1)
    corner = ((along < 0) | (along > size)) & ~before & ~after
    station = F.col("base") + F.when(corner, F.greatest(F.lit(0.0), F.least(along, size))).otherwise(along)
    offset = F.when(corner, F.col("distance") * F.when(across < 0, -1).otherwise(1)).otherwise(across)
    side = F.when(offset > 0, "right").when(offset < 0, "left").when(offset == 0, "on")
    where = F.when(before, "before").when(after, "after").when(F.col("line").isNotNull(), "along")
    return both.select("id", "line", station.alias("station"), offset.alias("offset"), side.alias("side"), where.alias("position"))


def ground_distances(legs: DataFrame, grid_scale: Column, elevation: Column, key: str = "traverse_id") -> DataFrame:
    """key, grid_m, ground_m, ppm: grid distances over the combined factor (grid times elevation factor)."""
    factor = grid_scale * (geom.MEAN_R / (geom.MEAN_R + elevation))
    out = legs.groupBy(key).agg(F.sum("distance_m").alias("grid_m"), F.sum(F.col("distance_m") / factor).alias("ground_m"))
    return out.withColumn("ppm", F.try_divide(1e6 * (F.col("ground_m") - F.col("grid_m")), "grid_m"))


_DMS = r"^\s*(-?)(\d{1,3})[°d:\s]\s*(\d{1,2})['m:\s]\s*(\d{1,2}(?:\.\d+)?)[\"s]?\s*([NSEWnsew]?)\s*$"


def dms(c: Column, most: float) -> Column:
    """Degrees of a text in degrees-minutes-seconds or plain decimal form; NULL if it is neither or out of range."""
    part = lambda i: F.regexp_extract(c, _DMS, i)
    size = part(2).try_cast("double") + part(3).try_cast("double") / 60 + part(4).try_cast("double") / 3600
    minus = (part(1) == "-") != F.upper(part(5)).isin("S", "W")
    sound = (part(3).try_cast("double") < 60) & (part(4).try_cast("double") < 60)
    v = F.when(c.rlike(_DMS), F.when(sound, F.when(minus, -size).otherwise(size))).otherwise(c.try_cast("double"))
    return F.when(F.abs(v) <= most, v)


def normalise_coordinates(df: DataFrame, lat: str, lon: str) -> DataFrame:
    """lat_deg, lon_deg and ok beside the given text columns; rows that aren't positions stay, with ok false."""
    need_columns(df, lat, lon)
    out = df.withColumn("lat_deg", dms(F.col(lat), 90)).withColumn("lon_deg", dms(F.col(lon), 180))
    return out.withColumn("ok", F.col("lat_deg").isNotNull() & F.col("lon_deg").isNotNull())


def utm_columns(df: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """zone, south, easting, northing of each position."""
    zone = F.least(F.floor((F.col(lon) + 180) / 6) + 1, F.lit(60)).cast("int")
    e, n = geom.utm(F.col(lon), F.col(lat), zone, F.col(lat) < 0)
    return df.withColumn("zone", zone).withColumn("south", F.col(lat) < 0).withColumn("easting", e).withColumn("northing", n)


def grid_bins(df: DataFrame, side: float = 1000.0, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """zone, south, square_e, square_n, count: positions a UTM grid square."""
    u = utm_columns(df, lon, lat)
    return u.groupBy("zone", "south", F.floor(F.col("easting") / side).alias("square_e"), F.floor(F.col("northing") / side).alias("square_n")).agg(F.count("*").alias("count"))


TWO_PI = 2 * math.pi
