"""What operators say beside their answers: prices, sources, alignment, nearest; survey chains on the ellipsoid and against lines."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoanswers.functions import geom
from geoanswers.functions.geodesy import direct, inverse
from geoanswers.meta import LayerMeta, Refused
from geoanswers.operators import runs, sjoin, survey

ZONE, DEGREES = LayerMeta("EPSG:32635", "m"), LayerMeta("EPSG:4326", "degrees", True)


def test_price_of_a_batch(spark):
    prices = spark.createDataFrame([("place", 0, 150, 1, None), ("trace", 250, None, 1, 4), ("free", 0, None, None, None), ("odd", None, 90, 1, 1)], "kind string, cents int, leave_cents int, placements int, traces int")
    items = [("a", "place", 12), ("a", "trace", 2), ("free", "free", 3), ("unknown", "odd", 1), ("unknown", "trace", 1), ("none", "trace", 0), ("none", "trace", None), ("absent", "other", 1), ("idle", "odd", 0), ("idle", "trace", 1), (None, "trace", 1)]
    got = {r.batch_id: tuple(r)[1:] for r in runs.batch_cost(spark.createDataFrame(items, "batch_id string, kind string, sheets int"), prices).collect()}
    assert got == {
        "a": (2, 14, 0, 500, 1800, 14, 8), "free": (1, 3, 0, 0, 0, 0, 0), "unknown": (2, 2, 1, None, None, None, None), "none": (2, 0, 0, None, None, None, None),
        "absent": (1, 1, 1, None, None, None, None), "idle": (2, 1, 0, 250, 0, 1, 4), None: (1, 1, 0, 250, 0, 1, 4),
    }
    old = prices.select("kind", "cents")
    assert runs.batch_cost(spark.createDataFrame(items[:2], "batch_id string, kind string, sheets int"), old).first().asDict() == {"batch_id": "a", "items": 2, "sheets": 14, "unknown": 0, "cents": 500, "later_cents": 0, "placements": 0, "traces": 0}


def test_wrong_sources_are_named(spark):
    rows = [("t", "file", f"s{k:02d}", 1, "raster", "vector" if k % 2 else "raster") for k in range(40)] + [("u", "layer", "fine", None, "vector", "vector"), ("u", "file", None, 5, "vector", None)]
    df = spark.createDataFrame(rows, "task_id string, origin string, label string, bytes int, wanted string, kind string")
    got = {r.task_id: r for r in runs.source_summary(df, F.col("kind"), most=3).collect()}
    assert (got["t"].wrong, got["t"].wrong_sources, got["t"].more_wrong) == (20, ["s01", "s03", "s05"], 17)
    assert (got["u"].files, got["u"].layers, got["u"].bytes, got["u"].wrong, got["u"].wrong_sources, got["u"].more_wrong) == (1, 1, 5, 1, [None], 0)


def spots(spark, rows):
    return spark.createDataFrame(rows, "id long, x double, y double").withColumn("geom", F.when(F.col("x").isNotNull(), geom.point(F.col("x"), F.col("y"))))


def test_alignment_counts_what_it_drops(spark):
    right = spots(spark, [(1, 28.9, 41.0), (2, 28.9, 91.0), (3, None, None), (4, float("nan"), 41.0), (5, 400.0, 41.0)])
    assert tuple(sjoin.alignment(ZONE, right, DEGREES).first()) == (5, 1, 3, 1, "EPSG:32635")
    assert [r.id for r in sjoin.aligned(ZONE, right, DEGREES).collect()] == [1]
    left = right.filter("id = 1").withColumn("geom", geom.reprojected(F.col("geom"), "EPSG:4326", "EPSG:32635"))
    assert sjoin.relate_layers(left, ZONE, right, DEGREES, "intersects").select("tested", "reference_features", "reference_empty", "reference_dropped").first() == (1, 1, 1, 3)
    with pytest.raises(Refused):
        sjoin.relate_layers(left, ZONE, right.filter("id > 1"), DEGREES, "intersects")


def test_a_layer_is_not_related_to_itself(spark):
    layer = spots(spark, [(1, 0.0, 0.0), (2, 5.0, 5.0)])
    for other in (layer, layer.select("*")):
        with pytest.raises(Refused):
            sjoin.relate(layer, other, "intersects")
    assert sjoin.relate(layer, spots(spark, [(9, 5.0, 5.0)]), "intersects").count() == 1


def test_nearest_says_what_was_considered(spark):
    layer = spots(spark, [(1, 0.0, 3.0), (2, 4.0, 0.0), (3, 0.0, -5.0), (4, None, None)])
    got = sjoin.nearest_k(layer, 0, 0, 2).orderBy("distance").collect()
    assert [tuple(r) for r in got] == [(1, 3.0, 3, 3.0, 4.0), (2, 4.0, 3, 3.0, 4.0)]


def test_direct_and_inverse_agree():
    r = np.random.default_rng(2)
    lon, lat, az, far = r.uniform(-180, 180, 500), r.uniform(-89, 89, 500), r.uniform(0, 360, 500), r.uniform(0, 9e6, 500)
    x, y, there = direct(lon, lat, az, far)
    metres, go, back, good = inverse(lon, lat, x, y)
    assert good.all() and np.abs(metres - far).max() < 1e-3
    turn = (go - az + 180) % 360 - 180
    assert np.abs(turn * np.minimum(far, 6e6) / 6e6).max() < 1e-6 and np.abs(((back - there + 180 + 180) % 360 - 180)[far > 1]).max() < 1e-5


def test_a_geodesic_polygon_closes(spark):
    corners = [(28.9, 41.0), (30.2, 41.4), (31.0, 39.0), (27.5, 38.2)]
    ring = corners + corners[:1]
    legs = []
    for k, (a, b) in enumerate(zip(ring, ring[1:])):
        metres, go, _, _ = inverse(*[np.array([v]) for v in (*a, *b)])
        legs.append(("p", k, float(go[0]), float(metres[0])))
    many = [("m", k, 90.0, 10.0) for k in range(25_000)]  # over batches
    odd = [("o", 0, 10.0, 5.0), ("o", 1, float("nan"), 5.0), ("o", 2, 10.0, 5.0), ("n", 0, 1.0, 1.0), (None, 0, 0.0, 7.0)]
    df = spark.createDataFrame(legs + many + odd, "traverse_id string, leg long, azimuth_deg double, distance_m double")
    starts = spark.createDataFrame([("p", *corners[0]), ("m", 10.0, 0.0), ("o", 0.0, 0.0), ("far", 0.0, 0.0), ("n", 0.0, 95.0), (None, 0.0, 0.0)], "traverse_id string, lon double, lat double")
    got = survey.traverse_geodesic(df, starts, ["leg"]).collect()
    assert len(got) == len(legs) + len(many) + len(odd)
    at = {(r.traverse_id, r.seq): r for r in got}
    assert all(abs(at["p", k + 1].lon - c[0]) < 1e-8 and abs(at["p", k + 1].lat - c[1]) < 1e-8 for k, c in enumerate(ring[1:]))
    assert abs(at["m", 25_000].lon - 10 - math.degrees(250_000 / 6378137)) < 1e-8
    assert [at["o", k].status for k in (1, 2, 3)] == ["ok", "broken", "broken"] and at["n", 1].status == "no_start" and at[None, 1].status == "ok"
    closed = {r.traverse_id: r for r in survey.closure_geodesic(df, starts, ["leg"]).collect()}
    assert closed["p"].misclosure < 1e-3 and closed["p"].precision is None and closed["o"].misclosure is None
    with pytest.raises(Refused):
        survey.traverse_geodesic(df, starts, ["leg"], azimuths="grid")


def test_stations_run_on_over_legs(spark):
    line = lambda *p: ("linestring", [[[(float(x), float(y)) for x, y in p]]])
    lines = spark.createDataFrame([("a", line((0, 0), (10, 0), (10, 0), (10, 10))), ("b", line((100, 0), (100, 50)))], f"id string, geom {geom.TYPE}")
    points = spark.createDataFrame([(1, 5.0, 2.0), (2, -3.0, -1.0), (3, 12.0, 4.0), (4, 13.0, -4.0), (5, 9.0, 14.0), (6, 101.0, 20.0), (7, 10.0, 7.0)], "id long, x double, y double")
    got = {r.id: (r.line, round(r.station, 9), round(r.offset, 9), r.side, r.position) for r in survey.station_offset_nearest(points, lines).collect()}
    assert got == {
        1: ("a", 5, -2, "left", "along"), 2: ("a", -3, 1, "right", "before"), 3: ("a", 14, 2, "right", "along"), 4: ("a", 10, 5, "right", "along"),
        5: ("a", 24, -1, "left", "after"), 6: ("b", 20, 1, "right", "along"), 7: ("a", 17, 0, "on", "along"),
    }
    none = survey.station_offset_nearest(points, lines.limit(0)).collect()
    assert len(none) == 7 and none[0].line is None and none[0].side is None


def test_a_point_on_the_edge_of_a_box_in_degrees_meets_it(spark):
    """Edges come back from degrees within rounding, and boxes that are as near are compared."""
    at = [((k * 3571 + 37) % 10000 / 10.0 + 500000, (k * 7717 + 11) % 10000 / 10.0 + 4540000) for k in range(60)]
    points = spark.createDataFrame([(4 * k + q, x + dx, y + dy) for k, (x, y) in enumerate(at) for q, (dx, dy) in enumerate([(5.0, 1.0), (-5.0, 2.0), (3.0, 5.0), (0.0, -5.0)])], "id long, x double, y double")
    points = points.withColumn("geom", geom.point(F.col("x"), F.col("y")))
    boxes = spark.createDataFrame([(k, x, y) for k, (x, y) in enumerate(at)], "id long, x double, y double")
    boxes = boxes.withColumn("geom", geom.reprojected(geom.box(F.col("x") - 5, F.col("y") - 5, F.col("x") + 5, F.col("y") + 5), "EPSG:32635", "EPSG:4326"))
    assert sjoin.relate_layers(points, ZONE, boxes, DEGREES, "intersects").first().matched == 240
    moved = sjoin.aligned(ZONE, boxes, DEGREES)
    assert sjoin.relate(points, moved, "intersects", size=50.0).count() == 240  # by cells, neither side broadcast
    assert sjoin.relate(points.withColumn("geom", geom.point(F.col("x") + 11, F.col("y") + 2000)), moved, "intersects").count() == 0


def test_the_other_layer_is_worked_out_once_and_equal_shapes_are_looked_at_once(spark, monkeypatch):
    monkeypatch.setattr(sjoin, "FEW_FEATURES", 4)
    seen, asked, pairs = spark.sparkContext.accumulator(0), [], sjoin.pairs
    touched = F.udf(lambda v: seen.add(1) or v, "double")

    def counted(left, right, *rest, **more):
        asked.append((left.count(), right.count()))
        return pairs(left, right, *rest, **more)

    k = F.col("id") % 10
    left = spark.range(200).select("id", geom.point(k * 10.0 + 2, k * 0.0 + 2).alias("geom")).union(spark.createDataFrame([(200, None)], f"id long, geom {geom.TYPE}"))
    far = spark.range(60).withColumn("x", touched((F.col("id") % 6 * 10).cast("double")))
    right = far.select("id", geom.box(F.col("x"), F.lit(0.0), F.col("x") + 5, F.lit(5.0)).alias("geom"))
    out = sjoin.relate_layers(left, ZONE, right, ZONE, "intersects").first()
    assert (out.tested, out.matched, out.reference_features) == (201, 120, 60) and seen.value == 60
    monkeypatch.setattr(sjoin, "pairs", counted)
    got = sorted(r.id for r in sjoin.relate(left, right, "intersects").collect())
    assert got == [i for i in range(200) if i % 10 < 6] and asked == [(201, 60), (11, 6)]
