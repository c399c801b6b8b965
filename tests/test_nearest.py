"""Nearest neighbours by the leaves of a partition tree, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoanswers.functions import geom
from geoanswers.operators import nearest, shapes, sjoin, survey


def spots(spark, xy, first=0):
    return spark.createDataFrame([(first + k, float(x), float(y)) for k, (x, y) in enumerate(xy)], "id long, x double, y double").withColumn("geom", geom.point(F.col("x"), F.col("y"))).select("id", "geom")


def brute(a, b):
    d = np.hypot(a[:, None, 0] - b[:, 0], a[:, None, 1] - b[:, 1])
    return {i: (int(d[i].argmin()), float(d[i].min())) for i in range(len(a))}


@pytest.mark.parametrize("kind", ["even", "clusters", "ties", "far"])
def test_points_equal_brute_force(spark, kind):
    r = np.random.default_rng(4)
    a, b = r.random((600, 2)) * 100, r.random((900, 2)) * 100
    if kind == "clusters":
        b = np.concatenate([r.normal((20, 20), 0.01, (700, 2)), r.random((200, 2)) * 100])
        a = np.concatenate([r.normal((20, 20), 0.02, (400, 2)), a[:200]])
    if kind == "ties":
        a, b = np.floor(a / 5), np.floor(b / 5)
    if kind == "far":
        b = b[:120] + 5000
    got = {q.id: (q.neighbor_id, q.distance) for q in nearest.by_leaves(spots(spark, a).repartition(3), spots(spark, b).repartition(4), 50).collect()}
    want = brute(a, b)
    assert {i: n for i, (n, _) in got.items()} == {i: n for i, (n, _) in want.items()}
    assert all(abs(got[i][1] - want[i][1]) < 1e-9 for i in want)


def test_candidates_of_dense_clusters_are_few(spark):
    """Lefts go to the leaves that may hold something nearer, not to all of a cluster."""
    r = np.random.default_rng(5)
    b = np.concatenate([r.normal((0, 0), 1e-3, (4000, 2)), r.normal((50, 50), 1e-3, (4000, 2)), r.random((200, 2)) * 100])
    tree = nearest.Tree(b, 80)
    leaf = tree.at(b)
    assert tree.leaves == 80 and np.bincount(leaf).max() <= 5 * np.median(np.bincount(leaf))
    a = np.concatenate([r.normal((0, 0), 2e-3, (300, 2)), r.normal((50, 50), 2e-3, (300, 2))])
    box = np.array([[*b[leaf == k].min(axis=0), *b[leaf == k].max(axis=0)] for k in range(80)])
    reach = np.array([d for _, d in brute(a, b).values()])
    tried = (nearest._gaps(np.hstack([a, a]), box) <= reach[:, None]).sum(axis=1)
    assert tried.mean() < 4


def test_shapes_and_odd_rows(spark):
    square = ("polygon", [[[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)]]])
    line = ("linestring", [[[(10.0, 0.0), (10.0, 9.0)]]])
    rows = [("a", square), ("b", line), ("c", ("point", [[[(7.0, 7.0)]]])), ("d", None)] + [(f"z{k}", ("point", [[[(100.0 + k, 50.0)]]])) for k in range(60)]
    right = spark.createDataFrame(rows, f"id string, geom {geom.TYPE}")
    left = spark.createDataFrame([(1, ("point", [[[(5.0, 2.0)]]])), (2, line), (3, None), (4, ("point", [[[(2.0, 2.0)]]])), (5, ("point", [[[(7.0, 6.0)]]]))], f"id long, geom {geom.TYPE}")
    got = {q.id: (q.neighbor_id, q.distance) for q in nearest.by_leaves(left, right, 8).collect()}
    assert got == {1: ("a", 1.0), 2: ("b", 0.0), 3: (None, None), 4: ("a", 0.0), 5: ("c", 1.0)}
    assert {q.id: (q.neighbor_id, q.distance) for q in sjoin.nearest_neighbor(left, right).collect()} == got
    none = sjoin.nearest_neighbor(left, right.limit(0))
    assert none.schema["neighbor_id"].dataType.typeName() == "string" and none.filter("neighbor_id is null").count() == 5
    assert shapes.IN > shapes.OUT


def test_a_leaf_with_very_many_visitors_is_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(nearest, "BLOCK", 50)
    r = np.random.default_rng(6)
    a, b = r.normal((0, 0), 1e-4, (700, 2)), r.random((300, 2)) * 10
    got = {q.id: q.neighbor_id for q in nearest.by_leaves(spots(spark, a), spots(spark, b), 30).collect()}
    assert got == {i: n for i, (n, _) in brute(a, b).items()}


def test_many_points_in_few_places_against_many_legs(spark):
    """Copies of a place and of a leg are looked at once; legs equally near but for rounding: the least line, the first leg."""
    line = lambda x, y: ("linestring", [[[(x, y), (x + 30, y), (x + 30, y + 40), (x + 60, y + 80)]]])
    at = [((k % 1000 * 3571 + 37) % 10000 / 10.0, (k % 1000 * 7717 + 11) % 10000 / 10.0) for k in range(1500)]
    lines = spark.createDataFrame([(k, line(*at[k])) for k in range(1500)], f"id long, geom {geom.TYPE}")
    places = [((k * 7919) % 10000 / 10.0, (k * 104729) % 10000 / 10.0) for k in (193, 515, 713, 737, 1183, 1193, 1515, 1713)]
    points = spark.createDataFrame([(k, *places[k % 8]) for k in range(20_000)] + [(20_000, None, 1.0), (20_001, float("nan"), 1.0)], "id long, x double, y double")
    got = survey.station_offset_nearest(points, lines).collect()
    assert len(got) == 20_002 and {r.line for r in got if r.id >= 20_000} == {None}
    a = np.array([(x + p, y + q) for x, y in at for p, q in ((0, 0), (30, 0), (30, 40))])
    d = np.array([(x + p, y + q) for x, y in at for p, q in ((30, 0), (30, 40), (60, 80))]) - a
    want = {}
    for k, p in enumerate(np.array(places)):
        t = np.clip(((p - a) * d).sum(axis=1) / (d * d).sum(axis=1), 0, 1)
        want[k] = int(np.round(np.hypot(*(p - a - t[:, None] * d).T), 9).argmin()) // 3
    assert {(r.id % 8, r.line) for r in got if r.id < 20_000} == set(want.items())


def test_single_points_are_told_from_other_shapes(spark):
    rows = [(1, ("point", [[[(3.0, 4.0)]]])), (2, None), (3, ("multipoint", [[[(0.0, 2.0)]], [[(9.0, 9.0)]]])), (4, ("point", [])), (5, ("linestring", [[[(0.0, 1.0), (5.0, 1.0)]]])), (6, ("point", [[[(0.0, -6.0)]]])), (7, ("point", None))]
    df = spark.createDataFrame(rows, f"id long, geom {geom.TYPE}")
    known, at = shapes.dots(df.toArrow().column("geom"))
    assert known.tolist() == [True, False, False, False, False, True, False] and at.tolist() == [[3.0, 4.0], [0.0, -6.0]]
    got = [tuple(r) for r in sjoin.nearest_k(df, 0, 0, 9).orderBy("distance").collect()]
    assert got == [(5, 1.0, 4, 1.0, 6.0), (3, 2.0, 4, 1.0, 6.0), (1, 5.0, 4, 1.0, 6.0), (6, 6.0, 4, 1.0, 6.0)]
