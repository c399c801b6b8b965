"""Dissolve of members that overlap, touch along parts of sides, hold holes or cover each other, against sets of unit cells."""

import collections
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoanswers import catalog
from geoanswers.functions import geom
from geoanswers.operators import coverage, shapes, vector


def layer(spark, rows):
    """(id, group, polygon parts) as a layer."""
    return spark.createDataFrame([(i, g, ("polygon" if len(p) == 1 else "multipolygon", p)) for i, g, p in rows], f"id long, label string, geom {geom.TYPE}")


def box(x0, y0, x1, y1):
    return [(float(x0), float(y0)), (float(x1), float(y0)), (float(x1), float(y1)), (float(x0), float(y1)), (float(x0), float(y0))]


def cells_of(boxes):
    return {(x, y) for x0, y0, x1, y1 in boxes for x in range(x0, x1) for y in range(y0, y1)}


def around(cells):
    return sum((x + dx, y + dy) not in cells for x, y in cells for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1)))


@pytest.mark.parametrize("size", [None, 3.0, 2.37])
def test_rectangles_equal_unit_cells(spark, size):
    r, rows, want = random.Random(7), [], {}
    for g in range(12):
        boxes = []
        for _ in range(r.randint(1, 25)):
            x, y = r.randrange(30), r.randrange(30)
            boxes.append((x, y, x + r.randint(1, 9), y + r.randint(1, 9)))
        boxes += r.choices(boxes, k=2)
        rows += [(len(rows) + k, f"g{g}", [[box(*b)]]) for k, b in enumerate(boxes)]
        want[f"g{g}"] = (len(cells_of(boxes)), around(cells_of(boxes)))
    got = vector.dissolve(layer(spark, rows), "label", size=size).select("*", geom.area(F.col("geom")).alias("whole")).collect()
    assert {r.group: (round(r.area, 9), round(r.perimeter, 9)) for r in got} == want
    assert all(abs(r.area - r.whole) < 1e-9 for r in got)
    if size:  # cuts of the grid leave no vertices
        plain = {r.group: (r.sides, r.rings) for r in vector.dissolve(layer(spark, rows), "label").collect()}
        assert {r.group: (r.sides, r.rings) for r in got} == plain


def test_overlap_and_t_junction(spark):
    rows = [(1, "over", [[box(0, 0, 2, 2)]]), (2, "over", [[box(1, 0, 3, 2)]]), (3, "t", [[box(0, 0, 2, 1)]]), (4, "t", [[box(0, 1, 1, 2)]]), (5, "t", [[box(1, 1, 2, 2)]])]
    got = {r.group: (r.area, r.perimeter, r.rings) for r in vector.dissolve(layer(spark, rows), "label").collect()}
    assert got == {"over": (6, 10, 1), "t": (4, 8, 1)}


def test_holes_islands_and_members_inside_members(spark):
    frame = [box(0, 0, 10, 10), box(2, 2, 8, 8)[::-1]]
    rows = [(1, "ring", [frame]), (2, "island", [frame]), (3, "island", [[box(4, 4, 5, 5)]]), (4, "filled", [frame]), (5, "filled", [[box(1, 1, 9, 9)]]), (6, "same", [[box(0, 0, 3, 3)]]), (7, "same", [[box(1, 1, 2, 2)]]), (8, None, [[box(0, 0, 1, 1)], [box(5, 5, 6, 6)]])]
    for size in (None, 2.5, 1.0):
        got = {r.group: (round(r.area, 9), round(r.perimeter, 9), r.rings, r.kind) for r in vector.dissolve(layer(spark, rows), "label", size=size).select("*", "geom.kind").collect()}
        assert got == {"ring": (64, 64, 2, "polygon"), "island": (65, 68, 3, "multipolygon"), "filled": (100, 40, 1, "polygon"), "same": (9, 12, 1, "polygon"), None: (2, 8, 2, "multipolygon")}


@pytest.mark.parametrize("size", [None, 0.21])
def test_slanted_members_equal_pairwise_unions(spark, size):
    r, rows, want = np.random.default_rng(3), [], {}
    for g in range(6):
        members = []
        for k in range(9):
            c, t = r.random(2), np.sort(r.random(r.integers(3, 8))) * 2 * math.pi
            ring = c + 0.25 * r.random() * np.stack([np.cos(t), np.sin(t)], axis=1)
            members.append(np.vstack([ring, ring[:1]]))
        rows += [(len(rows) + k, f"g{g}", [[list(map(tuple, m.tolist()))]]) for k, m in enumerate(members)]
        parts = shapes.united([shapes.Shape("polygon", [[m]]) for m in members])
        want[f"g{g}"] = (sum(shapes.signed_area(x) for p in parts for x in p), sum(np.hypot(*np.diff(x, axis=0).T).sum() for p in parts for x in p))
    got = {r.group: (r.area, r.perimeter) for r in vector.dissolve(layer(spark, rows), "label", size=size).collect()}
    assert got.keys() == want.keys()
    for g in want:
        assert np.allclose(got[g], want[g], rtol=1e-9)


def test_attributes_of_the_lowest_id(spark):
    rows = layer(spark, [(5, "a", [[box(0, 0, 1, 1)]]), (3, "a", [[box(1, 0, 2, 1)]]), (9, "b", [[box(4, 0, 5, 1)]])]).withColumn("owner", F.concat(F.lit("o"), "id"))
    got = {r.group: (r.id, r.owner, r.area) for r in coverage.dissolve(rows, "label", ("id", "owner")).collect()}
    assert got == {"a": (3, "o3", 2.0), "b": (9, "o9", 1.0)}


def test_nothing_to_dissolve(spark):
    empty = layer(spark, [(1, "a", [[box(0, 0, 1, 1)]])]).limit(0)
    assert vector.dissolve(empty, "label").count() == 0
    flat = layer(spark, [(1, "a", [[box(0, 0, 1, 0)]])])
    assert vector.dissolve(flat, "label").count() == 0
    assert vector.dissolve(layer(spark, [(1, "a", [[box(0, 0, 1, 1)]])]).withColumn("geom", F.when(F.col("id") > 1, F.col("geom"))), "label").count() == 0


def test_the_grid_is_never_a_whole(spark):
    """A large member's sides are spread over cells."""
    n = 4000
    t = np.linspace(0, 2 * math.pi, n, endpoint=False)
    ring = [(100 * math.cos(a), 100 * math.sin(a)) for a in t]
    rows = layer(spark, [(1, "a", [[ring + ring[:1]]]), (2, "a", [[box(-10, -150, 10, 150)]])])
    pieces = coverage.boundary(rows, "label", 20.0)
    r = vector.dissolve(rows, "label", size=20.0).first()
    circle = n / 2 * math.sin(2 * math.pi / n) * 100**2
    inside = 2 * sum(20 / 1000 * math.sqrt(100**2 - (-10 + (k + 0.5) * 20 / 1000) ** 2) for k in range(1000))
    assert abs(r.area - (circle + 6000 - inside)) < 0.5 and r.rings == 1
    assert pieces.count() > n * 0.9 and collections.Counter(pieces.filter("cut1 and cut2").select("x1").toPandas().x1 > 1e9)[True] == 0


def test_a_shape_with_very_many_partners_is_spread(spark):
    n = 40
    partners = [(k, "h", [[box(3 * (k % n) + 1, 3 * (k // n) + 1, 3 * (k % n) + 2, 3 * (k // n) + 2)]]) for k in range(n * n)]
    left = layer(spark, [(1, "a", [[box(0, 0, 3 * n, 3 * n)]]), (2, "a", [[box(500, 0, 501, 1)]]), (3, "a", [[box(1, 1, 2, 2)]]), (4, "a", [[box(-5, 4, 1, 5)], [box(0, 40, 2, 50)]])])
    right = layer(spark, partners)
    got = sorted((r.id, r.piece, round(r.area, 6), r.holes) for r in vector.difference(left, right).select("id", "piece", geom.area(F.col("geom")).alias("area"), (F.size(F.col("geom.parts")[0]) - 1).alias("holes")).collect())
    assert got[0] == (1, 0, 9 * n * n - n * n, n * n) and got[1] == (2, 0, 1, 0) and [x[0] for x in got[2:]] == [4, 4]
    assert round(sum(x[2] for x in got[2:]), 6) == 6 + 20 - 4
    away = right.select(F.lit(1).cast("long").alias("group"), "geom")
    pieces = coverage.boundary(left.filter("id = 1"), "id", None, away)
    assert pieces.count() >= 4 * n * n and pieces.select(F.spark_partition_id().alias("p")).distinct().count() > 1


def test_difference_equals_unit_cells(spark):
    r = random.Random(11)
    some = lambda n: [(x, y, x + r.randint(1, 8), y + r.randint(1, 8)) for x, y in ((r.randrange(25), r.randrange(25)) for _ in range(n))]
    left, right = some(40), some(60)
    taken = cells_of(right)
    want = {k: len(cells_of([b]) - taken) for k, b in enumerate(left)}
    out = vector.difference(layer(spark, [(k, "l", [[box(*b)]]) for k, b in enumerate(left)]), layer(spark, [(k, "r", [[box(*b)]]) for k, b in enumerate(right)]))
    got = {q.id: q.area for q in out.groupBy("id").agg(F.round(F.sum(geom.area(F.col("geom"))), 6).alias("area")).collect()}
    assert got == {k: v for k, v in want.items() if v}


def test_rectangles_on_tenths_in_any_order():
    """Sides of one height that differ by rounding: no piece is told by the wrong one of them."""
    for seed in range(12):
        r = np.random.default_rng(seed)
        a = r.integers(0, 300, (60, 2)) / 10.0
        q = np.hstack([a, a + r.integers(1, 10, (60, 2))])
        s, w = np.concatenate([q[:, k] for k in ([0, 1, 2, 1], [2, 1, 2, 3], [0, 3, 2, 3], [0, 1, 0, 3])]), np.repeat([1, 1, -1, -1], 60)
        order = r.permutation(len(s))
        s, w = s[order], w[order]
        p, _, _ = coverage.outline(s, np.stack([w, 0 * w], axis=1), np.zeros(240, int), np.array([[-11.3, -12.7]]), np.zeros((1, 2), int), np.zeros((240, 2), bool), 40.0)
        covered = np.zeros((420, 420), bool)
        for x0, y0, x1, y1 in np.round(q * 10).astype(int):
            covered[x0:x1, y0:y1] = True
        assert abs((p[:, 0] * p[:, 3] - p[:, 2] * p[:, 1]).sum() / 2 - covered.sum() / 100) < 1e-6


def test_many_small_groups_are_put_together_in_batches(spark):
    """No call of Python a group: for dissolve and for what is left of many shapes."""
    at = lambda v: F.col("id") * 0 + v
    ids = spark.range(700).withColumn("k", (F.col("id") / 2).cast("long"))
    pairs = ids.select("id", "k", geom.box((F.col("id") % 2 * 10).cast("double"), at(0.0), (F.col("id") % 2 * 10 + 10).cast("double"), at(5.0) + F.col("k") % 3).alias("geom"))
    merged = coverage.dissolve(pairs, "k")
    assert {(r.sides, r.rings, r.area, r.perimeter) for r in merged.collect()} == {(6, 1, 20.0 * (5 + k), 40.0 + 2 * (5 + k)) for k in range(3)}
    holed = pairs.select("id", geom.box(at(0.0), at(0.0), at(9.0), at(9.0)).alias("geom"))
    away = ids.select("id", geom.box(at(3.0), at(3.0), at(4.0), F.when(F.col("id") % 2 == 0, 4.0).otherwise(20.0)).alias("geom"))
    left = coverage.without(holed, away.union(ids.filter("id % 5 = 0").select("id", geom.box(at(6.0), at(-1.0), at(7.0), at(10.0)).alias("geom"))))
    areas = {}
    for r in left.select("id", "piece", F.round(geom.area(F.col("geom")), 6).alias("area")).collect():
        areas.setdefault(r.id, []).append((r.piece, r.area))
    assert len(areas) == 700
    for k, found in areas.items():
        hole = 1.0 if k % 2 == 0 else 6.0
        assert [p for p, _ in sorted(found)] == list(range(2 if k % 5 == 0 else 1))
        assert sorted(a for _, a in found) == ([18.0, 54.0 - hole] if k % 5 == 0 else [81.0 - hole])
    for df in (merged, left):
        assert "FlatMapGroups" not in df._jdf.queryExecution().executedPlan().toString()


def test_the_union_query_gives_what_is_left_of_boxes_too(spark, sf_dir):
    """What no lot covers of the boxes, on unit cells of 0.1 m."""
    covered, bare = np.zeros((11_000, 11_000), bool), 0
    for k, w in spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_size").collect():
        x, y = k * 7919 % 10_000, k * 104_729 % 10_000
        covered[x : x + 10 * w, y : y + 10 * (k % 13 + 1)] = True
    for (n,) in spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey").collect():
        x, y = n % 5 * 2_000, n // 5 * 2_000
        bare += int((~covered[x : x + 1_800, y : y + 1_800]).sum())
    got = {r.side: r.area for r in catalog.queries()["union"](spark, sf_dir).collect()}
    assert set(got) == {"both", "left", "right"} and got["right"] == round(bare / 100, 2)


def _sides_of(q, away):
    """Sides of rectangles, as ``outline`` takes them in one cell; the first ``away`` of them are taken away."""
    s = np.concatenate([q[:, k] for k in ([0, 1, 2, 1], [2, 1, 2, 3], [0, 3, 2, 3], [0, 1, 0, 3])])
    w, gone = np.repeat([1, 1, -1, -1], len(q)), np.tile(np.arange(len(q)) < away, 4)
    return s, np.stack([np.where(gone, 0, w), np.where(gone, w, 0)], axis=1), np.zeros(len(s), int), np.array([[-11.3, -12.7]]), np.zeros((1, 2), int), np.zeros((len(s), 2), bool)


@pytest.mark.parametrize("away", [0, 300])
def test_members_that_lie_on_each_other_many_times_are_not_all_cut(away):
    r = np.random.default_rng(3)
    a = r.integers(0, 200, (700, 2)) / 10.0
    q = np.hstack([a, a + r.integers(1, 10, (700, 2))])
    whole = _sides_of(q, away)
    *cells, of = coverage.thinned(*whole)
    p, cell, _ = coverage.outline(*cells, 30.0)
    grid = np.zeros((2, 320, 320), bool)
    for k, (x0, y0, x1, y1) in enumerate(np.round(q * 10).astype(int)):
        grid[int(k < away), x0:x1, y0:y1] = True
    left = np.pad(grid[0] & ~grid[1], 1)
    long = sum(int((left != np.roll(left, 1, axis)).sum()) for axis in (0, 1)) / 10
    assert abs((p[:, 0] * p[:, 3] - p[:, 2] * p[:, 1]).sum() / 2 - left.sum() / 100) < 1e-6
    assert abs(np.hypot(p[:, 2] - p[:, 0], p[:, 3] - p[:, 1]).sum() - long) < 1e-6 and set(of) == {0}
    assert len(coverage.noded(*(cells[k] for k in (0, 2)), 30.0)[0]) < len(coverage.noded(whole[0], whole[2], 30.0)[0]) / 10


def test_sides_along_a_cell_s_own_lines_stay():
    """Covered ground on one side of the lower line, none below it."""
    q = np.array([[0.0, 0.0, 9.0, 9.0]] * 3 + [[k * 0.37, 0.0, k * 0.37 + 4.1, 8.0] for k in range(12)])
    s, w, key, _, _, cuts = _sides_of(q, 0)
    *cells, _ = coverage.thinned(s, w, key, np.array([[-0.5, 0.0]]), np.zeros((1, 2), int), cuts)
    p, _, _ = coverage.outline(*cells, 10.0)
    assert abs((p[:, 0] * p[:, 3] - p[:, 2] * p[:, 1]).sum() / 2 - 81) < 1e-9


def test_holes_find_their_parts_without_a_look_at_every_part(monkeypatch):
    ring = lambda x, y, a: np.array([(x, y), (x + a, y), (x + a, y + a), (x, y + a), (x, y)], float)
    outers = [ring(10 * (k % 30), 10 * (k // 30), 9) for k in range(900)]
    holes = [ring(10 * (k % 30) + 3, 10 * (k // 30) + 3, 2)[::-1] for k in range(0, 900, 2)]
    looks, located = [], shapes.located
    monkeypatch.setattr(shapes, "located", lambda points, shape: looks.append(len(points)) or located(points, shape))
    parts = shapes.nested([*holes, *outers, ring(-5, -5, 400), ring(-4, -4, 396)[::-1]])
    assert sorted(len(p) for p in parts) == [1] * 450 + [2] * 451 and sum(looks) < 2_000
    assert all((p[0].min(axis=0) < p[1].min(axis=0)).all() and (p[0].max(axis=0) > p[1].max(axis=0)).all() for p in parts if len(p) == 2)
