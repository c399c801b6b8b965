"""Polygons looked at together against one pair at a time."""

import random

import numpy as np
import pyarrow as pa
import pytest

from geoanswers.operators import coverage, many, shapes, sjoin, vector
from geoanswers.operators.shapes import Relation, Shape
from test_shapes import area, blob, polygon

RELATIONS = ["intersects", "within", "contains", "overlaps", "touches", "equals", "crosses"]


def some(seed, n=40):
    """Polygons of unit cells, with parts, holes and corners that touch, on halves too; triangles and boxes."""
    r, out = random.Random(seed), []
    for k in range(n):
        s = polygon(blob(r, r.randrange(1, 9)))
        if k % 4 == 1:
            s = Shape("multipolygon", [[ring * 0.5 + 1 for ring in p] for p in s.parts])
        if k % 4 == 2:
            s = Shape("polygon", [[np.array([[r.randrange(6), r.randrange(6)] for _ in range(3)], float)]])
        if k % 4 == 3:
            x, y, w, h = r.randrange(4), r.randrange(4), r.randrange(1, 4), r.randrange(1, 4)
            s = Shape("polygon", [[np.array([(x, y), (x + w, y), (x + w, y + h), (x, y + h)], float)]])
        out.append(s)
    return [*out, None, Shape("point", [[np.array([[1.0, 1.0]])]]), Shape("polygon", [])]


def every(a, b):
    i, j = np.divmod(np.arange(len(a) * len(b)), len(b))
    known = np.array([x is not None for x in a])[i] & np.array([x is not None for x in b])[j]
    return i[known], j[known]


@pytest.mark.parametrize("seed", range(4))
def test_relations_of_many_equal_those_of_one(seed, monkeypatch):
    monkeypatch.setattr(many, "TOGETHER", 5000)
    a, b = some(seed), some(seed + 100)
    i, j = every(a, b)
    one = [Relation(a[x], b[y]) for x, y in zip(i, j)]
    fit, _ = many.together(many.Flat(a), many.Flat(b), i, j)
    assert fit.mean() > 0.7
    monkeypatch.setattr(shapes, "Relation", None if seed else Relation)
    for predicate in RELATIONS:
        flat_a, flat_b = many.Flat(a), many.Flat(b)
        for at in many.together(flat_a, flat_b, i, j)[1]:
            found, sure = many.related(flat_a, flat_b, i[at], j[at], predicate)
            want = np.array([one[x].holds(predicate) for x in at])
            assert sure.mean() > 0.9 and (found[sure] == want[sure]).all()
    if not seed:
        keep, _ = sjoin.Holds("touches")(a, b, i, j)
        assert keep.tolist() == [x.holds("touches") for x in one]


def listed(value):
    return None if value is None else [[[(v["x"], v["y"]) for v in ring] for ring in part] for part in value["parts"]]


@pytest.mark.parametrize("seed", range(4))
def test_intersections_of_many_equal_those_of_one(seed):
    a, b = some(seed), some(seed + 100)
    i, j = every(a, b)
    flat_a, flat_b = many.Flat(a), many.Flat(b)
    for at in many.together(flat_a, flat_b, i, j)[1]:
        rings = many.shared(flat_a, flat_b, i[at], j[at])
        got = [listed(v) for v in rings.shapes(np.arange(len(at))).to_pylist()]
        want = [shapes.overlay(a[i[x]], b[j[x]], "intersection") for x in at]
        assert (rings.open == np.array([w is None for w in want])).all()
        assert got == [listed(shapes.written(w)) for w in want]
        assert np.allclose(np.bincount(rings.key, rings.area, minlength=len(at)), [area(w or []) for w in want])


def test_yards_by_boxes_in_little_time(monkeypatch):
    """No pair of a notched or two-part lot and a box is looked at alone."""
    monkeypatch.setattr(shapes, "Split", None)
    r, yards, shares = random.Random(5), [], []
    boxes = [(x, y, x + 180, y + 180) for x in range(0, 1000, 200) for y in range(0, 1000, 200)]
    for k in range(400):
        x0, y0, w, h = r.random() * 900, r.random() * 900, 30.0, 12.0
        at = lambda *p: np.array([(x0 + u * w, y0 + v * h) for u, v in p])  # noqa: B023, E731
        if k % 2:
            yards.append(Shape("polygon", [[at((0, 0), (1, 0), (1, 1), (2 / 3, 1), (2 / 3, 0.5), (1 / 3, 0.5), (1 / 3, 1), (0, 1))]]))
            rects = [(0, 0, 1, 0.5), (0, 0.5, 1 / 3, 1), (2 / 3, 0.5, 1, 1)]
        else:
            yards.append(Shape("multipolygon", [[at((0, 0), (1 / 3, 0), (1 / 3, 1), (0, 1))], [at((2 / 3, 0), (1, 0), (1, 1), (2 / 3, 1))]]))
            rects = [(0, 0, 1 / 3, 1), (2 / 3, 0, 1, 1)]
        rects = [(x0 + a * w, y0 + b * h, x0 + c * w, y0 + d * h) for a, b, c, d in rects]
        shares.append([sum(max(0, min(c, q[2]) - max(a, q[0])) * max(0, min(d, q[3]) - max(b, q[1])) for a, b, c, d in rects) for q in boxes])
    boxes = [Shape("polygon", [[np.array([(a, b), (c, b), (c, d), (a, d)], float)]]) for a, b, c, d in boxes]
    i, j = every(yards, boxes)
    share, whole = np.array(shares).reshape(-1), np.array([area(s.parts) for s in yards])[i]
    assert (sjoin.Holds("within")(yards, boxes, i, j)[0] == (share >= whole - 1e-9)).all()
    assert (sjoin.Holds("overlaps")(yards, boxes, i, j)[0] == ((share > 1e-9) & (share < whole - 1e-9))).all()


def test_overlays_of_yards_and_boxes_in_little_time(monkeypatch):
    """What the kernel of intersections gives is the overlay of each pair; no pair of few sides is looked at alone."""
    a, b = some(7, 24), some(8, 24)
    a, b = ([s for s in side if s is not None and s.dim == 2] for side in (a, b))
    i, j = every(a, b)
    want = [shapes.overlay(a[x], b[y], "intersection") for x, y in zip(i, j)]
    fit, _ = many.together(many.Flat(a), many.Flat(b), i, j)
    alone, overlay = [], shapes.overlay
    monkeypatch.setattr(shapes, "overlay", lambda *s: alone.append(s) or overlay(*s))
    keep, values = vector.Shared()(a, b, i, j)
    assert len(alone) == (~fit).sum() < 0.2 * len(i)
    assert keep.tolist() == [w is None or bool(w) for w in want]
    assert [area(p or []) for p in map(listed_arrays, values.to_pylist())] == pytest.approx([area(w or []) for w in want if w is None or w])


def listed_arrays(value):
    return None if value is None else [[np.array(ring) for ring in part] for part in listed(value)]


def test_sides_of_a_column_equal_those_of_its_shapes(monkeypatch):
    at = lambda *p: [{"x": float(x), "y": float(y)} for x, y in p]
    rows = [shapes.written(s.parts) for s in some(3) if s is not None and s.dim == 2]
    rows += [None, {"kind": "polygon", "parts": None}, {"kind": "polygon", "parts": []}, {"kind": "linestring", "parts": [[at((0, 0), (1, 1), (2, 0))]]}, {"kind": None, "parts": [[at((0, 0), (1, 1), (2, 0))]]}]
    rows += [{"kind": "polygon", "parts": [[at((0, 0), (0, 4), (4, 4), (4, 0)), at((1, 1), (2, 1)), at((1, 1), (2, 1), (2, 1), (2, 2))]]}]  # open, turned, short and repeating rings
    rows += [{"kind": "polygon", "parts": [[at((1, 1)), at((1, 1), (2, 1), (2, 2), (1, 1))], [], [[], at((5, 5), (6, 5), (6, 6))]]}]
    column = pa.array([None, *rows], shapes.ARROW)
    for c in (column, column.slice(7), column.slice(0, 0)):
        one = [(k, tuple(side)) for k, s in enumerate(shapes.read(c)) if s is not None and s.dim == 2 for side in s.sides.tolist()]
        sides, row = shapes.outlines(c)
        assert sorted(zip(row.tolist(), map(tuple, sides.tolist()))) == sorted(one)
    monkeypatch.setattr(shapes, "read", None)
    batch = pa.record_batch({"group": pa.array(range(len(column))), "geom": column, "away": pa.array([False] * len(column))})
    assert sum(b.num_rows for b in coverage._sides(iter([batch]))) > 100


ODD = [None, {"kind": "polygon", "parts": None}, {"kind": "polygon", "parts": []}, {"kind": None, "parts": [[[(0, 0), (1, 1), (2, 0)]]]}, {"kind": "circle", "parts": [[[(0, 0), (1, 1), (2, 0)]]]}]
ODD += [{"kind": "linestring", "parts": [[[(0, 0), (1, 1), (2, 0)]]]}, {"kind": "point", "parts": [[[(1, 1)]]]}, {"kind": "multipoint", "parts": [[[(1, 1)], [(2, 2)]]]}, {"kind": "point", "parts": [[[]]]}]
ODD += [{"kind": "polygon", "parts": [[[(0, 0), (0, 4), (4, 4), (4, 0)], [(1, 1), (2, 1)], [(1, 1), (2, 1), (2, 1), (2, 2)]]]}, {"kind": "polygon", "parts": [[[(1, 1)], [(1, 1), (2, 1), (2, 2), (1, 1)]], [], [[], [(5, 5), (6, 5), (6, 6)]]]}]
ODD += [{"kind": "polygon", "parts": [[ring]]} for ring in ([(1, 1), (2, 1), (1, 1)], [(0, 0), (0.1, 0.1), (0.3, 0.3), (0.7, 0.7)], [(0, 0), (2, 0), (2, 0), (2, 3), (0, 3)], [(0, 0), (2, 0), (0, 3), (2, 3)], [(0, 0), (float("nan"), 0), (2, 3)])]


def odd_column(seed):
    """Polygons, other kinds, and rings that are open, turned, short, flat or repeat points."""
    at = lambda v: v if not isinstance(v, list) else [{"x": float(p[0]), "y": float(p[1])} if isinstance(p, tuple) else at(p) for p in v]
    rows = [shapes.written(s.parts) for s in some(seed) if s is not None and s.dim == 2]
    return pa.array([*rows, *[v and {"kind": v["kind"], "parts": at(v["parts"])} for v in ODD], *rows[:3]], shapes.ARROW)


@pytest.mark.parametrize("seed", range(3))
def test_a_column_equals_its_shapes(seed):
    whole = odd_column(seed)
    for column in (whole, whole.slice(7, 48), whole.slice(0, 0), pa.chunked_array([whole.slice(0, 9), whole.slice(9)])):
        one, many_ = list(shapes.read(column)), shapes.Column(column)
        assert len(one) == len(many_)
        for k, (x, y) in enumerate(zip(one, many_)):
            assert (x is None) == (y is None)
            points = many_.points[many_.first[k] : many_.first[k + 1]]
            if x is None:
                assert not len(points) and many_.dim[k] == -1
            else:
                assert x.kind == y.kind and x.dim == many_.dim[k] and np.array_equal(x.points, points, equal_nan=True) and np.array_equal(x.sides, y.sides, equal_nan=True)
        assert np.array_equal(many.bounds(one), many.bounds(many_), equal_nan=True)
        assert np.array_equal(sjoin._upright(one), sjoin._upright(many_))
        assert np.array_equal(sjoin._single(one), sjoin._single(many_))
        f, g = many.Flat(one), many.Flat(many_)
        for name in ("size", "box", "sides", "part", "part_of", "count", "first", "plain"):
            assert np.array_equal(getattr(f, name), getattr(g, name), equal_nan=name != "plain"), name


def test_relations_of_columns_equal_those_of_one():
    box = lambda lo, hi: Shape("polygon", [[np.array([(lo, lo), (hi, lo), (hi, hi), (lo, hi)], float)]])
    sides = [[*(s for s in some(seed, 16) if s is not None and s.dim == 2 and s.parts), box(-1, 4), box(-9, 99), box(0, 6)] for seed in (0, 1)]
    columns = [pa.array([shapes.written(s.parts) for s in side], shapes.ARROW) for side in sides]
    i, j = every(*sides)
    one = [Relation(sides[0][x], sides[1][y]) for x, y in zip(i, j)]
    assert sum(x.holds("within") for x in one) > 20 < sum(x.holds("contains") for x in one)
    odd = [list(shapes.read(odd_column(seed))) for seed in (0, 1)]
    u, v = every(*odd)
    for predicate in RELATIONS:
        assert sjoin.Holds(predicate)(*map(shapes.Column, columns), i, j)[0].tolist() == [x.holds(predicate) for x in one]
    for predicate in ("overlaps", "crosses"):
        with np.errstate(all="ignore"):
            assert sjoin.Holds(predicate)(*(shapes.Column(odd_column(seed)) for seed in (0, 1)), u, v)[0].tolist() == sjoin.Holds(predicate)(*odd, u, v)[0].tolist()


def test_yards_of_a_column_are_not_taken_one_by_one(monkeypatch):
    """No shape is made of a yard, and a yard well inside a box is not cut."""
    ring = lambda x, y, *at: [{"x": x + 30 * u, "y": y + 12 * v} for u, v in at]
    two = [[[(0, 0), (1 / 3, 0), (1 / 3, 1), (0, 1)]], [[(2 / 3, 0), (1, 0), (1, 1), (2 / 3, 1)]]]
    spots = [(float(x), float(y)) for x in range(1, 400, 7) for y in range(1, 400, 11)]
    yards = pa.array([{"kind": "multipolygon", "parts": [[ring(x, y, *r) for r in p] for p in two]} for x, y in spots], shapes.ARROW)
    corners = [(x, y) for x in (0.0, 200.0) for y in (0.0, 200.0)]
    boxes = [Shape("polygon", [[np.array([(x, y), (x + 180, y), (x + 180, y + 180), (x, y + 180)])]]) for x, y in corners]
    inside = [any(a < x and x + 30 < a + 180 and b < y and y + 12 < b + 180 for a, b in corners) for x, y in spots]
    cut, split = [], many.Split.__init__
    monkeypatch.setattr(shapes, "Shape", None)
    monkeypatch.setattr(many.Split, "__init__", lambda self, a, b, i, j: cut.extend(i.tolist()) or split(self, a, b, i, j))
    table = type("Side", (), {"read": lambda self: (pa.table({"n": range(4)}), boxes, many.bounds(boxes))})()
    batch = pa.record_batch({"id": pa.array(range(len(spots))), "geom": yards})
    found = {p: {v["l"]["id"] for out in sjoin._against(table, sjoin.Holds(p), 0.0, True, shapes.TOLERANCE)(iter([batch])) for v in out.to_pylist()} for p in ("within", "overlaps")}
    assert found["within"] >= set(np.flatnonzero(inside).tolist()) and not found["overlaps"] & set(np.flatnonzero(inside).tolist())
    assert found["overlaps"] and cut and not np.array(inside)[cut].any()


def test_points_and_polygons_of_few_sides_go_together(monkeypatch):
    b = some(5)[:40]
    spots = [Shape("point", [[np.array([[x / 2, y / 2]])]]) for x in range(-1, 10) for y in range(-1, 10)]
    i, j = every(spots, b)
    want = {p: [Relation(spots[x], b[y]).holds(p) for x, y in zip(i, j)] for p in RELATIONS}
    monkeypatch.setattr(many, "TOGETHER", 3000)
    monkeypatch.setattr(shapes, "located", None)
    for predicate in RELATIONS:
        assert sjoin.Holds(predicate)(spots, b, i, j)[0].tolist() == want[predicate]
