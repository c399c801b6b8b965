"""Relations and overlays of any shapes against sets of unit cells, and against sums of areas."""

import math
import random

import numpy as np
import pytest

from geoanswers.operators import shapes
from geoanswers.operators.shapes import Relation, Shape


def polygon(cells):
    """The polygon of a set of unit cells: sides that two cells share cancel."""
    sides = set()
    for x, y in cells:
        for s in ((x, y, x + 1, y), (x + 1, y, x + 1, y + 1), (x + 1, y + 1, x, y + 1), (x, y + 1, x, y)):
            back = (s[2], s[3], s[0], s[1])
            if back in sides:
                sides.remove(back)
            else:
                sides.add(s)
    parts = shapes.nested(shapes.rings(np.array(sorted(sides), float), 10.0))
    return Shape("multipolygon", parts)


def area(parts):
    return sum(shapes.signed_area(r) for p in parts for r in p)


def blob(r, n):
    cells = {(r.randrange(5), r.randrange(5))}
    for _ in range(n):
        x, y = r.choice(sorted(cells))
        cells.add((x + r.choice([-1, 0, 1]), y + r.choice([-1, 0, 1])))  # corners may touch, holes may form
    return cells


@pytest.mark.parametrize("seed", range(8))
def test_polygons_equal_sets_of_cells(seed):
    r = random.Random(seed)
    for _ in range(60):
        p = blob(r, r.randint(0, 14))
        q = r.choice([blob(r, r.randint(0, 14)), {c for c in p if r.random() < 0.7} or p, p])
        a, b = polygon(p), polygon(q)
        assert area(a.parts) == len(p)
        near = any(abs(x - u) <= 1 and abs(y - v) <= 1 for x, y in p for u, v in q)
        rel = Relation(a, b)
        assert (rel.meets, rel.inner) == (near, bool(p & q)) and (rel.a_out, rel.b_out) == (bool(p - q), bool(q - p))
        want = {
            "intersects": near, "within": p <= q, "contains": q <= p, "equals": p == q, "touches": near and not p & q,
            "overlaps": bool(p & q and p - q and q - p), "crosses": False,
        }
        assert {k: rel.holds(k) for k in want} == want
        for kind, cells in (("intersection", p & q), ("difference", p - q), ("union", p | q)):
            parts = shapes.overlay(a, b, kind)
            assert parts is not None and abs(area(parts) - len(cells)) < 1e-9
            if cells:
                assert not Relation(Shape("multipolygon", parts), polygon(cells)).a_out
        gap = min(math.hypot(max(abs(x - u) - 1, 0), max(abs(y - v) - 1, 0)) for x, y in p for u, v in q)
        assert abs(shapes.distance(a, b) - gap) < 1e-12


def star(r, x, y, n):
    turns = [2 * math.pi * (k + r.uniform(0, 0.4)) / n for k in range(n)]  # no gap of half a turn: no sides cross
    return np.array([(x + (d := r.uniform(0.2, 3)) * math.cos(t), y + d * math.sin(t)) for t in turns])


@pytest.mark.parametrize("seed", range(6))
def test_areas_of_overlays_add_up(seed):
    r = random.Random(100 + seed)
    for _ in range(40):
        a, b = (Shape("polygon", [[star(r, r.uniform(-2, 2), r.uniform(-2, 2), r.randint(3, 40))]]) for _ in "ab")
        both, rest, whole = (shapes.overlay(a, b, k) for k in ("intersection", "difference", "union"))
        assert None not in (both, rest, whole)
        assert abs(area(both) + area(rest) - area(a.parts)) < 1e-9 and abs(area(whole) - area(rest) - area(b.parts)) < 1e-9
        spots = np.array([(r.uniform(-5, 5), r.uniform(-5, 5)) for _ in range(200)])
        in_a, in_b = (shapes.located(spots, s) == shapes.IN for s in (a, b))
        for parts, want in ((both, in_a & in_b), (rest, in_a & ~in_b), (whole, in_a | in_b)):
            got = shapes.located(spots, Shape("multipolygon", parts)) == shapes.IN if parts else np.zeros(200, bool)
            assert (got == want).all()


def ring(*xy):
    return np.array([*xy, xy[0]], float)


U = Shape("polygon", [[ring((0, 0), (9, 0), (9, 9), (6, 9), (6, 3), (3, 3), (3, 9), (0, 9))]])


def box(x0, y0, x1, y1):
    return Shape("polygon", [[ring((x0, y0), (x1, y0), (x1, y1), (x0, y1))]])


def line(*xy):
    return Shape("linestring", [[np.array(xy, float)]])


def dots(*xy):
    return Shape("multipoint", [[np.array([p], float)] for p in xy])


@pytest.mark.parametrize(
    "a, b, true",
    [
        (box(4, 5, 5, 8), U, ""), (box(3, 3, 6, 9), U, "intersects touches"), (box(2, 5, 5, 8), U, "intersects overlaps"), (box(1, 1, 2, 8), U, "intersects within"),
        (dots((20, 20), (1, 1)), U, "intersects crosses"), (dots((20, 20), (30, 1)), U, ""), (dots((4, 4), (0, 0)), U, "intersects touches"), (dots((1, 1), (0, 0)), U, "intersects within"),
        (line((1, 8), (8, 8)), U, "intersects crosses"), (line((3, 5), (6, 5)), U, "intersects touches"), (line((0, 0), (9, 0)), U, "intersects touches"), (line((1, 1), (8, 1), (8, 8)), U, "intersects within"),
        (line((-1, 1), (-1, 5)), U, ""), (line((0, 0), (4, 4)), line((0, 4), (4, 0)), "intersects crosses"), (line((0, 0), (4, 0)), line((2, 0), (6, 0)), "intersects overlaps"),
        (line((0, 0), (4, 0)), line((4, 0), (4, 4)), "intersects touches"), (line((1, 0), (2, 0)), line((0, 0), (4, 0)), "intersects within"), (line((0, 0), (4, 0)), line((4, 0), (0, 0)), "intersects within contains equals"),
        (dots((1, 1)), dots((1, 1), (2, 2)), "intersects within"), (dots((1, 1), (3, 3)), dots((1, 1), (2, 2)), "intersects overlaps"), (dots((2, 0)), line((0, 0), (4, 0)), "intersects within"),
        (dots((0, 0)), line((0, 0), (4, 0)), "intersects touches"), (U, dots((1, 1)), "intersects contains"),
        (Shape("multipolygon", [[ring((20, 20), (21, 20), (21, 21))], [ring((1, 1), (2, 1), (2, 2))]]), U, "intersects overlaps"),
        (Shape("multipolygon", [[ring((4, 4), (5, 4), (5, 5))], [ring((1, 1), (2, 1), (2, 2))]]), box(0, 0, 9, 9), "intersects within"),
        (box(4, 4, 5, 5), Shape("polygon", [[ring((0, 0), (9, 0), (9, 9), (0, 9)), ring((3, 3), (6, 3), (6, 6), (3, 6))]]), ""),
        (box(3, 3, 6, 6), Shape("polygon", [[ring((0, 0), (9, 0), (9, 9), (0, 9)), ring((3, 3), (6, 3), (6, 6), (3, 6))]]), "intersects touches"),
        (box(0, 0, 9, 9), Shape("polygon", [[ring((0, 0), (9, 0), (9, 9), (0, 9)), ring((3, 3), (6, 3), (6, 6), (3, 6))]]), "intersects contains"),
    ],
)
def test_known_relations(a, b, true):
    names = ("intersects", "within", "contains", "equals", "touches", "overlaps", "crosses")
    assert {k for k in names if Relation(a, b).holds(k)} == set(true.split())
    turned = {"within": "contains", "contains": "within"}
    assert {turned.get(k, k) for k in names if Relation(b, a).holds(k)} == set(true.split())


def test_cuts_and_growth():
    pieces = shapes.cut(U, line((-1, 6), (10, 6)))
    assert sorted(area(p) for p in pieces) == [9, 9, 45] and len(shapes.cut(U, line((1, 1), (8, 1)))) == 1
    assert len(shapes.cut(box(0, 0, 4, 4), Shape("multilinestring", [[np.array([(-1.0, 2.0), (5.0, 2.0)])], [np.array([(2.0, 2.0), (2.0, 5.0)])]]))) == 3
    holed = Shape("polygon", [[ring((0, 0), (9, 0), (9, 9), (0, 9)), ring((3, 3), (6, 3), (6, 6), (3, 6))]])
    assert sorted(area(p) for p in shapes.cut(holed, line((-1, 4.5), (10, 4.5)))) == [36, 36]
    n = 64
    circle = 0.5 * 4 * n * math.sin(2 * math.pi / (4 * n))
    assert abs(area(shapes.grown(line((0, 0), (10, 0), (10, 10)), 1.0, n)) - (39 + 1.25 * circle)) < 1e-9
    big = Shape("multipolygon", shapes.grown(U, 0.5, 8))
    r = random.Random(3)
    spots = np.array([(r.uniform(-2, 11), r.uniform(-2, 11)) for _ in range(3000)])
    near = np.array([shapes.distance(Shape("point", [[p[None, :]]]), U) for p in spots])
    inside = shapes.located(spots, big) == shapes.IN
    assert inside[near < 0.49].all() and not inside[near > 0.5 + 1e-9].any()
