"""Relations and overlays of two shapes, for any points, lines and polygons (several parts, holes, not convex).

Sides are cut where they meet the other shape's sides. A piece of a side then lies inside the other shape, outside it or on
its outline as a whole, and its middle tells which; from that follow the relations, and the outlines of overlays, whose
pieces are put together to rings. Used inside tasks, on one pair of shapes at a time, with arrays over their sides."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from geoanswers.operators import planar, sweep

IN, ON, OUT = 1, 0, -1
#: Relative size below which a distance is none.
TOLERANCE = 1e-12
#: Pairs of a point or side with a side, and sides of a shape, that are compared without an index.
FEW_PAIRS, FEW_SIDES = 1 << 14, 32

Rings = list[np.ndarray]
_DIMENSION = {"point": 0, "multipoint": 0, "linestring": 1, "multilinestring": 1, "polygon": 2, "multipolygon": 2}


def signed_area(ring: np.ndarray) -> float:
    x, y = ring[:, 0] - ring[0, 0], ring[:, 1] - ring[0, 1]
    return float((x[:-1] * y[1:] - x[1:] * y[:-1]).sum() / 2)


class Shape:
    """dim, parts (rings of vertices; polygons: closed, the inside to the left), sides, part_of (of each side), points."""

    def __init__(self, kind: str, parts: list[Rings]):
        self.kind, self.dim = kind, _DIMENSION[kind]
        if self.dim == 2:
            parts = [[_turned(_closed(r), k > 0) for k, r in enumerate(p) if len(r) > 2] for p in parts]
        self.parts = [p for p in parts if p]
        rings = [r for p in self.parts for r in p]
        self.points = np.concatenate(rings) if rings else np.zeros((0, 2))
        sides = [np.hstack([r[:-1], r[1:]]) for r in rings] if self.dim else []
        sides = np.concatenate(sides) if sides else np.zeros((0, 4))
        self.sides = sides[(sides[:, 0] != sides[:, 2]) | (sides[:, 1] != sides[:, 3])]
        self.index: tuple[float, sweep.Heights] | None = None

    def ends(self) -> set[tuple[float, float]]:
        """The end points of lines: those at which an odd number of lines ends."""
        odd: set[tuple[float, float]] = set()
        for line in (r for p in self.parts for r in p):
            if len(line) > 1 and self.dim == 1:
                odd ^= {tuple(line[0])}
                odd ^= {tuple(line[-1])}
        return odd

    def size(self) -> float:
        return float(np.abs(self.points).max(initial=0.0)) or 1.0


def _closed(ring: np.ndarray) -> np.ndarray:
    return ring if (ring[0] == ring[-1]).all() else np.vstack([ring, ring[:1]])


def _turned(ring: np.ndarray, hole: bool) -> np.ndarray:
    return ring[::-1] if (signed_area(ring) < 0) != hole else ring


def _cross(ax, ay, bx, by, cx, cy):
    return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)


def located(points: np.ndarray, shape: Shape) -> np.ndarray:
    """IN, ON or OUT of each point. The outline of a line is its ends."""
    if not len(points):
        return np.zeros(0, int)
    if shape.dim == 0 or not len(shape.sides):
        known = set(map(tuple, shape.points.tolist()))
        return np.array([IN if tuple(p) in known else OUT for p in points.tolist()])
    slack = TOLERANCE * max(shape.size(), float(np.abs(points).max()))
    on, odd = np.zeros(len(points), bool), np.zeros(len(points), np.int64)
    for i, j in _beside(points, shape, slack):
        x, y = points[i].T
        ax, ay, bx, by = shape.sides[j].T
        line = np.abs(_cross(ax, ay, bx, by, x, y)) <= slack * np.hypot(bx - ax, by - ay)
        line &= (x >= np.minimum(ax, bx) - slack) & (x <= np.maximum(ax, bx) + slack) & (y >= np.minimum(ay, by) - slack) & (y <= np.maximum(ay, by) + slack)
        on[i[line]] = True
        with np.errstate(divide="ignore", invalid="ignore"):
            crossed = ((ay > y) != (by > y)) & (x < (bx - ax) * (y - ay) / (by - ay) + ax)
        odd += np.bincount(i[crossed], minlength=len(points))
    if shape.dim == 1:
        ends = shape.ends()
        return np.where(on, [ON if tuple(p) in ends else IN for p in points], OUT)
    return np.where(on, ON, np.where(odd % 2 == 1, IN, OUT))


def crossed(points: np.ndarray, shape: Shape) -> np.ndarray:
    """How many sides a ray from each point to the right crosses, half open."""
    out = np.zeros(len(points), np.int64)
    for i, j in _beside(points, shape, 0.0):
        x, y = points[i].T
        ax, ay, bx, by = shape.sides[j].T
        with np.errstate(divide="ignore", invalid="ignore"):
            hit = ((ay > y) != (by > y)) & (x < (bx - ax) * (y - ay) / (by - ay) + ax)
        out += np.bincount(i[hit], minlength=len(points))
    return out


def _beside(points: np.ndarray, shape: Shape, slack: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (point, side) at the same height: all of them for few, else by the shape's index, which is kept."""
    n = len(shape.sides)
    if n * len(points) <= FEW_PAIRS or n <= FEW_SIDES:
        step = max(1, sweep.BLOCK // n)
        for lo in range(0, len(points), step):
            k = min(step, len(points) - lo)
            yield np.repeat(np.arange(lo, lo + k), n), np.tile(np.arange(n), k)
        return
    if shape.index is None or shape.index[0] < slack:
        shape.index = (slack, sweep.Heights(shape.sides, slack))
    yield from shape.index[1].near(points)


def _against(sides: np.ndarray, points: np.ndarray, scale: float) -> np.ndarray:
    """On which side of its line each point lies; 0 if on the line."""
    ax, ay, bx, by = sides.T
    far = _cross(ax, ay, bx, by, points[:, 0], points[:, 1])
    return np.where(np.abs(far) <= TOLERANCE * scale * np.hypot(bx - ax, by - ay), 0.0, far)


def _close(s: np.ndarray, t: np.ndarray, slack: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of places (of s, of t) of sides that may meet: all pairs of few sides, else those whose boxes meet."""
    if len(s) * len(t) <= FEW_PAIRS:
        if len(s) and len(t):
            yield np.repeat(np.arange(len(s)), len(t)), np.tile(np.arange(len(t)), len(s))
        return
    yield from sweep.meeting(sweep.boxes_of(s) + np.array([-slack, -slack, slack, slack]), sweep.boxes_of(t))


class Split:
    """The sides of a and b cut at each other: pieces (k x 4), codes (where the other shape has them) and, for those that
    run along a side of the other shape, whether in the same direction; and the points at which the shapes meet."""

    def __init__(self, a: Shape, b: Shape):
        s, t = a.sides, b.sides
        scale = max(a.size(), b.size())
        self.meets: set[tuple[float, float]] = set()
        cuts_a: dict[int, list] = defaultdict(list)
        cuts_b: dict[int, list] = defaultdict(list)
        shared_a: dict[int, list] = defaultdict(list)
        shared_b: dict[int, list] = defaultdict(list)

        def along(side, w):
            """Where w lies between the ends of a side: 0 to 1 from the first to the second."""
            dx, dy = side[2] - side[0], side[3] - side[1]
            return ((w[0] - side[0]) * dx + (w[1] - side[1]) * dy) / (dx * dx + dy * dy)

        for at, to in _close(s, t, TOLERANCE * scale):
            p, q = s[at], t[to]
            d1, d2, d3, d4 = (_against(u, w, scale) for u, w in ((p, q[:, :2]), (p, q[:, 2:]), (q, p[:, :2]), (q, p[:, 2:])))
            crossed = (d1 * d2 < 0) & (d3 * d4 < 0)
            r = d3[crossed] / (d3[crossed] - d4[crossed])
            spots = p[crossed, :2] + r[:, None] * (p[crossed, 2:] - p[crossed, :2])
            for i, j, spot in zip(at[crossed].tolist(), to[crossed].tolist(), map(tuple, spots.tolist())):
                self.meets.add(spot)
                cuts_a[i].append(spot)
                cuts_b[j].append(spot)
            for k in np.flatnonzero((d1 == 0) | (d2 == 0) | (d3 == 0) | (d4 == 0)).tolist():
                i, j = int(at[k]), int(to[k])
                on_a = [w for d, w in ((d1, t[j, :2]), (d2, t[j, 2:])) if d[k] == 0 and -1e-12 <= along(s[i], w) <= 1 + 1e-12]
                on_b = [w for d, w in ((d3, s[i, :2]), (d4, s[i, 2:])) if d[k] == 0 and -1e-12 <= along(t[j], w) <= 1 + 1e-12]
                for w in on_a:
                    cuts_a[i].append(tuple(w))
                for w in on_b:
                    cuts_b[j].append(tuple(w))
                self.meets.update(tuple(w) for w in on_a + on_b)
                if d1[k] == 0 and d2[k] == 0:
                    same = (s[i, 2:] - s[i, :2]) @ (t[j, 2:] - t[j, :2]) > 0
                    for side, other, into in ((s[i], t[j], shared_a[i]), (t[j], s[i], shared_b[j])):
                        lo, hi = sorted((along(side, other[:2]), along(side, other[2:])))
                        if min(hi, 1.0) - max(lo, 0.0) > 1e-12:
                            into.append((lo, hi, same))
        self.a, self.codes_a, self.same_a = self._pieces(s, cuts_a, shared_a, along, b)
        self.b, self.codes_b, self.same_b = self._pieces(t, cuts_b, shared_b, along, a)

    @staticmethod
    def _pieces(sides, cuts, shared, along, other: Shape):
        pieces, same, on = [], [], []
        for i, side in enumerate(sides):
            ends = [(0.0, (side[0], side[1])), (1.0, (side[2], side[3]))]
            stops = sorted([*ends, *((along(side, w), w) for w in cuts.get(i, ()))], key=lambda x: x[0])
            stops = [x for x in stops if 0.0 <= x[0] <= 1.0]
            for (t0, u), (t1, v) in zip(stops, stops[1:]):
                if t1 - t0 <= 1e-12 or tuple(u) == tuple(v):
                    continue
                middle = (t0 + t1) / 2
                runs = [x[2] for x in shared.get(i, ()) if x[0] <= middle <= x[1]]
                pieces.append((*u, *v))
                on.append(bool(runs))
                same.append(bool(runs) and bool(runs[0]))
        pieces = np.array(pieces).reshape(-1, 4)
        on = np.array(on, bool)
        codes = np.full(len(pieces), ON)
        if other.dim == 1:
            codes[~on] = OUT
        else:
            codes[~on] = located((pieces[~on, :2] + pieces[~on, 2:]) / 2, other)
        return pieces, codes, np.array(same, bool)


def inner_point(part: Rings) -> np.ndarray:
    """A point inside a part of a polygon, half way between two neighbouring heights of vertices (of the 32 pairs that are
    furthest apart, where the part is widest)."""
    heights = np.unique(np.concatenate([r[:, 1] for r in part]))
    best, width = part[0][:1].mean(axis=0), -1.0
    wide = np.argsort(heights[:-1] - heights[1:], kind="stable")[:32]
    for y in ((heights[wide] + heights[wide + 1]) / 2).tolist():
        xs = []
        for r in part:
            (x0, y0), (x1, y1) = r[:-1].T, r[1:].T
            at = (y0 > y) != (y1 > y)
            xs += (x0[at] + (y - y0[at]) / (y1[at] - y0[at]) * (x1[at] - x0[at])).tolist()
        xs.sort()
        for lo, hi in zip(xs[::2], xs[1::2]):
            if hi - lo > width:
                best, width = np.array([(lo + hi) / 2, y]), hi - lo
    return best


class Relation:
    """meets, inner (their insides share a point), a_out and b_out (a part lies outside the other), along (lines that share
    a stretch)."""

    def __init__(self, a: Shape, b: Shape):
        self.dims, self.along = (a.dim, b.dim), False
        if not len(a.points) or not len(b.points):
            self.meets = self.inner = False
            self.a_out = self.b_out = True
        elif a.dim == 0 or b.dim == 0:
            self._points(a, b)
        else:
            self._sides(a, b)

    def _points(self, a: Shape, b: Shape) -> None:
        low, high = (a, b) if a.dim == 0 else (b, a)
        codes = located(low.points, high)
        self.meets, self.inner = bool((codes != OUT).any()), bool((codes == IN).any())
        low_out = bool((codes == OUT).any())
        high_out = high.dim > 0 or bool((located(high.points, low) == OUT).any())
        self.a_out, self.b_out = (low_out, high_out) if low is a else (high_out, low_out)

    def _sides(self, a: Shape, b: Shape) -> None:
        s = Split(a, b)
        self.a_out, self.b_out = bool((s.codes_a == OUT).any()), bool((s.codes_b == OUT).any())
        if a.dim == 1 and b.dim == 1:
            self.along = bool((s.codes_a == ON).any())
            ends = a.ends() | b.ends()
            self.inner = self.along or any(p not in ends for p in s.meets)
            self.meets = bool(s.meets) or self.along
        elif a.dim == 1 or b.dim == 1:
            codes = s.codes_a if a.dim == 1 else s.codes_b
            self.inner = bool((codes == IN).any())
            self.meets = self.inner or bool(s.meets) or bool((codes == ON).any())
            if a.dim == 1:
                self.b_out = True
            else:
                self.a_out = True
        else:
            cut_a, cut_b = bool((s.codes_a == IN).any()), bool((s.codes_b == IN).any())
            # where no outline enters a part, the part is inside or outside as a whole
            parts_a = located(np.array([inner_point(p) for p in a.parts]), b)
            parts_b = located(np.array([inner_point(p) for p in b.parts]), a)
            self.inner = cut_a or cut_b or bool((parts_a == IN).any()) or bool((parts_b == IN).any())
            self.a_out = self.a_out or cut_b or bool((parts_a == OUT).any())
            self.b_out = self.b_out or cut_a or bool((parts_b == OUT).any())
            self.meets = self.inner or bool(s.meets) or bool((s.codes_a == ON).any())

    def holds(self, predicate: str) -> bool:
        low, high = self.dims
        if predicate == "intersects":
            return self.meets
        if predicate == "within":
            return self.inner and not self.a_out
        if predicate == "contains":
            return self.inner and not self.b_out
        if predicate == "equals":
            return low == high and self.inner and not self.a_out and not self.b_out
        if predicate == "touches":
            return self.meets and not self.inner
        if predicate == "overlaps":
            return low == high and self.inner and self.a_out and self.b_out and (low != 1 or self.along)
        if low == high:
            return low == 1 and self.inner and not self.along
        return self.inner and (self.a_out if low < high else self.b_out)


def distance(a: Shape, b: Shape) -> float:
    """Least distance; 0 where they meet, NaN where one is empty."""
    if not len(a.points) or not len(b.points):
        return math.nan
    if Relation(a, b).meets:
        return 0.0

    return min(_least(a.points, b), _least(b.points, a))


def _least(points: np.ndarray, shape: Shape, group: int = 64) -> float:
    """The least distance of any point to a shape. Points and sides stand in groups that follow each other on the outline; two
    groups are compared where their boxes are nearer than what was found so far, the nearest first."""
    sides = shape.sides if len(shape.sides) else np.hstack([shape.points, shape.points])
    if len(points) * len(sides) <= FEW_PAIRS:
        return _apart(np.repeat(points, len(sides), axis=0), np.tile(sides, (len(points), 1)))
    mine, other = np.arange(0, len(points), group), np.arange(0, len(sides), group)
    boxes = sweep.boxes_of(sides)
    p = np.concatenate([np.minimum.reduceat(points, mine), np.maximum.reduceat(points, mine)], axis=1)
    q = np.concatenate([np.minimum.reduceat(boxes[:, :2], other), np.maximum.reduceat(boxes[:, 2:], other)], axis=1)
    best, step = _apart(np.repeat(points[:1], len(sides), axis=0), sides), max(1, sweep.BLOCK // len(other))
    for lo in range(0, len(mine), step):
        part = p[lo : lo + step]
        gap = np.maximum(np.maximum(q[:, :2] - part[:, None, 2:], part[:, None, :2] - q[:, 2:]), 0)
        gap = np.hypot(gap[:, :, 0], gap[:, :, 1])
        at, of = np.nonzero(gap < best)
        order = np.argsort(gap[at, of], kind="stable")
        for some in np.split(order, range(8, len(order), 256)):
            some = some[gap[at[some], of[some]] < best]
            for i, j in zip((at[some] + lo).tolist(), of[some].tolist()):
                x, s = points[mine[i] : mine[i] + group], sides[other[j] : other[j] + group]
                best = min(best, _apart(np.repeat(x, len(s), axis=0), np.tile(s, (len(x), 1))))
    return best


def _apart(points: np.ndarray, sides: np.ndarray) -> float:
    """The least distance of a point to the side beside it."""
    along = sides[:, 2:] - sides[:, :2]
    size = (along * along).sum(axis=1)
    t = np.clip(((points - sides[:, :2]) * along).sum(axis=1) / np.where(size > 0, size, 1), 0, 1)
    return float(np.hypot(*(points - sides[:, :2] - t[:, None] * along).T).min())


# ---- overlays ----------------------------------------------------------------------------------------------------


def rings(edges: np.ndarray, scale: float, cuts: np.ndarray | None = None) -> list[np.ndarray] | None:
    """Rings of directed pieces with the inside to the left; at a point with several ways on, the leftmost, so that rings
    that touch stay apart. None where a ring does not close. ``cuts``: ends of pieces that are no vertices; where one piece goes
    on from another at such ends, the point is left out."""
    grid = scale * 1e-10
    _, name = np.unique(np.round(edges.reshape(-1, 2) / grid).astype(np.int64), axis=0, return_inverse=True)
    name = name.reshape(-1, 2)
    live = np.flatnonzero(name[:, 0] != name[:, 1])
    edges, name, cuts = edges[live], name[live], None if cuts is None else cuts[live]
    if not len(edges):
        return []
    n = int(name.max()) + 1
    if (np.bincount(name[:, 0], minlength=n) != np.bincount(name[:, 1], minlength=n)).any():
        return None
    angle = np.arctan2(edges[:, 3] - edges[:, 1], edges[:, 2] - edges[:, 0])
    order = np.argsort(name[:, 0], kind="stable")
    first = np.searchsorted(name[order, 0], np.arange(n + 1))
    follow = order[first[name[:, 1]]]
    many = np.flatnonzero(first[name[:, 1] + 1] - first[name[:, 1]] > 1)
    left: dict[int, list[int]] = {}
    for e in many.tolist():  # each way on is taken once
        at = int(name[e, 1])
        ways = left.setdefault(at, order[first[at] : first[at + 1]].tolist())
        back = angle[e] + math.pi
        best = min(ways, key=lambda k: (back - angle[k]) % (2 * math.pi) or 2 * math.pi)
        ways.remove(best)
        follow[e] = best
    follow, seen, found = follow.tolist(), np.zeros(len(edges), bool), []
    for e in range(len(edges)):
        if seen[e]:
            continue
        line = []
        while not seen[e]:
            seen[e] = True
            line.append(e)
            e = follow[e]
        line = np.array(line)
        if cuts is not None:
            line = line[~(cuts[line, 0] & cuts[np.roll(line, 1), 1])]
        if len(line) > 2:
            ring = np.vstack([edges[line, :2], edges[line[:1], :2]])
            found += [ring] if len(np.unique(name[line, 0])) == len(line) else _simple(ring, grid)
    return [r for r in found if signed_area(r)]


def _simple(ring: np.ndarray, grid: float) -> list[np.ndarray]:
    """A ring that passes a point twice, as rings that don't."""
    seen: dict[tuple, int] = {}
    out, line = [], []
    for p in ring:
        key = tuple(np.round(p / grid).astype(np.int64).tolist())
        if key in seen:
            at = seen[key]
            loop = line[at:]
            if len(loop) > 2:
                out.append(np.array([*loop, loop[0]]))
            for q in loop:
                seen.pop(tuple(np.round(q / grid).astype(np.int64).tolist()), None)
            line = line[:at]
        seen[key] = len(line)
        line.append(p)
    return [r for r in out if signed_area(r)]


def nested(found: list[np.ndarray]) -> list[Rings]:
    """Parts of rings: holes with the smallest outer ring around them."""
    outers = sorted((r for r in found if signed_area(r) > 0), key=signed_area)
    parts: list[Rings] = [[r] for r in outers]
    holes = [r for r in found if signed_area(r) < 0]
    at, size = np.array([inner_point([r]) for r in holes]).reshape(-1, 2), np.array([-signed_area(r) for r in holes])
    home, left = np.full(len(holes), -1), np.arange(len(holes))
    for k, outer in enumerate(outers):  # the smallest first, each with all holes that it may hold
        # a part that lies in the hole is smaller than it, and may be where the hole's point is
        near = ((at[left] >= outer.min(axis=0)) & (at[left] <= outer.max(axis=0))).all(axis=1) & (size[left] < signed_area(outer))
        if near.any():
            inside = left[near][located(at[left[near]], Shape("polygon", [[outer]])) == IN]
            home[inside] = k
            left = left[home[left] < 0]
    for hole, k in zip(holes, home.tolist()):
        if k >= 0:
            parts[k].append(hole)
    return parts


def overlay(a: Shape, b: Shape, kind: str) -> list[Rings] | None:
    """Parts of the intersection, difference (a without b) or union of two polygons; None where rounding leaves a ring
    open."""
    s = Split(a, b)
    same, against = s.same_a & (s.codes_a == ON), ~s.same_a & (s.codes_a == ON)
    if kind == "intersection":
        edges = [s.a[(s.codes_a == IN) | same], s.b[s.codes_b == IN]]
    elif kind == "difference":
        edges = [s.a[(s.codes_a == OUT) | against], s.b[s.codes_b == IN][:, [2, 3, 0, 1]]]
    else:
        edges = [s.a[(s.codes_a == OUT) | same], s.b[s.codes_b == OUT]]
    found = rings(np.concatenate(edges), max(a.size(), b.size()))
    return None if found is None else nested(found)


def united(shapes: list[Shape]) -> list[Rings] | None:
    """Parts of the union of polygons, two and two."""
    while len(shapes) > 1:
        merged = []
        for k in range(0, len(shapes) - 1, 2):
            parts = overlay(shapes[k], shapes[k + 1], "union")
            if parts is None:
                return None
            merged.append(Shape("multipolygon", parts))
        shapes = merged + shapes[len(shapes) - len(shapes) % 2 :]
    return shapes[0].parts if shapes else []


def cut(a: Shape, line: Shape) -> list[list[Rings]] | None:
    """The pieces of a polygon (each a list of parts) that the stretches of a line leave which go all the way through; one
    line of several after the other."""
    pieces = [a.parts]
    for part in line.parts:
        done = [_cut_once(Shape("multipolygon", p), Shape("linestring", [part])) for p in pieces]
        if any(d is None for d in done):
            return None
        pieces = [p for d in done for p in d]
    return pieces


def _cut_once(a: Shape, line: Shape) -> list[list[Rings]] | None:
    s = Split(a, line)
    inner = s.b[s.codes_b == IN]
    grid = max(a.size(), line.size()) * 1e-10
    key = lambda p: tuple(np.round(p / grid).astype(np.int64).tolist())
    fixed = {key(p) for p in s.a[:, :2]}
    while len(inner):  # loose ends cut nothing
        times: dict[tuple, int] = defaultdict(int)
        for e in inner:
            times[key(e[:2])] += 1
            times[key(e[2:])] += 1
        held = [all(times[k] > 1 or k in fixed for k in (key(e[:2]), key(e[2:]))) for e in inner]
        if all(held):
            break
        inner = inner[held]
    if not len(inner):
        return [a.parts]
    found = rings(np.concatenate([s.a, inner, inner[:, [2, 3, 0, 1]]]), max(a.size(), line.size()))
    return None if found is None else [[p] for p in nested(found)]


def grown(shape: Shape, reach: float, segments: int) -> list[Rings] | None:
    """A shape and all within ``reach`` of it; circles have 4 * segments sides."""
    around = lambda pts: np.array(planar.hull([q for x, y in pts for q in planar.circle(x, y, reach, segments)]))
    pieces = [Shape("polygon", [[around([(s[0], s[1]), (s[2], s[3])])]]) for s in shape.sides.tolist()]
    if not len(shape.sides):
        pieces = [Shape("polygon", [[around([p])]]) for p in shape.points.tolist()]
    if shape.dim == 2:
        pieces.append(shape)
    return united(pieces)


# ---- columns -----------------------------------------------------------------------------------------------------


def read(column: pa.Array) -> Iterator[Shape | None]:
    """The shapes of a column of geometry structs; None for null and unknown kinds."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kinds = column.field("kind").to_pylist()
    valid = column.is_valid().to_pylist()
    parts = column.field("parts")
    known = parts.is_valid().to_pylist()
    edges = parts.offsets.to_numpy()
    rings_ = parts.values
    ring_edges = rings_.offsets.to_numpy()
    lines = rings_.values
    line_edges = lines.offsets.to_numpy()
    xy = np.stack([lines.values.field("x").to_numpy(zero_copy_only=False), lines.values.field("y").to_numpy(zero_copy_only=False)], axis=1) if len(lines.values) else np.zeros((0, 2))
    for i, kind in enumerate(kinds):
        if not valid[i] or not known[i] or kind not in _DIMENSION:
            yield None
            continue
        shape = [[xy[line_edges[r] : line_edges[r + 1]] for r in range(ring_edges[p], ring_edges[p + 1])] for p in range(edges[i], edges[i + 1])]
        yield Shape(kind, shape)


class Column(Sequence):
    """The shapes of a column of geometry structs, as ``read`` gives them, with their rings as arrays: row, part and length of each
    ring, vertices of all rings (of polygons closed, the inside to the left), where the vertices of each row begin (first), and
    each row's dim (-1: none). A shape is made when it is asked for."""

    def __init__(self, column: pa.Array):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        self.kinds, parts = column.field("kind"), column.field("parts")
        known = pc.and_(column.is_valid(), parts.is_valid()).to_numpy(zero_copy_only=False)
        kind = pc.fill_null(pc.index_in(self.kinds, pa.array(list(_DIMENSION))), -1).to_numpy()
        self.dim = np.where(known, np.array([*_DIMENSION.values(), -1])[kind], -1)
        self.edges, self.ring_edges, self.line_edges = (x.offsets.to_numpy() for x in (parts, parts.values, parts.values.values))
        vertices = parts.values.values.values
        self.xy = np.stack([vertices.field(k).to_numpy(zero_copy_only=False) for k in "xy"], axis=1) if len(vertices) else np.zeros((0, 2))
        self.made: dict[int, Shape | None] = {}
        self.flat = self.upright = None  # kept by who works them out
        self._rings()

    def _rings(self) -> None:
        first, last = self.ring_edges[self.edges[:-1]].astype(np.int64), self.ring_edges[self.edges[1:]].astype(np.int64)
        row, ring = sweep.listed(first, np.where(self.dim < 0, first, last))
        begin = self.line_edges[ring].astype(np.int64)
        long, flat = self.line_edges[ring + 1] - begin, self.dim[row] == 2
        keep = long > np.where(flat, 2, 0)
        row, ring, begin, long, flat = row[keep], ring[keep], begin[keep], long[keep], flat[keep]
        part = np.searchsorted(self.ring_edges, ring, side="right") - 1
        hole = ring > self.ring_edges[part]
        n = long + (flat & (self.xy[begin] != self.xy[begin + long - 1]).any(axis=1))
        start = np.cumsum(n) - n
        of = np.repeat(np.arange(len(n)), n)
        place = np.arange(len(of)) - start[of]
        at = begin[of] + np.where(place == long[of], 0, place)
        with np.errstate(invalid="ignore", over="ignore"):
            x, y = (self.xy[at] - self.xy[begin[of]]).T
            step = np.append(x[:-1] * y[1:] - x[1:] * y[:-1], 0.0)[: len(x)]
            step[start + n - 1] = 0.0
            area, most = np.bincount(of, step, minlength=len(n)), np.bincount(of, np.abs(step), minlength=len(n))
            for k in np.flatnonzero(flat & ~(np.abs(area) > 1e-9 * most)).tolist():  # the order of the sum may tell
                area[k] = signed_area(self.xy[at[start[k] : start[k] + n[k]]])
        turned = (flat & ((area < 0) != hole))[of]
        self.points = self.xy[np.where(turned, at[(2 * start + n - 1)[of] - np.arange(len(of))], at)]
        self.row, self.part, self.long = row, part, n
        self.first = np.concatenate([[0], np.cumsum(np.bincount(row, n, minlength=len(self)).astype(np.int64))])

    def __len__(self) -> int:
        return len(self.dim)

    def __getitem__(self, k: int) -> Shape | None:
        k = range(len(self))[k]
        if k not in self.made:
            edges, lines = self.ring_edges, self.line_edges
            parts = [[self.xy[lines[r] : lines[r + 1]] for r in range(edges[p], edges[p + 1])] for p in range(self.edges[k], self.edges[k + 1])]
            self.made[k] = None if self.dim[k] < 0 else Shape(self.kinds[k].as_py(), parts)
        return self.made[k]


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vertices of all rings of a column of geometry structs, where the vertices of each ring begin and end, and the row of each
    ring. Rows without parts have none."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    parts = column.field("parts")
    rows = pc.list_parent_indices(parts).to_numpy()
    rings_ = parts.flatten()
    part_of = pc.list_parent_indices(rings_).to_numpy()
    lines = rings_.flatten()
    vertices = lines.flatten()
    xy = np.stack([vertices.field(k).to_numpy(zero_copy_only=False) for k in "xy"], axis=1)
    edges = np.concatenate([[0], np.cumsum(pc.list_value_length(lines).fill_null(0).to_numpy())])
    return xy, edges.astype(np.int64), rows[part_of]


def outlines(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sides of all polygons of a column of geometry structs, the inside to the left, and the row of each; none of other kinds."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    xy, edges, row = flat(column)
    rings_ = column.field("parts").flatten()
    part = pc.list_parent_indices(rings_).to_numpy()
    hole = np.concatenate([[False], part[1:] == part[:-1]])[: len(part)]
    polygon = pc.fill_null(pc.and_(column.is_valid(), pc.is_in(column.field("kind"), pa.array(["polygon", "multipolygon"]))), False).to_numpy(zero_copy_only=False)
    n = np.diff(edges)
    of = np.repeat(np.arange(len(n)), n)
    after = np.arange(1, len(xy) + 1)
    after[edges[1:][n > 0] - 1] = edges[:-1][n > 0]  # rings are closed; of those that are, this side has no length
    x, y = (xy - xy[edges[:-1][of]]).T
    area = np.bincount(of, x * y[after] - x[after] * y, minlength=len(n))
    keep = ((n > 2) & polygon[row])[of] & (xy != xy[after]).any(axis=1)
    a, b, turned = xy[keep], xy[after[keep]], ((area < 0) != hole)[of[keep], None]
    return np.hstack([np.where(turned, b, a), np.where(turned, a, b)]), row[of[keep]]


def dots(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are single points, and where those are."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pc.fill_null(pc.and_(column.is_valid(), pc.equal(column.field("kind"), "point")), False).to_numpy(zero_copy_only=False)
    xy, edges, row = flat(column)
    rings_of, vertices = np.bincount(row, minlength=len(column)), np.bincount(row, np.diff(edges), minlength=len(column))
    single = kind & (rings_of == 1) & (vertices == 1)
    return single, xy[edges[:-1][single[row]]]


def written(parts: list[Rings] | None) -> dict | None:
    """A polygon of these parts as a geometry value; null where there are none."""
    if not parts:
        return None
    ring = lambda r: [{"x": x, "y": y} for x, y in r.tolist()]
    return {"kind": "polygon" if len(parts) == 1 else "multipolygon", "parts": [[ring(r) for r in p] for p in parts]}


_VERTEX = pa.struct([("x", pa.float64()), ("y", pa.float64())])
ARROW = pa.struct([("kind", pa.string()), ("parts", pa.list_(pa.list_(pa.list_(_VERTEX))))])
