"""Many polygons of few sides at once: what ``shapes`` tells of one pair, and the rings it puts together, as arrays over a batch.

The rules are those of ``shapes.Split``, ``Relation``, ``overlay`` and ``rings``; what needs more than them (a point that
several rings pass, a hole that looks for its part) goes to those, one by one."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from geoanswers.operators import shapes, sweep
from geoanswers.operators.shapes import IN, ON, OUT, TOLERANCE

Shapes = list[shapes.Shape] | shapes.Column
#: Pairs of sides up to which a pair of shapes is taken together with others, and pairs of sides looked at together.
FEW, TOGETHER = 1 << 10, 1 << 18


def bounds(side: Shapes) -> np.ndarray:
    """x0, y0, x1, y1 of each shape; of those without points, inf, inf, -inf, -inf."""
    column = isinstance(side, shapes.Column)
    dots = np.diff(side.first) if column else np.array([0 if s is None else len(s.points) for s in side], np.int64)
    out = np.tile([np.inf, np.inf, -np.inf, -np.inf], (len(side), 1))
    if dots.any():
        xy, begin = side.points if column else np.concatenate([s.points for s in side if s is not None]), (np.cumsum(dots) - dots)[dots > 0]
        out[dots > 0] = np.hstack([np.minimum.reduceat(xy, begin), np.maximum.reduceat(xy, begin)])
    return out


class Flat:
    """A list of shapes as arrays: sides of all polygons one after the other, where those of each shape begin (first), each side's
    part (numbered over all shapes), each shape's size and bounds (box), and whether it is a polygon whose parts all have sides."""

    def __init__(self, side: Shapes):
        n, box = len(side), bounds(side)
        size = np.where(box[:, :1] <= box[:, 2:3], np.abs(box), np.where(np.isnan(box), np.nan, 0.0)).max(axis=1, initial=0.0)
        self.size, self.box = np.where(size == 0, 1.0, size), box
        if isinstance(side, shapes.Column):
            flat, ours = side.dim == 2, side.dim[side.row] == 2
            of, part, long, xy = side.row[ours], side.part[ours], side.long[ours], side.points[np.repeat(ours, side.long)]
        else:
            flat = [s is not None and s.dim == 2 for s in side]
            rings = [(k, p, len(r)) for k, s in enumerate(side) if flat[k] for p, part in enumerate(s.parts) for r in part]
            of, part, long = np.array(rings, np.int64).reshape(-1, 3).T
            xy = np.concatenate([s.points for s, yes in zip(side, flat) if yes] or [np.zeros((0, 2))])
        whole = np.ones(len(xy), bool)
        whole[np.cumsum(long) - 1] = False
        at = np.flatnonzero(whole)
        sides, ring = np.hstack([xy[at], xy[at + 1]]), np.repeat(np.arange(len(long)), long)[at]
        real = (sides[:, 0] != sides[:, 2]) | (sides[:, 1] != sides[:, 3])
        self.sides, ring = sides[real], ring[real]
        fresh = np.concatenate([[True], (of[1:] != of[:-1]) | (part[1:] != part[:-1])])[: len(of)]
        number = np.cumsum(fresh) - 1
        self.part, self.part_of = number[ring], of[fresh]
        self.count = np.bincount(of[ring], minlength=n)
        self.first = np.concatenate([[0], np.cumsum(self.count)])
        thin = np.bincount(self.part, minlength=len(self.part_of)) < 3
        self.plain = np.array(flat, bool) & (self.count > 0) & np.isfinite(self.size)
        self.plain[self.part_of[thin]] = False

    def taken(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sides of the shapes at these places: which place each is of, and which side."""
        found = list(sweep.runs(self.first[at], self.first[at + 1], max(1, len(self.sides) * len(at) + 1)))
        return found[0] if found else (np.zeros(0, np.int64),) * 2


def flat(side: Shapes, at: np.ndarray) -> tuple[Flat, np.ndarray]:
    """Those of the shapes that stand at these places (of a column: all, once), and the places among them."""
    if isinstance(side, shapes.Column):
        if side.flat is None:
            side.flat = Flat(side)
        return side.flat, at
    used, place = np.unique(at, return_inverse=True)
    return Flat([side[k] for k in used.tolist()]), place.reshape(-1)


def together(a: Flat, b: Flat, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, Iterator[np.ndarray]]:
    """Which of the pairs (a[i], b[j]) can be looked at together, and their places, some at a time."""
    work = a.count[i] * b.count[j]
    fit = a.plain[i] & b.plain[j] & (work <= FEW)
    at = np.flatnonzero(fit)
    block = np.cumsum(work[at]) // TOGETHER
    return fit, (at[some] for some in np.split(np.arange(len(at)), np.flatnonzero(np.diff(block)) + 1) if len(some))


def _along(side: np.ndarray, w: np.ndarray) -> np.ndarray:
    dx, dy = side[:, 2] - side[:, 0], side[:, 3] - side[:, 1]
    return ((w[:, 0] - side[:, 0]) * dx + (w[:, 1] - side[:, 1]) * dy) / (dx * dx + dy * dy)


def located(points: np.ndarray, pair: np.ndarray, sides: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """IN, ON or OUT of each point, of a pair, in the polygon whose sides are [first[pair], first[pair + 1])."""
    largest = size.copy()
    np.maximum.at(largest, pair, np.abs(points).max(axis=1, initial=0.0))
    slack_of = TOLERANCE * largest
    on, odd = np.zeros(len(points), bool), np.zeros(len(points), np.int64)
    for i, j in sweep.runs(first[pair], first[pair + 1]):
        x, y = points[i].T
        ax, ay, bx, by = sides[j].T
        slack = slack_of[pair[i]]
        line = np.abs(shapes._cross(ax, ay, bx, by, x, y)) <= slack * np.hypot(bx - ax, by - ay)
        line &= (x >= np.minimum(ax, bx) - slack) & (x <= np.maximum(ax, bx) + slack) & (y >= np.minimum(ay, by) - slack) & (y <= np.maximum(ay, by) + slack)
        on[i[line]] = True
        with np.errstate(divide="ignore", invalid="ignore"):
            crossed = ((ay > y) != (by > y)) & (x < (bx - ax) * (y - ay) / (by - ay) + ax)
        odd += np.bincount(i[crossed], minlength=len(points))
    return np.where(on, ON, np.where(odd % 2 == 1, IN, OUT))


def beside(points: np.ndarray, b: Flat, j: np.ndarray) -> tuple[np.ndarray, Iterator[np.ndarray]]:
    """Which of the pairs (points, b[j]) can be looked at together (of larger polygons, an index is better), and their places, some
    at a time."""
    fit = b.plain[j] & (b.count[j] <= shapes.FEW_SIDES) & np.isfinite(points).all(axis=1)
    at = np.flatnonzero(fit)
    block = np.cumsum(b.count[j[at]]) // TOGETHER
    return fit, (at[some] for some in np.split(np.arange(len(at)), np.flatnonzero(np.diff(block)) + 1) if len(some))


def in_polygons(points: np.ndarray, b: Flat, j: np.ndarray) -> np.ndarray:
    """IN, ON or OUT of each point in its polygon b[j]."""
    sides, first = b.sides[b.taken(j)[1]], np.concatenate([[0], np.cumsum(b.count[j])])
    return located(points, np.arange(len(j)), sides, first, b.size[j])


class Pieces:
    """Pieces of one shape of each pair: sides, pair, part, code (where the other shape has them), same (those along a side of the
    other shape: in the same direction)."""

    def __init__(self, sides: np.ndarray, pair: np.ndarray, part: np.ndarray, cuts: list[tuple], shared: list[tuple], other: np.ndarray, first: np.ndarray, size: np.ndarray):
        n = len(sides)
        side, t, spot = np.concatenate([np.arange(n), np.arange(n)]), np.repeat([0.0, 1.0], n), np.concatenate([sides[:, :2], sides[:, 2:]])
        turn = np.repeat([0, 1], n)
        for which, w, when in cuts:
            if len(which):
                side, spot = np.concatenate([side, which]), np.concatenate([spot, w])
                t, turn = np.concatenate([t, _along(sides[which], w)]), np.concatenate([turn, when + 2])
        inside = (t >= 0) & (t <= 1)
        side, t, spot, turn = side[inside], t[inside], spot[inside], turn[inside]
        order = np.lexsort((turn, t, side))
        side, t, spot = side[order], t[order], spot[order]
        k = np.flatnonzero((side[:-1] == side[1:]) & (t[1:] - t[:-1] > 1e-12) & (spot[:-1] != spot[1:]).any(axis=1))
        middle = (t[k] + t[k + 1]) / 2
        of = side[k]
        self.sides, self.pair, self.part = np.hstack([spot[k], spot[k + 1]]), pair[of], part[of]
        on, self.same = np.zeros(len(k), bool), np.zeros(len(k), bool)
        whose, low, high, same = (np.concatenate([s[x] for s in shared]) for x in range(4))
        order = np.argsort(whose, kind="stable")
        whose, low, high, same = whose[order], low[order], high[order], same[order]
        for p, e in sweep.runs(np.searchsorted(whose, of), np.searchsorted(whose, of, side="right")):
            hit = (low[e] <= middle[p]) & (middle[p] <= high[e])
            p, e = p[hit], e[hit]
            begin = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]])[: len(p)])
            on[p[begin]], self.same[p[begin]] = True, same[e[begin]]
        self.code = np.full(len(k), ON)
        free = ~on
        self.code[free] = located((self.sides[free, :2] + self.sides[free, 2:]) / 2, self.pair[free], other, first, size)


class Split:
    """The polygons of pairs (a[i], b[j]) cut at each other: pieces of the first and of the second ones; ``met``: whether their outlines
    meet at a point."""

    def __init__(self, a: Flat, b: Flat, i: np.ndarray, j: np.ndarray):
        n = len(i)
        pair_s, of_s = a.taken(i)
        pair_t, of_t = b.taken(j)
        s, t = a.sides[of_s], b.sides[of_t]
        first_s, first_t = (np.concatenate([[0], np.cumsum(f.count[k])]) for f, k in ((a, i), (b, j)))
        self.n, self.scale = n, np.maximum(a.size[i], b.size[j])
        met = np.zeros(n, bool)
        cuts_s, cuts_t, shared_s, shared_t = [], [], [], []
        for at, to in [*sweep.runs(first_t[pair_s], first_t[pair_s + 1], 2 * (TOGETHER + FEW))] or [(np.zeros(0, np.int64),) * 2]:
            p, q, scale = s[at], t[to], self.scale[pair_s[at]]
            near = 4 * TOLERANCE * scale
            near = (np.minimum(p[:, 0], p[:, 2]) - near <= np.maximum(q[:, 0], q[:, 2])) & (np.minimum(q[:, 0], q[:, 2]) <= np.maximum(p[:, 0], p[:, 2]) + near) & (
                np.minimum(p[:, 1], p[:, 3]) - near <= np.maximum(q[:, 1], q[:, 3])
            ) & (np.minimum(q[:, 1], q[:, 3]) <= np.maximum(p[:, 1], p[:, 3]) + near)
            at, to, p, q, scale = at[near], to[near], p[near], q[near], scale[near]
            d1, d2, d3, d4 = (shapes._against(u, w, scale) for u, w in ((p, q[:, :2]), (p, q[:, 2:]), (q, p[:, :2]), (q, p[:, 2:])))
            crossed = np.flatnonzero((d1 * d2 < 0) & (d3 * d4 < 0))
            r = d3[crossed] / (d3[crossed] - d4[crossed])
            spot = p[crossed, :2] + r[:, None] * (p[crossed, 2:] - p[crossed, :2])
            met[pair_s[at[crossed]]] = True
            # the order in which cuts at one place were found: crossings, then touches
            late = 3 * (TOGETHER + FEW)
            cuts_s.append((at[crossed], spot, crossed)), cuts_t.append((to[crossed], spot, crossed))
            for d, side, whole, w, cuts, second in ((d1, at, p, q[:, :2], cuts_s, 0), (d2, at, p, q[:, 2:], cuts_s, 1), (d3, to, q, p[:, :2], cuts_t, 0), (d4, to, q, p[:, 2:], cuts_t, 1)):
                k = np.flatnonzero(d == 0)
                along = _along(whole[k], w[k])
                k = k[(along >= -1e-12) & (along <= 1 + 1e-12)]
                cuts.append((side[k], w[k], late + 2 * k + second))
                met[pair_s[at[k]]] = True
            k = np.flatnonzero((d1 == 0) & (d2 == 0))
            same = ((p[k, 2:] - p[k, :2]) * (q[k, 2:] - q[k, :2])).sum(axis=1) > 0
            for side, mine, other, shared in ((at, p[k], q[k], shared_s), (to, q[k], p[k], shared_t)):
                u, v = _along(mine, other[:, :2]), _along(mine, other[:, 2:])
                low, high = np.minimum(u, v), np.maximum(u, v)
                some = np.minimum(high, 1.0) - np.maximum(low, 0.0) > 1e-12
                shared.append((side[k[some]], low[some], high[some], same[some]))
        self.met = met
        self.a = Pieces(s, pair_s, a.part[of_s], cuts_s, shared_s, t, first_t, b.size[j])
        self.b = Pieces(t, pair_t, b.part[of_t], cuts_t, shared_t, s, first_s, a.size[i])

    def any(self, pieces: Pieces, which: np.ndarray) -> np.ndarray:
        """Of each pair, whether it has such a piece."""
        return np.bincount(pieces.pair[which], minlength=self.n) > 0


def related(a: Flat, b: Flat, i: np.ndarray, j: np.ndarray, predicate: str) -> tuple[np.ndarray, np.ndarray]:
    """Whether each pair is in the relation, and whether that is sure.

    Where no outline enters a shape's inside, its parts are inside or outside of the other one as wholes. A part with a piece off
    the other's outline is where that piece is; of one that runs along it all the way, the direction tells."""
    s = Split(a, b, i, j)
    cut_a, cut_b = s.any(s.a, s.a.code == IN), s.any(s.b, s.b.code == IN)
    out_a, out_b = s.any(s.a, s.a.code == OUT), s.any(s.b, s.b.code == OUT)
    inner, sure, out = cut_a | cut_b, np.ones(s.n, bool), []
    for pieces in (s.a, s.b):
        part = np.stack([pieces.pair, pieces.part], axis=1)
        begin = np.flatnonzero(np.concatenate([[True], (part[1:] != part[:-1]).any(axis=1)])[: len(part)])
        pair = pieces.pair[begin]
        if not len(begin):
            out.append(np.zeros(s.n, bool))
            continue
        on, same, against = (np.logical_and.reduceat(v, begin) for v in (pieces.code == ON, pieces.same, ~pieces.same))
        inner |= np.bincount(pair[on & same], minlength=s.n) > 0
        out.append(np.bincount(pair[on & against], minlength=s.n) > 0)
        sure[pair[on & ~same & ~against]] = False
    a_out, b_out = out_a | cut_b | out[0], out_b | cut_a | out[1]
    meets = inner | s.met | s.any(s.a, s.a.code == ON)
    found = {"intersects": meets, "within": inner & ~a_out, "contains": inner & ~b_out, "equals": inner & ~a_out & ~b_out, "touches": meets & ~inner, "overlaps": inner & a_out & b_out}
    return found.get(predicate, np.zeros(s.n, bool)), sure


# ---- rings -------------------------------------------------------------------------------------------------------


class Rings:
    """Rings of directed pieces with the inside to the left, by key (a number below n): vertices of all rings (closed), and of each
    ring its length, key, part and area. ``open``: keys of which a ring does not close; these have none."""

    def __init__(self, edges: np.ndarray, key: np.ndarray, n: int, scale: np.ndarray, cuts: np.ndarray | None = None):
        self.n, self.open = n, np.zeros(n, bool)
        spots = np.round(edges.reshape(-1, 2) / (np.repeat(scale[key], 2) * 1e-10)[:, None]).astype(np.int64)
        twice = np.repeat(key, 2)
        order = np.lexsort((spots[:, 1], spots[:, 0], twice))
        fresh = np.concatenate([[True], (spots[order[1:]] != spots[order[:-1]]).any(axis=1) | (twice[order[1:]] != twice[order[:-1]])])[: len(order)]
        name = np.zeros(len(order), np.int64)
        name[order] = np.cumsum(fresh) - 1
        name = name.reshape(-1, 2)
        live = np.flatnonzero(name[:, 0] != name[:, 1])
        edges, key, name, cuts = edges[live], key[live], name[live], None if cuts is None else cuts[live]
        nodes = int(name.max()) + 1 if len(name) else 0
        begins, ends = np.bincount(name[:, 0], minlength=nodes), np.bincount(name[:, 1], minlength=nodes)
        self.open[key[(begins != ends)[name[:, 0]] | (begins != ends)[name[:, 1]]]] = True
        odd = self.open.copy()
        odd[key[begins[name[:, 0]] > 1]] = True
        keep = np.flatnonzero(~odd[key])
        xy, long, of, area = self._plain(edges[keep], key[keep], name[keep], None if cuts is None else cuts[keep], nodes)
        # several ways on, or holes: one by one
        rest = odd & ~self.open
        holes = np.zeros(n, bool)
        holes[of[area < 0]] = True
        order = np.lexsort((area, of))
        order = order[~holes[of[order]]]
        begin = np.cumsum(long) - long
        at = np.concatenate([r for r in [np.zeros(0, np.int64), *self._ranges(begin[order], long[order])]])
        first = np.concatenate([[0], np.flatnonzero(np.diff(of[order])) + 1])[: len(order)]
        part = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
        table = [xy[at], long[order], of[order], part, area[order]]
        more: list[tuple] = []
        by_key, ring_of = np.argsort(key, kind="stable"), np.argsort(of, kind="stable")
        bounds, rings_from = np.searchsorted(key[by_key], np.arange(n + 1)), np.searchsorted(of[ring_of], np.arange(n + 1))
        for k in np.flatnonzero(rest | holes).tolist():
            if rest[k]:
                these = by_key[bounds[k] : bounds[k + 1]]
                found = shapes.rings(edges[these], float(scale[k]), None if cuts is None else cuts[these])
                if found is None:
                    self.open[k] = True
                    continue
            else:
                found = [xy[begin[r] : begin[r] + long[r]] for r in ring_of[rings_from[k] : rings_from[k + 1]].tolist()]
            more += [(ring, k, p, shapes.signed_area(ring)) for p, rings in enumerate(shapes.nested(found)) for ring in rings]
        if more:
            extra = [np.concatenate([r[0] for r in more]), *(np.array(v) for v in ([len(r[0]) for r in more], [r[1] for r in more], [r[2] for r in more], [r[3] for r in more]))]
            table = [np.concatenate([u, v]) for u, v in zip(table, extra)]
            xy, long, of, part, area = table
            begin, order = np.cumsum(long) - long, np.lexsort((part, of))
            at = np.concatenate([*self._ranges(begin[order], long[order])])
            table = [xy[at], long[order], of[order], part[order], area[order]]
        self.xy, self.long, self.key, self.part, self.area = table

    @staticmethod
    def _ranges(first: np.ndarray, long: np.ndarray) -> Iterator[np.ndarray]:
        yield from (member for _, member in sweep.runs(first, first + long))

    @staticmethod
    def _plain(edges: np.ndarray, key: np.ndarray, name: np.ndarray, cuts: np.ndarray | None, nodes: int) -> tuple:
        """Rings where every point has one way on, in the order of their first pieces: vertices, length, key, area."""
        e = len(edges)
        if not e:
            return np.zeros((0, 2)), *(np.zeros(0, np.int64) for _ in range(2)), np.zeros(0)
        leaves = np.zeros(nodes, np.int64)
        leaves[name[:, 0]] = np.arange(e)
        follow = leaves[name[:, 1]]
        head, jump = np.arange(e), follow
        while (head != head[follow]).any():  # the first piece of each ring, by doubling
            head, jump = np.minimum(head, head[jump]), jump[jump]
        jump, left = np.where(follow == head, np.arange(e), follow), np.where(follow == head, 0, 1)
        while (jump != jump[jump]).any():  # how many pieces follow
            left, jump = left + left[jump], jump[jump]
        if cuts is not None:
            before = np.zeros(e, np.int64)
            before[follow] = np.arange(e)
            real = ~(cuts[:, 0] & cuts[before, 1])
        else:
            real = np.ones(e, bool)
        order = np.lexsort((-left, head))
        order = order[real[order]]
        head = head[order]
        begin = np.flatnonzero(np.concatenate([[True], head[1:] != head[:-1]])[: len(head)])
        long = np.diff(np.append(begin, len(head)))
        # every ring ends where it began
        line = np.insert(order, begin + long, order[begin]) if len(begin) else order
        xy, of = edges[line, :2], np.repeat(np.arange(len(long)), long + 1)
        long = long + 1
        first = np.cumsum(long) - long
        x, y = (xy - xy[first[of]]).T
        step = np.append(x[:-1] * y[1:] - x[1:] * y[:-1], 0.0) if len(x) else x
        step[np.cumsum(long) - 1] = 0.0
        area = np.bincount(of, step, minlength=len(long)) / 2
        good = (long > 3) & (area != 0)
        return xy[good[of]], long[good], key[order[begin]][good], area[good]

    def shapes(self, keys: np.ndarray) -> pa.StructArray:
        """The polygons of these keys (in rising order) as geometry values; null for those without rings."""
        at = np.concatenate([np.zeros(0, np.int64), *self._ranges(np.searchsorted(self.key, keys), np.bincount(self.key, minlength=self.n)[keys])])
        fresh = np.concatenate([[True], (self.key[at][1:] != self.key[at][:-1]) | (self.part[at][1:] != self.part[at][:-1])])[: len(at)]
        parts = np.bincount(self.key[at][fresh], minlength=self.n)[keys]
        return _written(self, at, np.flatnonzero(fresh), parts)

    def parts(self) -> tuple[np.ndarray, np.ndarray, pa.StructArray]:
        """The key and number of each part, and the part as a polygon."""
        fresh = np.flatnonzero(np.concatenate([[True], (self.key[1:] != self.key[:-1]) | (self.part[1:] != self.part[:-1])])[: len(self.key)])
        return self.key[fresh], self.part[fresh], _written(self, np.arange(len(self.key)), fresh, np.ones(len(fresh), np.int64))


def _written(rings: Rings, at: np.ndarray, fresh: np.ndarray, parts: np.ndarray) -> pa.StructArray:
    """Geometry values of these rings; fresh: those that begin a part; parts: of each value."""
    edges = lambda n: pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
    begin = np.cumsum(rings.long) - rings.long
    dots = np.concatenate([np.zeros(0, np.int64), *Rings._ranges(begin[at], rings.long[at])])
    vertices = pa.StructArray.from_arrays([pa.array(rings.xy[dots, 0]), pa.array(rings.xy[dots, 1])], fields=list(shapes._VERTEX))
    lines = pa.ListArray.from_arrays(edges(rings.long[at]), vertices)
    whole = pa.ListArray.from_arrays(edges(np.diff(np.append(fresh, len(at)))), lines)
    kinds = pa.array(np.where(parts == 1, "polygon", "multipolygon").tolist(), pa.string())
    return pa.StructArray.from_arrays([kinds, pa.ListArray.from_arrays(edges(parts), whole)], fields=list(shapes.ARROW), mask=pa.array(parts == 0))


def shared(a: Flat, b: Flat, i: np.ndarray, j: np.ndarray) -> Rings:
    """The intersection of each pair of polygons."""
    s = Split(a, b, i, j)
    of_a, of_b = (s.a.code == IN) | (s.a.same & (s.a.code == ON)), s.b.code == IN
    return Rings(np.concatenate([s.a.sides[of_a], s.b.sides[of_b]]), np.concatenate([s.a.pair[of_a], s.b.pair[of_b]]), s.n, s.scale)
