"""Dissolve: the union of the polygons of each group, whether they overlap, touch along parts of sides or only share corners.

Polygons are taken as sides with the inside to the left, and never as wholes. Equal sides are counted against each other
in a combinable sum; those that cancel change no winding number and go. What is left is cut at the lines of a grid. Within a
cell of the grid, sides are cut where they meet each other; how often the group covers the ground beside each piece follows
from the winding number at the cell's lower left corner and the pieces that lie between. The winding numbers of corners are
running sums along a row of cells, of how the sides cross the row's lower line. A piece is outline where one side of it is
covered and the other one is not.

Where members lie on each other many times over, cells are quartered first, and quarters that the winding numbers show to be
covered all over go, so that only what is near the outline is cut.

So a group, or a polygon, of any size is spread over cells; only the outline of a group meets in one task, to become a shape."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoanswers.functions import geom
from geoanswers.operators import many, shapes, sweep
from geoanswers.sources.tables import stored

#: Sides in a cell of the grid, on average; sides that are looked at together.
PER_CELL, TOGETHER = 4_000, 50_000
#: Sides that are cut at each other without a look at quarters of their cell; how often a cell is quartered at most.
FEW, DEEP = 8, 8
#: Relative size below which two nodes are one. No round number, so that coordinates don't lie on the edges of rounding.
SNAP = 1.0947e-10
_ENDS, _GRID = ["x1", "y1", "x2", "y2"], ["ox", "oy", "size"]


def _schema(group: T.StructField, *more: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([group, *[T.StructField(k, T.DoubleType()) for k in _ENDS], *[T.StructField(n, t) for n, t in more]])


def _sides(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All sides, the lesser end first, with weight 1 where the inside is to the left and -1 where it is to the right: w of
    shapes, v of those that are taken away."""
    for batch in batches:
        s, at = shapes.outlines(batch.column("geom"))
        forward = (s[:, 0] < s[:, 2]) | ((s[:, 0] == s[:, 2]) & (s[:, 1] < s[:, 3]))
        turned = np.where(forward[:, None], s, s[:, [2, 3, 0, 1]])
        weight, away = np.where(forward, 1, -1), batch.column("away").to_numpy(zero_copy_only=False).astype(bool)[at]
        columns = [batch.column("group").take(pa.array(at)), *[pa.array(turned[:, k]) for k in range(4)], pa.array(np.where(away, 0, weight)), pa.array(np.where(away, weight, 0))]
        yield pa.RecordBatch.from_arrays(columns, names=["group", *_ENDS, "w", "v"])


# ---- the grid --------------------------------------------------------------------------------------------------


def _split(s: np.ndarray, lines: list[tuple[int, np.ndarray, np.ndarray]], cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sides cut at lines (axis, sides, where each of these is cut): pieces, the side each is of, and which of their ends are cuts
    (cuts: those of the sides already)."""
    n = np.arange(len(s))
    at, t, p = [n, n], [np.zeros(len(s)), np.ones(len(s))], [s[:, :2], s[:, 2:]]
    for axis, i, where in lines:
        part = (where - s[i, axis]) / (s[i, 2 + axis] - s[i, axis])
        inside = (part > 0) & (part < 1)
        i, where, part = i[inside], where[inside], part[inside]
        spot = s[i, :2] + part[:, None] * (s[i, 2:] - s[i, :2])
        spot[:, axis] = where
        at.append(i), t.append(part), p.append(spot)
    ends = np.concatenate([cuts[:, 0], cuts[:, 1], np.ones(sum(map(len, at)) - 2 * len(s), bool)])
    at, t, p = np.concatenate(at), np.concatenate(t), np.concatenate(p)
    order = np.lexsort((t, at))
    at, p, ends = at[order], p[order], ends[order]
    i = np.flatnonzero((at[:-1] == at[1:]) & (p[:-1] != p[1:]).any(axis=1))
    return np.hstack([p[i], p[i + 1]]), at[i], np.stack([ends[i], ends[i + 1]], axis=1)


def _gridded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sides cut at the lines of their grid (ox, oy, size): pieces with their cell, and which of their ends are such cuts."""
    for batch in batches:
        origin = [batch.column(k).to_numpy() for k in ("ox", "oy")]
        size = batch.column("size").to_numpy()
        s = np.stack([batch.column(k).to_numpy() for k in _ENDS], axis=1)
        lines = []
        for axis, o in enumerate(origin):
            a, b = s[:, axis], s[:, 2 + axis]
            first, last = np.floor((np.minimum(a, b) - o) / size).astype(np.int64) + 1, np.ceil((np.maximum(a, b) - o) / size).astype(np.int64)
            lines += [(axis, i, o[i] + line * size[i]) for i, line in sweep.runs(first, last)]
        pieces, at, cuts = _split(s, lines, np.zeros((len(s), 2), bool))
        of = pa.array(at)
        cell = [np.floor(((pieces[:, k] + pieces[:, 2 + k]) / 2 - o[at]) / size[at]).astype(np.int64) for k, o in enumerate(origin)]
        columns = [batch.column("group").take(of), *[pa.array(pieces[:, k]) for k in range(4)], batch.column("w").take(of), batch.column("v").take(of)]
        columns += [pa.array(cell[0]), pa.array(cell[1]), pa.array(cuts[:, 0]), pa.array(cuts[:, 1]), *[batch.column(k).take(of) for k in _GRID]]
        yield pa.RecordBatch.from_arrays(columns, names=["group", *_ENDS, "w", "v", "ix", "iy", "cut1", "cut2", *_GRID])


# ---- within cells ----------------------------------------------------------------------------------------------


def _nodes(points: np.ndarray, grid: float) -> np.ndarray:
    """The same number for points that are one."""
    return _rows(*np.round(points / grid).astype(np.int64).T)[1]


def _rows(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows of numbers, each once and in order: where it first stands; and which of them each row is."""
    order = np.lexsort(columns[::-1])
    fresh = np.ones(len(order), bool)
    fresh[1:] = np.any([c[order[1:]] != c[order[:-1]] for c in columns], axis=0)
    name = np.zeros(len(order), np.int64)
    name[order] = np.cumsum(fresh) - 1
    return order[fresh], name


def noded(s: np.ndarray, key: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sides cut wherever one of the same key meets them: pieces, the side each is of, and whether it has that side's first
    and last end."""
    slack = shapes.TOLERANCE * scale
    box = sweep.boxes_of(s) + np.array([-slack, -slack, slack, slack])
    n = np.arange(len(s))
    at, t, p = [n, n], [np.zeros(len(s)), np.ones(len(s))], [s[:, :2], s[:, 2:]]

    def cut(side: np.ndarray, spot: np.ndarray) -> None:
        d = s[side, 2:] - s[side, :2]
        part = ((spot - s[side, :2]) * d).sum(axis=1) / (d * d).sum(axis=1)
        inside = (part > 0) & (part < 1)
        at.append(side[inside]), t.append(part[inside]), p.append(spot[inside])

    for i, j in sweep.meeting(box, box, (key, key)):
        i, j = i[i < j], j[i < j]
        a, b = s[i], s[j]
        d1, d2, d3, d4 = (shapes._against(u, w, scale) for u, w in ((a, b[:, :2]), (a, b[:, 2:]), (b, a[:, :2]), (b, a[:, 2:])))
        crossed = (d1 * d2 < 0) & (d3 * d4 < 0)
        r = d3[crossed] / (d3[crossed] - d4[crossed])
        spot = a[crossed, :2] + r[:, None] * (a[crossed, 2:] - a[crossed, :2])
        cut(i[crossed], spot), cut(j[crossed], spot)
        for d, side, w in ((d1, i, b[:, :2]), (d2, i, b[:, 2:]), (d3, j, a[:, :2]), (d4, j, a[:, 2:])):
            cut(side[d == 0], w[d == 0])
    at, t, p = np.concatenate(at), np.concatenate(t), np.concatenate(p)
    order = np.lexsort((t, at))
    at, t, p = at[order], t[order], p[order]
    i = np.flatnonzero(at[:-1] == at[1:])
    return np.hstack([p[i], p[i + 1]]), at[i], t[i] == 0, t[i + 1] == 1


def _settled(pieces: np.ndarray, corner: np.ndarray, scale: float) -> np.ndarray:
    """Coordinates that differ by rounding made equal, axis by axis, so that level pieces stay level and what ends on one of them
    ends at its height. The left and lower line of a piece's cell (corner) stay as they are."""
    out = pieces.copy()
    for axis in (0, 1):
        v = pieces[:, [axis, 2 + axis]]
        known, at = np.unique(v, return_inverse=True)
        begin = np.concatenate([[True], np.diff(known) > shapes.TOLERANCE * scale])[: len(known)]
        one = known[begin][np.cumsum(begin) - 1][at.reshape(v.shape)]
        out[:, [axis, 2 + axis]] = np.where(v == corner[:, axis, None], v, one)
    return out


def _sums(key: np.ndarray, what: np.ndarray, n: int) -> np.ndarray:
    """Sums by key of two columns of whole numbers."""
    return np.stack([np.bincount(key, what[:, k], minlength=n) for k in (0, 1)], axis=1).round().astype(np.int64)


def thinned(s: np.ndarray, w: np.ndarray, key: np.ndarray, corner: np.ndarray, base: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Cells as ``outline`` takes them, in order of their keys. Those whose sides cross each other more often than there are sides are
    quartered, and quarters of them again; where the winding numbers at the corner and all sides' weights leave no other choice
    than that all or nothing is covered, there is no outline, and the cell goes. Comes back with the cell each is of."""
    of, kept = np.arange(len(corner)), []
    for deep in range(DEEP + 1):
        n, d, first = len(corner), s[:, 2:] - s[:, :2], np.searchsorted(key, np.arange(len(corner)))
        # a way up and to the right from the corner meets every side once at most: into the inside, out of it, or either
        into, out = ((d[:, 0] > 0) & (d[:, 1] <= 0))[:, None], ((d[:, 0] == 0) & (d[:, 1] > 0))[:, None]
        more = np.where(into, w, np.where(out, -w, np.abs(w)))
        less = np.where(into | out, -more, more)
        high, low = base + _sums(key, np.maximum(more, 0), n), base - _sums(key, np.maximum(less, 0), n)
        alike = ((low[:, 0] > 0) & (high[:, 1] <= 0)) | (high[:, 0] <= 0) | (low[:, 1] > 0)
        # sides along the cell's own lines have ground beside them that isn't the cell's
        runs_along = lambda line: np.bincount(key, ((d == 0) & (s[:, :2] == line[key])).any(axis=1), minlength=n) > 0
        own = runs_along(corner)
        lo, hi = np.minimum.reduceat(np.minimum(s[:, :2], s[:, 2:]), first), np.maximum.reduceat(np.maximum(s[:, :2], s[:, 2:]), first)
        long, count = np.add.reduceat(np.abs(d), first), np.bincount(key, minlength=n)
        line = lo + 0.48713 * (hi - lo)  # where coordinates are not likely to lie
        crossed = (count > FEW) & (long.prod(axis=1) > count * (hi - lo).prod(axis=1)) & (deep < DEEP)
        gone = alike & ~own
        split = crossed & ~gone & ~own & ~runs_along(line)
        cells = (s, w, key, corner, base, cuts, of)
        kept.append(_of_cells(~gone & ~split, *cells))
        if not split.any():
            break
        s, w, key, corner, base, cuts, of = _quartered(*_of_cells(split, *cells), line[split])
    before = np.cumsum([0, *[len(part[3]) for part in kept]])
    kept = [(s, w, key + k, *rest) for (s, w, key, *rest), k in zip(kept, before)]
    return tuple(np.concatenate(column) for column in zip(*kept))


def _of_cells(which: np.ndarray, s: np.ndarray, w: np.ndarray, key: np.ndarray, corner: np.ndarray, base: np.ndarray, cuts: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, ...]:
    rows = which[key]
    return s[rows], w[rows], (np.cumsum(which) - 1)[key[rows]], corner[which], base[which], cuts[rows], of[which]


def _quartered(s: np.ndarray, w: np.ndarray, key: np.ndarray, corner: np.ndarray, base: np.ndarray, cuts: np.ndarray, of: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, ...]:
    """Cells cut at an upright and a level line each, along which no side runs; as ``thinned`` holds them."""
    n, at_line = len(corner), line[key]
    met = (np.minimum(s[:, :2], s[:, 2:]) < at_line) & (at_line < np.maximum(s[:, :2], s[:, 2:]))
    pieces, at, cuts = _split(s, [(k, i, at_line[i, k]) for k in (0, 1) for i in [np.flatnonzero(met[:, k])]], cuts)
    w, beyond = w[at], (pieces[:, :2] + pieces[:, 2:]) / 2 >= at_line[at]
    quarter = 4 * key[at] + 2 * beyond[:, 1] + beyond[:, 0]
    corners = np.stack([corner, np.stack([line[:, 0], corner[:, 1]], axis=1), np.stack([corner[:, 0], line[:, 1]], axis=1), line], axis=1).reshape(-1, 2)
    left, bottom = corners[quarter].T
    ax, ay, bx, by = pieces.T
    rise = np.where((by > ay)[:, None], w, np.where((by < ay)[:, None], -w, 0))
    low = np.minimum(ay, by) == bottom
    here = low & (np.where(ay < by, ax, bx) == left)
    cross, here = (_sums(quarter[i], rise[i], 4 * n).reshape(n, 4, 2) for i in (low, here))
    # up along the left edge to the level line: what begins on it
    start = ~beyond[:, 0] & (ax == left) & (bx > left) & (~beyond[:, 1] | (ay == bottom))
    up = base + _sums(quarter[start] // 4, w[start], n)
    bases = np.stack([base, base + here[:, 0] - cross[:, 0] - here[:, 1], up - here[:, 2], up - cross[:, 2] - here[:, 3]], axis=1).reshape(-1, 2)
    order = np.argsort(quarter, kind="stable")
    some, first = np.unique(quarter[order], return_index=True)
    number = np.repeat(np.arange(len(some)), np.diff(np.append(first, len(order))))
    return pieces[order], w[order], number, corners[some], bases[some], cuts[order], of[some // 4]


def outline(s: np.ndarray, w: np.ndarray, key: np.ndarray, corner: np.ndarray, base: np.ndarray, cuts: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pieces by cell (key; its lower left corner; winding numbers there, at base; weights and numbers in two columns): the
    pieces of the outline of what the first ones cover and the second ones don't, with the inside to the left, the cell of each,
    and whether its ends are cuts of the grid."""
    pieces, of, is_first, is_last = noded(s, key, scale)
    pieces = _settled(pieces, corner[key[of]], scale)
    grid = SNAP * scale
    name = _nodes(pieces.reshape(-1, 2), grid).reshape(-1, 2)
    ends = np.stack([cuts[of, 0] & is_first, cuts[of, 1] & is_last], axis=1)
    # equal pieces once: the lesser end first, weights added up
    turned = (pieces[:, 0] > pieces[:, 2]) | ((pieces[:, 0] == pieces[:, 2]) & (pieces[:, 1] > pieces[:, 3]))
    pieces = np.where(turned[:, None], pieces[:, [2, 3, 0, 1]], pieces)
    name, ends = np.where(turned[:, None], name[:, ::-1], name), np.where(turned[:, None], ends[:, ::-1], ends)
    weight = np.where(turned[:, None], -w[of], w[of])
    flip = name[:, 0] > name[:, 1]  # snapped ends may stand the other way round for pieces that are nearly upright
    low, high = np.where(flip, name[:, 1], name[:, 0]), np.where(flip, name[:, 0], name[:, 1])
    some = low != high
    pieces, of, ends, weight, flip, low, high = (v[some] for v in (pieces, of, ends, weight, flip, low, high))
    first, same = _rows(key[of], low, high)
    weight = np.where((flip == flip[first][same])[:, None], weight, -weight)
    weight = np.stack([np.bincount(same, weight[:, k], minlength=len(first)).round().astype(np.int64) for k in (0, 1)], axis=1)
    real = np.stack([np.bincount(same, ~ends[:, k], minlength=len(first)) > 0 for k in (0, 1)], axis=1)
    pieces, cell, ends = pieces[first], key[of[first]], ~real
    live = (weight != 0).any(axis=1)
    pieces, cell, ends, weight = pieces[live], cell[live], ends[live], weight[live]
    if not len(pieces):
        return pieces, cell, ends
    beside = _covered(pieces, weight, cell, corner, base)
    flat = pieces[:, 1] == pieces[:, 3]
    beyond = beside - np.where((flat | (pieces[:, 3] > pieces[:, 1]))[:, None], weight, -weight)
    here, there = ((n[:, 0] > 0) & (n[:, 1] <= 0) for n in (beside, beyond))
    edge = here != there
    # the inside to the left: upward with it at lesser x, to the right with it above
    along = np.where(flat | (pieces[:, 3] > pieces[:, 1]), here, ~here)
    pieces = np.where(along[:, None], pieces, pieces[:, [2, 3, 0, 1]])
    ends = np.where(along[:, None], ends, ends[:, ::-1])
    return pieces[edge], cell[edge], ends[edge]


def _covered(pieces: np.ndarray, weight: np.ndarray, cell: np.ndarray, corner: np.ndarray, base: np.ndarray) -> np.ndarray:
    """The winding number beside the middle of each piece: at lesser x, and above it for level ones.

    The way there goes from just right of and above the corner up along the cell's left edge, then to the right. What ends
    on the left edge is crossed on the way up, everything else on the way to the right."""
    mid = (pieces[:, :2] + pieces[:, 2:]) / 2
    x, y = mid.T
    left, bottom = corner[cell].T
    ax, ay, bx, by = pieces.T
    rise = np.where((by > ay)[:, None], weight, np.where((by < ay)[:, None], -weight, 0))
    add = lambda i, what: np.stack([np.bincount(i, what[:, k], minlength=len(x)) for k in (0, 1)], axis=1).astype(np.int64)
    out = base[cell].astype(np.int64)
    # up along the left edge: pieces that begin on it and lead away from it
    start = np.flatnonzero((ax == left[np.arange(len(ax))]) & (bx > left) & ~((ay == bottom) & (by == bottom)))
    if len(start):
        reach = np.stack([np.zeros(len(x)), np.full(len(y), -np.inf), np.zeros(len(x)), y], axis=1)
        low = min(float(bottom.min()), float(y.min()))
        reach[:, 1] = low
        for i, j in sweep.meeting(reach, np.stack([np.zeros(len(start)), ay[start], np.zeros(len(start)), ay[start]], axis=1), (cell, cell[start])):
            j = start[j]
            under = (ay[j] < y[i]) | ((ay[j] == y[i]) & (by[j] <= ay[j]))
            out += add(i[under], weight[j[under]])
    # to the right
    way = np.stack([np.full(len(x), min(float(left.min()), float(ax.min()))), y, x, y], axis=1)
    upright = np.flatnonzero(ay != by)
    box = sweep.boxes_of(pieces[upright])
    for i, j in sweep.meeting(way, box, (cell, cell[upright])):
        j = upright[j]
        with np.errstate(divide="ignore", invalid="ignore"):
            where = ax[j] + (y[i] - ay[j]) / (by[j] - ay[j]) * (bx[j] - ax[j])
        hit = (i != j) & (np.minimum(ay[j], by[j]) <= y[i]) & (y[i] < np.maximum(ay[j], by[j])) & (where < x[i])
        hit &= ~((ax[j] == left[j]) & ((bx[j] == left[j]) | ((ay[j] == y[i]) & (by[j] > ay[j]))))
        out -= add(i[hit], rise[j[hit]])
    return out


def _group(rows: pa.Table) -> np.ndarray:
    """group (by number) of each row."""
    group = rows.column("group").combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    return group.astype(np.int64)[:, None]


def _cells(rows: pa.Table) -> np.ndarray:
    """group (by number), ix, iy of each row."""
    return np.hstack([_group(rows), np.stack([rows.column(k).to_numpy() for k in ("ix", "iy")], axis=1)])


def _outlines(scale: float):
    """Cells that stand together in a sorted partition, some at a time."""

    def work(rows: pa.Table) -> pa.RecordBatch:
        s = np.stack([rows.column(k).to_numpy() for k in _ENDS], axis=1)
        cell = _cells(rows)
        first = np.concatenate([[True], (cell[1:] != cell[:-1]).any(axis=1)])
        key, at = np.cumsum(first) - 1, np.flatnonzero(first)
        ox, oy, size = (rows.column(k).to_numpy()[at] for k in _GRID)
        corner = np.stack([ox + cell[at, 1] * size, oy + cell[at, 2] * size], axis=1)
        two = lambda a, b: np.stack([rows.column(a).to_numpy(), rows.column(b).to_numpy()], axis=1)
        cuts = np.stack([rows.column(k).to_numpy() for k in ("cut1", "cut2")], axis=1)
        *cells, origin = thinned(s, two("w", "v"), key, corner, two("base_w", "base_v")[at], cuts)
        pieces, of, ends = outline(*cells, scale)
        columns = [rows.column("group").combine_chunks().take(pa.array(at[origin[of]])), *[pa.array(pieces[:, k]) for k in range(4)], pa.array(ends[:, 0]), pa.array(ends[:, 1])]
        return pa.RecordBatch.from_arrays(columns, names=["group", *_ENDS, "cut1", "cut2"])

    return _whole(_cells, work)


def _whole(names: Callable, work: Callable) -> Callable:
    """Rows that stand together in a sorted partition (equal in ``names`` of a table), many of them in a call of ``work``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        most = TOGETHER
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(b.num_rows for b in held) < most:
                continue
            whole = pa.Table.from_batches(held)
            name = names(whole)
            last = np.flatnonzero((name != name[-1]).any(axis=1))
            if len(last):  # the last one may go on
                yield work(whole.slice(0, last[-1] + 1))
                held = whole.slice(last[-1] + 1).to_batches()
            most = TOGETHER + 2 * sum(b.num_rows for b in held)
        if held:
            yield work(pa.Table.from_batches(held))

    return run


def _tasks(df: DataFrame, sides: int) -> int:
    """Tasks for so many sides: their work is worth more than their bytes, so they are not put together by size."""
    return max(-(-sides // TOGETHER), min(df.sparkSession.sparkContext.defaultParallelism, -(-sides // 500)))


def boundary(df: DataFrame, group: str | None = None, size: float | None = None, away: DataFrame | None = None) -> DataFrame:
    """group, x1, y1, x2, y2, cut1, cut2: the outline of the union of each group's polygons without the polygons of ``away`` (group,
    geom), as pieces of sides with the inside to the left; cut1 and cut2: that end is no vertex, only a cut of the grid. A group
    of many sides has a grid of its own, after how dense it is; ``size``: of all grids' cells."""
    return _outlined(df, group, size, away)[0]


def _outlined(df: DataFrame, group: str | None, size: float | None, away: DataFrame | None) -> tuple[DataFrame, int]:
    """The outline, and how many tasks its work is dealt into."""
    rows = df.select((F.col(group) if group else F.lit("all")).alias("group"), "geom", F.lit(False).alias("away"))
    if away is not None:
        rows = rows.union(away.select("group", "geom", F.lit(True)))
    field, whole_number = rows.schema["group"], T.LongType()
    sides = rows.mapInArrow(_sides, _schema(field, ("w", whole_number), ("v", whole_number)))
    net = stored(sides.groupBy("group", *_ENDS).agg(F.sum("w").alias("w"), F.sum("v").alias("v")).filter("w <> 0 or v <> 0"), "sides")
    low, high = F.min(F.least("y1", "y2")), F.max(F.greatest("y1", "y2"))
    groups = net.groupBy("group").agg(F.count("*").alias("n"), F.min("x1").alias("x0"), low.alias("y0"), F.max("x2").alias("x1"), high.alias("y1"))
    x0, y0, x1, y1, n = groups.agg(F.min("x0"), F.min("y0"), F.max("x1"), F.max("y1"), F.sum("n")).first()
    if not n:
        return net.select("group", *_ENDS, F.lit(False).alias("cut1"), F.lit(False).alias("cut2")), 1
    span, scale = max(x1 - x0, y1 - y0) or 1.0, max(abs(v) for v in (x0, y0, x1, y1)) or 1.0
    # grids of groups with many sides; others are one cell. Lines that coordinates are not likely to lie on
    wide = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.lit(span * 1e-9))
    own = F.greatest(F.sqrt((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) * PER_CELL / F.col("n")), wide / 30_000) if size is None else F.lit(float(size))
    large = groups.filter(F.col("n") > PER_CELL if size is None else F.lit(True)).select(F.col("group").alias("_g"), own.alias("_size"), "x0", "y0")
    cell = F.coalesce("_size", F.lit(1.7 * span))
    placed = net.join(stored(large, "grids"), F.col("group").eqNullSafe(F.col("_g")), "left").withColumn("size", cell)
    placed = placed.select("group", *_ENDS, "w", "v", (F.coalesce("x0", F.lit(x0)) - 0.31830989 * F.col("size")).alias("ox"), (F.coalesce("y0", F.lit(y0)) - 0.36787944 * F.col("size")).alias("oy"), "size")
    more = [("w", whole_number), ("v", whole_number), ("ix", whole_number), ("iy", whole_number), ("cut1", T.BooleanType()), ("cut2", T.BooleanType()), *[(k, T.DoubleType()) for k in _GRID]]
    pieces = stored(placed.mapInArrow(_gridded, _schema(field, *more)), "pieces")
    # how the pieces of a cell cross its lower line (just above it), and those of them at its corner
    bottom, left = F.col("oy") + F.col("iy") * F.col("size"), F.col("ox") + F.col("ix") * F.col("size")
    low_x = F.when(F.col("y1") < F.col("y2"), F.col("x1")).otherwise(F.col("x2"))
    sums = []
    for k in ("w", "v"):
        up = F.when(F.least("y1", "y2") == bottom, F.when(F.col("y2") > F.col("y1"), F.col(k)).when(F.col("y2") < F.col("y1"), -F.col(k)))
        sums += [F.coalesce(F.sum(up), F.lit(0)).alias(f"cross_{k}"), F.coalesce(F.sum(F.when(low_x == left, up)), F.lit(0)).alias(f"here_{k}")]
    cells = pieces.groupBy("group", "ix", "iy").agg(*sums)
    before = Window.partitionBy("group", "iy").orderBy("ix").rowsBetween(Window.unboundedPreceding, -1)
    bases = [(-F.coalesce(F.sum(f"cross_{k}").over(before), F.lit(0)) - F.col(f"here_{k}")).alias(f"base_{k}") for k in ("w", "v")]
    cells = stored(cells.select(F.col("group").alias("_group"), F.col("ix").alias("_ix"), F.col("iy").alias("_iy"), *bases), "cells")
    both = pieces.join(cells, F.col("group").eqNullSafe(F.col("_group")) & (F.col("ix") == F.col("_ix")) & (F.col("iy") == F.col("_iy")))
    tasks = _tasks(df, n)
    line = both.drop("_group", "_ix", "_iy").repartition(tasks, "group", "ix", "iy").sortWithinPartitions("group", "ix", "iy")
    return line.mapInArrow(_outlines(scale), _schema(field, ("cut1", T.BooleanType()), ("cut2", T.BooleanType()))), tasks


def _ringed(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, many.Rings]:
    """Pieces of the outlines of groups that stand together, in order: the group of each (by number), the pieces, where each
    group begins, and the rings."""
    name = _group(table)[:, 0]
    key = np.cumsum(np.concatenate([[0], name[1:] != name[:-1]]))
    s = np.stack([table.column(k).to_numpy() for k in _ENDS], axis=1)
    cuts = np.stack([table.column(k).to_numpy() for k in ("cut1", "cut2")], axis=1)
    order = np.lexsort((*s.T[::-1], key))
    s, cuts = s[order], cuts[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    scale = np.maximum.reduceat(np.abs(s).max(axis=1), first)
    return key, s, first, many.Rings(s, key, len(first), np.where(scale > 0, scale, 1.0), cuts)


def _merged(table: pa.Table) -> pa.RecordBatch:
    key, s, first, rings = _ringed(table)
    n, o = len(first), s[first][key]
    area = np.bincount(key, (s[:, 0] - o[:, 0]) * (s[:, 3] - o[:, 1]) - (s[:, 2] - o[:, 0]) * (s[:, 1] - o[:, 1]), minlength=n) / 2
    counts = [pa.array(np.bincount(rings.key, weights, minlength=n).astype(np.int64), mask=rings.open) for weights in (rings.long - 1, None)]
    long = pa.array(np.bincount(key, np.hypot(s[:, 2] - s[:, 0], s[:, 3] - s[:, 1]), minlength=n))
    columns = [table.column("group").combine_chunks().take(pa.array(first)), counts[0], pa.array(area), long, counts[1], rings.shapes(np.arange(n))]
    return pa.RecordBatch.from_arrays(columns, names=["group", "sides", "area", "perimeter", "rings", "geom"])


def _by_groups(b: DataFrame, tasks: int, work: Callable, schema: T.StructType) -> DataFrame:
    return b.repartition(tasks, "group").sortWithinPartitions("group").mapInArrow(_whole(_group, work), schema)


def dissolve(df: DataFrame, group: str | None = None, attributes: tuple[str, ...] = (), size: float | None = None) -> DataFrame:
    """group, sides, area, perimeter, rings, geom of each group's union, and the attributes of its member of the lowest id.
    sides counts those between vertices (of members, or where their sides meet) on the outline. A merged shape is one value, so
    the outline of a group (not its members) must fit a task; ``boundary`` has no such bound."""
    b, tasks = _outlined(df, group, size, None)
    types = [("sides", T.LongType()), ("area", T.DoubleType()), ("perimeter", T.DoubleType()), ("rings", T.LongType()), ("geom", geom.GEOMETRY)]
    merged = _by_groups(b, tasks, _merged, T.StructType([b.schema["group"], *[T.StructField(n, t) for n, t in types]]))
    if not attributes:
        return merged
    first = df.groupBy((F.col(group) if group else F.lit("all")).alias("_group")).agg(F.min_by(F.struct(*attributes), "id").alias("_of"))
    return merged.join(first, F.col("group").eqNullSafe(F.col("_group"))).select(*merged.columns, *[F.col(f"_of.{a}").alias(a) for a in attributes])


def without(shapes_: DataFrame, away: DataFrame) -> DataFrame:
    """id, piece, geom: what is left of each polygon (id, geom) without the polygons of ``away`` (id, geom) of the same id. A shape
    and what is taken from it are spread over cells as sides, so a shape with very many partners is no single task."""
    b, tasks = _outlined(shapes_, "id", None, away.select(F.col("id").alias("group"), "geom"))
    schema = T.StructType([T.StructField("id", b.schema["group"].dataType), T.StructField("piece", T.IntegerType()), T.StructField("geom", geom.GEOMETRY)])

    def parts(table: pa.Table) -> pa.RecordBatch:
        _, _, first, rings = _ringed(table)
        key, piece, shape = rings.parts()
        bad = np.flatnonzero(rings.open)
        group = table.column("group").combine_chunks().take(pa.array(first[np.concatenate([key, bad])]))
        piece = pa.array(np.concatenate([piece, np.zeros(len(bad), np.int64)]), pa.int32())
        return pa.RecordBatch.from_arrays([group, piece, pa.concat_arrays([shape, pa.nulls(len(bad), shapes.ARROW)])], names=["id", "piece", "geom"])

    return _by_groups(b, tasks, parts, schema)
