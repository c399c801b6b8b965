"""Spatial joins: boxes first, exact tests on what is left.

A side of few features and vertices (both are counted) is broadcast, and the other one is not shuffled (but dealt out where
it has fewer partitions than there are cores). Otherwise ids
and boxes go through a grid of cells: a feature's own level is the finest of a few levels on which its box covers at most 64
cells. A pair meets on the coarser of its two own levels, in an equi-join on the cell: there one of both is on its own
level and the other one on that level or a finer one, and the key says which of both it is, so that features of finer levels
never meet each other on a coarse one. Levels above those that any feature of either side can own are not written. A pair
that meets in several cells is kept in the one that holds the lower left corner of the boxes' intersection, so nothing is
made distinct by a shuffle. Geometries are fetched by id for the pairs that are left.

Exact tests are kernels (below) over batches of pairs. No Cartesian product, no cap.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import ClassVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoanswers.functions import geom
from geoanswers.meta import LayerMeta, Refused, need_columns, need_metric, to_metres
from geoanswers.operators import many, shapes
from geoanswers.operators.nearest import by_leaves, measured, nearest_of
from geoanswers.sources.tables import stored

LEVELS, FACTOR, MOST_CELLS = 9, 8, 64
#: Features and vertices of a side that is broadcast; pairs of boxes compared at once.
FEW_FEATURES, FEW_VERTICES, AT_ONCE = 4096, 400_000, 4_000_000
#: The relations of two shapes.
PREDICATES = ["intersects", "within", "contains", "overlaps", "touches", "crosses", "equals"]
Shapes = many.Shapes


# ---- kernels: which of the pairs (a[i], b[j]) stay, and a value for each that does -------------------------------


class Holds:
    """Pairs in a relation."""

    value = None

    def __init__(self, predicate: str):
        if predicate not in PREDICATES:
            raise Refused(f"unknown predicate: {predicate}")
        self.predicate = predicate

    def __call__(self, a: Shapes, b: Shapes, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, list]:
        keep = np.zeros(len(i), bool)
        p, q = _upright(a), _upright(b)
        upright = p[i, 4].astype(bool) & q[j, 4].astype(bool)
        keep[upright] = self._of_boxes(p[i[upright]], q[j[upright]])
        rest = np.flatnonzero(~upright)
        (fa, ia), (fb, jb) = many.flat(a, i[rest]), many.flat(b, j[rest])
        done = upright
        for f, k, around, yes in ((fa, ia, q[j[rest]], "within"), (fb, jb, p[i[rest]], "contains")):  # no outlines to cut
            held = f.plain[k] & _inside(f.box[k], around)
            keep[rest[held]], done[rest[held]] = self.predicate in ("intersects", yes), True
        left = ~done[rest]
        rest, ia, jb = rest[left], ia[left], jb[left]
        for at in many.together(fa, fb, ia, jb)[1]:  # polygons of few sides
            keep[rest[at]], done[rest[at]] = many.related(fa, fb, ia[at], jb[at], self.predicate)
        if done.all():
            return keep, []
        single = _single(a)
        rest = np.flatnonzero(~done)
        rest = rest[single[i[rest]]]
        fb, jb = many.flat(b, j[rest])
        dots = _begins(a, i[rest]) if len(rest) else np.zeros((0, 2))
        fit, blocks = many.beside(dots, fb, jb)
        for at in blocks:  # single points and polygons of few sides
            keep[rest[at]] = self._of_points(many.in_polygons(dots[at], fb, jb[at]))
        done[rest[fit]] = True
        for k, at in _by(np.where(done, -1, j)):
            if k < 0:
                continue
            shape = b[k]
            if shape.dim == 2:  # single points against one polygon all at once
                dots = at[single[i[at]]]
                if len(dots):
                    keep[dots] = self._of_points(shapes.located(_begins(a, i[dots]), shape))
                at = at[~single[i[at]]]
            for x in at:
                keep[x] = shapes.Relation(a[i[x]], shape).holds(self.predicate)
        return keep, []

    def _of_points(self, codes: np.ndarray) -> np.ndarray:
        """The relation of single points to polygons that have them there."""
        found = {"intersects": codes >= shapes.ON, "within": codes == shapes.IN, "touches": codes == shapes.ON}
        return found.get(self.predicate, np.zeros(len(codes), bool))

    def _of_boxes(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """The relation of upright rectangles, all at once."""
        meets = ((p[:, :2] <= q[:, 2:4]) & (q[:, :2] <= p[:, 2:4])).all(axis=1)
        inner = ((p[:, :2] < q[:, 2:4]) & (q[:, :2] < p[:, 2:4])).all(axis=1)
        p_in = ((p[:, :2] >= q[:, :2]) & (p[:, 2:4] <= q[:, 2:4])).all(axis=1)
        q_in = ((q[:, :2] >= p[:, :2]) & (q[:, 2:4] <= p[:, 2:4])).all(axis=1)
        found = {"intersects": meets, "within": p_in, "contains": q_in, "equals": p_in & q_in, "touches": meets & ~inner, "overlaps": inner & ~p_in & ~q_in}
        return found.get(self.predicate, np.zeros(len(p), bool))


class PointIn:
    """Points in polygons, half open: a point on a lower or left side is inside, on an upper or right one outside, so that
    one on a common side counts once."""

    value = None

    def __call__(self, a: Shapes, b: Shapes, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, list]:
        keep = np.zeros(len(i), bool)
        for k, at in _by(j):
            keep[at] = shapes.crossed(_begins(a, i[at]), b[k]) % 2 == 1
        return keep, []


class Distance:
    """Pairs at most ``reach`` apart, and how far."""

    value = T.DoubleType()

    def __init__(self, reach: float):
        self.reach = reach

    def __call__(self, a: Shapes, b: Shapes, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, list]:
        far = np.full(len(i), np.nan)
        dots = [np.array([x.dim == 0 and len(x.points) == 1 for x in side], bool) for side in (a, b)]
        both = np.flatnonzero(dots[0][i] & dots[1][j])
        if len(both):
            p, q = (np.concatenate([side[x].points for x in at[both]]) for side, at in ((a, i), (b, j)))
            far[both] = np.hypot(*(p - q).T)
        for x in np.flatnonzero(~(dots[0][i] & dots[1][j])):
            far[x] = shapes.distance(a[i[x]], b[j[x]])
        keep = far <= self.reach
        return keep, far[keep].tolist()


def _single(side: Shapes) -> np.ndarray:
    """Which shapes are single points."""
    if isinstance(side, shapes.Column):
        return (side.dim == 0) & (np.diff(side.first) == 1) & pc.fill_null(pc.equal(side.kinds, "point"), False).to_numpy(zero_copy_only=False)
    return np.array([x is not None and x.kind == "point" and len(x.points) == 1 for x in side], bool)


def _begins(side: Shapes, at: np.ndarray) -> np.ndarray:
    """The first points of the shapes at these places."""
    return side.points[side.first[at]] if isinstance(side, shapes.Column) else np.concatenate([side[k].points[:1] for k in at])


def _inside(box: np.ndarray, upright: np.ndarray) -> np.ndarray:
    """Whether each box lies in an upright rectangle, off its outline by more than rounding."""
    slack = 4 * shapes.TOLERANCE * np.maximum(np.abs(box), np.abs(upright[:, :4])).max(axis=1, initial=0.0)[:, None]
    return (upright[:, 4] > 0) & (box[:, :2] > upright[:, :2] + slack).all(axis=1) & (box[:, 2:] < upright[:, 2:4] - slack).all(axis=1)


def _upright(side: Shapes) -> np.ndarray:
    """Bounds of each shape, and whether it is an upright rectangle."""
    if not isinstance(side, shapes.Column):
        at = [k for k, s in enumerate(side) if s is not None and s.dim == 2 and len(s.sides) == 4 and len(s.parts) == 1]
        plain = [k for k in at if len(side[k].points) == 5]
        return _rectangular(side, at, plain, np.stack([side[k].points for k in plain]) if plain else None)
    if side.upright is None:
        f = many.flat(side, np.zeros(0, np.int64))[0]
        at = np.flatnonzero((f.count == 4) & (np.bincount(f.part_of, minlength=len(side)) == 1))
        plain = at[np.diff(side.first)[at] == 5]
        side.upright = _rectangular(side, at.tolist(), plain.tolist(), side.points[side.first[plain][:, None] + np.arange(5)])
    return side.upright


def _rectangular(side: Shapes, at: list[int], plain: list[int], points: np.ndarray | None) -> np.ndarray:
    """The same, of shapes of one part and four sides; plain: those of five points, which are given."""
    out = np.zeros((len(side), 5))
    if plain:
        ends = np.concatenate([points[:, :-1], points[:, 1:]], axis=2)
        lo, hi = points.min(axis=1), points.max(axis=1)
        corners = ((points == lo[:, None]) | (points == hi[:, None])).all(axis=(1, 2)) & ((ends[:, :, :2] == ends[:, :, 2:]).sum(axis=2) == 1).all(axis=1)
        x, y = points[:, :, 0] - points[:, :1, 0], points[:, :, 1] - points[:, :1, 1]
        area = (x[:, :-1] * y[:, 1:] - x[:, 1:] * y[:, :-1]).sum(axis=1) / 2
        out[plain] = np.hstack([lo, hi, (corners & (lo < hi).all(axis=1) & (np.abs(area) > 0.5 * (hi - lo).prod(axis=1)))[:, None]])
    for k in set(at).difference(plain):
        s = side[k]
        lo, hi = s.points.min(axis=0), s.points.max(axis=0)
        corners = ((s.points == lo) | (s.points == hi)).all() and ((s.sides[:, :2] == s.sides[:, 2:]).sum(axis=1) == 1).all()
        out[k] = *lo, *hi, corners and (lo < hi).all() and abs(shapes.signed_area(s.parts[0][0])) > 0.5 * (hi - lo).prod()
    return out


def _by(keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each key and where it stands."""
    order = np.argsort(keys, kind="stable")
    found, first = np.unique(keys[order], return_index=True)
    yield from zip(found.tolist(), np.split(order, first[1:]))


def _measure(df: DataFrame) -> tuple[int, int, float, float, float, float, float]:
    """features, vertices, and of the boxes: the median longer side, the greatest width and height, the extent's area, the largest
    coordinate."""
    v = df.select(geom.vertices(F.col("geom")).alias("v")).select(F.size("v").alias("n"), F.transform("v", lambda p: p["x"]).alias("x"), F.transform("v", lambda p: p["y"]).alias("y"))
    v = v.select("n", F.array_min("x").alias("x0"), F.array_min("y").alias("y0"), F.array_max("x").alias("x1"), F.array_max("y").alias("y1"))
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    extent = (F.max("x1") - F.min("x0")) * (F.max("y1") - F.min("y0"))
    found = v.agg(F.count("*"), F.sum(F.greatest("n", F.lit(0))), F.percentile_approx(F.greatest(w, h), 0.5, 1000), F.max(w), F.max(h), extent, F.max(F.greatest(*[F.abs(c) for c in ("x0", "y0", "x1", "y1")]))).first()
    return tuple(m or 0 for m in found)


def _highest(width: float, height: float, size: float) -> int:
    """A level that no box of these sides or smaller ones is above, wherever it lies."""
    fits = (level for level in range(LEVELS) if (width / (size * FACTOR**level) + 2) * (height / (size * FACTOR**level) + 2) <= MOST_CELLS)
    return next(fits, LEVELS)


def _at(v: Column, size: float, level: int) -> Column:
    return F.floor(v / (size * FACTOR**level)).cast("long")


def _levelled(df: DataFrame, size: float, grow: float, name: str, highest: int) -> DataFrame:
    """Columns name (the row's key), the sides name_x0 ... name_y1 of its grown box (plain columns: a struct's fields would be
    worked out again at every use), name_own (its level)."""
    rows = df.select(F.col("_k").alias(name), *[(F.col(f"_{k}") + (grow if k[1] == "1" else -grow)).alias(f"{name}_{k}") for k in ("x0", "y0", "x1", "y1")])
    x0, y0, x1, y1 = (F.col(f"{name}_{k}") for k in ("x0", "y0", "x1", "y1"))

    def count(level: int) -> Column:
        return (_at(x1, size, level) - _at(x0, size, level) + 1.0) * (_at(y1, size, level) - _at(y0, size, level) + 1.0)

    own = F.coalesce(*[F.when(count(level) <= MOST_CELLS, level) for level in range(min(highest + 1, LEVELS))], F.lit(LEVELS))
    return rows.filter(x0.isNotNull()).withColumn(f"{name}_own", own)


def _celled(rows: DataFrame, size: float, name: str, highest: int, others: int) -> DataFrame:
    """A row for each cell of the feature's own level and the coarser ones up to the other side's highest, with the key columns
    ``left_owns`` (the left one of the pair is on its own level), level, ix, iy."""
    x0, y0, x1, y1, own = (F.col(f"{name}_{k}") for k in ("x0", "y0", "x1", "y1", "own"))

    def cells(level: int, left_owns: bool) -> Column:
        def cell(x: Column, y: Column) -> Column:
            return F.struct(F.lit(left_owns).alias("left_owns"), F.lit(level).alias("level"), x.alias("ix"), y.alias("iy"))

        if level == LEVELS:
            return F.array(cell(F.lit(0).cast("long"), F.lit(0).cast("long")))
        ys = F.sequence(_at(y0, size, level), _at(y1, size, level))
        return F.flatten(F.transform(F.sequence(_at(x0, size, level), _at(x1, size, level)), lambda x: F.transform(ys, lambda y: cell(x, y))))

    none = F.array().cast("array<struct<left_owns:boolean,level:int,ix:bigint,iy:bigint>>")
    made = []
    for level in range(max(highest, others) + 1):
        # the left side's own level takes right ones of that level and finer ones; the right side's own level finer left ones
        if name == "l":
            if level <= highest:
                made.append(F.when(own == level, cells(level, True)))
            if level <= others:
                made.append(F.when(own < level, cells(level, False)))
        else:
            if level <= highest:
                made.append(F.when(own == level, cells(level, False)))
            if level <= others:
                made.append(F.when(own <= level, cells(level, True)))
    return rows.withColumn("c", F.explode(F.concat(*[F.coalesce(m, none) for m in made])))


def _keyed(df: DataFrame, tag: str) -> DataFrame:
    """df (stored) with a key _k for each row and its box."""
    v = geom.vertices(F.col("geom"))
    at = lambda k: F.transform("_v", lambda p: p[k])
    boxed = df.withColumn("_v", v).select(*df.columns, F.array_min(at("x")).alias("_x0"), F.array_min(at("y")).alias("_y0"), F.array_max(at("x")).alias("_x1"), F.array_max(at("y")).alias("_y1"))
    return stored(boxed.withColumn("_k", F.monotonically_increasing_id()), tag)


def _plain(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != "geom"]


class _Side:
    """A broadcast side: rows, shapes and boxes, decoded once in a worker process (of the last few sides)."""

    known: ClassVar[dict[str, tuple]] = {}

    def __init__(self, data: Broadcast):
        self.data, self.name = data, uuid.uuid4().hex

    def read(self) -> tuple[pa.Table, Shapes, np.ndarray]:
        if self.name not in self.known:
            rows = pa.ipc.open_stream(self.data.value).read_all()
            side = shapes.Column(rows.column("geom"))
            while len(self.known) >= 4:
                self.known.pop(next(iter(self.known)))
            self.known[self.name] = (rows, side, many.bounds(side))
        return self.known[self.name]


def _broadcast(side: DataFrame) -> _Side:
    """A side, whose size the caller has checked, for all tasks."""
    sink, table = pa.BufferOutputStream(), side.withColumn("geom", F.col("geom").cast(geom.GEOMETRY)).toArrow()
    with pa.ipc.new_stream(sink, table.schema) as stream:
        stream.write_table(table)
    return _Side(side.sparkSession.sparkContext.broadcast(sink.getvalue().to_pybytes()))


def spread(df: DataFrame) -> DataFrame:
    """df in as many partitions as there are cores at least: a small file is one partition, and kernels take their time."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _schema(left: DataFrame, right: DataFrame, kernel) -> T.StructType:
    sides = [T.StructField(n, T.StructType([df.schema[c] for c in _plain(df)] + [T.StructField("_", T.ByteType())])) for n, df in (("l", left), ("r", right))]
    return T.StructType(sides + ([T.StructField("value", kernel.value)] if kernel.value else []))


def _loose(box: np.ndarray, slack: float) -> np.ndarray:
    """Boxes grown by a share of their largest coordinate."""
    more = slack * np.where(np.isfinite(box), np.abs(box), 0.0).max(axis=1, initial=0.0)
    return box + more[:, None] * np.array([-1, -1, 1, 1])


def _rows(side: pa.RecordBatch | pa.Table, at: np.ndarray) -> pa.StructArray:
    """The rows at these places as structs, without geometries."""
    names = [c for c in side.schema.names if c != "geom"]
    columns = [side.column(c).take(pa.array(at)) for c in names]
    columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns]
    return pa.StructArray.from_arrays([*columns, pa.nulls(len(at), pa.int8())], names=[*names, "_"])


def _out(left, right, i: np.ndarray, j: np.ndarray, values: list, kernel) -> pa.RecordBatch:
    columns, names = [_rows(left, i), _rows(right, j)], ["l", "r"]
    if kernel.value:
        columns.append(values if isinstance(values, pa.Array) else pa.array(values, pa.float64() if kernel.value == T.DoubleType() else shapes.ARROW))
        names.append("value")
    return pa.RecordBatch.from_arrays(columns, names=names)


def _against(table, kernel, grow: float, left: bool, slack: float):
    """Batches of one side against the other side, which is broadcast; ``left``: the batches are the left side; ``slack``: how much
    boxes may be apart, as a share of their coordinates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fixed, other, box = table.read()
        box = _loose(box + np.array([-grow, -grow, grow, grow]), slack)
        for whole in batches:
            step = max(1, AT_ONCE // max(1, len(other)))
            for lo in range(0, whole.num_rows, step):
                batch = whole.slice(lo, step)
                mine = shapes.Column(batch.column("geom"))
                b = _loose(many.bounds(mine), slack)
                meet = (b[:, None, 0] <= box[:, 2]) & (box[:, 0] <= b[:, None, 2]) & (b[:, None, 1] <= box[:, 3]) & (box[:, 1] <= b[:, None, 3])
                i, j = np.nonzero(meet)
                if not len(i):
                    continue
                keep, values = kernel(mine, other, i, j) if left else kernel(other, mine, j, i)
                i, j = i[keep], j[keep]
                if len(i):
                    yield _out(batch, fixed, i, j, values, kernel) if left else _out(fixed, batch, j, i, values, kernel)

    return run


def _tested(kernel, names: tuple[list[str], list[str]]):
    """Pairs of rows (l and r, with geometries) through the kernel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            # a struct's own nulls aside, its fields are the rows' columns
            left, right = (pa.RecordBatch.from_arrays([batch.column(s).field(c) for c in cols], names=cols) for s, cols in zip("lr", names))
            a, b = shapes.Column(left.column("geom")), shapes.Column(right.column("geom"))
            at = np.arange(batch.num_rows)
            keep, values = kernel(a, b, at, at)
            yield _out(left, right, at[keep], at[keep], values, kernel)

    return run


def _met(left: DataFrame, right: DataFrame, size: float, grow: float, sides: tuple) -> DataFrame:
    """Keys l and r of the pairs whose boxes, the left one grown, meet; each once."""
    (wl, hl), (wr, hr) = sides
    tl, tr = _highest(wl + 2 * grow, hl + 2 * grow, size), _highest(wr, hr, size)
    a = _celled(_levelled(left, size, grow, "l", tl), size, "l", tl, tr)
    b = _celled(_levelled(right, size, 0.0, "r", tr), size, "r", tr, tl).withColumnRenamed("c", "rc")
    met = a.join(b, [F.col(f"c.{k}") == F.col(f"rc.{k}") for k in ("left_owns", "level", "ix", "iy")])
    meet = F.expr("l_x0 <= r_x1 and r_x0 <= l_x1 and l_y0 <= r_y1 and r_y0 <= l_y1")
    width = F.lit(size) * F.pow(F.lit(float(FACTOR)), F.col("c.level"))
    corner = (F.floor(F.greatest("l_x0", "r_x0") / width).cast("long") == F.col("c.ix")) & (F.floor(F.greatest("l_y0", "r_y0") / width).cast("long") == F.col("c.iy"))
    return met.filter(meet & ((F.col("c.level") == LEVELS) | corner)).select("l", "r")


class Boxes:
    """All pairs whose boxes meet."""

    value = None

    def __call__(self, a: Shapes, b: Shapes, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, list]:
        return np.ones(len(i), bool), []


def pairs(left: DataFrame, right: DataFrame, size: float | None = None, grow: float = 0.0, kernel=None, once: Callable | None = None) -> DataFrame:
    """Columns l and r (rows of both sides, without geometries) and, where the kernel has one, value, of the pairs whose boxes,
    one of them grown, meet and which the kernel keeps; each once. ``once``: what to do instead where both sides are large."""
    need_columns(left, "geom")
    need_columns(right, "geom")
    kernel = kernel or Boxes()
    schema = _schema(left, right, kernel)
    # kernels take what is nearer than rounding for the same, so boxes that are as near are compared too
    slack = 0.0 if isinstance(kernel, Boxes) else shapes.TOLERANCE
    nr, vr, mr, wr, hr, extent, far_r = _measure(right)
    if size is None and nr <= FEW_FEATURES and vr <= FEW_VERTICES:
        return spread(left).mapInArrow(_against(_broadcast(right), kernel, grow, True, slack), schema)
    nl, vl, ml, wl, hl, _, far_l = _measure(left)
    if size is None and nl <= FEW_FEATURES and vl <= FEW_VERTICES:
        return spread(right).mapInArrow(_against(_broadcast(left), kernel, grow, False, slack), schema)
    if once is not None:
        return once()
    largest = max(far_l, far_r)
    grow += slack * largest if np.isfinite(largest) else 0.0
    # points have no sides: cells of about one of them
    size = max(size or 2 * max(ml, mr) or (extent / max(1, nr)) ** 0.5 or 1.0, grow)
    a, b = _keyed(left, "left"), _keyed(right, "right")
    met = _met(a, b, size, grow, ((wl, hl), (wr, hr)))
    rows = lambda df, k, name: df.select(F.col("_k").alias(f"_{k}"), F.struct(*name.columns).alias(k))
    whole = met.join(rows(a, "l", left).withColumnRenamed("l", "lrow"), F.col("l") == F.col("_l")).join(rows(b, "r", right).withColumnRenamed("r", "rrow"), F.col("r") == F.col("_r"))
    whole = whole.select(F.col("lrow").alias("l"), F.col("rrow").alias("r"))
    return whole.mapInArrow(_tested(kernel, (left.columns, right.columns)), schema)


def matched_ids(left: DataFrame, right: DataFrame, predicate: str, size: float | None = None) -> DataFrame:
    """_id of the left features that stand in the predicate to any right one. Of two large sides, equal shapes are looked at once,
    so copies at one place don't multiply the pairs."""
    left, right, kernel = left.select("id", "geom"), right.select("geom"), Holds(predicate)

    def shape_by_shape() -> DataFrame:
        each = stored(left.select("geom").distinct().withColumn("_shape", F.monotonically_increasing_id()), "shapes")
        met = pairs(each, stored(right.distinct(), "others"), size, kernel=kernel)
        hit = each.join(met.select(F.col("l._shape").alias("_hit")).distinct(), F.col("_shape") == F.col("_hit"), "left_semi").select(F.col("geom").alias("_geom"))
        same = left.join(hit, F.col("geom") == F.col("_geom"), "left_semi")
        return same.select(F.struct("id").alias("l"))

    return pairs(left, right, size, kernel=kernel, once=shape_by_shape).select(F.col("l.id").alias("_id")).distinct()


def relate(left: DataFrame, right: DataFrame, predicate: str, size: float | None = None) -> DataFrame:
    """Left features that stand in the predicate to any right one; ``disjoint``: that meet none."""
    need_two(left, right)
    hit = matched_ids(left, right, "intersects" if predicate == "disjoint" else predicate, size)
    return left.join(hit, left.id == hit["_id"], "left_anti" if predicate == "disjoint" else "left_semi")


def relate_report(left: DataFrame, right: DataFrame, predicate: str, meta: LayerMeta) -> DataFrame:
    """One row: tested, matched, reference_features, compared_in."""
    out = left.agg(F.count("*").alias("tested")).join(relate(left, right, predicate).agg(F.count("*").alias("matched"))).join(right.agg(F.count("*").alias("reference_features")))
    return out.withColumn("compared_in", F.lit(meta.crs))


def near(left: DataFrame, right: DataFrame, distance: float, unit: str, meta: LayerMeta) -> DataFrame:
    """Left features within a real distance of any right one."""
    need_metric(meta, "a distance")
    reach = to_metres(distance, unit) / to_metres(1, meta.unit)
    hit = pairs(left.select("id", "geom"), right.select("geom"), grow=reach, kernel=Distance(reach)).select(F.col("l.id").alias("_id")).distinct()
    return left.join(hit, left.id == hit["_id"], "left_semi")


def _finite(g: Column) -> Column:
    """Whether a geometry has vertices, and all of them are finite."""
    v = geom.vertices(g)
    return F.coalesce((F.size(v) > 0) & F.forall(v, lambda p: ~F.isnan(p["x"]) & ~F.isnan(p["y"]) & (F.abs(p["x"]) < 1e18) & (F.abs(p["y"]) < 1e18)), F.lit(False))


def _moved(left_meta: LayerMeta, right: DataFrame, right_meta: LayerMeta) -> DataFrame:
    if left_meta.crs == right_meta.crs:
        return right
    g = F.col("geom")
    if right_meta.geographic:  # series are finite off the earth too
        g = F.when(F.forall(geom.vertices(g), lambda p: (F.abs(p["x"]) <= 360) & (F.abs(p["y"]) <= 90)), g)
    return right.withColumn("geom", geom.reprojected(g, right_meta.crs, left_meta.crs))


def aligned(left_meta: LayerMeta, right: DataFrame, right_meta: LayerMeta) -> DataFrame:
    """The right side in the left's CRS; geometries that are empty or don't come out finite are dropped (``alignment`` counts
    them)."""
    return _moved(left_meta, right, right_meta).filter(_finite(F.col("geom")))


def alignment(left_meta: LayerMeta, right: DataFrame, right_meta: LayerMeta) -> DataFrame:
    """One row: features, empty (without a geometry), dropped (that can't be had in the left's CRS), compared, compared_in."""
    return _aligned_counts(_both(left_meta, right, right_meta), left_meta)


def _both(left_meta: LayerMeta, right: DataFrame, right_meta: LayerMeta) -> DataFrame:
    """The right side in the left's CRS, and whether it had a geometry (_some)."""
    some = F.coalesce(F.size(geom.vertices(F.col("geom"))) > 0, F.lit(False))
    return _moved(left_meta, right.withColumn("_some", some), right_meta)


def _aligned_counts(both: DataFrame, left_meta: LayerMeta) -> DataFrame:
    ok = _finite(F.col("geom"))
    counts = [F.count("*").alias("features"), F.count_if(~F.col("_some")).alias("empty"), F.count_if(F.col("_some") & ~ok).alias("dropped"), F.count_if(ok).alias("compared")]
    return both.agg(*counts).withColumn("compared_in", F.lit(left_meta.crs))


def need_two(left: DataFrame, right: DataFrame) -> None:
    """Refuses to relate a layer to itself."""
    if left is right or left.sameSemantics(right):
        raise Refused("a spatial relationship needs two different layers")


def relate_layers(left: DataFrame, left_meta: LayerMeta, right: DataFrame, right_meta: LayerMeta, predicate: str) -> DataFrame:
    """One row: tested, matched, reference_features, reference_empty, reference_dropped, compared_in, for layers in any two CRSs.
    Refused for a layer and itself, and where nothing of the right layer can be had in the left's CRS."""
    need_two(left, right)
    # series are long: they are worked out once, over all cores
    both = stored(_both(left_meta, spread(right), right_meta), "moved")
    said = _aligned_counts(both, left_meta).first()
    if not said.compared:
        raise Refused(f"nothing of the other layer can be compared in {left_meta.crs}")
    other = both.filter(_finite(F.col("geom"))).drop("_some")
    out = left.agg(F.count("*").alias("tested")).join(relate(left, other, predicate).agg(F.count("*").alias("matched")))
    counts = {"reference_features": said.compared, "reference_empty": said.empty, "reference_dropped": said.dropped}
    return out.select("*", *[F.lit(v).cast("long").alias(n) for n, v in counts.items()], F.lit(left_meta.crs).alias("compared_in"))


def parts(polygons: DataFrame) -> DataFrame:
    """A row for each part of each feature."""
    return polygons.withColumn("geom", F.explode(F.transform(F.col("geom.parts"), lambda p: F.struct(F.lit("polygon").alias("kind"), F.array(p).alias("parts")))))


def representative_points(df: DataFrame) -> DataFrame:
    """Points as they are, the centroid of other features."""
    c = geom.centroid(F.col("geom"))
    return df.withColumn("geom", F.when(F.col("geom.kind") == "point", F.col("geom")).otherwise(geom.point(c["x"], c["y"])))


def count_in_polygons(polygons: DataFrame, points: DataFrame, group: str = "label", size: float | None = None) -> DataFrame:
    """label, count: points in the polygons of each label (0 where none)."""
    inside = pairs(representative_points(points.select("id", "geom")), parts(polygons.select(group, "geom")), size, kernel=PointIn())
    counted = inside.groupBy(F.col(f"r.{group}").alias("_label")).agg(F.count("*").alias("n"))
    labels = polygons.select(F.col(group).alias("label")).distinct()
    return labels.join(counted, F.col("label").eqNullSafe(F.col("_label")), "left").select("label", F.coalesce("n", F.lit(0)).cast("long").alias("count"))


def unmatched_points(polygons: DataFrame, points: DataFrame, size: float | None = None) -> DataFrame:
    hit = pairs(representative_points(points.select("id", "geom")), parts(polygons.select("geom")), size, kernel=PointIn()).select(F.col("l.id").alias("_id")).distinct()
    return points.join(hit, points.id == hit["_id"], "left_anti")


def density(polygons: DataFrame, points: DataFrame, meta: LayerMeta, group: str = "label") -> DataFrame:
    """label, count, area_km2, per_km2; refused in degrees."""
    need_metric(meta, "a density")
    scale = to_metres(1, meta.unit) ** 2 / 1e6
    areas = polygons.groupBy(F.col(group).alias("_group")).agg((F.sum(geom.area(F.col("geom"))) * scale).alias("area_km2"))
    counts = count_in_polygons(polygons, points, group)
    return counts.join(areas, F.col("label").eqNullSafe(F.col("_group"))).select("label", "count", "area_km2", F.try_divide(F.col("count").cast("double"), "area_km2").alias("per_km2"))


def spatial_join(left: DataFrame, right: DataFrame, predicate: str = "intersects", how: str = "inner", suffix: str = "_2") -> DataFrame:
    """Left columns and the right ones with a suffix, for every pair in the predicate; how=left keeps the others."""
    met = pairs(left.select("id", "geom"), right, kernel=Holds(predicate))
    found = met.select(F.col("l.id").alias("_id"), *[F.col(f"r.{c}").alias(f"{c}{suffix}") for c in right.columns if c != "geom"])
    return left.join(found, left.id == found["_id"], how).drop("_id")


def nearest_k(df: DataFrame, x: float, y: float, k: int = 10) -> DataFrame:
    """id, distance of the k features nearest to a stated point, ties by id; and on each row how many were considered (have a
    geometry), and the nearest and farthest distance of those returned."""
    if not 1 <= k <= 500:
        raise Refused("k is from 1 to 500")

    def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spot = shapes.Shape("point", [[np.array([[x, y]], float)]])
        for batch in batches:
            dots, at = shapes.dots(batch.column("geom"))
            far = np.full(batch.num_rows, np.nan)
            far[dots] = np.hypot(at[:, 0] - x, at[:, 1] - y)
            rest = np.flatnonzero(~dots)
            far[rest] = [np.nan if s is None else shapes.distance(s, spot) for s in shapes.read(batch.column("geom").take(pa.array(rest)))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(far)], names=["id", "distance"])

    schema = T.StructType([df.schema["id"], T.StructField("distance", T.DoubleType())])
    far = df.select("id", "geom").mapInArrow(apart, schema).filter("not isnan(distance)")
    some = F.coalesce(F.size(geom.vertices(F.col("geom"))) > 0, F.lit(False))
    whole = df.agg(F.count_if(some).alias("considered"))
    ranked = far.orderBy("distance", "id").limit(k).join(F.broadcast(whole))
    all_ = Window.partitionBy()  # of at most k rows
    return ranked.select("id", "distance", "considered", F.min("distance").over(all_).alias("nearest"), F.max("distance").over(all_).alias("farthest"))


def _nearest_of(table, digits: int | None):
    """The nearest feature of a broadcast side for each feature; the side's features stand in the order of their ids, so the
    first of equally near ones is the right one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fixed, other, box = table.read()
        ids, exact = fixed.column("id").combine_chunks(), measured(other)
        for whole in batches:
            step = max(1, AT_ONCE // max(1, len(other)))
            for lo in range(0, whole.num_rows, step):
                batch = whole.slice(lo, step)
                mine = list(shapes.read(batch.column("geom")))
                b = many.bounds(mine)
                with np.errstate(invalid="ignore"):
                    dx = np.maximum(np.maximum(box[:, 0] - b[:, None, 2], b[:, None, 0] - box[:, 2]), 0)
                    dy = np.maximum(np.maximum(box[:, 1] - b[:, None, 3], b[:, None, 1] - box[:, 3]), 0)
                    gap = np.hypot(dx, dy)
                found, far = nearest_of(mine, other, gap, exact, digits)
                near = ids.take(pa.array(found, mask=found < 0))
                yield pa.RecordBatch.from_arrays([batch.column("id"), near, pa.array(far, mask=found < 0)], names=["id", "neighbor_id", "distance"])

    return run


def nearest_neighbor(left: DataFrame, right: DataFrame, few: int = FEW_FEATURES, digits: int | None = None) -> DataFrame:
    """id, neighbor_id, distance: the nearest right feature of each left one, ties (distances equal to so many digits, where given)
    by id; NULLs where a feature has no geometry or nothing is right. A right side of few features (counted, as its vertices are) is broadcast; otherwise both sides go by the
    leaves of a partition tree."""
    slim, target = left.select("id", "geom"), right.select("id", "geom")
    features, vertices, *_ = _measure(target)
    if features and features <= few and vertices <= FEW_VERTICES:
        schema = T.StructType([left.schema["id"], T.StructField("neighbor_id", right.schema["id"].dataType), T.StructField("distance", T.DoubleType())])
        return spread(slim).mapInArrow(_nearest_of(_broadcast(target.orderBy("id")), digits), schema)
    return by_leaves(slim, target, digits=digits)


def zonal_statistics(zones: DataFrame, cells: DataFrame, value: str = "z", size: float | None = None) -> DataFrame:
    """label, count, sum, mean, min, max, std of the cells (rows with geom at the cell's centre) in each zone."""
    inside = pairs(cells.select(value, "geom"), parts(zones.select("label", "geom")), size, kernel=PointIn())
    v = F.col(f"l.{value}")
    return inside.groupBy(F.col("r.label").alias("label")).agg(F.count(v).alias("count"), F.sum(v).alias("sum"), F.avg(v).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"), F.stddev_pop(v).alias("std"))


def relationship_count(left: DataFrame, right: DataFrame, predicate: str) -> DataFrame:
    """One row: pairs in the predicate, and features of the left side in any."""
    met = pairs(left.select("id", "geom"), right.select("geom"), kernel=Holds(predicate))
    return met.agg(F.count("*").alias("pairs"), F.countDistinct("l.id").alias("features"))


def bbox_count(df: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    b = geom.bbox(F.col("geom"))
    return df.filter((b["xmin"] <= box[2]) & (b["xmax"] >= box[0]) & (b["ymin"] <= box[3]) & (b["ymax"] >= box[1])).agg(F.count("*").alias("count"))
