"""Nearest neighbours of two large layers, by the leaves of a partition tree.

A k-d tree over a bounded sample of the right features' middles cuts the plane into leaves of about equally many features, so
a dense city is many leaves. Each left feature is first held against the features of one leaf that is near it: what it finds
there bounds how far any nearer one can be. Then it goes to the other leaves whose features' box is not farther than that, and
to no others. Two rounds, no radius. A leaf that very many left features go to is dealt out in blocks of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoanswers.functions import geom
from geoanswers.operators import shapes, sweep
from geoanswers.sources.tables import stored

#: Features in a leaf, leaves, features of the sample for each leaf, left features held against a leaf in one task.
PER_LEAF, MOST_LEAVES, SAMPLED, BLOCK = 2_000, 16_384, 8, 50_000
_BOX = ["x0", "y0", "x1", "y1"]


class Tree:
    """Splits of the plane, wider side first: places of points among the leaves."""

    def __init__(self, points: np.ndarray, leaves: int):
        self.axis, self.value, self.below = [], [], []
        self.leaves = 0
        self._grow(points, leaves)
        self.axis, self.value, self.below = np.array(self.axis), np.array(self.value), np.array(self.below)

    def _grow(self, points: np.ndarray, leaves: int) -> None:
        todo = [(points, leaves, -1, 0)]
        while todo:
            part, n, parent, side = todo.pop()
            here = len(self.axis)
            if parent >= 0:
                self.below[parent][side] = here
            size = np.ptp(part, axis=0) if len(part) else np.zeros(2)
            axis = int(size[1] > size[0])
            value = float(np.median(part[:, axis])) if len(part) else 0.0
            under = part[:, axis] < value if len(part) else np.zeros(0, bool)
            if n <= 1 or len(part) < 2 or not under.any():
                self.axis.append(-1), self.value.append(float(self.leaves)), self.below.append([0, 0])
                self.leaves += 1
                continue
            self.axis.append(axis), self.value.append(value), self.below.append([0, 0])
            todo += [(part[~under], n - n // 2, here, 1), (part[under], n // 2, here, 0)]

    def at(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), np.int64)
        while True:
            inner = np.flatnonzero(self.axis[node] >= 0)
            if not len(inner):
                return self.value[node].astype(np.int64)
            of = node[inner]
            node[inner] = self.below[of, (points[inner, self.axis[of]] >= self.value[of]).astype(int)]


def _boxed(df: DataFrame, tag: str) -> DataFrame:
    v = geom.vertices(F.col("geom"))
    x, y = F.transform(v, lambda p: p["x"]), F.transform(v, lambda p: p["y"])
    ends = [F.array_min(x), F.array_min(y), F.array_max(x), F.array_max(y)]
    return stored(df.select("id", "geom", *[e.alias(n) for e, n in zip(ends, _BOX)]), tag)


def _boxes(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in _BOX], axis=1)


def _with(schema: T.StructType, *more: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([*schema.fields, *[T.StructField(n, t) for n, t in more]])


def _leaf_of(tree):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            box = _boxes(batch)
            yield batch.append_column("leaf", pa.array(tree.value.at((box[:, :2] + box[:, 2:]) / 2)))

    return run


def _gaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How far boxes are apart, all of a by all of b."""
    gap = np.maximum(np.maximum(b[:, :2] - a[:, None, 2:], a[:, None, :2] - b[:, 2:]), 0)
    return np.hypot(gap[:, :, 0], gap[:, :, 1])


def _home_of(tree, table):
    """The leaf that a feature lies in, if it has features, else the one whose box is nearest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, boxes = table.value
        for batch in batches:
            box = _boxes(batch)
            leaf = tree.value.at((box[:, :2] + box[:, 2:]) / 2)
            lost = np.flatnonzero(~np.isin(leaf, names))
            step = max(1, sweep.BLOCK // len(names))
            for lo in range(0, len(lost), step):
                some = lost[lo : lo + step]
                leaf[some] = names[_gaps(box[some], boxes).argmin(axis=1)]
            yield batch.append_column("leaf", pa.array(leaf))

    return run


class Measured:
    """Distances of single points to points and lines, all pairs at once."""

    def __init__(self, other: list[shapes.Shape]):
        sides = [s.sides if len(s.sides) else np.hstack([s.points, s.points]) for s in other]
        self.upto = np.cumsum([len(s) for s in sides])
        self.first = self.upto - [len(s) for s in sides]
        self.sides, self.size = np.concatenate(sides), max(s.size() for s in other)

    def __call__(self, points: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How far each point is from the feature beside it."""
        out = np.empty(len(j))
        for which, member in sweep.runs(self.first[j], self.upto[j]):
            s, p = self.sides[member], points[which]
            along = s[:, 2:] - s[:, :2]
            size = (along * along).sum(axis=1)
            t = np.clip(((p - s[:, :2]) * along).sum(axis=1) / np.where(size > 0, size, 1), 0, 1)
            far = np.hypot(*(p - s[:, :2] - t[:, None] * along).T)
            begin = np.flatnonzero(np.concatenate([[True], which[1:] != which[:-1]]))
            out[which[begin]] = np.minimum.reduceat(far, begin)
        slack = shapes.TOLERANCE * np.maximum(self.size, np.abs(points).max(axis=1, initial=0.0))
        return np.where(out <= slack, 0.0, out)


def measured(other: list[shapes.Shape]) -> Measured | None:
    """None where a feature is no point and no line."""
    return Measured(other) if other and all(s is not None and s.dim < 2 and len(s.points) for s in other) else None


def _rounded(far: np.ndarray, digits: int | None) -> np.ndarray:
    return far if digits is None else np.round(far, digits)


def slack(far, digits: int | None):
    """How far boxes may be apart at most so that what they hold is not farther than ``far``, or as far."""
    return far * (1 + 1e-12) + (0.0 if digits is None else 10.0**-digits)


def nearest_of(mine: list[shapes.Shape], other: list[shapes.Shape], gap: np.ndarray, exact: Measured | None, digits: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The place of the nearest other feature of each, the first of equally near ones (to so many digits, where given), and its
    distance; -1 for features without vertices. gap: how far the boxes are apart."""
    found, far = np.full(len(mine), -1), np.full(len(mine), np.nan)
    some = np.array([s is not None and len(s.points) > 0 for s in mine], bool)
    dots = some & np.array([s is not None and s.dim == 0 and len(s.points) == 1 for s in mine], bool) if exact else np.zeros(len(mine), bool)
    at = np.flatnonzero(dots)
    if len(at):
        points, near = np.concatenate([mine[i].points for i in at.tolist()]), gap[at]
        limit = slack(exact(points, near.argmin(axis=1)), digits)
        i, j = np.nonzero(near <= limit[:, None])
        d = exact(points[i], j)
        key = _rounded(d, digits)
        begin = np.searchsorted(i, np.arange(len(at)))
        best = np.flatnonzero(key == np.minimum.reduceat(key, begin)[i])
        best = best[np.unique(i[best], return_index=True)[1]]
        found[at], far[at] = j[best], d[best]
    for i in np.flatnonzero(some & ~dots).tolist():
        best, near = np.inf, np.inf
        for j in np.argsort(gap[i], kind="stable").tolist():
            if gap[i, j] > slack(near, digits) or not np.isfinite(gap[i, j]):
                break
            d = shapes.distance(mine[i], other[j])
            key = float(_rounded(np.float64(d), digits))
            if key < best or key == best and j < found[i]:
                best, near, found[i], far[i] = key, min(near, d), j, d
    return found, far


def _others_of(table, digits: int | None):
    """A row for each other leaf whose box is not farther than what was found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, boxes = table.value
        for batch in batches:
            box, reach, home = _boxes(batch), batch.column("distance").to_numpy(zero_copy_only=False), batch.column("leaf").to_numpy()
            reach = slack(reach, digits)
            grown = box + reach[:, None] * np.array([-1, -1, 1, 1])
            for i, j in sweep.meeting(grown, boxes):
                p, q = box[i], boxes[j]
                gap = np.maximum(np.maximum(q[:, :2] - p[:, 2:], p[:, :2] - q[:, 2:]), 0)
                keep = (np.hypot(gap[:, 0], gap[:, 1]) <= reach[i]) & (names[j] != home[i])
                if keep.any():
                    rows = batch.select(["id", "geom", *_BOX]).take(pa.array(i[keep]))
                    yield rows.append_column("leaf", pa.array(names[j[keep]]))

    return run


def _nearest_in(lefts: DataFrame, rights: DataFrame, digits: int | None) -> DataFrame:
    """The columns of lefts (with leaf) and neighbor_id, distance: the nearest of the rights in that leaf, ties by id."""
    blocks = lefts.groupBy("leaf").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    blocks = F.broadcast(stored(blocks, "blocks"))  # a row a leaf at most
    a = lefts.join(blocks, "leaf").withColumn("block", F.pmod(F.xxhash64("id", *_BOX), F.col("blocks")).cast("int")).select(*lefts.columns, "block")
    b = rights.join(blocks, "leaf").select("leaf", "id", "rank", "geom", *_BOX, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    schema = _with(T.StructType([lefts.schema[c] for c in lefts.columns]), ("neighbor_id", rights.schema["id"].dataType), ("distance", T.DoubleType()))

    def run(mine: pa.Table, other: pa.Table) -> pa.Table:
        mine = mine.drop_columns(["block"])
        kind = mine.schema.append(pa.field("neighbor_id", other.schema.field("id").type)).append(pa.field("distance", pa.float64()))
        other = other.sort_by("rank")
        fixed, ids = list(shapes.read(other.column("geom"))), other.column("id").combine_chunks()
        box, out = _boxes(other.combine_chunks().to_batches()[0]), []
        exact = measured(fixed)
        for batch in mine.to_batches():
            step = max(1, sweep.BLOCK // len(fixed))
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                found, far = nearest_of(list(shapes.read(part.column("geom"))), fixed, _gaps(_boxes(part), box), exact, digits)
                near = ids.take(pa.array(found))
                out.append(pa.RecordBatch.from_arrays([*part.columns, near, pa.array(far)], schema=kind))
        return pa.Table.from_batches(out, kind)

    return a.groupBy("leaf", "block").cogroup(b.groupBy("leaf", "block")).applyInArrow(run, schema)


def by_leaves(left: DataFrame, right: DataFrame, per_leaf: int = PER_LEAF, digits: int | None = None) -> DataFrame:
    """id, neighbor_id, distance of each left feature (id, geom); NULLs for those without a geometry, or where nothing is right.
    ``digits``: distances that are equal to so many are equally near."""
    spark = left.sparkSession
    a, b = _boxed(left.select("id", "geom"), "left"), _boxed(right.select("id", "geom"), "right").filter("x0 is not null and not isnan(x0) and not isnan(y0)")
    none = [F.lit(None).cast(right.schema["id"].dataType).alias("neighbor_id"), F.lit(None).cast("double").alias("distance")]
    n = b.count()
    if not n:
        return a.select("id", *none)
    leaves = max(1, min(MOST_LEAVES, -(-n // per_leaf)))
    middle = b.select(((F.col("x0") + F.col("x1")) / 2).alias("x"), ((F.col("y0") + F.col("y1")) / 2).alias("y"))
    sample = middle.orderBy(F.xxhash64("x", "y"), "x", "y").limit(SAMPLED * leaves).toArrow()  # bounded by the leaves
    tree = spark.sparkContext.broadcast(Tree(np.stack([sample.column(k).to_numpy() for k in "xy"], axis=1), leaves))
    rights = b.mapInArrow(_leaf_of(tree), _with(b.schema, ("leaf", T.LongType())))
    rights = stored(rights.withColumn("rank", F.row_number().over(Window.partitionBy("leaf").orderBy("id"))), "leaves")
    held = rights.groupBy("leaf").agg(F.min("x0"), F.min("y0"), F.max("x1"), F.max("y1")).orderBy("leaf").collect()  # a row a leaf
    table = spark.sparkContext.broadcast((np.array([r[0] for r in held], np.int64), np.array([tuple(r)[1:] for r in held], float)))
    some = a.filter("x0 is not null and not isnan(x0) and not isnan(y0)")
    homed = stored(some.mapInArrow(_home_of(tree, table), _with(some.schema, ("leaf", T.LongType()))), "homes")
    first = stored(_nearest_in(homed, rights, digits), "first")
    spread = first.select("id", "geom", *_BOX, "leaf", "distance").mapInArrow(_others_of(table, digits), homed.schema)
    more = _nearest_in(stored(spread, "spread"), rights, digits)
    found = first.select("id", "neighbor_id", "distance").union(more.select("id", "neighbor_id", "distance"))
    key = F.col("distance") if digits is None else F.round("distance", digits)
    best = found.groupBy("id").agg(F.min(F.struct(key.alias("key"), "neighbor_id", "distance")).alias("m")).select("id", "m.neighbor_id", "m.distance")
    return best.union(a.filter("x0 is null or isnan(x0) or isnan(y0)").select("id", *none))
