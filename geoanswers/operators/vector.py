"""Geometry operators: measures, reprojection, hulls, buffers, overlays, coverages, validity.

Overlays take any polygons. What cannot be computed (a shape of another kind, a ring that rounding leaves open) comes back
as a row with status ``unsupported`` and no geometry, never approximated."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoanswers.functions import geom
from geoanswers.functions.geodesy import inverse
from geoanswers.meta import LayerMeta, Refused, metric_plan, need_columns, to_metres, utm_zone
from geoanswers.operators import many, planar, shapes, sweep
from geoanswers.operators.coverage import boundary as dissolve_boundary, dissolve, without  # noqa: F401
from geoanswers.operators.sjoin import Shapes, _upright, pairs, spread
from geoanswers.sources.tables import stored

GEOMETRY = geom.GEOMETRY
_STATISTICS = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max}


# ---- measures ----------------------------------------------------------------------------------------------------


def _extent(df: DataFrame) -> tuple[float, ...] | None:
    b = geom.bbox(F.col("geom"))
    found = df.agg(F.min(b["xmin"]), F.min(b["ymin"]), F.max(b["xmax"]), F.max(b["ymax"])).first()
    return None if found[0] is None else tuple(found)


def in_metric_frame(df: DataFrame, meta: LayerMeta) -> tuple[DataFrame, float, str, str]:
    """df, metres in a unit of its coordinates, frame and the CRS measured in: the layer's own units, the UTM zone of a layer
    in degrees, or (too wide for one) an equal-area frame of the ellipsoid, where only areas are right."""
    if not meta.geographic:
        return df, to_metres(1, meta.unit), "map_units", meta.crs or ""
    box = _extent(df)
    zone = utm_zone(*box) if box else None
    if zone:
        return reproject(df, meta.crs, zone), 1.0, "project", zone
    return df.withColumn("geom", geom.equal_area(F.col("geom"))), 1.0, "ellipsoidal", meta.crs or ""


def measured(df: DataFrame, meta: LayerMeta, metric: str = "area") -> DataFrame:
    """One row: features, measured, skipped (shapes that have no such measure), sum, mean, min, max, unit, frame. Nothing
    measurable makes NULL, never 0. Metrics: area, perimeter (polygons), length (lines)."""
    dims = {"area": 2, "perimeter": 2, "length": 1}
    if metric not in dims:
        raise Refused(f"unknown measure: {metric}")
    rows, scale, frame, _ = in_metric_frame(df, meta)
    if frame == "ellipsoidal" and metric != "area":
        rows, value = _geodesic_lengths(df), F.col("v")
    else:
        value = geom.area(F.col("geom")) * scale**2 if metric == "area" else geom.length(F.col("geom")) * scale
    value = F.when(geom.dimension(F.col("geom")) == dims[metric], value)
    out = rows.select(value.alias("v")).agg(F.count("*").alias("features"), F.count("v").alias("measured"), *[f("v").alias(n) for n, f in _STATISTICS.items()])
    skipped = (F.col("features") - F.col("measured")).alias("skipped")
    return out.select("features", "measured", skipped, *_STATISTICS, F.lit("m2" if metric == "area" else "m").alias("unit"), F.lit(frame).alias("frame"))


def _geodesic_lengths(df: DataFrame) -> DataFrame:
    """geom and v: the length of all its sides on the ellipsoid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = [None if s is None else float(inverse(*s.sides.T)[0].sum()) for s in shapes.read(batch.column("geom"))]
            yield pa.RecordBatch.from_arrays([batch.column("geom"), pa.array(far, pa.float64())], names=["geom", "v"])

    return df.select("geom").mapInArrow(run, T.StructType([df.schema["geom"], T.StructField("v", T.DoubleType())]))


def geometry_rank(df: DataFrame, meta: LayerMeta, n: int = 5, smallest: bool = False, label: str = "label") -> DataFrame:
    """id, label, area of the n largest (or smallest) shapes that have an area, ties by id."""
    need_columns(df, "id", label, "geom")
    rows, scale, _, _ = in_metric_frame(df, meta)
    sized = rows.select("id", label, (geom.area(F.col("geom")) * scale**2).alias("area")).filter("area is not null")
    return sized.orderBy(F.asc("area") if smallest else F.desc("area"), "id").limit(n)


def of_dimension(df: DataFrame, dimension: int) -> DataFrame:
    """Features whose geometry has this dimension: 0 points, 1 lines, 2 polygons."""
    return df.filter(geom.dimension(F.col("geom")) == dimension)


def reproject(df: DataFrame, source: str, target: str) -> DataFrame:
    return df.withColumn("geom", geom.reprojected(F.col("geom"), source, target))


def centroids(df: DataFrame) -> DataFrame:
    c = geom.centroid(F.col("geom"))
    return df.withColumn("geom", geom.point(c["x"], c["y"]))


# ---- one shape at a time -----------------------------------------------------------------------------------------


def _mapped(df: DataFrame, work: Callable, extra: list[T.StructField] = (), together: bool = False) -> DataFrame:
    """id, geom, status and what else ``work`` returns (geometry or None, *extra values) for each shape; ``together``: for a list of
    shapes, or None for each that is none."""
    fields = [df.schema["id"], T.StructField("geom", GEOMETRY), T.StructField("status", T.StringType()), *extra]
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            read = shapes.read(batch.column("geom"))
            found = work(list(read)) if together else [(None,) * (1 + len(extra)) if s is None else work(s) for s in read]
            values = list(zip(*found)) if found else [()] * (1 + len(extra))
            status = ["unsupported" if g is None else "ok" for g in values[0]]
            columns = [batch.column("id"), pa.array(values[0], shapes.ARROW), pa.array(status, pa.string()), *[pa.array(v, pa.int64()) for v in values[1:]]]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return spread(df.select("id", "geom")).mapInArrow(run, T.StructType(fields))


def outer(g: Column) -> Column:
    """The outer ring of a single polygon without holes, else NULL."""
    rings = F.get(g["parts"], F.lit(0))
    return F.when((g["kind"] == "polygon") & (F.size(g["parts"]) == 1) & (F.size(rings) == 1), F.get(rings, F.lit(0)))


def buffer(df: DataFrame, metres: float, meta: LayerMeta, segments: int = 8) -> DataFrame:
    """id, geom, status: shapes grown by a length; each circle has 4 * segments sides."""
    strategy, _ = metric_plan(meta, None, metres)
    reach = metres / to_metres(1, meta.unit) if strategy == "map_units" else metres

    turn = 2 * np.pi * np.arange(4 * segments) / (4 * segments)
    circle = reach * np.stack([np.cos(turn), np.sin(turn)], axis=1)

    def plain(s: shapes.Shape) -> np.ndarray | None:
        """The ring of a point or a convex polygon."""
        ring = s.parts[0][0] if len(s.parts) == 1 and len(s.parts[0]) == 1 else None
        return ring if ring is not None and (s.dim == 0 or s.dim == 2 and planar.is_convex(ring[:-1].tolist())) else None

    def grow(found: list[shapes.Shape | None]) -> list[tuple]:
        """Plain shapes become the hulls of circles around their vertices, many at once."""
        rings = [None if s is None else plain(s) for s in found]
        out = [(None,) if s is None or r is not None else (shapes.written(shapes.grown(s, reach, segments)),) for s, r in zip(found, rings)]
        at = np.array([i for i, r in enumerate(rings) if r is not None], np.int64)
        for some in np.split(at, np.flatnonzero(np.diff(np.cumsum([len(rings[i]) for i in at]) * len(circle) // sweep.BLOCK)) + 1) if len(at) else ():
            dots = np.concatenate([rings[i] for i in some])[:, None] + circle
            of = np.repeat(some, [len(rings[i]) * len(circle) for i in some])
            of, x, y = planar.hulls(of, dots[:, :, 0].ravel(), dots[:, :, 1].ravel())
            corners = np.stack([x, y], axis=1)
            for hull, i in zip(np.split(corners, np.flatnonzero(np.diff(of)) + 1), some.tolist()):
                out[i] = (shapes.written([[np.vstack([hull, hull[:1]])]]),)
        return out

    return _mapped(df, grow, together=True)


def _line(s: shapes.Shape, parts: list) -> dict:
    """A geometry value of the same kind with other vertices."""
    return {"kind": s.kind, "parts": [[[{"x": x, "y": y} for x, y in r.tolist()] for r in p] for p in parts]}


def simplify(df: DataFrame, tolerance: float, meta: LayerMeta) -> DataFrame:
    """id, geom, status, before, after: every line and ring by itself by Douglas-Peucker, the tolerance in metres. Holes that
    collapse go; an outer ring that would collapse stays as it is. before and after count vertices."""
    metric_plan(meta, None, tolerance)
    limit = tolerance / to_metres(1, meta.unit)

    def thin(s: shapes.Shape) -> tuple:
        if s.dim == 0:
            return _line(s, s.parts), len(s.points), len(s.points)
        parts = []
        for p in s.parts:
            slim = [np.array(planar.simplify(list(map(tuple, r.tolist())), limit)) for r in p]
            if s.dim == 2:
                slim = [r if len(r) > 3 else p[0] if k == 0 else None for k, r in enumerate(slim)]
            parts.append([r for r in slim if r is not None])
        return _line(s, parts), len(s.points), sum(len(r) for p in parts for r in p)

    return _mapped(df, thin, [T.StructField("before", T.LongType()), T.StructField("after", T.LongType())])


def clip(left: DataFrame, right: DataFrame) -> DataFrame:
    """id, geom, status: each left polygon, line or point cut to the extent of the right layer; what lies outside goes."""
    box = _extent(right)
    if box is None:
        raise Refused("the layer to clip by has no extent")
    x0, y0, x1, y1 = box
    frame = shapes.Shape("polygon", [[np.array([(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)], float)]])

    def cut(s: shapes.Shape) -> tuple:
        if not len(s.points):
            return ({"kind": s.kind, "parts": []},)
        lo, hi = s.points.min(axis=0), s.points.max(axis=0)
        if lo[0] >= x0 and lo[1] >= y0 and hi[0] <= x1 and hi[1] <= y1:
            return (_line(s, s.parts),)
        if s.dim == 2:
            parts = shapes.overlay(s, frame, "intersection")
            return (None if parts is None else shapes.written(parts) or {"kind": s.kind, "parts": []},)
        if s.dim == 0:
            kept = s.points[shapes.located(s.points, frame) != shapes.OUT]
            return ({"kind": s.kind, "parts": [[[{"x": x, "y": y}]] for x, y in kept.tolist()]},)
        split = shapes.Split(s, frame)
        return ({"kind": "multilinestring", "parts": [[[{"x": x, "y": y} for x, y in line]] for line in _joined(split.a[split.codes_a != shapes.OUT].tolist())]},)

    return _mapped(left, cut).filter("geom is null or size(geom.parts) > 0")


def _joined(pieces: list) -> list[list[tuple]]:
    """Pieces of lines in their order, put together where one begins at the end of the one before."""
    lines: list[list[tuple]] = []
    for ax, ay, bx, by in pieces:
        if lines and lines[-1][-1] == (ax, ay):
            lines[-1].append((bx, by))
        else:
            lines.append([(ax, ay), (bx, by)])
    return lines


# ---- overlays of two layers --------------------------------------------------------------------------------------


class Shared:
    """Pairs of polygons that share an area, and what they share; NULL where that can't be told."""

    value = GEOMETRY

    def __call__(self, a: Shapes, b: Shapes, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, list]:
        if not len(i):
            return np.zeros(0, bool), []
        at, found = [], []
        p, q = _upright(a), _upright(b)
        both = np.hstack([np.maximum(p[i, :2], q[j, :2]), np.minimum(p[i, 2:4], q[j, 2:4])])
        boxes = np.flatnonzero((p[i, 4] > 0) & (q[j, 4] > 0) & (both[:, :2] < both[:, 2:]).all(axis=1))
        at.append(boxes), found.append(_rectangles(both[boxes]))
        rest = np.setdiff1d(np.arange(len(i)), boxes)
        (fa, ia), (fb, jb) = many.flat(a, i[rest]), many.flat(b, j[rest])
        fit, blocks = many.together(fa, fb, ia, jb)
        for some in blocks:  # polygons of few sides
            rings = many.shared(fa, fb, ia[some], jb[some])
            told = np.flatnonzero(rings.open | (np.bincount(rings.key, minlength=rings.n) > 0))
            at.append(rest[some[told]]), found.append(rings.shapes(told))
        values, alone = [], []
        for k in rest[~fit].tolist():
            x, y = a[i[k]], b[j[k]]
            parts = shapes.overlay(x, y, "intersection") if x.dim == y.dim == 2 else None
            if parts is None and (x.dim != 2 or y.dim != 2) and not shapes.Relation(x, y).meets:
                continue
            if parts is None or parts:
                alone.append(k)
                values.append(shapes.written(parts))
        at.append(np.array(alone, np.int64)), found.append(pa.array(values, shapes.ARROW))
        at = np.concatenate(at)
        keep = np.zeros(len(i), bool)
        keep[at] = True
        return keep, pa.concat_arrays(found).take(pa.array(np.argsort(at, kind="stable")))


def _rectangles(box: np.ndarray) -> pa.StructArray:
    """Polygons of x0, y0, x1, y1."""
    n = len(box)
    corners = box[:, [0, 1, 2, 1, 2, 3, 0, 3, 0, 1]].reshape(-1, 2)
    edges = lambda k: pa.array(np.arange(0, k * n + 1, k), pa.int32())
    dots = pa.StructArray.from_arrays([pa.array(corners[:, 0]), pa.array(corners[:, 1])], fields=list(shapes.ARROW.field("parts").type.value_type.value_type.value_type))
    line = pa.ListArray.from_arrays(edges(1), pa.ListArray.from_arrays(edges(5), dots))
    return pa.StructArray.from_arrays([pa.repeat("polygon", n), pa.ListArray.from_arrays(edges(1), line)], fields=list(shapes.ARROW))


class Lines:
    """Pairs that meet, and the right shape."""

    value = GEOMETRY

    def __call__(self, a: Shapes, b: Shapes, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, list]:
        keep = np.array([shapes.Relation(a[x], b[y]).meets for x, y in zip(i, j)], bool)
        return keep, [_line(b[y], b[y].parts) for y in j[keep]]


def _shared(left: DataFrame, right: DataFrame) -> DataFrame:
    met = pairs(left.select("id", "geom"), right.select("id", "geom"), kernel=Shared())
    return met.select(F.col("l.id").alias("id"), F.col("r.id").alias("id_2"), F.col("value").alias("geom"))


def _told(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns, "geom", F.when(F.col("geom").isNull(), "unsupported").otherwise("ok").alias("status"))


def intersection(left: DataFrame, right: DataFrame) -> DataFrame:
    """id, id_2, geom, status: what each pair shares."""
    return _told(_shared(left, right), "id", "id_2")


def _applied(left: DataFrame, others: DataFrame, begin: Callable, step: Callable) -> DataFrame:
    """id, piece, geom, status of each left shape after ``step`` with each of its others (id, geom), one after the other: a
    shape and its others follow each other in a partition, and only what is left of the shape is held."""
    spoken = left.select("id", F.lit(0).alias("turn"), "geom").union(others.select("id", F.lit(1).alias("turn"), "geom"))
    line = spoken.withColumn("order", F.xxhash64(F.to_json("geom"))).repartition("id").sortWithinPartitions("id", "turn", "order").select("id", "turn", "geom")
    schema = T.StructType([left.schema["id"], T.StructField("piece", T.IntegerType()), T.StructField("geom", GEOMETRY)])
    kind = pa.schema([("piece", pa.int32()), ("geom", shapes.ARROW)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, state = None, None

        def given() -> pa.RecordBatch:
            rows = [None] if state is None else [shapes.written(p) for p in state]
            ids = pa.repeat(one, len(rows))
            return pa.RecordBatch.from_arrays([ids, pa.array(range(len(rows)), kind.field("piece").type), pa.array(rows, shapes.ARROW)], names=["id", "piece", "geom"])

        for batch in batches:
            for i, (turn, shape) in enumerate(zip(batch.column("turn").to_pylist(), shapes.read(batch.column("geom")))):
                if turn == 0:
                    if one is not None:
                        yield given()
                    one, state = batch.column("id")[i], None if shape is None or shape.dim != 2 else begin(shape)
                elif state is not None:
                    state = None if shape is None else step(state, shape)
        if one is not None:
            yield given()

    return _told(line.mapInArrow(run, schema), "id", "piece")


def _cut(pieces: list, line: shapes.Shape) -> list | None:
    done = [shapes.cut(shapes.Shape("multipolygon", p), line) for p in pieces]
    return None if any(d is None for d in done) else [p for d in done for p in d]


def _rest(left: DataFrame, shared: DataFrame) -> DataFrame:
    """id, piece, geom, status: the parts of each left shape outside what it shares (id, geom; NULL where that can't be told)."""
    polygon = F.col("geom.kind").isin("polygon", "multipolygon")
    said = stored(shared.groupBy(F.col("id").alias("_id")).agg(F.bool_and(F.col("geom").isNotNull()).alias("_known")), "partners")
    both = stored(left.select("id", "geom").join(said, F.col("id") == F.col("_id"), "left"), "shapes")
    alone = both.filter(polygon & F.col("_id").isNull()).select("id", F.posexplode("geom.parts").alias("piece", "part"))
    alone = alone.select("id", "piece", geom.geometry("polygon", F.array("part")).alias("geom"))
    cut = both.filter(polygon & F.col("_known")).select("id", "geom")
    cut = without(cut, shared.join(both.filter(polygon & F.col("_known")).select(F.col("id").alias("_id")), F.col("id") == F.col("_id"), "left_semi"))
    unknown = both.filter(~F.coalesce(polygon, F.lit(False)) | ~F.coalesce("_known", F.lit(True))).select("id", F.lit(0).alias("piece"), F.lit(None).cast(GEOMETRY).alias("geom"))
    return _told(alone.union(cut).union(unknown), "id", "piece")


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """id, piece, geom, status: the parts of each left shape outside all right ones. Neither is gathered by shape."""
    return _rest(left, stored(_shared(left, right), "shared"))


def split(left: DataFrame, lines: DataFrame) -> DataFrame:
    """id, piece, geom, status: each left shape cut by the stretches of lines that go all the way through it."""
    met = pairs(left.select("id", "geom"), lines.select("geom"), kernel=Lines())
    return _applied(left, met.select(F.col("l.id").alias("id"), F.col("value").alias("geom")), lambda s: [s.parts], _cut)


def union(left: DataFrame, right: DataFrame) -> DataFrame:
    """id, id_2, piece, geom, status: shared parts with both ids, the rest of each side with one. One join."""
    both = stored(_shared(left, right), "shared")
    none = F.lit(None)
    a = _rest(left, both.select("id", "geom"))
    b = _rest(right, both.select(F.col("id_2").alias("id"), "geom"))
    shared = _told(both, "id", "id_2").withColumn("piece", F.lit(0))
    a = a.select("id", none.cast(right.schema["id"].dataType).alias("id_2"), "piece", "geom", "status")
    b = b.select(none.cast(left.schema["id"].dataType).alias("id"), F.col("id").alias("id_2"), "piece", "geom", "status")
    return shared.select("id", "id_2", "piece", "geom", "status").union(a).union(b)


# ---- groups ------------------------------------------------------------------------------------------------------


def convex_hull(df: DataFrame, group: str) -> DataFrame:
    """group, vertices, geom: a hull a group. Each batch sends the hulls of its own groups on, all of them found at once, so a group's
    rows never gather; what is left goes by hash, many groups to a task."""

    def cut(rows: pa.RecordBatch) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
        """Hulls of the batch's groups: the groups, and of each corner its group's number, x and y."""
        g = rows.column("g").dictionary_encode(null_encoding="encode")
        of, x, y = planar.hulls(g.indices.to_numpy(), rows.column("x").to_numpy(zero_copy_only=False), rows.column("y").to_numpy(zero_copy_only=False))
        return g.dictionary, of, x, y

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                names, of, x, y = cut(batch)
                yield pa.RecordBatch.from_arrays([names.take(pa.array(of)), pa.array(x), pa.array(y)], names=["g", "x", "y"])

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Groups stand together in a sorted partition; the last one of a batch may go on, with its hull so far."""

        def written(names: pa.Array, of: np.ndarray, x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
            first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            n = np.diff(np.append(first, len(of)))
            # every ring ends where it began
            at = np.insert(np.arange(len(of)), first + n, first)
            edges = np.concatenate([[0], np.cumsum(n + 1)])
            dots = pa.StructArray.from_arrays([pa.array(x[at]), pa.array(y[at])], names=["x", "y"])
            rings = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), dots)
            return pa.RecordBatch.from_arrays([names.take(pa.array(of[first])), pa.array(n, pa.int64()), rings], names=["group", "vertices", "ring"])

        held: pa.RecordBatch | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            whole = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            names, of, x, y = cut(whole)
            last = of == len(names) - 1
            if not last.all():
                yield written(names, of[~last], x[~last], y[~last])
            held = pa.RecordBatch.from_arrays([names.take(pa.array(of[last])), pa.array(x[last]), pa.array(y[last])], schema=batch.schema)
        if held is not None:
            yield written(*cut(held))

    flat = df.select(F.col(group).cast("string").alias("g"), F.explode(geom.vertices(F.col("geom"))).alias("v")).select("g", "v.x", "v.y")
    small = flat.mapInArrow(partial, "g string, x double, y double")
    hulls = small.repartition("g").sortWithinPartitions("g").mapInArrow(final, "group string, vertices long, ring array<struct<x:double,y:double>>")
    return hulls.select("group", "vertices", geom.geometry("polygon", F.array(F.array("ring"))).alias("geom"))


# ---- validity ----------------------------------------------------------------------------------------------------


def crosses_itself(ring: np.ndarray) -> bool:
    """Two sides that are no neighbours cross; only sides whose boxes meet are compared."""
    s = np.hstack([ring[:-1], ring[1:]])
    s = s[(s[:, 0] != s[:, 2]) | (s[:, 1] != s[:, 3])]
    box, n = sweep.boxes_of(s), len(s)
    for i, j in sweep.meeting(box, box):
        apart = np.abs(i - j)
        i, j = i[(apart > 1) & (apart < n - 1)], j[(apart > 1) & (apart < n - 1)]
        side = lambda p, x, y: np.sign((p[:, 2] - p[:, 0]) * (y - p[:, 1]) - (p[:, 3] - p[:, 1]) * (x - p[:, 0]))
        p, q = s[i], s[j]
        if ((side(p, q[:, 0], q[:, 1]) * side(p, q[:, 2], q[:, 3]) < 0) & (side(q, p[:, 0], p[:, 1]) * side(q, p[:, 2], p[:, 3]) < 0)).any():
            return True
    return False


def _ring_problems(xy: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each ring (edges: where its vertices begin and end): too few points, unclosed, sides that cross, no area. Rings of a few
    sides are looked at all together, longer ones by themselves."""
    n = np.diff(edges)
    few = n < 4
    first, last = np.where(n > 0, edges[:-1], 0), np.where(n > 0, edges[1:] - 1, 0)
    open_ = (n > 0) & (xy[first] != xy[last]).any(axis=1) if len(xy) else np.zeros(len(n), bool)
    area, crossing = np.zeros(len(n)), np.zeros(len(n), bool)
    for size, some, r in _of_one_size(xy, edges):
        x, y = r[:, :, 0] - r[:, :1, 0], r[:, :, 1] - r[:, :1, 1]
        area[some] = (x[:, :-1] * y[:, 1:] - x[:, 1:] * y[:, :-1]).sum(axis=1) / 2
    # sides without length count for nothing, also not between their neighbours
    fresh = np.ones(len(xy), bool)
    fresh[1:] = (xy[1:] != xy[:-1]).any(axis=1)
    fresh[edges[:-1][n > 0]] = True
    slim = np.concatenate([[0], np.cumsum(fresh)])[edges]
    for size, some, r in _of_one_size(xy[fresh], slim):
        crossing[some] = _cross_themselves(r) if size <= shapes.FEW_SIDES else [crosses_itself(one) for one in r]
    return few, open_, crossing, area == 0


def _of_one_size(xy: np.ndarray, edges: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Rings of the same number of vertices, some at a time: the number, which they are, rings x vertices x 2."""
    n = np.diff(edges)
    for size in np.unique(n[n > 0]).tolist():
        these = np.flatnonzero(n == size)
        step = max(1, sweep.BLOCK // (size * min(size, shapes.FEW_SIDES)))
        for lo in range(0, len(these), step):
            some = these[lo : lo + step]
            yield size, some, xy[edges[some][:, None] + np.arange(size)]


def _cross_themselves(r: np.ndarray) -> np.ndarray:
    """``crosses_itself`` of rings of the same few vertices (rings x vertices x 2), whose sides all have a length."""
    n = r.shape[1] - 1
    i, j = np.triu_indices(n, 2)
    i, j = i[j - i < n - 1], j[j - i < n - 1]
    a, b = r[:, :-1], r[:, 1:]

    def side(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        d, e = b[:, p] - a[:, p], q - a[:, p]
        return np.sign(d[:, :, 0] * e[:, :, 1] - d[:, :, 1] * e[:, :, 0])

    return ((side(i, a[:, j]) * side(i, b[:, j]) < 0) & (side(j, a[:, i]) * side(j, b[:, i]) < 0)).any(axis=1)


def validate(df: DataFrame) -> DataFrame:
    """id, problem: of polygons with a short or unclosed ring, no area, or sides that cross; none if all pass."""
    schema = T.StructType([df.schema["id"], T.StructField("problem", T.StringType())])

    names = np.array(["too_few_points", "unclosed", "self_crossing", "zero_area"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xy, line_edges, shape_of = shapes.flat(batch.column("geom"))
            bad = np.stack(_ring_problems(xy, line_edges))
            # the first check that any of a shape's rings fails
            fails = np.zeros((len(names), batch.num_rows), bool)
            for k in range(len(names)):
                fails[k, shape_of[bad[k]]] = True
            at = np.flatnonzero(fails.any(axis=0))
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(at)), pa.array(names[fails[:, at].argmax(axis=0)].tolist(), pa.string())], names=["id", "problem"])

    polygons = df.filter(F.col("geom.kind").isin("polygon", "multipolygon")).select("id", "geom")
    return spread(polygons).mapInArrow(run, schema)


def _repaired_ring(ring: Column, hole: Column) -> Column:
    single = F.filter(ring, lambda p, i: (i == 0) | (p != F.get(ring, F.greatest(i - 1, F.lit(0)))))
    closed = F.when(F.get(single, F.lit(0)) == F.element_at(single, -1), single).otherwise(F.concat(single, F.slice(single, 1, 1)))
    return F.when((geom.ring_area(closed) < 0) != hole, F.reverse(closed)).otherwise(closed)


def repair(df: DataFrame) -> DataFrame:
    """Rings closed, repeats dropped, outer rings counter-clockwise and holes clockwise, rings without area dropped.
    ``fixed`` says whether anything changed; crossing sides are left for validate to report."""
    parts = F.transform(F.col("geom.parts"), lambda rings: F.filter(F.transform(rings, lambda r, i: _repaired_ring(r, i > 0)), lambda r: F.abs(geom.ring_area(r)) > 0))
    fixed = F.struct(F.col("geom.kind").alias("kind"), F.filter(parts, lambda p: F.size(p) > 0).alias("parts"))
    out = df.filter(F.col("geom.kind").isin("polygon", "multipolygon")).withColumn("_new", fixed)
    return out.withColumn("fixed", F.col("_new") != F.col("geom")).withColumn("geom", F.col("_new")).drop("_new")
