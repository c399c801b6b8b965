"""Terrain on a table of cells (raster_id, row, col, z): 3 x 3 neighbourhoods by tiles with a halo of one cell, contours by marching squares, drainage by eight directions. Edge cells use their own value for
missing neighbours. Formulas: Horn 1981 (slope, aspect, hillshade), Riley 1999 (ruggedness), max - min (roughness)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoanswers.meta import LayerMeta, Refused
from geoanswers.sources.tables import Scratch, stored

#: Cells along a tile's side.
SIDE = 128
#: Offsets (row, col); rows go down.
_AROUND = [(-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 0), (0, 1), (1, -1), (1, 0), (1, 1)]
_NAMES = ["a", "b", "c", "d", "e", "f", "g", "h", "i"]


def _check(meta: LayerMeta | None, z_factor: float, needs_metres: bool) -> None:
    if needs_metres and meta and meta.geographic:
        raise Refused("a slope on a raster in degrees")
    if not 0 < z_factor <= 1000:
        raise Refused("z_factor is above 0 and at most 1000")


def _by_tile(work):
    """``work`` on the rows of each tile, from batches in which a tile's rows stand together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key = None
        for batch in batches:
            if not batch.num_rows:
                continue
            raster = batch.column("raster_id").dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            ty, tx = batch.column("ty").to_numpy(), batch.column("tx").to_numpy()
            edges = np.flatnonzero((raster[1:] != raster[:-1]) | (ty[1:] != ty[:-1]) | (tx[1:] != tx[:-1])) + 1
            for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows]):
                this = (batch.column("raster_id")[lo].as_py(), int(ty[lo]), int(tx[lo]))
                if held and this != key:
                    yield work(pa.Table.from_batches(held))
                    held = []
                key = this
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield work(pa.Table.from_batches(held))

    return run


def _windows(cells: DataFrame) -> DataFrame:
    """raster_id, row, col and the nine values a..i around each cell that has a value, NULL where there is none.

    Cells are dealt into tiles of SIDE x SIDE; those at a tile's edge go to the neighbouring tile too (about 1 + 4 / SIDE rows a
    cell are shuffled). A tile is one array; the values around all its cells are nine cut-outs of it. Of several values of one
    cell the largest counts."""
    row, col = F.col("row").cast("long"), F.col("col").cast("long")
    tiles = lambda c: F.explode(F.sequence(F.floor((c - 1) / SIDE), F.floor((c + 1) / SIDE)))
    some = cells.filter("z is not null").select("raster_id", row.alias("row"), col.alias("col"), F.col("z").cast("double").alias("z"))
    dealt = some.withColumn("ty", tiles(F.col("row"))).withColumn("tx", tiles(F.col("col")))
    line = dealt.repartition("raster_id", "ty", "tx").sortWithinPartitions("raster_id", "ty", "tx")
    types = [cells.schema["raster_id"], T.StructField("row", cells.schema["row"].dataType), T.StructField("col", cells.schema["col"].dataType)]
    kinds = [pa.int32() if isinstance(t.dataType, T.IntegerType) else pa.int64() for t in types[1:]]
    return line.mapInArrow(_around(kinds), T.StructType(types + [T.StructField(n, T.DoubleType()) for n in _NAMES]))


def _around(kinds: list[pa.DataType]):
    def work(rows: pa.Table) -> pa.RecordBatch:
        """A whole tile."""
        r, c, z, ty, tx = (rows.column(k).to_numpy() for k in ("row", "col", "z", "ty", "tx"))
        y0, x0 = ty[0] * SIDE, tx[0] * SIDE
        grid, known = np.full((SIDE + 2, SIDE + 2), -np.inf), np.zeros((SIDE + 2, SIDE + 2), bool)
        y, x = r - y0 + 1, c - x0 + 1
        np.maximum.at(grid, (y, x), z)
        known[y, x] = True
        y, x = np.nonzero(known[1:-1, 1:-1])
        columns = []
        for dr, dc in _AROUND:
            at = (y + 1 + dr, x + 1 + dc)
            columns.append(pa.array(grid[at], mask=~known[at]))
        raster = pa.concat_arrays([rows.column("raster_id").chunk(0).slice(0, 1)]).take(pa.array(np.zeros(len(y), np.int64)))
        place = [pa.array(y + y0).cast(kinds[0]), pa.array(x + x0).cast(kinds[1])]
        return pa.RecordBatch.from_arrays([raster, *place, *columns], names=["raster_id", "row", "col", *_NAMES])

    return _by_tile(work)


def neighbourhood(cells: DataFrame) -> DataFrame:
    """raster_id, row, col and the nine values a..i; a missing neighbour has the cell's own value."""
    return _windows(cells).select("raster_id", "row", "col", *[F.coalesce(n, "e").alias(n) for n in _NAMES])


def _gradients(cell: float, z_factor: float) -> tuple[Column, Column]:
    c = {n: F.col(n) for n in _NAMES}
    east = ((c["c"] + 2 * c["f"] + c["i"]) - (c["a"] + 2 * c["d"] + c["g"])) * z_factor / (8 * cell)
    down = ((c["g"] + 2 * c["h"] + c["i"]) - (c["a"] + 2 * c["b"] + c["c"])) * z_factor / (8 * cell)
    return east, down


def slope(cells: DataFrame, cell: float, z_factor: float = 1.0, meta: LayerMeta | None = None) -> DataFrame:
    """Degrees from the level."""
    _check(meta, z_factor, True)
    x, y = _gradients(cell, z_factor)
    return neighbourhood(cells).select("raster_id", "row", "col", F.degrees(F.atan(F.hypot(x, y))).alias("slope"))


def _aspect(x: Column, y: Column) -> Column:
    return F.when((x == 0) & (y == 0), F.lit(-1.0)).otherwise(F.pmod(90 - F.degrees(F.atan2(y, -x)) + 360, F.lit(360.0)))


def aspect(cells: DataFrame, cell: float, z_factor: float = 1.0, meta: LayerMeta | None = None) -> DataFrame:
    """Compass direction of descent in degrees; -1 where level."""
    _check(meta, z_factor, True)
    x, y = _gradients(cell, z_factor)
    return neighbourhood(cells).select("raster_id", "row", "col", _aspect(x, y).alias("aspect"))


def hillshade(cells: DataFrame, cell: float, z_factor: float = 1.0, azimuth: float = 315, altitude: float = 45, meta: LayerMeta | None = None) -> DataFrame:
    """Light from 0 to 255."""
    _check(meta, z_factor, True)
    x, y = _gradients(cell, z_factor)
    steep, facing = F.atan(F.hypot(x, y)), F.radians(_aspect(x, y))
    zenith = math.radians(90 - altitude)
    light = math.cos(zenith) * F.cos(steep) + math.sin(zenith) * F.sin(steep) * F.cos(F.lit(math.radians(azimuth)) - facing)
    return neighbourhood(cells).select("raster_id", "row", "col", (255 * F.greatest(light, F.lit(0.0))).alias("hillshade"))


def ruggedness(cells: DataFrame) -> DataFrame:
    """Root of the summed squared differences to the eight neighbours."""
    total = sum(((F.col(n) - F.col("e")) * (F.col(n) - F.col("e")) for n in _NAMES if n != "e"), F.lit(0.0))
    return neighbourhood(cells).select("raster_id", "row", "col", F.sqrt(total).alias("ruggedness"))


def roughness(cells: DataFrame) -> DataFrame:
    return neighbourhood(cells).select("raster_id", "row", "col", (F.greatest(*_NAMES) - F.least(*_NAMES)).alias("roughness"))


def contours(cells: DataFrame, interval: float) -> DataFrame:
    """level, x1, y1, x2, y2: marching squares over each 2 x 2 of neighbours (saddles: the two segments that keep the
    middle with the higher corners apart)."""
    if interval <= 0:
        raise Refused("the interval is above 0")
    corners = [F.col(n).alias(f"z{k}") for k, n in enumerate("efhi")]
    quad = _windows(cells).select("raster_id", "row", "col", *corners).filter("z1 is not null and z2 is not null and z3 is not null")
    low, high = F.ceil(F.least("z0", "z1", "z2", "z3") / interval), F.floor(F.greatest("z0", "z1", "z2", "z3") / interval)
    steps = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))
    levels = quad.withColumn("level", F.explode(F.transform(steps, lambda k: k * F.lit(float(interval)))))
    corner = {0: (0, 0), 1: (0, 1), 3: (1, 1), 2: (1, 0)}
    ring = [0, 1, 3, 2]

    def crossing(p: int, q: int) -> Column:
        zp, zq, (rp, cp), (rq, cq) = F.col(f"z{p}"), F.col(f"z{q}"), corner[p], corner[q]
        t = (F.col("level") - zp) / (zq - zp)
        return F.when((zp >= F.col("level")) != (zq >= F.col("level")), F.struct((F.col("col") + cp + t * (cq - cp)).alias("x"), (F.col("row") + rp + t * (rq - rp)).alias("y")))

    points = F.filter(F.array(*[crossing(ring[i], ring[(i + 1) % 4]) for i in range(4)]), lambda p: p.isNotNull())
    out = levels.withColumn("p", points).filter(F.size("p") >= 2)
    pair = lambda i, j: F.struct(F.get("p", F.lit(i)).alias("a"), F.get("p", F.lit(j)).alias("b"))
    middle = (F.col("z0") + F.col("z1") + F.col("z2") + F.col("z3")) / 4 >= F.col("level")
    turn = middle == (F.col("z0") >= F.col("level"))
    both = F.when(F.size("p") == 2, F.array(pair(0, 1))).when(turn, F.array(pair(0, 1), pair(2, 3))).otherwise(F.array(pair(3, 0), pair(1, 2)))
    return out.select("raster_id", "level", F.explode(both).alias("s")).select("raster_id", "level", F.col("s.a.x").alias("x1"), F.col("s.a.y").alias("y1"), F.col("s.b.x").alias("x2"), F.col("s.b.y").alias("y2"))


def directions(cells: DataFrame) -> DataFrame:
    """raster_id, row, col, to_row, to_col: the steepest lower neighbour (ties: first in reading order); NULL in a pit."""
    drop = [F.struct((F.when(F.lit(dr * dc != 0), 1 / math.sqrt(2)).otherwise(1.0) * (F.col("e") - F.col(n))).alias("drop"), F.lit(-k).alias("k"), F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for k, ((dr, dc), n) in enumerate(zip(_AROUND, _NAMES)) if n != "e"]
    best = F.array_max(F.array(*drop))
    out = neighbourhood(cells).withColumn("m", best)
    down = F.col("m.drop") > 0
    return out.select("raster_id", "row", "col", F.when(down, F.col("row") + F.col("m.dr")).alias("to_row"), F.when(down, F.col("col") + F.col("m.dc")).alias("to_col"))


def _ways(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a tile's cells (row, col, ty, tx, and ``down``, the place in _AROUND of the neighbour it drains to, NULL in a pit): the
    place of the next cell in the tile (its own where the way ends or leaves), the next cell's row and column, and down."""
    r, c, ty, tx = (rows.column(k).to_numpy().astype(np.int64) for k in ("row", "col", "ty", "tx"))
    down = rows.column("down").fill_null(-1).to_numpy().astype(np.int64)
    step, grid, n = np.array(_AROUND), np.full((SIDE, SIDE), -1), np.arange(len(r))
    y, x = r - ty[0] * SIDE, c - tx[0] * SIDE
    grid[y, x] = n
    to_y, to_x = np.where(down < 0, y, y + step[down, 0]), np.where(down < 0, x, x + step[down, 1])
    inside = (to_y >= 0) & (to_y < SIDE) & (to_x >= 0) & (to_x < SIDE)
    follow = np.where(inside, grid[np.clip(to_y, 0, SIDE - 1), np.clip(to_x, 0, SIDE - 1)], n)
    return follow, to_y + ty[0] * SIDE, to_x + tx[0] * SIDE, down


def _through(follow: np.ndarray, start: np.ndarray) -> np.ndarray:
    """For each cell ``start`` and, for every cell that drains to it, one and what drains through that one. Senders first: a cell
    is added to the next one after all of its own have come."""
    n = np.arange(len(follow))
    waits, total = np.bincount(follow[follow != n], minlength=len(n)), start.copy()
    ready = np.flatnonzero(waits == 0)
    while len(ready):
        ready = ready[follow[ready] != ready]
        to = follow[ready]
        np.add.at(total, to, total[ready] + 1)
        np.subtract.at(waits, to, 1)
        to = np.unique(to)
        ready = to[waits[to] == 0]
    return total


def _drained(kinds: list[pa.DataType]):
    """Of each cell of a tile of directions where its way ends, and how many of the tile's cells drain through it."""

    def work(rows: pa.Table) -> pa.RecordBatch:
        follow, to_y, to_x, down = _ways(rows)
        last = follow
        while (last[last] != last).any():
            last = last[last]
        place = [rows.column(k).combine_chunks() for k in ("raster_id", "row", "col", "down")]
        ends = [pa.array(to_y[last]).cast(kinds[0]), pa.array(to_x[last]).cast(kinds[1])]
        flags = [pa.array(down[last] < 0), pa.array(last == np.arange(len(last))), pa.array(_through(follow, np.zeros(len(last), np.int64)))]
        return pa.RecordBatch.from_arrays([*place, *ends, *flags], names=["raster_id", "row", "col", "down", "end_row", "end_col", "pit", "is_last", "n"])

    return _by_tile(work)


def _accumulated(rows: pa.Table) -> pa.RecordBatch:
    follow = _ways(rows)[0]
    total = _through(follow, rows.column("inflow").to_numpy())
    return pa.RecordBatch.from_arrays([*[rows.column(k).combine_chunks() for k in ("raster_id", "row", "col")], pa.array(total)], names=["raster_id", "row", "col", "upstream"])


def _tiled(df: DataFrame, *columns: str) -> DataFrame:
    tile = lambda c: F.floor(F.col(c).cast("long") / SIDE).cast("long")
    line = df.select("raster_id", "row", "col", *columns, tile("row").alias("ty"), tile("col").alias("tx"))
    return line.repartition("raster_id", "ty", "tx").sortWithinPartitions("raster_id", "ty", "tx")


def _tile_drainage(cells: DataFrame) -> DataFrame:
    """raster_id, row, col, down; end_row, end_col: where the cell's way through its tile ends, in a pit (``pit``) or in the first
    cell of the next tile; is_last: the cell is the last one of its way in the tile; n: cells of the tile that drain through it."""
    drop = [F.struct((F.when(F.lit(dr * dc != 0), 1 / math.sqrt(2)).otherwise(1.0) * (F.col("e") - F.col(n))).alias("drop"), F.lit(-k).alias("k")) for k, ((dr, dc), n) in enumerate(zip(_AROUND, _NAMES)) if n != "e"]
    out = neighbourhood(cells).withColumn("m", F.array_max(F.array(*drop)))
    out = out.withColumn("down", F.when(F.col("m.drop") > 0, -F.col("m.k")).cast("int"))
    place = [T.StructField(k, cells.schema[k].dataType) for k in ("row", "col")]
    kinds = [pa.int32() if isinstance(f.dataType, T.IntegerType) else pa.int64() for f in place]
    ends = [T.StructField(f"end_{f.name}", f.dataType) for f in place]
    more = [T.StructField("pit", T.BooleanType()), T.StructField("is_last", T.BooleanType()), T.StructField("n", T.LongType())]
    return _tiled(out, "down").mapInArrow(_drained(kinds), T.StructType([cells.schema["raster_id"], *place, T.StructField("down", T.IntegerType()), *ends, *more]))


def _entries(every: DataFrame) -> DataFrame:
    """The cells by which ways come into a tile, with where they end in it."""
    into = every.filter("not pit").select("raster_id", F.col("end_row").alias("row"), F.col("end_col").alias("col")).distinct()
    return every.select("raster_id", "row", "col", "end_row", "end_col", "pit").join(into, ["raster_id", "row", "col"])


def watershed(cells: DataFrame, most_rounds: int = 64) -> DataFrame:
    """raster_id, row, col, pit_row, pit_col: where each cell drains to. Ways are followed inside tiles first; pointers are doubled
    (log rounds over written tables) only over the cells by which ways come into a tile, and every cell looks up the one its way
    leaves its tile for. A round's table goes when the next is written."""
    every = stored(_tile_drainage(cells).select("raster_id", "row", "col", "end_row", "end_col", "pit"), "drainage")
    met = ~F.col("pit") & (F.col("raster_id") == F.col("_r")) & (F.col("end_row") == F.col("_y")) & (F.col("end_col") == F.col("_x"))
    named = lambda df: df.select(F.col("raster_id").alias("_r"), F.col("row").alias("_y"), F.col("col").alias("_x"), F.col("end_row").alias("_ey"), F.col("end_col").alias("_ex"), F.col("pit").alias("_pit"))
    ends = [F.coalesce("_ey", "end_row"), F.coalesce("_ex", "end_col")]
    with Scratch(cells.sparkSession) as own:
        now = stored(_entries(every), "entries")
        for _ in range(most_rounds):
            if now.filter("not pit").isEmpty():
                break
            last = own.mark()
            step = now.join(named(now), met, "left")
            now = stored(step.select("raster_id", "row", "col", ends[0].alias("end_row"), ends[1].alias("end_col"), F.coalesce("_pit", "pit").alias("pit")), "entries")
            own.discard(last)
        else:
            raise RuntimeError("drainage did not settle")
    return every.join(named(now), met, "left").select("raster_id", "row", "col", ends[0].alias("pit_row"), ends[1].alias("pit_col"))


def flow_accumulation(cells: DataFrame, most_rounds: int = 64) -> DataFrame:
    """raster_id, row, col, upstream: cells that drain through each cell, itself not counted. Counted inside tiles first; what flows
    in by the cells at which ways come into a tile is summed over these cells alone, by path doubling (what comes within 2^k tiles
    and what those hold that lie 2^k tiles up, log rounds); then each tile is counted again with what flows into it."""
    key = ["raster_id", "row", "col"]
    to = ["raster_id", F.col("end_row").alias("row"), F.col("end_col").alias("col")]
    every = stored(_tile_drainage(cells), "drainage")
    with Scratch(cells.sparkSession) as own:
        within = stored(every.filter("is_last and not pit").groupBy(*to).agg(F.sum(F.col("n") + 1).alias("n")), "inflow")
        entries = _entries(every)
        reach = stored(entries.filter("not pit").select(*key, F.col("end_row").alias("y"), F.col("end_col").alias("x")), "reach")
        for _ in range(most_rounds):
            if reach.isEmpty():
                break
            last = own.mark()
            more = reach.join(within, key).groupBy("raster_id", F.col("y").alias("row"), F.col("x").alias("col")).agg(F.sum("n").alias("m"))
            within = stored(within.join(more, key, "left").select(*key, (F.col("n") + F.coalesce("m", F.lit(0))).alias("n")), "inflow")
            on = reach.select("raster_id", F.col("row").alias("y"), F.col("col").alias("x"), F.col("y").alias("ny"), F.col("x").alias("nx"))
            reach = stored(reach.join(on, ["raster_id", "y", "x"]).select(*key, F.col("ny").alias("y"), F.col("nx").alias("x")), "reach")
            own.discard(last)
        else:
            raise RuntimeError("drainage did not settle")
    fed = every.select(*key, "down").join(within, key, "left").select(*key, "down", F.coalesce("n", F.lit(0)).alias("inflow"))
    types = [cells.schema[k] for k in key]
    return _tiled(fed, "down", "inflow").mapInArrow(_by_tile(_accumulated), T.StructType([*types, T.StructField("upstream", T.LongType())]))


def raster_band_range(cells: DataFrame, band: str = "band", stops: int = 5) -> DataFrame:
    """band, min, max and evenly spaced stops between them."""
    out = cells.groupBy(band).agg(F.min("z").alias("min"), F.max("z").alias("max"))
    every = F.transform(F.sequence(F.lit(0), F.lit(stops - 1)), lambda i: F.round(F.col("min") + i * (F.col("max") - F.col("min")) / (stops - 1), 4))
    return out.withColumn("stops", F.array_join(F.transform(every, lambda v: F.format_string("%.2f", v)), ","))
