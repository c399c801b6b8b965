"""Terrain over several tiles, with gaps, negative places and values that are missing or repeated, against plain loops."""

import math

import numpy as np
import pytest

from geoanswers.operators import terrain

AROUND = [(dr, dc) for dr in (-1, 0, 1) for dc in (-1, 0, 1)]


def raster(kind):
    r = np.random.default_rng(9)
    rows, cols = range(-140, 137), range(-20, 150)
    out = {}
    for y in rows:
        for x in cols:
            if kind == "slope":  # long ways through many tiles
                z = 3.0 * y + 2.0 * x + 5 * math.sin(x / 9) + 4 * math.cos(y / 7)
            elif kind == "noise":
                z = float(r.integers(0, 50))
            else:
                z = ((y * 37) % 41) + abs(x) * 0.25
            if kind == "slope" or r.random() > 0.05:
                out[y, x] = z
    return out


def lower(z, at):
    best, to = 0.0, None
    for k, (dr, dc) in enumerate(AROUND):
        n = (at[0] + dr, at[1] + dc)
        if n in z and n != at:
            drop = (z[at] - z[n]) * (1 / math.sqrt(2) if dr * dc else 1.0)
            if drop > best:
                best, to = drop, n
    return to


@pytest.fixture(scope="module", params=["slope", "noise", "bands"])
def both(spark, request):
    z = raster(request.param)
    rows = [(7, y, x, v) for (y, x), v in z.items()]
    rows += [(7, 0, 400, None), (8, 0, 0, 1.0), (8, 0, 1, 2.0), (8, 0, 1, 2.5)]
    return z, spark.createDataFrame(rows, "raster_id long, row int, col int, z double").repartition(6)


def test_windows(both):
    z, cells = both
    got = {(q.row, q.col): tuple(q)[3:] for q in terrain.neighbourhood(cells.filter("raster_id = 7")).collect()}
    assert got.keys() == z.keys()
    for at, window in got.items():
        assert window == tuple(z.get((at[0] + dr, at[1] + dc), z[at]) for dr, dc in AROUND)
    assert [tuple(q) for q in terrain.roughness(cells.filter("raster_id = 8")).orderBy("col").collect()] == [(8, 0, 0, 1.5), (8, 0, 1, 1.5)]


def test_drainage(both):
    z, cells = both
    to = {at: lower(z, at) for at in z}
    pit, up = {}, dict.fromkeys(z, 0)
    for at in sorted(z, key=lambda k: z[k]):
        pit[at] = at if to[at] is None else pit[to[at]]
    for at in sorted(z, key=lambda k: -z[k]):
        if to[at] is not None:
            up[to[at]] += up[at] + 1
    one = cells.filter("raster_id = 7")
    assert {(q.row, q.col): (q.pit_row, q.pit_col) for q in terrain.watershed(one).collect()} == pit
    assert {(q.row, q.col): q.upstream for q in terrain.flow_accumulation(one).collect()} == up


def test_rows_shuffled_for_a_cell(both):
    z, cells = both
    n = terrain.SIDE
    sent = sum(len({(y + a) // n for a in (-1, 1)}) * len({(x + a) // n for a in (-1, 1)}) for y, x in z)
    assert sent < 1.05 * len(z)


def test_no_cells(spark):
    none = spark.createDataFrame([], "raster_id string, row int, col long, z double")
    assert terrain.watershed(none).count() == 0 and terrain.flow_accumulation(none).count() == 0 and terrain.contours(none, 1).count() == 0
