"""Masks, fills, strokes and floods on tiles against the cells themselves; coasts."""

import heapq
import random

import numpy as np
from pyspark.sql import functions as F

from wayspan.operators import rings, tiles
from wayspan.operators.raster import Grid
from wayspan.plans import surface
from wayspan.sources.fixtures import Fixtures



def grid_units():
    """A grid whose pixels are its units: x = lon * 1000, y = h - lat * 111320."""
    return Grid(0.0, 0.0, 290 / 111320, 0.3, 1000.0, 1, 300, 290)


def got(mask, grid):
    out = np.zeros((grid.h, grid.w), dtype=bool)
    for r in tiles.cells(mask, grid).collect():
        out[r.cell // grid.w, r.cell % grid.w] = True
    return out


def test_masks(spark):
    g, rng = grid_units(), random.Random(1)
    a, b = ({rng.randrange(g.w * g.h) for _ in range(4000)} for _ in range(2))
    b = {c for c in b if c % g.w < 200 and c // g.w < 200} | {g.w * g.h - 1}  # absent from some tiles, and the last cell
    frame = lambda s: tiles.of_cells(spark.createDataFrame([(c,) for c in s], "cell long"), g)
    A, B, every = frame(a), frame(b), tiles.every(spark, g)
    cells = lambda m: {r.cell for r in tiles.cells(m, g).collect()}
    assert cells(A) == a and A.count() == 4
    assert cells(tiles.union(A, B)) == a | b and cells(tiles.common(A, B)) == a & b and cells(tiles.without(A, B)) == a - b
    assert tiles.size(every).first().cells == g.w * g.h and tiles.size(tiles.without(every, A)).first().cells == g.w * g.h - len(a)
    none = A.where("false")
    assert cells(none) == set() and tiles.size(none).first().cells == 0 and cells(tiles.union(none, B)) == b and cells(tiles.without(none, B)) == set()


def test_seeds_leave_the_water_by_tiles(spark):
    """As by cells, also where the next land lies in the next tile."""
    from wayspan.operators import raster

    g, rng = grid_units(), random.Random(3)
    land = [c for c in range(g.w * g.h) if rng.random() < 0.3 or c % g.w == 256]
    seeds = spark.createDataFrame([(rng.randrange(g.w * g.h), rng.randrange(90)) for _ in range(800)] + [(255 + 7 * g.w, 5), (257 + 7 * g.w, 2), (None, 1)], "node long, t long")
    frame = spark.createDataFrame([(c,) for c in land], "cell long")
    rows = lambda df: sorted(map(tuple, df.collect()))
    want = rows(raster.on_land(seeds, frame, g))
    assert rows(tiles.on_land(seeds, tiles.of_cells(frame, g), g)) == want and len(want) > 300


def test_fill_and_stroke(spark):
    """Rings across tiles, one beyond the grid, two that overlap, a hole and a side along a row; strokes of every direction."""
    g = grid_units()
    shapes = [[(5, 5), (290, 20), (280, 280), (100, 285), (150, 140)], [(-50, 200), (120, 180), (60, 400)], [(20, 20), (60, 20), (60, 60), (20, 60)], [(200, 60), (200, 120), (240, 120), (240, 60)], [(250, 30), (280, 30.5), (265, 30.5)]]
    point = [(i, k, (g.h - y) / 111320, x / 1000) for i, ring in enumerate(shapes) for k, (x, y) in enumerate(ring)]
    mask = got(tiles.fill(spark.createDataFrame(point, "ring_id long, idx long, lat double, lon double"), g), g)
    want = np.zeros((g.h, g.w), dtype=np.int64)
    cx, cy = np.meshgrid(np.arange(g.w) + 0.5, np.arange(g.h) + 0.5)
    for i, ring in enumerate(shapes):
        at = [((p[3]) * g.deg_m / g.res, (g.north - p[2]) * 111320.0 / g.res) for p in point if p[0] == i]
        for (ax, ay), (bx, by) in zip(at, at[1:] + at[:1]):
            if ay != by:
                cross = (ay <= cy) != (by <= cy)
                want += np.where(cross & (ax + (cy - ay) * (bx - ax) / (by - ay) <= cx), 1 if by > ay else -1, 0)
    assert (mask == (want != 0)).all() and 0 < mask.sum() < mask.size

    lines = [(10, 250, 290, 260), (255, 10, 256, 280), (30, 30, 30, 30), (-40, 100, 40, 60), (700, 700, 900, 900)]
    frame = spark.createDataFrame([((g.h - ay) / 111320, ax / 1000, (g.h - by) / 111320, bx / 1000) for ax, ay, bx, by in lines], "lat_a double, lon_a double, lat_b double, lon_b double")
    wet = np.zeros((g.h, g.w), dtype=bool)
    for ax, ay, bx, by in lines:
        dx, dy = bx - ax, by - ay
        f = np.clip(((cx - ax) * dx + (cy - ay) * dy) / (dx * dx + dy * dy), 0, 1) if dx or dy else 0 * cx
        wet |= (cx - ax - f * dx) ** 2 + (cy - ay - f * dy) ** 2 <= 2.5**2
    stroked = got(tiles.stroke(frame, g, 5.0, 1.0), g)
    assert (stroked != wet).sum() <= 2 and wet.sum() > 500  # ties at the very edge


def test_flood_crosses_tiles(spark):
    g, rng = grid_units(), random.Random(2)
    land = np.array([[rng.random() < 0.8 for _ in range(g.w)] for _ in range(g.h)])
    land[:, 256] = False  # a wall along a tile's edge, with one gate
    land[140, 250:262] = True
    land[100, 100] = land[100, 101] = True
    seeds = [(100 * g.w + 100, 7), (100 * g.w + 100, 3), (100 * g.w + 101, 400), (0, 5)]
    land[0, 0] = False  # a seed on water reaches nothing
    mask = tiles.of_cells(spark.createDataFrame([(int(c),) for c in np.flatnonzero(land)], "cell long"), g)
    orth, cap = 1, 220
    best, heap = {}, [(t, s) for s, t in seeds if land[s // g.w, s % g.w]]
    heapq.heapify(heap)
    while heap:
        t, c = heapq.heappop(heap)
        if c in best:
            continue
        best[c] = t
        if t <= cap:
            y, x = divmod(c, g.w)
            for dy in (-1, 0, 1):
                for dx in (-1, 0, 1):
                    if (dx or dy) and 0 <= y + dy < g.h and 0 <= x + dx < g.w and land[y + dy, x + dx]:
                        heapq.heappush(heap, (t + (orth if not dx or not dy else int(orth * 1.4142135623730951 + 0.5)), (y + dy) * g.w + x + dx))
    times = tiles.flood(spark.createDataFrame(seeds, "node long, t long"), mask, g, cap)
    times = spark.createDataFrame(times.collect(), tiles.TIMES)  # once
    found = {r.cell: r.sec for r in tiles.timed_cells(times, g, cap).collect()}
    assert found == {c: t for c, t in best.items() if t <= cap} and any(c % g.w > 256 for c in found)
    assert tiles.rounds_run["flood"] <= 8
    half = tiles.of_cells(spark.range(g.w * g.h).where(F.col("id") % 2 == 0).withColumnRenamed("id", "cell"), g)
    rows = {r.band: (r.cells, round(r.far, 6)) for r in tiles.by_band(times, g, cap, [50, 150, 500], half, (100, 100)).collect()}
    for band, end in enumerate((50, 150, 500)):
        inside = [c for c, t in found.items() if t <= end and c % 2 == 0]
        assert rows[band] == (len(inside), round(max(((c % g.w - 100) ** 2 + (c // g.w - 100) ** 2) ** 0.5 for c in inside), 6))
    assert tiles.flood(spark.createDataFrame([], "node long, t long"), mask, g, cap).count() == 0


def test_a_hundred_times_fewer_rows(spark):
    """The city's masks have a row a tile where cells would have thousands."""
    fx = Fixtures(spark, "/root/testdata/sf0.01")
    grid = surface.grid_of(fx)
    land = surface.land_mask(fx, grid)
    assert tiles.size(land).first().cells >= 100 * land.count()


def test_lines_are_joined_on_both_sides():
    """The first piece lies in the middle; a ring, a fork and a piece apart."""
    chain = [(i, 0) for i in range(40)]
    pieces = [chain[20:25], chain[24:33][::-1], chain[5:21], chain[32:], chain[:6][::-1]]
    assert rings.stitched(pieces) == [chain]
    assert rings.stitched([[(2, 0), (3, 0)], [(1, 0), (2, 0)], [(3, 0), (4, 0)]]) == [[(1, 0), (2, 0), (3, 0), (4, 0)]]
    square = [(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)]
    assert rings.stitched([square[2:4], square[:3], square[3:]])[0][0] == rings.stitched([square[2:4], square[:3], square[3:]])[0][-1]
    assert sorted(map(len, rings.stitched([[(0, 0), (5, 5)], [(5, 5), (6, 6)], [(5, 5), (7, 7)], [(9, 9), (8, 8)]]))) == [2, 2, 3]
    many = [[(i, 0), (i + 1, 0)] for i in range(30_000)]
    random.Random(3).shuffle(many)
    assert sorted(rings.stitched(many)[0]) == [(i, 0) for i in range(30_001)]


def test_open_coasts_and_islands(spark):
    """An open coast of over 100 points is closed over the sea's corner, a shorter one is not; an island keeps its turn, a small one goes."""
    coast = [{"qlon": 2100000 + i % 2, "qlat": 5200000 + 10 * i} for i in range(150)]
    square = lambda lon, lat, a: [{"qlon": lon + x * a, "qlat": lat + y * a} for x, y in ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))]
    rows = [(0, 1, coast[:80]), (0, 0, coast[79:]), (1, 0, coast[:90]), (2, 0, square(2100500, 5200100, 200)), (3, 0, square(2100900, 5200100, 20))]
    frame = spark.createDataFrame(rows, f"relation_id long, chain_id long, ring {rings.POINTS}")
    found = {r.relation_id: [(p.qlon, p.qlat) for p in r.ring] for r in rings.coasts(frame, (52.5, 21.2), 0.0, 0.01, 100).collect()}
    assert set(found) == {0, 2}
    assert found[0][-3:] == [(coast[-1]["qlon"], 5250000), (2120000, 5250000), (2120000, 5200000)] and found[0][:150] == [(p["qlon"], p["qlat"]) for p in coast]
    assert found[2] == [(p["qlon"], p["qlat"]) for p in rows[3][2][:-1]]
    assert {r.relation_id for r in rings.coasts(frame, None, 0.0, 0.01, 100).collect()} == {2}
