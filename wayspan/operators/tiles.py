"""Rasters as tiles: a row holds a square of cells as a bitmap or as times, so that masks and floods move tiles and not cells.

A mask has rows (tile, words): 256 x 256 cells row by row, 64 a word, lowest bit first; tiles without a
cell have no row. Times have rows (tile, times): seconds a cell, -1 where none. Masks are joined on the tile
and combined word by word in Spark; filling, stroking and flooding work on the cells of one tile (a fill on
one row of tiles) inside a task.
"""

from __future__ import annotations

from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr as X
from ..plans.stages import staged
from .raster import DIAGONAL, Grid, moved, tried

SIDE = 256
WORDS = SIDE * SIDE // 64
MASK, TIMES = "tile long, words array<bigint>", "tile long, times array<int>"
#: Rounds that the last flood took.
rounds_run: dict[str, int] = {}


def tiles_wide(grid: Grid) -> int:
    return -(-grid.w // SIDE)


def tile_of(x: Column, y: Column, grid: Grid) -> Column:
    return (F.floor(y / SIDE) * tiles_wide(grid) + F.floor(x / SIDE)).cast("long")


def place_of(cell: Column, grid: Grid) -> Column:
    """Place of a cell within its tile."""
    return ((F.floor(cell / grid.w) % SIDE) * SIDE + (cell % grid.w) % SIDE).cast("int")


def cell_at(tile: Column, place: Column, grid: Grid) -> Column:
    wide = tiles_wide(grid)
    return ((F.floor(tile / wide) * SIDE + F.floor(place / SIDE)) * grid.w + (tile % wide) * SIDE + place % SIDE).cast("long")


def bits_of(words: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(words, "<i8").view(np.uint8), bitorder="little").reshape(SIDE, SIDE).astype(bool)


def words_of(bits: np.ndarray) -> np.ndarray:
    return np.packbits(bits.ravel(), bitorder="little").view("<i8")


def masks(tiles: list[int], bits: list[np.ndarray]) -> pa.Table:
    return pa.table({"tile": pa.array(tiles, pa.int64()), "words": pa.array([words_of(b) for b in bits], pa.list_(pa.int64()))})


def every(spark, grid: Grid) -> DataFrame:
    """All cells of the grid."""
    wide, high = tiles_wide(grid), -(-grid.h // SIDE)

    def work(batches):
        for batch in batches:
            bits = []
            for tile in batch.column("id").to_pylist():
                one = np.zeros((SIDE, SIDE), dtype=bool)
                one[: max(0, grid.h - tile // wide * SIDE), : max(0, grid.w - tile % wide * SIDE)] = True
                bits.append(one)
            yield from masks(batch.column("id").to_pylist(), bits).to_batches()

    return spark.range(wide * high).mapInArrow(work, MASK)


def combined(a: DataFrame, b: DataFrame, how: str, word) -> DataFrame:
    none = F.array_repeat(F.lit(0).cast("long"), WORDS)
    both = a.join(b.withColumnRenamed("words", "others"), "tile", how)
    words = F.zip_with(F.coalesce("words", none), F.coalesce("others", none), word)
    return both.select("tile", words.alias("words")).where(F.exists("words", lambda w: w != 0))


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return combined(a, b, "full", lambda x, y: x.bitwiseOR(y))


def common(a: DataFrame, b: DataFrame) -> DataFrame:
    return combined(a, b, "inner", lambda x, y: x.bitwiseAND(y))


def without(a: DataFrame, b: DataFrame) -> DataFrame:
    return combined(a, b, "left", lambda x, y: x.bitwiseAND(F.bitwise_not(y)))


def size(mask: DataFrame) -> DataFrame:
    """(cells): how many cells the mask has."""
    ones = F.aggregate("words", F.lit(0).cast("long"), lambda n, w: n + F.bit_count(w))
    return mask.agg(F.coalesce(F.sum(ones), F.lit(0)).alias("cells"))


def cells(mask: DataFrame, grid: Grid) -> DataFrame:
    """(cell): the mask as a row a cell."""
    word = mask.select("tile", F.posexplode("words").alias("i", "w")).where("w <> 0")
    bit = F.explode(F.expr("filter(sequence(0, 63), b -> shiftright(w, b) & 1 = 1)")).alias("b")
    return word.select("tile", "i", bit).select(cell_at(F.col("tile"), F.col("i") * 64 + F.col("b"), grid).alias("cell"))


def of_cells(rows: DataFrame, grid: Grid) -> DataFrame:
    """The mask of rows (cell)."""
    x, y = F.col("cell") % grid.w, F.floor(F.col("cell") / grid.w)
    at = rows.select(tile_of(x, y, grid).alias("tile"), place_of(F.col("cell"), grid).alias("p"))
    word = at.groupBy("tile", F.floor(F.col("p") / 64).cast("int").alias("i")).agg(F.bit_or(F.expr("shiftleft(1L, p % 64)")).alias("w"))
    one = word.groupBy("tile").agg(F.map_from_entries(F.collect_list(F.struct("i", "w"))).alias("m"))
    return one.select("tile", F.transform(F.sequence(F.lit(0), F.lit(WORDS - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0).cast("long"))).alias("words"))


def within(rows: DataFrame, mask: DataFrame, grid: Grid) -> DataFrame:
    """The rows (cell, ...) whose cell the mask has: a join on tiles."""
    x, y, place = F.col("cell") % grid.w, F.floor(F.col("cell") / grid.w), place_of(F.col("cell"), grid)
    at = rows.withColumn("tile", tile_of(x, y, grid)).withColumn("__word", F.floor(place / 64).cast("int")).withColumn("__bit", (place % 64).cast("int"))
    return at.join(mask, "tile").where(F.expr("shiftright(words[__word], __bit) & 1 = 1")).select(rows.columns)


def fill(points: DataFrame, grid: Grid) -> DataFrame:
    """The cells whose centre has a nonzero winding number in the rings (ring_id, idx, lat, lon)."""
    along = Window.partitionBy("ring_id").orderBy("idx")
    after = lambda c: F.coalesce(F.lead(c).over(along), F.first(c).over(along))
    return fill_sides(points.select(F.col("lat").alias("lat_a"), F.col("lon").alias("lon_a"), after("lat").alias("lat_b"), after("lon").alias("lon_b")), grid)


def fill_sides(sides: DataFrame, grid: Grid) -> DataFrame:
    """The same of the rings' sides (lat_a, lon_a, lat_b, lon_b), in any order.

    A side goes to the rows of tiles that it crosses, most often one; there the crossings' directions are summed along each row of
    cells, tile by tile, so that a wide grid takes no more memory than its crossings and its mask.
    """
    side = sides.select(grid.px(F.col("lon_a")).alias("ax"), grid.py(F.col("lat_a")).alias("ay"), grid.px(F.col("lon_b")).alias("bx"), grid.py(F.col("lat_b")).alias("by"))
    low, high = F.least("ay", "by"), F.greatest("ay", "by")
    side = side.select("*", F.greatest(F.ceil(low - 0.5), F.lit(0)).alias("top"), F.least(F.ceil(high - 0.5) - 1, F.lit(grid.h - 1)).alias("end")).where("top <= end")
    side = side.withColumn("band", F.explode(F.sequence(F.floor(F.col("top") / SIDE), F.floor(F.col("end") / SIDE))))
    wide = tiles_wide(grid)

    def work(key: tuple, table: pa.Table) -> pa.Table:
        first = key[0].as_py() * SIDE
        ax, ay, bx, by, top, end = (table.column(c).to_numpy() for c in ("ax", "ay", "bx", "by", "top", "end"))
        top, end = np.maximum(top, first), np.minimum(end, first + SIDE - 1)
        many = end - top + 1
        side = np.repeat(np.arange(len(many)), many)
        y = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + top[side]
        at = ax[side] + (y + 0.5 - ay[side]) * (bx - ax)[side] / (by - ay)[side]
        x = np.maximum(np.ceil(at - 0.5), 0)
        inside = x < grid.w
        x, y, step = x[inside].astype(np.int64), (y - first)[inside].astype(np.int64), np.where(by > ay, 1, -1)[side][inside]
        order = np.argsort(x, kind="stable")
        ends = np.searchsorted(x[order], np.arange(wide + 1) * SIDE)
        parts, wind = [], np.zeros(SIDE, dtype=np.int32)  # at the left side of the tile
        for t in range(wide):
            own = order[ends[t] : ends[t + 1]]
            if len(own) or wind.any():
                turn = np.zeros((SIDE, SIDE), dtype=np.int32)
                turn[:, 0] = wind
                np.add.at(turn, (y[own], x[own] - t * SIDE), step[own])
                turn = np.cumsum(turn, axis=1)
                wind, wet = turn[:, -1], turn != 0
                wet[:, max(0, grid.w - t * SIDE) :] = False
                if wet.any():
                    parts.append((key[0].as_py() * wide + t, wet))
        return masks([t for t, _ in parts], [b for _, b in parts])

    return side.groupBy("band").applyInArrow(work, MASK)


def stroke(lines: DataFrame, grid: Grid, least_px: float, width_m: float) -> DataFrame:
    """The cells whose centre lies at most half a stroke's width from a segment (lat_a, lon_a, lat_b, lon_b)."""
    half = max(least_px, width_m / grid.res) / 2
    s = lines.select(grid.px(F.col("lon_a")).alias("ax"), grid.py(F.col("lat_a")).alias("ay"), grid.px(F.col("lon_b")).alias("bx"), grid.py(F.col("lat_b")).alias("by"))
    ends = lambda a, b, n: (F.greatest(F.floor(F.least(a, b) - half - 0.5), F.lit(0)).cast("long"), F.least(F.ceil(F.greatest(a, b) + half), F.lit(n - 1)).cast("long"))
    (x0, x1), (y0, y1) = ends("ax", "bx", grid.w), ends("ay", "by", grid.h)
    s = s.select("*", x0.alias("x0"), x1.alias("x1"), y0.alias("y0"), y1.alias("y1")).where("x0 <= x1 and y0 <= y1")
    span = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / SIDE), F.floor(F.col(b) / SIDE)))
    wide = tiles_wide(grid)
    s = s.withColumn("ty", span("y0", "y1")).withColumn("tx", span("x0", "x1")).withColumn("tile", F.col("ty") * wide + F.col("tx"))

    def work(key: tuple, table: pa.Table) -> pa.Table:
        tile = key[0].as_py()
        left, top = tile % wide * SIDE, tile // wide * SIDE
        wet = np.zeros((SIDE, SIDE), dtype=bool)
        for ax, ay, bx, by, x0, x1, y0, y1 in zip(*(table.column(c).to_pylist() for c in ("ax", "ay", "bx", "by", "x0", "x1", "y0", "y1")), strict=True):
            x = np.arange(max(x0, left), min(x1, left + SIDE - 1) + 1)
            y = np.arange(max(y0, top), min(y1, top + SIDE - 1) + 1)[:, None]
            dx, dy, qx, qy = bx - ax, by - ay, x + 0.5 - ax, y + 0.5 - ay
            norm = dx * dx + dy * dy
            f = np.clip((qx * dx + qy * dy) / norm, 0.0, 1.0) if norm > 0 else np.zeros((len(y), len(x)))
            near = (qx - f * dx) * (qx - f * dx) + (qy - f * dy) * (qy - f * dy) <= half * half
            wet[y[:, 0][0] - top : y[:, 0][-1] - top + 1, x[0] - left : x[-1] - left + 1] |= near
        return masks([tile], [wet]) if wet.any() else masks([], [])

    return s.select("tile", "ax", "ay", "bx", "by", "x0", "x1", "y0", "y1").groupBy("tile").applyInArrow(work, MASK)


def on_land(seeds: DataFrame, land: DataFrame, grid: Grid) -> DataFrame:
    """(node, t): seeds (node, t) by cell, those off the mask moved to the first cell of it to the west, east, north or south; others go."""
    return moved(within(tried(seeds, grid), land, grid))


def flood(seeds: DataFrame, land: DataFrame, grid: Grid, cap: int) -> DataFrame:
    """(tile, times): least walking times from seeds (node: a cell, t) over the mask ``land`` to the eight neighbours; times past ``cap`` aren't carried on.

    A round settles each tile that has news to the end; only times that cross a tile's edge travel, so
    rounds are as many as tiles lie along a way. A tile that nothing improves is not written again.
    """
    orth = max(1, int(grid.res / X.WALK_MPS + 0.5))
    diag, wide = int(orth * DIAGONAL + 0.5), tiles_wide(grid)
    steps = [(dx, dy, diag if dx and dy else orth) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if dx or dy]
    x, y = F.col("node") % grid.w, F.floor(F.col("node") / grid.w)
    least = lambda rows: rows.groupBy("tile", "place").agg(F.min("t").alias("t"))
    inbox = staged(least(seeds.where("node is not null").select(tile_of(x, y, grid).alias("tile"), place_of(F.col("node"), grid).alias("place"), F.col("t").cast("long").alias("t"))), "flood-inbox")
    land = staged(land, "flood-land")

    def work(key: tuple, news: pa.Table, state: pa.Table) -> pa.Table:
        tile, out = key[0].as_py(), {"tile": [], "times": [], "place": [], "t": []}
        if state.num_rows and news.num_rows:
            ground = bits_of(state.column("words").combine_chunks().flatten().to_numpy()).ravel().tolist()
            held = state.column("times")[0].as_py()
            times = [-1] * (SIDE * SIDE) if held is None else held
            heap = [(t, p) for t, p in zip(news.column("t").to_pylist(), news.column("place").to_pylist(), strict=True) if ground[p] and not -1 < times[p] <= t]
            changed, sent = bool(heap), {}
            for t, p in heap:
                times[p] = t
            heapify(heap)
            left, top = tile % wide * SIDE, tile // wide * SIDE
            while heap:
                t, p = heappop(heap)
                if t > times[p] or t > cap:
                    continue
                py, px = divmod(p, SIDE)
                for dx, dy, sec in steps:
                    nx, ny = px + dx, py + dy
                    if 0 <= nx < SIDE and 0 <= ny < SIDE:
                        q = ny * SIDE + nx
                        if ground[q] and not -1 < times[q] <= t + sec:
                            times[q] = t + sec
                            heappush(heap, (t + sec, q))
                    elif 0 <= left + nx < grid.w and 0 <= top + ny < grid.h:
                        to = ((top + ny) // SIDE * wide + (left + nx) // SIDE, ny % SIDE * SIDE + nx % SIDE)
                        sent[to] = min(t + sec, sent.get(to, t + sec))
            if changed:
                rows = [(tile, times, None, None), *((to, None, p, t) for (to, p), t in sent.items())]
                out = {c: [r[i] for r in rows] for i, c in enumerate(out)}
        return pa.table({"tile": pa.array(out["tile"], pa.int64()), "times": pa.array(out["times"], pa.list_(pa.int32())), "place": pa.array(out["place"], pa.int32()), "t": pa.array(out["t"], pa.int64())})

    states, rounds_run["flood"] = None, 0
    latest = lambda rows: rows.groupBy("tile").agg(F.max_by("times", "round").alias("times"))
    while not inbox.isEmpty():
        rounds_run["flood"] += 1
        active = inbox.select("tile").distinct()
        known = land.join(active, "tile", "left_semi")
        known = known.withColumn("times", F.lit(None).cast("array<int>")) if states is None else known.join(latest(states.join(active, "tile", "left_semi")), "tile", "left")
        found = staged(inbox.groupBy("tile").cogroup(known.groupBy("tile")).applyInArrow(work, "tile long, times array<int>, place int, t long"), "flood-found")
        new = found.where("times is not null").select("tile", "times", F.lit(rounds_run["flood"]).alias("round"))
        states = new if states is None else states.unionByName(new)
        inbox = staged(least(found.where("times is null")), "flood-inbox")
    return land.sparkSession.createDataFrame([], TIMES) if states is None else latest(states)


def timed_cells(times: DataFrame, grid: Grid, cap: int) -> DataFrame:
    """(cell, sec): the cells of at most ``cap`` seconds, a row each."""
    return times.select("tile", F.posexplode("times").alias("p", "sec")).where((F.col("sec") >= 0) & (F.col("sec") <= cap)).select(cell_at(F.col("tile"), F.col("p"), grid).alias("cell"), F.col("sec").cast("long").alias("sec"))


def by_band(times: DataFrame, grid: Grid, cap: int, ends: list[int], mask: DataFrame | None = None, origin: tuple[int, int] | None = None) -> DataFrame:
    """(band, cells, far): cells (of the mask) of at most each band's seconds, and the greatest distance of one from the origin's cell in cells; a row a band that has any.

    A tile gives a row a band; nothing else is shuffled.
    """
    wide = tiles_wide(grid)
    masked, rows = mask is not None, times if mask is None else times.join(mask, "tile")
    ox, oy = origin or (0, 0)

    def work(batches):
        for batch in batches:
            out = []
            for i, tile in enumerate(batch.column("tile").to_pylist()):
                sec = batch.column("times")[i].values.to_numpy().reshape(SIDE, SIDE)
                fits = (sec >= 0) & (sec <= cap)
                if masked:
                    fits &= bits_of(batch.column("words")[i].values.to_numpy())
                y, x = np.nonzero(fits)
                far = (x + tile % wide * SIDE - ox).astype(np.float64) ** 2 + (y + tile // wide * SIDE - oy).astype(np.float64) ** 2
                for band, end in enumerate(ends):
                    within = sec[y, x] <= end
                    if within.any():
                        out.append((band, int(within.sum()), float(np.sqrt(far[within].max()))))
            yield pa.RecordBatch.from_pydict({"band": pa.array([r[0] for r in out], pa.int32()), "cells": pa.array([r[1] for r in out], pa.int64()), "far": pa.array([r[2] for r in out], pa.float64())})

    return rows.mapInArrow(work, "band int, cells long, far double").groupBy("band").agg(F.sum("cells").alias("cells"), F.max("far").alias("far"))
