"""Grids, and times on them as rows of cells: painting, spreading, moves. Masks and floods are tiles (see ``tiles``)."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr as X
from ..plans.stages import staged

#: Fixed values that results depend on.
MAX_CELLS, MIN_RES_M, DIAGONAL = 4_000_000, 25, 1.4142135623730951
WATER_PX, WATER_M, BRIDGE_PX, BRIDGE_M = 3.0, 100.0, 1.5, 50.0
NO_WALK_M, SPREAD_M = 200, 75


@dataclass(frozen=True)
class Grid:
    """A grid over a box of degrees; ``deg_m``: metres a degree of longitude at its middle."""

    south: float
    west: float
    north: float
    east: float
    deg_m: float
    res: int
    w: int
    h: int

    @staticmethod
    def over(points: DataFrame, margin: float = 0.001) -> Grid:
        """The grid of the box round all points (lat, lon), of ``MIN_RES_M`` whatever the box: one aggregated row goes to the driver."""
        box = points.agg((F.min("lat") - margin).alias("s"), (F.min("lon") - margin).alias("w"), (F.max("lat") + margin).alias("n"), (F.max("lon") + margin).alias("e"))
        box = box.withColumn("deg_m", F.lit(X.M_PER_DEG) * F.cos(F.radians((F.col("s") + F.col("n")) / 2)))
        x, y = (F.col("e") - F.col("w")) * F.col("deg_m"), (F.col("n") - F.col("s")) * X.M_PER_DEG
        return Grid(*box.select("s", "w", "n", "e", "deg_m", F.lit(MIN_RES_M), F.ceil(x / MIN_RES_M).cast("int"), F.ceil(y / MIN_RES_M).cast("int")).first())

    @staticmethod
    def of_box(south: float, west: float, north: float, east: float) -> Grid:
        """The grid of a city's box, as the reference chooses it: coarser than ``MIN_RES_M`` where that makes over ``MAX_CELLS``."""
        deg_m = X.M_PER_DEG * math.cos(math.radians((south + north) / 2))
        x, y = (east - west) * deg_m, (north - south) * X.M_PER_DEG
        res = max(MIN_RES_M, math.ceil(math.sqrt(x * y / MAX_CELLS)))
        return Grid(south, west, north, east, deg_m, res, math.ceil(x / res), math.ceil(y / res))

    def px(self, lon: Column) -> Column:
        return (lon - F.lit(self.west)) * F.lit(self.deg_m) / F.lit(self.res)

    def py(self, lat: Column) -> Column:
        return (F.lit(self.north) - lat) * F.lit(X.M_PER_DEG) / F.lit(self.res)

    def cell(self, lat: Column, lon: Column) -> Column:
        """y * w + x of the nearest cell, null outside."""
        x, y = X.js_round(self.px(lon)), X.js_round(self.py(lat))
        return F.when((x >= 0) & (x < self.w) & (y >= 0) & (y < self.h), y * self.w + x)

    def cells(self, spark) -> DataFrame:
        return spark.range(self.w * self.h).select(F.col("id").alias("cell"), (F.col("id") % self.w).alias("x"), F.floor(F.col("id") / self.w).alias("y"))


#: Where a place on water is moved, in this order.
SHIFTS = ((0, 0), (-1, 0), (1, 0), (0, -1), (0, 1))


def tried(seeds: DataFrame, grid: Grid) -> DataFrame:
    """(node, t, order, cell): the cells that a seed (node, t) may be moved to, in order."""
    seeds = seeds.where("node is not null").groupBy("node").agg(F.min("t").alias("t"))
    shift = F.explode(F.array(*[F.struct(F.lit(i).alias("order"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for i, (dx, dy) in enumerate(SHIFTS)]))
    x, y = F.col("node") % grid.w + F.col("s.dx"), F.floor(F.col("node") / grid.w) + F.col("s.dy")
    return seeds.withColumn("s", shift).where((x >= 0) & (x < grid.w) & (y >= 0) & (y < grid.h)).select("node", "t", "s.order", (y * grid.w + x).alias("cell"))


def moved(found: DataFrame) -> DataFrame:
    """(node, t): of the cells on land (node, t, order, cell) the first of each seed, with the least time of the seeds that come to it."""
    first = found.groupBy("node").agg(F.min("t").alias("t"), F.min_by("cell", "order").alias("cell"))
    return first.groupBy(F.col("cell").alias("node")).agg(F.min("t").alias("t"))


def on_land(seeds: DataFrame, land: DataFrame, grid: Grid) -> DataFrame:
    """(node, t): seeds (node, t) by cell, those on water moved to the first land cell to the west, east, north or south; others go."""
    return moved(tried(seeds, grid).join(land.select("cell"), "cell", "left_semi"))


def moves(land: DataFrame, grid: Grid) -> DataFrame:
    """(u, v, sec, step_m): walks from each land cell to its eight neighbours on land, in seconds and metres."""
    orth = max(1, int(grid.res / X.WALK_MPS + 0.5))
    diag = int(orth * DIAGONAL + 0.5)
    d = F.sequence(F.lit(-1), F.lit(1))
    near = land.select("cell").withColumn("dx", F.explode(d)).withColumn("dy", F.explode(d)).where("dx <> 0 or dy <> 0")
    x, y = F.col("cell") % grid.w + F.col("dx"), F.floor(F.col("cell") / grid.w) + F.col("dy")
    straight = (F.col("dx") == 0) | (F.col("dy") == 0)
    near = near.where((x >= 0) & (x < grid.w) & (y >= 0) & (y < grid.h)).select(F.col("cell").alias("u"), (y * grid.w + x).alias("v"), F.when(straight, orth).otherwise(diag).cast("long").alias("sec"), F.when(straight, float(grid.res)).otherwise(grid.res * DIAGONAL).alias("step_m"))
    return near.join(land.select(F.col("cell").alias("v")), "v", "left_semi").select("u", "v", "sec", "step_m")


def paint(edges: DataFrame, nodes: DataFrame, times: DataFrame, grid: Grid) -> DataFrame:
    """(cell, sec): least time of points along edges (u, v, len_m), from the times (node, t) at both ends."""
    at = nodes.join(times, nodes["node_id"] == times["node"], "left").select("node_id", "lat", "lon", "t")
    u, v = (at.select(F.col("node_id").alias(i), *[F.col(c).alias(f"{c}_{i}") for c in ("lat", "lon", "t")]) for i in "uv")
    e = edges.join(u, "u").join(v, "v").where("t_u is not null or t_v is not null")
    steps = F.greatest(F.lit(1), X.js_round(F.col("len_m") / grid.res)).cast("int")
    e = e.withColumn("n", steps).withColumn("i", F.explode(F.sequence(F.lit(0), steps))).withColumn("f", F.col("i") / F.col("n"))
    to = lambda t, f: F.col(t) + F.col("len_m") * f / X.NET_WALK_MPS
    sec = F.floor(F.least(to("t_u", F.col("f")), to("t_v", 1 - F.col("f")))).cast("long")
    mix = lambda c: F.col(f"{c}_u") + (F.col(f"{c}_v") - F.col(f"{c}_u")) * F.col("f")
    return e.select(grid.cell(mix("lat"), mix("lon")).alias("cell"), sec.alias("sec")).where("cell is not null").groupBy("cell").agg(F.min("sec").alias("sec"))


def spread(times: DataFrame, walks: DataFrame, grid: Grid, metres: float = SPREAD_M) -> DataFrame:
    """(cell, sec): times (cell, sec) carried on over ``walks`` for at most ``metres`` from where they stood.

    Of equal times the one with the smaller spread stays. As a step is a cell wide at least,
    the number of rounds is fixed.
    """
    label = times.select("cell", F.struct(F.col("sec"), F.lit(0.0).alias("m")).alias("best"))
    walks = staged(walks, "spread-walks")
    for _ in range(int(metres / grid.res)):
        gone = label.join(walks, label["cell"] == walks["u"]).where(F.col("best.m") + F.col("step_m") <= metres)
        gone = gone.select(F.col("v").alias("cell"), F.struct((F.col("best.sec") + F.col("sec")).alias("sec"), (F.col("best.m") + F.col("step_m")).alias("m")).alias("best"))
        label = staged(label.unionByName(gone).groupBy("cell").agg(F.min("best").alias("best")), "spread")
    return label.select("cell", "best.sec")


def near_cells(seeds: DataFrame, walks: DataFrame, grid: Grid, metres: float = NO_WALK_M) -> DataFrame:
    """(cell, sec): the least seed time (node, t) among seeds at most ``metres`` over land away; walking takes no time.

    Rows are by seed and cell, so that no wave stops another; a seed has few cells in reach.
    """
    label = seeds.select(F.col("node").alias("seed"), F.col("node").alias("cell"), F.lit(0.0).alias("m"))
    for _ in range(int(metres / grid.res)):
        gone = label.join(walks, label["cell"] == walks["u"]).where(F.col("m") + F.col("step_m") <= metres).select("seed", F.col("v").alias("cell"), (F.col("m") + F.col("step_m")).alias("m"))
        label = staged(label.unionByName(gone).groupBy("seed", "cell").agg(F.min("m").alias("m")), "near")
    return label.join(seeds.select(F.col("node").alias("seed"), "t"), "seed").groupBy("cell").agg(F.min("t").alias("sec"))
