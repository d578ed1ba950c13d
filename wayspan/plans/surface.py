"""Queries of rings, rasters and spreading times over the projected tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import raster, reach, rings, tiles
from ..operators.raster import Grid
from .catalog import A, ACCESS, ADJ, M, WAVE, ORACLES, query, walk_times
from .stages import staged

BOX = f"""SELECT s, w, n, e, deg_m, 25 AS res, CAST(ceil((e - w) * deg_m / 25) AS BIGINT) AS gw, CAST(ceil((n - s) * {M} / 25) AS BIGINT) AS gh FROM (
  SELECT *, {M} * cos(radians((s + n) / 2)) AS deg_m FROM (SELECT min(lat) - 0.001e0 AS s, min(lon) - 0.001e0 AS w, max(lat) + 0.001e0 AS n, max(lon) + 0.001e0 AS e FROM fx_stops))"""
PX, PY = "({} - box.w) * box.deg_m / box.res", f"(box.n - {{}}) * {M} / box.res"


def cell_sql(lat: str, lon: str) -> str:
    x, y = (f"CAST(floor({c} + 0.5) AS BIGINT)" for c in (PX.format(lon), PY.format(lat)))
    return f"CASE WHEN {x} BETWEEN 0 AND gw - 1 AND {y} BETWEEN 0 AND gh - 1 THEN {y} * gw + {x} END"


def grid_of(fx) -> Grid:
    return Grid.over(fx.fx_stops)


@query(f"SELECT node_id, {cell_sql('lat', 'lon')} AS cell FROM fx_walk_nodes, box", {"box": BOX})
def pixel_index(fx):
    return fx.fx_walk_nodes.select("node_id", grid_of(fx).cell(F.col("lat"), F.col("lon")).alias("cell"))


@query(f"SELECT node_id, lat, lon FROM fx_walk_nodes, box WHERE {cell_sql('lat', 'lon')} IS NULL", {"box": BOX})
def outside_grid(fx):
    return fx.fx_walk_nodes.where(grid_of(fx).cell(F.col("lat"), F.col("lon")).isNull()).select("node_id", "lat", "lon")


# rings: five to seven corners beside each stop, three of four of them closed
RING = """SELECT ring_id, idx, qlat, qlon, qlat / 1e5 AS lat, qlon / 1e5 AS lon FROM (
  SELECT stop_id AS ring_id, idx, CAST(floor(lat * 1e5 + 0.5) AS BIGINT) + ((idx % n) * 37 + stop_id * 11) % 100 AS qlat, CAST(floor(lon * 1e5 + 0.5) AS BIGINT) + ((idx % n) * 53 + stop_id * 7) % 150 AS qlon
  FROM (SELECT *, 5 + stop_id % 3 AS n FROM fx_stops) CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5), (6), (7)) AS k(idx) WHERE idx < n OR (idx = n AND stop_id % 4 <> 0))"""


def ring_points(fx) -> DataFrame:
    return fx.sql(RING, fx_stops=fx.fx_stops)


SIDES = "SELECT *, coalesce(lead(qlat) OVER o, first_value(qlat) OVER o) AS nlat, coalesce(lead(qlon) OVER o, first_value(qlon) OVER o) AS nlon, row_number() OVER o AS k, count(*) OVER (PARTITION BY ring_id) AS m, first_value(qlat) OVER o AS lat0, first_value(qlon) OVER o AS lon0 FROM ring WINDOW o AS (PARTITION BY ring_id ORDER BY idx)"
AREA2 = "SELECT ring_id, CAST(sum(qlon * nlat - nlon * qlat) AS BIGINT) AS area2, any_value(lat0) AS lat0 FROM sides GROUP BY ring_id"
RINGS = {"ring": RING, "sides": SIDES, "area": AREA2}
POINTS_TEXT = "string_agg(qlon || ',' || qlat, ' ' ORDER BY {})"


def as_text(ring) -> F.Column:
    return F.array_join(F.transform(ring, lambda p: F.concat_ws(",", p["qlon"].cast("string"), p["qlat"].cast("string"))), " ")


@query("SELECT ring_id, idx, lat, lon FROM ring", RINGS)
def ring_dequantize(fx):
    """Rings as files keep them (JSON arrays of whole 1e-5 degrees), read back to degrees."""
    text = rings.rings(ring_points(fx)).select("ring_id", F.to_json(F.transform("ring", lambda p: F.array(p["qlat"], p["qlon"]))).alias("t"))
    point = text.select("ring_id", F.posexplode(F.from_json("t", "array<array<bigint>>")).alias("idx", "p"))
    return point.select("ring_id", "idx", (F.col("p")[0] / 1e5).alias("lat"), (F.col("p")[1] / 1e5).alias("lon"))


@query("SELECT ring_id, area2 FROM area", RINGS)
def ring_signed_area(fx):
    return rings.rings(ring_points(fx)).select("ring_id", rings.twice_area(F.col("ring")).alias("area2"))


@query(f"SELECT ring_id, CAST(floor(abs(area2) / 2e10 * {M} * {M} * cos(radians(lat0 / 1e5))) AS BIGINT) AS m2 FROM area", RINGS)
def ring_area_km2(fx):
    return rings.rings(ring_points(fx)).select("ring_id", rings.area_m2(F.col("ring")).alias("m2"))


@query("SELECT ring_id, count(*) > 3 AND arg_min(qlat, idx) = arg_max(qlat, idx) AND arg_min(qlon, idx) = arg_max(qlon, idx) AS closed FROM ring GROUP BY ring_id", RINGS)
def ring_closed(fx):
    return rings.rings(ring_points(fx)).select("ring_id", rings.closed(F.col("ring")).alias("closed"))


@query(f"SELECT ring_id, {POINTS_TEXT.format('CASE WHEN area2 > 0 THEN -idx ELSE idx END')} AS points FROM ring JOIN area USING (ring_id) GROUP BY ring_id", RINGS)
def ring_orient(fx):
    return rings.rings(ring_points(fx)).select("ring_id", as_text(rings.orient(F.col("ring"), True)).alias("points"))


THIN = {
    **RINGS,
    "spot": f"SELECT ring_id, idx, m, qlon * scale AS x, qlat * {M} / 1e5 AS y FROM (SELECT *, {M} / 1e5 * cos(radians(lat0 / 1e5)) AS scale FROM sides)",
    "stretch": """SELECT ring_id, 0 AS i, CAST(max(idx) AS INTEGER) AS j FROM spot GROUP BY ring_id HAVING count(*) >= 8
  UNION ALL SELECT ring_id, unnest([i, w]), unnest([w, j]) FROM (SELECT ring_id, i, j, arg_min(idx, (-gap, idx)) AS w, max(gap) AS far FROM (
    SELECT s.*, p.idx, sqrt(power(px - f * dx, 2) + power(py - f * dy, 2)) AS gap FROM stretch s JOIN spot a ON a.ring_id = s.ring_id AND a.idx = s.i JOIN spot b ON b.ring_id = s.ring_id AND b.idx = s.j
      JOIN spot p ON p.ring_id = s.ring_id AND p.idx > s.i AND p.idx < s.j, LATERAL (SELECT b.x - a.x AS dx, b.y - a.y AS dy, p.x - a.x AS px, p.y - a.y AS py),
      LATERAL (SELECT CASE WHEN dx * dx + dy * dy > 0 THEN greatest(0.0e0, least(1.0e0, (px * dx + py * dy) / (dx * dx + dy * dy))) ELSE 0 END AS f)) GROUP BY ring_id, i, j) WHERE far > 15""",
}


@query(f"SELECT ring_id, {POINTS_TEXT.format('idx')} AS points FROM sides s WHERE m < 8 OR EXISTS (SELECT 1 FROM stretch t WHERE t.ring_id = s.ring_id AND s.idx IN (t.i, t.j)) GROUP BY ring_id", THIN)
def ring_simplify(fx):
    """Rings within 15 m; those of fewer than eight points stay as they are."""
    return rings.simplify(rings.rings(ring_points(fx)), 15.0).select("ring_id", as_text(F.col("ring")).alias("points"))


@query(f"SELECT ring_id, {POINTS_TEXT.format('idx')} AS points FROM ring WHERE ring_id % 4 <> 0 GROUP BY ring_id", RINGS)
def ring_stitch(fx):
    """Closed rings cut into their sides, every other side turned round, and joined again."""
    r = rings.rings(ring_points(fx).where("ring_id % 4 <> 0"))
    side = r.select("ring_id", F.posexplode(F.zip_with(F.expr("slice(ring, 1, size(ring) - 1)"), F.expr("slice(ring, 2, size(ring) - 1)"), lambda a, b: F.array(a, b))).alias("chain_id", "side"))
    side = side.select(F.col("ring_id").alias("relation_id"), "chain_id", F.when(F.col("chain_id") % 2 == 1, F.reverse("side")).otherwise(F.col("side")).alias("ring"))
    return rings.stitch(side).select(F.col("relation_id").alias("ring_id"), as_text(F.col("ring")).alias("points"))


CELLS = "SELECT CAST(i AS BIGINT) AS cell, i % gw AS x, i // gw AS y FROM box, generate_series(0, (SELECT gw * gh - 1 FROM box)) AS g(i)"
FILL_SIDES = f"SELECT {PX.format('qlon / 1e5')} AS ax, {PY.format('qlat / 1e5')} AS ay, {PX.format('nlon / 1e5')} AS bx, {PY.format('nlat / 1e5')} AS by FROM sides, box"
FILL = "SELECT cell FROM cells c JOIN fs s ON (s.ay <= c.y + 0.5) <> (s.by <= c.y + 0.5) AND s.ax + (c.y + 0.5 - s.ay) * (s.bx - s.ax) / (s.by - s.ay) <= c.x + 0.5 GROUP BY cell HAVING sum(CASE WHEN s.by > s.ay THEN 1 ELSE -1 END) <> 0"


@query("SELECT cell FROM filled", {"box": BOX, **RINGS, "cells": CELLS, "fs": FILL_SIDES, "filled": FILL})
def raster_fill(fx):
    grid = grid_of(fx)
    return tiles.cells(tiles.fill(ring_points(fx), grid), grid)


# a river past every tenth stop, a bridge over it at every thirtieth
LINE = """SELECT stop_id, lat AS lat_a, 21.018e0 AS lon_a, lat + 0.0012e0 AS lat_b, 21.018e0 AS lon_b, 0 AS bridge FROM fx_stops WHERE stop_id % 10 = 0
  UNION ALL SELECT stop_id, lat + 0.0006e0, 21.0165e0, lat + 0.0006e0, 21.0195e0, 1 FROM fx_stops WHERE stop_id % 30 = 0"""
SEG = f"SELECT bridge, {PX.format('lon_a')} AS ax, {PY.format('lat_a')} AS ay, {PX.format('lon_b')} AS bx, {PY.format('lat_b')} AS y2, greatest(CASE bridge WHEN 0 THEN 3.0e0 ELSE 1.5e0 END, CASE bridge WHEN 0 THEN 100.0e0 ELSE 50.0e0 END / res) / 2 AS half FROM line, box"
STRUCK = """SELECT DISTINCT cell, bridge FROM (SELECT cell, bridge, half, x + 0.5 - ax AS qx, y + 0.5 - ay AS qy, bx - ax AS dx, y2 - ay AS dy FROM cells, seg) t,
  LATERAL (SELECT greatest(0.0e0, least(1.0e0, (qx * dx + qy * dy) / (dx * dx + dy * dy))) AS f) WHERE (qx - f * dx) * (qx - f * dx) + (qy - f * dy) * (qy - f * dy) <= half * half"""
LAND = "SELECT cell FROM cells WHERE cell NOT IN (SELECT cell FROM struck WHERE bridge = 0) OR cell IN (SELECT cell FROM struck WHERE bridge = 1)"
GROUND = {"box": BOX, "cells": CELLS, "line": LINE, "seg": SEG, "struck": STRUCK, "land": LAND}


#: The city: the rings beside every third stop.
CITY = "SELECT * FROM ring WHERE ring_id % 3 = 0"


def city_mask(fx, grid: Grid) -> DataFrame:
    return tiles.fill(ring_points(fx).where("ring_id % 3 = 0"), grid)


def land_mask(fx, grid: Grid) -> DataFrame:
    """Tiles of cells off the water, and of those that a bridge opens again."""
    lines = fx.sql(LINE, fx_stops=fx.fx_stops)
    water = tiles.stroke(lines.where("bridge = 0"), grid, raster.WATER_PX, raster.WATER_M)
    bridge = tiles.stroke(lines.where("bridge = 1"), grid, raster.BRIDGE_PX, raster.BRIDGE_M)
    return tiles.without(tiles.every(fx.spark, grid), tiles.without(water, bridge))


def land_of(fx, grid: Grid) -> DataFrame:
    """The same as a row a cell."""
    return tiles.cells(land_mask(fx, grid), grid)


@query("SELECT cell FROM land", GROUND)
def raster_stroke(fx):
    return land_of(fx, grid_of(fx))


def relax(name: str, seeds: str, edges: str, cap: str) -> str:
    """A recursive named query of least times (node, t)."""
    return f"""{name}(node, t) USING KEY (node) AS ({seeds} UNION
  SELECT e.v, min(r.t + e.sec) FROM {name} r JOIN {edges} e ON e.u = r.node LEFT JOIN recurring.{name} b ON b.node = e.v
  WHERE r.t + e.sec <= {cap} AND (b.t IS NULL OR r.t + e.sec < b.t) GROUP BY e.v)"""


def recursive(name: str, relation: str) -> None:
    at = ORACLES[name].rindex("\nSELECT ")
    ORACLES[name] = f"{ORACLES[name][:at]}, {relation}{ORACLES[name][at:]}"


MOVES = "SELECT a.cell AS u, b.cell AS v, CASE WHEN a.cell % gw = b.cell % gw OR a.cell // gw = b.cell // gw THEN 26 ELSE 37 END AS sec FROM land a JOIN box ON true CROSS JOIN (VALUES (-1), (0), (1)) AS i(dx) CROSS JOIN (VALUES (-1), (0), (1)) AS j(dy) JOIN land b ON b.cell = a.cell + dy * gw + dx AND a.cell % gw + dx BETWEEN 0 AND gw - 1 WHERE dx <> 0 OR dy <> 0"
#: Stops within ten minutes of the origin start the flood, which goes on for two.
FLOOD_CAP, FLOOD_FROM = 720, 600
#: A place on water goes to the first land cell to its west, east, north or south.
SEEDS = f"""SELECT cell, min(sec) AS sec FROM (SELECT spot, any_value(t) AS sec, arg_min(l.cell, o) AS cell FROM (
    SELECT spot, t, o, CASE WHEN spot % gw + dx BETWEEN 0 AND gw - 1 AND spot // gw + dy BETWEEN 0 AND gh - 1 THEN spot + dy * gw + dx END AS cell
    FROM (SELECT {cell_sql('lat', 'lon')} AS spot, min(sec) AS t FROM access JOIN fx_stops USING (stop_id), box WHERE sec <= {FLOOD_FROM} GROUP BY 1) s, box,
      (VALUES (0, 0, 0), (1, -1, 0), (2, 1, 0), (3, 0, -1), (4, 0, 1)) AS k(o, dx, dy) WHERE spot IS NOT NULL) c JOIN land l ON l.cell = c.cell GROUP BY spot) GROUP BY cell"""


def near_cells_of(fx, grid: Grid) -> DataFrame:
    """(node, t): the cells of the stops near the origin, with their times."""
    at = reach.access(fx.fx_stops, *A).where(F.col("sec") <= FLOOD_FROM).join(fx.fx_stops, "stop_id")
    return at.select(grid.cell(F.col("lat"), F.col("lon")).alias("node"), F.col("sec").alias("t"))


def seeds_of(fx, grid: Grid, land: DataFrame) -> DataFrame:
    return raster.on_land(near_cells_of(fx, grid), land, grid)


def flood_of(fx, grid: Grid, land: DataFrame) -> DataFrame:
    """Tiles of times over the mask ``land``, from the stops near the origin."""
    return tiles.flood(tiles.on_land(near_cells_of(fx, grid), land, grid), land, grid, FLOOD_CAP)


@query("SELECT node AS cell, t AS sec FROM flood", {"access": ACCESS, **GROUND, "moves": MOVES, "seeds": SEEDS})
def grid_flood(fx):
    """Walking times over land cells, from the stops near the origin."""
    grid = grid_of(fx)
    return tiles.timed_cells(flood_of(fx, grid, staged(land_mask(fx, grid), "land")), grid, FLOOD_CAP)


recursive("grid_flood", relax("flood", "SELECT cell, sec FROM seeds", "moves", FLOOD_CAP))

PAINT = f"""SELECT cell, min(sec) AS sec FROM (SELECT {cell_sql('lat', 'lon')} AS cell, sec FROM (
  SELECT u_lat + (v_lat - u_lat) * f AS lat, u_lon + (v_lon - u_lon) * f AS lon, CAST(floor(least(tu + len_m * f / 1.25, tv + len_m * (1 - f) / 1.25)) AS BIGINT) AS sec FROM (
    SELECT *, i / n AS f FROM (SELECT a.lat AS u_lat, a.lon AS u_lon, b.lat AS v_lat, b.lon AS v_lon, x.t AS tu, y.t AS tv, CAST(e.len_m AS DOUBLE) AS len_m, CAST(greatest(1, floor(e.len_m / 25.0e0 + 0.5)) AS BIGINT) AS n
      FROM fx_walk_edges e JOIN fx_walk_nodes a ON a.node_id = e.u JOIN fx_walk_nodes b ON b.node_id = e.v LEFT JOIN wave x ON x.node = e.u LEFT JOIN wave y ON y.node = e.v WHERE x.t IS NOT NULL OR y.t IS NOT NULL), LATERAL (SELECT unnest(generate_series(0, n)) AS i))), box)
  WHERE cell IS NOT NULL GROUP BY cell"""


@query(f"SELECT cell, sec FROM ({PAINT})", {"box": BOX, "adj": ADJ})
def paint_network(fx):
    """Times along streets, from the walking times at their ends, as cells."""
    return raster.paint(fx.fx_walk_edges, fx.fx_walk_nodes, walk_times(fx), grid_of(fx))


recursive("paint_network", WAVE)
