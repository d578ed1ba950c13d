"""Queries of street, water and city documents, of the partitioned timetable, and of city lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import raster, rings, tiles
from ..operators.numbers import numbered
from ..operators.timetable import Coded, encoded
from ..sources import streets
from .catalog import GRID, query
from .feeds import MASKED, day_masks
from .stages import stage_path, staged
from .surface import AREA2, BOX, CELLS, FILL, FILL_SIDES, POINTS_TEXT, RING, RINGS, SEG, SIDES, STRUCK, as_text, grid_of, ring_points

#: Least area of water, tolerances of city and water lines, points of a main coast.
MIN_KM2, CITY_M, WATER_M, COAST = 0.02, 40.0, 20.0, 100


# the timetable by city and day
RUNS = "SELECT trip_id, 'city' || (o_custkey % 2) AS city, unnest(['workday', 'saturday', 'sunday']) AS day, unnest([1, 2, 4]) AS bit, mask, route_id, stop_id, pos, dep_sec FROM fx_ev JOIN orders ON o_orderkey = trip_id JOIN mask m ON m.feed = o_custkey % 2 AND m.service_id = concat(o_orderstatus, '-', CAST(o_custkey AS VARCHAR))"


def run_days(fx) -> DataFrame:
    """(trip_id, city, day): every day type that a run is on."""
    order = fx.orders.select(F.col("o_orderkey").alias("trip_id"), (F.col("o_custkey") % 2).cast("int").alias("feed"), F.concat_ws("-", "o_orderstatus", "o_custkey").alias("service_id"))
    runs = order.join(day_masks(fx), ["feed", "service_id"])
    days = F.filter(F.array(*[F.struct(F.lit(d).alias("day"), F.lit(1 << i).alias("bit")) for i, d in enumerate(("workday", "saturday", "sunday"))]), lambda d: F.col("mask").bitwiseAND(d["bit"]) != 0)
    return runs.select("trip_id", F.concat(F.lit("city"), F.col("feed")).alias("city"), F.explode(days).alias("d")).select("trip_id", "city", "d.day")


def keep_timetable(fx, folder: str) -> None:
    """The sink: patterns and profiles once for all days, runs in a folder a city and day."""
    encoded(fx.fx_ev, run_days(fx)).write(folder, ["city", "day"])


def load_day(spark, folder: str, city: str, day: str) -> DataFrame:
    """One city's timetable of a day, decoded: of the runs only its folder is read."""
    return Coded.read(spark, folder).where((F.col("city") == city) & (F.col("day") == day)).events()


@query(f"SELECT trip_id, pos, stop_id, dep_sec FROM ({RUNS}) WHERE city = 'city1' AND day = 'saturday' AND mask & bit <> 0", MASKED)
def timetable_day(fx):
    folder = stage_path(fx.spark, "timetable")
    keep_timetable(fx, folder)
    return load_day(fx.spark, folder, "city1", "saturday").select("trip_id", "pos", "stop_id", "dep_sec")


@query("SELECT * FROM fx_ev")
def timetable_round_trip(fx):
    """The timetable written as patterns, profiles and starts, read and decoded: the rows that went in."""
    folder = stage_path(fx.spark, "coded")
    encoded(fx.fx_ev).write(folder, [])
    return Coded.read(fx.spark, folder).events()


SHAPED = "SELECT trip_id, any_value(route_id) AS route_id, list(stop_id ORDER BY pos) AS stops, list(flags ORDER BY pos) AS flagged, list(delta ORDER BY pos) AS deltas, list(dwell ORDER BY pos) AS dwells FROM (SELECT *, dep_sec - arr_sec AS dwell, coalesce(dep_sec - lag(dep_sec) OVER (PARTITION BY trip_id ORDER BY pos), 0) AS delta FROM fx_ev) GROUP BY trip_id"


@query("""SELECT (SELECT count(*) FROM pat) AS patterns, (SELECT count(*) FROM prof) AS profiles, (SELECT count(*) FROM shaped) AS runs,
  CAST((SELECT sum(2 + len(stops) + CASE WHEN list_sum(flagged) > 0 THEN len(flagged) ELSE 0 END) FROM pat) + (SELECT sum(len(deltas) + CASE WHEN list_sum(dwells) > 0 THEN len(dwells) ELSE 0 END) FROM prof) + 3 * (SELECT count(*) FROM shaped) AS BIGINT) AS coded,
  6 * (SELECT count(*) FROM fx_ev) AS plain""", {"shaped": SHAPED, "pat": "SELECT DISTINCT route_id, stops, flagged FROM shaped", "prof": "SELECT DISTINCT route_id, stops, flagged, deltas, dwells FROM shaped"})
def timetable_size(fx):
    """How much smaller patterns and profiles are than a row a run and stop."""
    return encoded(fx.fx_ev).size()


@query(f"SELECT city, day, count(*) AS stops, count(DISTINCT trip_id) AS trips FROM ({RUNS}) WHERE mask & bit <> 0 GROUP BY city, day", MASKED)
def timetable_totals(fx):
    """What the partitioned timetable holds for each city and day."""
    days = staged(run_days(fx), "days")
    runs = fx.fx_ev.join(days, "trip_id", "left_semi").groupBy("trip_id").agg(F.count("*").alias("n"))
    return runs.join(days, "trip_id").groupBy("city", "day").agg(F.sum("n").alias("stops"), F.count("*").alias("trips"))


#: Runs of the second feed count only if they touch its box.
FEED_RUNS = f"SELECT o_custkey % 2 AS feed, e.trip_id, bool_or(o_custkey % 2 = 0 OR (s.lat BETWEEN {GRID[0]} AND {GRID[2]} AND s.lon BETWEEN {GRID[1]} AND {GRID[3]})) AS kept FROM fx_ev e JOIN orders ON o_orderkey = e.trip_id JOIN fx_stops s ON s.stop_id = e.stop_id GROUP BY 1, 2"


#: The boxes that the feeds' configuration names; a feed without one keeps all runs.
BOXES = {0: None, 1: GRID}


def kept_runs(fx, among: DataFrame | None = None) -> DataFrame:
    """(feed, trip_id, kept): whether a run (of those ``among`` names) touches the box of its feed.

    A stop's boxes are known before the runs are, so a run's stops are drawn together to a row of flags before it meets its feed.
    """
    inside = [(F.col("lat").between(b[0], b[2]) & F.col("lon").between(b[1], b[3]) if b else F.lit(True)).alias(f"in_{f}") for f, b in BOXES.items()]
    spots = fx.fx_stops.select("stop_id", *inside)
    ev = fx.fx_ev.select("trip_id", "stop_id")
    ev = ev if among is None else ev.join(among, "trip_id", "left_semi")
    flags = ev.join(spots, "stop_id").groupBy("trip_id").agg(*[F.bool_or(f"in_{f}").alias(f"in_{f}") for f in BOXES])
    of = flags.join(fx.orders.select(F.col("o_orderkey").alias("trip_id"), (F.col("o_custkey") % 2).cast("int").alias("feed")), "trip_id").where(F.col("feed").isin(*BOXES))
    own = F.element_at(F.create_map(*[c for f in BOXES for c in (F.lit(f), F.col(f"in_{f}"))]), F.col("feed"))
    return of.groupBy("feed", "trip_id").agg(F.bool_or(own).alias("kept"))


@query("SELECT feed, count(*) FILTER (WHERE kept) AS kept, count(*) FILTER (WHERE NOT kept) AS dropped FROM runs GROUP BY feed", {"runs": FEED_RUNS})
def feed_report(fx):
    """How many runs of each feed its box keeps and drops."""
    return kept_runs(fx).groupBy("feed").agg(F.count_if("kept").alias("kept"), F.count_if(~F.col("kept")).alias("dropped"))


@query(f"SELECT 'city' || (o_custkey % 2) AS city, d.day, count(DISTINCT (h.route_id, h.stops, h.flagged)) AS patterns, count(DISTINCT (h.route_id, h.stops, h.flagged, h.deltas, h.dwells)) AS profiles, count(*) AS runs FROM shaped h JOIN runs k ON k.trip_id = h.trip_id AND k.kept JOIN orders ON o_orderkey = h.trip_id JOIN mask m ON m.feed = o_custkey % 2 AND m.service_id = concat(o_orderstatus, '-', CAST(o_custkey AS VARCHAR)) JOIN (VALUES ('workday', 1), ('saturday', 2), ('sunday', 4)) AS d(day, bit) ON m.mask & d.bit <> 0 WHERE len(h.stops) >= 2 GROUP BY 1, 2", {**MASKED, "shaped": SHAPED, "runs": FEED_RUNS})
def build_report(fx):
    """What a build writes for each city and day: patterns, profiles and runs (of two stops or more, within the feed's box)."""
    days = staged(run_days(fx), "days")
    runs = days.join(kept_runs(fx, days).where("kept").select("trip_id"), "trip_id", "left_semi")
    coded = encoded(fx.fx_ev, runs)
    named = coded.profiles.where(F.size("deltas") > 0).select("profile", "pattern")
    used = coded.runs.groupBy("city", "day", "profile").agg(F.count("*").alias("n"))  # a profile's runs are one row before it meets its pattern
    return used.join(named, "profile").groupBy("city", "day").agg(F.countDistinct("pattern").alias("patterns"), F.count("*").alias("profiles"), F.sum("n").alias("runs"))


# documents of a city
def water_doc(fx, keys: str = "both") -> DataFrame:
    """The projected rings as a water document: every third ring is a line; ``lines`` may be missing."""
    r = rings.rings(ring_points(fx))
    part = lambda of: F.collect_list(F.when(of, F.transform("ring", lambda p: F.array(p["qlat"], p["qlon"]))))
    line = F.col("ring_id") % 3 == 0
    return r.groupBy((F.col("ring_id") % 8).alias("shard")).agg(part(~line).alias("polys"), *([part(line).alias("lines")] if keys == "both" else [])).drop("shard")


def kept_as_json(fx, frame: DataFrame, name: str) -> str:
    path = stage_path(fx.spark, name)
    frame.write.json(path)
    return path


@query("SELECT CASE WHEN ring_id % 3 = 0 THEN 'line' ELSE 'poly' END AS kind, lat, lon FROM ring", {"ring": RING})
def water_load(fx):
    """Polygons and lines of a water document, in degrees."""
    doc = fx.spark.read.schema(streets.WATER).json(kept_as_json(fx, water_doc(fx), "water"))
    return streets.lines_of(doc, "polys").select(F.lit("poly").alias("kind"), "lat", "lon").unionByName(streets.lines_of(doc, "lines").select(F.lit("line").alias("kind"), "lat", "lon"))


@query("SELECT lat, lon FROM ring WHERE ring_id % 3 <> 0", {"ring": RING})
def city_load(fx):
    """The rings of a document without lines: a missing key has no rows."""
    doc = fx.spark.read.schema(streets.WATER).json(kept_as_json(fx, water_doc(fx, "polys"), "city"))
    return streets.lines_of(doc, "polys").unionByName(streets.lines_of(doc, "lines")).select("lat", "lon")


@query("SELECT u, v, len_m FROM fx_walk_edges")
def walk_graph_load(fx):
    """The walking graph written as the library keeps it and read again."""
    folder = stage_path(fx.spark, "walknet")
    fx.fx_walk_edges.write.parquet(f"{folder}/edges")
    return load_graph(fx.spark, folder)


def load_graph(spark, folder: str) -> DataFrame | None:
    """Edges of a walking graph; none where the city has none."""
    return spark.read.parquet(f"{folder}/edges") if streets.exists(spark, f"{folder}/edges") else None


@query("SELECT n_name AS city, 'workday' AS day, CAST(DATE '1996-01-16' + CAST(n_nationkey AS INT) AS VARCHAR) AS date FROM nation UNION ALL SELECT n_name, 'sunday', CAST(DATE '1996-01-21' + CAST(n_nationkey AS INT) AS VARCHAR) FROM nation WHERE n_nationkey % 2 = 0")
def meta_load(fx):
    """The metadata documents of cities: their chosen dates by day type."""
    day = lambda d: F.date_add(F.lit(d).cast("date"), F.col("n_nationkey").cast("int")).cast("string")
    dates = F.map_filter(F.create_map(F.lit("workday"), day("1996-01-16"), F.lit("sunday"), F.when(F.col("n_nationkey") % 2 == 0, day("1996-01-21"))), lambda k, v: v.isNotNull())
    path = kept_as_json(fx, fx.nation.select(F.col("n_name").alias("city"), dates.alias("dates")), "meta")
    return fx.spark.read.schema(streets.META).json(path).select("city", F.explode("dates").alias("day", "date"))


@query("SELECT n_nationkey AS city, CASE WHEN n_nationkey % 5 = 2 THEN NULL WHEN n_nationkey % 5 = 3 THEN 0 ELSE 2 * (1 + n_nationkey % 3) END AS points, CASE WHEN n_nationkey % 5 NOT IN (2, 3) THEN 52.0e0 + n_nationkey / 1e2 END AS lat FROM nation")
def bridges_load(fx):
    """The bridges of each city's document: null where the document is broken, none where it has no lines."""
    key = F.col("n_nationkey")
    line = F.array(F.array((F.lit(5200000) + 1000 * key).cast("long"), F.lit(2100000).cast("long")), F.array((F.lit(5200000) + 1000 * key).cast("long"), F.lit(2100100).cast("long")))
    text = F.to_json(F.struct(F.array_repeat(line, (key % 3 + 1).cast("int")).alias("lines")))
    docs = fx.nation.select(key.alias("city"), F.when(key % 5 == 2, F.concat(F.lit("<html>"), text)).when(key % 5 == 3, "{\"lines\": []}").otherwise(text).alias("doc"))
    return streets.bridge_lines(docs, "doc").select("city", F.size(F.flatten("lines")).alias("n"), F.get(F.flatten("lines"), F.lit(0))["lat"].alias("lat"), F.col("lines").isNull().alias("none")).select("city", F.when(~F.col("none"), F.col("n")).alias("points"), "lat")


# elements
KINDS = "SELECT s_suppkey AS id, CASE s_suppkey % 5 WHEN 0 THEN 'motorway' WHEN 1 THEN 'footway' WHEN 2 THEN 'trunk_link' END AS highway, CASE s_suppkey % 4 WHEN 0 THEN 'river' WHEN 1 THEN 'canal' WHEN 2 THEN 'riverbank' END AS waterway, CASE WHEN s_suppkey % 6 = 0 THEN 'node' ELSE 'way' END AS type, s_suppkey % 7 AS points FROM supplier"


def element_docs(fx) -> DataFrame:
    kind = fx.sql(KINDS, supplier=fx.supplier)
    pairs = F.filter(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).alias("value")) for k in ("highway", "waterway")]), lambda p: p["value"].isNotNull())
    at = F.struct((F.lit(52.2) + F.col("id") / 1000).alias("lat"), F.lit(21.0).alias("lon"))
    geometry = F.when(F.col("points") > 0, F.array_repeat(at, F.col("points").cast("int"))).when(F.col("id") % 2 == 0, F.array().cast(f"array<{streets.POINT}>"))
    one = F.struct("type", "id", F.map_from_entries(pairs).alias("tags"), geometry.alias("geometry"))
    return kind.select(F.to_json(F.struct(F.array(one).alias("elements"))).alias("doc"))


@query(f"SELECT id FROM ({KINDS}) WHERE type = 'way' AND points > 0 AND coalesce(highway, '') NOT IN ('motorway', 'trunk_link')")
def bridge_filter(fx):
    return streets.bridges(streets.elements(element_docs(fx), "doc")).select("id")


@query(f"SELECT id FROM ({KINDS}) WHERE type = 'way' AND waterway IN ('river', 'canal') AND (points > 0 OR id % 2 = 0)")
def waterway_filter(fx):
    return streets.waterways(streets.elements(element_docs(fx), "doc")).select("id")


# city boundaries and water from relations
def relations(fx) -> DataFrame:
    """(relation_id, role, chain_id, ring): each projected ring as a relation of two ways, every other ring of the role `inner`."""
    r = rings.rings(ring_points(fx))
    half = F.floor(F.size("ring") / 2).cast("int")
    ways = F.array(F.slice("ring", F.lit(1), half + 1), F.slice("ring", half + 1, F.size("ring") - half))
    doc = r.select(F.col("ring_id").alias("relation_id"), F.when(F.col("ring_id") % 2 == 0, "outer").otherwise("inner").alias("role"), F.posexplode(ways).alias("chain_id", "way"))
    return doc.select("relation_id", "role", "chain_id", F.when(F.col("chain_id") == 1, F.reverse("way")).otherwise(F.col("way")).alias("ring"))


def assembled(fx, tolerance_m: float, least_km2: float = MIN_KM2) -> DataFrame:
    """(ring_id, ring): the relations' whole rings, outer ones clockwise, inner ones the other way."""
    chains = relations(fx)
    role = chains.select("relation_id", "role").distinct()
    whole = rings.whole_rings(chains.select("relation_id", "chain_id", "ring"), tolerance_m, least_km2).join(role, "relation_id")
    turned = F.when(F.col("role") == "outer", rings.orient(F.col("ring"), True)).otherwise(rings.orient(F.col("ring"), False))
    return whole.select(F.col("relation_id").alias("ring_id"), turned.alias("ring"))


OPEN = "SELECT r.* FROM ring r JOIN (SELECT ring_id, max(idx) AS last FROM ring GROUP BY ring_id) m USING (ring_id) WHERE ring_id % 4 <> 0 AND idx < last"
OPEN_AREA = AREA2.replace("FROM sides", "FROM open_sides")
OPENED = {**RINGS, "open": OPEN, "open_sides": SIDES.replace("FROM ring", "FROM open"), "open_area": OPEN_AREA}
TURN = "((ring_id % 2 = 0 AND area2 > 0) OR (ring_id % 2 = 1 AND area2 < 0))"
TURNED = f"CASE WHEN {TURN} THEN -idx ELSE idx END"
#: Rings of the projected tables are small: the least area that their water has.
RING_KM2 = 0.001


@query(f"SELECT ring_id, {POINTS_TEXT.format(TURNED)} AS points FROM open JOIN open_area USING (ring_id) GROUP BY ring_id", OPENED)
def city_rings(fx):
    """City boundaries: ways stitched to rings, open ones left out, simplified to 40 m (short rings stay), turned by their role."""
    return assembled(fx, CITY_M, 0.0).select("ring_id", as_text(F.col("ring")).alias("points"))


M2 = "floor(abs(area2) / 2e10 * 111320.0 * 111320.0 * cos(radians(lat0 / 1e5)))"
WATER_SIDES = f"SELECT s.ring_id, CASE WHEN turn THEN nlat ELSE qlat END AS qlat, CASE WHEN turn THEN nlon ELSE qlon END AS qlon, CASE WHEN turn THEN qlat ELSE nlat END AS nlat, CASE WHEN turn THEN qlon ELSE nlon END AS nlon FROM open_sides s JOIN (SELECT ring_id, {TURN} AS turn FROM open_area WHERE {M2} >= {int(RING_KM2 * 1e6)}) t USING (ring_id)"


@query("SELECT cell FROM filled", {"box": BOX, **OPENED, "water": WATER_SIDES, "cells": CELLS, "fs": FILL_SIDES.replace("FROM sides", "FROM water"), "filled": FILL})
def water_mask(fx):
    """Cells of water: the relations' rings of a least area, filled where they wind round a cell."""
    whole = assembled(fx, WATER_M, RING_KM2)
    grid = grid_of(fx)
    return tiles.cells(tiles.fill_sides(rings.ring_sides(whole), grid), grid)


# a coast from north to south, islands off it, lakes and rivers behind it
COAST_POINTS = "SELECT p_partkey AS i, 5220000 + p_partkey - CAST(floor(c.n / 2) AS BIGINT) AS qlat, 2101800 + (p_partkey * 37) % 50 AS qlon FROM part CROSS JOIN (SELECT count(*) AS n FROM part) c"
#: The sea's corner, north and east of everything.
SEA, PIECE = (90.0, 21.1), 40
CORNERS = "(VALUES (0, 0, 0), (1, 0, 60), (2, 60, 60), (3, 60, 0), (4, 0, 0)) AS k(idx, up, aside)"
SPOTS = "SELECT s_suppkey AS id, 5220000 + 120 * CAST(floor(s_suppkey / 10) AS BIGINT) AS qlat, 2100000 + 400 * (s_suppkey % 10) AS qlon FROM supplier"
ISLANDS = f"SELECT id, idx, qlat + up AS qlat, qlon + aside AS qlon FROM ({SPOTS}) s CROSS JOIN {CORNERS} WHERE id % 10 = 6"
LAKES = f"SELECT id, idx, qlat + up AS qlat, qlon + aside AS qlon FROM ({SPOTS}) s CROSS JOIN {CORNERS} WHERE id % 10 = 2"
RIVERS = f"SELECT id, idx, qlat + 50 AS qlat, 2100000 + 900 * idx AS qlon FROM ({SPOTS}) s CROSS JOIN (VALUES (0), (1), (2)) AS k(idx) WHERE id % 20 = 0"


def coast_ways(fx) -> DataFrame:
    """(relation_id, chain_id, ring): the coast cut into pieces, the first of which lies in its middle, every third turned round; and its islands."""
    point = fx.sql(COAST_POINTS, part=fx.part)
    last = point.agg(F.max("i").alias("last"))
    piece = point.join(F.broadcast(last)).withColumn("piece", F.explode(F.array_distinct(F.array(F.floor(F.col("i") / PIECE), F.floor((F.col("i") - 1) / PIECE)))))  # one row
    n = F.floor(F.col("last") / PIECE) + 1
    piece = piece.where(f"piece >= 0 and not (i = piece * {PIECE} and i = last)").select((n + F.col("piece") - F.floor(n / 2)).alias("k"), n.alias("n"), F.col("i").alias("idx"), "qlon", "qlat")
    ring = rings.rings(piece.select((F.col("k") % F.col("n")).alias("ring_id"), "idx", "qlon", "qlat"))
    chain = ring.select(F.lit(0).cast("long").alias("relation_id"), F.col("ring_id").alias("chain_id"), F.when(F.col("ring_id") % 3 == 1, F.reverse("ring")).otherwise(F.col("ring")).alias("ring"))
    island = rings.rings(fx.sql(ISLANDS, supplier=fx.supplier).withColumnRenamed("id", "ring_id"))
    return chain.unionByName(island.select((F.col("ring_id") + 1).cast("long").alias("relation_id"), F.lit(0).cast("long").alias("chain_id"), "ring"))


@query("SELECT count(*) AS n, min(i) AS first, md5(string_agg(qlon || ',' || qlat, ' ' ORDER BY i)) AS points FROM coast", {"coast": COAST_POINTS})
def coast_stitch(fx):
    """Pieces of an open coast joined on both sides of the first one."""
    line = rings.stitch(coast_ways(fx).where("relation_id = 0")).where(~rings.closed(F.col("ring")))
    first = fx.sql(COAST_POINTS, part=fx.part).select("i", "qlat", "qlon")
    named = line.select(F.size("ring").cast("long").alias("n"), F.col("ring")[0]["qlat"].alias("qlat"), F.md5(as_text(F.col("ring"))).alias("points"))
    return named.join(first, "qlat").select("n", F.col("i").alias("first"), "points")


SEA_RING = f"""SELECT 0 AS ring_id, i AS idx, qlat, qlon FROM coast
  UNION ALL SELECT 0, last + k, CASE k WHEN 3 THEN lat0 ELSE {round(SEA[0] * 1e5)} END, CASE k WHEN 1 THEN lon1 ELSE {round(SEA[1] * 1e5)} END FROM (SELECT max(i) AS last, arg_min(qlat, i) AS lat0, arg_max(qlon, i) AS lon1 FROM coast) CROSS JOIN (VALUES (1), (2), (3)) AS c(k)
  UNION ALL SELECT 1 + id, CASE WHEN id % 10 = 2 THEN -idx ELSE idx END, qlat, qlon FROM (SELECT * FROM islands UNION ALL SELECT * FROM lakes) WHERE idx < 4"""
RIVER_LINE = "SELECT qlat / 1e5 AS lat_a, qlon / 1e5 AS lon_a, nlat / 1e5 AS lat_b, nlon / 1e5 AS lon_b, 0 AS bridge FROM (SELECT *, lead(qlat) OVER o AS nlat, lead(qlon) OVER o AS nlon FROM rivers WINDOW o AS (PARTITION BY id ORDER BY idx)) WHERE nlat IS NOT NULL"


def water_tiles(fx, grid) -> DataFrame:
    """Tiles of the sea without its islands, of lakes and of rivers."""
    sea = rings.coast_sides(coast_ways(fx), SEA, RING_KM2, COAST)
    lakes = rings.rings(fx.sql(LAKES, supplier=fx.supplier).withColumnRenamed("id", "relation_id").withColumnRenamed("relation_id", "ring_id"))
    lakes = rings.whole_rings(lakes.select(F.col("ring_id").alias("relation_id"), F.lit(0).alias("chain_id"), "ring"), 0.0, RING_KM2)
    lakes = rings.ring_sides(lakes.select(rings.orient(F.col("ring"), True).alias("ring")))
    ways = fx.sql(RIVERS, supplier=fx.supplier)
    # a river of two ways that meet in its middle
    ways = ways.withColumn("way", F.explode(F.when(F.col("idx") == 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.floor(F.col("idx") / 2).cast("int")))))
    way = rings.rings(ways.select(F.struct("id", "way").alias("ring_id"), F.col("idx"), "qlon", "qlat"))
    rivers = rings.stitch(way.select(F.col("ring_id.id").alias("relation_id"), F.col("ring_id.way").alias("chain_id"), "ring"))
    return tiles.union(tiles.fill_sides(sea.unionByName(lakes), grid), tiles.stroke(rings.segments(rivers), grid, raster.WATER_PX, raster.WATER_M))


@query("SELECT cell FROM filled UNION SELECT cell FROM struck", {"box": BOX, "coast": COAST_POINTS, "islands": ISLANDS, "lakes": LAKES, "rivers": RIVERS, "ring": SEA_RING, "sides": SIDES, "cells": CELLS, "fs": FILL_SIDES, "filled": FILL, "line": RIVER_LINE, "seg": SEG, "struck": STRUCK})
def coast_mask(fx):
    """Cells of water on a coast: the sea closed over its corner, without islands, with lakes and rivers."""
    grid = grid_of(fx)
    return tiles.cells(water_tiles(fx, grid), grid)


@query("SELECT count(*) AS cells FROM (SELECT cell FROM filled UNION SELECT cell FROM struck)", {"box": BOX, "coast": COAST_POINTS, "islands": ISLANDS, "lakes": LAKES, "rivers": RIVERS, "ring": SEA_RING, "sides": SIDES, "cells": CELLS, "fs": FILL_SIDES, "filled": FILL, "line": RIVER_LINE, "seg": SEG, "struck": STRUCK})
def water_cells(fx):
    """How many of them there are, counted on the tiles."""
    return tiles.size(water_tiles(fx, grid_of(fx)))


# city lists
NAMED = "SELECT n_nationkey AS city_id, replace(replace(n_name, 'L', 'Ł'), 'A', 'Ą') AS name FROM nation"


@query(f"SELECT city_id, name, row_number() OVER (ORDER BY name COLLATE pl, city_id) AS ord FROM ({NAMED})")
def city_sort_collated(fx):
    """Cities in the order of the Polish alphabet."""
    return numbered(fx.sql(NAMED, nation=fx.nation), [F.collate("name", "pl"), F.col("city_id")], "ord", 1).select("city_id", "name", "ord")


@query("SELECT CAST(count(*) AS BIGINT) AS edges, CAST(sum(len_m) AS BIGINT) AS metres, (SELECT count(*) FROM fx_ev) AS stops, (SELECT count(DISTINCT trip_id) FROM fx_ev) AS trips, (SELECT count(*) FROM open_area) AS rings, (SELECT CAST(sum(m2) AS BIGINT) FROM (SELECT CAST({m2} AS BIGINT) AS m2 FROM open_area)) AS m2 FROM fx_walk_edges".replace("{m2}", M2), OPENED)
def build_totals(fx):
    """What a build reports: edges and metres of streets, stops and runs of the timetable, rings and area of the city."""
    street = fx.fx_walk_edges.agg(F.count("*").alias("edges"), F.sum("len_m").cast("long").alias("metres"))
    runs = fx.fx_ev.agg(F.count("*").alias("stops"), F.countDistinct("trip_id").alias("trips"))
    city = rings.whole_rings(relations(fx).select("relation_id", "chain_id", "ring"), CITY_M).agg(F.count("*").alias("rings"), F.sum(rings.area_m2(F.col("ring"))).alias("m2"))
    return street.join(F.broadcast(runs)).join(F.broadcast(city))  # one row each
