"""Distance joins and walking links between stops."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr as X
from ..plans.stages import staged


def within_distance(stops: DataFrame, metres: float) -> DataFrame:
    """(a, b, m): pairs of stops at most ``metres`` apart, a south of b (or equal and of the lesser id).

    Stops are dealt to cells of that size; one side looks into its 3 x 3 cells, so the join
    is on the cell and each stop meets its neighbourhood only. Cells are as wide as the
    northernmost stop needs (one aggregate).
    """
    far = stops.agg(F.max(F.abs("lat"))).first()[0] or 0.0
    step_lat = metres / X.M_PER_DEG
    step_lon = step_lat / max(math.cos(math.radians(min(far + step_lat, 89.9))), 1e-6)
    cell = stops.select("stop_id", "lat", "lon", F.floor(F.col("lat") / step_lat).alias("cy"), F.floor(F.col("lon") / step_lon).alias("cx"))
    a = cell.select(*[F.col(c).alias(f"a_{c}") for c in cell.columns])
    near = F.sequence(F.lit(-1), F.lit(1))
    a = a.withColumn("dy", F.explode(near)).withColumn("dx", F.explode(near)).select("a_stop_id", "a_lat", "a_lon", (F.col("a_cy") + F.col("dy")).alias("cy"), (F.col("a_cx") + F.col("dx")).alias("cx"))
    m = X.distance_m(F.col("a_lat"), F.col("a_lon"), F.col("lat"), F.col("lon"))
    first = (F.col("a_lat") < F.col("lat")) | ((F.col("a_lat") == F.col("lat")) & (F.col("a_stop_id") < F.col("stop_id")))
    return a.join(cell, ["cy", "cx"]).where(first).select(F.col("a_stop_id").alias("a"), F.col("stop_id").alias("b"), m.alias("m")).where(F.col("m") <= metres)


def transfer_pairs(stops: DataFrame) -> DataFrame:
    return within_distance(stops, X.TRANSFER_MAX_M).select("a", "b", X.walk_seconds(F.col("m")).alias("sec"))


def both_ways(pairs: DataFrame, least: int = X.MIN_TRANSFER_S) -> DataFrame:
    """(u, v, sec) in both directions, at least ``least`` seconds."""
    sec = F.greatest("sec", F.lit(least)).cast("long").alias("sec")
    return pairs.select(F.col("a").alias("u"), F.col("b").alias("v"), sec).unionByName(pairs.select(F.col("b").alias("u"), F.col("a").alias("v"), sec))


def same_name_pairs(stops: DataFrame, metres: float = X.GROUP_MAX_M) -> DataFrame:
    """(a, b): stops of one name at most ``metres`` apart, a < b; joined on name and grid cell, so a frequent name is no hot key."""
    near = near_stops(stops.select(F.col("stop_id").alias("a"), "lat", "lon", "stop_name"), "a", stops, metres, by=("stop_name",))
    return near.where("a < stop_id").select("a", F.col("stop_id").alias("b"))


def complex_pairs(stops: DataFrame) -> DataFrame:
    """(u, v, sec): stops of other names at most 150 m apart, both ways."""
    name = stops.select("stop_id", "stop_name")
    near = within_distance(stops, X.COMPLEX_MAX_M).join(name.toDF("a", "name_a"), "a").join(name.toDF("b", "name_b"), "b").where("name_a <> name_b")
    return both_ways(near.select("a", "b", X.walk_seconds(F.col("m")).alias("sec")))


def access_walk(stops: DataFrame, lat: float, lon: float) -> DataFrame:
    """(stop_id, metres, sec) of stops that a walk within the horizon reaches."""
    m = X.distance_m(F.lit(lat), F.lit(lon), F.col("lat"), F.col("lon"))
    return stops.select("stop_id", m.alias("metres")).where(F.col("metres") <= X.HORIZON_S * X.WALK_MPS).withColumn("sec", X.walk_seconds(F.col("metres")))


def group_adjacency(stops: DataFrame) -> DataFrame:
    """(u, v, sec): stops of one ``group_id``, both ways."""
    x, y = (stops.select(F.col("stop_id").alias(i), "group_id", F.col("lat").alias(f"lat_{i}"), F.col("lon").alias(f"lon_{i}")) for i in "ab")
    m = X.distance_m(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b"))
    return both_ways(x.join(y, "group_id").where("a < b").select("a", "b", X.walk_seconds(m).alias("sec")))


def access_nowalk(stops: DataFrame, lat: float, lon: float) -> DataFrame:
    """(stop_id, sec 0): the stop nearest to a point (least id of equals), its group and stops at most 150 m from it."""
    m = X.distance_m(F.lit(lat), F.lit(lon), F.col("lat"), F.col("lon"))
    o = stops.agg(F.min_by(F.struct("lat", "lon", "group_id"), F.struct(m, "stop_id")).alias("o"))
    near = X.distance_m(F.col("o.lat"), F.col("o.lon"), F.col("lat"), F.col("lon")) <= X.COMPLEX_MAX_M
    return stops.join(F.broadcast(o)).where((F.col("group_id") == F.col("o.group_id")) | near).select("stop_id", F.lit(0).alias("sec"))


def next_departure(asked: DataFrame, ev: DataFrame) -> DataFrame:
    """(stop_id, at_sec, dep_sec): the first departure at or after each asked (stop_id, at_sec).

    Both sides are laid in one order of stop and time and each question takes the next
    departure behind it, so a busy stop costs a sort and not a row a pair; times are made
    distinct first, so a stop has at most two rows a second.
    """
    rows = asked.select("stop_id", F.col("at_sec").cast("long").alias("t"), F.lit(0).alias("kind")).distinct().unionByName(ev.select("stop_id", F.col("dep_sec").cast("long").alias("t"), F.lit(1).alias("kind")).distinct())
    ahead = Window.partitionBy("stop_id").orderBy(F.desc("t"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, -1)
    found = rows.select("stop_id", F.col("t").alias("at_sec"), "kind", F.min(F.when(F.col("kind") == 1, F.col("t"))).over(ahead).alias("dep_sec"))
    return found.where("kind = 0 and dep_sec is not null").select("stop_id", "at_sec", "dep_sec")


def cell_width(row: Column, step: float) -> Column:
    """Degrees of longitude that one cell of a row of cells spans: ``step`` degrees of latitude at the most northern or southern place of the row and its neighbours."""
    outer, inner = (of(F.abs(row), F.abs(row + 1)) * step for of in (F.greatest, F.least))
    outer, inner = outer + step, inner - step
    narrow = F.when((inner < 90) & (outer > 90), 0.0).otherwise(F.least(F.abs(F.cos(F.radians(inner))), F.abs(F.cos(F.radians(outer)))))
    return F.lit(step) / F.greatest(narrow, F.lit(1e-6))


def near_stops(places: DataFrame, key: str, stops: DataFrame, metres: float, by: tuple[str, ...] = ()) -> DataFrame:
    """(key, stop_id, m): stops at most ``metres`` from each place (key, lat, lon) and equal in ``by``, joined on grid cells.

    Each row of cells has the width that its own latitude asks for, so a place near a pole widens its own row only.
    """
    step = metres / X.M_PER_DEG
    near = F.sequence(F.lit(-1), F.lit(1))
    row = lambda lat: F.floor(F.col(lat) / step)
    p = places.select(key, *by, F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon")).withColumn("cy", F.explode(F.transform(near, lambda d: row("p_lat") + d)))
    p = p.withColumn("cx", F.explode(F.transform(near, lambda d: F.floor(F.col("p_lon") / cell_width(F.col("cy"), step)) + d)))
    s = stops.select("stop_id", *by, "lat", "lon", row("lat").alias("cy"))
    s = s.withColumn("cx", F.floor(F.col("lon") / cell_width(F.col("cy"), step)))
    m = X.distance_m(F.col("p_lat"), F.col("p_lon"), F.col("lat"), F.col("lon"))
    return p.join(s, ["cy", "cx", *by]).select(key, "stop_id", m.alias("m")).where(F.col("m") <= metres)


#: The first search ring in metres; each further ring is four times as wide. The last one is
#: wider than any walk of the raster's time (90 minutes) goes.
RING_M, RINGS = 500.0, 3


def nearest_reached(places: DataFrame, stops: DataFrame) -> DataFrame:
    """(node_id, total, stop_id): the nearest stop (stop_id, lat, lon, sec) with sec <= total + 1 of each place (node_id, lat, lon, total).

    Rings of growing width are searched on grid cells; places that found a stop within a
    ring's width leave the next ones. A place that no stop within 8 km may have served has no row.
    """
    left, out, metres = staged(places, "places"), None, RING_M
    for _ in range(RINGS):
        near = near_stops(left, "node_id", stops, metres).join(left.select("node_id", "total"), "node_id").join(stops.select("stop_id", "sec"), "stop_id").where("sec <= total + 1")
        found = near.groupBy("node_id").agg(F.min(F.struct("m", "stop_id")).alias("o"), F.min("total").alias("total")).select("node_id", "total", "o.stop_id")
        found = staged(found, "nearest")
        out = found if out is None else out.unionByName(found)
        left = staged(left.join(found, "node_id", "left_anti"), "places")
        if left.isEmpty() or stops.isEmpty():
            break
        metres *= 4
    return out
