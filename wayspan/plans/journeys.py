"""Queries of whole searches: directions, night, walking waves, statistics, journeys, live counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expr as X
from ..operators import proximity, raster, reach, tiles
from ..operators import search as searches
from ..operators.raster import Grid
from ..sources import gtfs, streets
from ..streaming import delays
from ..streaming.kept import Kept
from .catalog import A, ACCESS, ADJ, FOOT, GENERAL, HIST, NEAR_M, ORACLES, PAIRS, PARTS, RND, STEPS, T0, WALK, adjacency, dist, query, round_sql
from .stages import stage_path, staged
from .surface import CITY, PAINT, FILL, FILL_SIDES, FLOOD_CAP, GROUND, MOVES, RING, SEEDS, SIDES, cell_sql, city_mask, flood_of, grid_flood, grid_of, land_mask, land_of, recursive, relax, seeds_of

REVERSED = "SELECT trip_id, stop_id, count(*) OVER (PARTITION BY trip_id) + 1 - pos AS pos, 172800 - dep_sec AS arr_sec, 172800 - arr_sec AS dep_sec, (flags >> 1) | ((flags & 1) << 1) AS flags FROM fx_ev"


def rounds_sql(rounds: int, t0: int, ev: str = "fx_ev", tag: str = "") -> dict[str, str]:
    """The round queries for another start time or timetable, their names behind ``tag``."""
    import re

    out = {}
    for name, text in round_sql(rounds).items():
        if name not in ("access", "pairs", "foot"):
            text = text.replace(str(T0 + 10800), str(t0 + 10800)).replace(str(T0), str(t0)).replace("fx_ev", ev)
            text = re.sub(r"\b([bcrn]\d)\b(?! AS)", rf"{tag}\1", text)
            name = tag + name
        out[name] = text
    return out


def search(fx, t0: int, rounds: int, ev: DataFrame | None = None) -> DataFrame:
    foot = proximity.both_ways(proximity.transfer_pairs(fx.fx_stops))
    return reach.raptor(fx.fx_ev if ev is None else ev, reach.access(fx.fx_stops, *A, NEAR_M), foot, t0, rounds)


@query("SELECT stop_id, 172800 - t AS dep_sec FROM b2", {"rev": REVERSED, **rounds_sql(2, 172800 - 43200, "rev")})
def reach_to(fx):
    """Latest departures that arrive at the point by noon: the search on the reversed timetable."""
    found = search(fx, X.REVERSE_C - 43200, 2, reach.reversed_network(fx.fx_ev))
    return found.select("stop_id", (F.lit(X.REVERSE_C) - F.col("arr_sec")).alias("dep_sec"))


@query("SELECT stop_id, min(sec) AS sec FROM (SELECT stop_id, t - 14400 AS sec FROM b2 UNION ALL SELECT stop_id, t - 100800 FROM n_b2) GROUP BY stop_id", {**rounds_sql(2, 14400), **rounds_sql(2, 100800, tag="n_")})
def raptor_night(fx):
    """A search at 4:00 and one a day later in the same timetable (runs past midnight); the faster time of each stop."""
    return night(fx, 14400, 100800)


def night(fx, t0: int, second: int, ev: DataFrame | None = None) -> DataFrame:
    both = [search(fx, t, 2, ev).select("stop_id", (F.col("arr_sec") - t).alias("sec"), F.lit(i).alias("pass")) for i, t in enumerate((t0, second))]
    return faster(both[0], both[1]).select("stop_id", "sec")


def faster(first: DataFrame, second: DataFrame) -> DataFrame:
    """(stop_id, sec, pass) of two searches: the second one's where it is strictly faster or alone."""
    return first.unionByName(second).groupBy("stop_id").agg(F.min(F.struct("sec", "pass")).alias("o")).select("stop_id", "o.*")


@query("SELECT stop_id, min(sec) AS sec FROM (SELECT stop_id, t - 158400 AS sec FROM b2 UNION ALL SELECT stop_id, t - 72000 FROM n_b2) GROUP BY stop_id", {"rev": REVERSED, **rounds_sql(2, 158400, "rev"), **rounds_sql(2, 72000, "rev", tag="n_")})
def raptor_night_to(fx):
    """Arrivals by 4:00, and by 28:00 in the same timetable: the reversed search and the one a day earlier on its axis."""
    return night(fx, X.REVERSE_C - 14400, X.REVERSE_C - 14400 - 86400, reach.reversed_network(fx.fx_ev))


@query("SELECT stop_id, arg_min(pass, (sec, pass)) AS pass, min(sec) AS sec FROM (SELECT stop_id, t - 14400 AS sec, 0 AS pass FROM b2 UNION ALL SELECT stop_id, t - 100800, 1 FROM n_b2) GROUP BY stop_id", {**rounds_sql(2, 14400), **rounds_sql(2, 100800, tag="n_")})
def night_merge(fx):
    """Which of the two passes serves each stop, and its time."""
    both = [search(fx, t, 2).select("stop_id", (F.col("arr_sec") - t).alias("sec"), F.lit(i).alias("pass")) for i, t in enumerate((14400, 100800))]
    return faster(*both).select("stop_id", "pass", "sec")


BANDS = "(VALUES (10), (20), (30), (45), (60), (90)) AS bands(band)"
CIRCLE = f"SELECT stop_id, band, least(CAST((band * 60 - sec) * {WALK} AS DOUBLE), 1000.0e0) AS r FROM access CROSS JOIN {BANDS} WHERE sec <= band * 60"


def circles(fx) -> DataFrame:
    """(stop_id, band, radius_m): how far a walk goes on from each stop within each band it is reached in."""
    at = reach.access(fx.fx_stops, *A).select("stop_id", "sec")
    bands = F.filter(F.array(*[F.lit(b) for b in X.BANDS_MIN]), lambda b: F.col("sec") <= b * 60)
    at = at.withColumn("band", F.explode(bands))
    return at.select("stop_id", "band", F.greatest(F.least((F.col("band") * 60 - F.col("sec")) * X.WALK_MPS, F.lit(1000.0)), F.lit(60.0)).alias("radius_m"))


@query("SELECT stop_id, band, CAST(floor(greatest(r, 60.0e0) * 1000) AS BIGINT) AS radius_mm FROM circle", {"access": ACCESS, "circle": CIRCLE})
def zone_circles(fx):
    return circles(fx).select("stop_id", "band", F.floor(F.col("radius_m") * 1000).alias("radius_mm"))


def labels(fx) -> DataFrame:
    """(stop_id, lat, lon, metres, sec) of the stops that a search of two rounds reaches: distance from the origin, time on the way."""
    m = X.distance_m(F.lit(A[0]), F.lit(A[1]), F.col("lat"), F.col("lon"))
    return search(fx, T0, 2).join(fx.fx_stops, "stop_id").select("stop_id", "lat", "lon", m.alias("metres"), (F.col("arr_sec") - T0).alias("sec"))


LABELS = f"SELECT stop_id, lat, lon, {dist(f'{A[0]},{A[1]}', 'lat,lon')} AS m, t - {T0} AS sec FROM b2 JOIN fx_stops USING (stop_id)"


def far_of_bands(fx, walk: bool) -> DataFrame:
    """(band, reach_mm, stops): how far each band reaches: over stops within it, and with ``walk`` on foot from the origin and on from them."""
    at = labels(fx)
    on = (lambda b: (F.lit(b * 60) - F.col("sec")) * X.WALK_MPS) if walk else (lambda b: F.lit(0.0))
    per = [F.struct(F.lit(b).alias("band"), F.max(F.when(F.col("sec") <= b * 60, F.col("metres") + on(b))).alias("m"), F.count_if(F.col("sec") <= b * 60).alias("stops")) for b in X.BANDS_MIN]
    row = at.agg(F.array(*per).alias("rows")).select(F.explode("rows").alias("r"))
    base = F.col("r.band") * 60 * F.lit(X.WALK_MPS) if walk else F.lit(0.0)
    return row.select("r.band", F.floor(F.greatest(base, F.coalesce("r.m", F.lit(0.0))) * 1000).alias("reach_mm"), "r.stops")


@query(f"SELECT band, CAST(floor(greatest(band * 60 * {WALK}, coalesce(max(m + (band * 60 - sec) * {WALK}), 0)) * 1000) AS BIGINT) AS reach_mm, count(sec) AS stops FROM {BANDS} LEFT JOIN labels ON sec <= band * 60 GROUP BY band", {**round_sql(2), "labels": LABELS})
def band_stats(fx):
    """With walking: by foot alone, or by a walk on from a stop that the search reaches."""
    return far_of_bands(fx, True)


@query(f"SELECT band, CAST(floor(coalesce(max(m), 0) * 1000) AS BIGINT) AS reach_mm, count(sec) AS stops FROM {BANDS} LEFT JOIN labels ON sec <= band * 60 GROUP BY band", {**round_sql(2), "labels": LABELS})
def band_stats_nowalk(fx):
    return far_of_bands(fx, False)


INNER = (52.201, 21.002, 52.206, 21.020)
INNER_BOX = f"SELECT {INNER[0]}e0 AS s, {INNER[1]}e0 AS w, {INNER[2]}e0 AS n, {INNER[3]}e0 AS e, 111320.0 * cos(radians(({INNER[0]}e0 + {INNER[2]}e0) / 2)) AS deg_m, 25 AS res, CAST(ceil(({INNER[3]}e0 - {INNER[1]}e0) * 111320.0 * cos(radians(({INNER[0]}e0 + {INNER[2]}e0) / 2)) / 25) AS BIGINT) AS gw, CAST(ceil(({INNER[2]}e0 - {INNER[0]}e0) * 111320.0 / 25) AS BIGINT) AS gh"


@query(f"SELECT stop_id, sec FROM labels, box WHERE sec <= 5400 AND {cell_sql('lat', 'lon')} IS NULL", {**round_sql(2), "labels": LABELS, "box": INNER_BOX})
def outside_stops(fx):
    """Stops within 90 minutes that lie outside the map's grid."""
    grid = Grid.of_box(*INNER)
    return labels(fx).where((F.col("sec") <= 5400) & grid.cell(F.col("lat"), F.col("lon")).isNull()).select("stop_id", "sec")


TARGET = f"SELECT node_id, arg_min(stop_id, (total, stop_id)) AS stop_id, min(total) AS total FROM (SELECT p.node_id, s.stop_id, a.sec + {RND.format(dist('p.lat,p.lon', 's.lat,s.lon') + ' / ' + WALK)} AS total FROM fx_walk_nodes p JOIN fx_stops s ON {dist('p.lat,p.lon', 's.lat,s.lon')} <= 300 JOIN access a ON a.stop_id = s.stop_id) GROUP BY node_id"


@query(TARGET, {"access": ACCESS})
def target_stop(fx):
    """For every place, the stop within 300 m over which it is reached first."""
    near = proximity.near_stops(fx.fx_walk_nodes.select("node_id", "lat", "lon"), "node_id", fx.fx_stops, X.GROUP_MAX_M)
    at = near.join(reach.access(fx.fx_stops, *A).select("stop_id", "sec"), "stop_id").withColumn("total", F.col("sec") + X.walk_seconds(F.col("m")))
    return at.groupBy("node_id").agg(F.min(F.struct("total", "stop_id")).alias("o")).select("node_id", "o.stop_id", "o.total")


MAIN = "SELECT node FROM parts WHERE label = (SELECT label FROM parts GROUP BY label ORDER BY count(*) DESC, label LIMIT 1)"
SNAP = f"SELECT stop_id, arg_min(node_id, (m, node_id)) AS node_id FROM (SELECT s.stop_id, n.node_id, {dist('s.lat,s.lon', 'n.lat,n.lon')} AS m FROM fx_stops s JOIN fx_walk_nodes n ON {dist('s.lat,s.lon', 'n.lat,n.lon')} <= 400 WHERE n.node_id IN ({MAIN})) GROUP BY stop_id"


def main_nodes(fx) -> DataFrame:
    """(node_id, lat, lon) of the walking network's largest component: elsewhere a walk would lead nowhere."""
    found = staged(reach.least_member(fx.fx_walk_nodes.select(F.col("node_id").alias("node")), fx.fx_walk_edges.select("u", "v")), "parts")
    main = found.groupBy("label").agg(F.count("*").alias("nodes")).orderBy(F.desc("nodes"), "label").limit(1)
    inside = found.join(F.broadcast(main), "label").select(F.col("node").alias("node_id"))  # one row
    return fx.fx_walk_nodes.join(inside, "node_id", "left_semi").select("node_id", "lat", "lon")


def nearest_nodes(fx, places: DataFrame) -> DataFrame:
    """(place, node_id, m): the main component's node nearest to each place (place, lat, lon), at most 400 m away (least id of equals)."""
    near = proximity.near_stops(places, "place", main_nodes(fx).withColumnRenamed("node_id", "stop_id"), 400)
    return near.groupBy("place").agg(F.min(F.struct("m", "stop_id")).alias("o")).select("place", F.col("o.stop_id").alias("node_id"), "o.m")


@query(SNAP, {"adj": ADJ})
def snap_node(fx):
    found = nearest_nodes(fx, fx.fx_stops.select(F.col("stop_id").alias("place"), "lat", "lon"))
    return found.select(F.col("place").alias("stop_id"), "node_id")


recursive("snap_node", PARTS)


@query(SNAP, {"adj": ADJ})
def snap_table(fx):
    """The nearest nodes of all stops, kept as a table that later searches read."""
    path = stage_path(fx.spark, "snapped")
    snap_node(fx).write.parquet(path)
    return fx.spark.read.parquet(path)


recursive("snap_table", PARTS)


# rasters of times
FLOODED = {"access": ACCESS, **GROUND, "moves": MOVES, "seeds": SEEDS}
BANDED = "SELECT node AS cell, t, CASE WHEN t <= 600 THEN 10 WHEN t <= 1200 THEN 20 WHEN t <= 1800 THEN 30 WHEN t <= 2700 THEN 45 WHEN t <= 3600 THEN 60 WHEN t <= 5400 THEN 90 END AS band FROM flood"


def flooded(fx, grid: Grid) -> DataFrame:
    """(cell, sec, band): the times of the flood from the stops near the origin."""
    return staged(grid_flood(fx), "flooded").withColumn("band", X.band_minutes(F.col("sec")))


@query(f"SELECT bands.band, count(b.cell) FILTER (WHERE b.band <= bands.band) AS cells, count(*) AS total, CAST(floor(1e6 * count(b.cell) FILTER (WHERE b.band <= bands.band) / count(*)) AS BIGINT) AS ppm FROM (SELECT l.cell FROM land l JOIN filled f ON f.cell = l.cell) c LEFT JOIN ({BANDED}) b ON b.cell = c.cell CROSS JOIN {BANDS} GROUP BY bands.band", {**FLOODED, "ring": RING, "city": CITY, "sides": SIDES.replace("FROM ring", "FROM city"), "fs": FILL_SIDES, "filled": FILL})
def area_percents(fx):
    """The city's land cells that the flood reaches within each band (cumulative), of all of its land cells, and in millionths."""
    grid = grid_of(fx)
    land = staged(land_mask(fx, grid), "land")
    city = staged(tiles.common(land, city_mask(fx, grid)), "city")
    found = tiles.by_band(flood_of(fx, grid, land), grid, FLOOD_CAP, [60 * b for b in X.BANDS_MIN], city)
    bands = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(b).alias("minutes")) for i, b in enumerate(X.BANDS_MIN)]))
    row = tiles.size(city).select(F.col("cells").alias("total"), bands.alias("b")).where("total > 0").join(found, F.col("b.i") == F.col("band"), "left")
    cells = F.coalesce("cells", F.lit(0))
    return row.select(F.col("b.minutes").alias("band"), cells.alias("cells"), "total", F.floor(F.lit(1e6) * cells / F.col("total")).alias("ppm"))


recursive("area_percents", relax("flood", "SELECT cell, sec FROM seeds", "moves", FLOOD_CAP))

FAR = f"SELECT b.band, sqrt(power(b.cell % gw - o.cell % gw, 2) + power(b.cell // gw - o.cell // gw, 2)) * res AS m FROM ({BANDED}) b, box, (SELECT {cell_sql(str(A[0]) + 'e0', str(A[1]) + 'e0')} AS cell FROM box) o WHERE o.cell IS NOT NULL"


@query(f"SELECT bands.band, CAST(floor(max(m) * 1000) AS BIGINT) AS reach_mm FROM ({FAR}) b JOIN {BANDS} ON b.band <= bands.band GROUP BY bands.band", FLOODED)
def max_band_distance(fx):
    """The farthest cell that the flood reaches within each band (cumulative), from the origin's cell; none where that lies off the grid."""
    grid = grid_of(fx)
    o = fx.spark.range(1).select(grid.cell(F.lit(A[0]), F.lit(A[1])).alias("o")).first().o  # one row
    if o is None:
        return fx.spark.createDataFrame([], "band int, reach_mm long")
    times = flood_of(fx, grid, staged(land_mask(fx, grid), "land"))
    found = tiles.by_band(times, grid, FLOOD_CAP, [60 * b for b in X.BANDS_MIN], origin=(o % grid.w, o // grid.w))
    return found.select(F.element_at(F.array(*map(F.lit, X.BANDS_MIN)), F.col("band") + 1).alias("band"), F.floor(F.col("far") * grid.res * 1000).alias("reach_mm"))


recursive("max_band_distance", relax("flood", "SELECT cell, sec FROM seeds", "moves", FLOOD_CAP))


# a place on the grid
PLACES = f"SELECT node_id, lat, lon, {cell_sql('lat', 'lon')} AS cell FROM fx_walk_nodes, box"
TARGET_GRID = f"SELECT node_id, arg_min(stop_id, (m, stop_id)) AS stop_id, any_value(total) AS total FROM (SELECT p.node_id, s.stop_id, f.t AS total, {dist('p.lat,p.lon', 's.lat,s.lon')} AS m FROM places p JOIN flood f ON f.node = p.cell JOIN access a ON a.sec <= f.t + 1 JOIN fx_stops s ON s.stop_id = a.stop_id) GROUP BY node_id"


@query(TARGET_GRID, {**FLOODED, "places": PLACES})
def target_stop_grid(fx):
    """For every place that the flood reaches, the nearest of the stops from which it may have come (reached by then)."""
    grid = grid_of(fx)
    places = fx.fx_walk_nodes.select("node_id", "lat", "lon", grid.cell(F.col("lat"), F.col("lon")).alias("cell"))
    at = places.join(flooded(fx, grid).select("cell", F.col("sec").alias("total")), "cell").select("node_id", "lat", "lon", "total")
    stops = reach.access(fx.fx_stops, *A).select("stop_id", "sec").join(fx.fx_stops.select("stop_id", "lat", "lon"), "stop_id")
    return proximity.nearest_reached(at, stops).select("node_id", "stop_id", "total")


recursive("target_stop_grid", relax("flood", "SELECT cell, sec FROM seeds", "moves", FLOOD_CAP))


# live counts
@query(HIST)
def stream_delay_histogram(fx):
    """The histogram kept by a stream over the events, all of them taken in one run."""
    return delays.histogram_of_stream(fx.spark, f"{fx.sf_dir}/events.parquet", stage_path(fx.spark, "live"))


POLLED = "SELECT event_type AS route_name, timezone('Europe/Warsaw', timezone('UTC', CAST(poll AS TIMESTAMP))) AS ts, arg_max(CAST(floor(value * 6) AS INT) - 120, event_id) AS delay_sec FROM (SELECT *, time_bucket(INTERVAL 15 MINUTE, CAST(ts AS TIMESTAMP)) AS poll FROM events) GROUP BY event_type, user_id, poll"


@query(HIST.replace("fx_delay_obs", "polled"), {"polled": POLLED})
def stream_poll_histogram(fx):
    """The same by polls: within a poll a run counts once, and its slot is the poll's on the local clock."""
    polls = delays.Polls(fx.spark, stage_path(fx.spark, "polls"))
    polls.run(delays.live(fx.spark, f"{fx.sf_dir}/events.parquet").withColumn("ts", delays.at_utc(F.col("ts"))))
    return polls.histogram()


def sent(fx) -> str:
    """Observations as files of JSON lines from three addresses, every tenth line cut short; some name no line, some no trip or delay. Their folder."""
    obs, folder, i = fx.fx_delay_obs, stage_path(fx.spark, "updates"), F.col("event_id")
    stop = F.array(F.struct(F.lit(None).cast("int").alias("arrival"), F.col("delay_sec").cast("int").alias("departure")))
    line = F.to_json(F.struct(F.when(i % 7 != 0, F.col("route_name")).alias("routeId"), F.when(i % 6 != 0, F.col("trip_ref").cast("string")).alias("tripId"), F.concat(F.lit("e"), i % 50).alias("id"), F.when(i % 4 == 0, F.col("delay_sec")).alias("delay"), F.when(i % 4 == 1, stop).alias("stops"), "event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("ts")))
    rows = obs.select(F.when(i % 10 == 0, line.substr(F.lit(1), F.length(line) - 5)).otherwise(line).alias("value"), F.concat(F.lit("a"), i % 3).alias("address"))
    rows.write.partitionBy("address").text(folder)
    files(fx.spark, folder)
    return folder


def files(spark, folder: str) -> None:
    """Gives the text files of each address the names of JSON files."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    at = hadoop.Path(folder)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    for sub in fs.listStatus(at):
        if sub.isDirectory():
            for f in fs.listStatus(sub.getPath()):
                fs.rename(f.getPath(), hadoop.Path(sub.getPath(), f.getPath().getName().replace(".txt", ".json")))


SENT = "SELECT event_id, event_type AS route_name, 'a' || (event_id % 3) || '|' || CASE WHEN event_id % 6 <> 0 THEN CAST(user_id AS VARCHAR) ELSE 'e' || (event_id % 50) END AS trip, time_bucket(INTERVAL 15 MINUTE, CAST(ts AS TIMESTAMP)) AS poll, CAST(floor(value * 6) AS INT) - 120 AS delay_sec FROM events WHERE event_id % 10 <> 0 AND event_id % 7 <> 0 AND event_id % 4 < 2"


@query(HIST.replace("fx_delay_obs", "polled"), {"sent": SENT, "polled": "SELECT route_name, timezone('Europe/Warsaw', timezone('UTC', poll)) AS ts, arg_max(delay_sec, event_id) AS delay_sec FROM sent GROUP BY route_name, trip, poll"})
def stream_json_histogram(fx):
    """Counts by polls from a stream of JSON files, broken lines and updates without line or delay among them."""
    polls = delays.Polls(fx.spark, stage_path(fx.spark, "polls"))
    polls.run(gtfs.observations(gtfs.live_updates(fx.spark, sent(fx))))
    return polls.histogram()


@query("SELECT 'a' || (event_id % 3) AS address, count(*) AS lines, count(*) FILTER (WHERE event_id % 10 = 0) AS broken FROM events GROUP BY 1")
def stream_json_faults(fx):
    """How many lines of each address were broken, counted by the stream."""
    folder = stage_path(fx.spark, "faults")
    kept = Kept(fx.spark, folder, lambda rows: rows.groupBy("address").agg(F.sum("lines").alias("lines"), F.sum("broken").alias("broken")))
    run = gtfs.live_updates(fx.spark, sent(fx)).writeStream.foreachBatch(lambda batch, number: kept.commit(gtfs.faults(batch), number))
    run.option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start().awaitTermination()
    return kept.rows()


# searches with more than times
CAREFUL_PAT = "SELECT e.*, p.pattern FROM fx_ev e JOIN (SELECT trip_id, any_value(route_id) || ':' || string_agg(stop_id || '/' || flags, '-' ORDER BY pos) AS pattern FROM fx_ev GROUP BY trip_id) p USING (trip_id)"


def careful_sql(rounds: int) -> dict[str, str]:
    out = {"access": ACCESS, "pairs": PAIRS, "foot": FOOT, "named": CAREFUL_PAT, "b0": f"SELECT stop_id, {T0} + sec AS t, 0 AS k FROM access WHERE m <= {NEAR_M}"}
    cap = T0 + X.HORIZON_S
    factor = "CASE WHEN route_type IN (3, 11) THEN 1.15e0 WHEN route_type = 0 THEN 1.05e0 WHEN route_type = 2 THEN 1.02e0 ELSE 1.1e0 END"
    for k in range(1, rounds + 1):
        p, wait = f"b{k - 1}", 0 if k == 1 else 240
        out[f"c{k}"] = f"SELECT e.trip_id, min(e.pos) AS on_pos, arg_min(e.dep_sec, e.pos) AS on_dep FROM named e JOIN {p} b ON b.stop_id = e.stop_id WHERE b.k = {k - 1} AND e.flags & 1 = 0 AND e.dep_sec >= b.t + {wait} AND e.dep_sec <= {cap} GROUP BY e.trip_id"
        out[f"h{k}"] = f"SELECT e.stop_id, e.route_type, e.flags, e.arr_sec, c.on_dep FROM named e JOIN c{k} c ON c.trip_id = e.trip_id WHERE e.pos > c.on_pos QUALIFY row_number() OVER (PARTITION BY e.pattern, e.pos ORDER BY e.dep_sec, c.on_pos, e.trip_id) = 1"
        out[f"r{k}"] = f"SELECT r.* FROM (SELECT stop_id, min(a) AS t FROM (SELECT stop_id, arr_sec + CAST(floor((arr_sec - on_dep) * ({factor} - 1.0e0) + 0.5) AS BIGINT) AS a FROM h{k} WHERE flags & 2 = 0) WHERE a <= {cap} GROUP BY stop_id) r LEFT JOIN {p} b ON b.stop_id = r.stop_id WHERE b.t IS NULL OR r.t < b.t"
        out[f"n{k}"] = f"SELECT stop_id, min(t) AS t FROM (SELECT stop_id, t FROM r{k} UNION ALL SELECT f.v, r.t + greatest(f.sec, 240) FROM r{k} r JOIN foot f ON f.u = r.stop_id WHERE r.t + greatest(f.sec, 240) <= {cap}) GROUP BY stop_id"
        out[f"b{k}"] = f"SELECT coalesce(b.stop_id, n.stop_id) AS stop_id, least(b.t, n.t) AS t, CASE WHEN b.t IS NULL OR n.t < b.t THEN {k} ELSE b.k END AS k FROM {p} b FULL JOIN n{k} n ON n.stop_id = b.stop_id"
    return out


@query("SELECT stop_id, t AS arr_sec FROM b2", careful_sql(2))
def raptor_cautious(fx):
    foot = proximity.both_ways(proximity.transfer_pairs(fx.fx_stops))
    return searches.cautious(fx.fx_ev, reach.access(fx.fx_stops, *A, NEAR_M), foot, T0, 2)


FACTOR = "CASE WHEN route_type IN (3, 11) THEN 1.15e0 WHEN route_type = 0 THEN 1.05e0 WHEN route_type = 2 THEN 1.02e0 ELSE 1.1e0 END"


def legs_sql(rounds: int, t0: int, ev: str, safe: bool = False) -> dict[str, str]:
    """Named queries of labels with their parents by round, the best of them, and the legs (`legs`: target, back, ...) by recursion."""
    wait, foot = (240, "greatest(f.sec, 240)") if safe else (60, "f.sec")
    cap, fields = t0 + X.HORIZON_S, "t, round, kind, from_stop, trip_id, dep_sec, from_round, from_kind"
    row = "{" + ", ".join(f"'{c}': {c}" for c in fields.split(", ")) + "}"
    out = {"access": ACCESS, "pairs": PAIRS, "foot": FOOT, **({"named": CAREFUL_PAT} if safe else {}), "l0": f"SELECT stop_id, {t0} + sec AS t, 0 AS round, 'access' AS kind, CAST(NULL AS BIGINT) AS from_stop, CAST(NULL AS BIGINT) AS trip_id, CAST({t0} AS BIGINT) AS dep_sec, -1 AS from_round, '' AS from_kind FROM access WHERE m <= {NEAR_M}", "best0": "SELECT * FROM l0"}
    for k in range(1, rounds + 1):
        b = f"best{k - 1}"
        out[f"on{k}"] = f"SELECT e.trip_id, min({{'pos': e.pos, 'dep': e.dep_sec, 'stop': e.stop_id, 'kind': b.kind}}) AS o FROM {ev} e JOIN {b} b ON b.stop_id = e.stop_id WHERE b.round = {k - 1} AND e.flags & 1 = 0 AND e.dep_sec >= b.t + {0 if k == 1 else wait} AND e.dep_sec <= {cap} GROUP BY e.trip_id"
        held = f"QUALIFY row_number() OVER (PARTITION BY e.pattern, e.pos ORDER BY e.dep_sec, c.o.pos, e.trip_id) = 1" if safe else ""
        late = f"CAST(floor((arr_sec - o.dep) * ({FACTOR} - 1.0e0) + 0.5) AS BIGINT)" if safe else "0"
        out[f"by{k}"] = f"SELECT stop_id, arr_sec + {late} AS t, trip_id, o FROM (SELECT e.stop_id, {'e.route_type,' if safe else ''} e.flags, e.arr_sec, e.trip_id, c.o FROM {ev} e JOIN on{k} c ON c.trip_id = e.trip_id WHERE e.pos > c.o.pos {held}) WHERE flags & 2 = 0"
        out[f"ride{k}"] = f"SELECT r.stop_id, r.o.t AS t, {k} AS round, 'ride' AS kind, r.o.o.stop AS from_stop, r.o.trip AS trip_id, r.o.o.dep AS dep_sec, {k - 1} AS from_round, r.o.o.kind AS from_kind FROM (SELECT stop_id, min({{'t': t, 'trip': trip_id, 'o': o}}) AS o FROM by{k} WHERE t <= {cap} GROUP BY stop_id) r LEFT JOIN {b} b ON b.stop_id = r.stop_id WHERE b.t IS NULL OR r.o.t < b.t"
        out[f"walk{k}"] = f"SELECT stop_id, o.t AS t, {k} AS round, 'walk' AS kind, o.u AS from_stop, CAST(NULL AS BIGINT) AS trip_id, o.dep AS dep_sec, {k} AS from_round, 'ride' AS from_kind FROM (SELECT f.v AS stop_id, min({{'t': r.t + {foot}, 'u': f.u, 'dep': r.t}}) AS o FROM ride{k} r JOIN foot f ON f.u = r.stop_id WHERE r.t + {foot} <= {cap} GROUP BY f.v)"
        out[f"best{k}"] = f"SELECT stop_id, o.* FROM (SELECT stop_id, arg_min({row}, (t, round, kind)) AS o FROM (SELECT * FROM {b} UNION ALL SELECT * FROM ride{k} UNION ALL SELECT * FROM walk{k}) GROUP BY stop_id)"
    every = " UNION ALL ".join(["SELECT * FROM l0", *(f"SELECT * FROM {kind}{k}" for k in range(1, rounds + 1) for kind in ("ride", "walk"))])
    out["labels"] = every
    # a recursive query names its own columns: the first part's
    out["legs"] = f"SELECT stop_id AS target, 0 AS back, stop_id, {fields} FROM best{rounds} UNION ALL SELECT l.target, l.back + 1, p.stop_id, {', '.join(f'p.{c}' for c in fields.split(', '))} FROM legs l JOIN labels p ON p.stop_id = l.from_stop AND p.round = l.from_round AND p.kind = l.from_kind WHERE l.from_round >= 0"
    return out


@query("SELECT target, max(back) OVER (PARTITION BY target) - back + 1 AS leg, kind, from_stop, stop_id AS to_stop, trip_id, dep_sec, t AS arr_sec FROM legs", legs_sql(2, T0, "fx_ev"))
def journey_legs(fx):
    """The legs of the earliest journey to every stop within two rounds."""
    foot = proximity.both_ways(proximity.transfer_pairs(fx.fx_stops))
    return searches.journeys(fx.fx_ev, reach.access(fx.fx_stops, *A, NEAR_M), foot, T0, 2)


@query("SELECT target, max(back) OVER (PARTITION BY target) - back + 1 AS leg, kind, from_stop, stop_id AS to_stop, trip_id, dep_sec, t AS arr_sec FROM legs", legs_sql(2, T0, "named", safe=True))
def journey_legs_safe(fx):
    """The legs of the cautious journey to every stop within two rounds, with the delays that it allows for."""
    foot = proximity.both_ways(proximity.transfer_pairs(fx.fx_stops))
    return searches.journeys(fx.fx_ev, reach.access(fx.fx_stops, *A, NEAR_M), foot, T0, 2, safe=True)


@query(f"SELECT target AS source, back + 1 AS leg, kind, stop_id AS from_stop, from_stop AS to_stop, trip_id, {X.REVERSE_C} - t AS dep_sec, {X.REVERSE_C} - dep_sec AS arr_sec FROM legs", {"rev": REVERSED, **legs_sql(2, X.REVERSE_C - 43200, "rev")})
def journey_legs_to(fx):
    """The legs of the latest journey from every stop that is at the place by noon, within two rounds."""
    foot = proximity.both_ways(proximity.transfer_pairs(fx.fx_stops))
    return searches.journeys_to(fx.fx_ev, reach.access(fx.fx_stops, *A, NEAR_M), foot, 43200, 2)


GENERAL_EDGES = "SELECT u, v, e.sec AS sec, e.kind AS kind, e.route_id AS route_id FROM (SELECT u, v, min({'sec': sec, 'kind': kind, 'route_id': route_id}) AS e FROM (SELECT stop_id AS u, next_stop AS v, CAST(greatest(ride, 0) AS BIGINT) AS sec, 'ride' AS kind, CAST(route_id AS BIGINT) AS route_id FROM steps WHERE ride IS NOT NULL UNION ALL SELECT u, v, sec, 'walk', NULL FROM foot) GROUP BY u, v)"
GENERAL_LEGS = {
    "steps": STEPS, "access": f"SELECT stop_id, sec FROM ({ACCESS}) WHERE m <= {NEAR_M}", "pairs": PAIRS, "foot": FOOT, "edges": GENERAL_EDGES,
    "parents": f"SELECT e.v AS node, min({{'kind': e.kind, 'u': e.u, 'route_id': e.route_id, 'sec': e.sec}}) AS p FROM edges e JOIN reach a ON a.node = e.u JOIN reach b ON b.node = e.v WHERE a.t <= {X.HORIZON_S} AND a.t + e.sec = b.t AND (e.sec > 0 OR e.u < e.v) GROUP BY e.v",
    "step": "SELECT t.node, s.sec IS NOT DISTINCT FROM t.t AS own, CASE WHEN own THEN 'access' ELSE p.p.kind END AS kind, CASE WHEN NOT own THEN p.p.u END AS from_stop, CASE WHEN NOT own THEN p.p.route_id END AS route_id, CASE WHEN own THEN t.t ELSE p.p.sec END AS sec FROM reach t LEFT JOIN access s ON s.stop_id = t.node LEFT JOIN parents p ON p.node = t.node WHERE own OR p.p IS NOT NULL",
    "path": f"SELECT node AS target, 0 AS back, node, kind, from_stop, route_id, sec FROM step UNION ALL SELECT h.target, h.back + 1, s.node, s.kind, s.from_stop, s.route_id, s.sec FROM path h JOIN step s ON s.node = h.from_stop WHERE h.back < {searches.MOST_LEGS - 1}",
    "turns": "SELECT *, CASE WHEN kind IS DISTINCT FROM lag(kind) OVER o OR route_id IS DISTINCT FROM lag(route_id) OVER o THEN 1 ELSE 0 END AS new FROM path WHERE target IN (SELECT target FROM path WHERE kind = 'access') WINDOW o AS (PARTITION BY target ORDER BY back DESC)",
    "numbered": "SELECT *, CAST(sum(new) OVER (PARTITION BY target ORDER BY back DESC) AS INTEGER) AS leg FROM turns",
}


@query("SELECT target, leg, any_value(kind) AS kind, CAST(arg_max(from_stop, back) AS BIGINT) AS from_stop, arg_min(node, back) AS to_stop, any_value(route_id) AS route_id, CAST(sum(sec) AS BIGINT) AS sec FROM numbered GROUP BY target, leg", GENERAL_LEGS)
def general_legs(fx):
    """The legs of the shortest journey without waiting to every stop; neighbouring rides of one route, and walks, are one leg."""
    foot = proximity.both_ways(proximity.transfer_pairs(fx.fx_stops))
    seeds = reach.access(fx.fx_stops, *A, NEAR_M).select(F.col("stop_id").alias("node"), F.col("sec").alias("t"))
    return searches.general_journeys(fx.fx_ev, seeds, foot)


ORACLES["general_legs"] = ORACLES["general_legs"].replace("parents AS (", f"{GENERAL}, parents AS (", 1)


HALF = "SELECT u, v, u || '-' || v AS e, 0 AS d, len_m FROM fx_walk_edges UNION ALL SELECT v, u, u || '-' || v, 1, len_m FROM fx_walk_edges"
CHAIN = """chain(start, e0, d0, node, e, d, len_m) AS (SELECT h.u, h.e, h.d, h.v, h.e, h.d, h.len_m FROM half h WHERE h.u NOT IN (SELECT u FROM two)
  UNION ALL SELECT c.start, c.e0, c.d0, h.v, h.e, h.d, c.len_m + h.len_m FROM chain c JOIN half h ON h.u = c.node AND h.e <> c.e WHERE c.node IN (SELECT u FROM two))"""


@query("SELECT u, v, CAST(len_m AS BIGINT) AS len_m FROM (SELECT least(start, node) AS u, greatest(start, node) AS v, len_m, row_number() OVER (PARTITION BY least((e0, d0), (e, 1 - d)), greatest((e0, d0), (e, 1 - d)) ORDER BY start) AS k FROM chain WHERE node NOT IN (SELECT u FROM two)) WHERE k = 1", {"half": HALF, "two": "SELECT u FROM half GROUP BY u HAVING count(*) = 2"})
def graph_contract(fx):
    return searches.contract(fx.fx_walk_edges)


recursive("graph_contract", CHAIN)


# waves
WAVE_CAP, WAVE_FROM = 900, 600


def wave(fx, places: DataFrame) -> DataFrame:
    """Times along streets from places (place, lat, lon, sec), painted on the grid and carried on for 75 m over land; the origin's own cell takes no time."""
    grid = grid_of(fx)
    land = staged(land_of(fx, grid), "land")
    times = reach.shortest(snapped(fx, places), adjacency(fx.fx_walk_edges), WAVE_CAP, blocks=reach.plane_blocks(fx.fx_walk_nodes, "node_id")).where(F.col("t") <= WAVE_CAP)
    painted = raster.paint(fx.fx_walk_edges, fx.fx_walk_nodes, times, grid)
    own = origin_of(fx).select(grid.cell(F.col("lat"), F.col("lon")).alias("cell"), "sec").where("cell is not null")
    painted = painted.unionByName(own).groupBy("cell").agg(F.min("sec").alias("sec"))
    return raster.spread(painted, raster.moves(land, grid), grid)


def snapped(fx, places: DataFrame) -> DataFrame:
    """(node, t): the street node nearest to each place (place, lat, lon, sec), with the walk to it."""
    near = nearest_nodes(fx, places.select("place", "lat", "lon")).join(places.select("place", "sec"), "place")
    return near.select(F.col("node_id").alias("node"), (F.col("sec") + X.js_round(F.col("m") / X.NET_WALK_MPS)).cast("long").alias("t"))


def origin_of(fx) -> DataFrame:
    return fx.spark.range(1).select(F.lit(-1).cast("long").alias("place"), F.lit(A[0]).alias("lat"), F.lit(A[1]).alias("lon"), F.lit(0).cast("long").alias("sec"))


ORIGIN = f"SELECT CAST(-1 AS BIGINT) AS place, {A[0]}e0 AS lat, {A[1]}e0 AS lon, CAST(0 AS BIGINT) AS sec"
LINKED = f"""SELECT arg_min(node_id, (m, node_id)) AS node, any_value(sec) + CAST(floor(min(m) / 1.25 + 0.5) AS BIGINT) AS t FROM (
  SELECT p.place, p.sec, n.node_id, {dist('p.lat,p.lon', 'n.lat,n.lon')} AS m FROM places p JOIN fx_walk_nodes n ON {dist('p.lat,p.lon', 'n.lat,n.lon')} <= 400 WHERE n.node_id IN ({MAIN})) GROUP BY place"""
PAINTED = f"SELECT cell, min(sec) AS sec FROM ({PAINT} UNION ALL SELECT {cell_sql('lat', 'lon')}, sec FROM origin, box) WHERE cell IS NOT NULL GROUP BY cell"
SPREAD = ", ".join(["s0 AS (SELECT cell, sec, 0.0e0 AS m FROM painted)"] + [f"s{k} AS (SELECT cell, min(sec) AS sec, arg_min(m, (sec, m)) AS m FROM (SELECT * FROM s{k - 1} UNION ALL SELECT x.v, w.sec + x.sec, w.m + x.step FROM s{k - 1} w JOIN (SELECT u, v, sec, CASE sec WHEN 26 THEN 25.0e0 ELSE 25 * 1.4142135623730951e0 END AS step FROM moves) x ON x.u = w.cell WHERE w.m + x.step <= 75) GROUP BY cell)" for k in range(1, 4)])
WAVED = {"access": ACCESS, "adj": ADJ, **GROUND, "moves": MOVES, "origin": ORIGIN}
STOPS_NEAR = f"SELECT stop_id AS place, lat, lon, sec FROM access JOIN fx_stops USING (stop_id) WHERE sec <= {WAVE_FROM} UNION ALL SELECT * FROM origin"
WAVE_PARTS = f"{PARTS}, linked AS ({LINKED}), {relax('wave', 'SELECT node, min(t) FROM linked GROUP BY node', 'adj', WAVE_CAP)}, painted AS ({PAINTED}), {SPREAD}"


@query("SELECT cell, sec FROM s3", {**WAVED, "places": STOPS_NEAR})
def walk_wave(fx):
    """A quarter of an hour's walk on from the origin and the stops reached in ten minutes."""
    at = reach.access(fx.fx_stops, *A).where(F.col("sec") <= WAVE_FROM).join(fx.fx_stops, "stop_id")
    return wave(fx, at.select(F.col("stop_id").alias("place"), "lat", "lon", "sec").unionByName(origin_of(fx)))


@query("SELECT cell, sec FROM s3", {**WAVED, "places": "SELECT * FROM origin"})
def walk_only(fx):
    """A quarter of an hour's walk from the origin, no vehicle taken."""
    return wave(fx, origin_of(fx))


recursive("walk_wave", WAVE_PARTS)
recursive("walk_only", WAVE_PARTS)


NEAR = ", ".join([f"w0 AS (SELECT cell AS seed, cell, 0.0e0 AS m FROM seeds)"] + [f"w{k} AS (SELECT seed, cell, min(m) AS m FROM (SELECT * FROM w{k - 1} UNION ALL SELECT w.seed, x.v, w.m + x.step FROM w{k - 1} w JOIN (SELECT u, v, CASE sec WHEN 26 THEN 25.0e0 ELSE 25 * 1.4142135623730951e0 END AS step FROM moves) x ON x.u = w.cell WHERE w.m + x.step <= 200) GROUP BY seed, cell)" for k in range(1, 9)])


@query("SELECT w8.cell, min(s.sec) AS sec FROM w8 JOIN seeds s ON s.cell = w8.seed GROUP BY w8.cell", {"access": ACCESS, **GROUND, "moves": MOVES, "seeds": SEEDS})
def grid_nowalk(fx):
    """Arrivals at the stops near the origin, held 200 m round them over land."""
    grid = grid_of(fx)
    land = staged(land_of(fx, grid), "land")
    return raster.near_cells(seeds_of(fx, grid, land), staged(raster.moves(land, grid), "moves"), grid)


recursive("grid_nowalk", NEAR)


# documents of streets and cities
TAGS = "CASE p_size % 6 WHEN 0 THEN 'motorway' WHEN 1 THEN NULL ELSE 'footway' END AS highway, CASE WHEN p_size % 7 = 0 THEN 'no' END AS foot, CASE WHEN p_size % 11 = 0 THEN 'private' WHEN p_size % 11 = 1 THEN 'yes' END AS access, CASE WHEN p_size % 13 = 0 THEN 'driveway' END AS service"


def street_docs(fx) -> DataFrame:
    tag = fx.sql(f"SELECT p_partkey AS id, {TAGS} FROM part", part=fx.part)
    pairs = F.filter(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).alias("value")) for k in ("highway", "foot", "access", "service")]), lambda p: p["value"].isNotNull())
    way = F.struct(F.lit("way").alias("type"), "id", F.array("id", F.col("id") + 1).alias("nodes"), F.map_from_entries(pairs).alias("tags"))
    return tag.select(F.to_json(F.struct(F.array(way).alias("elements"))).alias("doc"))


@query("SELECT p_partkey AS id, 2 AS n_nodes FROM part")
def osm_elements_explode(fx):
    return streets.elements(street_docs(fx), "doc").select("id", F.size("nodes").alias("n_nodes"))


@query(f"SELECT id FROM (SELECT p_partkey AS id, {TAGS} FROM part) WHERE highway = 'footway' AND foot IS NULL AND coalesce(access, '') <> 'private' AND service IS NULL")
def walkable_filter(fx):
    return streets.elements(street_docs(fx), "doc").where(streets.walkable(F.col("tags"))).select("id")


@query("SELECT n_name AS city, i AS feed, CAST(s_suppkey AS VARCHAR) AS url FROM (SELECT n_name, s_suppkey, row_number() OVER (PARTITION BY n_name ORDER BY s_suppkey) - 1 AS i FROM supplier JOIN nation ON n_nationkey = s_nationkey)")
def city_config_explode(fx):
    """A document a city with its feeds, taken apart to rows."""
    feed = F.struct(F.col("s_suppkey").cast("string").alias("url"))
    rows = fx.supplier.join(fx.nation, F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.array_sort(F.collect_list(F.struct("s_suppkey", feed.alias("feed")))).alias("l"))
    doc = rows.select(F.to_json(F.create_map("n_name", F.struct(F.transform("l", lambda x: x["feed"]).alias("feeds")))).alias("doc"))
    return streets.city_feeds(doc, "doc")
