"""Queries of feeds, live updates and the compiled timetable."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import expr as X
from ..operators import proximity, reach
from ..operators.numbers import numbered
from ..operators.timetable import encoded, next_of
from ..sources import gtfs
from .catalog import A, CHOSEN, DAYS, GROUPS, HIST, NAMESAKES, ORACLES, P80, RND, WALK, along, chosen_days, date_counts, dist, histogram, percentile, query, runs_on, staged_services, usable_dates
from .stages import stage_path, staged


def as_time(sec) -> F.Column:
    return F.format_string("%d:%02d:%02d", F.floor(sec / 3600), F.floor(sec / 60) % 60, (sec % 60).cast("long"))


def as_feed(fx) -> str:
    """The projected stop times written as a feed's table; its folder."""
    folder = stage_path(fx.spark, "feed")
    flag = lambda bit: F.when(F.col("flags").bitwiseAND(bit) != 0, "1").otherwise("0")
    rows = fx.fx_stop_times.select(F.lit("x").alias("extra"), "trip_id", as_time(F.col("arr_sec")).alias("arrival_time"), as_time(F.col("dep_sec")).alias("departure_time"), "stop_id", F.col("seq").alias("stop_sequence"), flag(1).alias("pickup_type"), flag(2).alias("drop_off_type"))
    rows.write.csv(f"{folder}/stop_times.txt", header=True)
    return folder


def stop_time_rows(raw: DataFrame) -> DataFrame:
    long = lambda c: F.col(c).cast("long").alias(c)
    return raw.select(*[c for c in raw.columns if c == "feed"], long("trip_id"), F.col("stop_sequence").cast("long").alias("seq"), long("stop_id"), X.time_to_sec(F.col("arrival_time")).alias("arr_sec"), X.time_to_sec(F.col("departure_time")).alias("dep_sec"), X.flags(F.col("pickup_type"), F.col("drop_off_type")).cast("long").alias("flags"))


@query("SELECT trip_id, seq, stop_id, arr_sec, dep_sec, flags FROM fx_stop_times")
def stop_times_scan(fx):
    """Stop times written as a feed's text table and read again."""
    return stop_time_rows(gtfs.table(fx.spark, as_feed(fx), "stop_times"))


@query("SELECT feed, trip_id, seq, stop_id, arr_sec, dep_sec, flags FROM fx_stop_times CROSS JOIN (VALUES (0), (1)) AS f(feed)")
def multi_feed_union(fx):
    """The same feed twice: ids never meet across feeds."""
    folder = as_feed(fx)
    return stop_time_rows(gtfs.feeds(fx.spark, [folder, folder], "stop_times"))


@query("SELECT o_custkey AS dataset, arg_max(o_orderkey, (coalesce(CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END, o_orderdate - INTERVAL 30 DAY), o_orderkey)) AS resource_id FROM orders GROUP BY o_custkey")
def latest_resource(fx):
    made = fx.orders.select(F.col("o_custkey").alias("dataset"), F.col("o_orderkey").alias("resource_id"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")).alias("last_modified"), F.expr("o_orderdate - INTERVAL 30 DAY").alias("created"))
    return gtfs.newest(made, "dataset")


@query("SELECT route_name, day_type, hour, p80 AS delay_sec FROM p", {"hist": HIST, "p": P80})
def delay_key_parse(fx):
    """Profiles as files keep them, one JSON map a route of 'route|day|hour' to seconds, taken apart again."""
    rows = percentile(histogram(fx.fx_delay_obs))
    entry = F.struct(F.concat_ws("|", "route_name", "day_type", "hour"), "p80")
    files = rows.groupBy("route_name").agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("file")).select("file")
    cell = files.select(F.explode(F.from_json("file", "map<string,int>")).alias("key", "delay_sec"))
    part = F.split("key", r"\|")
    return cell.select(part[0].alias("route_name"), part[1].cast("int").alias("day_type"), part[2].cast("int").alias("hour"), "delay_sec")


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN delay_sec WHEN event_id % 3 = 1 THEN delay_sec + 7 END AS delay_sec FROM fx_delay_obs")
def rt_first_delay(fx):
    """Updates with the trip's delay, with the second stop's departure delay only, and with none."""
    obs = fx.fx_delay_obs
    none, case = F.lit(None).cast("int"), F.col("event_id") % 3
    stop = lambda a, d: F.struct(a.cast("int").alias("arrival"), d.cast("int").alias("departure"))
    stops = F.when(case == 1, F.array(stop(none, none), stop(none, F.col("delay_sec") + 7), stop(F.lit(5), none)))
    text = F.to_json(F.struct(F.col("route_name").alias("routeId"), F.col("trip_ref").cast("string").alias("tripId"), F.when(case == 0, F.col("delay_sec")).alias("delay"), stops.alias("stops")))
    parsed = obs.select("event_id", F.from_json(text, gtfs.UPDATE).alias("update"))
    return parsed.select("event_id", gtfs.update_delay(F.col("update")).alias("delay_sec"))


@query("SELECT event_id, route_name AS route, delay_sec AS delay FROM fx_delay_obs WHERE event_id % 4 <> 0 AND event_id % 5 <> 0")
def rt_departures(fx):
    """Departure boards (stop -> departures): live ones with a delay."""
    one = F.struct(F.col("event_id").cast("string").alias("trip"), F.col("route_name").alias("route"), F.when(F.col("event_id") % 4 == 0, "PLANNED").otherwise("REALTIME").alias("status"), F.when(F.col("event_id") % 5 != 0, F.col("delay_sec")).alias("delay"))
    boards = fx.fx_delay_obs.select(F.to_json(F.create_map(F.col("trip_ref").cast("string"), F.array(one))).alias("board"))
    stops = boards.select(F.explode(F.from_json("board", gtfs.DEPARTURES)).alias("stop", "list"))
    return stops.select(F.explode("list").alias("d")).where("d.status = 'REALTIME' and d.delay is not null").select(F.col("d.trip").cast("long").alias("event_id"), "d.route", "d.delay")


@query("SELECT event_id, CASE dayofweek(l) WHEN 6 THEN 1 WHEN 0 THEN 2 ELSE 0 END AS day_type, hour(l) AS hour FROM (SELECT event_id, timezone('Europe/Warsaw', timezone('UTC', CAST(ts AS TIMESTAMP))) AS l FROM fx_delay_obs)")
def local_slot(fx):
    local = F.convert_timezone(F.lit("UTC"), F.lit("Europe/Warsaw"), F.col("ts").cast("timestamp_ntz"))
    return fx.fx_delay_obs.select("event_id", X.day_class(local).alias("day_type"), F.hour(local).alias("hour"))


@query("SELECT s_suppkey, CAST(s_acctbal AS DOUBLE) AS lat FROM supplier WHERE s_suppkey % 7 <> 0 AND s_suppkey % 11 <> 0")
def stop_filter(fx):
    """Stations (type 1) and stops without a finite latitude go."""
    lat = F.when(F.col("s_suppkey") % 11 == 0, F.lit("NaN")).otherwise(F.col("s_acctbal").cast("double").cast("string")).try_cast("double")
    rows = fx.supplier.select("s_suppkey", lat.alias("lat"), F.when(F.col("s_suppkey") % 7 == 0, "1").otherwise("").alias("location_type"))
    return rows.where((F.col("location_type") != "1") & F.col("lat").isNotNull() & ~F.isnan("lat")).select("s_suppkey", "lat")


@query("SELECT trip_id, CASE WHEN m >= 9950 THEN CAST(CAST(floor(m / 1000 + 0.5) AS BIGINT) AS VARCHAR) WHEN m > 0 THEN CAST(CAST(floor(m / 100 + 0.5) AS BIGINT) // 10 AS VARCHAR) || '.' || CAST(CAST(floor(m / 100 + 0.5) AS BIGINT) % 10 AS VARCHAR) ELSE '—' END AS text FROM (SELECT trip_id, start_sec % 20000 AS m FROM fx_trips)")
def stat_format(fx):
    return fx.fx_trips.select("trip_id", X.km_text(F.col("start_sec") % 20000).alias("text"))


MASK = "SELECT feed, service_id, CAST(bit_or(b) AS BIGINT) AS mask FROM (SELECT s.feed, s.service_id, 1 << d.i AS b FROM served s JOIN (SELECT unnest([workday, saturday, sunday]) AS date, unnest([0, 1, 2]) AS i FROM chosen) d ON d.date = s.date) GROUP BY ALL"
MASKED = {**DAYS, "chosen": CHOSEN, "mask": MASK}


def day_masks(fx) -> DataFrame:
    of = staged_services(fx)
    chosen = chosen_days(usable_dates(staged(date_counts(of), "date-counts")))
    runs = [F.when(runs_on(F.col(day)), 1 << i).otherwise(0) for i, day in enumerate(("workday", "saturday", "sunday"))]
    return of.join(F.broadcast(chosen)).select("feed", "service_id", sum(runs).cast("long").alias("mask")).where("mask <> 0")  # one row


@query("SELECT * FROM mask", MASKED)
def trip_day_mask(fx):
    """Bits of the representative days that each service runs on; services of none are left out."""
    return day_masks(fx)


@query("SELECT feed, CASE feed % 3 WHEN 0 THEN arg_max(id, (CASE WHEN o_orderstatus <> 'P' THEN d ELSE d - 30 END, id)) FILTER (WHERE zip) WHEN 1 THEN max(id) ELSE min(id) END AS resource_id FROM (SELECT o_custkey AS feed, o_orderkey AS id, CAST(o_orderdate AS DATE) AS d, o_orderstatus, o_orderpriority <> '5-LOW' AS zip FROM orders) GROUP BY feed HAVING feed % 3 <> 0 OR bool_or(zip)")
def feed_resolution(fx):
    """Feeds of three kinds of address; of the first kind only archives count."""
    day = F.col("o_orderdate").cast("date")
    kind = F.element_at(F.array(F.lit("ckan-latest"), F.lit("max-id"), F.lit("literal")), (F.col("o_custkey") % 3 + 1).cast("int"))
    made = fx.orders.select(F.col("o_custkey").alias("feed"), F.col("o_orderkey").alias("resource_id"), kind.alias("kind"), F.when(F.col("o_orderpriority") != "5-LOW", "ZIP").otherwise("csv").alias("format"), F.when(F.col("o_orderstatus") != "P", day).alias("last_modified"), F.date_sub(day, 30).alias("created"))
    return gtfs.resolved(made)


@query("SELECT route_name, route_type, dense_rank() OVER (ORDER BY route_name, route_type) - 1 AS route_idx FROM (SELECT DISTINCT route_name, route_type FROM fx_routes)")
def route_dictionary(fx):
    """Route names numbered over all feeds."""
    return numbered(fx.fx_routes.select("route_name", "route_type").distinct(), ["route_name", "route_type"], "route_idx")


PROFILES = "SELECT trip_id, any_value(route_id) AS route_id, string_agg(CAST(stop_id AS VARCHAR), '-' ORDER BY pos) AS stops, string_agg(CAST(dep_sec - first_dep AS VARCHAR) || '/' || CAST(dep_sec - arr_sec AS VARCHAR), '-' ORDER BY pos) AS profile FROM (SELECT *, first_value(dep_sec) OVER (PARTITION BY trip_id ORDER BY pos) AS first_dep FROM fx_ev) GROUP BY trip_id HAVING count(*) >= 2"


@query("SELECT DISTINCT route_id, stops, profile, dense_rank() OVER (PARTITION BY route_id, stops ORDER BY profile) - 1 AS profile_idx FROM profiles", {"profiles": PROFILES})
def profile_dedup(fx):
    """Distinct times (from the first departure, with dwells) of each stop sequence, numbered within it."""
    seq = F.array_sort(F.collect_list(F.struct("pos", "stop_id", "arr_sec", "dep_sec")))
    trips = fx.fx_ev.groupBy("trip_id").agg(F.first("route_id").alias("route_id"), seq.alias("seq")).where(F.size("seq") >= 2)
    start = F.col("seq")[0]["dep_sec"]
    times = F.transform("seq", lambda s: F.concat_ws("/", (s["dep_sec"] - start).cast("string"), (s["dep_sec"] - s["arr_sec"]).cast("string")))
    found = trips.select("route_id", F.array_join(F.transform("seq", lambda s: s["stop_id"].cast("string")), "-").alias("stops"), F.array_join(times, "-").alias("profile")).distinct()
    return found.select("*", (F.dense_rank().over(W.partitionBy("route_id", "stops").orderBy("profile")) - 1).alias("profile_idx"))


@query("SELECT trip_id, pos, dep_sec FROM fx_ev")
def dep_at(fx):
    """Departures put together again from each run's start and its deltas."""
    step = fx.fx_ev.select("trip_id", "pos", "dep_sec", (F.col("dep_sec") - F.lag("dep_sec").over(along())).alias("delta"))
    start, delta = step.where("pos = 1").select("trip_id", F.col("dep_sec").alias("start")), step.select("trip_id", "pos", F.coalesce("delta", F.lit(0)).alias("delta"))
    cum = F.sum("delta").over(along().rowsBetween(W.unboundedPreceding, 0))
    return delta.join(start, "trip_id").select("trip_id", "pos", (F.col("start") + cum).cast("long").alias("dep_sec"))


@query("SELECT trip_id, row_number() OVER (PARTITION BY route_id ORDER BY start_sec, trip_id) AS ord FROM fx_trips")
def trip_order(fx):
    return fx.fx_trips.select("trip_id", F.row_number().over(W.partitionBy("route_id").orderBy("start_sec", "trip_id")).alias("ord"))


# joins by stop
#: Rows by the clusters of stops of one name: grp (node, label).
SAME_GROUP = f"SELECT u, v, greatest({RND.format('m / ' + WALK)}, 60) AS sec FROM (SELECT a, b, m FROM pairs) p JOIN grp x ON x.node = p.a JOIN grp y ON y.node = p.b AND y.label = x.label CROSS JOIN LATERAL (VALUES (p.a, p.b), (p.b, p.a)) AS d(u, v)"
GROUP_PAIRS = f"SELECT a.stop_id AS a, b.stop_id AS b, {dist('a.lat,a.lon', 'b.lat,b.lon')} AS m FROM fx_stops a JOIN fx_stops b ON a.stop_name = b.stop_name AND a.stop_id < b.stop_id"
NOWALK = f"SELECT s.stop_id, 0 AS sec FROM fx_stops s JOIN grp g ON g.node = s.stop_id, (SELECT x.*, g.label FROM (SELECT *, {dist(f'{A[0]},{A[1]}', 'lat,lon')} AS m FROM fx_stops) x JOIN grp g ON g.node = x.stop_id ORDER BY m, stop_id LIMIT 1) o WHERE g.label = o.label OR {dist('o.lat,o.lon', 's.lat,s.lon')} <= 150"


def with_groups(name: str) -> None:
    """Gives the SQL of ``name`` the clusters of stops, in front of what rests on them."""
    text = ORACLES[name]
    at = text.index("same_group AS (") if "same_group AS (" in text else text.index("nowalk AS (")
    ORACLES[name] = f"{text[:at]}{GROUPS}, {text[at:]}"


@query("SELECT * FROM same_group", {"namesakes": NAMESAKES, "pairs": GROUP_PAIRS, "same_group": SAME_GROUP})
def same_group_adj(fx):
    """Walks within a cluster of stops: those of one name that a chain of at most 300 m a link joins."""
    return proximity.group_adjacency(reach.grouped(fx.fx_stops))


with_groups("same_group_adj")


@query("SELECT * FROM nowalk", {"namesakes": NAMESAKES, "nowalk": NOWALK})
def access_nowalk(fx):
    """Without walking: the nearest stop, its cluster, and stops at most 150 m from it."""
    return proximity.access_nowalk(reach.grouped(fx.fx_stops), *A)


with_groups("access_nowalk")


def questions(fx) -> DataFrame:
    """(stop_id, at_sec): a stop and a time of each event."""
    n = fx.supplier.agg(F.count("*").alias("n"))
    return fx.events.join(n).select((F.col("event_id") % F.col("n")).alias("stop_id"), (F.col("user_id") + 36000).alias("at_sec")).distinct()


QUESTIONS = "SELECT DISTINCT 36000 + user_id AS at_sec, event_id % (SELECT count(*) FROM supplier) AS stop_id FROM events"


@query("SELECT r.at_sec, r.stop_id, min(e.dep_sec) AS dep_sec FROM questions r JOIN fx_ev e ON e.stop_id = r.stop_id AND e.dep_sec >= r.at_sec AND e.flags & 1 = 0 GROUP BY ALL", {"questions": QUESTIONS})
def next_departure(fx):
    """The next departure from a stop at or after a time, for every asked (stop, time)."""
    return proximity.next_departure(questions(fx), fx.fx_ev.where(F.col("flags").bitwiseAND(1) == 0))


PATTERNED = "SELECT e.*, p.pattern FROM fx_ev e JOIN (SELECT trip_id, min(trip_id) OVER (PARTITION BY route_id, seq) AS pattern FROM (SELECT trip_id, any_value(route_id) AS route_id, string_agg(stop_id || '/' || flags, '-' ORDER BY pos) AS seq FROM fx_ev GROUP BY trip_id)) p USING (trip_id)"


@query("SELECT q.pattern, q.pos, q.at_sec, arg_min(e.trip_id, (e.dep_sec, e.trip_id)) AS trip_id, min(e.dep_sec) AS dep_sec FROM (SELECT DISTINCT p.pattern, p.pos, r.at_sec FROM questions r JOIN (SELECT DISTINCT pattern, pos, stop_id FROM patterned WHERE flags & 1 = 0) p USING (stop_id)) q LEFT JOIN patterned e ON e.pattern = q.pattern AND e.pos = q.pos AND e.dep_sec >= q.at_sec GROUP BY ALL", {"questions": QUESTIONS, "patterned": PATTERNED})
def earliest_trip(fx):
    """The next run of a pattern at one of its positions, for every pattern that lets riders on at an asked stop; null where none follows."""
    hops = staged(encoded(fx.fx_ev).hops(), "hops")
    at = hops.where(F.col("flags").bitwiseAND(1) == 0).select("pattern", "pos", "stop_id").distinct()
    asked = questions(fx).join(at, "stop_id").select("pattern", "pos", "at_sec").distinct()
    there = hops.select("pattern", "pos", F.col("dep_sec").alias("at_sec"), "trip_id")
    found = next_of(asked, there, ["pattern", "pos"], "at_sec", F.struct(F.col("at_sec").alias("dep_sec"), "trip_id"), "run", span=3600)
    return found.select("pattern", "pos", "at_sec", "run.trip_id", "run.dep_sec")


@query("SELECT e.trip_id, e.pos, coalesce(p.p80, CAST(floor(600 * (f.factor - 1) + 0.5) AS BIGINT)) AS delay_sec FROM fx_ev e LEFT JOIN (SELECT dense_rank() OVER (ORDER BY route_name) - 1 AS rid, day_type, hour, p80 FROM p) p ON p.rid = e.route_id AND p.day_type = 0 AND p.hour = (e.dep_sec // 3600) % 24 JOIN (SELECT route_id, CASE WHEN route_type IN (3, 11) THEN 1.15e0 WHEN route_type = 0 THEN 1.05e0 WHEN route_type = 2 THEN 1.02e0 ELSE 1.1e0 END AS factor FROM fx_routes) f ON f.route_id = e.route_id", {"hist": HIST, "p": P80})
def delay_lookup(fx):
    """A workday delay of each departure: its route's and hour's, else a share of ten minutes by vehicle."""
    prof = percentile(histogram(fx.fx_delay_obs))
    names = numbered(prof.select("route_name").distinct(), ["route_name"], "route_id")
    prof = prof.where("day_type = 0").join(names, "route_name").select("route_id", "hour", "p80")
    ev = fx.fx_ev.withColumn("hour", F.floor(F.col("dep_sec") / 3600) % 24)
    rest = X.js_round(F.lit(600) * (X.ride_factor(F.col("route_type")) - 1))
    return ev.join(prof, ["route_id", "hour"], "left").select("trip_id", "pos", F.coalesce(F.col("p80").cast("long"), rest).alias("delay_sec"))


# delta coding
ROWS = "SELECT node_id, CAST(floor(lat * 1e5 + 0.5) AS BIGINT) AS qlat, CAST(floor(lon * 1e5 + 0.5) AS BIGINT) AS qlon, CAST(floor(lat * 111320.0 / 500) AS BIGINT) AS band FROM fx_walk_nodes"


def coded(fx) -> DataFrame:
    """Nodes by 500 m band of latitude and longitude within it, as differences to the one before in the band."""
    q = fx.fx_walk_nodes.select("node_id", X.js_round(F.col("lat") * 1e5).alias("qlat"), X.js_round(F.col("lon") * 1e5).alias("qlon"), F.floor(F.col("lat") * X.M_PER_DEG / 500).alias("band"))
    w = W.partitionBy("band").orderBy("qlon", "node_id")
    delta = lambda c: (F.col(c) - F.coalesce(F.lag(c).over(w), F.lit(0))).alias(f"d_{c}")
    return q.select("node_id", "band", F.row_number().over(w).alias("ord"), delta("qlat"), delta("qlon"))


@query("SELECT node_id, band, row_number() OVER w AS ord, qlat - coalesce(lag(qlat) OVER w, 0) AS d_qlat, qlon - coalesce(lag(qlon) OVER w, 0) AS d_qlon FROM r WINDOW w AS (PARTITION BY band ORDER BY qlon, node_id)", {"r": ROWS})
def delta_encode(fx):
    return coded(fx)


@query("SELECT node_id, qlat, qlon FROM r", {"r": ROWS})
def delta_decode(fx):
    w = W.partitionBy("band").orderBy("ord").rowsBetween(W.unboundedPreceding, 0)
    return coded(fx).select("node_id", F.sum("d_qlat").over(w).alias("qlat"), F.sum("d_qlon").over(w).alias("qlon"))
