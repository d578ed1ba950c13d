"""The search driver: one ReachQuery answered over a timetable, and the queries that go through it."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expr as X
from ..operators import proximity, reach
from ..operators import search as searches
from .catalog import A, ACCESS_B, B, NAMESAKES, PAIRS, RND, STEPS, WALK, query, ride_edges, round_sql, tagged
from .feeds import GROUP_PAIRS, NOWALK, SAME_GROUP, with_groups
from .journeys import faster
from .options import City, ReachQuery, parsed, written
from .stages import staged
from .surface import recursive, relax

#: Rides that a search may take; before this minute of the day the day before runs on.
ROUNDS, NIGHT_MIN = 5, 300
CITY = City(A, B, ("bus", "tram", "train"))


@dataclass(frozen=True)
class Network:
    """A day's timetable: ``stops`` (stop_id, lat, lon, stop_name, group_id) and ``ev`` (a row a run and stop)."""

    stops: DataFrame
    ev: DataFrame

    def foot(self, walk: bool) -> DataFrame:
        """(u, v, sec): all transfers, or with no walking those within a group of stops and to stops close by."""
        if walk:
            return proximity.both_ways(proximity.transfer_pairs(self.stops))
        both = proximity.group_adjacency(self.stops).unionByName(proximity.complex_pairs(self.stops))
        return both.groupBy("u", "v").agg(F.min("sec").alias("sec"))

    def access(self, q: ReachQuery) -> DataFrame:
        near = reach.access(self.stops, *q.point) if q.walk else proximity.access_nowalk(self.stops, *q.point)
        return near.select("stop_id", F.col("sec").cast("long").alias("sec"))


def reachable(net: Network, q: ReachQuery, delays: DataFrame | None = None, horizon_rounds: int = ROUNDS) -> DataFrame:
    """(stop_id, sec, pass): travel times of the query's direction, mode, access and vehicles.

    ``pass`` is 1 where the run of the day before (searched in the first hours of a day) is
    faster. ``delays`` (route_id, hour, delay_sec) count in cautious searches from a point only.
    Without access or vehicles nothing is reached but by the walk alone. A comparison gives each
    place that both points reach, with the time of the slower one (and of equals the first one's pass).
    """
    if q.compare:
        one, two = (reachable(net, replace(q, compare=False, point=at), delays, horizon_rounds) for at in (q.point, q.point2))
        both = one.join(two.toDF("stop_id", "sec2", "pass2"), "stop_id")
        return both.select("stop_id", F.greatest("sec", "sec2").alias("sec"), F.when(F.col("sec2") > F.col("sec"), F.col("pass2")).otherwise(F.col("pass")).alias("pass"))
    ev = net.ev if q.route_types is None else net.ev.where(F.col("route_type").isin(*q.route_types))
    access, foot = net.access(q), net.foot(q.walk)
    if q.mode == "general":
        ev = reach.reversed_network(ev) if q.direction == "to" else ev
        least = X.CAUTIOUS_TRANSFER_S if q.safe else 0
        edges = ride_edges_of(ev).unionByName(foot.select("u", "v", F.greatest("sec", F.lit(least)).alias("sec"))).groupBy("u", "v").agg(F.min("sec").alias("sec"))
        found = reach.shortest(access.select(F.col("stop_id").alias("node"), F.col("sec").alias("t")), edges, X.HORIZON_S, blocks=reach.plane_blocks(net.stops, "stop_id"))
        return found.select(F.col("node").alias("stop_id"), F.col("t").alias("sec"), F.lit(0).alias("pass"))
    ev = reach.reversed_network(ev) if q.direction == "to" else ev

    def run(minute: int, number: int) -> DataFrame:
        t0 = X.REVERSE_C - minute * 60 if q.direction == "to" else minute * 60
        if q.safe:
            out = searches.cautious(ev, access, foot, t0, horizon_rounds, delays if q.direction == "from" else None)
        else:
            out = reach.raptor(ev, access, foot, t0, horizon_rounds, "reach")
        return out.select("stop_id", (F.col("arr_sec") - t0).alias("sec"), F.lit(number).alias("pass"))

    first = run(q.time_min, 0)
    return faster(first, run(q.time_min + 1440, 1)) if q.time_min < NIGHT_MIN else first


def ride_edges_of(ev: DataFrame) -> DataFrame:
    """(u, v, sec) of any timetable, as ``catalog.ride_edges`` of the projected one."""

    class Only:
        fx_ev = ev

    return ride_edges(Only).select("u", "v", F.col("sec").cast("long").alias("sec"))


def network(fx) -> Network:
    return Network(staged(reach.grouped(fx.fx_stops), "stops"), fx.fx_ev)


def asked(text: str) -> ReachQuery:
    return ReachQuery.from_params(text, {"x": CITY}, "x")


def driver_sql(t0: int, ev: str, rounds: int = ROUNDS) -> dict[str, str]:
    """The round queries of a search with all of its walks to stops."""
    import re

    out = {}
    for name, text in round_sql(rounds).items():
        if name not in ("access", "pairs", "foot"):
            text = re.sub(r" WHERE m <= \d+$", "", text).replace("fx_ev", ev).replace(str(36000 + 10800), str(t0 + 10800)).replace(str(36000), str(t0))
        out[name] = text
    return out


BY_TYPE = "SELECT trip_id, stop_id, count(*) OVER (PARTITION BY trip_id) + 1 - pos AS pos, 172800 - dep_sec AS arr_sec, 172800 - arr_sec AS dep_sec, (flags >> 1) | ((flags & 1) << 1) AS flags FROM fx_ev WHERE route_type IN (3, 11, 700, 800, 0, 900)"


@query(f"SELECT stop_id, t - {172800 - 45000} AS sec FROM b5", {"sel": BY_TYPE, **driver_sql(172800 - 45000, "sel")})
def reach_driver_to(fx):
    """Arrivals by 12:30 with buses and trams, walking, as a page's address asks for them."""
    return reachable(network(fx), asked("?dir=to&t=12:30&veh=bus,tram")).select("stop_id", "sec")


@query("SELECT stop_id, greatest(a.t, b.t) - 36000 AS sec FROM b5 a JOIN o_b5 b USING (stop_id)", {"access_b": ACCESS_B, **driver_sql(36000, "fx_ev"), **tagged(driver_sql(36000, "fx_ev"), "o_", {"access": "access_b"})})
def reach_driver_compare(fx):
    """Two points compared as a page's address asks for it: the slower one's time to every stop that both reach."""
    q = asked(f"t=10:00&cmp=1&p={A[0]},{A[1]}&p2={B[0]},{B[1]}")
    return reachable(network(fx), q).select("stop_id", "sec")


COMPLEX = f"SELECT u, v, greatest({RND.format('m / ' + WALK)}, 60) AS sec FROM (SELECT a AS u, b AS v, m FROM near UNION ALL SELECT b, a, m FROM near) e JOIN fx_stops x ON x.stop_id = u JOIN fx_stops y ON y.stop_id = v WHERE m <= 150 AND x.stop_name <> y.stop_name"
GROUP_FOOT = "SELECT u, v, min(sec) AS sec FROM (SELECT u, v, sec FROM same_group UNION ALL SELECT u, v, sec FROM complex) GROUP BY u, v"


@query("SELECT node AS stop_id, t AS sec FROM reach", {"steps": STEPS, "namesakes": NAMESAKES, "pairs": GROUP_PAIRS, "same_group": SAME_GROUP, "near": PAIRS, "complex": COMPLEX, "gfoot": GROUP_FOOT, "access": NOWALK, "edges": "SELECT u, v, min(sec) AS sec FROM (SELECT stop_id AS u, next_stop AS v, greatest(ride, 0) AS sec FROM steps WHERE ride IS NOT NULL UNION ALL SELECT u, v, sec FROM gfoot) GROUP BY u, v"})
def reach_driver_general(fx):
    """Times without waiting from the nearest group of stops, changing only within groups and close by."""
    return reachable(network(fx), asked("mode=general&walk=0")).select("stop_id", "sec")


with_groups("reach_driver_general")
recursive("reach_driver_general", relax("reach", "SELECT stop_id, CAST(sec AS BIGINT) FROM access", "edges", "1e9").replace("WHERE r.t + e.sec <= 1e9", "WHERE r.t <= 10800"))


# options as columns
OPTION = """concat('?p=', CASE o_orderkey % 4 WHEN 0 THEN '52.25,21.5' WHEN 1 THEN '52.25' WHEN 2 THEN 'x,21.5' ELSE '-7.5e0,.25' END, '&t=', CASE o_orderkey % 5 WHEN 0 THEN '7:30' WHEN 1 THEN '07%3A05' WHEN 2 THEN '29:75' WHEN 3 THEN '7:5' ELSE '' END,
  '&dir=', CASE WHEN o_orderkey % 3 = 0 THEN 'to' ELSE 'up' END, '&walk=', CASE WHEN o_orderkey % 7 = 0 THEN '0' ELSE '' END, '&mode=', CASE WHEN o_orderkey % 11 = 0 THEN 'general' ELSE 'fast' END,
  '&day=', CASE o_orderkey % 3 WHEN 0 THEN 'sunday' WHEN 1 THEN 'monday' ELSE '' END, '&cmp=', CASE WHEN o_orderkey % 13 = 0 THEN '1' ELSE 'true' END, '&st=1', CASE o_orderkey % 3 WHEN 0 THEN '&veh=tram%2Cship' WHEN 1 THEN '&veh=' ELSE '' END)"""
READ = f"""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 52.25e0 WHEN 3 THEN -7.5e0 ELSE {A[0]}e0 END AS lat, CASE o_orderkey % 4 WHEN 0 THEN 21.5e0 WHEN 3 THEN 0.25e0 ELSE {A[1]}e0 END AS lon,
  CASE o_orderkey % 5 WHEN 0 THEN 450 WHEN 1 THEN 425 WHEN 2 THEN 1439 ELSE 480 END AS time_min, CASE WHEN o_orderkey % 3 = 0 THEN 'to' ELSE 'from' END AS direction, o_orderkey % 7 <> 0 AS walk,
  CASE WHEN o_orderkey % 11 = 0 THEN 'general' ELSE 'time' END AS mode, CASE WHEN o_orderkey % 3 = 0 THEN 'sunday' ELSE 'workday' END AS day, o_orderkey % 13 = 0 AS compare, CASE o_orderkey % 3 WHEN 0 THEN 'tram' WHEN 1 THEN '' ELSE 'bus,tram,train' END AS vehicles FROM orders"""


def options_of(fx) -> DataFrame:
    return fx.sql(f"SELECT o_orderkey, {OPTION} AS text FROM orders", orders=fx.orders).select("o_orderkey", parsed(F.col("text"), CITY).alias("o"))


@query(READ)
def option_parse(fx):
    """Options with valid, invalid, missing and coded values."""
    return options_of(fx).select("o_orderkey", F.col("o.p.lat").alias("lat"), F.col("o.p.lon").alias("lon"), "o.time_min", "o.direction", "o.walk", "o.mode", "o.day", "o.compare", F.array_join("o.vehicles", ",").alias("vehicles"))


@query(f"""SELECT o_orderkey, concat('city=x%20y&p=', printf('%.5f', lat), '%2C', printf('%.5f', lon), CASE WHEN compare THEN '&cmp=1&p2={B[0]:.5f}%2C{B[1]:.5f}' ELSE '' END, '&dir=', direction, '&walk=', CASE WHEN walk THEN '1' ELSE '0' END, '&mode=', mode,
  CASE WHEN mode = 'time' THEN concat('&t=', printf('%02d', time_min // 60), '%3A', printf('%02d', time_min % 60), '&day=', day) ELSE '' END, CASE WHEN compare THEN '' ELSE '&st=1' END, CASE WHEN vehicles <> 'bus,tram,train' THEN concat('&veh=', replace(vehicles, ',', '%2C')) ELSE '' END) AS text FROM r""", {"r": READ})
def option_serialize(fx):
    """The options written back in their one form."""
    return options_of(fx).select("o_orderkey", F.regexp_replace(written(F.col("o"), F.lit("x y"), CITY), r"\+", "%20").alias("text"))
