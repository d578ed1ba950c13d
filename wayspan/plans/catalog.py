"""Registered timetable queries over the projected tables, each with its SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import expr as X
from ..operators import proximity, reach
from ..sources import gtfs
from ..sources.fixtures import Fixtures, with_tables
from .stages import staged

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Origins, departure, access radius of the transfer variant, the grid box.
A, B, T0, NEAR_M = (52.201, 21.010), (52.208, 21.030), 36000, 200
GRID = (52.199, 20.998, 52.212, 21.040)
M = "111320.0"


def query(sql: str | None = None, more: dict[str, str] | None = None):
    def register(f: Callable[[Fixtures], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Fixtures(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = with_tables(sql, more)
        return f

    return register


def dist(a: str, b: str) -> str:
    """SQL distance between the points a and b, given as 'lat,lon'."""
    (la, oa), (lb, ob) = a.split(","), b.split(",")
    return f"sqrt(power(({ob} - {oa}) * {M} * cos(radians({la})), 2) + power(({lb} - {la}) * {M}, 2))"


WALK = "(CAST(4.5 AS DOUBLE) / 3.6 / 1.3)"
RND = "CAST(floor({} + 0.5) AS BIGINT)"
ACCESS = f"SELECT stop_id, {RND.format('m / ' + WALK)} AS sec, m FROM (SELECT stop_id, {dist(f'{A[0]},{A[1]}', 'lat,lon')} AS m FROM fx_stops) WHERE m <= 10800 * {WALK}"
PAIRS = f"""SELECT a.stop_id AS a, b.stop_id AS b, {dist('a.lat,a.lon', 'b.lat,b.lon')} AS m FROM fx_stops a JOIN fx_stops b
  ON a.lat < b.lat OR (a.lat = b.lat AND a.stop_id < b.stop_id)"""
FOOT = f"""SELECT u, v, greatest({RND.format('m / ' + WALK)}, 60) AS sec FROM (
  SELECT a AS u, b AS v, m FROM pairs WHERE m <= 500 UNION ALL SELECT b, a, m FROM pairs WHERE m <= 500)"""


# scalars
@query("SELECT trip_id, seq, CASE trip_id % 11 WHEN 3 THEN NULL WHEN 4 THEN NULL WHEN 5 THEN arr_sec // 60 * 60 ELSE arr_sec END AS sec FROM fx_stop_times")
def time_to_sec(fx):
    """Times with one or two digits of hours, past midnight, without seconds, with blanks, empty, and with a word in them."""
    hour, minute, second = F.floor(F.col("arr_sec") / 3600), F.floor(F.col("arr_sec") / 60) % 60, (F.col("arr_sec") % 60).cast("long")
    whole, odd = F.format_string("%d:%02d:%02d", hour, minute, second), F.col("trip_id") % 11
    text = F.when(odd == 3, "").when(odd == 4, F.concat(F.lit("x"), whole)).when(odd == 5, F.format_string("%02d:%02d", hour, minute)).when(odd == 6, F.concat(F.lit(" "), whole, F.lit(" "))).otherwise(whole)
    return fx.fx_stop_times.select("trip_id", "seq", X.time_to_sec(text).alias("sec"))


@query("SELECT o_orderkey, dayofweek(o_orderdate) AS weekday, CASE dayofweek(o_orderdate) WHEN 6 THEN 1 WHEN 0 THEN 2 ELSE 0 END AS day_class FROM orders")
def weekday_class(fx):
    return fx.orders.select("o_orderkey", X.weekday(F.col("o_orderdate")).alias("weekday"), X.day_class(F.col("o_orderdate")).alias("day_class"))


@query(f"SELECT stop_id, CAST(floor({dist(f'{A[0]},{A[1]}', 'lat,lon')} * 1000) AS BIGINT) AS mm FROM fx_stops")
def distance_equirect(fx):
    return fx.fx_stops.select("stop_id", F.floor(X.distance_m(F.lit(A[0]), F.lit(A[1]), F.col("lat"), F.col("lon")) * 1000).alias("mm"))


@query("SELECT stop_id, CAST(floor(lat * 1e5 + 0.5) AS BIGINT) AS qlat, CAST(floor(lon * 1e5 + 0.5) AS BIGINT) AS qlon FROM fx_stops")
def quantize_coords(fx):
    return fx.fx_stops.select("stop_id", X.js_round(F.col("lat") * 1e5).alias("qlat"), X.js_round(F.col("lon") * 1e5).alias("qlon"))


@query(r"SELECT s_suppkey, regexp_replace(trim(concat(' ', s_name, ' 03 ')), ' \d+$', '') AS name FROM supplier")
def stop_name_normalize(fx):
    return fx.supplier.select("s_suppkey", X.stop_name(F.concat(F.lit(" "), "s_name", F.lit(" 03 "))).alias("name"))


@query("SELECT o_orderkey AS route_id, CASE WHEN o_orderkey % 5 = 1 THEN o_orderpriority WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey AS VARCHAR) ELSE o_orderstatus END AS name FROM orders")
def route_display_name(fx):
    """A short name in one of five rows, none or null in the others; a long one in two of three."""
    key = F.col("o_orderkey")
    short = F.when(key % 5 == 1, F.col("o_orderpriority")).when(key % 5 == 2, F.lit(None)).otherwise("")
    long = F.when(key % 3 == 0, "").otherwise(F.col("o_orderstatus"))
    return fx.orders.select(key.alias("route_id"), X.display_name(short, long, key.cast("string")).alias("name"))


@query("SELECT trip_id, seq, CASE WHEN (trip_id + seq) % 5 = 1 THEN 1 ELSE 0 END + CASE WHEN (trip_id + 3 * seq) % 7 = 1 THEN 2 ELSE 0 END AS flags FROM fx_stop_times")
def pickup_drop_flags(fx):
    """All codes, missing ones and a strange one among them."""
    code = lambda n: F.when(n < 4, n.cast("string")).when(n == 4, "").when(n == 5, "x")
    pickup, drop = code((F.col("trip_id") + F.col("seq")) % 5), code((F.col("trip_id") + 3 * F.col("seq")) % 7)
    return fx.fx_stop_times.select("trip_id", "seq", X.flags(pickup, drop).alias("flags"))


@query("SELECT route_id, CAST(CASE WHEN route_type IN (3, 11) THEN 1.15 WHEN route_type = 0 THEN 1.05 WHEN route_type = 2 THEN 1.02 ELSE 1.1 END AS DOUBLE) AS factor FROM fx_routes")
def ride_factor(fx):
    return fx.fx_routes.select("route_id", X.ride_factor(F.col("route_type")).cast("double").alias("factor"))


@query("SELECT stop_id, CASE WHEN sec <= 600 THEN 10 WHEN sec <= 1200 THEN 20 WHEN sec <= 1800 THEN 30 WHEN sec <= 2700 THEN 45 WHEN sec <= 3600 THEN 60 WHEN sec <= 5400 THEN 90 END AS band FROM access", {"access": ACCESS})
def band_classify(fx):
    return reach.access(fx.fx_stops, *A).select("stop_id", X.band_minutes(F.col("sec")).alias("band"))


@query("SELECT event_id, CASE WHEN delay_sec < -60 THEN 0 WHEN delay_sec < 60 THEN 1 WHEN delay_sec < 180 THEN 2 WHEN delay_sec < 300 THEN 3 WHEN delay_sec < 600 THEN 4 ELSE 5 END AS bucket FROM fx_delay_obs")
def delay_bucket(fx):
    return fx.fx_delay_obs.select("event_id", X.delay_bucket(F.col("delay_sec")).alias("bucket"))


@query("SELECT trip_id, lpad(CAST((start_sec // 3600) % 24 AS VARCHAR), 2, '0') || ':' || lpad(CAST((start_sec // 60) % 60 AS VARCHAR), 2, '0') AS clock FROM fx_trips")
def clock_format(fx):
    return fx.fx_trips.select("trip_id", X.clock(F.col("start_sec")).alias("clock"))


@query("SELECT trip_id, pos FROM fx_ev WHERE route_type IN (0, 2)")
def vehicle_type_filter(fx):
    return fx.fx_ev.where(F.col("route_type").isin(0, 2)).select("trip_id", "pos")


@query("SELECT trip_id, trip_id % 3 AS feed FROM fx_trips t JOIN fx_routes r ON r.route_id = t.route_id WHERE trip_id % 3 = 2 OR (trip_id % 3 = 0 AND agency_id IN (1, 3)) OR (trip_id % 3 = 1 AND agency_id = 2)")
def agency_filter(fx):
    """Runs of the agencies that their feed keeps, by the feeds' configuration; a feed that names none keeps all."""
    feeds = fx.spark.createDataFrame([(0, ["1", "3"]), (1, ["2"]), (2, None)], "feed long, keepAgency array<string>")
    runs = fx.fx_trips.join(fx.fx_routes, "route_id").select("trip_id", (F.col("trip_id") % 3).cast("long").alias("feed"), F.col("agency_id").cast("string").alias("agency"))
    return gtfs.kept_agencies(runs, feeds).select("trip_id", "feed")


@query(f"SELECT 25 AS res, CAST(ceil(({GRID[3]} - {GRID[1]}) * {M} * cos(radians(({GRID[0]} + {GRID[2]}) / 2)) / 25) AS BIGINT) AS w, CAST(ceil(({GRID[2]} - {GRID[0]}) * {M} / 25) AS BIGINT) AS h, count(*) AS stops FROM fx_stops")
def grid_dims(fx):
    s, w, n, e = map(F.lit, GRID)
    x, y = (e - w) * X.M_PER_DEG * F.cos(F.radians((s + n) / 2)), (n - s) * X.M_PER_DEG
    res = F.greatest(F.lit(25), F.ceil(F.sqrt(x * y / 4e6))).cast("int")
    return fx.fx_stops.agg(F.count("*").alias("stops")).select(res.alias("res"), F.ceil(x / res).alias("w"), F.ceil(y / res).alias("h"), "stops")


# calendar
DATES = """SELECT c.feed, c.service_id, CAST(d AS DATE) AS date FROM (
  SELECT *, unnest(generate_series(start_date, least(end_date, start_date + 119), INTERVAL 1 DAY)) AS d FROM fx_calendar) c
  WHERE CASE dayofweek(d) WHEN 0 THEN sun WHEN 1 THEN mon WHEN 2 THEN tue WHEN 3 THEN wed WHEN 4 THEN thu WHEN 5 THEN fri ELSE sat END = 1"""
#: The same without the bound on a range's days.
ALL_DATES = DATES.replace("least(end_date, start_date + 119)", "end_date")
SERVED = """SELECT feed, service_id, date FROM dates UNION SELECT feed, service_id, date FROM fx_calendar_dates WHERE exception_type = 1
  EXCEPT SELECT feed, service_id, date FROM fx_calendar_dates WHERE exception_type = 2"""


WEEK = ("sun", "mon", "tue", "wed", "thu", "fri", "sat")


#: Days of a range that the reference's build takes at most, as does the SQL of queries on ``DATES``.
MOST_DAYS = 120


def range_of(most: int | None = MOST_DAYS) -> Column:
    """A calendar row as (first, last, week): its first ``most`` days, or all; a bit a weekday from Sunday on."""
    last = F.col("end_date") if most is None else F.least("end_date", F.date_add("start_date", most - 1))
    week = sum((F.when(F.col(day) == 1, 1 << i).otherwise(0) for i, day in enumerate(WEEK)), F.lit(0))
    return F.struct(F.col("start_date").alias("first"), last.alias("last"), week.alias("week"))


def days_of(range_: Column) -> Column:
    """Dates of a range (see ``range_of``); none of one that ends before it starts."""
    first, last = range_["first"], range_["last"]
    weekly = []
    for i in range(7):  # a sequence of seven days' steps each
        start = F.date_add(first, (F.lit(8 + i) - F.dayofweek(first)) % 7)
        weekly.append(F.when((range_["week"].bitwiseAND(1 << i) != 0) & (start <= last), F.sequence(start, last, F.expr("interval 7 days"))).otherwise(F.array().cast("array<date>")))
    return F.concat(*weekly)


def calendar_dates(calendar: DataFrame) -> DataFrame:
    """Dates of service by weekday flags (see ``days_of``), a row each."""
    return calendar.select("feed", "service_id", F.explode(days_of(range_of())).alias("date"))


def services(fx, most: int | None = MOST_DAYS) -> DataFrame:
    """(feed, service_id, ranges, more, less): a row a service, with its distinct ranges (of ``most`` days, or whole) and the dates that are added and taken out.

    Only rows of the two tables are shuffled, and no range becomes dates. They are dealt
    by ``service_id`` alone: services of that name in other feeds lie in the same partition.
    """
    none = lambda of: F.lit(None).cast(of)
    keys, change = ["feed", "service_id"], fx.fx_calendar_dates
    ranges = fx.fx_calendar.select(*keys, range_of(most).alias("range"))
    kind = ranges.schema["range"].dataType
    rows = ranges.select(*keys, "range", none("struct<date:date>").alias("more"), none("struct<date:date>").alias("less"))
    day = lambda n: F.when(F.col("exception_type") == n, F.struct("date"))
    rows = rows.unionByName(change.select(*keys, none(kind).alias("range"), day(1).alias("more"), day(2).alias("less")))
    of = rows.repartition("service_id").groupBy(*keys).agg(*[F.collect_set(c).alias(c) for c in ("range", "more", "less")])
    return of.select(*keys, F.array_sort("range").alias("ranges"), F.col("more.date").alias("more"), F.col("less.date").alias("less"))


def service_days(fx) -> DataFrame:
    """(feed, service_id, added, dates): a row a service, with the distinct dates of its ranges and additions, and those left when exceptions go."""
    weekly = F.flatten(F.transform("ranges", days_of))
    of = services(fx).select("feed", "service_id", F.array_union(weekly, F.col("more")).alias("added"), "less")
    return of.select("feed", "service_id", "added", F.array_except("added", F.col("less")).alias("dates"))


def in_ranges(day: Column, ranges: Column | str = "ranges") -> Column:
    """Whether a service's ranges hold the day."""
    bit = F.call_function("shiftleft", F.lit(1), F.dayofweek(day) - 1)
    return F.coalesce(F.exists(ranges, lambda r: day.between(r["first"], r["last"]) & (r["week"].bitwiseAND(bit) != 0)), F.lit(False))


def runs_on(day: Column) -> Column:
    """Whether a service (see ``services``) runs on the day; not where that is null."""
    has = lambda dates: F.coalesce(F.array_contains(dates, day), F.lit(False))
    return (in_ranges(day) | has("more")) & ~has("less")


def apart() -> Column:
    """The parts (first, last, week) of a row's ``ranges`` that no earlier one has on their weekdays; those of a single range are itself."""
    alone = F.filter("ranges", lambda r: (r["first"] <= r["last"]) & (r["week"] != 0))
    none = F.struct(F.array().cast("array<struct<first:date,last:date,week:int>>").alias("parts"), F.lit(None).cast("date").alias("end"))
    weekly = []
    for i in range(7):
        on = F.filter("ranges", lambda r: (r["first"] <= r["last"]) & (r["week"].bitwiseAND(1 << i) != 0))  # noqa: B023
        rest = lambda held, r: F.struct(F.greatest(r["first"], F.date_add(held["end"], 1)).alias("first"), r["last"].alias("last"), F.lit(1 << i).alias("week"))  # noqa: B023, E731
        held = F.aggregate(on, none, lambda held, r: F.struct(F.concat(held["parts"], F.array(rest(held, r))).alias("parts"), F.greatest(held["end"], r["last"]).alias("end")))  # noqa: B023
        weekly.append(F.filter(held["parts"], lambda r: r["first"] <= r["last"]))
    return F.when(F.size("ranges") > 1, F.concat(*weekly)).otherwise(alone)


def weekly_counts(of: DataFrame, by: str) -> DataFrame:
    """(by, date, n): how many services of ``of`` (by, ranges, n: services alike) have the date in their ranges.

    A range is a step up at its first date and one down behind its last. Only the sums of steps become dates, so
    a service with a range of many years costs two rows.
    """
    part = of.select(by, "n", F.explode(apart()).alias("r"))
    ends = F.array(F.struct(F.col("r.first").alias("date"), F.col("n")), F.struct(F.date_add("r.last", 1).alias("date"), (-F.col("n")).alias("n")))
    step = part.select(by, "r.week", F.explode(ends).alias("s")).groupBy(by, "week", F.col("s.date").alias("first")).agg(F.sum("s.n").alias("n"))
    along = W.partitionBy(by, "week").orderBy("first")  # a row a date at most
    runs = step.select(by, F.struct("first", F.date_sub(F.lead("first").over(along), 1).alias("last"), "week").alias("r"), F.sum("n").over(along).alias("n"))
    return runs.where("n > 0").select(by, "n", F.explode(days_of(F.col("r"))).alias("date")).groupBy(by, "date").agg(F.sum("n").alias("n"))


def date_counts(of: DataFrame) -> DataFrame:
    """(feed, date, added, served): how many services of each feed have the date by ranges and additions, and how many are left when exceptions go. ``of``: staged ``services``, which is read twice.

    Ranges are counted by their ends (see ``weekly_counts``); additions and exceptions are then counted one by one, where
    the ranges don't say the same.
    """
    alike = of.where(F.size("ranges") > 0).groupBy("feed", "ranges").agg(F.count("*").alias("n"))
    weekly = weekly_counts(alike, "feed").select("feed", "date", F.col("n").alias("added"), F.lit(0).cast("long").alias("gone"))
    change = lambda more, less: F.struct(F.lit(more).cast("long").alias("added"), F.lit(less).cast("long").alias("gone"))
    new = F.transform(F.filter("more", lambda d: ~in_ranges(d)), lambda d: F.struct(d.alias("date"), change(1, 0).alias("n")))
    gone = F.transform(F.filter("less", lambda d: in_ranges(d) | F.exists("more", lambda m: m.eqNullSafe(d))), lambda d: F.struct(d.alias("date"), change(0, 1).alias("n")))
    other = of.select("feed", F.explode(F.concat(new, gone)).alias("c")).select("feed", "c.date", "c.n.added", "c.n.gone")
    dates = weekly.unionByName(other).groupBy("feed", "date").agg(F.sum("added").alias("added"), F.sum("gone").alias("gone"))
    return dates.select("feed", "date", "added", (F.col("added") - F.col("gone")).alias("served"))


def ranges_of(days: DataFrame, dates: str) -> DataFrame:
    """(feed, first, last) of the dates of all its services."""
    return days.where(F.size(dates) > 0).groupBy("feed").agg(F.min(F.array_min(dates)).alias("first"), F.max(F.array_max(dates)).alias("last"))


def counted_ranges(counts: DataFrame, of: str) -> DataFrame:
    """(feed, first, last) of the dates that ``date_counts`` has in the column ``of``."""
    return counts.where(F.col(of) > 0).groupBy("feed").agg(F.min("date").alias("first"), F.max("date").alias("last"))


def staged_counts(fx, most: int | None = MOST_DAYS) -> DataFrame:
    return staged(date_counts(staged_services(fx, most)), "date-counts")


def staged_services(fx, most: int | None = MOST_DAYS) -> DataFrame:
    return staged(services(fx, most), "services")


def served(fx) -> DataFrame:
    return service_days(fx).select("feed", "service_id", F.explode("dates").alias("date"))


@query("SELECT * FROM dates", {"dates": DATES})
def calendar_expand(fx):
    return calendar_dates(fx.fx_calendar)


@query("SELECT * FROM served", {"dates": DATES, "served": SERVED})
def calendar_exceptions(fx):
    return served(fx)


@query("SELECT feed, min(date) AS first, max(date) AS last FROM served GROUP BY feed", {"dates": DATES, "served": SERVED})
def feed_ranges(fx):
    return counted_ranges(date_counts(staged_services(fx)), "served")


def names_by_date(of: DataFrame) -> DataFrame:
    """(date, services): how many names of ``services`` run on each date in any feed; dates on which only services without a name run have none.

    A name's ranges of all feeds are counted together (see ``weekly_counts``). Only on dates that are added or
    taken out can it differ from them, and there it is asked day by day.
    """
    one = of.groupBy("service_id").agg(F.collect_list(F.struct("ranges", "more", "less")).alias("feeds"))
    each = lambda part: F.flatten(F.transform("feeds", part))
    one = one.select("service_id", "feeds", F.array_sort(F.array_distinct(each(lambda f: f["ranges"]))).alias("ranges"), F.array_distinct(each(lambda f: F.concat(f["more"], f["less"]))).alias("odd"))
    has = lambda dates, day: F.exists(dates, lambda d: d.eqNullSafe(day))
    runs = lambda day: F.exists("feeds", lambda f: (in_ranges(day, f["ranges"]) | has(f["more"], day)) & ~has(f["less"], day))
    change = F.transform("odd", lambda d: F.struct(d.alias("date"), (runs(d).cast("long") - in_ranges(d).cast("long")).alias("n")))
    one = staged(one.select(F.col("service_id").isNotNull().alias("named"), "ranges", F.filter(change, lambda c: c["n"] != 0).alias("change")), "names")
    alike = one.where(F.size("ranges") > 0).groupBy("named", "ranges").agg(F.count("*").alias("n"))
    other = one.select("named", F.explode("change").alias("c")).select("named", "c.date", "c.n")
    dates = weekly_counts(alike, "named").unionByName(other).groupBy("named", "date").agg(F.sum("n").alias("n")).where("n > 0")
    return dates.groupBy("date").agg(F.sum(F.when(F.col("named"), F.col("n")).otherwise(0)).alias("services"))


@query("SELECT date, count(DISTINCT service_id) AS services FROM served GROUP BY date", {"dates": ALL_DATES, "served": SERVED})
def services_by_date(fx):
    return names_by_date(services(fx, None))


#: The day from which timetables count (an argument, never the clock).
AS_OF = "1996-01-15"
COMMON = "SELECT max(first) AS first, min(last) AS last FROM (SELECT feed, min(date) AS first, max(date) AS last FROM added GROUP BY feed)"
#: Ranges are bounded by what is added, so a date that is taken out still counts.
ADDED = "SELECT feed, service_id, date FROM dates UNION SELECT feed, service_id, date FROM fx_calendar_dates WHERE exception_type = 1"
USABLE = f"""SELECT date FROM (SELECT date, date >= DATE '{AS_OF}' AS ahead, max(date) OVER () >= DATE '{AS_OF}' AS any_ahead
  FROM (SELECT DISTINCT s.date FROM served s, common c WHERE s.date BETWEEN c.first AND c.last)) WHERE ahead OR NOT any_ahead"""
DAYS = {"dates": DATES, "served": SERVED, "added": ADDED, "common": COMMON, "usable": USABLE}
ALL_DAYS = {**DAYS, "dates": ALL_DATES}


def common_range(fx) -> DataFrame:
    """(first, last) of the dates that all feeds cover; fails where they have none in common."""
    return common_of(date_counts(staged_services(fx)))


def common_of(counts: DataFrame) -> DataFrame:
    both = counted_ranges(counts, "added").agg(F.max("first").alias("first"), F.min("last").alias("last"))
    return both.select(F.when(F.col("first") > F.col("last"), F.raise_error(F.lit("the feeds have no dates in common")).cast("date")).otherwise(F.col("first")).alias("first"), "last")


def usable_dates(counts: DataFrame, as_of: str = AS_OF) -> DataFrame:
    """(date): served dates of the common range from ``as_of`` on; all of the range where none is left. ``counts``: staged ``date_counts``, read more than once."""
    inside = counts.where("served > 0").select("date").distinct().join(F.broadcast(common_of(counts))).where("date between first and last").select("date")  # one row
    day = F.lit(as_of).cast("date")
    ahead = inside.agg((F.max("date") >= day).alias("any_ahead"))
    return inside.join(F.broadcast(ahead)).where((F.col("date") >= day) | ~F.col("any_ahead")).select("date")


@query("SELECT * FROM common", DAYS)
def common_date_range(fx):
    return common_range(fx)


@query("SELECT * FROM usable", ALL_DAYS)
def service_dates(fx):
    return usable_dates(staged_counts(fx, None))


@query("SELECT date FROM (SELECT DISTINCT s.date FROM served s, common c WHERE s.date BETWEEN c.first AND c.last)", ALL_DAYS)
def service_dates_past(fx):
    """All dates lie before the day asked for: the whole common range counts."""
    return usable_dates(staged_counts(fx, None), "2040-01-01")


@query("SELECT trip_id, unnest(range(start_sec, end_sec, headway)) AS start FROM fx_frequencies")
def frequency_expand(fx):
    starts = F.when((F.col("headway") > 0) & (F.col("start_sec") < F.col("end_sec")), F.sequence("start_sec", F.col("end_sec") - 1, "headway"))
    return fx.fx_frequencies.select("trip_id", F.explode(starts).alias("start")).select("trip_id", F.col("start").cast("long"))


@query("SELECT trip_id, unnest(range(start_sec, end_sec, headway)) AS start FROM fx_frequencies UNION ALL SELECT trip_id, start_sec FROM fx_trips WHERE trip_id NOT IN (SELECT trip_id FROM fx_frequencies)")
def trip_starts(fx):
    """Starts of all runs: those of a run's frequency windows stand for its own."""
    own = fx.fx_trips.join(fx.fx_frequencies, "trip_id", "left_anti").select("trip_id", F.col("start_sec").cast("long").alias("start"))
    return frequency_expand(fx).unionByName(own)


# timetable
@query("SELECT t.trip_id, coalesce(r.route_name, '?') AS route_name, coalesce(r.route_type, 0) AS route_type FROM fx_trips t LEFT JOIN fx_routes r ON r.route_id = t.route_id AND r.route_id <> 7")
def trip_route_join(fx):
    known = fx.fx_routes.where("route_id <> 7")
    return fx.fx_trips.join(known, "route_id", "left").select("trip_id", F.coalesce("route_name", F.lit("?")).alias("route_name"), F.coalesce("route_type", F.lit(0)).alias("route_type"))


@query("SELECT f.* FROM fx_frequencies f WHERE f.trip_id IN (SELECT trip_id FROM fx_trips WHERE service_id = 'F')")
def frequency_semi(fx):
    return fx.fx_frequencies.join(fx.fx_trips.where("service_id = 'F'"), "trip_id", "left_semi")


@query("SELECT s.trip_id, s.seq, s.stop_id FROM fx_stop_times s JOIN fx_stops p ON p.stop_id = s.stop_id WHERE p.stop_id % 5 <> 0 AND s.trip_id IN (SELECT trip_id FROM fx_trips WHERE service_id <> 'P')")
def stop_times_resolve(fx):
    trips, stops = fx.fx_trips.where("service_id <> 'P'"), fx.fx_stops.where("stop_id % 5 <> 0").select("stop_id")
    return fx.fx_stop_times.join(trips, "trip_id", "left_semi").join(stops, "stop_id").select("trip_id", "seq", "stop_id")


@query("SELECT trip_id, string_agg(CAST(stop_id AS VARCHAR), '-' ORDER BY pos) AS stops, count(*) AS n FROM fx_ev GROUP BY trip_id")
def trip_sequences(fx):
    seq = F.array_sort(F.collect_list(F.struct("pos", "stop_id")))
    return fx.fx_ev.groupBy("trip_id").agg(F.array_join(F.transform(seq, lambda s: s["stop_id"].cast("string")), "-").alias("stops"), F.count("*").alias("n"))


STEPS = "SELECT *, dep_sec - lag(dep_sec) OVER (PARTITION BY trip_id ORDER BY pos) AS delta, lead(arr_sec) OVER (PARTITION BY trip_id ORDER BY pos) - dep_sec AS ride, lead(stop_id) OVER (PARTITION BY trip_id ORDER BY pos) AS next_stop, count(*) OVER (PARTITION BY trip_id) AS n FROM fx_ev"


def along():
    return W.partitionBy("trip_id").orderBy("pos")



@query("SELECT trip_id, bool_and(delta IS NULL OR delta >= 0) AND count(*) >= 2 AS valid FROM steps GROUP BY trip_id", {"steps": STEPS})
def trip_validity(fx):
    delta = fx.fx_ev.withColumn("delta", F.col("dep_sec") - F.lag("dep_sec").over(along()))
    return delta.groupBy("trip_id").agg((F.bool_and(F.col("delta").isNull() | (F.col("delta") >= 0)) & (F.count("*") >= 2)).alias("valid"))


@query("SELECT trip_id, pos, delta FROM steps", {"steps": STEPS})
def departure_deltas(fx):
    return fx.fx_ev.select("trip_id", "pos", (F.col("dep_sec") - F.lag("dep_sec").over(along())).alias("delta"))


@query("SELECT trip_id, pos, CASE WHEN pos = 1 OR pos = n THEN 0 ELSE greatest(0, dep_sec - arr_sec) END AS dwell FROM steps", {"steps": STEPS})
def dwell_times(fx):
    n = F.count("*").over(W.partitionBy("trip_id"))
    return fx.fx_ev.select("trip_id", "pos", F.when((F.col("pos") == 1) | (F.col("pos") == n), 0).otherwise(F.greatest(F.lit(0), F.col("dep_sec") - F.col("arr_sec"))).alias("dwell"))


@query("SELECT trip_id, pos, greatest(ride, 0) AS ride FROM steps WHERE ride IS NOT NULL", {"steps": STEPS})
def hop_ride_time(fx):
    hop = fx.fx_ev.select("trip_id", "pos", (F.lead("arr_sec").over(along()) - F.col("dep_sec")).alias("ride"))
    return hop.where("ride is not null").select("trip_id", "pos", F.greatest("ride", F.lit(0)).alias("ride"))


@query("SELECT trip_id, pos, CAST(sum(coalesce(delta, 0)) OVER (PARTITION BY trip_id ORDER BY pos) AS BIGINT) AS cum FROM steps", {"steps": STEPS})
def profile_cumsum(fx):
    delta = fx.fx_ev.withColumn("delta", F.coalesce(F.col("dep_sec") - F.lag("dep_sec").over(along()), F.lit(0)))
    return delta.select("trip_id", "pos", F.sum("delta").over(along().rowsBetween(W.unboundedPreceding, 0)).cast("long").alias("cum"))


@query("SELECT stop_id AS u, next_stop AS v, min(greatest(ride, 0)) AS sec, arg_min(route_id, (greatest(ride, 0), route_id)) AS route_id FROM steps WHERE ride IS NOT NULL GROUP BY ALL", {"steps": STEPS})
def min_ride_edges(fx):
    """The shortest ride between neighbouring stops of any run, and the route that has it (the least of equals)."""
    hop = fx.fx_ev.select(F.col("stop_id").alias("u"), F.lead("stop_id").over(along()).alias("v"), (F.lead("arr_sec").over(along()) - F.col("dep_sec")).alias("ride"), "route_id")
    least = F.min(F.struct(F.greatest("ride", F.lit(0)).alias("sec"), "route_id"))
    return hop.where("ride is not null").groupBy("u", "v").agg(least.alias("e")).select("u", "v", "e.sec", "e.route_id")


def ride_edges(fx) -> DataFrame:
    """(u, v, sec): the shortest ride between neighbouring stops of any run."""
    hop = fx.fx_ev.select(F.col("stop_id").alias("u"), F.lead("stop_id").over(along()).alias("v"), (F.lead("arr_sec").over(along()) - F.col("dep_sec")).alias("ride"))
    return hop.where("ride is not null").groupBy("u", "v").agg(F.min(F.greatest("ride", F.lit(0))).alias("sec"))


@query("SELECT route_id, stops, flagged, count(*) AS trips FROM (SELECT trip_id, any_value(route_id) AS route_id, string_agg(CAST(stop_id AS VARCHAR), '-' ORDER BY pos) AS stops, string_agg(CAST(flags AS VARCHAR), '-' ORDER BY pos) AS flagged FROM fx_ev GROUP BY trip_id HAVING count(*) >= 2) GROUP BY ALL")
def pattern_dedup(fx):
    seq = F.array_sort(F.collect_list(F.struct("pos", "stop_id", "flags")))
    trips = fx.fx_ev.groupBy("trip_id").agg(F.first("route_id").alias("route_id"), seq.alias("seq")).where(F.size("seq") >= 2)
    text = lambda c: F.array_join(F.transform("seq", lambda s: s[c].cast("string")), "-")
    return trips.groupBy("route_id", text("stop_id").alias("stops"), text("flags").alias("flagged")).agg(F.count("*").alias("trips"))


# proximity
@query(f"SELECT a, b, {RND.format('m / ' + WALK)} AS sec FROM pairs WHERE m <= 500", {"pairs": PAIRS})
def transfer_pairs(fx):
    return proximity.transfer_pairs(fx.fx_stops)


@query("SELECT * FROM foot", {"pairs": PAIRS, "foot": FOOT})
def transfer_adj(fx):
    return proximity.both_ways(proximity.transfer_pairs(fx.fx_stops))


@query(f"SELECT a.stop_id AS a, b.stop_id AS b FROM fx_stops a JOIN fx_stops b ON a.stop_name = b.stop_name AND a.stop_id < b.stop_id WHERE {dist('a.lat,a.lon', 'b.lat,b.lon')} <= 300")
def same_name_pairs(fx):
    return proximity.same_name_pairs(fx.fx_stops)


@query(f"SELECT u, v, greatest({RND.format('m / ' + WALK)}, 60) AS sec FROM (SELECT a AS u, b AS v, m FROM pairs UNION ALL SELECT b, a, m FROM pairs) e JOIN fx_stops x ON x.stop_id = u JOIN fx_stops y ON y.stop_id = v WHERE m <= 150 AND x.stop_name <> y.stop_name", {"pairs": PAIRS})
def complex_adj(fx):
    return proximity.complex_pairs(fx.fx_stops)


@query("SELECT stop_id, sec FROM access", {"access": ACCESS})
def access_walk(fx):
    return reach.access(fx.fx_stops, *A).select("stop_id", "sec")


NAMESAKES = f"SELECT a.stop_id AS u, b.stop_id AS v FROM fx_stops a JOIN fx_stops b ON a.stop_name = b.stop_name AND a.stop_id <> b.stop_id WHERE CASE WHEN a.stop_id < b.stop_id THEN {dist('a.lat,a.lon', 'b.lat,b.lon')} ELSE {dist('b.lat,b.lon', 'a.lat,a.lon')} END <= 300"
GROUPS = """grp(node, label) USING KEY (node) AS (SELECT stop_id, stop_id FROM fx_stops UNION
  SELECT e.v, min(r.label) FROM grp r JOIN namesakes e ON e.u = r.node JOIN recurring.grp b ON b.node = e.v WHERE r.label < b.label GROUP BY e.v)"""


@query("SELECT node AS stop_id, label AS group_id FROM grp", {"namesakes": NAMESAKES})
def stop_groups(fx):
    return reach.grouped(fx.fx_stops).select("stop_id", "group_id")


ORACLES["stop_groups"] = ORACLES["stop_groups"].replace("\nSELECT node AS stop_id", f", {GROUPS}\nSELECT node AS stop_id")


# reach
def round_sql(rounds: int) -> dict[str, str]:
    """Named queries b0, b1, ...: best labels after each round."""
    out = {"access": ACCESS, "pairs": PAIRS, "foot": FOOT, "b0": f"SELECT stop_id, {T0} + sec AS t, 0 AS k FROM access WHERE m <= {NEAR_M}"}
    cap = T0 + 10800
    for k in range(1, rounds + 1):
        p = f"b{k - 1}"
        out[f"c{k}"] = f"SELECT e.trip_id, min(e.pos) AS pos FROM fx_ev e JOIN {p} b ON b.stop_id = e.stop_id WHERE b.k = {k - 1} AND e.flags & 1 = 0 AND e.dep_sec >= b.t + {0 if k == 1 else 60} AND e.dep_sec <= {cap} GROUP BY e.trip_id"
        out[f"r{k}"] = f"SELECT r.* FROM (SELECT e.stop_id, min(e.arr_sec) AS t FROM fx_ev e JOIN c{k} c ON c.trip_id = e.trip_id WHERE e.pos > c.pos AND e.flags & 2 = 0 AND e.arr_sec <= {cap} GROUP BY e.stop_id) r LEFT JOIN {p} b ON b.stop_id = r.stop_id WHERE b.t IS NULL OR r.t < b.t"
        out[f"n{k}"] = f"SELECT stop_id, min(t) AS t FROM (SELECT stop_id, t FROM r{k} UNION ALL SELECT f.v, r.t + f.sec FROM r{k} r JOIN foot f ON f.u = r.stop_id WHERE r.t + f.sec <= {cap}) GROUP BY stop_id"
        out[f"b{k}"] = f"SELECT coalesce(b.stop_id, n.stop_id) AS stop_id, least(b.t, n.t) AS t, CASE WHEN b.t IS NULL OR n.t < b.t THEN {k} ELSE b.k END AS k FROM {p} b FULL JOIN n{k} n ON n.stop_id = b.stop_id"
    return out


def _raptor(rounds: int):
    def run(fx):
        foot = proximity.both_ways(proximity.transfer_pairs(fx.fx_stops))
        return reach.raptor(fx.fx_ev, reach.access(fx.fx_stops, *A, NEAR_M), foot, T0, rounds)

    run.__name__ = f"raptor_r{rounds}"
    return query(f"SELECT stop_id, t AS arr_sec FROM b{rounds}", round_sql(rounds))(run)


for _k in range(1, 6):
    _raptor(_k)


@query("SELECT trip_id, route_id, route_type, stop_id, count(*) OVER (PARTITION BY trip_id) + 1 - pos AS pos, 172800 - dep_sec AS arr_sec, 172800 - arr_sec AS dep_sec, (flags >> 1) | ((flags & 1) << 1) AS flags FROM fx_ev")
def reverse_network(fx):
    return reach.reversed_network(fx.fx_ev)


GENERAL = """reach(node, t) USING KEY (node) AS (SELECT stop_id, sec FROM access UNION
  SELECT e.v, min(r.t + e.sec) FROM reach r JOIN edges e ON e.u = r.node LEFT JOIN recurring.reach b ON b.node = e.v
  WHERE r.t <= 10800 AND (b.t IS NULL OR r.t + e.sec < b.t) GROUP BY e.v)"""


@query("SELECT node AS stop_id, t AS sec FROM reach", {"steps": STEPS, "access": f"SELECT stop_id, sec FROM ({ACCESS}) WHERE m <= {NEAR_M}", "pairs": PAIRS, "foot": FOOT, "edges": "SELECT u, v, min(sec) AS sec FROM (SELECT stop_id AS u, next_stop AS v, greatest(ride, 0) AS sec FROM steps WHERE ride IS NOT NULL UNION ALL SELECT u, v, sec FROM foot) GROUP BY u, v"})
def general_reach(fx):
    foot = proximity.both_ways(proximity.transfer_pairs(fx.fx_stops))
    edges = ride_edges(fx).unionByName(foot).groupBy("u", "v").agg(F.min("sec").alias("sec"))
    seeds = reach.access(fx.fx_stops, *A, NEAR_M).select(F.col("stop_id").alias("node"), F.col("sec").alias("t"))
    return reach.shortest(seeds, edges, X.HORIZON_S, blocks=reach.plane_blocks(fx.fx_stops, "stop_id")).select(F.col("node").alias("stop_id"), F.col("t").alias("sec"))


ORACLES["general_reach"] = ORACLES["general_reach"].replace("\nSELECT node AS stop_id", f", {GENERAL}\nSELECT node AS stop_id")


# delays
HIST = "SELECT route_name, CASE dayofweek(ts) WHEN 6 THEN 1 WHEN 0 THEN 2 ELSE 0 END AS day_type, hour(ts) AS hour, count(*) AS n, CAST(sum(delay_sec) AS BIGINT) AS total, " + ", ".join(f"count(*) FILTER (WHERE {c}) AS b{i}" for i, c in enumerate(("delay_sec < -60", "delay_sec >= -60 AND delay_sec < 60", "delay_sec >= 60 AND delay_sec < 180", "delay_sec >= 180 AND delay_sec < 300", "delay_sec >= 300 AND delay_sec < 600", "delay_sec >= 600"))) + " FROM fx_delay_obs GROUP BY ALL"
P80 = "SELECT *, CASE WHEN b0 >= 0.8 * n THEN -60 WHEN b0 + b1 >= 0.8 * n THEN 60 WHEN b0 + b1 + b2 >= 0.8 * n THEN 180 WHEN b0 + b1 + b2 + b3 >= 0.8 * n THEN 300 WHEN b0 + b1 + b2 + b3 + b4 >= 0.8 * n THEN 600 ELSE 900 END AS p80 FROM hist"


def histogram(obs: DataFrame) -> DataFrame:
    bucket = X.delay_bucket(F.col("delay_sec"))
    keys = [F.col("route_name"), X.day_class(F.col("ts")).alias("day_type"), F.hour("ts").alias("hour")]
    return obs.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("delay_sec").alias("total"), *[F.count_if(bucket == i).alias(f"b{i}") for i in range(6)])


def percentile(hist: DataFrame) -> DataFrame:
    """The named edge of the first bucket up to which at least 80 % of observations lie."""
    upto, out = F.lit(0), None
    for i, named in enumerate(X.DELAY_NAMED[:-1]):
        upto = upto + F.col(f"b{i}")
        met = upto * 10 >= F.col("n") * 8
        out = F.when(met, named) if out is None else out.when(met, named)
    return hist.withColumn("p80", out.otherwise(X.DELAY_NAMED[-1]))


@query("SELECT * FROM hist", {"hist": HIST})
def delay_histogram(fx):
    return histogram(fx.fx_delay_obs)


@query("SELECT route_name, day_type, hour, p80 FROM p", {"hist": HIST, "p": P80})
def delay_p80(fx):
    return percentile(histogram(fx.fx_delay_obs)).select("route_name", "day_type", "hour", "p80")


@query("SELECT route_name, day_type, hour, p80 AS delay_sec FROM p WHERE n >= 20 AND p80 > 0", {"hist": HIST, "p": P80})
def delay_profile(fx):
    return percentile(histogram(fx.fx_delay_obs)).where("n >= 20 and p80 > 0").select("route_name", "day_type", "hour", F.col("p80").alias("delay_sec"))


# walk graph
ENDS = "SELECT u AS node FROM fx_walk_edges UNION ALL SELECT v FROM fx_walk_edges"


@query("SELECT node, count(*) AS degree FROM ends GROUP BY node", {"ends": ENDS})
def node_degree(fx):
    e = fx.fx_walk_edges
    return e.select(F.col("u").alias("node")).union(e.select("v")).groupBy("node").agg(F.count("*").alias("degree"))


@query("SELECT DISTINCT node FROM ends", {"ends": ENDS})
def used_nodes(fx):
    return fx.fx_walk_edges.select(F.col("u").alias("node")).union(fx.fx_walk_edges.select("v")).distinct()


@query("SELECT u, v, len_m FROM fx_walk_edges WHERE NOT (len_m < 25 AND (u IN (SELECT node FROM deg WHERE d = 1) OR v IN (SELECT node FROM deg WHERE d = 1)))", {"ends": ENDS, "deg": "SELECT node, count(*) AS d FROM ends GROUP BY node"})
def spur_prune(fx):
    e = fx.fx_walk_edges
    leaf = e.select(F.col("u").alias("node")).union(e.select("v")).groupBy("node").count().where("count = 1").select("node")
    e = e.join(leaf.select(F.col("node").alias("u"), F.lit(True).alias("lu")), "u", "left").join(leaf.select(F.col("node").alias("v"), F.lit(True).alias("lv")), "v", "left")
    return e.where((F.col("len_m") >= 25) | (F.col("lu").isNull() & F.col("lv").isNull())).select("u", "v", "len_m")


def adjacency(edges: DataFrame) -> DataFrame:
    sec = F.greatest(F.lit(1), X.js_round(F.col("len_m") / X.NET_WALK_MPS)).cast("long").alias("sec")
    return edges.select("u", "v", sec).union(edges.select("v", "u", sec))


ADJ = "SELECT u, v, greatest(1, CAST(floor(len_m / 1.25 + 0.5) AS BIGINT)) AS sec FROM fx_walk_edges UNION ALL SELECT v, u, greatest(1, CAST(floor(len_m / 1.25 + 0.5) AS BIGINT)) FROM fx_walk_edges"


@query("SELECT * FROM adj", {"adj": ADJ})
def walk_adjacency(fx):
    return adjacency(fx.fx_walk_edges)


WAVE = """wave(node, t) USING KEY (node) AS (SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT) UNION
  SELECT e.v, min(r.t + e.sec) FROM wave r JOIN adj e ON e.u = r.node LEFT JOIN recurring.wave b ON b.node = e.v
  WHERE r.t + e.sec <= 1800 AND (b.t IS NULL OR r.t + e.sec < b.t) GROUP BY e.v)"""


@query("SELECT node, t FROM wave", {"adj": ADJ})
def walk_times(fx):
    """Walking times of at most half an hour from node 0."""
    seed = fx.fx_walk_nodes.where("node_id = 0").select(F.col("node_id").alias("node"), F.lit(0).cast("long").alias("t"))
    return reach.shortest(seed, adjacency(fx.fx_walk_edges), 1800, blocks=reach.plane_blocks(fx.fx_walk_nodes, "node_id")).where("t <= 1800")


ORACLES["walk_times"] = ORACLES["walk_times"].replace("\nSELECT node, t FROM wave", f", {WAVE}\nSELECT node, t FROM wave")


# more aggregates and sets
@query("SELECT DISTINCT least(u, v) AS u, greatest(u, v) AS v FROM fx_walk_edges")
def canonical_edges(fx):
    return fx.fx_walk_edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


@query("SELECT count(*) AS edges, CAST(sum(len_m) AS BIGINT) AS metres FROM fx_walk_edges")
def network_totals(fx):
    return fx.fx_walk_edges.agg(F.count("*").alias("edges"), F.sum("len_m").cast("long").alias("metres"))


@query(f"SELECT e.trip_id FROM fx_ev e JOIN fx_stops s ON s.stop_id = e.stop_id GROUP BY e.trip_id HAVING bool_or(s.lat BETWEEN {GRID[0]} AND {GRID[2]} AND s.lon BETWEEN {GRID[1]} AND {GRID[3]})")
def trip_bbox_filter(fx):
    """Runs with any stop in the box, its edges included."""
    inside = F.col("lat").between(GRID[0], GRID[2]) & F.col("lon").between(GRID[1], GRID[3])
    return fx.fx_ev.join(fx.fx_stops.where(inside), "stop_id", "left_semi").select("trip_id").distinct()


@query("SELECT trip_id, bool_or(pos > 1 AND pos < n AND dep_sec > arr_sec) AS any_dwell, bool_or(flags <> 0) AS any_flag FROM (SELECT *, count(*) OVER (PARTITION BY trip_id) AS n FROM fx_ev) GROUP BY trip_id")
def dwell_flags_any(fx):
    # the first stop with a dwell behind the first stop lies before the last stop
    dwells = F.min(F.when((F.col("pos") > 1) & (F.col("dep_sec") > F.col("arr_sec")), F.col("pos")))
    return fx.fx_ev.groupBy("trip_id").agg(F.coalesce(dwells < F.max("pos"), F.lit(False)).alias("any_dwell"), F.bool_or(F.col("flags") != 0).alias("any_flag"))


@query("SELECT route_name, trip_ref, arg_min(delay_sec, event_id) AS delay_sec FROM fx_delay_obs GROUP BY ALL")
def obs_dedup_first(fx):
    return fx.fx_delay_obs.groupBy("route_name", "trip_ref").agg(F.min_by("delay_sec", "event_id").alias("delay_sec"))


@query("SELECT route_name, trip_ref, arg_max(delay_sec, event_id) AS delay_sec FROM fx_delay_obs GROUP BY ALL")
def obs_dedup_last(fx):
    return fx.fx_delay_obs.groupBy("route_name", "trip_ref").agg(F.max_by("delay_sec", "event_id").alias("delay_sec"))


CHOSEN = "SELECT coalesce(min(date) FILTER (WHERE dayofweek(date) BETWEEN 2 AND 4), min(date) FILTER (WHERE dayofweek(date) BETWEEN 1 AND 5)) AS workday, min(date) FILTER (WHERE dayofweek(date) = 6) AS saturday, min(date) FILTER (WHERE dayofweek(date) = 0) AS sunday FROM usable"


def chosen_days(dates: DataFrame) -> DataFrame:
    """(workday, saturday, sunday): the first date of each kind, a workday from Tuesday to Thursday if there is one; null where there is none."""
    first = lambda of: F.min(F.when(of, F.col("date")))
    day = X.weekday(F.col("date"))
    return dates.agg(F.coalesce(first(day.between(2, 4)), first(day.between(1, 5))).alias("workday"), first(day == 6).alias("saturday"), first(day == 0).alias("sunday"))


@query(CHOSEN, ALL_DAYS)
def representative_days(fx):
    return chosen_days(usable_dates(staged_counts(fx, None)))


ACCESS_B = ACCESS.replace(str(A[0]), str(B[0])).replace(str(A[1]), str(B[1]))


def tagged(rounds: dict[str, str], tag: str, swap: dict[str, str] | None = None) -> dict[str, str]:
    """The round queries with ``tag`` before their names, and names in ``swap`` exchanged."""
    import re

    out = {}
    for name, text in rounds.items():
        if re.fullmatch(r"[bcrn]\d", name):
            for old, new in (swap or {}).items():
                text = re.sub(rf"\b{old}\b", new, text)
            text = re.sub(r"\b([bcrn]\d)\b(?! AS)", rf"{tag}\1", text)
            name = tag + name
        out[name] = text
    return out


@query("SELECT stop_id, greatest(a.t, b.t) AS arr_sec FROM b2 a JOIN o_b2 b USING (stop_id)", {"access": ACCESS, "access_b": ACCESS_B, **round_sql(2), **tagged(round_sql(2), "o_", {"access": "access_b"})})
def compare_max(fx):
    """The later of two searches' arrivals; a stop that either doesn't reach is left out."""
    foot = proximity.both_ways(proximity.transfer_pairs(fx.fx_stops))
    a, b = (reach.raptor(fx.fx_ev, reach.access(fx.fx_stops, *at, NEAR_M), foot, T0, 2).select("stop_id", F.col("arr_sec").alias(n)) for at, n in ((A, "a"), (B, "b")))
    return a.join(b, "stop_id").select("stop_id", F.greatest("a", "b").alias("arr_sec"))


@query("SELECT 0 AS origin, stop_id, t AS arr_sec FROM b2 UNION ALL SELECT 1, stop_id, t FROM o_b2", {"access": ACCESS, "access_b": ACCESS_B, **round_sql(2), **tagged(round_sql(2), "o_", {"access": "access_b"})})
def raptor_origins(fx):
    """Several origins searched side by side, in the same rounds."""
    foot = proximity.both_ways(proximity.transfer_pairs(fx.fx_stops))
    near = [reach.access(fx.fx_stops, *at, NEAR_M).withColumn("origin", F.lit(i)) for i, at in enumerate((A, B))]
    return reach.raptor(fx.fx_ev, near[0].unionByName(near[1]), foot, T0, 2, "origins", by=("origin",))


@query(f"SELECT count(*) FILTER (WHERE t - {T0} <= 5400) AS reachable FROM b2", round_sql(2))
def reachable_count(fx):
    return QUERIES["raptor_r2"](fx.spark, fx.sf_dir).agg(F.count_if(F.col("arr_sec") - T0 <= 5400).alias("reachable"))


PARTS = """parts(node, label) USING KEY (node) AS (SELECT node_id, node_id FROM fx_walk_nodes UNION
  SELECT e.v, min(r.label) FROM parts r JOIN adj e ON e.u = r.node JOIN recurring.parts b ON b.node = e.v WHERE r.label < b.label GROUP BY e.v)"""


@query("SELECT label, nodes FROM (SELECT label, count(*) AS nodes FROM parts JOIN fx_walk_nodes ON node_id = node GROUP BY label) ORDER BY nodes DESC, label LIMIT 1", {"adj": ADJ})
def main_component(fx):
    """The walking network's largest component by its least node (the least one of equals)."""
    found = reach.least_member(fx.fx_walk_nodes.select(F.col("node_id").alias("node")), fx.fx_walk_edges.select("u", "v"))
    return found.groupBy("label").agg(F.count("*").alias("nodes")).orderBy(F.desc("nodes"), "label").limit(1)


ORACLES["main_component"] = ORACLES["main_component"].replace("\nSELECT label, nodes", f", {PARTS}\nSELECT label, nodes")
