"""A timetable as patterns, profiles and starts, and the next run by a sorted merge.

Runs of one route, stop sequence and flags share a pattern; runs of a pattern with the same
times from their start share a profile; a run is then its profile and start. Dictionaries
are named by their least run, so that the names don't hang on how the work was dealt.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.stages import staged


def by_run(ev: DataFrame) -> DataFrame:
    """(trip_id, route_id, route_type, stops, flags, deps, arrs): a row a run, its stops in order."""
    one = F.array_sort(F.collect_list(F.struct("pos", "stop_id", "flags", "dep_sec", "arr_sec")))
    runs = ev.groupBy("trip_id").agg(F.first("route_id").alias("route_id"), F.first("route_type").alias("route_type"), one.alias("seq"))
    part = lambda c: F.transform("seq", lambda s: s[c].cast("long"))
    return runs.select("trip_id", "route_id", "route_type", part("stop_id").alias("stops"), part("flags").alias("flags"), part("dep_sec").alias("deps"), part("arr_sec").alias("arrs"))


def running(steps: Column) -> Column:
    """0 and the running sums of an array."""
    zero = F.array(F.lit(0).cast("long"))
    return F.aggregate(steps, zero, lambda sums, s: F.concat(sums, F.array(F.element_at(sums, -1) + s)))


@dataclass(frozen=True)
class Coded:
    """``patterns`` (pattern, route_id, route_type, stops, flags), ``profiles`` (profile, pattern, deltas, dwells),
    ``runs`` (trip_id, profile, start, and whatever columns a run carries).

    Flags of a pattern and dwells of a profile are null where all are 0. A run's departures are its
    start and the running sums of ``deltas``; its arrivals lie ``dwells`` before them.
    """

    patterns: DataFrame
    profiles: DataFrame
    runs: DataFrame

    def write(self, folder: str, by: list[str]) -> None:
        """The dictionaries once, the runs in a folder a value of ``by``, spread over as many tasks as their size asks for."""
        self.patterns.write.parquet(f"{folder}/patterns")
        self.profiles.write.parquet(f"{folder}/profiles")
        runs = self.runs.hint("rebalance", *by) if by else self.runs
        runs.sortWithinPartitions(*by, "profile", "start").write.partitionBy(*by).parquet(f"{folder}/runs")

    @staticmethod
    def read(spark, folder: str) -> Coded:
        return Coded(*(spark.read.parquet(f"{folder}/{part}") for part in ("patterns", "profiles", "runs")))

    def where(self, of: Column) -> Coded:
        return Coded(self.patterns, self.profiles, self.runs.where(of))

    def hops(self) -> DataFrame:
        """A row a run and stop: (trip_id, pattern, route_id, route_type, pos, stop_id, flags, arr_sec, dep_sec)."""
        zeros = F.array_repeat(F.lit(0).cast("long"), F.size("stops"))
        dictionary = self.profiles.join(self.patterns, "pattern").select("profile", "pattern", "route_id", "route_type", "stops", F.coalesce("flags", zeros).alias("flags"), running(F.col("deltas")).alias("off"), F.coalesce("dwells", zeros).alias("dwells"))
        whole = dictionary.select("profile", "pattern", "route_id", "route_type", F.arrays_zip("stops", "flags", "off", "dwells").alias("hops"))
        rows = self.runs.join(whole, "profile").select("trip_id", "pattern", "route_id", "route_type", "start", F.posexplode("hops").alias("i", "h"))
        at = F.col("start") + F.col("h.off")
        return rows.select("trip_id", "pattern", "route_id", "route_type", (F.col("i") + 1).cast("long").alias("pos"), F.col("h.stops").alias("stop_id"), F.col("h.flags").alias("flags"), (at - F.col("h.dwells")).alias("arr_sec"), at.alias("dep_sec"))

    def events(self) -> DataFrame:
        """The rows that were coded: (trip_id, route_id, route_type, stop_id, arr_sec, dep_sec, flags, pos)."""
        return self.hops().select("trip_id", "route_id", "route_type", "stop_id", "arr_sec", "dep_sec", "flags", "pos")

    def size(self) -> DataFrame:
        """(patterns, profiles, runs, coded, plain): rows of each part, and the numbers that they hold, coded and as plain rows of six."""
        long = lambda c: F.coalesce(F.size(c), F.lit(0))
        none = lambda c: F.when(F.col(c).isNull(), 0).otherwise(long(c))
        stops = self.patterns.agg(F.count("*").alias("patterns"), F.sum(2 + long("stops") + none("flags")).alias("in_patterns"))
        times = self.profiles.agg(F.count("*").alias("profiles"), F.sum(1 + long("deltas") + none("dwells")).alias("in_profiles"))
        length = self.profiles.select("profile", (long("deltas") + 1).alias("n"))
        runs = self.runs.join(length, "profile").agg(F.count("*").alias("runs"), F.sum("n").alias("rows"))
        one = stops.join(F.broadcast(times)).join(F.broadcast(runs))  # a row each
        coded = F.coalesce("in_patterns", F.lit(0)) + F.coalesce("in_profiles", F.lit(0)) + 3 * F.col("runs")
        return one.select("patterns", "profiles", "runs", coded.alias("coded"), (6 * F.coalesce("rows", F.lit(0))).alias("plain"))


def encoded(ev: DataFrame, runs: DataFrame | None = None, name: str = "timetable") -> Coded:
    """The timetable's dictionaries and its runs; ``runs`` (trip_id, ...) may carry a run several times, by day say, and only runs that it carries are coded.

    Every run is kept, whatever its length or times: what is decoded equals what was coded, positions
    counted from 1. Joins are on whole sequences and on names; a pattern that a third of all runs
    share is drawn together map-side and never gathered.
    """
    if runs is not None:
        runs = staged(runs, f"{name}-carried")
        ev = ev.join(runs, "trip_id", "left_semi")
    deps = F.col("deps")
    deltas = F.transform(F.sequence(F.lit(2), F.size("deps")), lambda i: F.element_at(deps, i) - F.element_at(deps, i - 1))
    seq = by_run(ev).select("trip_id", "route_id", "route_type", "stops", "flags", deps[0].alias("start"), F.when(F.size("deps") > 1, deltas).otherwise(F.array().cast("array<long>")).alias("deltas"), F.zip_with("deps", "arrs", lambda d, a: d - a).alias("dwells"))
    seq = staged(seq, f"{name}-runs")
    shape, times = ["route_id", "route_type", "stops", "flags"], ["deltas", "dwells"]
    patterns = staged(seq.groupBy(*shape).agg(F.min("trip_id").alias("pattern")), f"{name}-patterns")
    named = seq.join(patterns, shape).select("trip_id", "pattern", "start", *times)
    profiles = staged(named.groupBy("pattern", *times).agg(F.min("trip_id").alias("profile")), f"{name}-profiles")
    coded = named.join(profiles, ["pattern", *times]).select("trip_id", "profile", "start")
    if runs is not None:
        coded = coded.join(runs, "trip_id")
    none = lambda c: F.when(F.exists(c, lambda x: x != 0), F.col(c)).alias(c)
    return Coded(patterns.select("pattern", "route_id", "route_type", "stops", none("flags")), profiles.select("profile", "pattern", "deltas", none("dwells")), coded)


def next_of(asked: DataFrame, there: DataFrame, on: list[str], at: str, value: Column, out: str, span: int | None = None) -> DataFrame:
    """``asked`` with the ``value`` of the row of ``there`` that comes next at or after it (of equals the least); null where none does.

    A forward as-of join by one sorted merge: both sides go to their key once, lie there from
    late to early, and each ask takes what was seen last. With ``span`` a key is cut into stretches of ``at``, each
    merged by itself, so that a key with very many rows is many tasks' work; an ask that finds nothing in its
    stretch takes the first row of the next one that has any, by the same merge over stretches.
    """
    if span is not None:
        cut = lambda df: df.withColumn("__part", F.floor(F.col(at) / span))
        asks, rows = cut(asked), cut(there)
        own = next_of(asks, rows, [*on, "__part"], at, value, "__own")
        first = rows.groupBy(*on, "__part").agg(F.min(F.struct(F.col(at).alias("at"), value.alias("v"))).alias("first"))
        parts = asks.select(*on, (F.col("__part") + 1).alias("__next")).distinct()
        later = next_of(parts, first.withColumnRenamed("__part", "__next"), on, "__next", F.col("first.v"), "__later")
        later = later.withColumn("__part", F.col("__next") - 1).drop("__next")
        found = own.join(later, [*on, "__part"])
        return found.select(*on, *[c for c in asked.columns if c not in on], F.coalesce("__own", "__later").alias(out))
    kept = [c for c in asked.columns if c not in on]
    side = lambda df, ask, v: df.select(*on, F.col(at).alias("__at"), F.lit(ask).alias("__ask"), v.alias("__value"), F.struct(*kept).alias("__row") if ask else F.lit(None).alias("__row"))
    both = side(asked, True, F.lit(None)).unionByName(side(there, False, value))
    late_first = Window.partitionBy(*on).orderBy(F.desc("__at"), "__ask", F.desc("__value")).rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn(out, F.last("__value", ignorenulls=True).over(late_first))
    return seen.where("__ask").select(*on, "__row.*", out)


def shapes(ev: DataFrame, t0: int, cap: int, name: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """For a search from ``t0`` to ``cap``, staged: ``rides`` (profile, hops), ``boards`` (stop_id, profile, pos, off), ``starts`` (profile, start).

    Runs of the same stops, flags and times from the start are one profile. Of such runs the earliest is
    the best at every stop, whatever runs of other profiles overtake it.
    """
    runs = by_run(ev.select("trip_id", F.lit(0).alias("route_id"), F.lit(0).alias("route_type"), "stop_id", "pos", "arr_sec", "dep_sec", "flags"))
    runs = runs.where((F.array_max("deps") >= t0) & (F.array_min("arrs") <= cap))
    runs = runs.withColumn("start", F.col("deps")[0])
    off = lambda c: F.transform(c, lambda s: s - F.col("start"))
    runs = runs.select("stops", "flags", off("deps").alias("dep_offs"), off("arrs").alias("arr_offs"), "start")
    # a profile has as many distinct starts as two days have seconds, at most
    profiles = runs.groupBy("stops", "flags", "dep_offs", "arr_offs").agg(F.collect_set("start").alias("starts"))
    hops = F.arrays_zip(F.col("stops").alias("stop_id"), F.col("flags").alias("flags"), F.col("dep_offs").alias("dep"), F.col("arr_offs").alias("arr"))
    rides = staged(profiles.select(F.monotonically_increasing_id().alias("profile"), hops.alias("hops"), "starts"), f"{name}-rides")
    hop = rides.select("profile", F.posexplode("hops").alias("pos", "h"))
    boards = hop.where(F.col("h.flags").bitwiseAND(1) == 0).select(F.col("h.stop_id").alias("stop_id"), "profile", "pos", F.col("h.dep").alias("off"))
    return rides.select("profile", "hops"), staged(boards, f"{name}-boards"), staged(rides.select("profile", F.explode("starts").alias("start")), f"{name}-starts")


def ridden(front: DataFrame, rides: DataFrame, boards: DataFrame, starts: DataFrame, wait: int, cap: int, by: list[str]) -> DataFrame:
    """(by, stop_id, a): one round's least arrivals over the runs that are caught from ``front`` (by, stop_id, t).

    Each profile that passes a stop of the front is asked once a position for its next run; along its stops the
    earliest run caught so far is held.
    """
    asks = front.join(boards, "stop_id").select(*by, "profile", "pos", "off", (F.col("t") + wait - F.col("off")).alias("start"))
    caught = next_of(asks, starts, ["profile"], "start", F.col("start"), "run").where(F.col("run") + F.col("off") <= cap)
    held = caught.groupBy(*by, "profile").agg(F.collect_list(F.struct("pos", "run")).alias("on"))  # as many as the profile has stops
    run = lambda i: F.array_min(F.transform(F.filter("on", lambda c: c["pos"] < i), lambda c: c["run"]))
    stops = F.transform("hops", lambda h, i: F.struct(h["stop_id"].alias("stop_id"), h["flags"].alias("flags"), (h["arr"] + run(i)).alias("a")))
    rows = held.join(rides, "profile").select(*by, F.inline(stops))
    return rows.where((F.col("flags").bitwiseAND(2) == 0) & (F.col("a") <= cap)).groupBy(*by, "stop_id").agg(F.min("a").alias("a"))
