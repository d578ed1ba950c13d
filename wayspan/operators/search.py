"""Searches that keep more than times: the cautious one and the one with legs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr as X
from ..plans.stages import staged
from .reach import reversed_network, shortest, windowed


def patterns(ev: DataFrame) -> DataFrame:
    """(trip_id, pattern): runs of one route, stop sequence and flag sequence share a pattern."""
    seq = F.array_sort(F.collect_list(F.struct("pos", "stop_id", "flags")))
    return ev.groupBy("trip_id").agg(F.first("route_id").alias("route_id"), seq.alias("seq")).select("trip_id", F.struct("route_id", "seq").alias("pattern"))


def cautious(ev: DataFrame, access: DataFrame, foot: DataFrame, t0: int, rounds: int, delay: DataFrame | None = None) -> DataFrame:
    """(stop_id, arr_sec): arrivals that allow for delays and take four minutes to change.

    A pattern's held run at a position is the earliest scheduled one there among those
    caught before it; its delay is added after that: ``delay`` (route_id, hour,
    delay_sec) where known, else a share of the time on board by vehicle.
    """
    cap, wait = t0 + X.HORIZON_S, X.CAUTIOUS_TRANSFER_S
    named = staged(ev.join(patterns(ev), "trip_id").withColumn("pattern", F.sha2(F.to_json("pattern"), 256)), "patterns")
    foot = foot.withColumn("sec", F.greatest("sec", F.lit(wait)).cast("long"))
    best = staged(access.select("stop_id", (F.lit(t0) + F.col("sec")).cast("long").alias("t"), F.lit(0).alias("round")), "cautious")
    for k in range(1, rounds + 1):
        front = best.where(F.col("round") == k - 1).select("stop_id", "t")
        board = named.join(front, "stop_id").where((F.col("flags").bitwiseAND(1) == 0) & (F.col("dep_sec") >= F.col("t") + (0 if k == 1 else wait)) & (F.col("dep_sec") <= cap))
        board = board.groupBy("trip_id").agg(F.min(F.struct("pos", "dep_sec")).alias("on")).select("trip_id", F.col("on.pos").alias("on_pos"), F.col("on.dep_sec").alias("on_dep"))
        ride = named.join(board, "trip_id").where("pos > on_pos")
        held = F.min_by(F.struct("stop_id", "route_id", "route_type", "flags", "arr_sec", "on_dep"), F.struct("dep_sec", "on_pos", "trip_id"))
        ride = ride.groupBy("pattern", "pos").agg(held.alias("h")).select("h.*").where(F.col("flags").bitwiseAND(2) == 0)
        ride, late = late_of(ride, F.col("on_dep"), delay)
        ride = ride.select("stop_id", (F.col("arr_sec") + late).cast("long").alias("a")).where(F.col("a") <= cap).groupBy("stop_id").agg(F.min("a").alias("a"))
        ride = ride.join(best.select("stop_id", "t"), "stop_id", "left").where("t is null or a < t").select("stop_id", F.col("a").alias("t"))
        walk = ride.join(foot, ride["stop_id"] == foot["u"]).select(F.col("v").alias("stop_id"), (F.col("t") + F.col("sec")).alias("t")).where(F.col("t") <= cap)
        new = ride.unionByName(walk).groupBy("stop_id").agg(F.min("t").alias("new"))
        best = best.join(new, "stop_id", "full").select("stop_id", F.least("t", "new").alias("t"), F.when(F.col("t").isNull() | (F.col("new") < F.col("t")), k).otherwise(F.col("round")).alias("round"))
        best = staged(best, "cautious")
    return best.select("stop_id", F.col("t").alias("arr_sec"))


def late_of(rows: DataFrame, on_dep: Column, delay: DataFrame | None) -> tuple[DataFrame, Column]:
    """Rows (route_id, route_type, arr_sec, ...) and by how much they come late: the known delay of their route and hour, else a share of the time on board by vehicle."""
    late = X.js_round((F.col("arr_sec") - on_dep) * (X.ride_factor(F.col("route_type")).cast("double") - F.lit(1.0)))
    if delay is None:
        return rows, late
    rows = rows.withColumn("hour", F.floor(on_dep / 3600) % 24).join(delay, ["route_id", "hour"], "left")
    return rows, F.coalesce(F.col("delay_sec").cast("long"), late)


def journeys(ev: DataFrame, access: DataFrame, foot: DataFrame, t0: int, rounds: int, safe: bool = False, delay: DataFrame | None = None) -> DataFrame:
    """(target, leg, kind, from_stop, to_stop, trip_id, dep_sec, arr_sec): the legs to every stop reached.

    Labels carry their round and parent, so that a journey never mixes rounds. The first leg
    is the walk from the origin (``from_stop`` null). Legs are followed back by joins, at
    most two a round. With ``safe`` they are those of the cautious search: a ride's ``arr_sec`` has its delay.
    """
    cap = t0 + X.HORIZON_S
    wait = X.CAUTIOUS_TRANSFER_S if safe else X.MIN_TRANSFER_S
    if safe:
        ev = staged(ev.join(patterns(ev), "trip_id").withColumn("pattern", F.sha2(F.to_json("pattern"), 256)), "patterns")
        foot = foot.withColumn("sec", F.greatest("sec", F.lit(wait)).cast("long"))
    else:
        ev = windowed(ev, t0, cap, "journeys")
    none, long = F.lit(None).cast("long"), lambda c: c.cast("long")
    first = access.select("stop_id", long(F.lit(t0) + F.col("sec")).alias("t"), F.lit(0).alias("round"), F.lit("access").alias("kind"), none.alias("from_stop"), none.alias("trip_id"), long(F.lit(t0)).alias("dep_sec"), F.lit(-1).alias("from_round"), F.lit("").alias("from_kind"))
    best = labels = staged(first, "journeys")
    cols = first.columns
    for k in range(1, rounds + 1):
        front = best.where(F.col("round") == k - 1).select("stop_id", "t", "kind")
        board = ev.join(front, "stop_id").where((F.col("flags").bitwiseAND(1) == 0) & (F.col("dep_sec") >= F.col("t") + (0 if k == 1 else wait)) & (F.col("dep_sec") <= cap))
        board = board.groupBy("trip_id").agg(F.min(F.struct("pos", "dep_sec", "stop_id", "kind")).alias("on"))
        ride, late = ev.join(board, "trip_id").where(F.col("pos") > F.col("on.pos")), F.lit(0)
        if safe:  # of a pattern only the run that is held comes through
            held = F.min_by(F.struct("stop_id", "route_id", "route_type", "flags", "arr_sec", "trip_id", "on"), F.struct("dep_sec", "on.pos", "trip_id"))
            ride, late = late_of(ride.groupBy("pattern", "pos").agg(held.alias("h")).select("h.*"), F.col("on.dep_sec"), delay)
        ride = ride.select("stop_id", "flags", long(F.col("arr_sec") + late).alias("t"), "trip_id", "on").where((F.col("flags").bitwiseAND(2) == 0) & (F.col("t") <= cap))
        ride = ride.groupBy("stop_id").agg(F.min(F.struct("t", "trip_id", "on")).alias("o"))
        ride = ride.join(best.select("stop_id", F.col("t").alias("had")), "stop_id", "left").where("had is null or o.t < had")
        ride = staged(ride.select("stop_id", "o.t", F.lit(k).alias("round"), F.lit("ride").alias("kind"), long(F.col("o.on.stop_id")).alias("from_stop"), long(F.col("o.trip_id")).alias("trip_id"), long(F.col("o.on.dep_sec")).alias("dep_sec"), F.lit(k - 1).alias("from_round"), F.col("o.on.kind").alias("from_kind")), "rides")
        walk = ride.select(F.col("stop_id").alias("u"), F.col("t").alias("dep_sec")).join(foot, "u").withColumn("t", F.col("dep_sec") + F.col("sec")).where(F.col("t") <= cap)
        walk = walk.groupBy(F.col("v").alias("stop_id")).agg(F.min(F.struct("t", "u", "dep_sec")).alias("o"))
        walk = walk.select("stop_id", "o.t", F.lit(k).alias("round"), F.lit("walk").alias("kind"), long(F.col("o.u")).alias("from_stop"), none.alias("trip_id"), "o.dep_sec", F.lit(k).alias("from_round"), F.lit("ride").alias("from_kind"))
        new = staged(ride.unionByName(walk), "steps")
        labels = labels.unionByName(new)
        rank = F.struct("t", "round", "kind")
        best = staged(best.unionByName(new).groupBy("stop_id").agg(F.min_by(F.struct(*[c for c in cols if c != "stop_id"]), rank).alias("o")).select("stop_id", "o.*"), "journeys")
    at = best.select(F.col("stop_id").alias("target"), F.lit(0).alias("back"), *cols)
    legs = []
    for i in range(2 * rounds + 1):
        at = staged(at, "legs")
        legs.append(at)
        step = at.where("from_round >= 0").select("target", (F.col("back") + 1).alias("back"), F.col("from_stop").alias("stop_id"), F.col("from_round").alias("round"), F.col("from_kind").alias("kind"))
        at = step.join(labels, ["stop_id", "round", "kind"]).select("target", "back", *cols)
    found = legs[0]
    for leg in legs[1:]:
        found = found.unionByName(leg)
    last = found.groupBy("target").agg(F.max("back").alias("n"))
    return found.join(last, "target").select("target", (F.col("n") - F.col("back") + 1).alias("leg"), "kind", "from_stop", F.col("stop_id").alias("to_stop"), "trip_id", "dep_sec", F.col("t").alias("arr_sec"))


def journeys_to(ev: DataFrame, access: DataFrame, foot: DataFrame, arrive: int, rounds: int) -> DataFrame:
    """(source, leg, kind, from_stop, to_stop, trip_id, dep_sec, arr_sec): the legs from every stop to the place of ``access`` by ``arrive``, leaving as late as can be.

    The search runs backwards; its legs are turned round, with times and order of the day. The last leg is
    the walk to the place (``to_stop`` null).
    """
    back = journeys(reversed_network(ev), access, foot, X.REVERSE_C - arrive, rounds)
    n = back.groupBy("target").agg(F.max("leg").alias("n"))
    turned = lambda c: (F.lit(X.REVERSE_C) - F.col(c)).cast("long")
    return back.join(n, "target").select(F.col("target").alias("source"), (F.col("n") - F.col("leg") + 1).alias("leg"), "kind", F.col("to_stop").alias("from_stop"), F.col("from_stop").alias("to_stop"), "trip_id", turned("arr_sec").alias("dep_sec"), turned("dep_sec").alias("arr_sec"))


#: Legs of a journey without waiting that are followed at most.
MOST_LEGS = 100


def general_edges(ev: DataFrame, foot: DataFrame) -> DataFrame:
    """(u, v, sec, kind, route_id): the shortest ride between neighbouring stops (least route of equals) or walk; a ride before an equal walk."""
    along = Window.partitionBy("trip_id").orderBy("pos")
    hop = ev.select(F.col("stop_id").alias("u"), F.lead("stop_id").over(along).alias("v"), (F.lead("arr_sec").over(along) - F.col("dep_sec")).alias("ride"), "route_id").where("ride is not null")
    ride = hop.select("u", "v", F.struct(F.greatest("ride", F.lit(0)).cast("long").alias("sec"), F.lit("ride").alias("kind"), F.col("route_id").cast("long").alias("route_id")).alias("e"))
    walk = foot.select("u", "v", F.struct(F.col("sec").cast("long").alias("sec"), F.lit("walk").alias("kind"), F.lit(None).cast("long").alias("route_id")).alias("e"))
    return ride.unionByName(walk).groupBy("u", "v").agg(F.min("e").alias("e")).select("u", "v", "e.*")


def general_journeys(ev: DataFrame, seeds: DataFrame, foot: DataFrame) -> DataFrame:
    """(target, leg, kind, from_stop, to_stop, route_id, sec): legs without waiting from the seeds (node, t) to every stop.

    A stop's parent is the least one over which its least time comes; seeds that nothing
    improves have the walk from the origin (`access`). Legs are followed back one join at a time; then
    neighbouring rides of one route, and neighbouring walks, are drawn together as islands.
    """
    edges = staged(general_edges(ev, foot), "general-edges")
    times = staged(shortest(seeds, edges, X.HORIZON_S, "general"), "general-times")
    first = seeds.groupBy("node").agg(F.min("t").alias("seed"))
    come = edges.join(times.select(F.col("node").alias("u"), F.col("t").alias("t_u")).where(F.col("t_u") <= X.HORIZON_S), "u").join(times.select(F.col("node").alias("v"), "t"), "v").where(F.col("t_u") + F.col("sec") == F.col("t"))
    # rides that take no time may run in circles: a parent lies earlier, or as early and nearer to where the time came from
    parent = come.where("sec > 0 or u < v").groupBy(F.col("v").alias("node")).agg(F.min(F.struct("kind", "u", "route_id", "sec")).alias("p"))
    step = times.join(first, "node", "left").join(parent, "node", "left")
    own = F.col("seed") == F.col("t")
    step = step.where(own | F.col("p").isNotNull()).select(
        "node", F.when(own, "access").otherwise(F.col("p.kind")).alias("kind"), F.when(~own | F.col("seed").isNull(), F.col("p.u")).alias("from_stop"), F.when(~own | F.col("seed").isNull(), F.col("p.route_id")).alias("route_id"), F.when(own, F.col("t")).otherwise(F.col("p.sec")).alias("sec"),
    )
    step = staged(step, "general-steps")
    at, found = step.select(F.col("node").alias("target"), F.lit(0).alias("back"), *step.columns), None
    for _ in range(MOST_LEGS):
        at = staged(at, "general-legs")
        if at.isEmpty():
            break
        found = at if found is None else found.unionByName(at)
        go = at.where("from_stop is not null").select("target", (F.col("back") + 1).alias("back"), F.col("from_stop").alias("node"))
        at = go.join(step.hint("merge"), "node").select("target", "back", *step.columns)  # as in `along`
    # only whole journeys: those that come to a walk from the origin
    whole = found.where("kind = 'access'").select("target")
    legs = found.join(whole, "target", "left_semi")
    on = Window.partitionBy("target").orderBy(F.desc("back"))
    changed = (F.col("kind") != F.lag("kind").over(on)) | ~F.col("route_id").eqNullSafe(F.lag("route_id").over(on))
    legs = legs.withColumn("new", F.coalesce(changed, F.lit(True)).cast("int")).withColumn("leg", F.sum("new").over(on.rowsBetween(Window.unboundedPreceding, 0)))
    far = F.struct("back", F.col("from_stop").alias("from_stop"))
    merged = legs.groupBy("target", "leg").agg(F.first("kind").alias("kind"), F.max(far).alias("a"), F.min(F.struct("back", "node")).alias("b"), F.first("route_id").alias("route_id"), F.sum("sec").alias("sec"))
    return merged.select("target", F.col("leg").cast("int").alias("leg"), "kind", F.col("a.from_stop").alias("from_stop"), F.col("b.node").alias("to_stop"), "route_id", "sec")


def contract(edges: DataFrame) -> DataFrame:
    """(u, v, len_m): streets between junctions, chains of two-edge nodes between them drawn together.

    Every edge is walked both ways; a walk into a two-edge node goes on to that node's other
    edge. Pointers double each round, so a chain takes log2 of its length; circles without
    a junction never end and are left out.
    """
    e = staged(edges.select("u", "v", F.col("len_m").cast("long").alias("len_m"), F.xxhash64("u", "v").alias("e")).dropDuplicates(["u", "v"]), "edges")
    half = e.select("u", "v", "e", "len_m", F.lit(0).alias("d")).unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"), "e", "len_m", F.lit(1).alias("d")))
    pass_by = half.groupBy("u").agg(F.count("*").alias("deg")).where("deg = 2").select("u")
    out = half.join(pass_by, "u").select(F.col("u").alias("v"), F.struct("e", "d").alias("next"), F.col("e").alias("next_e"))
    h = half.join(out, "v", "left").where("next_e is null or next_e <> e")
    h = h.select(F.struct("e", "d").alias("id"), F.col("u").alias("start"), F.col("v").alias("end"), F.struct("e", "d").alias("last"), "len_m", "next")
    h = staged(h, "halves")
    # a street of one name twice (u, v, u) keeps its two edges: e tells them apart
    while not h.where("next is not null and next <> id").isEmpty():
        far = h.select(F.col("id").alias("next"), F.col("end").alias("f_end"), F.col("last").alias("f_last"), F.col("len_m").alias("f_len"), F.col("next").alias("f_next"))
        j = h.join(far, "next", "left")
        on = F.col("f_last").isNotNull()
        new = staged(j.select("id", "start", F.when(on, F.col("f_end")).otherwise(F.col("end")).alias("end"), F.when(on, F.col("f_last")).otherwise(F.col("last")).alias("last"), (F.col("len_m") + F.coalesce("f_len", F.lit(0))).alias("len_m"), F.when(on, F.col("f_next")).alias("next")), "halves")
        # circles keep their pointers for ever: the work ends when no open walk moved
        if new.where("next is not null").count() == h.where("next is not null").count():
            break
        h = new
    ends = h.where("next is null").join(pass_by.select(F.col("u").alias("start")), "start", "left_anti")
    back = F.struct(F.col("end"), F.col("last.e").alias("e"), (1 - F.col("last.d")).alias("d"))
    return ends.where(F.struct(F.col("start"), F.col("id.e").alias("e"), F.col("id.d").alias("d")) <= back).select(F.least("start", "end").alias("u"), F.greatest("start", "end").alias("v"), "len_m")
