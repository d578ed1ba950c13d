"""Patterns and profiles, boarding by a sorted merge, rounds over profiles, clusters of stops."""

import random

from pyspark.sql import functions as F

from wayspan.operators import proximity, reach
from wayspan.operators.timetable import Coded, encoded, next_of

EV = "trip_id long, route_id long, route_type long, stop_id long, arr_sec long, dep_sec long, flags long, pos long"
COLS = ["trip_id", "route_id", "route_type", "stop_id", "arr_sec", "dep_sec", "flags", "pos"]


def made(seed, trips=120, stops=9):
    """Runs over few stop sequences: loops, stops without getting on or off, dwells, one stop only, times that fall back, runs that overtake."""
    rng = random.Random(seed)
    lines = [[rng.randrange(stops) for _ in range(rng.randint(1, 6))] for _ in range(5)]
    rows = []
    for trip in range(trips):
        line = rng.randrange(5)
        t, hop, dwell = 60 * rng.randint(0, 150), rng.choice((60, 90, 200)), rng.choice((0, 0, 30))
        for i, stop in enumerate(lines[line]):
            arr = t + i * hop - (500 if trip % 40 == 7 and i == 2 else 0)
            rows.append((trip, line, 3, stop, arr, arr + dwell * (i % 2), 1 if (line, i) == (1, 0) else 2 if i == 3 else 0, i + 1))
    return rows


def test_round_trip(spark, tmp_path):
    rows = made(1)
    coded = encoded(spark.createDataFrame(rows, EV))
    coded.write(f"{tmp_path}/t", [])
    back = Coded.read(spark, f"{tmp_path}/t")
    assert sorted(map(tuple, back.events().select(COLS).collect())) == sorted(rows)
    runs = {}
    for r in sorted(rows, key=lambda r: (r[0], r[7])):
        runs.setdefault(r[0], []).append(r)
    patterns = {(x[0][1], tuple((r[3], r[6]) for r in x)) for x in runs.values()}
    profiles = {(x[0][1], tuple((r[3], r[6], r[4] - x[0][5], r[5] - x[0][5]) for r in x)) for x in runs.values()}
    size = back.size().first()
    assert (size.patterns, size.profiles, size.runs) == (len(patterns), len(profiles), len(runs)) and size.coded < size.plain
    assert back.patterns.where("exists(flags, f -> f <> 0) is not null and not exists(flags, f -> f <> 0)").isEmpty()
    assert encoded(spark.createDataFrame([], EV)).events().isEmpty()


def test_runs_by_day_are_read_by_folder(spark, tmp_path):
    ev = spark.createDataFrame(made(2), EV)
    days = spark.range(120).select(F.col("id").alias("trip_id"), F.explode(F.split(F.when(F.col("id") % 3 == 0, "a,b").otherwise("b"), ",")).alias("day"))
    encoded(ev, days).write(f"{tmp_path}/t", ["day"])
    back = Coded.read(spark, f"{tmp_path}/t").where(F.col("day") == "a")
    assert {r.trip_id for r in back.events().select("trip_id").distinct().collect()} == set(range(0, 120, 3))
    plan = back.runs._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan


def test_only_carried_runs_are_coded(spark):
    """Runs that no day carries take no part in the dictionaries; positions stay those of the whole run."""
    rows = made(2)
    days = spark.createDataFrame([(t, d) for t in (3, 4, 8) for d in "ab"], "trip_id long, day string")
    coded = encoded(spark.createDataFrame(rows, EV), days)
    assert sorted(map(tuple, coded.where(F.col("day") == "a").events().select(COLS).collect())) == sorted(r for r in rows if r[0] in (3, 4, 8))
    names = {r[0] for r in coded.patterns.select("pattern").collect()} | {r[0] for r in coded.profiles.select("profile").collect()}
    assert names <= {3, 4, 8} and coded.size().first().runs == 6


def test_next_of(spark):
    rng = random.Random(3)
    there = [(rng.randrange(4), rng.randrange(60), i) for i in range(80)]
    asked = [(k, t, f"{k}/{t}") for k in range(5) for t in range(0, 64, 3)]
    for span in (None, 7, 1, 1000):
        got = next_of(spark.createDataFrame(asked, "k long, at long, what string"), spark.createDataFrame(there, "k long, at long, run long"), ["k"], "at", F.struct(F.col("at").alias("t"), "run"), "found", span).collect()
        assert len(got) == len(asked)
        for r in got:
            late = sorted((t, i) for k, t, i in there if k == r.k and t >= r.at)
            assert r.what == f"{r.k}/{r.at}" and (tuple(r.found) if r.found else None) == (late[0] if late else None)


def plain_rounds(rows, access, foot, t0, rounds, cap):
    """The search by its definition, over every event."""
    best = {s: (t0 + d, 0) for s, d in access}
    runs = {}
    for r in rows:
        runs.setdefault(r[0], []).append(r)
    for k in range(1, rounds + 1):
        ready = {s: t + (0 if k == 1 else 60) for s, (t, at) in best.items() if at == k - 1}
        ride = {}
        for x in runs.values():
            for on in x:
                if on[3] in ready and not on[6] & 1 and ready[on[3]] <= on[5] <= cap:
                    for off in x:
                        if off[7] > on[7] and not off[6] & 2 and off[4] <= cap:
                            ride[off[3]] = min(ride.get(off[3], 10**9), off[4])
        ride = {s: t for s, t in ride.items() if s not in best or t < best[s][0]}
        new = dict(ride)
        for u, v, sec in foot:
            if u in ride and ride[u] + sec <= cap:
                new[v] = min(new.get(v, 10**9), ride[u] + sec)
        best |= {s: (t, k) for s, t in new.items() if s not in best or t < best[s][0]}
    return {s: t for s, (t, _) in best.items()}


def test_rounds_over_profiles(spark):
    """Against the search over all events, on runs that overtake each other and on loops; one origin and two side by side."""
    foot = [(0, 5, 70), (5, 0, 70), (2, 7, 90), (7, 2, 90)]
    for seed in (4, 5):
        rows = [r for r in made(seed) if r[0] % 40 != 7]
        ev, walk = spark.createDataFrame(rows, EV), spark.createDataFrame(foot, "u long, v long, sec long")
        got = reach.raptor(ev, spark.createDataFrame([(0, 0), (3, 45)], "stop_id long, sec long"), walk, 1200, 3)
        assert {r.stop_id: r.arr_sec for r in got.collect()} == plain_rounds(rows, [(0, 0), (3, 45)], foot, 1200, 3, 1200 + 10800)
    both = spark.createDataFrame([(1, 0, 0), (2, 3, 45)], "origin long, stop_id long, sec long")
    found = reach.raptor(ev, both, walk, 1200, 3, by=("origin",)).collect()
    for origin, start in ((1, (0, 0)), (2, (3, 45))):
        assert {r.stop_id: r.arr_sec for r in found if r.origin == origin} == plain_rounds(rows, [start], foot, 1200, 3, 1200 + 10800)


def test_namesakes_far_apart_are_no_group(spark):
    """A chain of namesakes at 250 m is one cluster, one 2 km away is not: no link and no access leads there."""
    step = 250 / 111320
    stops = spark.createDataFrame([(i, "A", 52 + i * step, 21.0) for i in range(3)] + [(9, "A", 52.02, 21.0), (10, "B", 52 + 100 / 111320, 21.0)], "stop_id long, stop_name string, lat double, lon double")
    grouped = reach.grouped(stops)
    assert {r.stop_id: r.group_id for r in grouped.collect()} == {0: 0, 1: 0, 2: 0, 9: 9, 10: 10}
    assert {(r.u, r.v) for r in proximity.group_adjacency(grouped).collect()} == {(a, b) for a in range(3) for b in range(3) if a != b}
    assert {r.stop_id for r in proximity.access_nowalk(grouped, 52.0, 21.0).collect()} == {0, 1, 2, 10}


def test_blocks_settle_at_once(spark):
    """Times over a network of many blocks equal those by relaxation and by a heap; rounds are as many as blocks on a path, and one."""
    import heapq

    rng = random.Random(6)
    n, wide = 400, 20
    edges = [(i, j, rng.choice((0, 1, 3, 9))) for i in range(n) for j in (i + 1, i + wide) if j < n and (j != i + 1 or j % wide)]
    edges += [(v, u, s) for u, v, s in edges] + [(0, n + 5, 4), (n + 5, 399, 1)]  # a node of no block
    seeds, cap, best = [(0, 5), (0, 2), (210, 30)], 60, {}
    heap = sorted((t, s) for s, t in seeds)
    while heap:
        t, u = heapq.heappop(heap)
        if u in best:
            continue
        best[u] = t
        if t <= cap:
            for a, b, s in edges:
                if a == u:
                    heapq.heappush(heap, (t + s, b))
    frame = lambda rows, cols: spark.createDataFrame(rows, cols)
    e, s = frame(edges, "u long, v long, sec long"), frame(seeds, "node long, t long")
    blocks = frame([(i, i // wide // 5 * 10 + i % wide // 5) for i in range(n)], "node long, block long")
    got = dict(map(tuple, reach.shortest(s, e, cap, blocks=blocks).collect()))
    rounds = reach.rounds_run["shortest"]
    assert got == best == dict(map(tuple, reach.shortest(s, e, cap).collect()))
    assert rounds <= 8
    one = frame([(i, 1) for i in range(n + 6)], "node long, block long")
    assert dict(map(tuple, reach.shortest(s, e, cap, blocks=one).collect())) == best and reach.rounds_run["shortest"] == 1
    assert reach.shortest(s.where("false"), e, cap, blocks=blocks).count() == 0


def test_only_runs_asked_for_meet_their_box(spark):
    """A feed's box is looked at for the runs that are named alone, however often they are named; without names for all."""
    from wayspan.plans import documents

    class Feeds:
        fx_stops = spark.createDataFrame([(0, 52.205, 21.02), (1, 10.0, 10.0)], "stop_id long, lat double, lon double")
        fx_ev = spark.createDataFrame([(t, 0 if t == 1 else 1) for t in range(1, 6)] + [(5, 0)], "trip_id long, stop_id long")
        orders = spark.createDataFrame([(t, t % 2) for t in range(1, 6)], "o_orderkey long, o_custkey long")

    all_of = {(1, 1, True), (0, 2, True), (1, 3, False), (0, 4, True), (1, 5, True)}
    assert set(map(tuple, documents.kept_runs(Feeds).collect())) == all_of
    among = spark.createDataFrame([(1,), (1,), (3,), (4,)], "trip_id long")
    assert sorted(map(tuple, documents.kept_runs(Feeds, among).collect())) == sorted(r for r in all_of if r[1] in (1, 3, 4))
