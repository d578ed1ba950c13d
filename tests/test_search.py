"""Searches with legs and delays, and feed readers, on small cases and against the plain search."""

from pyspark.sql import functions as F

from wayspan.operators import raster, search
from wayspan.plans import registered
from wayspan.sources import gtfs
from wayspan.sources.fixtures import Fixtures

SF = "/root/testdata/sf0.01"
EV = "trip_id long, route_id long, route_type long, stop_id long, arr_sec long, dep_sec long, flags long, pos long"
FOOT = "u long, v long, sec long"


def test_legs_join_up(spark):
    legs = registered.QUERIES["journey_legs"](spark, SF).collect()
    labels = {r["stop_id"]: r["arr_sec"] for r in registered.QUERIES["raptor_r2"](spark, SF).collect()}
    ev = {(r["trip_id"], r["stop_id"]): r for r in Fixtures(spark, SF).fx_ev.collect()}
    by = {}
    for leg in sorted(legs, key=lambda r: (r["target"], r["leg"])):
        by.setdefault(leg["target"], []).append(leg)
    assert set(by) == set(labels)
    for target, path in by.items():
        assert path[0]["kind"] == "access" and path[-1]["to_stop"] == target and path[-1]["arr_sec"] == labels[target]
        for a, b in zip(path, path[1:]):
            assert b["from_stop"] == a["to_stop"] and b["dep_sec"] >= a["arr_sec"]
            if b["kind"] == "ride":
                assert ev[b["trip_id"], b["from_stop"]]["dep_sec"] == b["dep_sec"] and ev[b["trip_id"], b["to_stop"]]["arr_sec"] == b["arr_sec"]
    assert any(len(p) > 1 for p in by.values())


def two_lines(spark, wait):
    """Bus 1 from stop 1 to 2 in 100 s, bus 2 from 2 to 3 leaving ``wait`` s after that arrival with its delay."""
    return spark.createDataFrame([(1, 1, 3, 1, 0, 0, 0, 1), (1, 1, 3, 2, 100, 100, 0, 2), (2, 2, 3, 2, 115 + wait, 115 + wait, 0, 1), (2, 2, 3, 3, 1000, 1000, 0, 2)], EV)


def test_cautious_change(spark):
    access, foot = spark.createDataFrame([(1, 0)], "stop_id long, sec long"), spark.createDataFrame([], FOOT)
    for wait, caught in ((239, False), (240, True)):
        got = {r[0] for r in search.cautious(two_lines(spark, wait), access, foot, 0, 2).collect()}
        assert got == ({1, 2, 3} if caught else {1, 2})


def test_contraction(spark):
    # 1-2-3-4 a chain, 4-5 and 4-6 at a junction, 7-8-9 a circle without a junction
    rows = [(1, 2, 10), (2, 3, 20), (3, 4, 30), (4, 5, 5), (4, 6, 6), (7, 8, 1), (8, 9, 1), (9, 7, 1)]
    got = search.contract(spark.createDataFrame(rows, "u long, v long, len_m long")).collect()
    assert sorted(map(tuple, got)) == [(1, 4, 60), (4, 5, 5), (4, 6, 6)]


def test_no_walk_flood(spark):
    """Eleven cells in a row, water in the sixth: nothing behind it is reached; 100 m stop at the fifth."""
    grid = raster.Grid(0, 0, 0, 0, 1.0, 25, 11, 1)
    land = spark.range(11).where("id <> 5").select(F.col("id").alias("cell"))
    walks = raster.moves(land, grid)
    for metres, t in ((200, 300), (100, 300)):
        seeds = spark.createDataFrame([(0, t)], "node long, t long")
        assert sorted(map(tuple, raster.near_cells(seeds, walks, grid, metres).collect())) == [(x, 300) for x in range(5)]
    both = spark.createDataFrame([(0, 600), (2, 300)], "node long, t long")
    assert dict(map(tuple, raster.near_cells(both, walks, grid, 25).collect())) == {0: 600, 1: 300, 2: 300, 3: 300}


def test_feed_tables(spark, tmp_path):
    (tmp_path / "stops.txt").write_text('﻿stop_id, stop_name ,more\n007,"Say ""hi"", all",x\n8,,\n', encoding="utf-8")
    rows = [tuple(r) for r in gtfs.table(spark, str(tmp_path), "stops").collect()]
    assert rows == [("007", 'Say "hi", all', "", "", ""), ("8", "", "", "", "")]
    assert gtfs.table(spark, str(tmp_path), "frequencies").count() == 0
    both = gtfs.feeds(spark, [str(tmp_path), str(tmp_path)], "stops")
    assert both.select("feed", "stop_id").distinct().count() == 4


def test_legs_without_waiting(spark):
    """Two rides of one line and two walks in a row are a leg each."""
    rows = [(1, 7, 3, s, 100 * i, 100 * i, 0, i + 1) for i, s in enumerate((1, 2, 3))] + [(2, 8, 3, 3, 0, 0, 0, 1), (2, 8, 3, 4, 50, 50, 0, 2)]
    foot = spark.createDataFrame([(4, 5, 70), (5, 6, 80), (1, 6, 900)], FOOT)
    seeds = spark.createDataFrame([(1, 30)], "node long, t long")
    got = {}
    for r in search.general_journeys(spark.createDataFrame(rows, EV), seeds, foot).orderBy("target", "leg").collect():
        got.setdefault(r.target, []).append((r.kind, r.from_stop, r.to_stop, r.route_id, r.sec))
    start = ("access", None, 1, None, 30)
    assert got[1] == [start] and got[2] == [start, ("ride", 1, 2, 7, 100)] and got[3] == [start, ("ride", 1, 3, 7, 200)]
    assert got[4] == [start, ("ride", 1, 3, 7, 200), ("ride", 3, 4, 8, 50)]
    assert got[6] == [start, ("ride", 1, 3, 7, 200), ("ride", 3, 4, 8, 50), ("walk", 4, 6, None, 150)]


def test_legs_without_waiting_add_up(spark):
    legs = registered.QUERIES["general_legs"](spark, SF).collect()
    times = {r["stop_id"]: r["sec"] for r in registered.QUERIES["general_reach"](spark, SF).collect()}
    by = {}
    for leg in sorted(legs, key=lambda r: (r["target"], r["leg"])):
        by.setdefault(leg["target"], []).append(leg)
    assert set(by) == {s for s, t in times.items()}
    for target, path in by.items():
        assert path[0]["kind"] == "access" and path[-1]["to_stop"] == target and sum(x["sec"] for x in path) == times[target]
        for a, b in zip(path, path[1:]):
            assert a["to_stop"] == b["from_stop"] and (a["kind"], a["route_id"]) != (b["kind"], b["route_id"])


def test_driver_agrees_with_the_searches(spark):
    """The driver's night search from a point, and what no vehicle or no stop leaves."""
    from wayspan.plans import reaching

    fx = Fixtures(spark, SF)
    net = reaching.network(fx)
    got = {r.stop_id: (r.sec, r["pass"]) for r in reaching.reachable(net, reaching.asked("t=4:00"), horizon_rounds=2).collect()}
    access = net.access(reaching.asked(""))
    both = [{r.stop_id: r.arr_sec - t for r in reaching.reach.raptor(fx.fx_ev, access, net.foot(True), t, 2).collect()} for t in (14400, 100800)]
    for stop, (sec, number) in got.items():
        assert sec == min(b.get(stop, 10**9) for b in both) and number == (both[1].get(stop, 10**9) < both[0].get(stop, 10**9))
    walk = {r.stop_id: r.sec for r in reaching.reachable(net, reaching.asked("veh="), horizon_rounds=1).collect()}
    assert walk == {r.stop_id: r.sec for r in access.collect()}


def test_feeds_without_common_dates_fail(spark):
    from wayspan.plans import catalog

    class Apart:
        fx_calendar = spark.sql("select 0 feed, 'a' service_id, date'2020-01-01' start_date, date'2020-01-09' end_date, 1 sun, 1 mon, 1 tue, 1 wed, 1 thu, 1 fri, 1 sat union all select 1, 'b', date'2021-01-01', date'2021-01-09', 1, 1, 1, 1, 1, 1, 1")
        fx_calendar_dates = spark.createDataFrame([], "feed int, service_id string, date date, exception_type int")

    import pytest

    with pytest.raises(Exception, match="no dates in common"):
        catalog.common_range(Apart).collect()


def test_seeds_leave_the_water(spark):
    """A seed on water goes to the first of west, east, north, south that is land; at the grid's edge none wraps."""
    grid = raster.Grid(0, 0, 0, 0, 1.0, 25, 5, 3)
    land = spark.range(15).where("id in (5, 8, 2, 10)").select(F.col("id").alias("cell"))
    at = lambda cell: [tuple(r) for r in raster.on_land(spark.createDataFrame([(cell, 9)], "node long, t long"), land, grid).collect()]
    assert at(5) == [(5, 9)] and at(6) == [(5, 9)] and at(7) == [(8, 9)] and at(9) == [(8, 9)]
    assert at(0) == [(5, 9)]  # south, as nothing lies west of it
    assert at(4) == []  # 5 is the next cell, but of the next row


def test_served_dates_are_a_row_a_service(spark):
    """Ranges, additions and exceptions of one service, and a service of the same name in another feed."""
    from datetime import date, timedelta

    from wayspan.plans import catalog

    class Feeds:
        fx_calendar = spark.sql("select 0 feed, 'a' service_id, date'2020-01-01' start_date, date'2020-12-31' end_date, 1 sun, 0 mon, 0 tue, 1 wed, 0 thu, 0 fri, 1 sat union all select 0, 'a', date'2020-01-04', date'2020-01-06', 1, 1, 1, 1, 1, 1, 1 union all select 0, 'b', date'2020-02-02', date'2020-02-01', 1, 1, 1, 1, 1, 1, 1")
        fx_calendar_dates = spark.sql("select 0 feed, 'a' service_id, date'2020-01-02' date, 1 exception_type union all select 0, 'a', date'2020-01-05', 2 union all select 1, 'a', date'2020-01-05', 1 union all select 1, 'c', date'2020-01-07', 2")

    first = date(2020, 1, 1)
    weekly = {d for d in (first + timedelta(n) for n in range(120)) if d.weekday() in (2, 5, 6)}
    added = weekly | {date(2020, 1, n) for n in (2, 4, 5, 6)}
    got = {(r.feed, r.service_id): (r.added, r.dates) for r in catalog.service_days(Feeds).collect()}
    assert {k: tuple(map(sorted, v)) for k, v in got.items()} == {(0, "a"): (sorted(added), sorted(added - {date(2020, 1, 5)})), (0, "b"): ([], []), (1, "a"): ([date(2020, 1, 5)],) * 2, (1, "c"): ([], [])}
    assert {r.feed: (r.first, r.last) for r in catalog.ranges_of(catalog.service_days(Feeds), "dates").collect()} == {0: (first, max(weekly)), 1: (date(2020, 1, 5),) * 2}


def test_dates_are_counted_without_expanding_services(spark):
    """Counts by date, the days that services run on and the bounds against a row a service and date; ranges become dates once for all services that share them."""
    import random
    from collections import Counter
    from datetime import date, timedelta

    from pyspark.sql import functions as F

    from wayspan.plans import catalog

    rng = random.Random(8)
    day = lambda n: date(2020, 1, 1) + timedelta(n)
    some = lambda n: None if rng.random() < 0.05 else day(n)
    calendar = [(rng.randrange(3), f"s{rng.randrange(25)}", some(a := rng.randrange(40)), some(a + rng.randrange(-3, 150)), *[rng.choice((0, 1, None)) for _ in range(7)]) for _ in range(60)]
    changes = [(rng.randrange(3), f"s{rng.randrange(30)}", some(rng.randrange(-5, 60)), rng.randrange(1, 4)) for _ in range(200)]

    class Feeds:
        fx_calendar = spark.createDataFrame(calendar, f"feed int, service_id string, start_date date, end_date date, {', '.join(f'{d} int' for d in catalog.WEEK)}")
        fx_calendar_dates = spark.createDataFrame(changes, "feed int, service_id string, date date, exception_type int")

    rows = catalog.service_days(Feeds).collect()
    added, left = (Counter((r.feed, d) for r in rows for d in r[c]) for c in ("added", "dates"))
    counts = catalog.staged_counts(Feeds)
    assert {(r.feed, r.date): (r.added, r.served) for r in counts.collect()} == {k: (n, left[k]) for k, n in added.items()}
    of = catalog.services(Feeds)
    for one in [*map(day, range(0, 60, 7)), None]:
        found = {(r.feed, r.service_id) for r in of.where(catalog.runs_on(F.lit(one).cast("date"))).collect()}
        assert found == {(r.feed, r.service_id) for r in rows if one and one in r.dates}
    for c, column in (("added", "added"), ("dates", "served")):
        assert sorted(map(tuple, catalog.counted_ranges(counts, column).collect())) == sorted(map(tuple, catalog.ranges_of(catalog.service_days(Feeds), c).collect()))

    class Alike:
        fx_calendar = spark.range(500).selectExpr("0 feed", "string(id) service_id", "date'2020-01-01' start_date", "date'2020-12-31' end_date", *[f"1 {d}" for d in catalog.WEEK])
        fx_calendar_dates = Feeds.fx_calendar_dates.where("false")

    few = catalog.date_counts(catalog.staged_services(Alike))
    few.collect()
    metric, todo = 0, [few._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif "QueryStage" in node.nodeName():
            todo.append(node.plan())
        else:
            todo += [node.children().apply(i) for i in range(node.children().size())]
        if node.nodeName() == "Generate":
            metric = max(metric, node.metrics().apply("numOutputRows").value())
    assert metric == 120 and {r.served for r in few.collect()} == {500}
