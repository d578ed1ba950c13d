"""Ranges of any length: all their days count, and none of them becomes dates a service."""

import random
from collections import Counter
from datetime import date, timedelta

import duckdb
import pytest

from wayspan.plans import catalog

DAY = date(2019, 12, 1)


def feeds(spark, seed, long=2000):
    """Feeds with services of several ranges, many of them longer than 120 days, odd rows, and services of one name in several feeds."""
    rng = random.Random(seed)
    some = lambda n: None if rng.random() < 0.05 else DAY + timedelta(n)
    name = lambda: None if rng.random() < 0.03 else f"s{rng.randrange(14)}"
    calendar = [(rng.randrange(3), name(), some(a := rng.randrange(400)), some(a + rng.randrange(-3, rng.choice((9, 200, long)))), *[rng.choice((0, 1)) for _ in range(7)]) for _ in range(50)]
    changes = [(rng.randrange(3), name(), some(rng.randrange(-9, long)), rng.randrange(1, 4)) for _ in range(150)]

    class Feeds:
        fx_calendar = spark.createDataFrame(calendar, f"feed int, service_id string, start_date date, end_date date, {', '.join(f'{d} int' for d in catalog.WEEK)}")
        fx_calendar_dates = spark.createDataFrame(changes, "feed int, service_id string, date date, exception_type int")

    Feeds.spark = spark
    return Feeds, calendar, changes


def plain(calendar, changes):
    """(feed, service): dates added, dates left."""
    added, gone = {}, {}
    for feed, service, first, last, *week in calendar:
        days = [first + timedelta(n) for n in range((last - first).days + 1)] if first and last else []
        added.setdefault((feed, service), set()).update(d for d in days if week[(d.weekday() + 1) % 7])
    for feed, service, d, kind in changes:
        if kind < 3:
            (added if kind == 1 else gone).setdefault((feed, service), set()).add(d)
    return added, {k: v - gone.get(k, set()) for k, v in added.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_whole_ranges_are_counted(spark, seed):
    fx, calendar, changes = feeds(spark, seed)
    added, left = plain(calendar, changes)
    counts = {(r.feed, r.date): (r.added, r.served) for r in catalog.staged_counts(fx, None).collect()}
    n, m = (Counter((feed, d) for (feed, _), days in of.items() for d in days) for of in (added, left))
    assert counts == {k: (c, m[k]) for k, c in n.items()}
    assert max(len(days) for days in added.values()) > 300


#: Two feeds of one service each, of a year; and the bound ahead of which no date is asked for.
YEAR = {
    "fx_calendar": "SELECT CAST(f AS INT) AS feed, concat('s', CAST(f AS VARCHAR(9))) AS service_id, DATE '1995-06-01' AS start_date, DATE '1996-12-31' AS end_date, 0 AS sun, 1 AS mon, 1 AS tue, 1 AS wed, 1 AS thu, 1 AS fri, 1 AS sat FROM (VALUES (0), (1)) AS v(f)",
    "fx_calendar_dates": "SELECT CAST(f AS INT) AS feed, concat('s', CAST(f AS VARCHAR(9))) AS service_id, DATE '1996-03-03' AS date, 1 AS exception_type FROM (VALUES (0), (1)) AS v(f)",
}


def year(spark, name):
    """The query's rows over two services of nineteen months, and those of its SQL."""

    class Fx:
        fx_calendar, fx_calendar_dates = spark.sql(YEAR["fx_calendar"]), spark.sql(YEAR["fx_calendar_dates"])

    sql = {"representative_days": catalog.CHOSEN}.get(name) or catalog.ORACLES[name][catalog.ORACLES[name].rindex("\nSELECT ") :]
    with_ = ", ".join(f"{n} AS ({q})" for n, q in {**YEAR, **catalog.ALL_DAYS}.items())
    want = duckdb.sql(f"WITH {with_} {sql}")
    got = BODIES[name](Fx)
    return sorted(tuple(r[c] for c in want.columns) for r in got.collect()), sorted(want.fetchall())


BODIES = {n: getattr(catalog, n) for n in ("representative_days", "service_dates", "service_dates_past", "services_by_date")}


@pytest.mark.parametrize("seed", [1, 2])
def test_names_are_counted_by_date(spark, seed):
    """names of several feeds count once a date, over whole ranges; a date of services without a name only has none."""
    fx, calendar, changes = feeds(spark, seed)
    served = {(d, name) for (_, name), days in plain(calendar, changes)[1].items() for d in days}
    want = {d: 0 for d, _ in served} | Counter(d for d, name in served if name is not None)
    assert {r.date: r.services for r in catalog.services_by_date(fx).collect()} == want and len(want) > 1000


def test_days_late_in_a_range_are_chosen(spark):
    """of ranges of nineteen months the days after the 120th count."""
    got, want = year(spark, "representative_days")
    assert got == want == [(date(1996, 1, 16), date(1996, 1, 20), date(1996, 3, 3))]


@pytest.mark.parametrize("name", ["service_dates", "service_dates_past", "services_by_date"])
def test_days_late_in_a_range_are_served(spark, name):
    """the same."""
    got, want = year(spark, name)
    assert got == want and max(r[0] for r in got) == date(1996, 12, 31)
