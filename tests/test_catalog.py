"""Every registered timetable query against its SQL in DuckDB, on a table where it has rows."""

import duckdb
import pytest

from wayspan.plans.registered import ORACLES, QUERIES

#: The second one where a query finds nothing among the ten stops of the first.
FOLDERS = ("/root/testdata/sf0.001", "/root/testdata/sf0.01")


@pytest.fixture(scope="session")
def duck():
    out = {}
    for folder in FOLDERS:
        out[folder] = duckdb.connect()
        for t in "region nation customer supplier part orders lineitem events".split():
            out[folder].execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return out


def cell(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    for folder in FOLDERS:
        got = QUERIES[name](spark, folder)
        cols = sorted(got.columns)
        rows = sorted(tuple(cell(r[c]) for c in cols) for r in got.collect())
        if name in ORACLES:  # the others are tested in test_search.py and test_rings.py
            result = duck[folder].execute(ORACLES[name])
            at = [x[0] for x in result.description]
            assert sorted(at) == cols
            assert rows == sorted(tuple(cell(x[at.index(c)]) for c in cols) for x in result.fetchall())
        if rows:
            return
    assert rows, "no rows to compare"


def test_flagship_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_feed_report_shuffles_flags(spark):
    """A run's stops become a flag a box before the run meets its feed: no coordinates are shuffled with them."""
    from wayspan.plans import documents
    from wayspan.sources.fixtures import Fixtures

    plan = documents.kept_runs(Fixtures(spark, FOLDERS[1]))._jdf.queryExecution().optimizedPlan().toString()
    assert any("Aggregate [trip_id#" in line and "in_1" in line for line in plan.split("\n"))
    assert {r.feed for r in documents.kept_runs(Fixtures(spark, FOLDERS[1])).select("feed").distinct().collect()} == {0, 1}
