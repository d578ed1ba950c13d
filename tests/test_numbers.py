"""Dense numbers over many partitions, and comparison of two points by the driver."""

import random

from pyspark.sql import functions as F

from wayspan.operators.numbers import numbered
from wayspan.plans import reaching
from wayspan.sources import streets
from wayspan.sources.fixtures import Fixtures


def test_numbers_are_places_in_the_order(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(50), f"w{rng.randrange(10**6)}", i) for i in range(5000)] + [(None, "x", -1), (3, None, -2)]
    frame = spark.createDataFrame(rows, "k long, word string, `a.b` long").repartition(13)
    got = numbered(frame, ["k", "word", F.col("`a.b`")], "place", 1).collect()
    none_first = lambda r: tuple((v is not None, v if v is not None else 0) for v in r[:3])
    assert [tuple(r[:3]) for r in sorted(got, key=lambda r: r.place)] == sorted(rows, key=none_first)
    assert sorted(r.place for r in got) == list(range(1, 5003))
    plan = numbered(frame, ["k"], "place")._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
    assert numbered(frame.where("false"), ["k"], "place").count() == 0
    skewed = numbered(spark.range(3000).select(F.lit(7).alias("k")), ["k"], "place").collect()
    assert sorted(r.place for r in skewed) == list(range(3000))


def test_two_points_are_compared(spark):
    """A stop counts if both points reach it, with the slower one's time and pass."""
    net = reaching.network(Fixtures(spark, "/root/testdata/sf0.01"))
    q = reaching.asked("t=4:30&cmp=1&p=52.201,21.01&p2=52.208,21.03")
    one, two = ({r.stop_id: (r.sec, r["pass"]) for r in reaching.reachable(net, reaching.asked(f"t=4:30&p={p}"), horizon_rounds=1).collect()} for p in ("52.201,21.01", "52.208,21.03"))
    got = {r.stop_id: (r.sec, r["pass"]) for r in reaching.reachable(net, q, horizon_rounds=1).collect()}
    assert got == {s: one[s] if one[s][0] >= two[s][0] else two[s] for s in one.keys() & two.keys()} and got


def test_broken_bridge_documents_are_null(spark):
    docs = [(1, '{"lines": [[[5200000, 2100000], [5200010, 2100005]]]}'), (2, '{"lines": []}'), (3, "<html>"), (4, None), (5, "{}"), (6, '{"lines": [[[5200000]]]}')]
    got = {r.city: r.lines for r in streets.bridge_lines(spark.createDataFrame(docs, "city long, doc string"), "doc").collect()}
    assert [(p.lat, p.lon) for p in got[1][0]] == [(52.0, 21.0), (52.0001, 21.00005)]
    assert got[2] == [] and got[3] is None and got[4] is None and got[5] is None and (got[6][0][0].lat, got[6][0][0].lon) == (52.0, None)
