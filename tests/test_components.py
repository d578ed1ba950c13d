"""Components of a graph, and stops near places, at any size and latitude."""

import random

import pytest
from pyspark.sql import functions as F

from wayspan.functions import expr as X
from wayspan.operators import proximity, reach


def label_of(spark, nodes, edges):
    found = reach.least_member(spark.createDataFrame([(n,) for n in nodes], "node long"), spark.createDataFrame(edges, "u long, v long"))
    rows = found.collect()
    assert len(rows) == len(nodes)
    return {r.node: r.label for r in rows}


def test_components_in_few_rounds(spark):
    """Two combs whose least nodes lie at the ends of long paths, single nodes, loops, both directions, an edge to nowhere."""
    rng = random.Random(4)
    n = 1500
    path = list(range(10, 10 + n))
    mixed = path[:]
    rng.shuffle(mixed)
    edges = list(zip(path, path[1:], strict=False)) + [(a + 5000, b + 5000) for a, b in zip(mixed, mixed[1:], strict=False)]
    edges += [(b, a) for a, b in edges[::7]] + [(3, 3), (4, 99_999), (5, 99_999)]
    nodes = [*path, *[m + 5000 for m in mixed], 3, 4, 5]
    want = {**{p: 10 for p in path}, **{p + 5000: 5010 for p in path}, 3: 3, 4: 4, 5: 5}
    assert label_of(spark, nodes, edges) == want
    assert reach.rounds_run["components"] <= 10
    assert label_of(spark, [1, 2], []) == {1: 1, 2: 2}


@pytest.mark.parametrize("south", [-52.3, -0.01, 52.2, 89.6, 94.9])
def test_near_stops_at_any_latitude(spark, south):
    rng = random.Random(5)
    at = lambda n: [(i, south + rng.random() / 100, 21 + rng.random() / 50 * (30 if 89 < abs(south) < 91 else 1)) for i in range(n)]
    places, stops = (spark.createDataFrame(at(60), f"{k} long, lat double, lon double") for k in ("place", "stop_id"))
    m = X.distance_m(F.col("p.lat"), F.col("p.lon"), F.col("s.lat"), F.col("s.lon"))
    want = {(r.place, r.stop_id) for r in places.alias("p").crossJoin(stops.alias("s")).where(m <= 400).collect()}
    got = [(r.place, r.stop_id) for r in proximity.near_stops(places, "place", stops, 400).collect()]
    assert want and len(got) == len(set(got)) and set(got) == want


def test_a_far_northern_stop_widens_no_other_row(spark):
    """The cells of places in the south stay as narrow as they need, whatever lies in the north."""
    width = lambda lat: proximity.cell_width(F.floor(F.lit(lat) * X.M_PER_DEG / 400), 400 / X.M_PER_DEG)
    low, high = spark.range(1).select(width(52.2), width(89.99)).first()
    assert 0.0058 < low < 0.006 and high > 1


def test_edges_of_a_round_stay_off_the_driver(spark, tmp_path):
    spark.createDataFrame([(1, 2, 5), (1, 3, 9), (2, 3, 1)], "u long, v long, sec long").write.parquet(f"{tmp_path}/edges")
    found = reach.along(spark.createDataFrame([(1, 0), (2, 2)], "node long, t long"), spark.read.parquet(f"{tmp_path}/edges"))
    assert sorted(map(tuple, found.collect())) == [(2, 5), (3, 3)]
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
