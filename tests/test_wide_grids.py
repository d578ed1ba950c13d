"""Grids of over 4,000,000 cells keep their 25 m."""

import duckdb
import pytest

from wayspan.operators import tiles
from wayspan.operators.raster import Grid
from wayspan.plans import documents, surface
from wayspan.plans.registered import ORACLES
from wayspan.sources.fixtures import Fixtures


@pytest.fixture(scope="module")
def far(tmp_path_factory):
    """A few suppliers, the last of whom stands 10 degrees north of the others; parts of a coast of 104 points."""
    folder = tmp_path_factory.mktemp("far")
    duckdb.sql(f"COPY (SELECT CAST(k AS BIGINT) AS s_suppkey FROM (VALUES (2), (6), (9), (20), (88001)) AS v(k)) TO '{folder}/supplier.parquet'")
    duckdb.sql(f"COPY (SELECT CAST(k AS BIGINT) AS p_partkey FROM range(104) AS v(k)) TO '{folder}/part.parquet'")
    return str(folder)


def both(spark, far, name):
    duck = duckdb.connect()
    for t in ("supplier", "part"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{far}/{t}.parquet')")
    return sorted(tuple(r) for r in getattr(documents, name)(Fixtures(spark, far)).collect()), sorted(duck.execute(ORACLES[name]).fetchall())


def test_water_cells_of_a_large_box(spark, far):
    """cells grew beyond 25 m with the box."""
    grid = surface.grid_of(Fixtures(spark, far))
    assert grid.res == 25 and grid.w * grid.h > 4_000_000
    got, want = both(spark, far, "water_cells")
    assert got == want and got[0][0] > 100


def test_water_mask_of_a_large_box(spark, far):
    """F8: the same."""
    got, want = both(spark, far, "water_mask")
    assert got == want and len(got) > 3


def test_fill_across_tiles(spark):
    """A ring over several tiles of a row, with a hole that begins in one and ends in another, and a side that leaves the grid."""
    grid = Grid(0.0, 0.0, 300 / 111320, 0.9, 1000.0, 1, 900, 300)
    at = lambda x, y: ((300 - y) / 111320, x / 1000)
    shapes = [[(10, 10), (1200, 10), (1200, 290), (10, 290)], [(300, 40), (300, 200), (700, 200), (700, 40)]]
    rows = [(i, k, *at(x + 0.25, y + 0.25)) for i, s in enumerate(shapes) for k, (x, y) in enumerate(s)]
    found = {r.cell for r in tiles.cells(tiles.fill(spark.createDataFrame(rows, "ring_id int, idx int, lat double, lon double"), grid), grid).collect()}
    assert found == {y * 900 + x for y in range(10, 290) for x in range(10, 900) if not (300 <= x < 700 and 40 <= y < 200)}
