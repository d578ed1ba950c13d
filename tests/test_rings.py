"""Rings: simplification against its definition, stitching, orientation."""

import math
import random

from pyspark.sql import functions as F

from wayspan.operators import rings


def recursive(ring, tolerance):
    """The textbook form: keep the farthest point of a stretch if it is beyond the tolerance."""
    kx, ky = 1.1132 * math.cos(math.radians(ring[0][1] / 1e5)), 1.1132

    def gap(p, a, b):
        ax, ay, bx, by, px, py = a[0] * kx, a[1] * ky, b[0] * kx, b[1] * ky, p[0] * kx, p[1] * ky
        n = (bx - ax) ** 2 + (by - ay) ** 2
        f = min(1, max(0, ((px - ax) * (bx - ax) + (py - ay) * (by - ay)) / n)) if n else 0
        return math.hypot(px - ax - f * (bx - ax), py - ay - f * (by - ay))

    if len(ring) < 3:
        return ring
    gaps = [gap(p, ring[0], ring[-1]) for p in ring[1:-1]]
    k = gaps.index(max(gaps)) + 1
    if gaps[k - 1] <= tolerance:
        return [ring[0], ring[-1]]
    return recursive(ring[: k + 1], tolerance)[:-1] + recursive(ring[k:], tolerance)


def test_simplify(spark):
    long = [(2_100_000 + 10 * k, 5_220_000 + (k * k * 7) % 40) for k in range(60)]
    short = long[:7]
    rows = spark.createDataFrame([(1, long), (2, short), (3, [])], f"ring_id long, ring {rings.POINTS}")
    got = {r[0]: [tuple(p) for p in r[1]] for r in rings.simplify(rows, 15.0).collect()}
    assert got == {1: recursive(long, 15.0), 2: short, 3: []}
    assert 2 < len(got[1]) < 60


def test_stitch():
    assert rings.stitched([[(0, 0), (1, 0)], [(0, 1), (1, 0)], [(0, 1), (0, 0)]]) == [[(0, 0), (1, 0), (0, 1), (0, 0)]]
    assert rings.stitched([[(0, 0), (1, 0)], [(5, 5), (6, 6)]]) == [[(0, 0), (1, 0)], [(5, 5), (6, 6)]]


def test_orientation(spark):
    clockwise = [(0, 0), (0, 1), (1, 1), (1, 0)]
    ring = F.col("ring")
    row = spark.createDataFrame([(clockwise,)], f"ring {rings.POINTS}").select(rings.twice_area(ring), rings.orient(ring, True), rings.orient(ring, False), rings.closed(ring)).first()
    assert row[0] == -2 and [tuple(p) for p in row[1]] == clockwise and [tuple(p) for p in row[2]] == clockwise[::-1] and not row[3]


def test_open_coast_closes_over_the_sea(spark):
    line = [(2100000, 5400000), (2110000, 5410000), (2120000, 5400000)]
    df = spark.createDataFrame([(1, [{"qlon": x, "qlat": y} for x, y in line])], f"ring_id long, ring {rings.POINTS}")
    ring = [(p.qlon, p.qlat) for p in df.select(rings.towards_sea(F.col("ring"), (54.9, 21.5)).alias("r")).first().r]
    want = line + [(2120000, 5490000), (2150000, 5490000), (2150000, 5400000)]
    assert ring == want or ring == want[::-1]
    area = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1]))
    assert area < 0  # clockwise


def test_open_and_small_rings_are_left_out(spark):
    square = lambda n: [(0, 0), (n, 0), (n, n), (0, n), (0, 0)]
    chain = lambda r, c, pts: (r, c, [{"qlon": x, "qlat": y} for x, y in pts])
    rows = [chain(1, 0, square(1000)[:3]), chain(1, 1, square(1000)[2:][::-1]), chain(2, 0, square(5)), chain(3, 0, square(1000)[:4])]
    df = spark.createDataFrame(rows, f"relation_id long, chain_id long, ring {rings.POINTS}")
    got = {r.relation_id: [(p.qlon, p.qlat) for p in r.ring] for r in rings.whole_rings(df, 20.0, 0.02).collect()}
    assert got == {1: square(1000)[:4]}


def test_coasts_in_pieces_have_every_side(spark):
    coast = [(2101800 + 37 * i % 50, 5220000 + i) for i in range(3000)]
    parts = [coast[i : i + 41] for i in range(0, 2999, 40)]
    chain = [(0, (k - 30) % len(parts), p[::-1] if k % 3 == 1 else p) for k, p in enumerate(parts)]
    island = [(2100000, 5220000), (2100000, 5220060), (2100060, 5220060), (2100060, 5220000), (2100000, 5220000)]
    small, short = [(x // 60, y // 60) for x, y in island], coast[:50]
    chain += [(1, 0, island), (2, 0, island[:3]), (2, 1, island[2:][::-1]), (3, 0, small), (4, 0, short), (5, 0, [coast[0]]), (6, 0, [])]
    frame = spark.createDataFrame([(r, k, [{"qlon": x, "qlat": y} for x, y in p]) for r, k, p in chain], f"relation_id long, chain_id long, ring {rings.POINTS}")
    got = sorted(map(tuple, rings.coast_sides(frame, (90.0, 21.1), 0.001, 100).collect()))
    sea = [*coast, (coast[-1][0], 9000000), (2110000, 9000000), (2110000, 5220000)]
    area = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(sea, sea[1:] + sea[:1]))
    want = []
    for ring in (sea[::-1] if area > 0 else sea, island[:-1], island[:-1]):
        want += [(a[1] / 1e5, a[0] / 1e5, b[1] / 1e5, b[0] / 1e5) for a, b in zip(ring, ring[1:] + ring[:1])]
    assert got == sorted(want)


def test_relations_are_one_stream(spark):
    """Many small relations, cut by batches anywhere: the lines of ``stitched``, and no relation is a group of its own."""
    rng, want, rows = random.Random(16), {}, []
    for r in range(200):
        line = [(1000 * r + rng.randrange(900), rng.randrange(900)) for _ in range(rng.randrange(4, 14))]
        line += line[:1] if r % 4 else []
        cuts = sorted({0, len(line) - 1, *(rng.randrange(1, len(line) - 1) for _ in range(rng.randrange(5)))})
        chains = [line[a : b + 1][:: rng.choice((1, -1))] for a, b in zip(cuts, cuts[1:])]
        rng.shuffle(chains)
        want |= {(r, part): ring for part, ring in enumerate(rings.stitched(chains))}
        rows += [(r, k, [{"qlon": x, "qlat": y} for x, y in c]) for k, c in enumerate(chains)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, f"relation_id long, chain_id long, ring {rings.POINTS}")
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    spark.conf.set(size, "3")
    try:
        lines = rings.stitch(frame)
        got = {(x.relation_id, x.part): [(p.qlon, p.qlat) for p in x.ring] for x in lines.collect()}
    finally:
        spark.conf.set(size, before)
    assert got == want
    assert "FlatMapGroups" not in lines._jdf.queryExecution().toString()


def test_without_a_least_area_every_ring_stays(spark):
    """Also one beyond the pole, as the projected tables have them at many stops; with a least area it goes, as in SQL."""
    square = [(0, 9100000), (1000, 9100000), (1000, 9101000), (0, 9101000), (0, 9100000)]
    df = spark.createDataFrame([(1, 0, [{"qlon": x, "qlat": y} for x, y in square])], f"relation_id long, chain_id long, ring {rings.POINTS}")
    assert [[(p.qlon, p.qlat) for p in r.ring] for r in rings.whole_rings(df, 20.0).collect()] == [square[:4]]
    assert rings.whole_rings(df, 20.0, 0.02).isEmpty()
