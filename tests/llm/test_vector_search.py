"""Exact top-k search and hard negatives against brute force, and on odd rows."""

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayspan.llm import negatives, topk, vectors

SCHEMA = "vec_id long, embedding array<double>, label int, row long, code string, block string, `a.b` string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, lab, 1, "x", "y", "z") for i, v, lab in rows], SCHEMA)


def grid(v):
    if v is None or any(x is None or not math.isfinite(x) or not math.isfinite(256 * x) for x in v):
        return None
    return [math.floor(256 * x) for x in v]


def inner(a, b):
    return min(max(sum(x * y for x, y in zip(a, b, strict=True)), vectors.LEAST), vectors.MOST)


def order(x):  # highest score first, equal ones by id, null last
    return (-x[0], x[1] is None, x[1] or 0)


def brute_top_k(rows, k=5):
    rows = [(n, i, grid(v)) for n, (i, v, _) in enumerate(rows)]
    out = []
    for n, i, a in rows:
        if i is not None and i % 50 == 0 and a is not None:
            near = sorted(((inner(a, b), j) for m, j, b in rows if m != n and b is not None and len(b) == len(a)), key=order)
            out += [(i, r, j, s) for r, (s, j) in enumerate(near[:k], 1)]
    return sorted(map(str, out))


def brute_negatives(rows):
    rows = [(n, i, grid(v), None if lab is None else (lab + 1) % 10 if i is not None and i % 7 == 0 else lab) for n, (i, v, lab) in enumerate(rows)]
    rows = [r for r in rows if r[2] is not None and r[3] is not None]
    out = []
    for n, i, a, lab in rows:
        if i is not None and i % 50 == 0:
            scored = sorted(((inner(a, b), j, other) for m, j, b, other in rows if m != n and len(b) == len(a)), key=order)
            for ps, p, _ in [s for s in scored if s[2] == lab][:5]:
                window = [s for s in scored if s[2] != lab and 50 * ps <= 100 * s[0] <= 95 * ps]
                out += [(i, p, r, j, ps, s) for r, (s, j, _) in enumerate(window[:3], 1)]
    return sorted(map(str, out))


def top_k(df):
    found = topk.top_k(df, F.col("vec_id") % 50 == 0)
    return sorted(str((r.query_id, r.rank, r.vec_id, r.score)) for r in found.collect())


def mined(df):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    found = negatives.hard_negatives(df, F.col("vec_id") % 50 == 0, label=label)
    return sorted(str(tuple(r)) for r in found.collect())


def made(seed, n=600, dim=7):
    """Clusters, copies, near copies and a group of copies that holds a third of all rows."""
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((12, dim))
    rows = []
    for i in range(n):
        v = base[0] if i % 3 == 0 else base[rng.integers(12)] + rng.standard_normal(dim) * rng.choice([0, 0.05, 0.6])
        rows.append((i, v.tolist(), int(rng.integers(4))))
    return rows


ODD = [
    (None, [1.0, 0.5], 1), (50, [1.0, 0.5], 1), (50, [1.0, 0.5], 1), (51, [1.0, 0.4], None), (52, None, 1), (53, [math.nan, 1.0], 1), (54, [None, 1.0], 1), (55, [math.inf, 1.0], 1), (56, [], 1), (100, [], 1), (57, [], 2),
    (58, [0.0, 0.0], 2), (59, [-1.0, -0.5], 2), (60, [0.7, 0.5], 2), (61, [0.7, 0.5], 2), (62, [0.6, 0.5], 3), (150, [1.0, 0.5, 0.25], 1), (151, [1.0, 0.5, 0.25], 1), (152, [0.8, 0.5, 0.1], 2),
    (200, [1e9, 1e9, 0.0, 0.0], 1), (201, [1e9, -1e9 + 1, 0.0, 0.0], 1), (202, [9e8, 9e8, 1.0, 0.0], 2), (203, [9e8, 9e8, 1.0, 1e300], 3), (204, [1e300, 1e300, 0.0, 0.0], 1), (205, [1e308, 0.0, 0.0, 0.0], 1),
]


@pytest.fixture
def small_blocks(monkeypatch):
    """Many blocks, chunks and zones on few rows."""
    for module, values in ((topk, {"ROWS": 40, "QUERIES": 5, "STEP": 3}), (negatives, {"ROWS": 25, "ANCHORS": 5, "ZONES": 4, "STEP": 3, "RUN": 2})):
        for name, value in values.items():
            monkeypatch.setattr(module, name, value)


@pytest.mark.parametrize("seed", [1, 2])
def test_top_k_against_brute_force(spark, small_blocks, seed):
    rows = made(seed)
    assert top_k(table(spark, rows)) == brute_top_k(rows)


def test_hard_negatives_against_brute_force(spark, small_blocks):
    rows = made(3)
    want = brute_negatives(rows)
    assert len(want) > 50 and mined(table(spark, rows)) == want


def test_odd_rows(spark):
    df = table(spark, ODD)
    assert top_k(df) == brute_top_k(ODD)
    assert mined(df) == brute_negatives(ODD)
    assert top_k(df.where("false")) == [] and mined(df.where("false")) == []
    # fewer rows than asked for; no query at all
    assert top_k(df.where("vec_id in (150, 151)")) == brute_top_k([r for r in ODD if r[0] in (150, 151)])
    assert top_k(df.where("vec_id = 151")) == [] and mined(df.where("vec_id = 151")) == []


@pytest.mark.parametrize(("dim", "bits"), [(2, 4), (3, 3), (5, 2)])
def test_hilbert_curve_steps_to_neighbours(dim, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dim, indexing="ij")).reshape(dim, -1).T
    keys = [k.tobytes() for k in negatives.hilbert(cells, bits)]
    assert len(set(keys)) == len(cells)
    walk = cells[sorted(range(len(keys)), key=keys.__getitem__)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_zone_maps_leave_blocks_unread(spark, monkeypatch):
    """Clusters far apart: an anchor reads its own cluster's blocks and few others, and the result is whole."""
    monkeypatch.setattr(negatives, "ROWS", 50)
    monkeypatch.setattr(negatives, "RUN", 4)
    rng = np.random.default_rng(4)
    rows = [(i, (np.eye(8)[i % 8] * 3 + rng.standard_normal(8) * 0.05).tolist(), int(rng.integers(3))) for i in range(2000)]
    seen = defaultdict(int)
    own = negatives.Blocks.search

    def watched(self, anchors, same, k, home):
        if not home:
            seen["blocks"] += self.zones.count() * anchors.count()
        out = own(self, anchors, same, k, home)
        if not home:
            cols = ["row", "id", "label", "code", "home", "least", "most"]
            chunk = F.lit(0).alias("chunk")
            zones, a = vectors.fresh(self.zones.select("*", chunk)), anchors.select("dim", chunk, *cols)
            seen["read"] += a.groupBy("dim", "chunk").cogroup(zones.groupBy("dim", "chunk")).applyInArrow(negatives._chosen(same), "block long, row long").count()
        return out

    monkeypatch.setattr(negatives.Blocks, "search", watched)
    assert mined(table(spark, rows)) == brute_negatives(rows)
    assert seen["read"] < 0.3 * seen["blocks"]
