"""Ranked lexical search against a plain version."""

import math
import random
import re
from collections import Counter

import pytest

from wayspan.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [] if text is None else TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))


def brute(docs, items, k=10):
    docs = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    docs = [d for d in docs if d[2]]
    n, length = len(docs), sum(d[2] for d in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    w = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * f + 1))) for t, f in df.items()}
    out = []
    for item, text in items:
        scored = [(sum(w[t] * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * (10 + 90 * size * n // length))) for t in set(terms(text)) if t in c), i) for i, c, size in docs]
        scored = sorted((s for s in scored if s[0] > 0), key=lambda s: (-s[0], s[1] is None, s[1] or 0))
        out += [(item, r, i, s) for r, (s, i) in enumerate(scored[:k], 1)]
    return sorted(map(str, out))


def run(spark, docs, items):
    d = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in docs], "doc_id long, text string, id string, n string, `a.b` string")
    i = spark.createDataFrame([(i, t, "x", "y") for i, t in items], "item_id long, text string, row string, terms string")
    return sorted(str((r.item_id, r["rank"], r.doc_id, r.score)) for r in lexical.search(d, i).collect())


def prose(rng, n, words):
    """Words of very unlike frequency."""
    return " ".join(rng.choice((str.upper, str.title, str))(words[min(int(rng.expovariate(0.04)), len(words) - 1)]) for _ in range(n))


@pytest.fixture
def small_shards(monkeypatch):
    for name, value in (("DOCS", 60), ("ITEMS", 7), ("WAVE", 3), ("FIRST", 4)):
        monkeypatch.setattr(lexical, name, value)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_a_plain_version(spark, small_shards, seed):
    rng = random.Random(seed)
    words = [f"w{i}" if i % 5 else f"żółw{i}" for i in range(400)]
    docs = [(i, prose(rng, rng.choice((1, 5, 40, 300)), words)) for i in range(500)]
    docs += [(1000 + i, docs[3][1]) for i in range(250)]  # a third are copies, which tie
    items = [(i, prose(rng, rng.choice((1, 8, 90)), words)) for i in range(30)]  # over 64 terms as well
    assert run(spark, docs, items) == brute(docs, items)


ODD_DOCS = [(1, "Alpha beta-beta, GAMMA!"), (1, "Alpha beta-beta, GAMMA!"), (2, None), (3, ""), (4, " \t--\n"), (None, "alpha alpha"), (None, None), (5, "Été été ĄB"), (6, "alpha " * 20_000 + "omega" * 9_000), (7, "zeta_eta 12,5\x00nul"), (8, "—  alpha")]
ODD_ITEMS = [(1, "ALPHA beta"), (1, "ALPHA beta"), (2, None), (3, "..."), (None, "gamma"), (4, "Été"), (5, "absent words"), (6, "12 5 nul zeta eta"), (7, " alpha —"), (8, " ".join(f"t{i}" for i in range(3000)) + " omega alpha")]


def test_odd_rows(spark):
    assert run(spark, ODD_DOCS, ODD_ITEMS) == brute(ODD_DOCS, ODD_ITEMS)
    assert run(spark, [], ODD_ITEMS) == [] and run(spark, ODD_DOCS, []) == []
    assert run(spark, [(2, None)], ODD_ITEMS) == [] and run(spark, ODD_DOCS, [(3, "...")]) == []


def test_masks_end_early(spark):
    """Most documents are never scored: their masks' maximum lies under the tenth best score."""
    import numpy as np
    import pyarrow as pa

    rng = random.Random(5)
    vocabulary = {f"t{i}".encode(): i for i in range(6)}
    rows = [[t for t in vocabulary if rng.random() < (0.9 if t in (b"t0", b"t1") else 0.1)] for _ in range(4000)]
    docs = pa.table({"id": pa.array(range(4000), pa.int64()), "m": pa.array([100] * 4000, pa.int64()), "terms": pa.array(rows, pa.list_(pa.binary())), "counts": pa.array([[1] * len(r) for r in rows], pa.list_(pa.int64()))})
    shard = lexical.Shard(docs, vocabulary)
    weights, scored = np.array([10, 20, 4000, 5000, 6000, 7000]), []
    plain = lexical.saturated
    lexical.saturated = lambda count, m: (scored.append(np.size(count)), plain(count, m))[1]
    try:
        found, score = lexical.ranked(shard, list(range(6)), weights, 0, 10)
    finally:
        lexical.saturated = plain
    every = sorted((-sum(int(weights[vocabulary[t]]) * plain(1, 100) for t in r), i) for i, r in enumerate(rows))[:10]
    assert [(-s, i) for s, i in zip(score.tolist(), found.tolist(), strict=True)] == every
    assert sum(scored) < 0.2 * sum(map(len, rows))
