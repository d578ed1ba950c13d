from collections import defaultdict
from fractions import Fraction

from wayspan.llm.mixing import mix, repeated, targets


def brute_targets(sizes):
    named = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {s: Fraction(1 + i % 3) for i, (s, _) in enumerate(named)}
    size = dict(named)
    out, free, left = {}, set(size), Fraction(sum(size.values()))
    while True:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > 3 * size[s]} if free else set()
        if not over:
            return out | {s: left * weight[s] / total for s in free}
        for s in over:
            out[s], left = Fraction(3 * size[s]), left - 3 * size[s]
        free -= over


def test_targets(spark):
    for sizes in ([("a", 10), ("b", 1000), ("c", 5), (None, 70)], [("x", 0), ("y", 9)], [("a", 1)], [("a", 100), ("b", 1), ("c", 1), ("d", 1), ("é", 3000)]):
        rows = targets(spark.createDataFrame(sizes, "s string, source_size long")).collect()
        got, want = {r.s: r.target for r in rows}, brute_targets(sizes)
        assert got.keys() == want.keys()
        for s in want:
            assert abs(got[s] - want[s]) < 1e-9 * max(1, want[s])


def test_targets_are_met(spark):
    rows = [(i, " ".join(["w"] * ((i * 37) % 211)), f"s{min(i % 10, 6)}" if i % 3 else "hot", i) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, hash long")
    got = mix(df).collect()
    of = {r[0]: r[2] for r in rows}
    taken, target = defaultdict(int), {}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size and r.size == (r.doc_id * 37) % 211
        taken[of[r.doc_id]] += r.taken
        target[of[r.doc_id]] = r.target
    assert sum(target.values()) - sum(r.size for r in got) < 1e-6
    for s in taken:
        assert abs(taken[s] - target[s]) <= 1
    assert sorted(map(tuple, got)) == sorted(map(tuple, mix(df.repartition(7)).collect()))
    again = repeated(df)
    assert again.columns == df.columns
    words = defaultdict(int)
    for r in again.collect():
        words[r.source] += len(r.text.split())
    for s in taken:
        assert abs(words[s] - target[s]) <= 211


def test_odd_rows(odd, none):
    got = mix(odd).collect()
    assert len(got) == odd.count() and all(0 <= r.taken <= 3 * r.size for r in got)
    assert repeated(odd).columns == odd.columns
    assert mix(none).count() == repeated(none).count() == 0


def test_rows_that_share_an_id(spark):
    """Texts of one word without ids, and of one id: sources still meet their targets to a word."""
    rows = [(None, f"w{i}", "a") for i in range(10)] + [(7, f"v{i}", "b") for i in range(10)] + [(100 + i, f"u{i}", "c") for i in range(10)]
    got = defaultdict(int)
    want = {}
    for r in mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect():
        name = "a" if r.doc_id is None else "b" if r.doc_id == 7 else "c"
        got[name] += r.taken
        want[name] = r.target
    assert all(abs(got[s] - want[s]) <= 1 for s in want) and want["a"] < want["b"] < want["c"]
