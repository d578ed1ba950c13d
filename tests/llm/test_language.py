import zlib

import numpy as np

from wayspan.llm.common import read
from wayspan.llm.language import counts, languages


def test_held_out_accuracy(spark):
    docs = read(spark, "/root/testdata/sf0.01", "documents")
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    got = languages(docs).collect()
    assert len(got) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    right = [r.lang_pred == truth[r.doc_id] for r in got if r.held_out and truth[r.doc_id]]
    assert sum(right) > 0.97 * len(right)
    sure = [r.score for r in got if r.held_out]
    assert abs(sum(sure) / len(sure) - sum(right) / len(right)) < 0.05


def test_counts_do_not_depend_on_chunks(monkeypatch):
    from wayspan.llm import language

    text = "The quick brown fox 123 jumps -- over ÉTÉ. " * 50
    whole = counts(text)
    monkeypatch.setattr(language, "CHUNK", 7)
    assert (counts(text) == whole).all()
    assert counts("12 ## \U0001f600") is None and counts("") is None


def test_odd_rows(odd, none):
    got = {r.doc_id: r for r in languages(odd).collect()}
    assert got[2].lang_pred == got[3].lang_pred == got[8].lang_pred == "und" and got[8].score == 0
    assert languages(odd).count() == odd.count() and languages(none).count() == 0
    assert {r.lang_pred for r in languages(odd.drop("lang").selectExpr("*", "cast(null as string) as lang")).collect()} == {"und"}


def plain_ftrl(rows, classes):
    """The definition, a coordinate at a time."""
    import math

    from wayspan.llm import language as L

    z, n = {}, {}

    def weight(i, k):
        zi, ni = z.get((i, k), 0.0), n.get((i, k), 0.0)
        if i == L.FEATURES:
            return -zi / ((L.BETA + math.sqrt(ni)) / L.ALPHA)
        if abs(zi) <= L.L1:
            return 0.0
        return -(zi - math.copysign(L.L1, zi)) / ((L.BETA + math.sqrt(ni)) / L.ALPHA + L.L2)

    rng = np.random.default_rng(11)
    for _ in range(L.EPOCHS):
        for r in rng.permutation(len(rows)):
            at, x, y = rows[r]
            pairs = [*zip(at.tolist(), x.tolist(), strict=True), (L.FEATURES, 1.0)]
            w = {(i, k): weight(i, k) for i, _ in pairs for k in range(classes)}
            score = [sum(v * w[i, k] for i, v in pairs) for k in range(classes)]
            e = [math.exp(s - max(score)) for s in score]
            for i, v in pairs:
                for k in range(classes):
                    g = v * (e[k] / sum(e) - (k == y))
                    old = n.get((i, k), 0.0)
                    sigma = (math.sqrt(old + g * g) - math.sqrt(old)) / L.ALPHA
                    z[i, k] = z.get((i, k), 0.0) + g - sigma * w[i, k]
                    n[i, k] = old + g * g
    return weight


def test_training_against_a_plain_version():
    from wayspan.llm.language import FEATURES, ftrl

    rng = np.random.default_rng(2)
    rows = []
    for i in range(40):
        at = np.sort(rng.choice(30, 6, replace=False))
        x = rng.random(6)
        rows.append((at, x / np.linalg.norm(x), i % 3))
    weights, bias = ftrl(rows, 3)
    plain = plain_ftrl(rows, 3)
    for k in range(3):
        assert abs(bias[k] - plain(FEATURES, k)) < 1e-9
        for i in range(30):
            assert abs(weights[i, k] - plain(i, k)) < 1e-9
    assert (weights == 0).any() and not weights[30:].any()  # the penalty leaves weights at zero
