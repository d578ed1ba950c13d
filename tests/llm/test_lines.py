import hashlib
import random
import time

from wayspan.llm.lines import LONG, RUN, WINDOW, without_repeats


def h60(x):
    return int(hashlib.md5(x.encode()).hexdigest()[:15], 16)


def brute(rows, run=RUN, window=WINDOW, long=LONG):
    """The definition by loops: fingerprints of windows, texts that share one, first places of grams, runs extended both ways."""
    texts, grams, marks = {}, {}, {}
    for i, text in sorted(rows):
        lines = text.split("\n")
        at = [k for k, x in enumerate(lines) if x.strip(" \t\x0b\x0c\r")]
        own = [lines[k] for k in at]
        texts[i] = (lines, at)
        grams[i] = {(run, k): "\n".join(own[k : k + run]) for k in range(len(own) - run + 1)}
        hashes, marks[i] = [h60(grams[i][run, k]) for k in range(len(own) - run + 1)], set()
        wide = max(1, window - run + 1)
        for w in range(max(1, len(hashes) - wide + 1)) if hashes else ():
            part = hashes[w : w + wide]
            marks[i].add((run, w + max(k for k in range(len(part)) if part[k] == min(part))))
        if run > 1:
            for k, x in enumerate(own):
                if len(x) >= long:
                    grams[i][0, k] = x
                    marks[i].add((0, k))
    seen = {}
    for i in texts:
        for m in marks[i]:
            seen.setdefault(grams[i][m], []).append(i)
    touched = [i for i in texts if any(len(seen[grams[i][m]]) > 1 for m in marks[i])]
    first = {}
    for i in touched:
        for (wide, k), gram in sorted(grams[i].items(), key=lambda g: g[0][1]):
            first.setdefault(gram, (i, k))
    out = {}
    for i, (lines, at) in texts.items():
        before = {m for m, gram in grams[i].items() if i in touched and first[gram] != (i, m[1])}
        gone = set()
        for wide, k in marks[i] & before:
            a = b = k
            while wide and (wide, a - 1) in before:
                a -= 1
            while wide and (wide, b + 1) in before:
                b += 1
            gone |= set(range(a, b + max(wide, 1)))
        places = {at[x] for x in gone}
        out[i] = (len(at), len(places), "\n".join(x for k, x in enumerate(lines) if k not in places))
    return out


def results(df, **how):
    return {r.doc_id: (r["__n_lines"], r["__n_removed"], r.text) for r in without_repeats(df, **how).collect()}


def test_against_brute_force(spark):
    rng = random.Random(3)
    pool = [f"line {k} of the pool" + " with many more words than the others have" * (k % 7 == 0) for k in range(60)]
    rows = []
    for i in range(200):
        lines = []
        while len(lines) < rng.randint(1, 25):
            a = rng.randrange(60)
            lines += pool[a : a + rng.randint(1, 6)] if rng.random() < 0.5 else [f"own {i} {len(lines)}", ""][: rng.randint(1, 2)]
        rows.append((i, "\n".join(lines)))
    rows += [(300 + i, rows[7][1]) for i in range(20)] + [(400, "same\n" * 9), (401, "a\nb"), (402, "b\na"), (403, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for how in ({}, {"run": 1, "window": 1}, {"run": 3, "window": 4, "long": 1000}):
        got, want = results(df, **how), brute(rows, **how)
        assert got == want
        assert sum(x[1] for x in want.values()) > 300
    assert brute(rows)[400][1] == 8


def test_guarantee(spark):
    """A run of three lines goes from all but its first text; a single short line stays, a single long one goes."""
    footer, passage = "the short footer", " ".join(f"word{k}" for k in range(51))
    rows = [(i, f"before {i}\ncommon a\ncommon b\ncommon c\nafter {i}\n{footer}\nthen {i}\n{passage}") for i in range(50)]
    got = results(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got[0][2] == rows[0][1] and all(got[i][2] == f"before {i}\nafter {i}\n{footer}\nthen {i}" for i in range(1, 50))


def test_ends_of_runs_with_earlier_owners(spark):
    """Lines that an earlier, shorter variant owns don't break a run."""
    rows = [(1, "line a\nline b"), (2, "line a\nline b\nline c"), (3, "x\nline a\nline b\nline c\ny")]
    got = results(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got[3][2] == "x\ny"


def test_lines_that_never_stood_together_stay(spark):
    """Every line stands before, each in another text or order: no run of them does."""
    rows = [(1, "alpha one\nbeta two"), (2, "gamma three\ndelta four"), (3, "own start\nbeta two\ngamma three\nown end"), (4, "delta four\nalpha one")]
    got = results(spark.createDataFrame(rows, "doc_id long, text string"))
    assert all(got[i][1:] == (0, text) for i, text in rows)
    # a run is matched against the text that it stands in, also where its lines stand first in others
    rows = [(1, "a 1\nx"), (2, "b 2\ny"), (3, "c 3\nz"), (4, "own\na 1\nb 2\nc 3"), (5, "a 1\nb 2\nc 3\nlast")]
    got = results(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got[4][1] == 0 and got[5][2] == "last"


def test_text_of_very_many_equal_lines(spark):
    lines = [f"line {k}" for k in range(100_000)]
    mixed = lines[:]
    random.Random(1).shuffle(mixed)
    rows = [(1, "equal\n" * 100_000), (2, "\n".join(lines)), (3, "\n".join(mixed))]
    began = time.time()
    got = results(spark.createDataFrame(rows, "doc_id long, text string"))
    assert [got[i][1] for i in (1, 2)] == [99_999, 0] and got[3][1] < 30  # shuffled lines stand together only by chance
    assert time.time() - began < 60


def test_odd_rows(odd, none):
    out = without_repeats(odd)
    assert out.columns == [*odd.columns, "__n_lines", "__n_removed"]
    got = out.collect()
    assert len(got) == odd.count()
    assert [r.text for r in got if r.doc_id == 2] == [None] and [r.text for r in got if r.doc_id == 4] == [" \n\t \n"]
    assert {r["__n_removed"] for r in got if r.doc_id == 1} == {0}
    assert {r["__n_removed"] for r in got if r.doc_id is None} == {0, 3}  # null ids come last
    assert without_repeats(none).count() == 0


def test_grams_are_shuffled_as_hashes_once(spark, monkeypatch):
    """Of the texts that share a fingerprint hashes alone are written, and read for first places and matches alike."""
    from wayspan.llm import lines

    kept = {}
    monkeypatch.setattr(lines, "staged", lambda df, name: kept.setdefault(name, df.localCheckpoint()))
    both = [(1, "a b\nc d\ne f"), (2, "x\na b\nc d\ne f\ny"), (3, "alone\nhere")]
    got = {r.id: sorted(r.gone) for r in lines.repeated_lines(spark.createDataFrame(both, "doc_id long, text string")).collect()}
    assert got == {1: [], 2: [1, 2, 3], 3: []}
    assert kept["lines-near"].columns == ["text", "hash", "check", "passages"] and kept["lines-near"].count() == 2
