import random
import time

from conftest_docs import words_text

from wayspan.llm.spans import repeated_spans, sentences, spans, without


def brute(rows, run=2, words=20):
    """Covered sentences by the definition: any span seen before, in order of id and position."""
    first, found = {}, []
    for i, text in sorted(rows):
        cut = sentences(text)
        gone = set()
        for a, b, h, _ in sorted(spans(cut, run, words)):
            if h in first and first[h] != (i, a):
                gone |= set(range(a, b + 1))
            else:
                first.setdefault(h, (i, a))
        found.append((i, len(cut), len(gone), sum(cut[k][2] for k in gone)))
    return found


def test_against_brute_force(spark):
    rng = random.Random(5)
    shared = [words_text(rng, 60) for _ in range(5)]
    rows = []
    for i in range(120):
        parts = [words_text(rng, rng.randint(5, 80)) for _ in range(rng.randint(1, 5))]
        for _ in range(rng.randint(0, 2)):
            parts.insert(rng.randint(0, len(parts)), rng.choice(shared))
        rows.append((i, rng.choice([" ", "\n"]).join(parts)))
    rows += [(200 + i, rows[3][1]) for i in range(30)]
    got = repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_sentences, r.n_removed, r.removed_words) for r in got) == brute(rows)
    texts = dict(rows)
    for r in got:
        left = without(texts[r.doc_id], [(x["from"], x["to"]) for x in r.removed])
        assert len(left.split()) == len(texts[r.doc_id].split()) - r.removed_words
        if r.doc_id >= 200:
            assert not left.split()


def test_passages_go_and_other_text_stays(spark):
    rng = random.Random(9)
    passages = [" ".join(rng.choice("abcdefgh") * 3 + str(rng.randint(0, 999)) for _ in range(55)) for _ in range(20)]  # one sentence without a stop
    rows = [(10 * k + i, f"{words_text(rng, 80)}\n{p}\n{words_text(rng, 80)}") for k, p in enumerate(passages) for i in range(3)]
    got = {r.doc_id: r for r in repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        left = without(text, [(x["from"], x["to"]) for x in got[i].removed])
        if i % 10 == 0:
            assert left == text
        else:
            assert passages[i // 10][:40] not in left and len(left.split()) == 160


def test_odd_rows(odd, none):
    got = {(r.doc_id, r.n_sentences): r.n_removed for r in repeated_spans(odd).collect()}
    assert got[2, 0] == got[3, 0] == got[4, 0] == 0
    assert got[1, 3] == 0  # of 16 words: too short for a span
    assert max(n for (i, _), n in got.items() if i == 6) > 1000
    assert repeated_spans(odd).count() == odd.count() and repeated_spans(none).count() == 0


def test_passages_within_sentences_go(spark):
    """51 words, of many or of few distinct words, spliced into the middle of sentences: at most 16 words at each end stay."""
    rng = random.Random(11)
    passages = [words_text(rng, 51) for _ in range(20)] + [" ".join(f"unstopped{rng.randint(0, 10**6)}" for _ in range(51)) for _ in range(20)]
    passages += [" ".join(rng.choice(["few", "words", "only"]) + str(k) for _ in range(51)) for k in range(20)] + [" ".join([f"one{k}"] * 51) for k in range(20)]
    rows = []
    for k, p in enumerate(passages):
        for i in range(3):
            rows.append((10 * k + i, f"{words_text(rng, 60)} then{k}x{i} {p} and{k}x{i} {words_text(rng, 60)}"))
    got = {r.doc_id: r for r in repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        k = i // 10
        if i % 10:
            assert 51 - 2 * 16 <= got[i].removed_words <= 51, (k, got[i].removed_words)
        elif k < 40:
            assert got[i].removed_words == 0
    assert max(s[2] for _, t in rows for s in sentences(t)) <= 16


def test_long_texts_are_cut_in_one_pass():
    for text in ("!" * 1_000_000, "! " * 300_000, "word" * 300_000, "word " * 300_000, "." * 300_000 + " x" + "?" * 300_000):
        began = time.time()
        cut = sentences(text)
        spans(cut, 2, 20)
        assert time.time() - began < 15
        assert sum(s[2] for s in cut) == len(text.split())


def test_spans_cover_any_passage():
    """Whatever its sizes, all sentences of any run with enough words lie in spans within the run."""
    rng = random.Random(3)
    for _ in range(300):
        sizes = [rng.randint(1, 16) for _ in range(rng.randint(1, 14))]
        found = [(0, 0, n, rng.getrandbits(64)) for n in sizes]
        for run, words in ((2, 20), (3, 5), (1, 30)):
            of = [(a, b) for a, b, _, _ in spans(found, run, words)]
            assert len(of) == len(set(of))
            for i in range(len(sizes)):
                for j in range(i, len(sizes)):
                    if j - i + 1 >= run and sum(sizes[i : j + 1]) >= words:
                        inside = {k for a, b in of if i <= a and b <= j for k in range(a, b + 1)}
                        assert inside == set(range(i, j + 1))
