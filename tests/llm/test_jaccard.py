import random

import corpus_pipeline
from conftest_docs import words_text

from wayspan.llm import simhash
from wayspan.llm.jaccard import fuzzy_keys, near_duplicates, shingles


def shingle_set(text):
    words = text.lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    """The least id that each document reaches by links of Jaccard 0.8 and more; texts without words are one group."""
    sets = {i: shingle_set(t) for i, t in rows}
    alike = lambda a, b: a == b or len(a & b) >= 0.8 * len(a | b)
    near = {i: [j for j in sets if alike(sets[i], sets[j])] for i in sets}
    least = {i: i for i in sets}
    while True:
        new = {i: min(least[j] for j in near[i]) for i in sets}
        if new == least:
            return least
        least = new


def edited(rng, text, n):
    words = text.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def documents(rng):
    texts = ["", " \n", "one", "One", "two words"]
    for _ in range(25):
        base = words_text(rng, rng.choice([8, 64, 200]))
        texts += [base, base.upper(), *[edited(rng, base, rng.randint(1, 6)) for _ in range(4)]]
    base = words_text(rng, 120)  # copies that are like the base and less like each other
    texts += [base, *[edited(rng, base, 2) for _ in range(40)]]
    chain = words_text(rng, 150)
    for k in range(8):
        texts.append(chain)
        chain = " ".join(chain.split()[6:]) + " " + words_text(rng, 6)
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_stage_against_brute_force(spark):
    rows = documents(random.Random(6))
    want = brute(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.id: r.component_id for r in near_duplicates(df).collect()} == want
    kept = corpus_pipeline.near_dedup(spark, df, "").collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(want.values()))


def test_edited_copy_of_64_words_goes(spark):
    """Two words of the last five differ: Jaccard over 0.8, more than 3 bits apart."""
    base = words_text(random.Random(2), 64)
    rows = [(1, base), (2, base.rsplit(" ", 1)[0] + " other"), (3, words_text(random.Random(3), 64))]
    kept = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted(r.doc_id for r in kept) == [1, 3]


def test_rows_of_one_id_and_without_id(spark):
    """Verdicts are on id and text: unlike texts of one id both stay, of each group one row, null ids included."""
    a, b, c, d = (words_text(random.Random(k), 40) for k in range(4))
    rows = [(1, a), (2, b), (2, c), (3, b), (None, a), (None, c), (None, d), (None, d), (None, d + " end")]
    kept = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    got = [(r.doc_id, r.text.removesuffix(" end")) for r in kept]
    assert sorted(got, key=str) == sorted([(1, a), (2, b), (2, c), (None, d)], key=str)


def test_simhash_groups_are_keys(spark):
    """The stage's SimHash step: texts at most 3 bits apart, or linked by such, share a key, and no others do."""
    rng = random.Random(9)
    texts = [words_text(rng, 900) for _ in range(6)]
    texts += [edited(rng, t, 1) for t in texts]
    fps = {i: simhash.majority(shingles(t)) for i, t in enumerate(texts)}
    near = {frozenset((i, j)) for i in fps for j in fps if i < j and (fps[i] ^ fps[j]).bit_count() <= 3}
    assert near and near <= {frozenset((i, i + 6)) for i in range(6)}
    rows = [(i, fp - (1 << 64) if fp >> 63 else fp) for i, fp in fps.items()]
    key = {r.node: r.key for r in fuzzy_keys(spark.createDataFrame(rows, "node long, fp long")).collect()}
    assert {frozenset((i, j)) for i in key for j in key if i < j and key[i] == key[j]} == near
