import os
import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wayspan.llm.tokens import VOCABULARY, PieceAutomaton, count_texts, plain_count, read_pieces, token_counts

PIECES = st.sets(st.text("ab", min_size=1, max_size=4).map(str.encode), min_size=1, max_size=12)


@settings(max_examples=150, deadline=None)
@given(PIECES, PIECES, st.lists(st.text("abc", min_size=1, max_size=12).map(str.encode), max_size=8))
def test_counts_are_those_of_greedy_matching(first, later, words):
    pieces = {b" " + p for p in first} | later
    assert PieceAutomaton(pieces).counts(words).tolist() == [plain_count(pieces, w) for w in words]


@pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary here")
def test_public_vocabulary():
    pieces = set(read_pieces(VOCABULARY))
    rng = random.Random(3)
    words = [w for w in "the internationalisation of unbelievable größere naïve 東京 x1234 ###!!".split()]
    words += ["".join(rng.choice("aeionst éß.") for _ in range(rng.randint(1, 20))).replace(" ", "") or "a" for _ in range(300)]
    words = [w.encode() for w in words]
    assert PieceAutomaton(pieces).counts(words).tolist() == [plain_count(pieces, w) for w in words]


def test_marked_pieces_and_unknown_words(tmp_path):
    path = tmp_path / "pieces.txt"
    path.write_text("un\n##aff\n##able\n##a\n")
    automaton = PieceAutomaton(read_pieces(str(path)))
    n_words, n_tokens = count_texts(automaton, ["unaffable una\tzzz", None, "", "  "])
    assert n_words.tolist() == [3, 0, 0, 0]
    assert n_tokens.tolist() == [3 + 2 + 1, 0, 0, 0]


@pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary here")
def test_odd_rows(odd, none):
    pieces = set(read_pieces(VOCABULARY))
    got = sorted((r.doc_id or -1, r.n_words, r.n_tokens) for r in token_counts(odd).collect())
    want = sorted((r.doc_id or -1, len(w := (r.text or "").encode().split()), sum(plain_count(pieces, x) for x in w)) for r in odd.where("doc_id <> 7 or doc_id is null").collect())
    assert [g for g in got if g[0] != 7] == want
    assert token_counts(none).count() == 0


@pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary here")
def test_very_long_words():
    pieces = set(read_pieces(VOCABULARY))
    automaton = PieceAutomaton(pieces)
    rng = random.Random(5)
    words = ["".join(rng.choice("aeionst\u00e9\u6771!") for _ in range(n)).encode() for n in (5, 400, 3000)]
    assert automaton.counts(words).tolist() == [plain_count(pieces, w) for w in words]
    assert automaton.counts(words * 20).tolist() == [plain_count(pieces, w) for w in words] * 20
    began = time.time()
    assert automaton.counts([b"x" * 1_000_000, b"short"])[0] > 1000
    assert time.time() - began < 10


@pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary here")
def test_vocabulary_of_the_session(spark, tmp_path):
    path = tmp_path / "pieces.txt"
    path.write_text("un\n##aff\n##able\n##a\n")
    spark.conf.set("spark.wayspan.vocabulary", str(path))
    try:
        assert token_counts(spark.createDataFrame([(1, "unaffable")], "doc_id long, text string")).first().n_tokens == 3
    finally:
        spark.conf.unset("spark.wayspan.vocabulary")
