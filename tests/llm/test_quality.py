import random

import numpy as np
from pyspark.sql import functions as F

from conftest_docs import words_text

from wayspan.llm.common import read
from wayspan.llm.quality import RATIOS, bucketed, fences, measured, measures, quality, sketches


def brute_repeats(words):
    seen, gone = {}, set()
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    for places in seen.values():
        if len(places) > 1:
            for p in places:
                gone |= set(range(p, p + 8))
    return len(gone)


def test_measures():
    rng = random.Random(1)
    for _ in range(40):
        part = words_text(rng, rng.randint(1, 40))
        text = "\n".join([words_text(rng, 10), *[part] * rng.randint(0, 3), "  ", words_text(rng, 5) + " ## $5", " x"])
        words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", text)]
        got = measures(text)
        lines = [x for x in text.split("\n") if x.strip(" \t\x0b\x0c\r")]
        assert got[:5] == (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), brute_repeats(words))


def test_buckets_are_close(spark):
    rows = bucketed(spark.range(5000).withColumnRenamed("id", "value")).collect()
    by = {}
    for r in rows:
        by.setdefault(r.top, set()).add((r.value, r.top))
    for values in by.values():
        tops = {t for _, t in values}
        assert len(tops) == 1 and max(v for v, _ in values) <= (top := tops.pop()) <= min(v for v, _ in values) * 17 / 16 + 1


def test_junk_goes_and_prose_stays(spark):
    rng = random.Random(2)
    rows = [(i, words_text(rng, rng.randint(30, 200)), "en", f"s{i % 4}") for i in range(400)]
    junk = [(1000 + i, " ".join(w + rng.choice(["###", "$$$", "&&&"]) for w in words_text(rng, 100).split()), "en", f"s{i % 4}") for i in range(20)]
    shout = [(2000 + i, words_text(rng, 100).upper().replace(" ", "!! "), "en", "s1") for i in range(10)]
    short = [(3000, "a few words", "en", "s1"), (3001, words_text(rng, 10) + " " + "say it again and again and then more " * 10, "en", None), (3002, None, None, None)]
    got = {r.doc_id: r for r in quality(spark.createDataFrame(rows + junk + shout + short, "doc_id long, text string, lang string, source string")).collect()}
    assert np.mean([got[r[0]].kept for r in rows]) > 0.99
    assert not any(got[r[0]].kept for r in junk + shout + short)
    assert got[3001].base_failed and not got[1000].base_failed and "symbol_pm" in got[1000].failed


def test_odd_rows(odd, none):
    got = quality(odd).collect()
    assert len(got) == odd.count() and all(r.kept is not None for r in got)
    assert quality(none).count() == 0


def test_fences_follow_their_groups(spark):
    """Each ratio's fence differs between groups, and moves when its group's texts do."""
    docs = read(spark, "/root/testdata/sf0.01", "documents").selectExpr("lang", "source", "text")
    found = fences(sketches(measured(docs, ["lang", "source"], "text"))).collect()
    for name, *_, two_sided in RATIOS:
        for side in ("high", "low")[: 1 + two_sided]:
            assert len({r[f"{name}_{side}"] for r in found}) >= 3, (name, side)
    moved = docs.withColumn("text", F.expr("case when source = 'src1' then concat(text, repeat(' #x', length(text) div 40)) else text end"))
    of = lambda rows: {(r.g_lang, r.g_source): r.symbol_pm_high for r in rows}
    before, after = of(found), of(fences(sketches(measured(moved, ["lang", "source"], "text"))).collect())
    assert all(after[k] > before[k] for k in before if k[1] == "src1")


def test_a_quarter_of_junk_in_a_source_goes(spark):
    """Texts of which a third is symbols don't lift the fence of a source that they make a quarter of, and its other texts stay."""
    rng = random.Random(4)
    rows = [(i, words_text(rng, rng.randint(30, 200)), "en", f"s{i % 8}") for i in range(480)]
    junk = [(1000 + i, " ".join(w + "###"[: rng.randint(2, 3)] for w in words_text(rng, 80).split()), "en", "s3") for i in range(20)]
    few = [(2000 + i, words_text(rng, 90), "en", "few") for i in range(2)]
    alike = [(3000 + i, words_text(rng, 90), None, None) for i in range(12)]
    got = {r.doc_id: r.kept for r in quality(spark.createDataFrame(rows + junk + few + alike, "doc_id long, text string, lang string, source string")).collect()}
    assert not any(got[r[0]] for r in junk)
    assert np.mean([got[r[0]] for r in rows + few + alike]) > 0.99


def test_no_english_text_of_symbols_stays(spark):
    docs = read(spark, "/root/testdata/sf0.01", "documents")
    kept = quality(docs).where("kept and n_symbols * 10 >= 3 * word_chars").join(docs.select("doc_id", "lang"), "doc_id")
    assert kept.where("lang = 'en'").isEmpty()


def test_nulls_are_groups_by_value(spark):
    """Null languages and sources have fences of their own: symbols that are usual there stay there and go elsewhere."""
    rng = random.Random(6)
    marked = lambda: words_text(rng, 60).replace(" ", " # ")
    rows = [(i, words_text(rng, 60), "en", "a") for i in range(200)] + [(500 + i, marked(), None, None) for i in range(40)] + [(900, marked(), "en", "a"), (901, None, None, None)]
    got = {r.doc_id: r.kept for r in quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[500 + i] for i in range(40)) and not got[900] and not got[901]
    assert np.mean([got[i] for i in range(200)]) > 0.99
