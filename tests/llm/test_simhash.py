import random

import numpy as np
import xxhash

from wayspan.llm.simhash import codewords, fingerprint, linked, near_duplicates, near_pairs, stars


def brute_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words, held = [], ""
    for c in lowered + " ":
        if c in " \t\n\x0b\x0c\r":
            words, held = words + [held] * bool(held), ""
        else:
            held += c
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_fingerprints():
    for text in ("", "  ", "One", "One two", "ONE two\tthree", "Ärger mit É one two three four two three four", "a b c a b c d " * 30):
        assert fingerprint(text) == brute_fingerprint(text)
    assert fingerprint(None) == 0


def test_spark_agrees_on_xxhash(spark):
    row = spark.sql("select xxhash64('one two three') h").first()
    assert row.h % 2**64 == xxhash.xxh64_intdigest(b"one two three", seed=42)


def test_codewords_of_near_words_meet():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 1 << 23, 2000)
    near = codewords(x)
    assert (near[:, 0] >= 0).all()
    for bit in range(23):
        own = codewords(x ^ (1 << bit))[:, :1]
        assert (near == own).any(axis=1).all()


def test_near_pairs_are_all_found(spark):
    rng = random.Random(4)
    fps = set()
    for _ in range(300):
        f = rng.getrandbits(64)
        fps.add(f)
        for _ in range(4):
            g = f
            for b in rng.sample(range(64), rng.randint(1, 5)):
                g ^= 1 << b
            fps.add(g)
    fps = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    got = {(r.src, r.dst) for r in near_pairs(spark.createDataFrame([(f,) for f in fps], "fp long")).collect()}
    want = {(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= 3}
    assert got == want and len(want) > 500


def brute_components(rows):
    fp = {i: fingerprint(t) for i, t in rows}
    least = {i: i for i in fp}
    while True:
        new = {i: min(least[j] for j in fp if (fp[i] ^ fp[j]).bit_count() <= 3) for i in fp}
        if new == least:
            return {i: (f"{fp[i]:016x}", least[i], least[i] == i) for i in fp}
        least = new


def test_documents_against_brute_force(spark):
    rng = random.Random(8)
    rows = []
    for i in range(60):
        words = [rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(rng.randint(0, 50)) for _ in range(rng.choice([0, 1, 2, 200]))]
        rows.append((i, " ".join(words)))
        for k in range(rng.randint(0, 3)):
            other = list(words)
            if other:
                other[rng.randrange(len(other))] = f"new{rng.randint(0, 9)}"
            rows.append((100 + 10 * i + k, " ".join(other)))
    got = {r.doc_id: (r.fingerprint, r.component_id, r.kept) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows)


def test_odd_rows(odd, none):
    got = near_duplicates(odd).collect()
    assert len(got) == odd.count()
    by = {(r.doc_id, r.fingerprint): r.component_id for r in got}
    assert by[2, "0" * 16] == by[3, "0" * 16] == by[4, "0" * 16] == by[None, "0" * 16] == 2
    assert {r.component_id for r in got if r.doc_id == 1} == {1}
    assert near_duplicates(none).count() == 0


def test_a_template_of_very_many_variants_is_linear(spark):
    """20,000 variants of one fingerprint, any two of which may link: pairs written grow with the variants; chains of single steps stay whole."""
    rng = random.Random(9)
    base, far = rng.getrandbits(64), rng.getrandbits(64)
    variants = {base}
    while len(variants) < 20_000:
        g = base
        for b in rng.sample(range(64), rng.randint(1, 3)):
            g ^= 1 << b
        variants.add(g)
    chain = [far]
    for b in rng.sample(range(64), 30):
        chain.append(chain[-1] ^ (1 << b))
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    frame = spark.createDataFrame([(signed(f),) for f in [*variants, *chain, rng.getrandbits(64)]], "fp long")
    assert stars(frame).count() <= 12 * len(variants)
    roots = {}
    for r in linked(frame).collect():
        roots.setdefault(r.root, set()).add(r.node)
    assert roots == {min(map(signed, x)): set(map(signed, x)) for x in (variants, chain)}
