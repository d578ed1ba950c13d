import random
from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from wayspan.llm.packing import LENGTHS, cost, pack, packed

SMALL = (25, 50, 100)


def fill_plainly(sizes, room):
    """Words of the longest pieces that fit, one after the other."""
    begin = room
    for s in sorted(sizes, reverse=True):
        if s <= room:
            room -= s
    return begin - room


def brute_pack(sizes, lengths, overhead, attention):
    """The definition by loops: (bin of each piece, final lengths, opening lengths)."""
    bins, opened, out = [], [], []
    for k, size in enumerate(sizes):
        fits = [b for b, held in enumerate(bins) if opened[b] - sum(held) >= size]
        if fits:
            left = min(opened[b] - sum(bins[b]) for b in fits)
            b = [b for b in range(len(bins)) if opened[b] - sum(bins[b]) == left]
        else:
            def worth(x):
                held = size + fill_plainly(sizes[k + 1 :], x - size)
                return cost(min(y for y in lengths if y >= held), overhead, attention) / held, x

            opened.append(min((x for x in lengths if x >= size), key=worth))
            bins.append([])
            b = [len(bins) - 1]
        # of equally full bins any may take the piece: the one with the same contents in `out`
        bins[b[-1]].append(size)
        out.append(b[-1])
    return sorted(map(sum, bins)), sorted(min(x for x in lengths if x >= sum(h)) for h in bins), opened


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=40))
def test_against_the_definition(sizes):
    sizes = sorted(sizes, reverse=True)
    bins, offsets, lengths, opened = pack(sizes, SMALL, 4, 400)
    filled = defaultdict(int)
    for size, b, at in zip(sizes, bins, offsets, strict=True):
        assert at == filled[b]
        filled[b] += size
    for b, n in filled.items():
        assert lengths[b] == min(x for x in SMALL if x >= n) <= opened[b]
    fills, finals, opens = brute_pack(sizes, SMALL, 4, 400)
    assert (sorted(filled.values()), sorted(lengths), opened) == (fills, finals, opens)


def cheapest(sizes, lengths, overhead, attention):
    """The least cost over all partitions of the pieces."""
    best = [float("inf")]

    def go(k, bins, spent):
        if k == len(sizes):
            total = sum(cost(min(x for x in lengths if x >= b), overhead, attention) for b in bins)
            best[0] = min(best[0], total)
            return
        for i in range(len(bins)):
            if bins[i] + sizes[k] <= lengths[-1]:
                bins[i] += sizes[k]
                go(k + 1, bins, spent)
                bins[i] -= sizes[k]
        go(k + 1, [*bins, sizes[k]], spent)

    go(0, [], 0)
    return best[0]


def test_cost_is_near_the_least():
    rng = random.Random(4)
    ratios = []
    for _ in range(60):
        sizes = sorted((rng.randint(1, 100) for _ in range(7)), reverse=True)
        got = sum(cost(x, 4, 400) for x in pack(sizes, SMALL, 4, 400)[2])
        ratios.append(got / cheapest(sizes, SMALL, 4, 400))
    assert min(ratios) >= 1 - 1e-9 and max(ratios) < 1.35 and sum(ratios) / len(ratios) < 1.05


def test_several_lengths_open_and_pay():
    rng = random.Random(1)
    sizes = sorted((rng.choice([rng.randint(5, 60), rng.randint(400, 700), rng.randint(900, 1300)]) for _ in range(5000)), reverse=True)
    bins, _, lengths, opened = pack(sizes)
    assert set(opened) >= {512, 1024, 2048} and min(Counter(opened)[x] for x in (512, 1024, 2048)) > 20
    only, _, _, _ = pack(sizes, LENGTHS[-1:])
    held = Counter()
    for size, b in zip(sizes, only, strict=True):
        held[b] += size
    fixed = sum(cost(min(x for x in LENGTHS if x >= h)) for h in held.values())  # one length, then downsized
    assert sum(map(cost, lengths)) < 0.995 * fixed


def test_all_words_are_packed(spark):
    rows = [(i, (i * 7919) % 5000) for i in range(3000)] + [(9000, 123_456), (9001, 0), (9002, None), (None, 5), (9003, 40), (9003, 40)]
    rows += [(None, 77)] * 1500  # equal rows without an id
    frame = spark.createDataFrame(rows, "doc_id long, n long")
    got = packed(frame, "doc_id", "n", shard=500).collect()
    total, bins = defaultdict(int), defaultdict(list)
    for r in got:
        total[r.doc_id] += r.size
        bins[r.bin_id].append((r.bin_offset, r.size, r.capacity))
    want = defaultdict(int)
    for i, n in rows:
        if n:
            want[i] += n
    assert total == want
    used = taken = 0
    for pieces in bins.values():
        at = 0
        for offset, size, capacity in sorted(pieces):
            assert offset == at
            at += size
        assert capacity == min(x for x in LENGTHS if x >= at)
        used, taken = used + at, taken + capacity
    assert used / taken > 0.97
    shards = Counter(r.bin_id.split("-")[0] for r in got if r.doc_id is None and r.size == 77)
    assert len(shards) > 5 and max(shards.values()) < 500
    again = packed(frame.repartition(5), "doc_id", "n", shard=500).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_empty_and_odd(spark):
    schema = "doc_id long, n long"
    assert packed(spark.createDataFrame([], schema), "doc_id", "n").count() == 0
    assert packed(spark.createDataFrame([(1, None), (2, 0)], schema), "doc_id", "n").count() == 0
