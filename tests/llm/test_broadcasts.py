"""Operators over keys send no side of a join to the driver, however small Spark takes it for."""

import random
from contextlib import contextmanager

from conftest import documents
from conftest_docs import words_text

from wayspan.llm import jaccard, lines, simhash


@contextmanager
def plans(spark):
    """The physical plans, as they ended, of the queries that run inside."""
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()
    bus.waitUntilEmpty()
    last, out = max((store.executionsList().apply(i).executionId() for i in range(store.executionsList().size())), default=-1), []
    yield out
    bus.waitUntilEmpty()
    ran = store.executionsList()
    out += [e.physicalPlanDescription() for e in map(ran.apply, range(ran.size())) if e.executionId() > last]


def near_texts(spark):
    rng, rows = random.Random(3), []
    for i in range(40):
        words = words_text(rng, 80).split()
        for k in range(3):
            words[rng.randrange(80)] = f"new{i}x{k}"
            rows.append((3 * i + k, " ".join(words[:40]) + "\n" + " ".join(words[40:]), "en", "a"))
    return documents(spark, rows)


def test_simhash_keys_are_not_broadcast(spark):
    """64 keys a fingerprint were taken for one row, and sent whole to the driver."""
    docs = near_texts(spark)
    with plans(spark) as ran:
        found = simhash.near_duplicates(docs).collect()
    assert len(found) == 120 and len({r.component_id for r in found}) < 120
    assert any("SortMergeJoin" in p for p in ran) and not any("BroadcastHashJoin" in p or "BroadcastNestedLoopJoin" in p for p in ran)


def test_jaccard_and_line_keys_are_not_broadcast(spark):
    """the pipeline's near_dedup and line_dedup join keys, sets and sketches, which their files make look small."""
    docs = near_texts(spark)
    with plans(spark) as ran:
        assert jaccard.near_duplicates(docs).count() == 120
        lines.repeated_lines(docs, run=1, window=1).count()
    own = [p for p in ran if "BroadcastHashJoin" in p or "BroadcastNestedLoopJoin" in p]
    assert any("SortMergeJoin" in p for p in ran) and not own
