"""Polls over several batches and restarts, kept state, broken live files."""

import gzip
import json
import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from wayspan.sources import gtfs
from wayspan.streaming import delays
from wayspan.streaming.kept import Kept

OBS = "event_id long, route_name string, trip_ref string, ts timestamp, delay_sec int"
START = datetime(2024, 3, 30, 22, 0, tzinfo=timezone.utc)  # the clock changes in this night


def observed(seed=1, polls=14, runs=9):
    """Some observations a run and poll, in the order in which they came."""
    rng, rows = random.Random(seed), []
    for p in range(polls):
        for _ in range(30):
            trip = rng.randrange(runs)
            rows.append((START + timedelta(minutes=15 * p, seconds=rng.randrange(900)), f"r{trip % 3}", f"t{trip}", rng.randrange(-200, 1500)))
    return [(i, route, trip, ts, d) for i, (ts, route, trip, d) in enumerate(sorted(rows))]


def table(df):
    return sorted(tuple(r[c] for c in (*delays.KEYS, *delays.COUNTS)) for r in df.collect())


def put(spark, folder, rows, name):
    spark.createDataFrame(rows, OBS).coalesce(1).write.mode("append").parquet(f"{folder}/{name}")


def stream(spark, folder):
    return spark.readStream.schema(OBS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)


@pytest.mark.parametrize(("late_s", "every"), [(86_400, 100), (1800, 2)])
def test_a_poll_over_files_and_restarts_counts_a_run_once(spark, tmp_path, late_s, every):
    """Every poll is cut into three files, each a batch; the stream stops and starts anew after each. Also where closed polls are folded into counts."""
    rows, source = observed(), f"{tmp_path}/in"
    want = table(delays.counts(delays.polled(spark.createDataFrame(rows, OBS))))
    cut = [rows[i : i + 47] for i in range(0, len(rows), 47)]
    for k, part in enumerate(cut):
        put(spark, source, part, f"f{k}")
        if k % 3 == 2 or k == len(cut) - 1:  # several batches a start as well
            delays.Polls(spark, f"{tmp_path}/out", late_s, every).run(stream(spark, source))
    polls = delays.Polls(spark, f"{tmp_path}/out", late_s, every)
    assert table(polls.histogram()) == want
    if every == 2:
        closed = polls.kept.closed()
        assert closed is not None and closed.agg(F.sum("n")).first()[0] > 0
        assert len(polls.kept._numbers("bases")) <= 2 and polls.kept.rows().select("poll").distinct().count() <= 5
    polls.run(stream(spark, source))  # nothing new
    assert table(delays.Polls(spark, f"{tmp_path}/out", late_s, every).histogram()) == want


def add(rows):
    return rows.groupBy("k").agg(F.sum("n").alias("n"))


def test_kept_rows_survive_replays_and_failures(spark, tmp_path, monkeypatch):
    one = lambda i: spark.createDataFrame([(j % 3, i + j) for j in range(5)], "k long, n long").coalesce(1)
    kept, want = Kept(spark, f"{tmp_path}/k", add, every=4), {}
    with pytest.raises(ValueError, match="nothing is kept"):
        kept.rows()
    for i in range(23):
        for j in range(5):
            want[j % 3] = want.get(j % 3, 0) + i + j
        kept.commit(one(i), i)
        kept.commit(one(i), i)  # run again
        if i >= 6:
            kept.commit(one(i - 6), i - 6)  # long since drawn together
        assert {r.k: r.n for r in kept.rows().collect()} == want
        assert len(kept._numbers("batches")) <= 8 and len(kept._numbers("bases")) <= 2 and len(kept._numbers("marks")) <= 2
    # a failure after the base is written and before its mark
    kept.commit(one(23), 23)
    want = {r.k: r.n for r in kept.rows().collect()}
    mark, path = kept.mark(), kept._path
    monkeypatch.setattr(kept, "_path", lambda *p: path(*p) if p[:1] != ("marks",) or len(p) == 1 else 1 / 0)
    with pytest.raises(ZeroDivisionError):
        kept.compact(25)
    monkeypatch.undo()
    assert kept.mark() == mark and {r.k: r.n for r in kept.rows().collect()} == want
    kept.compact(25)
    assert kept.mark() == 25 and {r.k: r.n for r in Kept(spark, f"{tmp_path}/k", add).rows().collect()} == want


def test_one_address_keeps_its_faults(spark, tmp_path):
    """Lines cut short, a file that is no archive, a folder without files: whatever else there is comes through."""
    line = lambda **f: json.dumps({"ts": "2024-01-01T08:00:00Z", **f})
    good = [line(event_id=1, routeId="7", tripId="a", delay=30), line(event_id=2, routeId="7", id="e", stops=[{}, {"departure": 90}, {"arrival": 5}]), line(event_id=3, routeId="7", tripId="b"), line(event_id=4, tripId="c", delay=5), line(event_id=5, routeId="8", tripId="d", delay=0, stops=[{"arrival": 4}])]
    for name, text in (("x", "\n".join([good[0], good[1][:-9], good[2]])), ("y", "\n".join(good)), ("w", "not json\n[1, 2\n")):
        (tmp_path / f"in/address={name}").mkdir(parents=True)
        (tmp_path / f"in/address={name}/1.json").write_text(text + "\n")
    (tmp_path / "in/address=x/2.json.gz").write_bytes(b"\x1f\x8bno archive")
    (tmp_path / "in/address=y/2.json.gz").write_bytes(gzip.compress((line(event_id=9, routeId="9", tripId="z", delay=-70) + "\n").encode()))
    (tmp_path / "in/address=none").mkdir()
    seen = {"good": [], "faults": []}

    def keep(batch, number):
        seen["good"] += [(r.event_id, r.route_name, r.trip_ref, r.delay_sec) for r in gtfs.observations(batch).collect()]
        seen["faults"] += [tuple(r) for r in gtfs.faults(batch).collect()]

    gtfs.live_updates(spark, f"{tmp_path}/in").writeStream.foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/progress").trigger(availableNow=True).start().awaitTermination()
    assert sorted(seen["good"]) == [(1, "7", "x|a", 30), (1, "7", "y|a", 30), (2, "7", "y|e", 90), (5, "8", "y|d", 0), (9, "9", "y|z", -70)]
    assert sorted(seen["faults"]) == [("w", 2, 2), ("x", 3, 1), ("y", 6, 0)]
