"""Earliest arrivals by rounds over the timetable, and shortest times over static edges."""

from __future__ import annotations

from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expr as X
from ..plans.stages import staged
from .proximity import access_walk, same_name_pairs
from .timetable import ridden, shapes


def windowed(ev: DataFrame, t0: int, cap: int, name: str) -> DataFrame:
    """The events that a search from ``t0`` to ``cap`` can use, written once: every round reads them twice."""
    cols = ["trip_id", "stop_id", "pos", "arr_sec", "dep_sec", "flags"]
    return staged(ev.where((F.col("dep_sec") >= t0) & (F.col("arr_sec") <= cap)).select(*cols), f"{name}-events")


def raptor(ev: DataFrame, access: DataFrame, foot: DataFrame, t0: int, rounds: int, name: str = "raptor", by: tuple[str, ...] = ()) -> DataFrame:
    """(stop_id, arr_sec): best labels after ``rounds`` rounds; ``foot``: (u, v, sec), both directions.

    A round boards from stops whose label fell in the round before (buffer 60 s from the
    second on), holds along each profile the earliest run caught, then walks one hop from the
    stops that riding improved. Rounds join profiles, not events: a row a profile and stop of the front,
    however many runs there are. With ``by`` (columns of ``access``, an origin's
    number, say) the searches of all origins run side by side in the same rounds.
    """
    cap, by = t0 + X.HORIZON_S, list(by)
    rides, boards, starts = shapes(ev, t0, cap, name)
    foot = staged(foot.select("u", "v", "sec"), f"{name}-foot")
    best = staged(access.select(*by, "stop_id", (F.lit(t0) + F.col("sec")).cast("long").alias("t"), F.lit(0).alias("round")), name)
    for k in range(1, rounds + 1):
        front = best.where(F.col("round") == k - 1).select(*by, "stop_id", "t")
        ride = ridden(front, rides, boards, starts, 0 if k == 1 else X.MIN_TRANSFER_S, cap, by)
        ride = ride.join(best.select(*by, "stop_id", "t"), [*by, "stop_id"], "left").where("t is null or a < t").select(*by, "stop_id", F.col("a").alias("t"))
        walk = ride.join(foot, ride["stop_id"] == foot["u"]).select(*by, F.col("v").alias("stop_id"), (F.col("t") + F.col("sec")).alias("t")).where(F.col("t") <= cap)
        new = ride.unionByName(walk).groupBy(*by, "stop_id").agg(F.min("t").alias("new"))
        best = best.join(new, [*by, "stop_id"], "full").select(*by, "stop_id", F.least("t", "new").alias("t"), F.when(F.col("t").isNull() | (F.col("new") < F.col("t")), k).otherwise(F.col("round")).alias("round"))
        best = staged(best, name)
    return best.select(*by, "stop_id", F.col("t").alias("arr_sec"))


#: Rounds whose labels stand side by side before they are drawn together; edges that a round follows where there are no blocks.
LEVELS, HOPS = 16, 3
#: Side of a block of the plane in metres: some ten thousand nodes of a dense city.
BLOCK_M = 4000
#: Rounds that the last search of each kind took, for the bench.
rounds_run: dict[str, int] = {}


def plane_blocks(places: DataFrame, node: str) -> DataFrame:
    """(node, block): the square of the plane that each place (node, lat, lon) lies in."""
    south, east = F.floor(F.col("lat") * X.M_PER_DEG / BLOCK_M), F.floor(F.col("lon") * X.M_PER_DEG * F.cos(F.radians(F.floor("lat"))) / BLOCK_M)
    return places.select(F.col(node).cast("long").alias("node"), (F.shiftleft(south.cast("long"), 32) + east.cast("long")).alias("block"))


def least(rows: DataFrame) -> DataFrame:
    return rows.groupBy("node").agg(F.min("t").alias("t"))


def shortest(seeds: DataFrame, edges: DataFrame, cap: int, name: str = "shortest", blocks: DataFrame | None = None) -> DataFrame:
    """(node, t): least times from seeds (node, t) over edges (u, v, sec); labels past ``cap`` aren't carried on.

    With ``blocks`` (node, block), each holding a bounded part of the network, a round settles every block that has
    new labels to the end, and only edges that leave a block send times on: rounds are as many as
    blocks lie along a path, not edges. A node without a block is one by itself. Without ``blocks`` a round follows
    a few edges of all new labels. Either way only improvements are written; rounds end when there are none.
    """
    return relaxed(seeds, edges, cap, name) if blocks is None else by_block(seeds, edges, cap, name, blocks)


def by_block(seeds: DataFrame, edges: DataFrame, cap: int, name: str, blocks: DataFrame) -> DataFrame:
    of = staged(blocks.select("node", "block").dropDuplicates(["node"]), f"{name}-blocks")
    block_of = lambda node, out: F.coalesce(F.col(out), F.xxhash64(node)).alias(out)
    wanted = edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"), F.col("sec").cast("long").alias("sec"))
    wanted = wanted.join(of.toDF("u", "block"), "u", "left").join(of.toDF("v", "to"), "v", "left")
    wanted = staged(wanted.select("u", "v", "sec", block_of("u", "block"), block_of("v", "to")), f"{name}-edges")
    first = least(seeds.select(F.col("node").cast("long").alias("node"), F.col("t").cast("long").alias("t")))
    front = staged(first.join(of, "node", "left").select("node", "t", block_of("node", "block")), name)
    labels, levels, rounds_run["shortest"] = front.where("false"), 0, 0
    while not front.isEmpty():
        rounds_run["shortest"] += 1
        active = front.select("block").distinct()
        known = labels.join(active, "block", "left_semi").groupBy("node", "block").agg(F.min("t").alias("t")).select("node", "t", "block")
        state = known.withColumn("new", F.lit(False)).unionByName(front.withColumn("new", F.lit(True)))
        inside = wanted.join(active, "block", "left_semi")
        found = staged(state.groupBy("block").cogroup(inside.groupBy("block")).applyInArrow(_settled(cap), "node long, t long, block long, sent boolean"), name)
        new = found.where("not sent").drop("sent")
        labels, levels = (new, 1) if not levels else (labels.unionByName(new), levels + 1)
        if levels == LEVELS:
            labels, levels = staged(labels.groupBy("node", "block").agg(F.min("t").alias("t")).select("node", "t", "block"), name), 1
        sent = found.where("sent").groupBy("node", "block").agg(F.min("t").alias("t"))
        had = labels.join(sent.select("node"), "node", "left_semi").groupBy("node").agg(F.min("t").alias("had"))
        front = staged(sent.join(had, "node", "left").where("had is null or t < had").select("node", "t", "block"), name)
    return least(labels.select("node", "t"))


def _settled(cap: int):
    """A block's improved labels, and the least times that its edges send to nodes of other blocks."""

    def run(key: tuple, state: pa.Table, edges: pa.Table) -> pa.Table:
        best: dict[int, int] = {}
        heap, sent, improved, block = [], {}, set(), key[0].as_py()
        for node, t, new in sorted(zip(*(state.column(c).to_pylist() for c in ("node", "t", "new")), strict=True), key=lambda r: r[2]):
            if t < best.get(node, t + 1):
                best[node] = t
                if new:
                    improved.add(node)
                    heap.append((t, node))
        out: dict[int, list] = {}
        for u, v, sec, to in zip(*(edges.column(c).to_pylist() for c in ("u", "v", "sec", "to")), strict=True):
            out.setdefault(u, []).append((v, sec, to))
        heapify(heap)
        while heap:
            t, u = heappop(heap)
            if t > best[u] or t > cap:
                continue
            for v, sec, to in out.get(u, ()):
                if to != block:
                    if t + sec < sent.get(v, (t + sec + 1,))[0]:
                        sent[v] = (t + sec, to)
                elif t + sec < best.get(v, t + sec + 1):
                    best[v] = t + sec
                    improved.add(v)
                    heappush(heap, (t + sec, v))
        rows = [(v, best[v], block, False) for v in improved] + [(v, t, to, True) for v, (t, to) in sent.items()]
        return pa.table({"node": pa.array([r[0] for r in rows], pa.int64()), "t": pa.array([r[1] for r in rows], pa.int64()), "block": pa.array([r[2] for r in rows], pa.int64()), "sent": pa.array([r[3] for r in rows], pa.bool_())})

    return run


def along(step: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, t): least times one edge on. Edges are merged, never broadcast: every hop of every round would send them all to the driver."""
    return step.join(edges.hint("merge"), F.col("node") == F.col("u")).groupBy(F.col("v").alias("node")).agg(F.min(F.col("t") + F.col("sec")).alias("t"))


def relaxed(seeds: DataFrame, edges: DataFrame, cap: int, name: str) -> DataFrame:
    edges = staged(edges.select("u", "v", "sec"), f"{name}-edges")
    front = staged(least(seeds.select("node", F.col("t").cast("long").alias("t"))), name)
    labels, levels, rounds_run["shortest"] = front, 1, 0
    while True:
        rounds_run["shortest"] += 1
        found = step = front
        for _ in range(HOPS):
            step = along(step.where(F.col("t") <= cap), edges)
            found = found.unionByName(step)
        found = least(found)
        had = labels.join(found.select("node"), "node", "left_semi").groupBy("node").agg(F.min("t").alias("had"))
        front = staged(found.join(had, "node", "left").where("had is null or t < had").select("node", "t"), name)
        if front.isEmpty():
            return least(labels)
        labels, levels = labels.unionByName(front), levels + 1
        if levels == LEVELS:
            labels, levels = staged(least(labels), name), 1


def least_member(nodes: DataFrame, edges: DataFrame, name: str = "members") -> DataFrame:
    """(node, label): the least node of each node's component; edges that leave ``nodes`` don't count.

    Each round a node goes over to whichever of itself and its neighbours has the least hash, then one pointer on, and
    edges are renamed. Hashes are new each round, so a fraction of the nodes is left however they are numbered, and
    rounds grow as the logarithm of the nodes, not as the paths' length. Then names are handed back down.
    """
    known = nodes.select("node")
    left = edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u <> v")
    for end in ("u", "v"):
        left = left.join(known.withColumnRenamed("node", end), end, "left_semi")
    left, levels = staged(left.select("u", "v").distinct(), f"{name}-edges"), []
    while not left.isEmpty():
        rank = lambda c: F.xxhash64(F.lit(len(levels)), c)  # noqa: B023, E731
        low = left.union(left.select("v", "u")).groupBy(F.col("u").alias("node")).agg(F.min(F.struct(rank("v").alias("rank"), "v")).alias("o"))
        over = staged(low.select("node", F.when(F.col("o.rank") < rank("node"), F.col("o.v")).otherwise(F.col("node")).alias("up")), f"{name}-over")
        over = staged(over.join(over.select(F.col("node").alias("up"), F.col("up").alias("far")), "up").select("node", F.col("far").alias("up")), f"{name}-up")
        levels.append(over)
        left = left.join(over.toDF("u", "a"), "u").join(over.toDF("v", "b"), "v").where("a <> b")
        left = staged(left.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), f"{name}-edges")
    rounds_run["components"] = len(levels)
    root = known.select("node", F.col("node").alias("up"))
    if levels:
        down = levels.pop()
        while levels:
            down = levels.pop().join(down.toDF("up", "root"), "up", "left").select("node", F.coalesce("root", "up").alias("up"))
        root = known.join(down, "node", "left").select("node", F.coalesce("up", "node").alias("up"))
    root = staged(root, name)
    return root.join(root.groupBy("up").agg(F.min("node").alias("label")), "up").select("node", "label")


def grouped(stops: DataFrame) -> DataFrame:
    """``stops`` with ``group_id``: the least stop of its cluster, namesakes joined by links of at most 300 m."""
    found = least_member(stops.select(F.col("stop_id").alias("node")), same_name_pairs(stops).toDF("u", "v"), "groups")
    return stops.join(found.select(F.col("node").alias("stop_id"), F.col("label").alias("group_id")), "stop_id")


def reversed_network(ev: DataFrame) -> DataFrame:
    """The network run backwards: positions from the end, times from ``REVERSE_C``, flag bits swapped."""
    last = ev.groupBy("trip_id").agg(F.max("pos").alias("n"))
    flag = F.shiftright("flags", 1).bitwiseOR(F.shiftleft(F.col("flags").bitwiseAND(1), 1))
    return ev.join(last, "trip_id").select(
        "trip_id", "route_id", "route_type", "stop_id", (F.col("n") + 1 - F.col("pos")).cast("long").alias("pos"),
        (F.lit(X.REVERSE_C) - F.col("dep_sec")).cast("long").alias("arr_sec"), (F.lit(X.REVERSE_C) - F.col("arr_sec")).cast("long").alias("dep_sec"), flag.cast("long").alias("flags"),
    )


def access(stops: DataFrame, lat: float, lon: float, most_m: float | None = None) -> DataFrame:
    near = access_walk(stops, lat, lon)
    return near if most_m is None else near.where(F.col("metres") <= most_m)
