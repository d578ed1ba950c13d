"""Rings as arrays of points (lon, lat in 1e-5 degrees): area, orientation, simplification, stitching."""

from __future__ import annotations

import math
from collections import deque

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr as X
from ..plans.stages import staged

SIMPLIFY_FROM = 8
POINTS = "array<struct<qlon:bigint,qlat:bigint>>"


def rings(points: DataFrame) -> DataFrame:
    """(ring_id, ring) from points (ring_id, idx, qlon, qlat)."""
    ordered = F.array_sort(F.collect_list(F.struct("idx", "qlon", "qlat")))
    return points.groupBy("ring_id").agg(F.transform(ordered, lambda p: F.struct(p["qlon"].alias("qlon"), p["qlat"].alias("qlat"))).alias("ring"))


def twice_area(ring: Column) -> Column:
    """Twice the signed area in square units of 1e-5 degrees, exact; negative: clockwise."""
    after = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    parts = F.zip_with(ring, after, lambda a, b: a["qlon"] * b["qlat"] - b["qlon"] * a["qlat"])
    return F.aggregate(parts, F.lit(0).cast("long"), lambda s, p: s + p)


def m2_of(area2: Column, first: Column) -> Column:
    return F.floor(F.abs(area2) / 2e10 * X.M_PER_DEG * X.M_PER_DEG * F.cos(F.radians(first["qlat"] / 1e5))).cast("long")


def area_m2(ring: Column) -> Column:
    """Area in whole square metres, with the longitude scale of the first point."""
    return m2_of(twice_area(ring), ring[0])


def closed(ring: Column) -> Column:
    return (F.size(ring) > 3) & (ring[0] == F.element_at(ring, -1))


def orient(ring: Column, clockwise: bool) -> Column:
    area = twice_area(ring)
    return F.when((area > 0) if clockwise else (area < 0), F.reverse(ring)).otherwise(ring)


def simplified(ring: list, tolerance_m: float) -> list:
    """Keeps both ends and each point more than ``tolerance_m`` from the chord of its stretch; short rings stay."""
    if len(ring) < SIMPLIFY_FROM:
        return ring
    scale = X.M_PER_DEG / 1e5 * math.cos(math.radians(ring[0][1] / 1e5))
    at = [(lon * scale, lat * X.M_PER_DEG / 1e5) for lon, lat in ring]
    keep, todo = {0, len(ring) - 1}, [(0, len(ring) - 1)]
    while todo:
        i, j = todo.pop()
        (ax, ay), (bx, by) = at[i], at[j]
        dx, dy = bx - ax, by - ay
        norm, far, where = dx * dx + dy * dy, tolerance_m, None
        for k in range(i + 1, j):
            px, py = at[k][0] - ax, at[k][1] - ay
            f = max(0.0, min(1.0, (px * dx + py * dy) / norm)) if norm else 0.0
            gap = math.hypot(px - f * dx, py - f * dy)
            if gap > far:
                far, where = gap, k
        if where is not None:
            keep.add(where)
            todo += [(i, where), (where, j)]
    return [ring[k] for k in sorted(keep)]


def simplify(frame: DataFrame, tolerance_m: float) -> DataFrame:
    """The frame (ring_id, ring) with each ring simplified."""

    def work(batches):
        for b in batches:
            lines = [simplified([(p["qlon"], p["qlat"]) for p in r], tolerance_m) for r in b["ring"]]
            yield pd.DataFrame({"ring_id": b["ring_id"], "ring": [[{"qlon": x, "qlat": y} for x, y in r] for r in lines]})

    return frame.select("ring_id", "ring").mapInPandas(work, f"ring_id bigint, ring {POINTS}")


def orders(ends: list[tuple]) -> list[list[tuple[int, bool]]]:
    """Joins open chains, given as (first point, last point), at equal ends, on both sides and turning them where needed; takes chains in order, of those that fit the least.

    Gives by line the chains' numbers, and whether each is turned. A line runs in the direction of its first
    chain. Chains are found by an index of their ends, so the work grows with the chains.
    """
    by_end: dict = {}
    for k, both in enumerate(ends):
        for end in set(both):
            by_end.setdefault(end, deque()).append(k)
    used, out = [False] * len(ends), []

    def take(end) -> int | None:
        there = by_end.get(end, ())
        while there:
            k = there.popleft()
            if not used[k]:
                used[k] = True
                return k
        return None

    for k, (head, tail) in enumerate(ends):
        if used[k]:
            continue
        used[k], line = True, deque([(k, False)])
        while head != tail and (more := take(tail)) is not None:
            back = ends[more][0] != tail
            line.append((more, back))
            tail = ends[more][0 if back else 1]
        while head != tail and (more := take(head)) is not None:
            back = ends[more][0] == head
            line.appendleft((more, back))
            head = ends[more][1 if back else 0]
        out.append(list(line))
    return out


def stitched(chains: list[list]) -> list[list]:
    """The lines that ``orders`` makes of chains of points."""
    lines = [[chains[k][::-1] if back else chains[k] for k, back in line] for line in orders([(c[0], c[-1]) for c in chains])]
    return [[*parts[0], *(p for part in parts[1:] for p in part[1:])] for parts in lines]


def pieces(chains: DataFrame) -> DataFrame:
    """(relation_id, part, ord, ring): chains (relation_id, chain_id, ring) in the order and direction in which they make lines within their relation (one boundary's ways).

    Only the ends of chains go to Python, those of a relation to one task; a chain's points stay in its row. Chains without a point are left out.
    """
    chains = staged(chains.where(F.size("ring") > 0).select(F.col("relation_id").cast("long").alias("relation_id"), "chain_id", "ring").withColumn("row", F.monotonically_increasing_id()), "chains")
    at = {"a": F.col("ring")[0], "b": F.element_at("ring", -1)}
    ends = chains.select("relation_id", "chain_id", "row", *[p[c].alias(f"{c}_{end}") for end, p in at.items() for c in ("qlon", "qlat")])

    def work(batches):
        relation, rows, found = None, [], []

        def settle() -> None:
            for part, line in enumerate(orders([r[1:] for r in rows])):
                found.extend((rows[k][0], part, i, back) for i, (k, back) in enumerate(line))
            rows.clear()

        def made() -> pa.RecordBatch:
            columns = list(zip(*found, strict=True)) or [()] * 4
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.bool_()), strict=True)], names=["row", "part", "ord", "back"])

        for batch in batches:
            of, row, *ab = (batch.column(c).to_pylist() for c in ("relation_id", "row", "qlon_a", "qlat_a", "qlon_b", "qlat_b"))
            for r, k, xa, ya, xb, yb in zip(of, row, *ab, strict=True):
                if r != relation:
                    settle()
                    relation = r
                rows.append((k, (xa, ya), (xb, yb)))
            yield made()
        settle()
        yield made()

    order = ends.repartition("relation_id").sortWithinPartitions("relation_id", "chain_id", "row").mapInArrow(work, "row bigint, part bigint, ord bigint, back boolean")
    return chains.join(order, "row").select("relation_id", "part", "ord", F.when(F.col("back"), F.reverse("ring")).otherwise(F.col("ring")).alias("ring"))


def stitch(chains: DataFrame) -> DataFrame:
    """(relation_id, part, ring): the lines of ``pieces``, a whole one in a row."""
    of = F.array_sort(F.collect_list(F.struct("ord", "ring")))
    ring = F.flatten(F.transform(of, lambda p: F.when(p["ord"] == 0, p["ring"]).otherwise(F.slice(p["ring"], F.lit(2), F.size(p["ring"])))))
    return pieces(chains).groupBy("relation_id", "part").agg(ring.alias("ring"))


def minimum(ring: Column, km2: float) -> Column:
    """Whether a ring's area is at least ``km2``; 0 asks nothing of it (beyond the pole an area's longitude scale is negative)."""
    return area_m2(ring) >= F.lit(int(km2 * 1e6)) if km2 > 0 else F.lit(True)


def whole_rings(chains: DataFrame, tolerance_m: float, least_km2: float = 0.0) -> DataFrame:
    """(relation_id, part, ring): closed rings, without their last point, of chains (relation_id, chain_id, ring), simplified; the rest is left out."""
    found = stitch(chains).where(closed(F.col("ring")))
    found = found.select("relation_id", "part", F.slice("ring", 1, F.size("ring") - 1).alias("ring")).where(minimum(F.col("ring"), least_km2))
    return thinned(found, tolerance_m).where(F.size("ring") >= 4)


def thinned(lines: DataFrame, tolerance_m: float) -> DataFrame:
    """Lines (relation_id, part, ring) simplified."""

    def work(batches):
        for batch in batches:
            ring = batch.column("ring")
            if (pc.max(pc.list_value_length(ring)).as_py() or 0) >= SIMPLIFY_FROM:
                thin = [[{"qlon": x, "qlat": y} for x, y in simplified([(p["qlon"], p["qlat"]) for p in r], tolerance_m)] for r in ring.to_pylist()]
                batch = pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(thin, ring.type)], schema=batch.schema)
            yield batch

    return lines.select("relation_id", "part", "ring").mapInArrow(work, f"relation_id bigint, part bigint, ring {POINTS}")


def over_sea(first: Column, last: Column, sea: tuple[float, float]) -> Column:
    """The points by which a line is closed over the sea's corner (north, east in degrees)."""
    north, east = F.lit(round(sea[0] * 1e5)).cast("long"), F.lit(round(sea[1] * 1e5)).cast("long")
    point = lambda lon, lat: F.struct(lon.alias("qlon"), lat.alias("qlat"))
    return F.array(point(last["qlon"], north), point(east, north), point(east, first["qlat"]))


def towards_sea(ring: Column, sea: tuple[float, float]) -> Column:
    """A ring of an open coast, closed over the sea's corner (north, east in degrees): water lies within, clockwise."""
    return orient(F.concat(ring, over_sea(ring[0], F.element_at(ring, -1), sea)), True)


def coasts(chains: DataFrame, sea: tuple[float, float] | None, tolerance_m: float, least_km2: float, least_points: int) -> DataFrame:
    """(relation_id, part, ring) of coast lines (relation_id, chain_id, ring), which have the sea on their right.

    Closed ones of a least area keep their turn: clockwise is water, the other way an island. Open ones of
    more than ``least_points`` are closed over the sea's corner (north, east), where there is one; shorter ones are left out.
    """
    lines = stitch(chains)
    whole = lines.where(closed(F.col("ring"))).select("relation_id", "part", F.slice("ring", 1, F.size("ring") - 1).alias("ring")).where(minimum(F.col("ring"), least_km2))
    found = thinned(whole, tolerance_m).where(F.size("ring") >= 4)
    if sea is None:
        return found
    main = lines.where(~closed(F.col("ring")) & (F.size("ring") > least_points))
    thin = thinned(main, tolerance_m).select("relation_id", "part", towards_sea(F.col("ring"), sea).alias("ring"))
    return found.unionByName(thin.where(F.size("ring") >= 4))


def cross(a: Column, b: Column) -> Column:
    return a["qlon"] * b["qlat"] - b["qlon"] * a["qlat"]


def pairs(line: Column) -> Column:
    """The sides (a, b) of an open line."""
    n = F.greatest(F.size(line) - 1, F.lit(0))
    return F.zip_with(F.slice(line, F.lit(1), n), F.slice(line, F.lit(2), n), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def in_degrees(sides: DataFrame) -> DataFrame:
    """(lat_a, lon_a, lat_b, lon_b) in degrees of sides (s: a, b)."""
    return sides.select(*[(F.col(f"s.{end}.q{c}") / 1e5).alias(f"{c}_{end}") for end in "ab" for c in ("lat", "lon")])


def ring_sides(lines: DataFrame) -> DataFrame:
    """(lat_a, lon_a, lat_b, lon_b) in degrees: the sides of rings (ring), which close themselves."""
    return in_degrees(lines.select(F.explode(pairs(F.concat("ring", F.slice("ring", 1, 1)))).alias("s")))


def coast_sides(chains: DataFrame, sea: tuple[float, float], least_km2: float, least_points: int) -> DataFrame:
    """The sides (as ``ring_sides``) of ``coasts`` that aren't simplified.

    Neighbouring chains share a point, so a line's sides are those of its chains: lines stay in pieces, and areas are sums over them.
    """
    piece = staged(pieces(chains), "coast-pieces")
    swept = F.aggregate(pairs(F.col("ring")), F.lit(0).cast("long"), lambda n, s: n + cross(s["a"], s["b"]))
    line = piece.groupBy("relation_id", "part").agg(
        F.sum(F.size("ring") - 1).alias("n"), F.min_by(F.col("ring")[0], "ord").alias("first"), F.max_by(F.element_at("ring", -1), "ord").alias("last"), F.sum(swept).alias("area2")
    )
    whole = (F.col("n") > 2) & (F.col("first") == F.col("last"))
    line = line.withColumn("around", F.when(~whole, pairs(F.concat(F.array("last"), over_sea(F.col("first"), F.col("last"), sea), F.array("first")))))
    area2 = F.when(whole, F.col("area2")).otherwise(F.aggregate("around", F.col("area2"), lambda n, s: n + cross(s["a"], s["b"])))
    fits = F.when(whole, (F.col("n") >= 4) & (m2_of(F.col("area2"), F.col("first")) >= F.lit(int(least_km2 * 1e6)))).otherwise(F.col("n") + 1 > least_points)
    line = staged(line.where(fits).select("relation_id", "part", "around", (~whole & (area2 > 0)).alias("turn")), "coast-lines")
    side = piece.join(line.select("relation_id", "part", "turn"), ["relation_id", "part"]).select("turn", F.explode(pairs(F.col("ring"))).alias("s"))
    side = side.unionByName(line.select("turn", F.explode("around").alias("s")))
    return in_degrees(side.select(F.when(F.col("turn"), F.struct(F.col("s.b").alias("a"), F.col("s.a").alias("b"))).otherwise(F.col("s")).alias("s")))


def segments(lines: DataFrame) -> DataFrame:
    """(lat_a, lon_a, lat_b, lon_b) in degrees: the sides of open lines (ring)."""
    return in_degrees(lines.select(F.explode(pairs(F.col("ring"))).alias("s")))
