"""Timetable tables projected from the given star-schema tables (same text in both SQL dialects)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession

#: name -> (tables it reads, SQL); later entries may read earlier ones.
TABLES = {
    "fx_stops": (("supplier",), """
SELECT s_suppkey AS stop_id, CASE WHEN s_suppkey % 7 = 0 THEN concat('Far ', CAST(s_suppkey % 21 AS VARCHAR(20)))
         ELSE concat('Stop ', CAST(CAST(floor(s_suppkey / 2) AS BIGINT) AS VARCHAR(20))) END AS stop_name,
       52.2e0 + 0.0012e0 * floor(s_suppkey / 10) AS lat, 21.0e0 + 0.0040e0 * (s_suppkey % 10) AS lon
FROM supplier"""),
    "fx_routes": (("nation",), """
SELECT n_nationkey AS route_id, n_name AS route_name, n_regionkey AS agency_id,
       CASE n_nationkey % 4 WHEN 0 THEN 3 WHEN 1 THEN 0 WHEN 2 THEN 2 ELSE 11 END AS route_type
FROM nation"""),
    "fx_trips": (("orders",), """
SELECT o_orderkey AS trip_id, CAST(o_custkey % 25 AS INT) AS route_id, o_orderstatus AS service_id,
       CAST(18000 + ((o_orderkey * 7919) % 1080) * 60 AS INT) AS start_sec, ascii(o_orderpriority) - 49 AS speed_class
FROM orders"""),
    "fx_stop_times": (("lineitem", "supplier", "fx_trips"), """
SELECT k.trip_id, k.seq,
       (t.route_id * (CAST(floor(n.n / 25) AS BIGINT) + 7) + k.seq * (1 + t.route_id % 4)) % n.n AS stop_id,
       t.start_sec + (k.seq - 1) * (120 + 15 * t.speed_class) AS arr_sec,
       t.start_sec + (k.seq - 1) * (120 + 15 * t.speed_class) + CASE WHEN k.seq % 3 = 2 THEN 20 ELSE 0 END AS dep_sec,
       CASE WHEN k.seq = 7 THEN 1 ELSE 0 END + CASE WHEN k.seq = 1 THEN 2 ELSE 0 END AS flags
FROM (SELECT DISTINCT l_orderkey AS trip_id, l_linenumber AS seq FROM lineitem) k
JOIN fx_trips t ON t.trip_id = k.trip_id
CROSS JOIN (SELECT count(*) AS n FROM supplier) n"""),
    "fx_calendar": (("orders",), """
SELECT CAST(o_custkey % 2 AS INT) AS feed, concat(o_orderstatus, '-', CAST(o_custkey AS VARCHAR(20))) AS service_id,
       CAST(min(o_orderdate) AS DATE) AS start_date, CAST(max(o_orderdate) AS DATE) AS end_date,
       CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END AS sun, CASE WHEN o_orderstatus = 'P' THEN 0 ELSE 1 END AS mon,
       CASE WHEN o_orderstatus = 'P' THEN 0 ELSE 1 END AS tue, CASE WHEN o_orderstatus = 'P' THEN 0 ELSE 1 END AS wed,
       CASE WHEN o_orderstatus = 'P' THEN 0 ELSE 1 END AS thu, CASE WHEN o_orderstatus = 'P' THEN 0 ELSE 1 END AS fri,
       CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END AS sat
FROM orders GROUP BY o_custkey, o_orderstatus"""),
    "fx_calendar_dates": (("orders",), """
SELECT CAST(o_custkey % 2 AS INT) AS feed, concat(o_orderstatus, '-', CAST(o_custkey AS VARCHAR(20))) AS service_id,
       CAST(o_orderdate AS DATE) AS date, CASE WHEN o_orderpriority = '1-URGENT' THEN 2 ELSE 1 END AS exception_type
FROM orders"""),
    "fx_frequencies": (("fx_trips",), """
SELECT trip_id, t.start_sec + w.after AS start_sec, t.start_sec + w.till AS end_sec, w.headway
FROM fx_trips t CROSS JOIN (VALUES (0, 3600, 600), (3600, 6400, 300), (9000, 9000, 300)) AS w(after, till, headway)
WHERE trip_id % 5 = 0"""),
    "fx_delay_obs": (("events",), """
SELECT event_id, event_type AS route_name, ts, CAST(floor(value * 6) AS INT) - 120 AS delay_sec, user_id AS trip_ref FROM events"""),
    "fx_walk_nodes": (("part",), """
SELECT p.p_partkey AS node_id, p.p_size AS p_size, n.w AS w,
       52.2e0 + 0.0010e0 * floor(p.p_partkey / n.w) AS lat, 21.0e0 + 0.0015e0 * (p.p_partkey % n.w) AS lon
FROM part p CROSS JOIN (SELECT CAST(floor(sqrt(count(*))) AS BIGINT) AS w FROM part) n"""),
    "fx_walk_edges": (("fx_walk_nodes",), """
SELECT a.node_id AS u, b.node_id AS v, 102 + CASE WHEN a.p_size % 7 = 0 THEN -90 ELSE a.p_size END AS len_m
FROM fx_walk_nodes a JOIN fx_walk_nodes b ON b.node_id = a.node_id + 1
WHERE a.node_id % a.w < a.w - 1 AND a.p_size % 5 <> 0
UNION ALL
SELECT a.node_id, b.node_id, 111 + CASE WHEN a.p_size % 7 = 0 THEN -90 ELSE a.p_size END
FROM fx_walk_nodes a JOIN fx_walk_nodes b ON b.node_id = a.node_id + a.w
WHERE a.p_size % 3 <> 0"""),
    "fx_ev": (("fx_stop_times", "fx_trips", "fx_routes"), """
SELECT s.trip_id, t.route_id, r.route_type, s.stop_id, s.arr_sec, s.dep_sec, s.flags,
       row_number() OVER (PARTITION BY s.trip_id ORDER BY s.seq) AS pos
FROM fx_stop_times s JOIN fx_trips t ON t.trip_id = s.trip_id JOIN fx_routes r ON r.route_id = t.route_id
WHERE t.service_id IN ('F', 'O')"""),
}
GIVEN = {"supplier", "nation", "orders", "lineitem", "part", "events"}


class Fixtures:
    """Lazy DataFrames of the projected tables: ``fx.fx_stops``, and of the given ones."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._made = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name not in self._made:
            if name in TABLES:
                reads, text = TABLES[name]
                frames = {r: getattr(self, r) for r in reads}
                self._made[name] = self.sql(text, **frames)
            else:
                self._made[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._made[name]

    def sql(self, text: str, **frames: DataFrame) -> DataFrame:
        """Runs SQL over the named frames."""
        import re

        for r in sorted(frames, key=len, reverse=True):
            text = re.sub(rf"(?<=[\s(,])({r})(?=[\s)]|$)", "{" + r + "}", text)
        return self.spark.sql(text, **frames)


def needed(names: set[str]) -> list[str]:
    """The projected tables that ``names`` rest on, in order."""
    todo = reduce(lambda got, n: got | set(TABLES[n][0]) & set(TABLES) if n in got else got, reversed(TABLES), set(names))
    return [n for n in TABLES if n in todo]


def with_tables(sql: str, more: dict[str, str] | None = None) -> str:
    """DuckDB text: ``sql`` behind the projections (and ``more`` named queries) that it names."""
    import re

    body = "\n".join([*(more or {}).values(), sql])
    names = needed({n for n in TABLES if re.search(rf"\b{n}\b", body)})
    ctes = [f"{n} AS ({TABLES[n][1]}\n)" for n in names] + [f"{n} AS ({q}\n)" for n, q in (more or {}).items()]
    return f"WITH RECURSIVE {', '.join(ctes)}\n{sql}" if ctes else sql
