"""Embedding near-dedup by collision-counting projections.

Equal vectors are collapsed first. A vector then travels as a code of one byte a component
with a bound of its error, so that a pair's cosine is known from the codes to within the two bounds.

Vectors meet in cells: each of L tables hashes a
vector by which of a few random directions it is most extreme in, with so many values
that a cell holds about ``cell`` vectors. Within a cell every vector is ranked on many
sorted one-dimensional projections; a pair collides on a projection if one lies in the
window centred on the other, and pairs with enough collisions are verified: by their codes
where these decide, else by the cosine of the vectors themselves in double precision. A pair exactly
at the threshold collides on each projection with one known probability, so the least
count follows from the binomial distribution, and L from the measured
probability that such a pair shares a cell: together they lose at most ``miss`` of the pairs at the threshold,
fewer beyond, whatever the data are. L grows as about n^0.2.

(Windows on single projections of unit vectors hold a third of all rows, so that sorting the whole table by them finds
nothing; hence the cells.)

A cell of more than ``block`` vectors is split into salted blocks that meet pairwise:
no task holds more than two blocks of one cell. A pair is counted only in the first
table whose cell it shares. Tasks emit link counts and a local spanning star for each
vector, and as pairs only those that the codes can't decide.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, staged

SEED = 7
#: One-dimensional projections a pair is counted on; half-width of windows in distances at the threshold.
PROJECTIONS, WIDE = 24, 1.5
#: Pairs at the threshold by which a table's share of them is measured.
SIMULATED = 20_000
#: Vectors of which there are more copies than the table's rows by this number: so many at most; their rows are joined apart.
HOT = 1000
#: What a vector travels as: its id, copies, error bound and code.
HEAD = np.dtype([("rep", "<i8"), ("copies", "<i8"), ("error", "<f4")])


@cache
def hash_directions(dim: int, cells: int, tables: int) -> list[list[np.ndarray]]:
    """For each table the direction matrices whose extreme direction and sign name a cell; of whole numbers, so that products with codes are exact."""
    rng = np.random.default_rng(SEED)
    out = []
    for _ in range(tables):
        parts, left = [], float(cells)
        while left > 1.5:
            k = min(dim, max(1, math.ceil(left / 2)))
            parts.append(np.rint(rng.standard_normal((dim, k)) * 4096))
            left /= 2 * k
        out.append(parts)
    return out


def cells_of(codes: np.ndarray, cells: int, tables: int) -> np.ndarray:
    """(n, tables) cell numbers of codes (whole numbers as doubles)."""
    out = np.zeros((len(codes), tables), dtype=np.int64)
    for t, parts in enumerate(hash_directions(codes.shape[1], cells, tables)):
        for directions in parts:
            p = codes @ directions
            at = np.abs(p).argmax(axis=1)
            positive = p[np.arange(len(p)), at] > 0
            out[:, t] = out[:, t] * (2 * directions.shape[1]) + 2 * at + positive
    return out


@cache
def projections(dim: int) -> np.ndarray:
    return np.random.default_rng(SEED + 1).standard_normal((dim, PROJECTIONS))


def coded(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of unit vectors and how far each code's own direction lies from its vector, rounded up."""
    codes = np.rint(unit * (127 / np.abs(unit).max(axis=1, keepdims=True)))
    error = np.linalg.norm(unit - codes / np.linalg.norm(codes, axis=1, keepdims=True), axis=1)
    return codes.astype(np.int8), np.nextafter((error + 1e-12).astype(np.float32), np.float32(2))


def least_count(miss: float) -> int:
    """The most collisions that a pair at the threshold reaches but for ``miss``."""
    p = math.erf(WIDE / math.sqrt(2))
    lost = 0.0
    for k in range(PROJECTIONS + 1):
        lost += math.comb(PROJECTIONS, k) * p**k * (1 - p) ** (PROJECTIONS - k)
        if lost > miss:
            return k
    return PROJECTIONS


@cache
def tables_for(dim: int, cells: int, threshold: float, miss: float) -> int:
    """Tables after which a pair at the threshold has shared a cell but for ``miss``."""
    if cells <= 1:
        return 1
    rng = np.random.default_rng(SEED + 2)
    x = rng.standard_normal((SIMULATED, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.standard_normal((SIMULATED, dim))
    z -= (z * x).sum(axis=1, keepdims=True) * x
    z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
    y = threshold * x + math.sqrt(1 - threshold**2) * z
    a, b = (cells_of(coded(v)[0].astype(np.float64), cells, 16) for v in (x, y))
    meet = float((a == b).mean())
    return 1 if meet >= 1 else max(1, math.ceil(math.log(miss) / math.log(1 - meet)))


def _double(raws: list[bytes], dtype: str) -> np.ndarray:
    v = np.frombuffer(b"".join(raws), dtype).reshape(len(raws), -1).astype(np.float64)
    return v / np.abs(v).max(axis=1, keepdims=True)  # no overflow in the norm


def _raw(v: pa.Scalar, dtype: str) -> bytes | None:
    """A vector's bytes; none if it is null, zero or has a null or non-finite component."""
    if not v.is_valid or not len(v) or v.values.null_count:
        return None
    a = v.values.to_numpy(zero_copy_only=False).astype(dtype) + 0.0  # -0.0 becomes 0.0
    return a.tobytes() if np.isfinite(a).all() and a.any() else None


def _keyed(dtype: str):
    """(vec_id, key, dim, code, error) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = [_raw(v, dtype) if i.is_valid else None for i, v in zip(batch.column("vec_id"), batch.column("vec"), strict=True)]
            keys = [None if r is None else hashlib.blake2b(r, digest_size=16).digest() for r in raws]
            codes: list = [None] * len(raws)
            errors: list = [None] * len(raws)
            by_size: dict[int, list[int]] = {}
            for i, r in enumerate(raws):
                if r is not None:
                    by_size.setdefault(len(r), []).append(i)
            for rows in by_size.values():
                v = _double([raws[i] for i in rows], dtype)
                found, error = coded(v / np.linalg.norm(v, axis=1, keepdims=True))
                for i, c, e in zip(rows, found, error.tolist(), strict=True):
                    codes[i], errors[i] = c.tobytes(), e
            dims = [None if c is None else len(c) for c in codes]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(keys, pa.binary()), pa.array(dims, pa.int32()), pa.array(codes, pa.binary()), pa.array(errors, pa.float32())], names=["vec_id", "key", "dim", "code", "error"])

    return run


def _cells(plan: dict[int, tuple[int, int]], nodes: bool):
    """(t, dim, cell) of each vector and table, and what the vector travels as if ``nodes``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 2000):
                batch = whole.slice(k, 2000)
                dims = batch.column("dim").to_numpy()
                codes, rep, copies, error = (batch.column(c) for c in ("code", "rep", "copies", "error"))
                for dim in np.unique(dims).tolist():
                    at = np.flatnonzero(dims == dim)
                    raw = [codes[i].as_py() for i in at.tolist()]
                    cells, tables = plan[dim]
                    found = cells_of(np.frombuffer(b"".join(raw), np.int8).reshape(len(at), dim).astype(np.float64), cells, tables)
                    out = [np.tile(np.arange(tables, dtype=np.int32), len(at)), np.full(found.size, dim, dtype=np.int32), found.ravel()]
                    names = ["t", "dim", "cell"]
                    if nodes:
                        head = np.empty(len(at), dtype=HEAD)
                        for name, of in (("rep", rep), ("copies", copies), ("error", error)):
                            head[name] = of.to_numpy()[at]
                        packed = [head[i].tobytes() + r for i, r in enumerate(raw)]
                        out.append(pa.array([x for x in packed for _ in range(tables)], pa.binary()))
                        names.append("node")
                    yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in out], names=names)

    return run


def _links(threshold: float, least: int, plan: dict[int, tuple[int, int]]):
    """Links within one block, or between two, of a cell: counts and stars; pairs that the codes leave open have an ``other``."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        t, dim, lo, hi = key[0].as_py(), key[1].as_py(), key[3].as_py(), key[4].as_py()
        out = {c: np.zeros(0, dtype=np.int64) for c in ("rep", "links", "root")}
        pairs = (out["rep"], out["rep"])
        if table.num_rows > 1:
            nodes = np.frombuffer(b"".join(table.column("node").to_pylist()), dtype=np.dtype([("head", HEAD), ("code", "i1", (dim,))]))
            rep, copies, error = (nodes["head"][c] for c in ("rep", "copies", "error"))
            block = table.column("block").to_numpy()
            code = nodes["code"].astype(np.float64)
            v = code / np.linalg.norm(code, axis=1, keepdims=True)
            a = np.flatnonzero(block == lo)
            b = a if lo == hi else np.flatnonzero(block == hi)
            x, y = collisions(v @ projections(dim), a, b, WIDE * math.sqrt(2 - 2 * threshold), least)
            keep = (x < y) if lo == hi else np.ones(len(x), dtype=bool)
            x, y = x[keep], y[keep]
            cosine = np.concatenate([np.zeros(0), *((v[x[i : i + 65536]] * v[y[i : i + 65536]]).sum(axis=1) for i in range(0, len(x), 65536))])
            bound = error[x].astype(np.float64) + error[y] + error[x].astype(np.float64) * error[y] + 1e-9
            near = cosine + bound >= threshold
            x, y, sure = x[near], y[near], cosine[near] - bound[near] >= threshold
            if t and len(x):  # not met in an earlier table
                met = np.unique(np.concatenate([x, y]))
                cells = cells_of(code[met], plan[dim][0], t)
                first = (cells[np.searchsorted(met, x)] != cells[np.searchsorted(met, y)]).all(axis=1)
                x, y, sure = x[first], y[first], sure[first]
            pairs = (rep[x[~sure]], rep[y[~sure]])
            x, y = x[sure], y[sure]
            links, root = np.zeros(len(rep), dtype=np.int64), rep.copy()
            np.add.at(links, x, copies[y])
            np.add.at(links, y, copies[x])
            while True:  # least id of each local component
                before = root.copy()
                low = np.minimum(root[x], root[y])
                np.minimum.at(root, x, low)
                np.minimum.at(root, y, low)
                if (root == before).all():
                    break
            some = links > 0
            out = {"rep": rep[some], "links": links[some], "root": root[some]}
        n, m = len(out["rep"]), len(pairs[0])
        return pa.table(
            {
                "rep": pa.array(np.concatenate([out["rep"], pairs[0]])),
                "links": pa.array(np.concatenate([out["links"], np.zeros(m, dtype=np.int64)])),
                "root": pa.array(np.concatenate([out["root"], pairs[0]])),
                "other": pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(pairs[1])]),
            }
        )

    return run


def collisions(p: np.ndarray, a: np.ndarray, b: np.ndarray, width: float, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs (of a, of b) that collide on at least ``least`` columns of ``p``."""
    count = np.zeros((len(a), len(b)), dtype=np.uint8)
    for j in range(p.shape[1]):
        order = np.argsort(p[b, j], kind="stable")
        line = p[b, j][order]
        rank = np.empty(len(b), dtype=np.uint16)
        rank[order] = np.arange(len(b), dtype=np.uint16)
        low = np.searchsorted(line, p[a, j] - width, side="left").astype(np.uint16)
        high = np.searchsorted(line, p[a, j] + width, side="right").astype(np.uint16)
        count += (rank[None, :] - low[:, None]) < (high - low)[:, None]  # unsigned: one comparison for both ends
    x, y = np.nonzero(count >= least)
    return a[x], b[y]


def _verified(dtype: str, threshold: float):
    """Of pairs with both vectors, those whose cosine in double precision is at least the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for v, w in zip(batch.column("v"), batch.column("w"), strict=True):
                x, y = (_double([_raw(u, dtype)], dtype)[0] for u in (v, w))
                keep.append(bool((x @ y) / (math.sqrt(x @ x) * math.sqrt(y @ y)) >= threshold))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    return run


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.9, miss: float = 0.0005, cell: int = 512, block: int = 1024) -> DataFrame:
    """(id, n_links, component_id, kept), one row a row.

    Vectors that are null, zero, of null or non-finite components, or of a null id link
    with nothing; so do vectors of different lengths. Equal vectors, of repeated ids too,
    are other vectors to each other; unlike vectors of one id share their links. Empty table:
    empty result. ``block`` may be 65,535 at most.
    """
    dtype = "<f4" if isinstance(df.schema[vec_col].dataType.elementType, T.FloatType) else "<f8"
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("vec"))
    keyed = rows.mapInArrow(_keyed(dtype), "vec_id long, key binary, dim int, code binary, error float")
    nodes = keyed.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), *[F.first(c).alias(c) for c in ("dim", "code", "error")])
    nodes = staged(nodes, "vector-nodes")
    counts = {r["dim"]: r["count"] for r in nodes.groupBy("dim").count().collect()}  # a row for each length of vector
    plan = {dim: (cells := max(1, n // cell), tables_for(dim, cells, threshold, miss / 2)) for dim, n in counts.items()}
    hot = nodes.mapInArrow(_cells(plan, False), "t int, dim int, cell long").groupBy("t", "dim", "cell").count().where(F.col("count") > block)
    hot = staged(hot.select("t", "dim", "cell", F.ceil(F.col("count") / block).cast("int").alias("blocks")), "vector-hot")
    dealt = (
        nodes.mapInArrow(_cells(plan, True), "t int, dim int, cell long, node binary")
        .join(hot, ["t", "dim", "cell"], "left")
        .withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("t", "dim", "cell", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "node")
    )
    found = dealt.groupBy("t", "dim", "cell", "lo", "hi").applyInArrow(_links(threshold, least_count(miss / 2), plan), "rep long, links long, root long, other long")
    found = staged(found, "vector-links")
    sure = found.where("other is null")
    links, edges = sure.select("rep", "links"), sure.select(F.col("rep").alias("src"), F.col("root").alias("dst"))
    close = found.where("other is not null").select(F.least("rep", "other").alias("a"), F.greatest("rep", "other").alias("b"))
    if not close.isEmpty():
        # only vectors of such pairs are read again
        asked = staged(close.select(F.explode(F.array("a", "b")).alias("vec_id")).distinct(), "vector-asked")
        vectors = rows.join(asked, "vec_id", "left_semi").join(nodes.select(F.col("rep").alias("vec_id"), "key", "dim", "copies"), "vec_id")
        vectors = staged(_own(vectors, dtype), "vector-exact")
        both = close.join(vectors.select(F.col("vec_id").alias("a"), F.col("vec").alias("v")), "a").join(vectors.select(F.col("vec_id").alias("b"), F.col("vec").alias("w")), "b")
        true = staged(both.mapInArrow(_verified(dtype, threshold), "a long, b long"), "vector-true")
        many = vectors.select("vec_id", "copies")
        ends = true.select(F.col("a").alias("rep"), F.col("b").alias("vec_id")).unionByName(true.select(F.col("b").alias("rep"), F.col("a").alias("vec_id")))
        links = links.unionByName(ends.join(many, "vec_id").select("rep", F.col("copies").alias("links")))
        edges = edges.unionByName(true.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    links = links.groupBy("rep").agg(F.sum("links").alias("links"))
    roots = components(edges, "vector")
    named = nodes.select("key", "rep", "copies").join(links, "rep", "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    named = staged(named.select("key", "copies", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "rep").alias("component_id")), "vector-named")
    return _named_rows(keyed.select("vec_id", "key"), named, id_col)


def _own(vectors: DataFrame, dtype: str) -> DataFrame:
    """Of rows (vec_id, vec, key, copies) the ones whose vector has the key, one a node: an id may be repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = [_raw(v, dtype) for v in batch.column("vec")]
            keep = [r is not None and hashlib.blake2b(r, digest_size=16).digest() == k for r, k in zip(raws, batch.column("key").to_pylist(), strict=True)]
            yield batch.filter(pa.array(keep, pa.bool_())).select(["vec_id", "vec", "key", "copies"])

    kind = vectors.schema["vec"].dataType.simpleString()
    return vectors.select("vec_id", "vec", "key", "copies").mapInArrow(run, f"vec_id long, vec {kind}, key binary, copies long").dropDuplicates(["vec_id", "key"])


def _named_rows(of: DataFrame, named: DataFrame, id_col: str) -> DataFrame:
    """Rows (vec_id, key) with their node's values: rows without a node and rows of the few nodes with very many copies are joined apart."""
    of = staged(of, "vector-rows")
    n = of.count()
    hot = named.where(F.col("copies") * HOT > n).drop("copies")  # fewer than HOT nodes
    rest = named.where(F.col("copies") * HOT <= n).drop("copies")
    valid = of.where("key is not null")
    most = valid.join(F.broadcast(hot), "key")
    others = valid.join(F.broadcast(hot.select("key")), "key", "left_anti").join(rest, "key")
    none = of.where("key is null").select("key", "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = most.select(none.columns).unionByName(others.select(none.columns)).unionByName(none)
    return out.select(F.col("vec_id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS src, b.vec_id AS dst FROM v a JOIN v b
  ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach(src, dst) AS (
  SELECT src, dst FROM links UNION
  SELECT r.src, l.dst FROM reach r JOIN links l ON l.src = r.dst),
least AS (SELECT src, least(src, min(dst)) AS component_id FROM reach GROUP BY src),
counted AS (SELECT src, count(*) AS n_links FROM links GROUP BY src)
SELECT e.vec_id, coalesce(n_links, 0) AS n_links, coalesce(component_id, e.vec_id) AS component_id,
       e.vec_id = coalesce(component_id, e.vec_id) AS kept
FROM embeddings e LEFT JOIN least l ON l.src = e.vec_id LEFT JOIN counted c ON c.src = e.vec_id
"""
