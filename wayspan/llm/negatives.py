"""Hard-negative mining over Hilbert-ordered blocks with zone maps.

Rows are sorted along a Hilbert curve through all dimensions and written as Parquet in
blocks; each block has a zone map, the least and greatest component in every dimension and
the range of its labels. The products of an anchor's components with a zone's ends
bound its inner products with all rows of the block (interval arithmetic), so a block is read
for an anchor only if its bounds meet one of the anchor's windows of scores:

1. Positives: a block must be able to reach the anchor's k-th best same-label score in its own block.
2. Negatives: a window is a share of a positive's score. The own block gives the
   n-th best score of each window first; others must reach that and lie in the window.

Anchors travel to blocks in chunks; a task holds one chunk and one block. Scores are sums
of whole numbers and never rounded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import col, staged
from .vectors import NONE, alike, as_long, best, floored, fresh, ids_of, matrix, products

#: Bits a dimension of the curve; rows a block; anchors a chunk; zones a task weighs at once; anchors scored at a time; blocks a sorting task writes.
BITS, ROWS, ANCHORS, ZONES, STEP, RUN = 4, 1024, 1024, 1024, 128, 16


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Keys (rows of bytes) of whole-number cells along a Hilbert curve of all columns, by the transposed form of the curve."""
    x, (n, dim) = cells.astype(np.int64).T.copy(), cells.shape
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for i in range(dim):
            turned = (x[i] >> b & 1).astype(bool)
            swap = np.where(turned, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(turned, low, swap)
            x[i] ^= swap
    for i in range(1, dim):
        x[i] ^= x[i - 1]
    flip = np.zeros(n, dtype=np.int64)
    for b in range(bits - 1, 0, -1):
        flip ^= np.where(x[dim - 1] >> b & 1, (1 << b) - 1, 0)
    x ^= flip
    planes = np.stack([x >> b & 1 for b in range(bits - 1, -1, -1)])  # bit, dimension, row
    return np.packbits(planes.reshape(bits * dim, n).T.astype(np.uint8), axis=1)


def _keyed(low: float, width: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, codes = batch.column("dim").to_numpy(), batch.column("code").to_pylist()
            keys: list = [b""] * len(codes)
            for dim in np.unique(dims[dims > 0]).tolist():
                at = np.flatnonzero(dims == dim)
                cell = np.floor((matrix([codes[i] for i in at.tolist()], dim) - low) * ((1 << BITS) / width))
                for i, k in zip(at.tolist(), hilbert(np.clip(cell, 0, (1 << BITS) - 1), BITS), strict=True):
                    keys[i] = k.tobytes()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.binary())], names=[*batch.schema.names, "key"])

    return run


def _range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(low, high): a row a batch, the least and greatest component."""
    for batch in batches:
        dims, codes = batch.column("dim").to_numpy(), batch.column("code").to_pylist()
        parts = [matrix([codes[i] for i in np.flatnonzero(dims == d).tolist()], d) for d in np.unique(dims[dims > 0]).tolist()]
        if parts:
            yield pa.RecordBatch.from_pydict({"low": [min(float(p.min()) for p in parts)], "high": [max(float(p.max()) for p in parts)]})


def _blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with their block: each ``ROWS`` rows of one length along the sorted partition."""
    block, held, dim = (TaskContext.get().partitionId() << 32) - 1, ROWS, None
    for batch in batches:
        out = np.empty(batch.num_rows, dtype=np.int64)
        for i, d in enumerate(batch.column("dim").to_pylist()):
            if held == ROWS or d != dim:
                block, held, dim = block + 1, 0, d
            out[i], held = block, held + 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[*batch.schema.names, "block"])


def _zone(positives: int):
    """A block's zone map, as a row; and each of its anchors with its k-th best same-label score within the block."""

    def run(table: pa.Table) -> pa.Table:
        dim = table.column("dim")[0].as_py()
        x, labels = matrix(table.column("code").to_pylist(), dim), table.column("label").to_numpy()
        block, n = table.column("block")[0].as_py(), table.num_rows
        rows = {"block": [block], "dim": [dim], "low": [x.min(axis=0).tobytes() if n else b""], "high": [x.max(axis=0).tobytes() if n else b""], "label_low": [int(labels.min())], "label_high": [int(labels.max())]}
        rows |= {"row": [None], "id": [None], "label": [None], "code": [None], "floor": [None]}
        at = np.flatnonzero(table.column("anchor").to_numpy(zero_copy_only=False).astype(bool))
        codes, number, (ids, _) = table.column("code").to_pylist(), table.column("row").to_numpy(), ids_of(table)
        for begin in range(0, len(at), STEP):
            here = at[begin : begin + STEP]
            score = products(x[here], x)
            score[labels[here][:, None] != labels[None, :]] = NONE
            score[np.arange(len(here)), here] = NONE
            kth = -np.sort(-score, axis=1)[:, positives - 1] if n >= positives else np.full(len(here), NONE)
            for i, s in zip(here.tolist(), kth.tolist(), strict=True):
                for c, v in (("block", block), ("dim", dim), ("row", number[i]), ("id", ids[i]), ("label", labels[i]), ("code", codes[i]), ("floor", None if s == NONE else int(as_long(np.array([s]))[0])), *((c, None) for c in ("low", "high", "label_low", "label_high"))):
                    rows[c].append(v)
        return pa.table(rows, schema=pa.schema([("block", pa.int64()), ("dim", pa.int32()), ("low", pa.binary()), ("high", pa.binary()), ("label_low", pa.int64()), ("label_high", pa.int64()), ("row", pa.int64()), ("id", pa.int64()), ("label", pa.int64()), ("code", pa.binary()), ("floor", pa.int64())]))

    return run


ZONED = "block long, dim int, low binary, high binary, label_low long, label_high long, row long, id long, label long, code binary, floor long"
#: An anchor and its windows: rows from ``least`` to ``most`` of each.
ANCHOR = "row long, id long, label long, code binary, home long, least array<long>, most array<long>"


def _chosen(same: bool):
    """(block, row): blocks whose score bounds meet a window of the anchor and that may hold a row of its label (or of another)."""

    def run(key: tuple, anchors: pa.Table, zones: pa.Table) -> pa.Table:
        out = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        if anchors.num_rows and zones.num_rows:
            dim = key[0].as_py()
            a = matrix(anchors.column("code").to_pylist(), dim)
            low, high = (np.stack([np.frombuffer(z, "<f8") for z in zones.column(c).to_pylist()]) for c in ("low", "high"))
            plus, minus = np.maximum(a, 0), np.minimum(a, 0)
            ends = alike([products(plus, high), products(minus, low), products(plus, low), products(minus, high)])
            upper, lower = ends[0] + ends[1], ends[2] + ends[3]
            label, first, last = anchors.column("label").to_numpy(), zones.column("label_low").to_numpy(), zones.column("label_high").to_numpy()
            may = (first[None, :] <= label[:, None]) & (label[:, None] <= last[None, :]) if same else (first[None, :] != label[:, None]) | (last[None, :] != label[:, None])
            block, row, home = zones.column("block").to_numpy(), anchors.column("row").to_numpy(), anchors.column("home").to_numpy()
            may &= home[:, None] != block[None, :]
            least, most = anchors.column("least").to_pylist(), anchors.column("most").to_pylist()
            for i in range(len(row)):
                meets = np.zeros(len(block), dtype=bool)
                for lo, hi in zip(least[i], most[i], strict=True):
                    meets |= (upper[i] >= (NONE if lo is None else lo)).astype(bool) & (lower[i] <= (np.inf if hi is None else hi)).astype(bool)
                j = np.flatnonzero(meets & may[i])
                out[0].append(block[j])
                out[1].append(np.full(len(j), row[i]))
        return pa.table({"block": np.concatenate(out[0]), "row": np.concatenate(out[1])})

    return run


def _read(same: bool, k: int):
    """(anchor_row, window, id, score): the k best rows of the block in each window of each anchor."""

    def run(key: tuple, anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out = []
        if anchors.num_rows and rows.num_rows:
            dim = rows.column("dim")[0].as_py()
            ids, null = ids_of(rows)
            x, labels, number = matrix(rows.column("code").to_pylist(), dim), rows.column("label").to_numpy(), rows.column("row").to_numpy()
            a, label, own = matrix(anchors.column("code").to_pylist(), dim), anchors.column("label").to_numpy(), anchors.column("row").to_numpy()
            least, most = anchors.column("least").to_pylist(), anchors.column("most").to_pylist()
            for begin in range(0, len(a), STEP):
                here = np.arange(begin, min(begin + STEP, len(a)))
                score = products(a[here], x)
                fits = (label[here][:, None] == labels[None, :]) == same
                fits &= own[here][:, None] != number[None, :]
                for w in range(max((len(least[i]) for i in here), default=0)):
                    ends = [[v[i][w] if w < len(v[i]) else none for i in here] for v, none in ((least, np.inf), (most, NONE))]
                    lo = np.array([NONE if v is None else v for v in ends[0]], dtype=score.dtype)
                    hi = np.array([np.inf if v is None else v for v in ends[1]], dtype=score.dtype)
                    i, j = np.nonzero(fits & (score >= lo[:, None]).astype(bool) & (score <= hi[:, None]).astype(bool))
                    found = as_long(score[i, j])
                    keep = best(i, found, ids[j], null[j], k)
                    i, j = here[i[keep]], j[keep]
                    out.append(pa.table({"anchor_row": own[i], "window": np.full(len(i), w, dtype=np.int32), "id": pa.array(ids[j], mask=null[j]), "score": found[keep]}))
        none = {"anchor_row": pa.int64(), "window": pa.int32(), "id": pa.int64(), "score": pa.int64()}
        return pa.concat_tables(out) if out else pa.table({c: pa.array([], t) for c, t in none.items()})

    return run


class Blocks:
    """The blocks of a table, their zone maps and its anchors, all staged."""

    def __init__(self, rows: DataFrame, positives: int):
        spark = rows.sparkSession
        ends = rows.mapInArrow(_range, "low double, high double").agg(F.min("low").alias("low"), F.max("high").alias("high")).first()
        low, width = ends.low or 0.0, max(1.0, (ends.high or 0.0) - (ends.low or 0.0))
        keyed = rows.mapInArrow(_keyed(low, width), f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in rows.schema)}, key binary")
        parts = max(1, -(-rows.count() // (ROWS * RUN)))
        # the row's number breaks ties: copies of one vector may fill many blocks
        sort = ["dim", "key", "row"]
        sorted_rows = keyed.repartitionByRange(parts, *sort).sortWithinPartitions(*sort).drop("key")
        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
        self.rows = staged(sorted_rows.mapInArrow(_blocked, f"{kinds}, block long"), "negatives-blocks")
        zoned = staged(self.rows.groupBy("block").applyInArrow(_zone(positives), ZONED), "negatives-zones")
        self.zones = zoned.where("row is null").select("block", "dim", "low", "high", "label_low", "label_high")
        self.anchors = zoned.where("row is not null").select("dim", "row", "id", "label", "code", F.col("block").alias("home"), "floor")
        zones = {r["dim"]: r["count"] for r in self.zones.groupBy("dim").count().collect()}  # a row a length of vector
        anchors = {r["dim"]: r["count"] for r in self.anchors.groupBy("dim").count().collect()}
        self.plan = spark.createDataFrame([(d, -(-n // ZONES), max(1, -(-anchors.get(d, 0) // ANCHORS))) for d, n in zones.items()], "dim int, zone_parts int, chunks int")

    def search(self, anchors: DataFrame, same: bool, k: int, home: bool) -> DataFrame:
        """(anchor_row, window, id, score): the best rows in the anchors' windows, in their own block or in those that the zone maps leave."""
        chunk = F.pmod(F.xxhash64("row"), "chunks").cast("int").alias("chunk")
        anchors = anchors.join(self.plan, "dim").select("*", chunk)
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        cols = ["row", "id", "label", "code", "home", "least", "most"]
        if home:
            sent = anchors.select(F.col("home").alias("block"), "chunk", *cols)
        else:
            part = F.pmod(F.xxhash64("block"), "zone_parts").cast("int").alias("part")
            zones = self.zones.join(self.plan, "dim").select("*", part).select("*", every("chunks").alias("chunk"))
            on = ["dim", "chunk", "part"]
            pairs = anchors.select("*", every("zone_parts").alias("part")).groupBy(on).cogroup(fresh(zones).groupBy(on)).applyInArrow(_chosen(same), "block long, row long")
            sent = pairs.join(anchors.select("chunk", *cols), "row").select("block", "chunk", *cols)
        sent = staged(sent, "negatives-sent")
        read = self.rows.join(sent.select("block", "chunk").distinct(), "block")
        on = ["block", "chunk"]
        return sent.groupBy(on).cogroup(fresh(read).groupBy(on)).applyInArrow(_read(same, k), "anchor_row long, window int, id long, score long")


def _top(rows: DataFrame, by: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def hard_negatives(df: DataFrame, is_anchor: Column, id_col: str = "vec_id", vec_col: str = "embedding", label: Column | None = None, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Positives are an anchor's best other rows of its label; negatives the best rows of
    another label with low * positive <= 100 * negative <= high * positive. Equal scores go by
    ascending id, a null id last. Rows with a null label, a null vector or a null or non-finite component
    take no part; vectors of other lengths have no score with each other. Rows of a
    repeated id are rows each; a repeated anchor has its own result. A positive of a score below 0 has
    no window, one without negatives no row. Scores beyond a long count as its end. Empty table: empty result.
    """
    own = (col("label") if label is None else label).cast("long")
    rows = floored(df.where(own.isNotNull()), id_col, vec_col, "negatives-rows", label=own, anchor=F.coalesce(is_anchor, F.lit(False)))
    if rows.isEmpty():
        return df.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    blocks = Blocks(rows, positives)
    open_end = F.array(F.lit(None).cast("long"))
    asked = blocks.anchors.select("*", F.array("floor").alias("least"), open_end.alias("most"))
    near = blocks.search(asked, True, positives, True).unionByName(blocks.search(asked, True, positives, False))
    near = staged(_top(near, ["anchor_row"], positives).select(F.col("anchor_row").alias("row"), (F.col("place") - 1).alias("window"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "negatives-positives")

    # the window's ends in whole numbers; decimals, as products with a long may not fit one
    wide = F.col("positive_score").cast("decimal(38,0)")
    ends = near.withColumn("lo", F.ceil(wide * low / 100).cast("long")).withColumn("hi", F.floor(wide * high / 100).cast("long"))
    in_order = F.array_sort(F.collect_list(F.struct("window", "lo", "hi")))
    windows = ends.groupBy("row").agg(in_order.alias("w"))
    asked = staged(blocks.anchors.join(windows, "row").select("dim", "row", "id", "label", "code", "home", F.col("w.lo").alias("least"), F.col("w.hi").alias("most")), "negatives-windows")
    first = staged(_top(blocks.search(asked, False, negatives, True), ["anchor_row", "window"], negatives).drop("place"), "negatives-first")
    full = first.groupBy("anchor_row", "window").agg(F.when(F.count("*") >= negatives, F.min("score")).alias("nth"))
    floors = ends.join(full.withColumnRenamed("anchor_row", "row"), ["row", "window"], "left").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("window", F.coalesce(F.greatest("lo", "nth"), "lo").alias("lo"), "hi"))).alias("w"))
    rest = blocks.anchors.join(floors, "row").select("dim", "row", "id", "label", "code", "home", F.col("w.lo").alias("least"), F.col("w.hi").alias("most"))
    found = _top(first.unionByName(blocks.search(rest, False, negatives, False)), ["anchor_row", "window"], negatives)
    named = found.withColumnsRenamed({"anchor_row": "row", "id": "negative_id", "score": "negative_score", "place": "rank"}).join(near, ["row", "window"])
    return named.join(blocks.anchors.select("row", F.col("id").alias("anchor_id")), "row").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


ORACLE = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.r, a.vec_id AS anchor_id, a.label = v.label AS same, v.r AS other, v.vec_id, CAST(list_inner_product(a.e, v.e) AS BIGINT) AS score
  FROM v a JOIN v ON v.r <> a.r AND len(v.e) = len(a.e) WHERE a.vec_id % 50 = 0),
positives AS (
  SELECT r, anchor_id, other, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) <= 5),
ranked AS (
  SELECT p.anchor_id, p.positive_id, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score,
         CAST(row_number() OVER (PARTITION BY p.r, p.other ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
  FROM positives p JOIN scored s ON s.r = p.r AND NOT s.same
  WHERE 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 3
"""
