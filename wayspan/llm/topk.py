"""Exact top-k search by a three-phase uniform threshold.

The dimensions are cut into slices; a slice's inner products are one list of scores, and a
row's score is the sum over the lists. Rows and queries meet in blocks.

1. Each block gathers, for each query, the best rows of each slice's list with their sums.
   The k-th best sum of all blocks is a safe cutoff t: k rows reach it.
2. The cutoff goes out with its query. A row of score t or more has t / slices or more in
   at least one list, so entries from there on are sufficient.
3. What the other lists hold for these entries is added, which gives exact scores; a
   block sends on its k best at or above the cutoff, and the k best of these are the answer.

Sums are of whole numbers and never rounded. Blocks are dealt by a hash of the row's
number, so that copies spread; a task holds one block of rows and one of queries.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .vectors import LEAST, NONE, alike, as_long, best, floored, fresh, ids_of, matrix, products

#: Lists that a score is summed over; rows and queries of a block; queries scored at a time.
SLICES, ROWS, QUERIES, STEP = 2, 2048, 1024, 128


def _scored(queries: pa.Table, rows: pa.Table, dim: int):
    """For each step of queries: their places, one array of partial scores a slice and the sums; a query's own row has none."""
    q, x = (matrix(t.column("code").to_pylist(), dim) for t in (queries, rows))
    number, own = rows.column("row").to_numpy(), queries.column("row").to_numpy()
    order = np.argsort(number)
    at = np.minimum(np.searchsorted(number, own, sorter=order), len(number) - 1)
    at = np.where(number[order[at]] == own, order[at], -1)
    cuts = np.linspace(0, dim, SLICES + 1).astype(int)
    for begin in range(0, len(q), STEP):
        here = np.arange(begin, min(begin + STEP, len(q)))
        parts = alike([products(q[here, a:b], x[:, a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
        mine = np.flatnonzero(at[here] >= 0)
        for p in parts:
            p[mine, at[here][mine]] = NONE
        yield here, parts, sum(parts[1:], parts[0])


def _lists(k: int):
    """(query_row, score): the best sums of the rows that lead a slice's list."""

    def run(key: tuple, queries: pa.Table, rows: pa.Table) -> pa.Table:
        found = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        if queries.num_rows and rows.num_rows:
            number = queries.column("row").to_numpy()
            for here, parts, total in _scored(queries, rows, key[0].as_py()):
                most = min(k, rows.num_rows)
                lead = np.sort(np.concatenate([np.argsort(-p, axis=1, kind="stable")[:, :most] if p.dtype == object else np.argpartition(-p, most - 1, axis=1)[:, :most] for p in parts], axis=1), axis=1)
                sums = np.take_along_axis(total, lead, axis=1)
                sums[:, 1:][lead[:, 1:] == lead[:, :-1]] = NONE  # leads two lists
                sums = -np.sort(-sums, axis=1)[:, :k]
                i, j = np.nonzero(sums > NONE)
                found[0].append(number[here[i]])
                found[1].append(as_long(sums[i, j]))
        return pa.table({"query_row": np.concatenate(found[0]), "score": np.concatenate(found[1])})

    return run


def _sufficient(k: int):
    """(query_row, query_id, id, score): of the entries that can reach the cutoff, the block's k best."""

    def run(key: tuple, queries: pa.Table, rows: pa.Table) -> pa.Table:
        out = []
        if queries.num_rows and rows.num_rows:
            ids, null = ids_of(rows)
            number, own = queries.column("row").to_numpy(), queries.column("id").to_numpy()
            cut = np.array([NONE if c is None or c == LEAST else c for c in queries.column("cutoff").to_pylist()], dtype=object)
            for here, parts, total in _scored(queries, rows, key[0].as_py()):
                least = cut[here] if total.dtype == object else cut[here].astype(np.float64)
                enough = parts[0] * SLICES >= least[:, None]
                for p in parts[1:]:
                    enough |= p * SLICES >= least[:, None]
                i, j = np.nonzero(enough & (total > NONE))
                score = as_long(total[i, j])
                reach = score >= least[i]
                i, j, score = i[reach], j[reach], score[reach]
                keep = best(i, score, ids[j], null[j], k)
                i, j = here[i[keep]], j[keep]
                out.append(pa.table({"query_row": number[i], "query_id": own[i], "id": pa.array(ids[j], mask=null[j]), "score": score[keep]}))
        return pa.concat_tables(out) if out else pa.table({c: pa.array([], pa.int64()) for c in ("query_row", "query_id", "id", "score")})

    return run


def top_k(df: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 5) -> DataFrame:
    """(query_id, rank, id, score): the ``k`` rows (all, if fewer) of the highest inner products with each query row.

    A query is compared with every row but its own; rows of a repeated id are rows each, and
    each query row has its own ``k``, whose ranks then stand beside the others of that id.
    Equal scores go by ascending id, a null id last. Vectors that are null or hold a null or non-finite
    component take no part; vectors of other lengths have no score with each other; vectors
    without components score 0. Scores beyond a long count as its end. Empty table: empty result.
    """
    coded = floored(df, id_col, vec_col, "topk-rows", query=F.coalesce(is_query, F.lit(False)))
    sizes = coded.groupBy("dim").agg(F.count("*").alias("n"), F.count_if("query").alias("queries")).collect()  # a row a length of vector
    plan = df.sparkSession.createDataFrame([(r.dim, max(1, -(-r.n // ROWS)), max(1, -(-r.queries // QUERIES))) for r in sizes], "dim int, blocks int, query_blocks int")
    dealt = coded.join(plan, "dim")
    block, query_block = F.pmod(F.xxhash64("row"), "blocks").cast("int"), F.pmod(F.xxhash64("row"), "query_blocks").cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    on = ["dim", "i", "j"]
    rows = fresh(dealt.select("dim", every("query_blocks").alias("i"), block.alias("j"), "row", "id", "code")).groupBy(on)
    queries = dealt.where("query")

    lists = queries.select("dim", query_block.alias("i"), every("blocks").alias("j"), "row", "code").groupBy(on).cogroup(rows).applyInArrow(_lists(k), "query_row long, score long")
    by_score = Window.partitionBy("query_row").orderBy(F.desc("score"))
    lead = lists.withColumn("place", F.row_number().over(by_score)).where(F.col("place") <= k)
    cutoff = lead.groupBy(F.col("query_row").alias("row")).agg(F.when(F.count("*") >= k, F.min("score")).alias("cutoff"))
    asked = queries.join(cutoff, "row", "left").select("dim", query_block.alias("i"), every("blocks").alias("j"), "row", "id", "code", "cutoff")
    entries = asked.groupBy(on).cogroup(rows).applyInArrow(_sufficient(k), "query_row long, query_id long, id long, score long")
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return entries.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")


ORACLE = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.r, q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(q.e, v.e) AS BIGINT) AS score
  FROM v q JOIN v ON v.r <> q.r AND len(v.e) = len(q.e) WHERE q.vec_id % 50 = 0)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored) WHERE rank <= 5
"""
