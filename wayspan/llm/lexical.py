"""Ranked lexical search by presence masks.

Documents become rows of terms and counts, kept only where a bit of the term's hash
is set among the items' terms (a map of fixed size; what passes by chance is dropped by the
exact terms later). A block of items meets a shard of documents in one task. There each item
groups the shard's documents by the mask of its terms that they hold, built by OR-ing each
term's bit into its documents' masks. A mask's maximum score takes every term of
it at the shard's highest count and shortest document. Masks are evaluated exactly, by descending
maximum, until the k-th best score found lies above the next maximum.

A first wave over one shard in ``WAVE`` gives each item a floor, its k-th best score there, so
that in the others masks below it end the work at once.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import col, slices, staged
from .vectors import best, ids_of

#: The scale of weights and of counts, and the part of the length in a document's m, in hundredths.
WEIGHT, COUNT, LENGTH = 1000, 1_000_000_000, 90
#: Bits of the terms' map (a byte each in memory); documents a shard; items a block; shards of the first wave are one in so many; documents evaluated at first.
BUCKETS, DOCS, ITEMS, WAVE, FIRST = 1 << 20, 2048, 256, 16, 64
#: What is no part of a term becomes a blank, A-Z becomes a-z; bytes of other characters stay.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def bucket(term: bytes) -> int:
    return zlib.crc32(term) & (BUCKETS - 1)


def _profiled(flags: bytes | None):
    """(row, id, n, terms, counts) of each text; terms by the flags of their buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                n, terms, counts = [], [], []
                for text in batch.column("text").cast(pa.binary()).to_pylist():
                    words = [] if text is None else text.translate(TABLE).split(b" ")
                    found = Counter(words)
                    n.append(len(words) - found.pop(b"", 0))
                    if flags is not None:
                        found = {t: c for t, c in found.items() if flags[zlib.crc32(t) & (BUCKETS - 1)]}
                    terms.append(list(found))
                    counts.append(list(found.values()))
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), pa.array(terms, pa.list_(pa.binary())), pa.array(counts, pa.list_(pa.int64()))], names=["id", "n", "terms", "counts"])

    return run


def profiles(df: DataFrame, id_col: str, text_col: str, flags: bytes | None, name: str) -> DataFrame:
    """(row, id, n, terms, counts), staged: a row a text, null ones too."""
    rows = df.select(col(id_col).cast("long").alias("id"), col(text_col).cast("string").alias("text"))
    found = rows.mapInArrow(_profiled(flags), "id long, n long, terms array<binary>, counts array<long>")
    return staged(found.select(F.monotonically_increasing_id().alias("row"), *found.columns), name)


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(sorted({bucket(t) for t in batch.column("term").to_pylist()}), pa.int32())})


class Shard:
    """One shard of documents: for each of the terms asked for, the documents that hold it and their counts."""

    def __init__(self, docs: pa.Table, vocabulary: dict[bytes, int]):
        terms, counts = docs.column("terms").combine_chunks(), docs.column("counts").combine_chunks()
        number = np.array([vocabulary.get(t, -1) for t in pc.list_flatten(terms).to_pylist()], dtype=np.int64)
        size = pc.list_value_length(terms).to_numpy()
        doc = np.repeat(np.arange(docs.num_rows), size)
        count = pc.list_flatten(counts).to_numpy()
        known = np.flatnonzero(number >= 0)
        known = known[np.argsort(number[known], kind="stable")]
        self.doc, self.count = doc[known], count[known]
        self.begin = np.searchsorted(number[known], np.arange(len(vocabulary) + 1))
        self.length = docs.column("m").to_numpy()
        self.shortest = int(self.length.min()) if docs.num_rows else 0
        self.ids, self.null = ids_of(docs)

    def postings(self, term: int) -> slice:
        return slice(self.begin[term], self.begin[term + 1])


def saturated(count, m):
    return (COUNT * count) // (WEIGHT * count + 8 * m)


def ranked(shard: Shard, terms: list[int], weights: np.ndarray, floor: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores): the item's ``k`` best documents of the shard with a score above 0 and from ``floor`` on."""
    held = [(t, shard.postings(t), w) for t, w in zip(terms, weights.tolist(), strict=True)]
    held = [(p, w) for t, p, w in held if p.stop > p.start]
    none = np.zeros(0, dtype=np.int64)
    if not held:
        return none, none
    words = -(-len(held) // 64)
    mask = np.zeros((len(shard.length), words), dtype=np.uint64)
    for b, (p, _) in enumerate(held):
        mask[shard.doc[p], b // 64] |= np.uint64(1 << (b % 64))
    docs = np.flatnonzero(mask.any(axis=1))
    if words == 1:
        distinct, group = np.unique(mask[docs, 0], return_inverse=True)
        distinct = distinct[:, None]
    else:
        distinct, group = np.unique(mask[docs], axis=0, return_inverse=True)
    group = group.reshape(-1)
    most = np.array([w * saturated(int(shard.count[p].max()), shard.shortest) for p, w in held], dtype=np.int64)
    maximum = np.zeros(len(distinct), dtype=np.int64)
    for b in range(len(held)):
        maximum += np.where((distinct[:, b // 64] >> np.uint64(b % 64)) & np.uint64(1), most[b], 0)

    entry = np.concatenate([shard.doc[p] for p, _ in held])
    gain = np.concatenate([np.full(p.stop - p.start, w) for p, w in held])
    count = np.concatenate([shard.count[p] for p, _ in held])
    by_maximum = np.argsort(-maximum, kind="stable")
    place = np.empty(len(distinct), dtype=np.int64)
    place[by_maximum] = np.arange(len(distinct))
    order = np.argsort(place[group], kind="stable")  # documents by their mask's maximum
    ends = np.cumsum(np.bincount(place[group], minlength=len(distinct)))
    total = np.zeros(len(shard.length), dtype=np.int64)
    found, step, done, least = none, FIRST, 0, max(1, floor)
    while done < len(distinct) and maximum[by_maximum[done]] >= least:
        reach = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + step)))
        reach = min(reach, len(distinct))
        new = docs[order[(ends[done - 1] if done else 0) : ends[reach - 1]]]
        asked = np.zeros(len(shard.length), dtype=bool)
        asked[new] = True
        e = np.flatnonzero(asked[entry])
        np.add.at(total, entry[e], gain[e] * saturated(count[e], shard.length[entry[e]]))
        found = np.concatenate([found, new])
        found = found[total[found] >= least]
        found = found[best(np.zeros(len(found), dtype=np.int8), total[found], shard.ids[found], shard.null[found], k)]
        if len(found) == k:
            least = max(least, int(total[found].min()))
        done, step = reach, 2 * step
    return found, total[found]


def _ranked(k: int):
    """(item_row, item_id, id, score): the shard's best documents of each item."""

    def run(key: tuple, items: pa.Table, docs: pa.Table) -> pa.Table:
        out = {"item_row": [], "item_id": [], "id": [], "score": []}
        if items.num_rows and docs.num_rows:
            vocabulary: dict[bytes, int] = {}
            numbered = [[vocabulary.setdefault(t, len(vocabulary)) for t in terms] for terms in items.column("terms").to_pylist()]
            shard = Shard(docs, vocabulary)
            columns = [items.column(c).to_pylist() for c in ("row", "id", "weights", "floor")]
            for terms, row, item, weights, floor in zip(numbered, *columns, strict=True):
                found, score = ranked(shard, terms, np.array(weights, dtype=np.int64), floor or 0, k)
                out["item_row"] += [row] * len(found)
                out["item_id"] += [item] * len(found)
                out["id"] += [None if shard.null[i] else int(shard.ids[i]) for i in found.tolist()]
                out["score"] += score.tolist()
        return pa.table({c: pa.array(v, pa.int64()) for c, v in out.items()})

    return run


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", k: int = 10) -> DataFrame:
    """(item_id, rank, id, score): each item's ``k`` documents of the highest scores above 0, all of them if fewer.

    Equal scores go by ascending id, a null id last. Rows of a repeated id are documents each; a
    repeated item row has a ranking of its own, whose ranks then stand beside the other's. Null texts, and those without a
    letter, digit or character beyond ASCII, hold no term: such documents are found for no item, such
    items find none. Empty table of either: empty result.
    """
    spark = docs.sparkSession
    asked = profiles(items, item_col, item_text, None, "lexical-items")
    terms = staged(asked.select(F.explode("terms").alias("term")).distinct(), "lexical-terms")
    flags = bytearray(BUCKETS)
    for r in terms.mapInArrow(_buckets, "bucket int").distinct().toLocalIterator():  # BUCKETS rows at most
        flags[r.bucket] = 1
    found = profiles(docs, id_col, text_col, bytes(flags), "lexical-documents")
    total = found.agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("length"), F.count("*").alias("rows")).first()
    n, length = int(total.docs), max(1, int(total.length))
    df = found.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weight = F.floor(WEIGHT * F.log(F.lit(float(2 * n + 2)) / (2 * F.col("df") + 1).cast("double"))).cast("long")
    weighed = staged(terms.join(df, "term").select("term", weight.alias("weight")), "lexical-weights")
    held = asked.select("row", "id", F.explode("terms").alias("term")).join(weighed, "term").groupBy("row").agg(F.first("id").alias("id"), F.sort_array(F.collect_list(F.struct("term", "weight"))).alias("t"))
    held = staged(held.select("row", "id", F.col("t.term").alias("terms"), F.col("t.weight").alias("weights")), "lexical-asked")

    # decimals: the product may go beyond a long
    m = 100 - LENGTH + F.floor(F.lit(LENGTH * n).cast("decimal(24,0)") * F.col("n").cast("decimal(14,0)") / F.lit(length).cast("decimal(20,0)")).cast("long")
    shards, blocks = max(1, -(-int(total.rows) // DOCS)), max(1, -(-held.count() // ITEMS))
    shard = F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int").alias("shard")
    block = F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("block")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    sent = found.where(F.size("terms") > 0).select(shard, "id", m.alias("m"), "terms", "counts").select("*", every(blocks).alias("block"))
    on, by_item = ["shard", "block"], Window.partitionBy("item_row").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    best_of = lambda rows: rows.withColumn("rank", F.row_number().over(by_item)).where(F.col("rank") <= k)

    def wave(inside, floors: DataFrame | None) -> DataFrame:
        one = held.join(floors, "row", "left") if floors is not None else held.withColumn("floor", F.lit(None).cast("long"))
        one = one.select("row", "id", "terms", "weights", "floor", block).select("*", every(shards).alias("shard")).where(inside)
        return one.groupBy(on).cogroup(sent.where(inside).groupBy(on)).applyInArrow(_ranked(k), "item_row long, item_id long, id long, score long")

    first = staged(best_of(wave(F.col("shard") % WAVE == 0, None)).drop("rank"), "lexical-first")
    floors = first.groupBy(F.col("item_row").alias("row")).agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
    out = best_of(first.unionByName(wave(F.col("shard") % WAVE != 0, floors)))
    return out.select(F.col("item_id").alias(item_col), "rank", F.col("id").alias(id_col), "score")


TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER.format('text')}, '{TERM}') AS terms FROM documents WHERE text IS NOT NULL),
sized AS (SELECT r, doc_id, CAST(len(terms) AS BIGINT) AS n FROM d WHERE len(terms) > 0),
total AS (SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(n) AS BIGINT) AS l FROM sized),
held AS (SELECT r, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT r, unnest(terms) AS term FROM d) GROUP BY r, term),
weighed AS (SELECT term, CAST(floor(1000 * ln((2 * t.n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM held, total t GROUP BY term, t.n),
items AS (SELECT DISTINCT i, item_id, unnest(terms) AS term FROM (SELECT row_number() OVER () AS i, item_id, regexp_extract_all({_LOWER.format('text')}, '{TERM}') AS terms FROM benchmark WHERE text IS NOT NULL)),
scored AS (
  SELECT i.i, any_value(i.item_id) AS item_id, h.r, CAST(sum(w.w * ((1000000000 * h.tf) // (1000 * h.tf + 8 * (10 + (90 * s.n * t.n) // t.l)))) AS BIGINT) AS score
  FROM items i JOIN held h ON h.term = i.term JOIN weighed w ON w.term = i.term JOIN sized s ON s.r = h.r CROSS JOIN total t GROUP BY i.i, h.r)
SELECT item_id, rank, doc_id, score FROM (
  SELECT s.item_id, d.doc_id, s.score, CAST(row_number() OVER (PARTITION BY s.i ORDER BY s.score DESC, d.doc_id) AS INTEGER) AS rank
  FROM scored s JOIN d ON d.r = s.r WHERE s.score > 0) WHERE rank <= 10
"""
