"""Near duplicates by the Jaccard similarity of word shingles: SimHash groups and MinHash keys, verified exactly.

A text's shingles are the distinct runs of ``WIDTH`` words (a shorter text is one shingle). Their SimHash
fingerprints are linked by Golay-code fuzzy hashing (``simhash``), and each group of fingerprints is a
key of its texts. A pair at similarity 0.8 differs in some 10 of 64 bits, which that doesn't reach, so
``BANDS`` keys of ``ROWS`` least hashes each are added. Two texts at similarity s
share one with probability 1 - (1 - s ** ROWS) ** BANDS, so of pairs at exactly 0.8 about
3 in a million share none. All that share a key are candidates, and a link is a candidate
pair whose shingle sets are at least ``LEAST`` alike.

Groups need the links' components only, not every pair. So each member of a key is first
compared with one leader of the key, then with its member of most links; only pairs of a
key that are then still in different components are compared one by one, and of those only
such as a parity sketch lets through: a bit for each of ``SKETCH`` x 64 classes of hashes,
set where the class has an odd number of shingles. Two sketches never differ in more bits
than the sets in shingles, so no pair in reach is lost. Joins are merged, as in ``simhash``: staged keys, sets and sketches
of copies take far less room in their files than in memory.
"""

from __future__ import annotations

from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import simhash
from .common import WORD, col, components, staged, with_text_columns

#: Words of a shingle, least similarity, MinHash bands and rows, the seed of XXH64.
WIDTH, LEAST = 5, 0.8
BANDS, ROWS = 24, 4
SEED = 42
#: Words of 64 bits of a sketch.
SKETCH = 8
#: Shingle hashes that are permuted at a time.
CHUNK = 8_192
_RANDOM = np.random.default_rng(SEED)
FLIPS, ODDS = (_RANDOM.integers(0, 1 << 64, (BANDS * ROWS, 1), dtype=np.uint64) for _ in range(2))
ODDS |= np.uint64(1)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct XXH64 of the word shingles; words as in ``simhash.fingerprint``. No word: none."""
    return np.unique(simhash.hashes(text, WIDTH))


def keys(found: np.ndarray) -> list[int]:
    """The keys of the bands; none without shingles."""
    if not len(found):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(found), CHUNK):
        least = np.minimum(least, ((found[i : i + CHUNK] ^ FLIPS) * ODDS).min(axis=1))
    rows = least.reshape(BANDS, ROWS)
    return [xxhash.xxh64_intdigest(row.tobytes(), seed=band) - (1 << 63) for band, row in enumerate(rows)]


def sketch(found: np.ndarray) -> list[int]:
    """The number of shingles, then the parities."""
    odd = np.bincount((found % np.uint64(64 * SKETCH)).astype(np.int64), minlength=64 * SKETCH) & 1
    return [len(found), *np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8").tolist()]


def _keys():
    def columns(texts: pa.Array) -> list[pa.Array]:
        found = [shingles(x.as_py()) for x in texts]
        fp = np.array([simhash.majority(x) for x in found], dtype=np.uint64).view(np.int64)
        return [*[pa.array([of(x) for x in found], pa.list_(pa.int64())) for of in (keys, sketch)], pa.array(fp)]

    return columns


def _shingles():
    return lambda texts: [pa.array([shingles(x.as_py()).view(np.int64) for x in texts], pa.list_(pa.int64()))]


def node_of(text_col: str) -> Column:
    """One node for equal texts, and node 0 for all texts without a word."""
    return F.when(col(text_col).rlike(WORD), F.xxhash64(col(text_col))).otherwise(F.lit(0).cast("long"))


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The (src, dst) whose shingle sets are at least ``LEAST`` alike."""
    pairs = staged(pairs, "jaccard-pairs")  # plain shuffles on both sides: Spark can split a leader's rows
    both = pairs.join(sets.select(F.col("node").alias("src"), F.col("set").alias("a")).hint("merge"), "src").join(sets.select(F.col("node").alias("dst"), F.col("set").alias("b")).hint("merge"), "dst")
    shared = F.size(F.array_intersect("a", "b"))
    # in whole numbers: shared / union >= 0.8
    return staged(both.where(shared * 100 >= round(LEAST * 100) * (F.size("a") + F.size("b") - shared)).select("src", "dst"), "jaccard-links")


def fuzzy_keys(of: DataFrame) -> DataFrame:
    """(node, key): the group of SimHash fingerprints (node, fp) that a text belongs to, linked at 3 or fewer differing bits."""
    fps = staged(of.select("fp").distinct(), "jaccard-fps")
    near = simhash.linked(fps).withColumnRenamed("node", "fp")
    return of.join(near.hint("merge"), "fp", "left").select("node", F.xxhash64(F.lit("simhash"), F.coalesce("root", "fp")).alias("key"))


def _stars(members: DataFrame, rank: Column) -> DataFrame:
    """Pairs of each member with the member of its key that is least by ``rank``."""
    leaders = members.groupBy("key").agg(F.min(F.struct(rank, "node"))["node"].alias("leader"))
    pairs = members.join(staged(leaders, "jaccard-leaders").hint("merge"), "key").where("node <> leader")
    return pairs.select(F.least("node", "leader").alias("src"), F.greatest("node", "leader").alias("dst")).distinct()


def groups(df: DataFrame, text_col: str = "text") -> DataFrame:
    """(node, root): the nodes (see ``node_of``) that have links, with the least node they reach."""
    texts = df.select(node_of(text_col).alias("node"), col(text_col).cast("string").alias("text")).where("node <> 0")
    of = staged(with_text_columns(texts, "text", ["node"], [*[T.StructField(n, T.ArrayType(T.LongType())) for n in ("keys", "sketch")], T.StructField("fp", T.LongType())], _keys), "jaccard")
    fuzzy = staged(fuzzy_keys(of.select("node", "fp")), "jaccard-fuzzy")
    every = of.select("node", F.explode("keys").alias("key")).unionByName(fuzzy).distinct()
    shared = staged(every.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "jaccard-shared")
    members = staged(every.join(shared.hint("merge"), "key").select("key", "node"), "jaccard-members")
    some = texts.join(members.select("node").distinct().hint("merge"), "node", "left_semi").groupBy("node").agg(F.min("text").alias("text"))
    sets = staged(with_text_columns(some, "text", ["node"], [T.StructField("set", T.ArrayType(T.LongType()))], _shingles), "jaccard-sets")
    links = _similar(_stars(members, F.xxhash64("key", "node")), sets)
    degree = links.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("n"))
    ranked = staged(members.join(degree.hint("merge"), "node", "left").select("key", "node", F.coalesce(-F.col("n"), F.lit(0)).alias("rank")), "jaccard-ranked")
    links = links.union(_similar(_stars(ranked, F.col("rank")).join(links.hint("merge"), ["src", "dst"], "left_anti"), sets))
    apart = members.join(components(links, "jaccard").hint("merge"), "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    # keys whose members are all of one group are done
    mixed = staged(apart.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("key"), "jaccard-mixed")
    apart = apart.join(mixed.hint("merge"), "key", "left_semi").join(of.select("node", "sketch").dropDuplicates(["node"]).hint("merge"), "node")
    apart = staged(apart.select("key", "node", "root", *[F.col("sketch")[i].alias(f"s{i}") for i in range(SKETCH + 1)]), "jaccard-apart")
    other = apart.select("key", F.col("node").alias("dst"), F.col("root").alias("far"), *[F.col(f"s{i}").alias(f"t{i}") for i in range(SKETCH + 1)])
    differ = reduce(add, [F.bit_count(F.col(f"s{i}").bitwiseXOR(F.col(f"t{i}"))) for i in range(1, SKETCH + 1)])
    # at similarity s the sets differ in (1 - s) / (1 + s) of the sum of their sizes at most
    near = differ * round(100 + 100 * LEAST) <= (F.col("s0") + F.col("t0")) * round(100 - 100 * LEAST)
    pairs = apart.join(other.hint("merge"), (apart["key"] == other["key"]) & (F.col("node") < F.col("dst")) & (F.col("root") != F.col("far")) & near)
    pairs = pairs.select(F.col("node").alias("src"), "dst").distinct()
    return components(links.union(_similar(pairs, sets)), "jaccard")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(node, id, root, component_id: the least id reachable by links), one row for each distinct id and node.

    Texts without words are one group. Null ids take part in groups but never name one; a
    group of null ids only has a null component_id.
    """
    rows = staged(df.select(node_of(text_col).alias("node"), col(id_col).alias("id")).distinct(), "jaccard-rows")
    named = rows.join(groups(df, text_col).hint("merge"), "node", "left").select("node", "id", F.coalesce("root", "node").alias("root"))
    named = staged(named, "jaccard-named")
    least = staged(named.groupBy("root").agg(F.min("id").alias("component_id")), "jaccard-least")
    return named.join(least.hint("merge"), "root").select("node", "id", "root", "component_id")
