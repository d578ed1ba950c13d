"""SimHash near-dedup by Golay-code fuzzy hashing.

The perfect [23, 12] Golay code decodes every 23-bit word to the one codeword within 3
bits. A 64-bit fingerprint is cut into four segments of 16 bits (padded with zeros to
decode). Of two fingerprints that differ in at most 3 bits, one segment at least is equal, and two
others at least differ in at most one bit each (pigeonhole). For two words x, y one bit apart, the
codeword of y lies within 4 bits of x. So for each segment E and each pair (A, B) of the others a row of the
left side carries (E, own codeword in A, each near codeword in B), a row of the right side
(E, each near codeword in A, own codeword in B): a pair in reach shares a key for certain,
and the join verifies the true distance. A word has 1 or 6 near codewords, so a
fingerprint gets about 64 keys a side. A key has 40 bits: among 10^10 unlike fingerprints a
fingerprint meets about 3 others by chance. Joins are merged: Spark sizes keys by the fingerprints that
they are made of, some 40 times too low, and would send them whole to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, staged, with_text_columns

#: The Golay code's generator polynomial, a segment's bits, the seed of XXH64.
GENERATOR = 0b110001110101
BITS = 23
SEED = 42
#: Bits of each of a fingerprint's four segments.
SEGMENT = 16
#: Shingle hashes whose bits are counted at a time.
CHUNK = 65_536


def hashes(text: str | None, width: int = 3) -> np.ndarray:
    """XXH64 of the word shingles, repeats included. No word: none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, white space is 0x20 and 0x09-0x0D
    width = min(width, len(words))
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)) if words else ()
    return np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=SEED), shingles), dtype="<u8", count=len(words) - width + 1 if words else 0)


def majority(found: np.ndarray) -> int:
    """64 bits; a bit is 1 if set in over half the hashes. No hash: 0."""
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(found), CHUNK):
        part = found[i : i + CHUNK].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(found), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, width: int = 3) -> int:
    """64 bits; a bit is 1 if set in over half the XXH64 of the word shingles. No word: 0."""
    return majority(hashes(text, width))


def _setup():
    def columns(texts: pa.Array) -> list[pa.Array]:
        found = np.array([fingerprint(x.as_py()) for x in texts], dtype=np.uint64)
        return [pa.array(found.view(np.int64))]

    return columns


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long: the fingerprint's bits). Null and empty texts: 0."""
    return with_text_columns(df, text_col, [id_col], [T.StructField("fp", T.LongType())], _setup)


def syndrome(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words modulo the generator."""
    rest = words.astype(np.int64)
    for bit in range(BITS - 1, 10, -1):
        rest = np.where(rest >> bit & 1, rest ^ (GENERATOR << (bit - 11)), rest)
    return rest


@cache
def code_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By syndrome: the error of 3 bits at most, its weight, and the five errors of 4 bits (-1: none)."""

    def patterns(weight: int) -> np.ndarray:
        return np.array([sum(1 << i for i in c) for c in combinations(range(BITS), weight)] or [0], dtype=np.int64)

    error, weight = np.zeros(2048, dtype=np.int64), np.zeros(2048, dtype=np.int64)
    for w in (1, 2, 3):
        found = patterns(w)
        error[syndrome(found)], weight[syndrome(found)] = found, w
    four = patterns(4)
    of = syndrome(four)
    order = np.argsort(of, kind="stable")
    fours = np.full((2048, 5), -1, dtype=np.int64)
    fours[np.unique(of)] = four[order].reshape(-1, 5)
    return error, weight, fours


def codewords(words: np.ndarray) -> np.ndarray:
    """(n, 6): the index of the codeword within 3 bits, then of the others within 4 (-1: none)."""
    error, _, fours = code_tables()
    s = syndrome(words)
    near = np.concatenate([(words ^ error[s])[:, None], np.where(fours[s] >= 0, words[:, None] ^ fours[s], -1)], axis=1)
    return np.where(near >= 0, near >> 11, -1)  # systematic: the 12 high bits


def _keys(side: str):
    """(key, side, root) of fingerprints (fp, root): the left or right side's keys, or those of `own` codewords alone, 12 a fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, root = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("fp", "root"))
            parts = [(fps.view(np.uint64) >> np.uint64(SEGMENT * i) & np.uint64((1 << SEGMENT) - 1)).astype(np.int64) for i in range(4)]
            near = [codewords(p) for p in parts]
            for table, (equal, a, b) in enumerate((e, *pair) for e in range(4) for pair in combinations([i for i in range(4) if i != e], 2)):
                one, many = (near[b][:, :1], near[a]) if side == "right" else (near[a][:, :1], near[b] if side == "left" else near[b][:, :1])
                key = (many << 12 | one) if side == "right" else (one << 12 | many)
                row, at = np.nonzero(many >= 0)
                whole = table << 40 | parts[equal][row] << 24 | key[row, at]
                yield pa.RecordBatch.from_arrays([pa.array(whole), pa.array(fps[row]), pa.array(root[row])], names=["key", side, f"{side}_root"])

    return run


def _side(fps: DataFrame, side: str) -> DataFrame:
    fps = fps if "root" in fps.columns else fps.withColumn("root", F.col("fp"))
    return fps.select("fp", "root").mapInArrow(_keys(side), f"key long, {side} long, {side}_root long")


def _near(fps: DataFrame, distance: int) -> DataFrame:
    """Distinct fingerprints (fp, and root, else each its own) -> (left, left_root, right, right_root) of unlike roots at most ``distance`` <= 3 bits apart, some more than once."""
    if not 0 <= distance <= 3:
        raise ValueError("the keys guarantee distances of 3 bits at most")
    left, right = _side(fps, "left"), _side(fps, "right")
    return left.join(right.hint("merge"), (left["key"] == right["key"]) & (F.col("left") < F.col("right")) & (F.col("left_root") != F.col("right_root")) & (F.bit_count(F.col("left").bitwiseXOR(F.col("right"))) <= distance))


def near_pairs(fps: DataFrame, distance: int = 3) -> DataFrame:
    """All pairs (src, dst) of fingerprints (fp) at most ``distance`` <= 3 bits apart."""
    return _near(fps, distance).select(F.col("left").alias("src"), F.col("right").alias("dst")).distinct()


def stars(fps: DataFrame, distance: int = 3) -> DataFrame:
    """(src, dst): each fingerprint with the least one of each key of own codewords, where they are at most ``distance`` bits apart: 12 a fingerprint at most."""
    members = _side(fps, "own").select("key", F.col("own").alias("fp"))
    leaders = members.groupBy("key").agg(F.min("fp").alias("leader"), F.max("fp").alias("last")).where("leader <> last").select("key", "leader")
    leaders = staged(leaders, "simhash-leaders")  # written, so that the rows of a very common key can be split
    near = members.join(leaders.hint("merge"), "key").where((F.col("fp") != F.col("leader")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("leader"))) <= distance))
    return near.select(F.col("leader").alias("src"), F.col("fp").alias("dst")).distinct()


def linked(fps: DataFrame, distance: int = 3) -> DataFrame:
    """Distinct fingerprints (fp) -> (node, root): those with links, and the least fingerprint that they reach.

    Stars come first. Then the full keys join fingerprints of unlike components, and of the pairs that each has with
    another component one is kept (counted together before the shuffle): no link between components is lost, and a template
    with very many variants costs a few rows each.
    """
    star = staged(stars(fps, distance), "simhash-stars")
    first = components(star, "simhash-stars")
    named = fps.join(first.withColumnRenamed("node", "fp").hint("merge"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))
    rest = _near(staged(named, "simhash-roots"), distance).groupBy("left", "right_root").agg(F.min("right").alias("right"))
    rest = staged(rest.select(F.col("left").alias("src"), F.col("right").alias("dst")), "simhash-rest")
    return components(star.unionByName(rest), "simhash")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 3) -> DataFrame:
    """(id, fingerprint hex, component_id: the least id reachable by links, kept).

    One row a row. Texts with one fingerprint (copies, all texts without words) are one
    node, so a group of any size costs a row; links between nodes are found by the keys.
    Null ids take part in groups but never name one; a group of null ids only has a null
    component_id and is not kept. Repeated rows get equal results.
    """
    of = staged(fingerprints(df, id_col, text_col), "simhash")
    nodes = of.groupBy("fp").agg(F.min(id_col).alias("least"))
    nodes = staged(nodes, "simhash-nodes")
    roots = linked(nodes.select("fp"), distance)
    # `root` is the least fingerprint; a component's name is its least id
    named = nodes.join(roots.withColumnRenamed("node", "fp").hint("merge"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = staged(named, "simhash-named")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = named.join(least.hint("merge"), "root").select("fp", "component_id")
    return of.join(by_fp.hint("merge"), "fp").select(
        id_col,
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        "component_id",
        F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)).alias("kept"),
    )
