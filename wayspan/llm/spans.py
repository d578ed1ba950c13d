"""Substring dedup by sliding sentence spans.

Texts are cut into sentences: at line ends, and behind ``.``, ``!`` or ``?`` before white
space. A sentence of more than ``LONG`` words is cut further, behind the word of least hash
of each window of ``NEAR`` words (of equal ones the last): so the cuts depend on the words
at hand alone and fall alike wherever a passage stands, whatever is before and behind it, and no
piece has more than ``LONG`` words. From every sentence starts one span, and up to every sentence goes
one: the shortest run of ``run`` sentences or more that holds ``words`` words or more.
A passage that holds a span so has all its whole sentences covered, and at most ``LONG``
words at each end lie outside them. Span hashes are joined over the
whole corpus, a second hash is compared, and sentences covered by a span that is not the first of its kind (least
id, then position) go.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import staged, with_text_columns

#: Where sentences end. One step a character: the mark is looked back for from the white space.
END = re.compile(r"\n|(?<=[.!?])[\x20\x09\x0B-\x0D]")
#: Words of a sentence that stays whole, words of a window of cuts.
LONG, NEAR = 16, 15
#: Bits held beside a sentence's place (of 31 bits): a span's further sentences, then a text's hash.
REST_BITS = 32
#: Word hashes that a task keeps.
KEPT = 100_000


def cuts(words: list[str], known: dict[str, int]) -> list[int]:
    """The words behind which a long sentence is cut: the least of each window, and the last word."""
    if len(known) > KEPT:
        known.clear()
    hashes = [known[w] if w in known else known.setdefault(w, xxhash.xxh3_64_intdigest(w)) for w in words]
    out, best = [], -1
    for end in range(NEAR - 1, len(hashes)):
        start = end + 1 - NEAR
        if best < start:
            window = hashes[start : end + 1][::-1]
            best = end - window.index(min(window))
        elif hashes[end] <= hashes[best]:
            best = end
        else:
            continue
        out.append(best)
    if not out or out[-1] != len(words) - 1:
        out.append(len(words) - 1)
    return out


def sentences(text: str, known: dict[str, int] | None = None) -> list[tuple[int, int, int, int]]:
    """(start, end, words, hash) of each sentence with a word; hashes are of the words, joined by spaces. ``known``: word hashes so far."""
    out, begin, known = [], 0, {} if known is None else known
    for end in [*(m.start() for m in END.finditer(text)), len(text)]:
        words = text[begin:end].split()
        if 0 < len(words) <= LONG:
            out.append((begin, end, len(words), xxhash.xxh3_64_intdigest(" ".join(words))))
        elif words:
            start, first, at = begin, 0, begin
            for last in cuts(words, known):
                for w in words[first : last + 1]:
                    at = text.index(w, at) + len(w)
                stop = at if last < len(words) - 1 else end
                out.append((start, stop, last + 1 - first, xxhash.xxh3_64_intdigest(" ".join(words[first : last + 1]))))
                start, first = stop, last + 1
        begin = end
    return out


def spans(found: list[tuple[int, int, int, int]], run: int, words: int) -> list[tuple[int, int, int, int]]:
    """(first, last, hash, check) of the shortest span from each sentence and of the shortest up to each, as far as they fit.

    Where a span from some sentence ends, none up to there is needed: of a passage that holds the
    one, its first sentence's span or a later one ends there too.
    """
    n = len(found)
    hashes = np.array([s[3] for s in found], dtype=np.uint64).tobytes()
    total = np.concatenate([[0], np.cumsum([s[2] for s in found], dtype=np.int64)])
    stop = np.maximum(np.searchsorted(total, total[:-1] + words, side="left"), np.arange(n) + run)
    start = np.minimum(np.searchsorted(total, total[1:] - words, side="right") - 1, np.arange(n) + 1 - run)
    ranges = [(i, e) for i, e in enumerate(stop.tolist()) if e <= n]
    met = set(stop.tolist())
    ranges += [(i, e) for e, i in enumerate(start.tolist(), 1) if i >= 0 and e not in met]
    return [(i, e - 1, xxhash.xxh3_64_intdigest(hashes[8 * i : 8 * e]) - (1 << 63), (xxhash.xxh32_intdigest(hashes[8 * i : 8 * e]) & 0xFFFF) - (1 << 15)) for i, e in ranges]


def _setup(run: int, words: int):
    def setup():
        known: dict[str, int] = {}

        def columns(texts: pa.Array) -> list[pa.Array]:
            cut = [sentences(x.as_py() or "", known) for x in texts]
            of = [spans(c, run, words) for c in cut]
            key = [0 if not x.is_valid else xxhash.xxh3_64_intdigest(x.as_py().encode("utf-8", "surrogatepass")) - (1 << 63) for x in texts]
            ints = pa.list_(pa.int32())
            return [
                pa.array(key, pa.int64()),
                pa.array([[s[0] for s in c] for c in cut], ints),
                pa.array([[s[1] for s in c] for c in cut], ints),
                pa.array([np.cumsum([0, *(s[2] for s in c)], dtype=np.int32) for c in cut], ints),  # words before each sentence, and all
                pa.array([[s[2] for s in o] for o in of], pa.list_(pa.int64())),
                pa.array([[s[3] for s in o] for o in of], pa.list_(pa.int16())),
                pa.array([[s[0] for s in o] for o in of], ints),
                pa.array([[s[1] - s[0] for s in o] for o in of], ints),
            ]

        return columns

    return setup


def repeated_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = 2, words: int = 20) -> DataFrame:
    """(id, n_sentences, n_removed, removed_words, removed: ranges of characters), one row a row.

    A range covers removed sentences that follow each other; ``without`` cuts them out.
    Null, empty and short texts have nothing removed. A row that repeats another in id and
    text counts as the same text, with the same result; null ids come after all others.
    An empty table gives an empty result.
    """
    more_bits = max(run, words).bit_length()  # a span has `run` or `words` sentences at most
    mark_bits = REST_BITS - more_bits
    if mark_bits < 1:
        raise ValueError("run and words are under 2 ** 31")
    ints = T.ArrayType(T.IntegerType())
    fields = [T.StructField("key", T.LongType()), *[T.StructField(n, ints) for n in ("starts", "ends", "words")], T.StructField("hashes", T.ArrayType(T.LongType())), T.StructField("checks", T.ArrayType(T.ShortType())), *[T.StructField(n, ints) for n in ("firsts", "mores")]]
    cut = with_text_columns(df, text_col, [id_col], fields, _setup(run, words)).withColumnRenamed(id_col, "id")
    mark = F.pmod("key", F.lit(1 << mark_bits))
    own = F.when(F.col("id").isNull(), F.col("key"))  # null, and so least, for texts with an id
    cut = staged(cut.withColumns({"mark": mark, "own": own}).drop("key"), "spans", "zstd")
    # texts of one id are told apart by some bits of their key (27 by default) beside the sentence, texts without an id by `own`
    each = cut.select("own", "id", "mark", F.explode(F.arrays_zip("hashes", "checks", "firsts", "mores")).alias("span"))
    # spans of one hash that start at one place are one span, so a place may hold their length too
    spot = F.shiftleft(F.shiftleft(F.col("span.firsts").cast("long"), more_bits) + F.col("span.mores"), mark_bits) + F.col("mark")
    each = each.select(F.col("span.hashes").alias("hash"), F.col("span.checks").alias("check"), F.struct("own", "id", spot.alias("spot")).alias("place"))
    # only what repeats, and written: the join then has plain shuffles on both sides, so that
    # Spark can split the rows of a very common passage over tasks
    first = each.groupBy("hash").agg(F.min(F.struct("place", "check")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    first = staged(first, "spans-first", "zstd")
    # 80 bits decide: a span whose second hash is another than the first one's stays
    later = each.join(first, "hash").where("place <> first.place and check = first.check")
    spot = F.col("place.spot")
    at = F.shiftright(spot, mark_bits + more_bits).cast("int")
    text = [F.col("place.own").alias("own"), F.col("place.id").alias("id"), spot.bitwiseAND((1 << mark_bits) - 1).alias("mark")]
    later = later.select(*text, at.alias("at"), (at + F.shiftright(spot, mark_bits).bitwiseAND((1 << more_bits) - 1).cast("int")).alias("last"))
    # spans that meet are drawn together to ranges of sentences, row by row, before a text's are collected
    by = W.partitionBy("own", "id", "mark").orderBy("at", "last")
    before = F.max("last").over(by.rowsBetween(W.unboundedPreceding, -1))
    ranges = later.withColumn("new", F.coalesce(F.col("at") > before + 1, F.lit(True)).cast("int")).withColumn("number", F.sum("new").over(by.rowsBetween(W.unboundedPreceding, 0)))
    ranges = ranges.groupBy("own", "id", "mark", "number").agg(F.min("at").alias("at"), F.max("last").alias("last"))
    gone = ranges.groupBy("own", "id", "mark").agg(F.array_sort(F.collect_list(F.struct("at", "last"))).alias("gone"))
    same = F.col("c.own").eqNullSafe(F.col("g.own")) & F.col("c.id").eqNullSafe(F.col("g.id")) & (F.col("c.mark") == F.col("g.mark"))
    out = cut.drop("hashes", "checks", "firsts", "mores").alias("c").join(gone.alias("g"), same, "left")
    out = out.select("c.*", F.coalesce("gone", F.expr("array()")).alias("gone"))
    return out.select(
        F.col("id").alias(id_col),
        F.size("starts").cast("long").alias("n_sentences"),
        F.expr("aggregate(gone, 0L, (a, r) -> a + r.last - r.at + 1)").alias("n_removed"),
        F.expr("aggregate(gone, 0L, (a, r) -> a + words[r.last + 1] - words[r.at])").alias("removed_words"),
        F.expr("transform(gone, r -> named_struct('from', starts[r.at], 'to', ends[r.last]))").alias("removed"),
    )


def without(text: str, removed: list[tuple[int, int]]) -> str:
    """The text without the ranges, as ``repeated_spans`` gives them."""
    out, at = [], 0
    for begin, end in removed:
        out.append(text[at:begin])
        at = end
    return "".join([*out, text[at:]])
