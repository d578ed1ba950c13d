"""Mixing sources to target weights by hash-threshold histograms.

Each source has a target of words; all its documents are repeated as often as the target
holds its size, and the rest of the target is taken from those documents whose hash lies
under a threshold. Thresholds are found without sorting: words are summed by source and
the top bits of the hash, the bucket where the running sum passes the budget is refined
by the next bits, again for that bucket only, and last by single hashes. Documents under
a lower budget are also under a higher one (nested), and hashes depend on id and text alone,
so reruns agree. Documents at the very threshold hash share the last words in proportion.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import col, n_words, staged

#: Weights of sources in code-point order, repeating; times that a document may be taken.
WEIGHTS = (1, 2, 3)
MOST = 3
#: Bits of a hash, and bits by which each of two levels refines it.
HASH_BITS, LEVEL_BITS = 60, 12


def hash60(id_col: str, text_col: str):
    """60 bits of an MD5 of id (null: as the text 'null') and text: unlike texts of one id, or without one, are apart."""
    named = F.concat_ws(":", F.coalesce(col(id_col).cast("string"), F.lit("null")), F.coalesce(F.md5(col(text_col).cast("string")), F.lit("null")))
    return F.conv(F.substring(F.md5(named), 1, 15), 16, 10).cast("long")


def targets(totals: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """(s, source_size, target) of totals (s, source_size): each source's weight's share of all words, at most ``most`` times its size.

    What is cut off goes to the others by weight, until none is above. In the order of
    size by weight: when the level of a unit of weight passes a source's limit, that
    source stops there and the level rises for the rest; so the highest level is the last one. Windows over
    a row a source, and no texts.
    """
    every = W.partitionBy()
    rank = F.row_number().over(every.orderBy(F.col("s").asc_nulls_last()))
    rows = totals.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((rank - 1) % len(weights) + 1).cast("int")))
    rows = rows.withColumn("cap", F.col("source_size") * most)
    order = every.orderBy(F.col("cap") / F.col("weight"), F.col("s").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    gone = lambda c: F.coalesce(F.sum(c).over(order), F.lit(0))
    left, weight = F.sum("source_size").over(every) - gone("cap"), F.sum("weight").over(every) - gone("weight")
    rows = rows.withColumn("level", left.cast("double") / weight.cast("double"))
    return rows.select("s", "source_size", F.least(F.col("cap").cast("double"), F.max("level").over(every) * F.col("weight")).alias("target"))


def thresholds(sized: DataFrame, budget: DataFrame) -> DataFrame:
    """(source, edge, below, at): the hash where each budget is met, words under it and at it.

    ``sized``: (source, size, hash); ``budget``: (s, extra). Sources whose extra is 0 have
    no row. ``budget`` has a row a source, so it is the small side of the first join.
    """
    rows = sized.where("size > 0").join(budget.where("extra > 0"), F.col("source").eqNullSafe(F.col("s")))
    rows = rows.select("source", "size", "hash", "extra", F.lit(0).cast("long").alias("below"))
    for level in (HASH_BITS - LEVEL_BITS, HASH_BITS - 2 * LEVEL_BITS, 0):
        bucket = F.shiftright("hash", level)
        sums = rows.groupBy("source", bucket.alias("edge")).agg(F.sum("size").alias("at"), F.first("extra").alias("extra"), F.first("below").alias("below"))
        # at most 2^12 buckets a source; at the last level the hashes of one bucket in 2^24
        run = F.sum("at").over(W.partitionBy("source").orderBy("edge").rowsBetween(W.unboundedPreceding, 0)) + F.col("below")
        edge = sums.withColumn("upto", run).where("upto >= extra and upto - at < extra").select(F.col("source").alias("s"), "edge", (F.col("upto") - F.col("at")).alias("below"), "at")
        edge = staged(edge, "mix-edge")
        if level:
            rows = rows.drop("below").join(edge, F.col("source").eqNullSafe(F.col("s")) & (bucket == F.col("edge")))
            rows = staged(rows.select("source", "size", "hash", "extra", "below"), "mix-boundary")
    return edge


def goals(sized: DataFrame, weights, most: int) -> DataFrame:
    """A row a source: (s, source_size, target, repeats, extra, edge, below, at)."""
    totals = staged(sized.groupBy(F.col("source").alias("s")).agg(F.sum("size").alias("source_size")), "mix-totals")
    # whole repeats, and the words of the rest, cut to whole words
    whole, some = F.floor("target").cast("long"), F.col("source_size") > 0
    goal = targets(totals, weights, most).withColumns({"repeats": F.when(some, F.expr("floor(target) div source_size")).otherwise(0).cast("long"), "extra": F.when(some, whole % F.col("source_size")).otherwise(0).cast("long")})
    goal = staged(goal, "mix-targets")
    edge = thresholds(sized, goal.select("s", "extra")).withColumnRenamed("s", "t")
    return staged(goal.join(edge, F.col("s").eqNullSafe(F.col("t")), "left").drop("t"), "mix-goal")


def sizes(df: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    sized = df.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), n_words(text_col).alias("size"), hash60(id_col, text_col).alias("hash"))
    return staged(sized, "mix-sized")


def taken():
    """Words taken of a row of (size, hash, and its source's goal)."""
    part = F.when(F.col("hash") < F.col("edge"), F.col("size"))
    part = part.when(F.col("hash") == F.col("edge"), F.floor(F.col("size") * (F.col("extra") - F.col("below")) / F.col("at")))
    return (F.col("repeats") * F.col("size") + F.coalesce(part, F.lit(0))).cast("long")


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """(id, size, source_size, target, taken), one row a row.

    Null and empty texts have size 0 and are taken 0 words; rows of a null source form a
    source of their own, last in order. Rows equal in id and text have equal hashes, and so share
    their part of the last words evenly, cut to whole words.
    An empty table gives an empty result.
    """
    sized = sizes(df, id_col, text_col, source_col)
    goal = goals(sized, weights, most)
    return sized.join(goal, F.col("source").eqNullSafe(F.col("s"))).select(F.col("id").alias(id_col), "size", "source_size", "target", taken().alias("taken"))


def repeated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """The mixed corpus: rows of ``df``, each as often as the mix takes it.

    A part of half a document or more counts as the whole. Texts are read with the goals
    of their source beside them (a row a source), and never shuffled.
    """
    goal = goals(sizes(df, id_col, text_col, source_col), weights, most)
    row = df.select(F.struct(*[col(c) for c in df.columns]).alias("row"), F.col(source_col).cast("string").alias("source"), n_words(text_col).alias("size"), hash60(id_col, text_col).alias("hash"))
    times = F.when(F.col("size") > 0, F.floor(taken() / F.col("size") + 0.5)).otherwise(0).cast("int")
    dealt = row.join(goal, F.col("source").eqNullSafe(F.col("s"))).select("row", times.alias("times")).where("times > 0")
    return dealt.select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(concat(coalesce(CAST(doc_id AS VARCHAR), 'null'), ':', coalesce(md5(text), 'null'))), 1, 15) AS BIGINT) AS hash
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight
  FROM sized GROUP BY source),
ordered AS (
  SELECT *, 3 * source_size AS cap,
         sum(source_size) OVER () AS total, sum(weight) OVER () AS weights,
         coalesce(sum(3 * source_size) OVER w, 0) AS caps_before, coalesce(sum(weight) OVER w, 0) AS weights_before
  FROM sources
  WINDOW w AS (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
leveled AS (
  SELECT *, CAST(total - caps_before AS DOUBLE) / CAST(weights - weights_before AS DOUBLE) AS level FROM ordered),
goals AS (
  SELECT source, source_size, least(CAST(cap AS DOUBLE), max(level) OVER () * weight) AS target FROM leveled),
run AS (
  SELECT s.*, g.source_size, g.target,
         CASE WHEN g.source_size > 0 THEN CAST(floor(g.target) AS BIGINT) // g.source_size ELSE 0 END AS repeats,
         CASE WHEN g.source_size > 0 THEN CAST(floor(g.target) AS BIGINT) % g.source_size ELSE 0 END AS extra,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.hash RANGE UNBOUNDED PRECEDING) AS upto,
         sum(s.size) OVER (PARTITION BY s.source, s.hash) AS here
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       CAST(repeats * size + CASE
         WHEN upto <= extra THEN size
         WHEN upto - here < extra AND here > 0 THEN floor(CAST(size AS DOUBLE) * (extra - (upto - here)) / here)
         ELSE 0 END AS BIGINT) AS taken
FROM run
"""
