"""The training-corpus pipeline over `documents`, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept;
its result is written as Parquet and read again. All stages but the last return the
columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayspan.llm import jaccard, language, lines, mixing, packing
from wayspan.llm.common import col, n_words, read, staged

#: Least calibrated probability of a document's language.
LEAST_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter (null ones too) and texts of no language the model is at least half sure of.

    Rows stay as they are, repeated ones and ones without an id too. Without any row that has an
    id and a language there is nothing to learn from, and all rows go. An empty table stays empty.
    """
    own = docs.toDF(*[f"d_{c}" for c in docs.columns])  # extra columns may have any names
    found = language.languages(own, "d_doc_id", "d_text", "d_lang", keep=own.columns)
    sure = found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    return sure.select(*[col(f"d_{c}").alias(c) for c in docs.columns])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts out every line that stands before, alone or not; texts that had words and are left with none go.

    Null texts and texts without words stay as they are; rows equal in id and text are one text
    and all stay; rows without an id come after all others.
    """
    clean = lines.without_repeats(docs, run=1, window=1)
    left = clean.where((F.col("__n_removed") == 0) | (F.col("__n_removed") < F.col("__n_lines")))
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*map(col, docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near duplicates (five-word shingles, Jaccard 0.8) one row, that of the least id.

    Unlike texts of one id are judged each by itself. All texts without a word (null ones too) are one group. A
    row without an id stays only if no row of its group has one; of equal rows one stays.
    """
    groups = jaccard.near_duplicates(docs)
    # one row by id and text; null ids come last
    best = groups.groupBy("root").agg(F.min(F.struct(F.col("id").isNull(), "id", "node")).alias("best"))
    keep = best.select(F.col("best.id").alias("id"), F.col("best.node").alias("node"))
    own = docs.toDF(*[f"d_{c}" for c in docs.columns]).withColumn("own", jaccard.node_of("d_text"))  # no name clashes with ours
    own = own.join(keep, F.col("d_doc_id").eqNullSafe(F.col("id")) & (F.col("own") == F.col("node")), "left_semi").dropDuplicates(["d_doc_id", "own"])
    return own.drop("own").toDF(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix of sources takes them.

    Texts without words are never taken; rows without a source are a source of their own;
    repeated rows count each. An empty table stays empty.
    """
    return mixing.repeated(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row a piece of a document: its sequence, place and length.

    Texts without words give no row; repeated rows and rows without an id are packed as often as they come.
    """
    return packing.packed(docs.select("doc_id", n_words("text").alias("n_words")), "doc_id", "n_words")


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mix_sources", mix_sources), ("best_fit_packing", best_fit_packing)]

#: No stage but line dedup and the mix can be told in SQL (trained model, MinHash links verified by Jaccard, greedy packing).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
