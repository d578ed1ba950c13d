"""The registered queries of the operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embeddings, language, lexical, licences, lines, mixing, negatives, packing, quality, simhash, spans, tokens, topk
from .common import n_words, read


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(read(spark, sf_dir, "documents"))


def op2_embedding_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(read(spark, sf_dir, "embeddings"))


def op3_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.repeated_spans(read(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = read(spark, sf_dir, "documents").select("doc_id", n_words("text").alias("n_words"))
    return packing.packed(sized, "doc_id", "n_words")


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


def op6_simhash_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op7_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.licences(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.array_join("licences", ",").alias("licences"), "n_sentences")


def op8_adaptive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(read(spark, sf_dir, "documents")).drop("failed")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = lines.without_repeats(read(spark, sf_dir, "documents"))
    return clean.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_removed").alias("n_removed"), F.md5("text").alias("text_md5"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.languages(read(spark, sf_dir, "documents"))


def op11_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label=label)


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_embedding_near_dups, op3_sentence_spans, op4_best_fit_packing, op5_source_mix, op6_simhash_near_dups, op7_licence_scan, op8_adaptive_quality, op9_line_dedup, op10_language_id, op11_exact_top_k, op12_hard_negatives, op13_lexical_search)}

ORACLES = {
    "op2_embedding_near_dups": embeddings.ORACLE,
    "op5_source_mix": mixing.ORACLE,
    "op8_adaptive_quality": quality.ORACLE,
    "op9_line_dedup": lines.ORACLE,
    "op11_exact_top_k": topk.ORACLE,
    "op12_hard_negatives": negatives.ORACLE,
    "op13_lexical_search": lexical.ORACLE,
}
