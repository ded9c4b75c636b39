"""The registered queries of the training-data operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import pii, ppm
from ._spark import tables
from .decontam import digest
from .mixing import taken_words
from .ngram_join import linked_components
from .paragraph_dedup import repeated_paragraphs
from .sharding import interleave
from .suffix_dedup import dedup_digest
from .topk import top_k
from .toxicity import toxicity_scores


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(tables(spark, sf_dir, "documents"), tables(spark, sf_dir, "labels"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = interleave(tables(spark, sf_dir, "documents"), 24)
    return out.withColumn("law", F.lit("rows")).withColumn("grown_shard", F.lit(None).cast("int"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_components(tables(spark, sf_dir, "documents"), k=3, num=90, den=100).drop("text_hash")


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(tables(spark, sf_dir, "embeddings"), k=20, every=20)


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(tables(spark, sf_dir, "documents"), tables(spark, sf_dir, "benchmark"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(tables(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_paragraphs(tables(spark, sf_dir, "documents"), k=5, num=80, den=100)


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken_words(tables(spark, sf_dir, "documents"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables(spark, sf_dir, "documents")
    held_out = ppm.held_out(F.col("doc_id"))
    out = ppm.scores(docs, ~held_out)
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_digest(tables(spark, sf_dir, "documents"), 400)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_toxicity, op2_sharding, op3_ngram_jaccard_join, op4_exact_top_k, op5_benchmark_decontamination, op6_pii, op7_substring_dedup, op8_source_mixing, op9_lm_scoring, op10_suffix_array_dedup)}
