"""The operators applied to their whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import lm_score, mixing, near_dedup, packing, pii, quality, topk, toxicity, url_filter, vector_dedup
from .common import read


def op1_near_dedup(spark: SparkSession, d: str) -> DataFrame:
    return near_dedup.near_duplicates(spark, read(spark, d, "documents"))


def op2_quality(spark: SparkSession, d: str) -> DataFrame:
    return quality.quality(spark, read(spark, d, "documents"), read(spark, d, "labels"))


def op3_vector_dedup(spark: SparkSession, d: str) -> DataFrame:
    return vector_dedup.near_vectors(spark, read(spark, d, "embeddings"))


def op4_toxicity(spark: SparkSession, d: str) -> DataFrame:
    return toxicity.toxicity(spark, read(spark, d, "documents"), read(spark, d, "labels"))


def op5_topk(spark: SparkSession, d: str) -> DataFrame:
    return topk.top_k(spark, read(spark, d, "embeddings"))


def op6_pii(spark: SparkSession, d: str) -> DataFrame:
    return pii.personal_data(spark, read(spark, d, "documents"))


def op7_lm_score(spark: SparkSession, d: str) -> DataFrame:
    return lm_score.score(spark, read(spark, d, "documents"))


def op8_url_filter(spark: SparkSession, d: str) -> DataFrame:
    pages = read(spark, d, "pages")
    return url_filter.url_filter(spark, pages, listed=url_filter.spam_list(pages))


def op9_packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(spark, read(spark, d, "documents"))


def op10_mixing(spark: SparkSession, d: str) -> DataFrame:
    out = mixing.mix(spark, read(spark, d, "documents"))
    return out.select("doc_id", F.col("mix_domain").alias("domain"), F.col("mix_lang").alias("lang"), F.col("mix_source").alias("source"), F.col("mix_tokens").alias("n_tokens"), F.col("mix_copies").alias("copies"))


QUERIES = {f.__name__: f for f in (op1_near_dedup, op2_quality, op3_vector_dedup, op4_toxicity, op5_topk, op6_pii, op7_lm_score, op8_url_filter, op9_packing, op10_mixing)}
ORACLES = {"op5_topk": topk.SQL, "op8_url_filter": url_filter.SQL}
