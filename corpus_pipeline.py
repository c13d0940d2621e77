"""A corpus from documents to packed sequences: each stage is one of the operators, written as Parquet and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from helixframe.llm import mixing, near_dedup, packing, pii, toxicity
from helixframe.llm.common import read, shared_dir


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go, those with a null doc_id included; null and empty texts stay."""
    return toxicity.without_toxic(spark, docs, read(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts with a similarity of 0.8 or more stays, the one with the smallest doc_id (a null one
    counts as the largest); of repeated rows one stays; texts without words are no copies of each other."""
    return near_dedup.deduplicated(spark, docs, num=80, den=100)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are replaced by their kind; n_chars follows. Every row stays, null and repeated ids too; a null text stays null."""
    return pii.personal_data(spark, docs, redact=True)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the target mixture, each once: after de-duplication no epoch is repeated. A null lang or source counts as '';
    null and empty texts have no tokens and go or stay with their place in their leaf's order; null ids are rows of their own."""
    return mixing.mixed(spark, docs, ratio=0.8, epochs=1)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of full sequences, with their token ids; a null or empty text is the end id alone; null ids are packed as rows of their own."""
    return packing.pack(spark, docs, with_ids=True)


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_duplicates), ("pii", redact), ("mixing", mix_sources), ("packing", pack)]

#: The classifier, the set-similarity join and the tokenizer have no SQL form; the stages are tested by
#: the operators' brute-force tests and by what each must drop and keep (tests/llm).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i + 1 == len(STAGES):
            return out
        path = f"{shared_dir(spark)}/stage-{name}-{uuid.uuid4().hex}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
