"""Sequences derived from the documents table, in Spark and as SQL, so that both engines see the same inputs."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ABC = "abcdefghijklmnopqrstuvwxyz"
DNA = "acgtacgtacgtacgtacgtacgtac"
DNA_N = "acgtacgtacgtacgtncgtacgnan"

SQL_DNA = f"upper(regexp_replace(translate(lower(text), '{ABC}', '{DNA}'), '[^acgt]', '', 'g'))"
SQL_DNA_N = f"upper(regexp_replace(translate(lower(text), '{ABC}', '{DNA_N}'), '[^acgtn]', '', 'g'))"
SQL_PROTEIN = "upper(regexp_replace(lower(text), '[^acdefghiklmnpqrstvwy]', '', 'g'))"
D = f"d AS (SELECT doc_id, {SQL_DNA} AS seq FROM documents)"
P = f"p AS (SELECT doc_id, {SQL_PROTEIN} AS seq FROM documents)"
R = f"""dn AS (SELECT doc_id, {SQL_DNA_N} AS s FROM documents),
rb AS (SELECT doc_id || '.' || i AS name, substr(s, CAST(i * 150 + 1 AS BIGINT), 150) AS sequence FROM dn, unnest(range(0, (length(s) + 149) // 150)) AS t(i)),
r AS (SELECT name, sequence, array_to_string(list_transform(range(1, length(sequence) + 1), lambda j: chr(CAST(33 + (ascii(substr(sequence, j, 1)) + j - 1) % 42 AS INTEGER))), '') AS quality FROM rb)"""


def documents(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")


def _dna(letters: str, keep: str):
    return F.upper(F.regexp_replace(F.translate(F.lower("text"), ABC, letters), f"[^{keep}]+", ""))


def dna(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", _dna(DNA, "acgt").alias("seq"))


def protein(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", F.upper(F.regexp_replace(F.lower("text"), "[^acdefghiklmnpqrstvwy]+", "")).alias("seq"))


def reads(spark: SparkSession, d: str) -> DataFrame:
    """150-base reads with Ns and a quality that follows base and place; the last read of a document may be shorter."""
    cut = F.posexplode(F.regexp_extract_all(_dna(DNA_N, "acgtn"), F.lit(".{1,150}"), F.lit(0))).alias("i", "sequence")
    out = documents(spark, d).select("doc_id", cut)
    quality = F.array_join(F.transform(F.split("sequence", ""), lambda c, j: F.chr(F.lit(33) + (F.ascii(c) + j) % 42)), "")
    return out.select(F.concat_ws(".", F.col("doc_id").cast("string"), F.col("i").cast("string")).alias("name"), "sequence", quality.alias("quality"))


_OWN: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the cluster's shared folder, or in a temporary one where none is configured and all runs in one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not folder:
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="helixframe-"))
            atexit.register(shutil.rmtree, _OWN[0], True)
        folder = f"file://{_OWN[0]}"
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
