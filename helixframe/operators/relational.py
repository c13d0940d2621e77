"""Relational operators over sequence tables: k-mers, codon adaptation, quality control, summaries, rankings."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..dims import codes
from ..functions import kernels
from ..functions import sequence as sq
from ..sources.sinks import phred


def count_kmers(df: DataFrame, k: int, seq: str = "sequence", by: list[str] | None = None) -> DataFrame:
    """A1: counts of overlapping k-mers of A, C, G and T, in all or per group; combined before the shuffle."""
    keys = by or []
    return df.select(*keys, F.explode(sq.kmers(seq, k)).alias("kmer")).groupBy(*keys, "kmer").agg(F.count("*").alias("n"))


def kmer_counts_streaming(df: DataFrame, k: int, seq: str = "sequence") -> DataFrame:
    """A1 over a stream of records: the same plan, kept as state by kmer."""
    return count_kmers(df, k, seq)


def codon_counts(df: DataFrame, seq: str = "sequence", by: list[str] | None = None) -> DataFrame:
    """Counts of the whole codons, in all or per group; in all, a batch of sequences is a row per codon before the shuffle."""
    if not by:
        kernels.batches(df.sparkSession)
        each = df.select(F.upper(F.col(seq)).alias("seq")).mapInArrow(kernels.codon_totals("seq"), "codon string, n bigint")
        return each.groupBy("codon").agg(F.sum("n").alias("n"))
    keys = by
    return df.select(*keys, F.explode(sq.codons(seq)).alias("codon")).groupBy(*keys, "codon").agg(F.count("*").alias("n"))


def codon_adaptation_index(spark: SparkSession, genes: DataFrame, seq: str = "sequence", table: int | str = 1) -> DataFrame:
    """A3: rows (codon, aa, n, w): counts of all genes, 0 read as one half, over the largest of the synonymous ones.

    Codons of other letters fail the query; a trailing partial codon is not counted. 64 rows whatever the input.
    """
    code = codes.get(table)
    dim = spark.createDataFrame([(c, code.forward.get(c, "*")) for c in sorted(codes.ORDER)], "codon string, aa string")
    n = codon_counts(genes, seq)
    bad = n.where(~F.col("codon").rlike("^[ACGT]{3}$"))
    n = n.withColumn("codon", F.when(F.col("codon").rlike("^[ACGT]{3}$"), F.col("codon")).otherwise(F.raise_error(F.concat(F.lit("illegal codon '"), "codon", F.lit("'"))).cast("string")))
    del bad
    full = F.broadcast(dim).join(n, "codon", "left").withColumn("n", F.coalesce(F.col("n").cast("double"), F.lit(0.5)))
    top = F.max("n").over(W.partitionBy("aa"))
    return full.withColumn("w", F.col("n") / top).select("codon", "aa", "n", "w")


def codon_adaptation(genes: DataFrame, index: DataFrame, key: str = "id", seq: str = "sequence") -> DataFrame:
    """A4: rows (key, cai, n_codons): exp of the mean log w without ATG and TGG; genes without other codons give null.

    The index has 64 rows and is gathered; a gene's logs are added in a vector kernel, so nothing is shuffled and genes that
    share a key stay apart. A codon without a weight fails the query unless it is a stop, which is then left out.
    """
    w = {r.codon: r.w for r in index.select("codon", "w").collect()}
    left_out = ["ATG", "TGG"] + [c for c in ("TGA", "TAA", "TAG") if not w.get(c)]
    logs = {c: math.log(x) for c, x in w.items() if x}
    kernels.batches(genes.sparkSession)
    # named nondeterministic so that a filter on the result is not pushed below and the genes are not read twice
    used = genes.select(key, kernels.codon_logs(logs, left_out).asNondeterministic()(F.upper(F.col(seq))).alias("c"))
    some = F.col("c.n") > 0
    return used.select(key, F.when(some, F.exp(F.col("c.s") / F.col("c.n"))).alias("cai"), F.when(some, F.col("c.n")).cast("long").alias("n_codons"))


def adaptation_text(index: DataFrame) -> DataFrame:
    """A5: the printed lines of an index."""
    return index.select("codon", F.format_string("%s\t%.3f", "codon", "w").alias("line"))


def quality_reason(seq: str = "sequence", quality: str = "quality", most_n: int = 0, gc: tuple[float, float] = (0.3, 0.7), least_q: float = 30.0) -> Column:
    """Why a read is dropped: its Ns, then its GC, then its mean quality; null if it is kept."""
    share = sq.gc_fraction(seq)
    scores = phred(quality)
    mean = F.try_divide(F.aggregate(scores, F.lit(0).cast("long"), lambda s, q: s + q).cast("double"), F.size(scores).cast("double"))
    return F.when(sq.count_letters(F.col(seq), "Nn") > most_n, "n").when((share < gc[0]) | (share > gc[1]), "gc").when(F.coalesce(mean, F.lit(0.0)) < least_q, "quality")


def fastq_qc(reads: DataFrame, **limits) -> DataFrame:
    """Kept and dropped reads by reason."""
    return reads.groupBy(F.coalesce(quality_reason(**limits), F.lit("kept")).alias("reason")).agg(F.count("*").alias("n_reads"), F.sum(F.length("sequence")).cast("long").alias("n_bases"))


def read_summary(reads: DataFrame) -> DataFrame:
    """A10: count, bases, mean length, pooled GC, shortest and longest in one pass."""
    c = sq.gc_counts("sequence")
    n = F.length("sequence")
    out = reads.select(n.alias("len"), c["gc"].alias("gc"), c["at"].alias("at")).agg(F.count("*").alias("n_reads"), F.sum("len").cast("long").alias("n_bases"), F.sum("gc").cast("long").alias("gc"), F.sum("at").cast("long").alias("at"), F.min("len").alias("shortest"), F.max("len").alias("longest"))
    return out.select("n_reads", "n_bases", F.try_divide(F.col("n_bases").cast("double"), F.col("n_reads").cast("double")).alias("mean_length"), F.try_divide(F.col("gc").cast("double"), (F.col("gc") + F.col("at")).cast("double")).alias("gc_share"), "shortest", "longest")


def rank_top(df: DataFrame, score: str, tie: str, n: int, ascending_tie: bool = False) -> DataFrame:
    """The n best by score with ties by another column: a top-k, no full sort."""
    return df.orderBy(F.desc(score), F.asc(tie) if ascending_tie else F.desc(tie)).limit(n)
