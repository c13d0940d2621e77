"""Connected components by alternating large-star and small-star steps over a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, drop


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """Rows (id, component) for every node of edges(a, b); component is the smallest id reachable.

    Each round is two map-side-combined minima and two joins on the node; the star steps need a number of
    rounds that grows with the logarithm of the nodes. Nothing is gathered on the driver but two counters.
    Self-loops and repeated edges are fine; rows with a null end are dropped; no edges give no rows.
    """
    e = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v")).distinct()
    e = cut(spark, e, "edges")
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionByName(e.join(low.where("m < u"), "u").select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        m = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(m, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(m.select("u", F.col("m").alias("v"))).distinct()
        nxt = cut(spark, star, "edges")
        now = nxt.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if before is None:
            before = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        drop(e)
        e = nxt
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
