"""Exact top-k inner-product search: tiled matrix products, partial selection per tile, tree merge of top lists.

Queries go out in blocks of a fixed number of bytes, one after the other: a block is gathered, sent to the workers, searched for
in one pass over the vectors and forgotten, so the driver and the workers hold one block whatever the number of queries. A task
multiplies the block with one tile of its partition at a time and keeps a running top list per query. The lists of the partitions
meet in two merges, first within groups of partitions and then per query, each keeping k.
"""

from __future__ import annotations

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut

QUERY_BYTES = 16 << 20
TILE = 4096


def vectors(batch, column: str = "embedding"):
    """Per vector length d: (d, rows, matrix) of the vectors that are whole: no null or non-finite component."""
    import pyarrow as pa

    col = batch.column(column)
    if col.null_count == len(col):
        return
    rows = np.flatnonzero(~np.asarray(col.is_null().to_numpy(zero_copy_only=False)))
    col = col.drop_null()
    sizes = col.value_lengths().to_numpy()
    flat = col.flatten()
    bad = flat.is_null().to_numpy(zero_copy_only=False)
    x = flat.fill_null(0).cast(pa.float64()).to_numpy(zero_copy_only=False)
    start = np.cumsum(sizes) - sizes
    for d in np.unique(sizes):
        pick = np.flatnonzero(sizes == d)
        at = start[pick][:, None] + np.arange(d)
        m = x[at]
        ok = np.isfinite(m).all(axis=1) & ~bad[at].any(axis=1)
        if ok.any() and d:
            yield int(d), rows[pick[ok]], m[ok]


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best, by score and then by the smaller id."""
    if len(score) > 4 * k:
        bar = np.partition(score, len(score) - k)[len(score) - k]
        keep = np.flatnonzero(score >= bar)
    else:
        keep = np.arange(len(score))
    return keep[np.lexsort((ids[keep], -score[keep]))[:k]]


def top_k(spark: SparkSession, table: DataFrame, every: int = 50, k: int = 5, scale: int = 256) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): for each vec_id divisible by `every` the k highest integer products.

    Components become floor(scale * x). Vectors that are null, empty or hold null or non-finite components take no
    part, nor do rows with a null vec_id; only vectors of one length meet. A query's own id is no candidate; ties go
    to the smaller id; repeated rows of another id compete each by itself. An empty table gives no rows; other columns
    are ignored. Products are exact while their sums stay below 2**53.
    """
    source = table.where("vec_id IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    asked = source.where(F.col("vec_id") % every == 0)
    shape = asked.agg(F.count("*"), F.max(F.size("embedding"))).first()
    blocks = max(1, -(-int(shape[0]) * max(int(shape[1] or 1), 1) * 8 // QUERY_BYTES))
    lists = None
    for block in range(blocks):
        got = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block).toArrow()
        q: dict = {}
        for b in got.to_batches():
            ids = b.column("vec_id").to_numpy()
            for d, rows, m in vectors(b):
                q.setdefault(d, []).append((ids[rows], np.floor(m * scale)))
        held = spark.sparkContext.broadcast({d: (np.concatenate([a for a, _ in x]), np.concatenate([m for _, m in x])) for d, x in q.items()})
        part = source.mapInArrow(_search(held, k, scale), "query_id long, vec_id long, score long, part int")
        if blocks > 1:
            part = cut(spark, part, "lists")
            held.destroy()
        lists = part if lists is None else lists.unionByName(part)
    order = [F.desc("score"), "vec_id"]
    group = W.partitionBy("query_id", (F.col("part") / 32).cast("int")).orderBy(*order)
    near = lists.withColumn("r", F.row_number().over(group)).where(F.col("r") <= k).drop("r", "part")
    ranked = near.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*order)))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _search(held, k: int, scale: int):
    def run(batches):
        import pyarrow as pa

        part = TaskContext.get().partitionId()
        best = {d: ([np.zeros(0, np.int64)] * len(q[0]), [np.zeros(0, np.int64)] * len(q[0])) for d, q in held.value.items()}
        for batch in batches:
            if batch.num_rows == 0:
                continue
            ids = batch.column("vec_id").to_numpy()
            for d, rows, m in vectors(batch):
                if d not in best:
                    continue
                qid, qm = held.value[d]
                for i in range(0, len(rows), TILE):
                    own = ids[rows[i : i + TILE]]
                    tile = np.floor(m[i : i + TILE] * scale)
                    for a in range(0, len(qid), 512):
                        product = (qm[a : a + 512] @ tile.T).astype(np.int64)
                        for j in range(len(product)):
                            s = product[j]
                            x = a + j
                            have = best[d][1][x]
                            if len(have) == k:  # only what can enter the list
                                pick = np.flatnonzero(s >= have[-1])
                                if len(pick) == 0:
                                    continue
                                s, cand = s[pick], own[pick]
                            else:
                                cand = own
                            other = cand != qid[x]
                            cand, s = np.concatenate([best[d][0][x], cand[other]]), np.concatenate([have, s[other]])
                            p = _best(s, cand, k)
                            best[d][0][x], best[d][1][x] = cand[p], s[p]
        for d, (vec, score) in best.items():
            n = np.array([len(v) for v in vec], np.int64)
            if n.sum():
                yield pa.RecordBatch.from_pydict({"query_id": np.repeat(held.value[d][0], n), "vec_id": np.concatenate(vec), "score": np.concatenate(score), "part": np.full(int(n.sum()), part, np.int32)})

    return run


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
