"""Embedding near-dedup with product quantisation.

Coarse k-means lists and residual subspace codebooks are fitted on a bounded sample (`FIT_ROWS`); every vector is
indexed. A vector probes its nearest lists under its own label; table-lookup distances to the coded residuals drop what
cannot reach the bar (the coding error of each stored vector widens its bar, so no pair of a probed list is lost);
survivors get the exact cosine. Each vector counts its own links and tasks emit spanning edges only, never all pairs.
Equal vectors are one class with a multiplicity; long lists and long query sets are cut into bounded tasks.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, runs, union_find
from .components import components
from .topk import vectors

#: Rows of the sample that lists and codebooks are fitted on.
FIT_ROWS = 20_000
#: Rows of the sample for a list, at least: with FIT_ROWS it bounds the number of lists, and so how fine a search can be.
ROWS_PER_LIST = 8
SUBSPACES, CODES = 8, 64
LIST_BLOCK, QUERY_BLOCK = 4096, 8192


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 0) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = np.argmin((c**2).sum(1) - 2 * x @ c.T, axis=1)
        n = np.bincount(near, minlength=len(c))
        s = np.zeros_like(c)
        np.add.at(s, near, x)
        c[n > 0] = s[n > 0] / n[n > 0, None]
    return c


def fit(x: np.ndarray, lists: int) -> dict:
    """Coarse centroids and one codebook per subspace of the residuals."""
    d = x.shape[1]
    coarse = kmeans(x, min(lists, len(x)))
    near = np.argmin((coarse**2).sum(1) - 2 * x @ coarse.T, axis=1)
    res = x - coarse[near]
    cuts = np.linspace(0, d, min(SUBSPACES, d) + 1).astype(int)
    books = [kmeans(res[:, a:b], min(CODES, len(x)), seed=i + 1) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    return {"dim": d, "coarse": coarse, "cuts": cuts, "books": books}


def encode(model: dict, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(list, codes, coding error) of unit vectors."""
    c = model["coarse"]
    near = np.argmin((c**2).sum(1) - 2 * x @ c.T, axis=1)
    res = x - c[near]
    codes, err = [], np.zeros(len(x))
    for (a, b), book in zip(zip(model["cuts"], model["cuts"][1:]), model["books"]):
        code = np.argmin((book**2).sum(1) - 2 * res[:, a:b] @ book.T, axis=1)
        err += ((res[:, a:b] - book[code]) ** 2).sum(1)
        codes.append(code)
    return near, np.stack(codes, 1).astype(np.uint8), np.sqrt(err)


def near_vectors(spark: SparkSession, table: DataFrame, bar: float = 0.93, probes: int = 12, lists: int | None = None) -> DataFrame:
    """Per vector: vec_id, n_links, component_id, kept.

    Vectors meet only under one label that is not null and with one length. Those that are null, empty, zero or hold
    null or non-finite components, or have a null label, link with nothing and are kept. Rows with a null vec_id are
    dropped, repeated vec_ids give one row; an empty table gives no rows; other columns are ignored. Links have a
    cosine of `bar` at least in double precision; which are found depends on the probes (recall is tested).
    """
    source = table.where("vec_id IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.col("label").cast("string").alias("label")).dropDuplicates(["vec_id"])
    source = cut(spark, source, "vectors")
    usable = source.where("label IS NOT NULL AND embedding IS NOT NULL AND size(embedding) > 0")
    classes = cut(spark, usable.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("mult")), "classes")
    n = classes.count()
    share = max(1, -(-n // FIT_ROWS))
    dims: dict = {}
    for b in classes.where(F.pmod(F.xxhash64("rep"), F.lit(share)) == 0).select("embedding").toArrow().to_batches():
        for d, _, m in vectors(b):
            dims.setdefault(d, []).append(m)
    sample = np.concatenate(max(dims.values(), key=lambda x: sum(map(len, x)))) if dims else np.zeros((0, 1))
    norm = np.linalg.norm(sample, axis=1)
    sample = sample[norm > 0] / norm[norm > 0, None]
    held = spark.sparkContext.broadcast(fit(sample, lists or int(min(FIT_ROWS // ROWS_PER_LIST, max(8, round(n**0.5 / 4))))) if len(sample) else None)

    def index(batches):
        import pyarrow as pa

        model = held.value
        for batch in batches:
            if batch.num_rows == 0:
                continue
            rep, mult, label = batch.column("rep").to_numpy(), batch.column("mult").to_numpy(), batch.column("label")
            for d, rows, m in vectors(batch):
                norm = np.linalg.norm(m, axis=1)
                ok = norm > 0
                rows, x = rows[ok], m[ok] / norm[ok, None]
                if len(rows) == 0:
                    continue
                lab = label.take(pa.array(rows))
                if model is not None and d == model["dim"]:
                    near, codes, err = encode(model, x)
                    c = model["coarse"]
                    dist = (c**2).sum(1) - 2 * x @ c.T
                    p = min(probes, len(c))
                    ask = np.argpartition(dist, p - 1, axis=1)[:, :p] if p < len(c) else np.tile(np.arange(len(c)), (len(x), 1))
                    code = [r.tobytes() for r in codes]
                else:  # another length: one list, exact distances only
                    near, err, ask, code = np.full(len(x), -d), np.zeros(len(x)), np.full((len(x), 1), -d), [b""] * len(x)
                raw = [r.tobytes() for r in x]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rep[rows]), pa.array(mult[rows]), lab, pa.array(near.astype(np.int32)), pa.array(code, pa.binary()), pa.array(err), pa.array(ask.astype(np.int32).tolist(), pa.list_(pa.int32())), pa.array(raw, pa.binary())],
                    ["rep", "mult", "label", "list", "code", "err", "ask", "x"],
                )

    indexed = cut(spark, classes.mapInArrow(index, "rep long, mult long, label string, list int, code binary, err double, ask array<int>, x binary"), "index")
    stored = indexed.select("rep", "mult", "label", "list", "code", "err", "x")
    asking = indexed.select("rep", "label", F.explode("ask").alias("list"), "x")
    size = stored.groupBy("label", "list").agg(F.ceil(F.count("*") / LIST_BLOCK).cast("int").alias("sb"))
    qsize = asking.groupBy("label", "list").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("qb"))
    cells = cut(spark, size.join(qsize, ["label", "list"]).repartition(1) if n < 100_000 else size.join(qsize, ["label", "list"]), "cells")
    s = stored.join(cells, ["label", "list"]).withColumn("s", F.pmod(F.xxhash64("rep"), "sb").cast("int")).withColumn("q", F.explode(F.expr("sequence(0, qb - 1)")))
    q = asking.join(cells, ["label", "list"]).withColumn("q", F.pmod(F.xxhash64("rep", F.lit(1)), "qb").cast("int")).withColumn("s", F.explode(F.expr("sequence(0, sb - 1)")))
    key = F.xxhash64("label", "list", "s", "q").alias("task")
    none = F.lit(None)
    tasks = s.select(key, "list", "rep", "mult", "code", "err", "x").unionByName(q.select(key, "list", "rep", none.cast("long").alias("mult"), none.cast("binary").alias("code"), none.cast("double").alias("err"), "x"))
    reach = float(np.sqrt(max(0.0, 2 - 2 * bar))) + 1e-9

    def search(batches):
        import pyarrow as pa

        model = held.value
        for t in runs(batches, "task"):
            is_q = t.column("mult").is_null().to_numpy()
            b, a = np.flatnonzero(~is_q), np.flatnonzero(is_q)
            if len(a) == 0 or len(b) == 0:
                continue
            lst = t.column("list")[0].as_py()
            x = np.frombuffer(b"".join(t.column("x").to_pylist())).reshape(t.num_rows, -1)
            ids = t.column("rep").to_numpy()
            mult = t.column("mult").take(pa.array(b)).to_numpy()
            codes = err = None
            if lst >= 0:
                codes = np.frombuffer(b"".join(t.column("code").take(pa.array(b)).to_pylist()), np.uint8).reshape(len(b), -1)
                err = t.column("err").take(pa.array(b)).to_numpy()
            links = np.zeros(len(a), np.int64)
            ea, eb = [], []
            step = max(1, 4_000_000 // len(b))
            for i in range(0, len(a), step):
                rows = a[i : i + step]
                if codes is not None:
                    res = x[rows] - model["coarse"][lst]
                    dist = np.zeros((len(rows), len(b)))
                    for k, book in enumerate(model["books"]):
                        lo, hi = model["cuts"][k], model["cuts"][k + 1]
                        look = (res[:, lo:hi] ** 2).sum(1)[:, None] - 2 * res[:, lo:hi] @ book.T + (book**2).sum(1)
                        dist += look[:, codes[:, k]]
                    u, v = np.nonzero(dist <= (reach + err) ** 2 + 1e-9)
                else:
                    u, v = (z.ravel() for z in np.meshgrid(np.arange(len(rows)), np.arange(len(b)), indexing="ij"))
                for j in range(0, len(u), 200_000):
                    uu, vv = u[j : j + 200_000], v[j : j + 200_000]
                    cos = np.einsum("ij,ij->i", x[rows[uu]], x[b[vv]])
                    ok = (cos >= bar) & (ids[rows[uu]] != ids[b[vv]])
                    uu, vv = uu[ok], vv[ok]
                    np.add.at(links, i + uu, mult[vv])
                    if len(uu):  # a spanning part of this slice is enough for the components
                        near = union_find(len(rows) + len(b), uu, len(rows) + vv)
                        nodes = np.unique(np.concatenate([uu, len(rows) + vv]))
                        every = np.concatenate([ids[rows], ids[b]])
                        ea.append(every[nodes])
                        eb.append(every[near[nodes]])
            hit = np.flatnonzero(links)
            e = np.unique(np.stack([np.concatenate(ea), np.concatenate(eb)], 1), axis=0) if ea else np.zeros((0, 2), np.int64)
            e = e[e[:, 0] != e[:, 1]]
            if len(hit) + len(e):
                yield pa.RecordBatch.from_pydict({"a": np.concatenate([ids[a[hit]], e[:, 0]]), "b": pa.array(np.concatenate([np.full(len(hit), -1), e[:, 1]]), mask=np.concatenate([np.ones(len(hit), bool), np.zeros(len(e), bool)])), "n": np.concatenate([links[hit], np.zeros(len(e), np.int64)])})

    found = cut(spark, tasks.repartition("task").sortWithinPartitions("task").mapInArrow(search, "a long, b long, n long"), "links")
    links = found.where("b IS NULL").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    comp = components(spark, found.where("b IS NOT NULL").select("a", "b"))
    per = indexed.select("rep", "mult").join(links, "rep", "left").join(comp.withColumnRenamed("id", "rep"), "rep", "left")
    per = per.select("rep", (F.col("mult") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    member = usable.join(classes.select("label", "embedding", "rep"), ["label", "embedding"]).select("vec_id", "rep").join(per, "rep").drop("rep")
    out = source.select("vec_id").join(member, "vec_id", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
