"""MinHash near-dedup by a chosen-path set-similarity join.

1. One pass turns each text into its set of five-word shingle hashes, a fingerprint of that set and a
   one-permutation minwise sketch; texts are not carried on. Equal sets form a class, named by the fingerprint
   and standing for all its documents from here on.
2. Chosen paths: in each of `trees` independent trees a class follows `branch` minwise tokens per node,
   chosen by the node, three levels deep. Nodes of one member vanish; equal nodes are kept once; nodes above
   `node_limit` are branched further.
3. Small nodes compare sketches exhaustively (a low bar, several deviations under the threshold) and emit a
   spanning star. Components of those stars are clusters: supersets of the true groups.
4. Each cluster's texts meet in one task, which confirms links on full sets and stops comparing what is
   already connected. A cluster that is too large for a task is cut into blocks that share pivots; blocks
   that hold a component other than the cluster's main one are then compared with every block.

Recall of a pair at the threshold s is 1 - (1 - f)**trees, f from f = 1 - (1 - s * f) ** branch three times:
over 0.9999 for s = 0.85, branch 2 and 3 trees.
"""

from __future__ import annotations

from typing import TYPE_CHECKING

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_texts, chunks, cut, mix, runs, small, text_batches, union_find, word_hashes
from .components import components

if TYPE_CHECKING:  # workers import this module and need no pandas
    import pandas as pd

SKETCH = 64
WORDS = 5


def shingle_sets(column):
    """For each text of an Arrow column its sorted distinct shingle hashes."""
    buf, offsets = arrow_texts(column)
    for i, j in chunks(offsets):
        h, _, _, first = word_hashes(buf, offsets[i : j + 1])
        k = max(0, len(h) - WORDS + 1)
        roll = np.zeros(k, np.uint64)
        a = np.uint64(0x2545F4914F6CDD1D)
        for w in range(WORDS):
            roll = roll * a + h[w : w + k]
        roll = mix(roll)
        for d in range(j - i):
            s, e = first[d], first[d + 1]
            if e - s >= WORDS:
                yield np.unique(roll[s : e - WORDS + 1])
            elif e > s:
                x = np.array([e - s], np.uint64)
                for v in h[s:e]:
                    x = mix(x * a + v)
                yield x
            else:
                yield np.zeros(0, np.uint64)


_BOUNDS = (np.arange(SKETCH + 1, dtype=np.float64) * (2.0**64 / SKETCH))[:-1].astype(np.uint64)
_PICKS = mix(np.arange(SKETCH * 256, dtype=np.uint64) + np.uint64(99)).reshape(SKETCH, 256).astype(np.int64) % SKETCH


def sketch(values: np.ndarray) -> np.ndarray:
    """One-permutation minwise sketch: the least hash of each of 64 ranges; empty ranges borrow by a fixed hash."""
    at = np.searchsorted(values, _BOUNDS)
    end = np.append(at[1:], len(values))
    full = at < end
    out = np.zeros(SKETCH, np.uint64)
    out[full] = values[at[full]]
    for b in np.flatnonzero(~full):
        picks = _PICKS[b]
        hit = np.flatnonzero(full[picks])
        src = picks[hit[0]] if len(hit) else int(np.flatnonzero(full)[0])
        out[b] = mix(values[at[src] : at[src] + 1] + np.uint64(b))[0]
    return (mix(out) >> np.uint64(48)).astype(np.uint16)


def _children(paths: np.ndarray, sk: np.ndarray, pool: np.ndarray, branch: int) -> np.ndarray:
    """Child nodes (rows, branch) of nodes (rows,) with sketches (rows, 64); the node picks the tokens."""
    row = np.arange(len(paths))
    out = []
    h = mix(paths + np.uint64(7))
    used = []
    for k in range(branch):
        at = ((h >> np.uint64(16 * k)) % np.uint64(len(pool) - k)).astype(np.int64)
        for u in used:
            at = np.where(at >= u, at + 1, at)
        used.append(at)
        coord = pool[np.minimum(at, len(pool) - 1)]
        out.append(mix(mix(paths * np.uint64(31) + coord.astype(np.uint64)) + sk[row, coord].astype(np.uint64)))
    return np.stack(out, axis=1)


def chosen_paths(sk: np.ndarray, trees: int, branch: int, seed: int) -> np.ndarray:
    """Nodes (rows, trees * branch**3) at depth three."""
    out = []
    for t in range(trees):
        perm = np.random.default_rng(seed * 1000 + t).permutation(SKETCH)
        pools = [perm[:16], perm[16:36], perm[36:]]
        nodes = np.full((len(sk), 1), mix(np.array([seed * 7919 + t + 1], np.uint64))[0])
        for pool in pools:
            nodes = np.concatenate([_children(nodes[:, c], sk, pool, branch) for c in range(nodes.shape[1])], axis=1)
        out.append(nodes)
    return np.concatenate(out, axis=1)


def _exact_links(sets: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """Component labels under den * |A & B| >= num * |A | B|.

    Pivots are taken until all that are left lie in one component. A pivot is compared with the sets outside its component that
    share one of its rarest tokens: with the rarest first, linked sets of size k have one in common among their first k - a + 1, a being
    the least intersection that a link of such a set can have.
    """
    n = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets) if n else np.zeros(0, np.uint64)
    if n == 2:
        inter = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return np.zeros(2, int) if inter and den * inter >= num * (size.sum() - inter) else np.arange(2)
    _, code, often = np.unique(flat, return_inverse=True, return_counts=True)
    start = np.concatenate([[0], np.cumsum(size)])
    rank = np.empty(len(often), np.int32)
    rank[np.argsort(often, kind="stable")] = np.arange(len(often), dtype=np.int32)
    who = np.repeat(np.arange(n, dtype=np.int32), size)
    token = rank[code]
    token = token[np.lexsort((token, who))]
    head = size - (num * size + den - 1) // den + 1
    first = np.arange(len(token)) - start[who] < head[who]
    first_token = token[first]
    post = who[first][np.argsort(first_token, kind="stable")]
    at = np.concatenate([[0], np.cumsum(np.bincount(first_token, minlength=len(often)))])
    del flat, code, rank, who, first, first_token
    mark = np.zeros(len(often), np.int32)
    label = np.arange(n)
    todo = np.ones(n, bool)
    todo[size == 0] = False
    order = np.argsort(np.abs(size - np.median(size)), kind="stable")
    while True:
        left = np.flatnonzero(todo)
        if len(left) == 0:
            break
        seen, counts = np.unique(label[left], return_counts=True)
        if len(seen) == 1:
            break
        p = order[0] if todo.all() else left[label[left] == seen[np.argmin(counts)]][0]
        todo[p] = False
        own = token[start[p] : start[p + 1]]
        near = np.zeros(n, bool)
        for k in own[: head[p]][at[own[: head[p]] + 1] - at[own[: head[p]]] > 1]:
            near[post[at[k] : at[k + 1]]] = True
        near &= (label != label[p]) & (den * size >= num * size[p]) & (den * size[p] >= num * size)
        met = np.flatnonzero(near)
        if len(met) == 0:
            continue
        end = np.cumsum(size[met])
        mark[own] = 1
        inter = np.add.reduceat(mark[token[np.arange(end[-1]) + np.repeat(start[met] - end + size[met], size[met])]], end - size[met]).astype(np.int64)
        mark[own] = 0
        links = met[den * inter >= num * (size[met] + size[p] - inter)]
        label_of = np.unique(label[np.append(links, p)])
        label[np.isin(label, label_of)] = label_of.min()
    return label


def _compare(num: int, den: int):
    """Arrow batches (task, cid, text) sorted by task -> (task, a, b): star edges of confirmed components of classes."""

    def run(batches):
        import pyarrow as pa

        task, a, b = [], [], []
        for t in runs(batches, "task"):
            ids, first = np.unique(t.column("cid").to_numpy(), return_index=True)  # repeated rows of one text count once
            label = _exact_links(list(shingle_sets(t.column("text").take(pa.array(first)))), num, den)
            low = np.full(len(ids), np.iinfo(np.int64).max)
            np.minimum.at(low, label, ids)
            task.append(np.full(len(ids), t.column("task")[0].as_py(), np.int64))
            a.append(ids)
            b.append(low[label])
            if sum(map(len, a)) > 10_000:
                yield pa.RecordBatch.from_pydict({"task": np.concatenate(task), "a": np.concatenate(a), "b": np.concatenate(b)})
                task, a, b = [], [], []
        if a:
            yield pa.RecordBatch.from_pydict({"task": np.concatenate(task), "a": np.concatenate(a), "b": np.concatenate(b)})

    return run


def near_duplicates(spark: SparkSession, docs: DataFrame, num: int = 85, den: int = 100, **options) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept.

    Links hold where den * |A & B| >= num * |A | B| over the full sets of distinct five-word shingles (lower-cased
    A-Z, words between ASCII white space; a text of fewer words is one shingle). Null, empty and blank texts have
    no shingles, link with nothing and are kept. Rows with a null doc_id are dropped; rows that agree in doc_id and shingle
    set are one document, rows of one doc_id with different sets a document each, with a row and a component of its own;
    component_id is the smallest doc_id of the component. An empty table gives no rows; other columns are ignored.
    """
    rows = _resolve(spark, docs.where("doc_id IS NOT NULL"), num, den, **options)
    out = rows.select("cid", "doc_id", "n_shingles", F.col("best.doc_id").alias("component_id")).dropDuplicates(["cid", "doc_id"])
    return out.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def deduplicated(spark: SparkSession, docs: DataFrame, num: int = 80, den: int = 100, **options) -> DataFrame:
    """docs with one row of each group: that with the smallest doc_id (a null one counts as the largest), then the least text hash.

    Rows that agree in doc_id and text are repeats, of which one stays, empty texts included; otherwise texts without words are no
    copies of each other and stay. All columns of docs are kept; an empty table stays empty. What goes is a list of two numbers
    a row, broadcast if its count shows that it is small; texts are shuffled only beyond that.
    """
    rows = _resolve(spark, docs, num, den, **options)
    own = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("tkey") == F.col("best.tkey"))
    marks = rows.withColumn("own", own).groupBy("doc_id", "tkey").agg(F.count("*").alias("n"), F.bool_and("own").alias("own"))
    marks = cut(spark, marks.where("n > 1 OR NOT own").select(F.col("doc_id").alias("near_id"), F.col("tkey").alias("near_key"), "own"), "marks")
    count = {r.own: r.n for r in marks.groupBy("own").agg(F.count("*").alias("n")).collect()}
    match = docs["doc_id"].cast("long").eqNullSafe(marks["near_id"]) & (F.xxhash64(docs["text"].cast("string")) == marks["near_key"])
    out = docs.join(small(marks, sum(count.values()), 64), match, "left_anti")
    if count.get(True):
        again = docs.join(small(marks.where("own"), count[True], 64), match)
        kept = again.groupBy(marks["near_id"], marks["near_key"]).agg(F.first(F.struct(*[docs[c] for c in docs.columns])).alias("row"))
        out = out.unionByName(kept.select("row.*"))
    return out


def _resolve(
    spark: SparkSession,
    docs: DataFrame,
    num: int,
    den: int,
    trees: int = 3,
    branch: int = 2,
    node_limit: int = 128,
    cluster_docs: int = 2048,
    cluster_shingles: int = 4_000_000,
    seed: int = 1,
) -> DataFrame:
    """Per row of docs: doc_id, tkey (hash of the text), n_shingles, cid (class) and best, the (doc_id, tkey) that leads its component."""
    text_batches(spark)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("tkey", F.xxhash64("text"))

    def scan(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows == 0:
                continue
            n, k1, k2, sk = [], [], [], []
            for s in shingle_sets(batch.column("text")):
                n.append(len(s))
                k1.append(np.bitwise_xor.reduce(mix(s + np.uint64(1))) if len(s) else np.uint64(0))
                k2.append(np.add.reduce(mix(s ^ np.uint64(0x5555))) if len(s) else np.uint64(0))
                sk.append(sketch(s).astype("<u2").tobytes() if len(s) else None)
            n = np.array(n, np.int64)
            cid = mix(np.array(k1, np.uint64) * np.uint64(3) + np.array(k2, np.uint64) + n.view(np.uint64))
            alone = mix(batch.column("doc_id").fill_null(0).to_numpy().view(np.uint64) ^ np.uint64(0xA5A5A5A5)) ^ batch.column("tkey").to_numpy().view(np.uint64)
            cid = np.where(n > 0, cid, alone).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tkey"), pa.array(n), pa.array(cid), pa.array(sk, pa.binary())], ["doc_id", "tkey", "n_shingles", "cid", "sk"])

    def paths(batches):
        import pyarrow as pa

        for b in batches:
            if b.num_rows:
                sk = np.frombuffer(b"".join(b.column("sk").to_pylist()), "<u2").reshape(-1, SKETCH)
                p = chosen_paths(sk, trees, branch, seed).astype(np.int64)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1, dtype=np.int32) * p.shape[1]), pa.array(p.ravel()))], [*b.schema.names, "paths"])

    sets = cut(spark, source.mapInArrow(scan, "doc_id long, tkey long, n_shingles long, cid long, sk binary"), "sets")
    lead = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "tkey")
    classes = sets.where("n_shingles > 0").groupBy("cid").agg(F.max("n_shingles").alias("n_shingles"), F.min(lead).alias("lead"), F.max("sk").alias("sk"))
    classes = classes.select("cid", "n_shingles", F.col("lead.doc_id").alias("doc_id"), F.col("lead.tkey").alias("tkey"), "sk")
    classes = cut(spark, classes.mapInArrow(paths, "cid long, n_shingles long, doc_id long, tkey long, sk binary, paths array<long>"), "classes")

    # nodes of the trees; those of one class vanish, equal ones are kept once
    rows = classes.select("cid", F.explode("paths").alias("path"))

    def shared(rows: DataFrame) -> DataFrame:
        n = rows.groupBy("path").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("cid")).alias("f"), F.min("cid").alias("low"))
        return n.where("n > 1").groupBy("n", "f", "low").agg(F.min("path").alias("path")).drop("f")

    nodes = cut(spark, shared(rows), "nodes")
    stars = []
    level, level_rows = nodes, rows
    small_nodes = [(nodes.where(F.col("n") <= node_limit), rows)]
    for depth in range(4):
        big = level.where(F.col("n") > node_limit).select("path", "low")
        if big.isEmpty():
            break
        inside = cut(spark, level_rows.join(big, "path"), "inside")
        if depth == 3:  # members share six or more tokens: one cluster, which the confirmation takes apart
            stars.append(inside.select(F.col("cid").alias("a"), F.col("low").alias("b")))
            break

        def deeper(batches, depth=depth):
            import pyarrow as pa

            pool = np.random.default_rng(seed * 1000 + 500 + depth).permutation(SKETCH)
            for b in batches:
                if b.num_rows:
                    sk = np.frombuffer(b"".join(b.column("sk").to_pylist()), "<u2").reshape(-1, SKETCH)
                    child = _children(b.column("path").to_numpy().view(np.uint64), sk, pool, branch)
                    yield pa.RecordBatch.from_pydict({"cid": np.repeat(b.column("cid").to_numpy(), branch), "path": child.ravel().view(np.int64)})

        level_rows = cut(spark, inside.join(classes.select("cid", "sk"), "cid").select("cid", "path", "sk").mapInArrow(deeper, "cid long, path long"), "deeper")
        level = cut(spark, shared(level_rows), "nodes")
        small_nodes.append((level.where(F.col("n") <= node_limit), level_rows))

    low_bar = SKETCH * max(0.0, num / den - 0.21)

    def spanning(batches):
        import pyarrow as pa

        a, b = [], []
        for t in runs(batches, "path"):
            ids = t.column("cid").to_numpy()
            x = np.frombuffer(b"".join(t.column("sk").to_pylist()), "<u2").reshape(-1, SKETCH)
            i, j = np.triu_indices(len(ids), 1)
            if len(i) <= 2000:
                same = (x[i] == x[j]).sum(axis=1)
            else:
                same = np.concatenate([(x[k] == x[k + 1 :]).sum(axis=1) for k in range(len(ids) - 1)])
            ok = same >= low_bar
            label = union_find(len(ids), i[ok], j[ok])
            low = np.full(len(ids), np.iinfo(np.int64).max)
            np.minimum.at(low, label, ids)
            own = low[label]
            a.append(ids[own != ids])
            b.append(own[own != ids])
            if len(a) > 5000:
                yield pa.RecordBatch.from_pydict({"a": np.concatenate(a), "b": np.concatenate(b)})
                a, b = [], []
        if a:
            yield pa.RecordBatch.from_pydict({"a": np.concatenate(a), "b": np.concatenate(b)})

    for chosen, of in small_nodes:
        inside = of.join(chosen.select("path"), "path").join(classes.select("cid", "sk"), "cid")
        stars.append(inside.select("path", "cid", "sk").repartition("path").sortWithinPartitions("path").mapInArrow(spanning, "a long, b long"))
    edges = stars[0]
    for more in stars[1:]:
        edges = edges.unionByName(more)
    light = classes.select("cid", "n_shingles", "doc_id", "tkey")
    cluster = cut(spark, components(spark, edges).join(light, F.col("id") == F.col("cid")).select("cid", "n_shingles", "doc_id", "tkey", F.col("component").alias("cluster")), "cluster")
    found = _confirm(spark, source, cluster, num, den, cluster_docs, cluster_shingles)
    found = cut(spark, cluster.join(found, F.col("cid") == F.col("id")).select("cid", "component", F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "tkey").alias("lead")), "found")
    best = found.groupBy("component").agg(F.min("lead").alias("best"))
    best = found.join(best, "component").select("cid", "best")
    led = light.join(best, "cid", "left").select("cid", F.coalesce("best", F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "tkey")).alias("best"))
    out = sets.select("doc_id", "tkey", "n_shingles", "cid").join(led, "cid", "left")
    return out.withColumn("best", F.coalesce("best", F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "tkey")))


def _confirm(spark: SparkSession, source: DataFrame, cluster: DataFrame, num: int, den: int, most: int, weight: int) -> DataFrame:
    """Rows (id, component) of classes whose links hold on full sets."""
    size = cluster.groupBy("cluster").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("w"))
    size = size.withColumn("blocks", F.greatest(F.ceil(F.col("n") / most), F.ceil(F.col("w") / weight)).cast("int"))
    size = cut(spark, size, "size")
    name = ["cid", "doc_id", "tkey"]
    tasks = cluster.join(size.select("cluster", "blocks"), "cluster")
    one = tasks.where("blocks <= 1").select(*name, F.xxhash64("cluster").alias("task"))
    many = tasks.where("blocks > 1").select(*name, "cluster", "blocks", F.pmod(F.xxhash64("cid"), "blocks").cast("int").alias("block"))
    is_many = not size.where("blocks > 1").isEmpty()
    if is_many:
        many = cut(spark, many, "many")
        # the pivots of a cluster: 16 classes of the least hash, found by a bounded aggregate
        pivot = many.groupBy("cluster", F.pmod(F.xxhash64("cid", F.lit(5)), F.lit(16)).alias("p")).agg(F.min_by(F.struct(*name), F.xxhash64("cid", F.lit(9))).alias("d"))
        pivot = pivot.join(size.select("cluster", "blocks"), "cluster").select("d.*", "cluster", F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"))
        placed = many.select(*name, "cluster", "block").unionByName(pivot).distinct()
        one = one.unionByName(placed.select(*name, F.xxhash64("cluster", "block").alias("task")))
    found = cut(spark, _linked(source, one, cluster.count(), num, den), "linked")
    if not is_many:
        return found.select(F.col("a").alias("id"), F.col("b").alias("component"))
    single = found.join(many.select(F.col("cid").alias("a")), "a", "left_anti").select(F.col("a").alias("id"), F.col("b").alias("component"))
    part = found.join(many.select(F.col("cid").alias("a")), "a", "left_semi").select("a", "b")
    comp = cut(spark, components(spark, part), "comp")
    state = cut(spark, many.join(comp, many.cid == comp.id, "left").select(*name, "cluster", "block", "blocks", F.coalesce("component", "cid").alias("c")), "state")
    main = state.groupBy("cluster", "c").agg(F.count("*").alias("k")).groupBy("cluster").agg(F.max_by("c", "k").alias("main"))
    state = state.join(main, "cluster")
    rest = state.where("c <> main")
    # a block with classes outside the main component meets every block of its cluster, a pair of blocks a task
    odd = rest.select("cluster", "block").distinct()
    pairs = odd.join(size.select("cluster", "blocks"), "cluster").select("cluster", F.col("block").alias("x"), F.explode(F.expr("sequence(0, blocks - 1)")).alias("y"))
    left = rest.join(pairs.withColumnRenamed("x", "block"), ["cluster", "block"]).select(*name, F.xxhash64("cluster", "block", "y").alias("task"))
    right = state.join(pairs.withColumnRenamed("y", "block"), ["cluster", "block"]).select(*name, F.xxhash64("cluster", "x", "block").alias("task"))
    again = cut(spark, left.unionByName(right).distinct(), "again")
    more = _linked(source, again, again.count(), num, den)
    final = components(spark, part.unionByName(more))
    whole = many.select("cid").join(final, F.col("cid") == F.col("id"), "left").select(F.col("cid").alias("id"), F.coalesce("component", "cid").alias("component"))
    return single.unionByName(whole)


def _linked(source: DataFrame, tasks: DataFrame, rows: int, num: int, den: int) -> DataFrame:
    """Star edges between classes that a task of tasks(cid, doc_id, tkey, task) links; doc_id and tkey find the text of a class."""
    side = tasks.withColumnsRenamed({"doc_id": "at_id", "tkey": "at_key"})
    placed = source.join(small(side, rows, 96), F.col("doc_id").eqNullSafe(F.col("at_id")) & (F.col("tkey") == F.col("at_key"))).select("task", "cid", "text")
    return placed.repartition("task").sortWithinPartitions("task").mapInArrow(_compare(num, den), "task long, a long, b long").select("a", "b").distinct()


def brute_force(rows: list[tuple[int, str | None]], num: int = 85, den: int = 100) -> pd.DataFrame:
    """All pairs of a small fixture, by the definition; for tests."""
    import re

    import pandas as pd

    def shingles(text: str | None) -> frozenset:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        return frozenset(tuple(w[i : i + WORDS]) for i in range(len(w) - WORDS + 1)) if len(w) >= WORDS else frozenset([tuple(w)] if w else [])

    sets = {d: shingles(t) for d, t in rows}
    ids = sorted(sets)
    parent = {d: d for d in ids}

    def root(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            k = len(sets[a] & sets[b])
            if k and den * k >= num * (len(sets[a]) + len(sets[b]) - k):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return pd.DataFrame([(d, len(sets[d]), root(d), root(d) == d) for d in ids], columns=["doc_id", "n_shingles", "component_id", "kept"])
