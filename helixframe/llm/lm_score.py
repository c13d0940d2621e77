"""Language-model scoring with a log-frequency Bloom filter of n-gram counts.

Counting: every task reduces its tokens and bigrams to distinct 64-bit hashes with counts and ships them as one
packed block per hash bucket; a bucket is merged by one sort. The number of buckets follows the input's bytes, so a
bucket stays small at any size. Each bucket keeps exact token counts and builds its own segment of the filter: an
n-gram of count c is entered once per level 1 .. 1 + log2(c), so the largest level found tells the quantised count. Tokens and
bigrams seen once are entered too.

Scoring: segments are broadcast as one file, written segment by segment, which the workers of an executor map into memory and
share; a Dirichlet-smoothed bigram model is read by repeated membership probes. The exact base score looks up the most frequent
words (a bounded broadcast) on the spot and sends the other tokens, packed, to their bucket, which holds the exact counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark import Broadcast, SparkContext, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_texts, bucket_of, chunks, cut, mix, runs, spread, text_batches, word_hashes

END = np.uint64(0xE0F1D2C3B4A59687)
BITS_PER_ENTRY = 10
PROBES = 5
#: Most frequent words whose counts are broadcast exactly: 16 bytes each.
HEAVY = 1 << 18
#: Entries that a task holds before it sends blocks off.
HELD = 1_500_000
MU = 40.0


def tokens(column):
    """Per chunk of texts: (first text, token hashes with an end per text, first token of each text and the total)."""
    buf, offsets = arrow_texts(column)
    for i, j in chunks(offsets):
        h, _, _, first = word_hashes(buf, offsets[i : j + 1])
        yield i, np.insert(h, first[1:], END), first + np.arange(len(first))


def bigrams(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Hash of each token and the one before it; before the first stands the end."""
    prev = np.empty_like(h)
    prev[1:] = h[:-1]
    prev[first[:-1]] = END
    return mix(prev * np.uint64(3) + mix(h))


def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    if len(k) == 0:
        return k, c
    at = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    return k[at], np.add.reduceat(c, at)


def _slots(keys: np.ndarray, level: int, bits: np.ndarray | int) -> list[np.ndarray]:
    a = mix(keys + np.uint64(level * 0x9E3779B97F4A7C15 % 2**64))
    b = mix(a ^ np.uint64(0xABCDEF)) | np.uint64(1)
    return [(a + np.uint64(i) * b) % np.asarray(bits, np.uint64) for i in range(PROBES)]


def segment(keys: np.ndarray, levels: np.ndarray, per_entry: int = BITS_PER_ENTRY) -> np.ndarray:
    """A filter (bytes) that holds each key at levels 1 .. its own."""
    bits = max(64, -(-int(levels.sum()) * per_entry // 8) * 8)
    flags = np.zeros(bits, bool)
    for level in range(1, int(levels.max(initial=0)) + 1):
        for slot in _slots(keys[levels >= level], level, bits):
            flags[slot.astype(np.int64)] = True
    return np.packbits(flags)


class FileBroadcast(Broadcast):
    """A broadcast of bytes that never stand in the driver's memory as a whole: chunks are written as they come.

    The file is the pickle of one bytes object, so value works as usual; workers rather map its bytes (``mapped``).
    """

    HEAD = 11

    def __init__(self, sc: SparkContext, chunks_: Iterator[bytes], size: int):
        super().__init__(sc, (chunks_, size), sc._pickled_broadcast_vars)

    def dump(self, value, f) -> None:
        chunks_, size = value
        f.write(b"\x80\x05\x8e" + size.to_bytes(8, "little"))
        for chunk in chunks_:
            f.write(chunk)
        f.write(b".")
        f.close()


def mapped(held: Broadcast, size: int) -> np.ndarray:
    """On a worker: the bytes of a FileBroadcast, shared with the other workers of the executor."""
    path = getattr(held, "_path", None)
    return np.memmap(path, np.uint8, "r", FileBroadcast.HEAD, (size,)) if path and size else np.frombuffer(held.value, np.uint8)


class Filter:
    """All segments laid end to end; level() probes level after level until one is missing."""

    def __init__(self, data: np.ndarray, start: np.ndarray, size: np.ndarray):
        self.data, self.start, self.bits, self.buckets = data, start * 8, np.maximum(size * 8, 1).astype(np.uint64), len(size)

    def level(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), np.int32)
        seg = (keys % np.uint64(self.buckets)).astype(np.int64)
        alive, level = np.flatnonzero(self.bits[seg] > 1), 1
        while len(alive):
            k, s = keys[alive], seg[alive]
            ok = np.ones(len(alive), bool)
            for slot in _slots(k, level, self.bits[s]):
                at = slot.astype(np.int64) + self.start[s]
                ok &= (self.data[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
            alive = alive[ok]
            out[alive] = level
            level += 1
        return out


def levels_of(c: np.ndarray) -> np.ndarray:
    return (1 + np.floor(np.log2(np.maximum(c, 1)))).astype(np.int32)


def counts_of(level: np.ndarray) -> np.ndarray:
    """Middle of the range that a level stands for; 0 for no level."""
    return np.where(level <= 1, level, 1.5 * 2.0 ** (level - 1) - 0.5)


def _blocks(keys: np.ndarray, counts: np.ndarray, kind: int, buckets: int):
    import pyarrow as pa

    b = (keys % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(b, kind="stable")
    keys, counts, b = keys[order], counts[order], b[order]
    at = np.searchsorted(b, np.arange(buckets + 1))
    have = np.flatnonzero(at[1:] > at[:-1])
    narrow = counts.astype(np.uint32 if kind < 2 else np.int64)
    return pa.RecordBatch.from_arrays(
        [pa.array(have.astype(np.int32)), pa.array(np.full(len(have), kind, np.int32)), pa.array([keys[at[i] : at[i + 1]].tobytes() for i in have], pa.binary()), pa.array([narrow[at[i] : at[i + 1]].tobytes() for i in have], pa.binary()), pa.array([None] * len(have), pa.binary())],
        ["bucket", "kind", "keys", "counts", "rows"],
    )


_BLOCK = "bucket int, kind int, keys binary, counts binary, rows binary"


def score(spark: SparkSession, docs: DataFrame, held_out: F.Column | None = None, per_entry: int = BITS_PER_ENTRY) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are the lower-cased (A-Z) words between ASCII white space, then one end; a null or empty text is the end
    alone. Counts come from all rows where held_out is false. n_known counts tokens seen there, base_score is the
    sum of log10((c + 1) / (N + V + 1)); score is the log10 probability under the smoothed bigram model, its counts read from a
    filter of per_entry bits for each level of an n-gram. With nothing to learn from, c, N and V are 0. Rows with a null doc_id are dropped; a repeated doc_id gives a row
    each and counts each time; an empty table gives no rows; other columns are ignored.
    """
    text_batches(spark)
    fold = bucket_of("doc_id", 7) == 2 if held_out is None else held_out
    source = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), fold.alias("held_out"))
    buckets = spread(spark, docs, 6 << 20)
    parts = max(12, buckets // 2)

    def count(batches):
        held, n = {0: ([], []), 1: ([], [])}, 0
        for batch in batches:
            for _, h, first in tokens(batch.column("text")):
                for kind, x in ((0, h), (1, bigrams(h, first))):
                    k, c = np.unique(x, return_counts=True)
                    held[kind][0].append(k)
                    held[kind][1].append(c)
                    n += len(k)
            if n > HELD:
                for kind in held:
                    yield _blocks(*merged(*held[kind]), kind, buckets)
                held, n = {0: ([], []), 1: ([], [])}, 0
        if n:
            for kind in held:
                yield _blocks(*merged(*held[kind]), kind, buckets)

    def reduce(batches):
        import pyarrow as pa

        for t in runs(batches, "bucket"):
            kinds = t.column("kind").to_numpy()
            keys, counts = t.column("keys").to_pylist(), t.column("counts").to_pylist()
            got = []
            for kind in (0, 1):
                pick = np.flatnonzero(kinds == kind)
                got.append(merged([np.zeros(0, np.uint64), *(np.frombuffer(keys[i], np.uint64) for i in pick)], [np.zeros(0, np.int64), *(np.frombuffer(counts[i], np.uint32).astype(np.int64) for i in pick)]))
            (w, c), (p, d) = got
            seg = segment(np.concatenate([w, p]), levels_of(np.concatenate([c, d])), per_entry)
            hist = np.bincount(levels_of(c), minlength=64).astype(np.int64)
            yield pa.RecordBatch.from_pydict({"bucket": np.array([t.column("bucket")[0].as_py()], np.int32), "keys": [w.tobytes()], "counts": [c.tobytes()], "segment": [seg.tobytes()], "n": np.array([c.sum()], np.int64), "v": np.array([len(w)], np.int64), "hist": [hist.tolist()]})

    packed = source.where(~F.col("held_out")).select("text").mapInArrow(count, _BLOCK)
    model = cut(spark, packed.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(reduce, "bucket int, keys binary, counts binary, segment binary, n long, v long, hist array<long>"), "model")
    total, distinct = model.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    levels = model.select(F.posexplode("hist").alias("level", "n")).groupBy("level").agg(F.sum("n").alias("n")).orderBy(F.desc("level")).collect()
    cutoff, room = 64, HEAVY
    for r in levels:  # at most 64 rows: the least level whose words, with all above it, fit
        if r.n > room:
            break
        room, cutoff = room - r.n, r.level

    def frequent(batches):
        import pyarrow as pa

        for b in batches:
            for k, c in zip(b.column("keys").to_pylist(), b.column("counts").to_pylist()):
                k, c = np.frombuffer(k, np.uint64), np.frombuffer(c, np.int64)
                top = levels_of(c) >= cutoff
                yield pa.RecordBatch.from_pydict({"keys": [k[top].tobytes()], "counts": [c[top].tobytes()]})

    top = model.select("keys", "counts").mapInArrow(frequent, "keys binary, counts binary").collect()
    hk = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(r.keys, np.uint64) for r in top)])
    hc = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(r.counts, np.int64) for r in top)])
    order = np.argsort(hk)
    heavy = spark.sparkContext.broadcast((hk[order], hc[order]))
    lay = model.select("bucket", F.length("segment").alias("size"))
    sizes, starts, at = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64), 0
    whole = int(lay.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0])

    def segments():
        nonlocal at
        for r in model.select("bucket", "segment").toLocalIterator():  # a partition of the table at a time
            sizes[r.bucket], starts[r.bucket] = len(r.segment), at
            at += len(r.segment)
            yield bytes(r.segment)

    held_filter = FileBroadcast(spark.sparkContext, segments(), whole)
    log_d = math.log10(total + distinct + 1)

    def judge(batches):
        import pyarrow as pa

        f = Filter(mapped(held_filter, whole), starts, sizes)
        hk, hc = heavy.value
        part, at = TaskContext.get().partitionId(), 0
        held, n = ([], [], []), 0

        def flush():
            keys, tf, uid = map(np.concatenate, held)
            b = (keys % np.uint64(buckets)).astype(np.int64)
            o = np.argsort(b, kind="stable")
            keys, tf, uid, b = keys[o], tf[o], uid[o], b[o]
            e = np.searchsorted(b, np.arange(buckets + 1))
            have = np.flatnonzero(e[1:] > e[:-1])
            m = len(have)
            empty = pa.nulls(m, pa.int64())
            return pa.RecordBatch.from_arrays(
                [pa.array(have.astype(np.int32)), pa.array([keys[e[i] : e[i + 1]].tobytes() for i in have], pa.binary()), pa.array([tf[e[i] : e[i + 1]].astype(np.uint32).tobytes() for i in have], pa.binary()), pa.array([uid[e[i] : e[i + 1]].tobytes() for i in have], pa.binary()), empty, empty, pa.nulls(m, pa.bool_()), empty, empty, pa.nulls(m, pa.float64()), pa.nulls(m, pa.float64())], names)

        names = ["bucket", "keys", "counts", "rows", "uid", "doc_id", "held_out", "n_tokens", "n_known", "base", "score"]
        for batch in batches:
            if batch.num_rows == 0:
                continue
            rows = batch.num_rows
            nt, nk, base, sc = np.zeros(rows, np.int64), np.zeros(rows, np.int64), np.zeros(rows), np.zeros(rows)
            uid = (np.int64(part) << 36) + at + np.arange(rows)
            at += rows
            for i, h, first in tokens(batch.column("text")):
                m = len(first) - 1
                nt[i : i + m] = np.diff(first)
                doc = np.repeat(np.arange(m), np.diff(first))
                u, inv = np.unique(h, return_inverse=True)
                p = np.minimum(np.searchsorted(hk, u), max(len(hk) - 1, 0))
                is_heavy = hk[p] == u if len(hk) else np.zeros(len(u), bool)
                c = np.where(is_heavy, hc[p] if len(hc) else 0, 0)
                logs = np.where(is_heavy, np.log10(c + 1.0) - log_d, 0.0)
                base[i : i + m] = np.add.reduceat(logs[inv], first[:-1])
                hv = is_heavy[inv]
                nk[i : i + m] = np.add.reduceat(hv.astype(np.int64), first[:-1])
                # the smoothed bigram model, by probes
                q = counts_of(f.level(u))
                p1 = (q + 1) / (total + distinct + 1)
                g, ginv = np.unique(bigrams(h, first), return_inverse=True)
                q2 = counts_of(f.level(g))[ginv]
                prev = np.empty_like(inv)
                prev[1:] = inv[:-1]
                end = np.searchsorted(u, END)
                prev[first[:-1]] = end
                qv = q[prev]
                logp = np.log10((np.minimum(q2, qv) + MU * p1[inv]) / (qv + MU))
                sc[i : i + m] = np.add.reduceat(logp, first[:-1])
                rare = np.flatnonzero(~hv)
                if len(rare):
                    pair = (doc[rare].astype(np.uint64) << np.uint64(32)) | inv[rare].astype(np.uint64)
                    k, tf = np.unique(pair, return_counts=True)
                    held[0].append(u[(k & np.uint64(0xFFFFFFFF)).astype(np.int64)])
                    held[1].append(tf)
                    held[2].append(uid[i + (k >> np.uint64(32)).astype(np.int64)])
                    n += len(k)
            none = pa.nulls(rows, pa.binary())
            yield pa.RecordBatch.from_arrays([pa.nulls(rows, pa.int32()), none, none, none, pa.array(uid), batch.column("doc_id"), batch.column("held_out"), *map(pa.array, (nt, nk, base, sc))], names)
            if n > HELD // 2:
                yield flush()
                held, n = ([], [], []), 0
        if n:
            yield flush()

    first_pass = cut(spark, source.mapInArrow(judge, "bucket int, keys binary, counts binary, rows binary, uid long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double"), "scored")

    def lookup(batches):
        import pyarrow as pa

        for t in runs(batches, "bucket"):
            rows = t.column("rows").to_pylist()
            keys, counts = t.column("keys").to_pylist(), t.column("counts").to_pylist()
            at = [i for i, r in enumerate(rows) if r is None]
            ask = [i for i, r in enumerate(rows) if r is not None]
            if not ask:
                continue
            k = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(keys[i], np.uint64) for i in at)])
            c = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(counts[i], np.int64) for i in at)])
            q = np.concatenate([np.frombuffer(keys[i], np.uint64) for i in ask])
            tf = np.concatenate([np.frombuffer(counts[i], np.uint32) for i in ask]).astype(np.int64)
            uid = np.concatenate([np.frombuffer(rows[i], np.int64) for i in ask])
            p = np.minimum(np.searchsorted(k, q), max(len(k) - 1, 0))
            n = np.where(k[p] == q, c[p], 0) if len(k) else np.zeros(len(q), np.int64)
            u, inv = np.unique(uid, return_inverse=True)
            yield pa.RecordBatch.from_pydict({"uid": u, "base": np.bincount(inv, tf * (np.log10(n + 1.0) - log_d)), "known": np.bincount(inv, tf * (n > 0)).astype(np.int64)})

    blocks = first_pass.where("bucket IS NOT NULL").select("bucket", "keys", "counts", "rows").unionByName(model.select("bucket", "keys", "counts", F.lit(None).cast("binary").alias("rows")))
    rare = blocks.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(lookup, "uid long, base double, known long").groupBy("uid").agg(F.sum("base").alias("b"), F.sum("known").alias("k"))
    out = first_pass.where("bucket IS NULL").select("uid", "doc_id", "held_out", "n_tokens", "n_known", "base", "score").join(rare, "uid", "left")
    return out.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("k", F.lit(0))).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("b", F.lit(0.0))).alias("base_score"), "score")
