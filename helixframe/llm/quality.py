"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of `PASSAGE` words. Each passage is encoded from its words (the mean of learned vectors of
hashed words) and from counts that a few passes over the bytes give (case, symbols, digits, repetition, word lengths); a gated
attention weighs the encodings and a logistic head scores their weighted mean. All weights, word vectors included, are learned
together from document labels, on a bounded sample of labelled rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_texts, bucket_of, chunks, mix, small, text_batches, word_hashes

#: Labelled documents that the model is fitted on, at most (about, by hash).
FIT_ROWS = 8_000
PASSAGE = 64
HIDDEN, GATE = 16, 8
#: Rows of the table of word vectors; words share them by hash.
WORDS = 1 << 13
#: Documents of a step, steps and the pull of the word vectors to 0 when fitting.
BATCH, STEPS, SHRINK = 256, 300, 2e-4

_KINDS = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b"!", b"%#$&*", b"|", b".", b",", b"\n", b"<>{}[]\\/=_", b"@:;?-()'\"+", bytes(range(128, 256))]
_KIND = np.full(256, len(_KINDS), np.uint8)
for _i, _k in enumerate(_KINDS):
    _KIND[list(_k)] = _i
WIDTH = len(_KINDS) + 10


def passages(column) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(features, passages per text, rows of the word table, words per passage); a text without words has one passage of zeros."""
    buf, offsets = arrow_texts(column)
    feats, counts, words, sizes = [], [], [np.zeros(0, np.uint16)], [np.zeros(0, np.int64)]
    for i, j in chunks(offsets):
        h, s, e, first = word_hashes(buf, offsets[i : j + 1])
        m, nw = j - i, np.diff(first)
        per = np.maximum(1, -(-nw // PASSAGE))
        counts.append(per)
        x = np.zeros((int(per.sum()), WIDTH))
        feats.append(x)
        words.append((h >> np.uint64(40)).astype(np.int64).astype(np.uint16) % WORDS)
        sizes.append(np.zeros(len(x), np.int64))
        if len(h) == 0:
            continue
        base = int(offsets[i])
        kind = _KIND[buf[base : int(offsets[j])]]
        doc = np.repeat(np.arange(m), nw)
        place = np.arange(len(h)) - first[doc]
        passage = (np.cumsum(per) - per)[doc] + place // PASSAGE
        at = np.flatnonzero(np.concatenate([[True], passage[1:] != passage[:-1]]))
        rows = passage[at]
        n = np.diff(np.concatenate([at, [len(h)]])).astype(float)
        sizes[-1][rows] = n
        lo, hi = s[at] - base, e[np.concatenate([at[1:], [len(h)]]) - 1] - base
        size = np.maximum(hi - lo, 1)
        for k in range(len(_KINDS)):
            sums = np.concatenate([[0], np.cumsum(kind == k)])
            x[rows, k] = (sums[hi] - sums[lo]) / size
        length = (e - s).astype(float)
        k = len(_KINDS)

        def total(v: np.ndarray) -> np.ndarray:
            return np.add.reduceat(v.astype(float), at)

        mean = total(length) / n
        x[rows, k] = mean / 10
        x[rows, k + 1] = np.sqrt(np.maximum(total(length**2) / n - mean**2, 0)) / 10
        x[rows, k + 2] = total(length <= 3) / n
        x[rows, k + 3] = total(length > 14) / n
        same = np.zeros(len(h), bool)
        same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
        x[rows, k + 4] = total(same) / n
        _, index = np.unique(mix(h + passage.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
        new = np.zeros(len(h), bool)
        new[index] = True
        x[rows, k + 5] = total(new) / n
        trio = h.copy()
        trio[2:] = mix(h[2:] * np.uint64(3) + mix(h[1:-1] * np.uint64(5) + mix(h[:-2])))
        _, index = np.unique(mix(trio + doc.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)), return_index=True)
        new = np.zeros(len(h), bool)
        new[index] = True
        x[rows, k + 6] = total(new) / n
        last = kind[np.minimum(e - 1 - base, len(kind) - 1)]
        x[rows, k + 7] = total((last >= 3) & (last <= 5)) / n
        x[rows, k + 8] = np.log1p(n) / 5
        x[rows, k + 9] = 1.0
    return np.concatenate(feats) if feats else np.zeros((0, WIDTH)), np.concatenate(counts) if counts else np.zeros(0, np.int64), np.concatenate(words), np.concatenate(sizes)


def _sig(v: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(v, -40, 40)))


def forward(p: dict, x: np.ndarray, n: np.ndarray, words: np.ndarray, sizes: np.ndarray) -> tuple:
    """Passage encodings, both gates, attention, document encodings and scores."""
    at = np.cumsum(n) - n
    full = np.flatnonzero(sizes)
    pre = ((x - p["mean"]) / p["sd"]) @ p["W"] + p["b"]
    if len(full):
        pre[full] += np.add.reduceat(p["E"][words], (np.cumsum(sizes) - sizes)[full]) / sizes[full, None]
    h = np.tanh(pre)
    t, g = np.tanh(h @ p["V"]), _sig(h @ p["U"])
    s = (t * g) @ p["w"]
    s = np.exp(s - np.repeat(np.maximum.reduceat(s, at), n))
    a = s / np.repeat(np.add.reduceat(s, at), n)
    z = np.add.reduceat(h * a[:, None], at)
    return h, t, g, a, z, _sig(z @ p["c"] + p["c0"])


def fit(bags: list[tuple[np.ndarray, np.ndarray, np.ndarray]], y: np.ndarray, steps: int = STEPS, rate: float = 0.01, decay: float = 1e-4) -> dict:
    """Weights by Adam on the log loss of bags (features, words, words per passage), some of them a step."""
    rng = np.random.default_rng(3)
    every = np.concatenate([b[0] for b in bags])
    p = {"mean": every.mean(0), "sd": every.std(0) + 1e-6}
    p |= {"W": rng.normal(0, 0.3, (WIDTH, HIDDEN)), "b": np.zeros(HIDDEN), "V": rng.normal(0, 0.3, (HIDDEN, GATE)), "U": rng.normal(0, 0.3, (HIDDEN, GATE)), "w": rng.normal(0, 0.3, GATE), "c": rng.normal(0, 0.3, HIDDEN), "c0": np.zeros(1), "E": np.zeros((WORDS, HIDDEN))}
    names = ["W", "b", "V", "U", "w", "c", "c0", "E"]
    m1, m2 = ({k: np.zeros_like(p[k]) for k in names} for _ in range(2))
    order = np.zeros(0, np.int64)
    for step in range(1, steps + 1):
        if len(order) == 0:
            order = rng.permutation(len(bags))
        pick, order = order[:BATCH], order[BATCH:]
        x, words, sizes = (np.concatenate([bags[i][k] for i in pick]) for k in range(3))
        n, target = np.array([len(bags[i][0]) for i in pick]), y[pick]
        h, t, g, a, z, out = forward(p, x, n, words, sizes)
        at = np.cumsum(n) - n
        d = (out - target) / len(target)
        dz = d[:, None] * p["c"]
        dzr = np.repeat(dz, n, axis=0)
        da = (dzr * h).sum(1)
        ds = a * (da - np.repeat(np.add.reduceat(a * da, at), n))
        dt, dg = ds[:, None] * p["w"] * g * (1 - t**2), ds[:, None] * p["w"] * t * g * (1 - g)
        dh = (dzr * a[:, None] + dt @ p["V"].T + dg @ p["U"].T) * (1 - h**2)
        dw = np.repeat(dh / np.maximum(sizes, 1)[:, None], sizes, axis=0)
        grad = {"W": ((x - p["mean"]) / p["sd"]).T @ dh, "b": dh.sum(0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ ds, "c": z.T @ d, "c0": d.sum(keepdims=True)}
        grad["E"] = np.stack([np.bincount(words, dw[:, k], WORDS) for k in range(HIDDEN)], 1)
        for k in names:
            gk = grad[k] + (SHRINK if k == "E" else decay) * p[k]
            m1[k] = 0.9 * m1[k] + 0.1 * gk
            m2[k] = 0.999 * m2[k] + 0.001 * gk**2
            p[k] = p[k] - rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
    return p


def labelled(docs: DataFrame, labels: DataFrame, target: str, train: Column, most: int) -> DataFrame:
    """(doc_id, text, y) of about `most` labelled training rows at most, chosen by hash; labels with more than one value go by the largest."""
    y = labels.where(F.col("doc_id").isNotNull() & F.col(target).isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(target).cast("int")).alias("y"))
    y = y.where(train)
    share = max(1, -(-y.count() // most))
    y = y.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(share)) == 0)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(small(y, 2 * most, 64), "doc_id")


def quality(spark: SparkSession, docs: DataFrame, labels: DataFrame, target: str = "quality", most: int = FIT_ROWS) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted, n_passages.

    Learns from labelled rows outside the fold crc32(doc_id) mod 3 = 1, at most about `most` of them. Null, empty and
    blank texts are one passage without words and get the score of such a bag. Without labels of both kinds every score is the
    share of label 1 (0.5 without labels). Rows with a null doc_id are dropped; repeated rows get a row each; an empty
    table gives no rows; other columns are ignored.
    """
    text_batches(spark)
    fold = bucket_of("doc_id", 3) == 1

    def bags(batches):
        import pyarrow as pa

        for b in batches:
            if b.num_rows:
                x, n, words, sizes = passages(b.column("text"))
                at = np.concatenate([[0], np.cumsum(n)])
                to = np.concatenate([[0], np.cumsum(sizes)])[at]
                yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "y": b.column("y"), "x": [x[i:j].tobytes() for i, j in zip(at, at[1:])], "w": [words[i:j].tobytes() for i, j in zip(to, to[1:])], "s": [sizes[i:j].tobytes() for i, j in zip(at, at[1:])]})

    got = labelled(docs, labels, target, ~fold, most).mapInArrow(bags, "doc_id long, y int, x binary, w binary, s binary").toArrow().sort_by("doc_id")
    y = got.column("y").to_numpy().astype(float) if got.num_rows else np.zeros(0)
    model = None
    if len(y) and y.min() != y.max():
        model = fit([(np.frombuffer(x).reshape(-1, WIDTH), np.frombuffer(w, np.uint16).astype(np.int64), np.frombuffer(s, np.int64)) for x, w, s in zip(*(got.column(k).to_pylist() for k in "xws"))], y)
    flat = float(y.mean()) if len(y) else 0.5
    held = spark.sparkContext.broadcast(model)

    def judge(batches):
        import pyarrow as pa

        p = held.value
        for b in batches:
            if b.num_rows == 0:
                continue
            x, n, words, sizes = passages(b.column("text"))
            out = forward(p, x, n, words, sizes)[-1] if p else np.full(b.num_rows, flat)
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "held_out": b.column("held_out"), "score": out, "predicted": (out >= 0.5).astype(np.int32), "n_passages": n.astype(np.int64)})

    source = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("held_out", fold)
    return source.mapInArrow(judge, "doc_id long, held_out boolean, score double, predicted int, n_passages long")
