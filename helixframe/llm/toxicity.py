"""Toxicity: Levenshtein automata intersected with a lexicon trie, and context windows around the hits.

The lexicon (whole words and word stems) is mined from labelled training rows. The trie of its terms is crossed with the
Levenshtein automaton of one edit (over code points; terms of `FUZZY` letters and more) and determinised; a task runs all its
words through the table at once, a letter at a time, and drops words that reached the dead state. Near misses that clean
training texts use are exceptions, found by running the automaton over all their distinct words. Each hit looks at a window
around it: quotation marks and words of reporting make it quoted. A logistic model over direct, misspelled and quoted hits
gives the score; as training texts seldom misspell, each of them also counts with its exact hits taken for misspelled ones.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_texts, bucket_of, chunks, cut, drop, text_batches
from .quality import _sig, labelled

#: Labelled documents that lexicon and weights are learned from, at most (about, by hash).
FIT_ROWS = 20_000
#: Terms of the lexicon, at most, the most telling ones: bounds the automaton.
TERMS = 400
#: Letters that a term has at least for an edit to be allowed; one edit turns shorter ones into too many words.
FUZZY = 4
#: Independent toxic documents that hold a term, at least, and the share of such among all that hold it.
LEAST, SHARE = 8, 0.9
WINDOW = 60
FEATURES = 6
CUES = frozenset("quote quoted quotes said says wrote writes called calls reported according cited slur word term".split())
_OPEN, _CLOSE = frozenset('"\u201c\u00ab\u201e'), frozenset('"\u201d\u00bb\u201c')

_SPAN = 0x3000  # letters by table below, all letters above
_IN_WORD = np.array([chr(c).isalnum() or c in (36, 64) for c in range(_SPAN)])
_FOLD = np.array([ord(chr(c).lower()) if len(chr(c).lower()) == 1 else c for c in range(_SPAN)], np.uint32)


class Automaton:
    """Deterministic table over letters for (term, is_stem, edits) entries; accepts give (term, edits).

    A word is accepted by a term within its edits, and by a stem if some prefix of the word, not the whole, is within the stem's
    edits; the fewest edits win, then the term that is listed first.
    """

    def __init__(self, terms: list[tuple[str, bool, int]], exceptions: set[str] = frozenset()):
        self.exceptions = exceptions
        self.stem = [int(stem) for _, stem, _ in terms]
        self.letters = np.array(sorted({ord(c) for t, _, _ in terms for c in t}), np.uint32)
        place = {chr(c): i + 1 for i, c in enumerate(self.letters.tolist())}
        nxt: list[dict[int, int]] = [{}]
        end: list[tuple[int, bool] | None] = [None]
        most = [0]  # edits allowed below a node
        for k, (t, stem, edits) in enumerate(terms):
            node = 0
            most[0] = max(most[0], edits)
            for c in t:
                c = place[c]
                if c not in nxt[node]:
                    nxt[node][c] = len(nxt)
                    nxt.append({})
                    end.append(None)
                    most.append(0)
                node = nxt[node][c]
                most[node] = max(most[node], edits)
            if end[node] is None or stem:
                end[node] = (k, stem)

        def close(states: set) -> frozenset:
            """With deletions; a stem that was passed is the state -1 - term, which any letter keeps."""
            best: dict[int, int] = {}
            todo = list(states)
            while todo:
                node, e = todo.pop()
                if best.get(node, 9) <= e or node >= 0 and e > most[node]:
                    continue
                best[node] = e
                if node >= 0:
                    todo += [(child, e + 1) for child in nxt[node].values()]
            sure = [n for n, e in best.items() if n < 0 and e == 0]
            return frozenset([(max(sure), 0)]) if sure else frozenset(best.items())

        start = close({(0, 0)})
        ids, order = {frozenset(): 0, start: 1}, [frozenset(), start]
        rows, accept = [], []
        i = 0
        while i < len(order):
            st = order[i]
            hits = sorted([(e, -1 - n) for n, e in st if n < 0] + [(e, end[n][0]) for n, e in st if n >= 0 and end[n] and not end[n][1] and e <= terms[end[n][0]][2]])
            accept.append((hits[0][1], hits[0][0]) if hits else (-1, 0))
            row = []
            for c in range(len(self.letters) + 1):
                to = set()
                for n, e in st:
                    if n < 0:
                        to.add((n, e))
                        continue
                    if end[n] and end[n][1] and e <= terms[end[n][0]][2]:
                        to.add((-1 - end[n][0], e))
                    if c in nxt[n]:
                        to.add((nxt[n][c], e))
                    to.add((n, e + 1))
                    to |= {(child, e + 1) for child in nxt[n].values()}
                new = close(to)
                if new not in ids:
                    ids[new] = len(order)
                    order.append(new)
                row.append(ids[new])
            rows.append(row)
            i += 1
        self.table = np.array(rows, np.int32)
        self.fixed = (self.table == np.arange(len(rows))[:, None]).all(axis=1)  # nothing more to read
        self.term = np.array([a for a, _ in accept], np.int32)
        self.edits = np.array([e for _, e in accept], np.int32)

    def run(self, b: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, term, edits) of the words b[s:e] (folded code points) that a term accepts and no exception lists."""
        at = np.minimum(np.searchsorted(self.letters, b), max(len(self.letters) - 1, 0))
        letter = np.where(self.letters[at] == b, at + 1, 0) if len(self.letters) else np.zeros(len(b), np.int64)
        state = np.ones(len(s), np.int32)
        alive = np.arange(len(s))
        pos = 0
        while len(alive):
            alive = alive[s[alive] + pos < e[alive]]
            new = self.table[state[alive], letter[s[alive] + pos]]
            state[alive] = new
            alive = alive[~self.fixed[new]]
            pos += 1
        hit = np.flatnonzero(self.term[state] >= 0)
        term, edits = self.term[state[hit]], self.edits[state[hit]]
        if self.exceptions and (edits > 0).any():
            ok = np.array([x == 0 or text_of(b[s[w] : e[w]]) not in self.exceptions for w, x in zip(hit, edits)], bool)
            hit, term, edits = hit[ok], term[ok], edits[ok]
        return hit, term, edits


def text_of(b: np.ndarray) -> str:
    return b.astype("<u4").tobytes().decode("utf-32-le")


def words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of UTF-8 texts: folded code points, starts and ends of the words, the first word of each text with the total, and the
    place of each text's first code point with the total."""
    raw = buf[int(offsets[0]) : int(offsets[-1])]
    b = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), "<u4")
    lead = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    off = lead[offsets - int(offsets[0])]
    low = np.minimum(b, _SPAN - 1)
    b = np.where(b < _SPAN, _FOLD[low], b)
    inside = np.concatenate([[False], (b >= _SPAN) | _IN_WORD[np.minimum(b, _SPAN - 1)], [False]]).astype(np.int8)
    edge = np.diff(inside)
    s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    cut_ = off[1:-1]
    cut_ = cut_[(cut_ > 0) & (cut_ < len(b))]
    cut_ = cut_[(inside[cut_] == 1) & (inside[cut_ + 1] == 1)]  # a word must not reach into the next text
    if len(cut_):
        s, e = np.sort(np.concatenate([s, np.unique(cut_)])), np.sort(np.concatenate([e, np.unique(cut_)]))
    return b, s, e, np.searchsorted(s, off), off


def hits(auto: Automaton, column) -> np.ndarray:
    """Per text the counts (FEATURES) of its hits: exact, stem, misspelled, each direct and quoted, as logarithms."""
    buf, offsets = arrow_texts(column)
    out = np.zeros((len(offsets) - 1, FEATURES))
    for i, j in chunks(offsets):
        b, s, e, first, off = words(buf, offsets[i : j + 1])
        w, term, edits = auto.run(b, s, e)
        if len(w) == 0:
            continue
        doc = np.searchsorted(first, w, "right") - 1
        for k, d, t, x in zip(w, doc, term, edits):
            lo, hi = max(int(off[d]), int(s[k]) - WINDOW), min(int(off[d + 1]), int(e[k]) + WINDOW)
            left, right = text_of(b[lo : int(s[k])]), text_of(b[int(e[k]) : hi])
            quoted = not _OPEN.isdisjoint(left) and not _CLOSE.isdisjoint(right)
            quoted = quoted or not CUES.isdisjoint(x.strip('.,;:!?"') for x in (left + " " + right).split())
            out[i + d, (2 if x else auto.stem[t]) * 2 + quoted] += 1
    return np.log1p(out)


def lexicon(spark: SparkSession, sample: DataFrame) -> tuple[list[tuple[str, bool, int]], set[str]]:
    """Telling words and stems of the sample (doc_id, text, y), and clean words that they would take for misspellings.

    A document stands for a word with one of the word's contexts (the words before and after, the least by hash); documents that
    agree in it count once, so a text that was copied often and is labelled toxic does not make its vocabulary telling.
    """

    def contexts(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows == 0:
                continue
            y = batch.column("y").to_numpy()
            buf, offsets = arrow_texts(batch.column("text"))
            for i, j in chunks(offsets):
                b, s, e, first, _ = words(buf, offsets[i : j + 1])
                names = [text_of(b[x:z]) for x, z in zip(s, e)]
                out: dict = {}
                for d in range(j - i):
                    own = names[first[d] : first[d + 1]]
                    for before, w, after in zip(["", *own], own, [*own[1:], ""]):
                        if 3 <= len(w) <= 40:
                            c = zlib.crc32(f"{before} {after}".encode())
                            key = (w, int(y[i + d]), d)
                            if key not in out or c < out[key]:
                                out[key] = c
                if out:
                    yield pa.RecordBatch.from_pydict({"word": [k[0] for k in out], "y": np.array([k[1] for k in out], np.int32), "c": np.array(list(out.values()), np.int64)})

    pair = sample.select("y", "text").mapInArrow(contexts, "word string, y int, c long").groupBy("word", "c").agg(F.max("y").alias("y1"), F.min("y").alias("y0"))
    per = cut(spark, pair.groupBy("word").agg(F.sum("y1").cast("long").alias("n1"), F.sum(1 - F.col("y0")).cast("long").alias("n0")), "words")
    telling = F.col("n1") >= SHARE * (F.col("n1") + F.col("n0"))
    strong = per.where((F.col("n1") >= LEAST) & telling).orderBy(F.desc("n1"), "word").limit(4 * TERMS).collect()
    stems = None
    for size in range(4, 9):
        part = per.where(F.length("word") > size).groupBy(F.substring("word", 1, size).alias("stem")).agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"), F.count("*").alias("k"), F.max("n1").alias("top"))
        part = part.where((F.col("n1") >= 2 * LEAST) & telling & (F.col("k") >= 4) & (F.col("top") * 2 <= F.col("n1")))
        stems = part if stems is None else stems.unionByName(part)
    prefixes: list[str] = []
    for r in sorted(stems.orderBy(F.desc("n1"), "stem").limit(4 * TERMS).collect(), key=lambda r: (len(r.stem), -r.n1)):
        if not any(r.stem.startswith(p) for p in prefixes):
            prefixes.append(r.stem)
    whole = [r.word for r in strong if not any(r.word.startswith(p) for p in prefixes)]
    terms = [(w, stem, int(len(w) >= FUZZY)) for w, stem in [*((p, True) for p in prefixes), *((w, False) for w in whole)][:TERMS]]
    held = spark.sparkContext.broadcast(Automaton(terms))

    def close(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                buf, offsets = arrow_texts(batch.column("word"))
                b, s, e, first, _ = words(buf, offsets)
                w, _, edits = held.value.run(b, s, e)
                near = batch.column("word").to_pylist()
                yield pa.RecordBatch.from_pydict({"word": [near[int(np.searchsorted(first, k, "right")) - 1] for k in w[edits > 0]]}, schema=pa.schema([("word", pa.string())]))

    clean = per.where((F.col("n0") > 0) & (F.col("n0") * 4 > F.col("n1"))).select("word").mapInArrow(close, "word string")
    exceptions = {r.word for r in clean.collect()}  # words one edit away from at most TERMS terms, in a bounded sample
    drop(per)
    return terms, exceptions


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 60, ridge: float = 0.5) -> np.ndarray:
    """Weights, none below 0, and the intercept last: Newton steps, the weights drawn to 0."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x1.shape[1])
    pull = np.full(len(w), ridge)
    pull[-1] = 1e-3
    for _ in range(steps):
        p = _sig(x1 @ w)
        grad = x1.T @ (p - y) + pull * w
        hess = (x1 * (p * (1 - p))[:, None]).T @ x1 + np.diag(pull)
        step = np.linalg.solve(hess, grad)
        w = w - step * min(1.0, 2.0 / (np.abs(step).max() + 1e-9))
        w[:-1] = np.maximum(w[:-1], 0.0)  # a hit never speaks for a text
    return w


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, target: str, train, most: int):
    """(automaton, weights); (None, the only label) without labels of both kinds."""
    sample = cut(spark, labelled(docs, labels, target, train, most), "labelled")
    kinds = dict(sample.groupBy("y").count().collect())
    if len(kinds) < 2:
        drop(sample)
        return None, (sum(kinds) / len(kinds) if kinds else 0.0)
    half = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(3)) < 2  # lexicon and weights from different documents
    terms, clean = lexicon(spark, sample.where(half))
    auto = Automaton(terms, clean)
    held = spark.sparkContext.broadcast(auto)

    def count(batches):
        import pyarrow as pa

        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_pydict({"y": b.column("y"), "x": hits(held.value, b.column("text")).tolist()})

    got = sample.where(~half).select("y", "text").mapInArrow(count, "y int, x array<double>").toArrow()
    drop(sample)
    x = np.array(got.column("x").to_pylist()).reshape(-1, FEATURES)
    wrong = np.zeros_like(x)  # the same texts with every hit misspelled
    wrong[:, 4:] = np.log1p(np.expm1(x).reshape(-1, 3, 2).sum(1))
    y = got.column("y").to_numpy().astype(float)
    return auto, logistic(np.concatenate([x, wrong]), np.concatenate([y, y]))


def verdicts(spark: SparkSession, docs: DataFrame, labels: DataFrame, target: str, bar: float, most: int):
    """The fitted scorer: Arrow column of texts -> (score, predicted, features), for use in tasks."""
    fold = bucket_of("doc_id", 4) == 2
    held = spark.sparkContext.broadcast(fit(spark, docs, labels, target, ~fold, most))

    def score(column):
        auto, w = held.value
        x = hits(auto, column) if auto else np.zeros((len(column), FEATURES))
        p = _sig(x @ w[:-1] + w[-1]) if auto else np.full(len(column), float(w))
        return p, p >= bar, x

    return score


def toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame, target: str = "toxic", bar: float = 0.3, most: int = FIT_ROWS) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted, n_hits.

    Learns from labelled rows outside the fold crc32(doc_id) mod 4 = 2, at most about `most` of them. Null, empty and blank
    texts have no hits and get the lowest score. Without labels of both kinds every score is the only label's (0 without
    labels). Rows with a null doc_id are dropped; repeated rows get a row each; an empty table gives no rows; other columns are ignored.
    """
    text_batches(spark)
    score = verdicts(spark, docs, labels, target, bar, most)

    def judge(batches):
        import pyarrow as pa

        for b in batches:
            if b.num_rows:
                p, bad, x = score(b.column("text"))
                yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "held_out": b.column("held_out"), "score": p, "predicted": bad.astype(np.int32), "n_hits": np.rint(np.expm1(x).sum(1)).astype(np.int64)})

    source = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("held_out", bucket_of("doc_id", 4) == 2)
    return source.mapInArrow(judge, "doc_id long, held_out boolean, score double, predicted int, n_hits long")


def without_toxic(spark: SparkSession, docs: DataFrame, labels: DataFrame, target: str = "toxic", bar: float = 0.3, most: int = FIT_ROWS) -> DataFrame:
    """The rows of docs that the classifier does not reject, judged and passed on in one scan.

    A row is judged by its text alone, so rows with a null doc_id and repeated rows are judged too; all columns stay as they
    are; null and empty texts stay; an empty table stays empty.
    """
    text_batches(spark)
    score = verdicts(spark, docs, labels, target, bar, most)

    def keep(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for b in batches:
            if b.num_rows:
                text = pc.cast(b.column("text"), pa.string())
                yield b.filter(pa.array(~score(text)[1]))

    return docs.mapInArrow(keep, docs.schema)
