"""Personal data: exact base patterns and a skip-chain conditional random field that keeps labels consistent.

Base spans are matches of four patterns. The field runs over the tokens that hold a digit or an at sign and
their neighbours. Tokens inside base spans are evidence; the others get potentials from their shape, from adjacent tokens and
from skip edges: all tokens of a document with an equal or similar form (equal digits, or the same start of an address) hang on one
entity variable, so evidence reaches every repeat in one hop. Loopy belief propagation, all documents of a batch at once, yields
marginals; tokens above `SURE` become added spans, cards only if they pass Luhn.

Weights are learned by pseudo-likelihood on a bounded sample of documents, with base spans as the labels. The skip weights come from
repeats that are made for it: a base span in another spelling (no plus, other separators, no last domain) has the span's label
beside its entity and none without it. Tokens of matches that the base rules drop because several data run together carry no
label there, so the field decides them by their shape.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_batches

KINDS = ["email", "ip", "card", "phone"]
#: Documents that the field is learned from, at most (about, by hash).
FIT_ROWS = 4_000
ROUNDS, SURE = 6, 0.8
#: Log odds against an entity that no base span names; how firmly an entity takes the label of a base span.
NAMELESS, NAMED = 3.0, 20.0

_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_MAYBE = re.compile(r"[^\x20\x09-\x0D]*[0-9@][^\x20\x09-\x0D]*")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOCALS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    out, pos = [], 0
    at = text.find("@")
    while at >= 0:
        s = at
        while s > pos and text[s - 1] in _LOCALS:
            s -= 1
        m = _EMAIL.match(text, s) if s < at else None
        if m:
            out.append(m.span())
            pos = m.end()
            at = text.find("@", pos)
        else:
            at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) by start and then kind, code points, end exclusive."""
    out = [(s, 0, e) for s, e in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        if text.count(".") >= 3:
            out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                d = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(d) <= 19 and luhn(d):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                    out.append((m.start(), 3, m.end()))
    out.sort()
    return out


def unsure_spans(text: str) -> list[tuple[int, int]]:
    """Matches that the base rules drop although they may hold several data, such as a phone and a card run together."""
    out = []
    if _DIGIT.search(text):
        for pattern, most in ((_CARD, 19), (_PHONE, 15)):
            for m in pattern.finditer(text):
                parts = [p for p in re.split("[^0-9]+", m[0]) if p]
                if len(parts) > 1 and (sum(map(len, parts)) > most or pattern is _CARD and not luhn("".join(parts)) and any(12 <= len(p) <= 19 and luhn(p) for p in parts)):
                    out.append(m.span())
    return out


LABELS = len(KINDS) + 1  # 0: none
SHAPES = 16


def _shape(t: str) -> list[float]:
    digits = [c for c in t if "0" <= c <= "9"]
    n = len(digits)
    ip = t.strip(".,;:").split(".")
    return [1.0, "@" in t, "@" in t and "." in t.rpartition("@")[2], n == 0, 0 < n <= 2, 2 < n <= 4, 4 < n <= 8, 8 < n < 12, 12 <= n <= 19, t[:1] == "+", t[:1] == "(", "-" in t and n > 0, len(ip) == 4 and all(p.isdecimal() for p in ip), t.count(".") >= 2 and n > 0, n == len(t), 12 <= n <= 19 and luhn("".join(digits))]


def tokens(text: str) -> list[tuple[int, int]]:
    """Tokens with a digit or an at sign and the words next to them, in order."""
    out: list[tuple[int, int]] = []
    for m in _MAYBE.finditer(text):
        s, e = m.span()
        k = s - 1
        while k >= 0 and text[k] in " \t\n\v\f\r":
            k -= 1
        if k >= 0 and (not out or out[-1][1] <= k):
            j = k
            while j >= 0 and text[j] not in " \t\n\v\f\r":
                j -= 1
            if not out or out[-1][1] < j + 1:
                out.append((j + 1, k + 1))
        if not out or out[-1] != (s, e):
            out.append((s, e))
        after = _WORD.search(text, e)
        if after and not _DIGIT.search(after[0]) and "@" not in after[0]:
            out.append(after.span())
    return out


def _digits(t: str) -> str:
    return "".join(c for c in t if "0" <= c <= "9")


def forms(word: str) -> set[str]:
    """Names of the entities that a token may stand for."""
    out, digits = set(), _digits(word)
    if digits or "@" in word:
        out.add(word.strip(".,;:()").lower())
    local, at, domain = word.strip(".,;:()").lower().partition("@")
    if at and local and domain:
        out.add(f"{local}@{domain.split('.')[0]}")
    if len(digits) >= 4:
        out |= {digits, digits[-7:], digits[-10:]}
    return out


def other_spelling(text: str, kind: int) -> str:
    """A base span as it may be repeated: an address without its last domain, a number with other signs or none."""
    if kind == 2:
        return ".".join(re.findall(".{1,4}", _digits(text)))
    return (text.rpartition(".")[0], text.replace(".", "-"), "", _digits(text))[kind]


class Graph:
    """Nodes of many documents: tokens, then entities; chain edges between tokens, skip edges (token, entity, by its own form)."""

    def __init__(self, texts: list[str]):
        self.spans, x, evidence, chain, skip, unsure = [], [], [], [], [], []
        self.base = [base_spans(t) for t in texts]
        self.first = [0]
        self.made: list[tuple[list[float], int]] = []  # shapes and labels of base spans in another spelling
        entities = 0
        for d, text in enumerate(texts):
            own = tokens(text) if (_DIGIT.search(text) or "@" in text) else []
            begin = len(self.spans)
            base, k = self.base[d], 0
            seen: dict[str, list[int]] = {}
            open_ = unsure_spans(text) if own else []
            for i, (s, e) in enumerate(own):
                node = begin + i
                word = text[s:e]
                while k < len(base) and base[k][2] <= s:
                    k += 1
                inside = [b for b in base[k : k + 4] if b[0] < e and b[2] > s]
                self.spans.append((s, e))
                x.append(_shape(word))
                evidence.append(inside[0][1] + 1 if inside else 0)
                unsure.append(not inside and any(a < e and b > s for a, b in open_))
                if i and own[i - 1][1] >= s - 3:
                    chain.append((node - 1, node))
                keys = forms(word)
                for q in keys:
                    seen.setdefault(q, []).append((node, 1))
                for b in inside:  # a token of a number in groups also stands for the whole number
                    for q in forms(text[b[0] : b[2]]) - keys:
                        seen.setdefault(q, []).append((node, 0))
            for members in {tuple(m) for m in seen.values() if len(m) > 1}:
                skip += [(t, entities, own_form) for t, own_form in members]
                entities += 1
            self.made += [(_shape(other_spelling(text[s:e], kind)), kind + 1) for s, kind, e in base]
            self.first.append(len(self.spans))
        self.x = np.array(x, float).reshape(-1, SHAPES)
        self.y = np.array(evidence, np.int64)
        self.sure = ~np.array(unsure, bool)
        self.chain = np.array(chain, np.int64).reshape(-1, 2)
        self.skip = np.array(skip, np.int64).reshape(-1, 3)
        self.entities = entities


def patterns(g: Graph) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (shape, labels beside, labels of the same entity, label) rows of a graph, small integers, with their counts."""
    y = np.eye(LABELS)[g.y]
    beside, same = np.zeros((len(g.y), LABELS)), np.zeros((len(g.y), LABELS))
    if len(g.chain):
        np.add.at(beside, g.chain[:, 0], y[g.chain[:, 1]])
        np.add.at(beside, g.chain[:, 1], y[g.chain[:, 0]])
    skip = g.skip[g.skip[:, 2] == 1]  # else the groups of one number would explain each other
    if len(skip):
        total = np.zeros((g.entities, LABELS))
        np.add.at(total, skip[:, 1], y[skip[:, 0]])
        np.add.at(same, skip[:, 0], total[skip[:, 1]] - y[skip[:, 0]])
    rows = [np.hstack([g.x, np.minimum(beside, 2), same > 0, g.y[:, None]])[g.sure]]
    for shape, label in g.made:
        beside = 2 * np.eye(LABELS)[0]  # between two plain words
        rows.append(np.array([[*shape, *beside, *np.eye(LABELS)[label], label], [*shape, *beside, *np.zeros(LABELS), 0]]))
    got, n = np.unique(np.concatenate(rows).astype(np.int8), axis=0, return_counts=True)
    return got, n


def learn(rows: np.ndarray, n: np.ndarray, steps: int = 400) -> dict:
    """Node, chain and skip weights by pseudo-likelihood: each label given the shape and its neighbours' labels."""
    width = SHAPES + 2 * LABELS
    rows = np.asarray(rows, float).reshape(-1, width + 1)
    x, y = rows[:, :width], np.eye(LABELS)[rows[:, width].astype(int)]
    x = np.hstack([x[:, : SHAPES + LABELS], np.zeros((len(x), 1)), x[:, SHAPES + LABELS + 1 :]])  # mates without a label say nothing
    share = (n / max(n.sum(), 1))[:, None]
    w, m1, m2 = (np.zeros((width, LABELS)) for _ in range(3))
    for step in range(1, steps + 1 if len(x) else 0):
        z = x @ w
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        grad = x.T @ ((p - y) * share) + 1e-4 * w
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad**2
        w -= 0.1 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
    c = w[SHAPES : SHAPES + LABELS]
    return {"node": w[:SHAPES], "chain": (c + c.T) / 2, "skip": w[SHAPES + LABELS :]}


def marginals(g: Graph, w: dict) -> np.ndarray:
    """Loopy sum-product beliefs of the tokens; base tokens are held at their labels."""
    n = len(g.y)
    node = g.x @ w["node"]
    node = node - np.logaddexp.reduce(node, axis=1, keepdims=True) if n else node
    known = g.y > 0
    node[known] = -30.0
    node[known, g.y[known]] = 0.0
    prior = np.tile([0.0] + [-NAMELESS] * (LABELS - 1), (g.entities, 1))
    node = np.concatenate([node, prior])
    token, entity = g.skip[:, 0], g.skip[:, 1] + n
    src = np.concatenate([g.chain[:, 0], g.chain[:, 1], token, entity])
    dst = np.concatenate([g.chain[:, 1], g.chain[:, 0], entity, token])
    nc, ns = len(g.chain), len(g.skip)
    back = np.concatenate([np.arange(nc) + nc, np.arange(nc), np.arange(ns) + 2 * nc + ns, np.arange(ns) + 2 * nc])
    down = np.where(known[token][:, None, None], NAMED * np.eye(LABELS) * (np.abs(w["skip"]).sum() > 0), w["skip"])  # entity, token
    pot = np.concatenate([np.broadcast_to(w["chain"], (2 * nc, LABELS, LABELS)), down.transpose(0, 2, 1), down])
    msg = np.zeros((len(src), LABELS))
    belief = node.copy()
    for _ in range(ROUNDS if len(src) else 0):
        out = (belief[src] - msg[back])[:, :, None] + pot
        top = out.max(1)
        msg = top + np.log(np.exp(out - top[:, None]).sum(1))
        msg -= msg.max(1, keepdims=True)
        belief = node.copy()
        np.add.at(belief, dst, msg)
    belief = belief[:n]
    p = np.exp(belief - belief.max(1, keepdims=True)) if n else belief
    return p / p.sum(1, keepdims=True) if n else p


_TRIM = " \t\n\v\f\r.,;:!?\"'"


def all_spans(texts: list[str], w: dict) -> list[tuple[list, list]]:
    """(base, base and added) spans of each text."""
    g = Graph(texts)
    p = marginals(g, w)
    out = []
    for d, text in enumerate(texts):
        a, b = g.first[d], g.first[d + 1]
        base = g.base[d]
        added: list[tuple[int, int, int]] = []
        if b > a:
            label = p[a:b].argmax(1)
            for i in np.flatnonzero((label > 0) & (p[a:b].max(1) >= SURE) & (g.y[a:b] == 0)):
                s, e = g.spans[a + i]
                while s < e and text[s] in _TRIM:
                    s += 1
                while e > s and text[e - 1] in _TRIM:
                    e -= 1
                if s == e or not (_DIGIT.search(text, s, e) or "@" in text[s:e]) or any(x[0] < e and x[2] > s for x in base):
                    continue
                k = int(label[i]) - 1
                whole = sum("0" <= c <= "9" for c in text[s:e]) >= 9  # a number by itself, no group of one
                if added and added[-1][1] == k and not whole and text[added[-1][2] : s].strip(" ") == "" and s - added[-1][2] <= 2:
                    added[-1] = (added[-1][0], k, e)
                else:
                    added.append((s, k, e))
        added = [(s, k, e) for s, k, e in added if KINDS[k] != "card" or 12 <= len(_digits(text[s:e])) <= 19 and luhn(_digits(text[s:e]))]
        out.append((base, sorted(base + added)))
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def fit(spark: SparkSession, docs: DataFrame, most: int = FIT_ROWS) -> dict:
    """Weights from a sample by hash of about `most` documents at most; their distinct patterns are counted before they are gathered."""
    share = max(1, -(-docs.count() // most))
    width = SHAPES + 2 * LABELS + 1

    def count(batches):
        import pyarrow as pa

        for b in batches:
            if b.num_rows:
                rows, n = patterns(Graph([t or "" for t in b.column("text").to_pylist()]))
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in rows], pa.binary()), pa.array(n)], ["row", "n"])

    sample = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(share)) == 0).select(F.col("text").cast("string").alias("text"))
    got = sample.mapInArrow(count, "row binary, n long").groupBy("row").agg(F.sum("n").alias("n")).orderBy("row").collect()  # a pattern is a few small integers
    return learn(np.frombuffer(b"".join(bytes(r.row) for r in got), np.int8).reshape(-1, width), np.array([r.n for r in got], np.int64))


def personal_data(spark: SparkSession, docs: DataFrame, redact: bool = False, most: int = FIT_ROWS) -> DataFrame:
    """Per document: doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans, n_added; or, with redact,
    the columns of docs with every span's text replaced by its kind in angle brackets.

    A null text is empty and stays null when redacted. Null and repeated doc_ids are rows of their own; an empty table gives
    no rows; n_chars follows the redacted text where docs has it; other columns are kept by redact and else ignored.
    """
    text_batches(spark)
    held = spark.sparkContext.broadcast(fit(spark, docs, most))

    def find(batches):
        import pyarrow as pa

        for b in batches:
            if b.num_rows == 0:
                continue
            found = all_spans([t or "" for t in b.column("text").to_pylist()], held.value)
            count = np.array([[sum(k == i for _, k, _ in base) for i in range(len(KINDS))] for base, _ in found], np.int64).reshape(-1, len(KINDS))
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), **{f"n_{k}": count[:, i] for i, k in enumerate(KINDS)}, "base_sha256": [hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found], "spans": [joined(spans) for _, spans in found], "n_added": np.array([len(spans) - len(base) for base, spans in found], np.int64)})

    def hide(batches):
        import pyarrow as pa

        for b in batches:
            texts = b.column("text").to_pylist()
            new = []
            for t, (_, spans) in zip(texts, all_spans([t or "" for t in texts], held.value)):
                out, at = [], 0
                for s, k, e in spans:
                    if s >= at:
                        out += [t[at:s], f"<{KINDS[k].upper()}>"]
                    at = max(at, e)
                new.append(None if t is None else "".join(out) + t[at:])
            yield b.set_column(b.schema.get_field_index("text"), "text", pa.array(new, pa.string()))

    if redact:
        out = docs.withColumn("text", F.col("text").cast("string"))
        out = out.mapInArrow(hide, out.schema)
        return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(find, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")
