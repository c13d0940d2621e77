"""Small fixtures for every operator: against brute force, and with nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from helixframe.llm import lm_score, mixing, near_dedup, packing, pii, quality, topk, toxicity, url_filter, vector_dedup
from helixframe.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, path string, id long, held_out string, rep string"


def prose(rng, n):
    return " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi".split()) + str(rng.randrange(60)) for _ in range(n))


def corpus():
    rng = random.Random(7)
    texts = [prose(rng, rng.randint(1, 80)) for _ in range(60)]
    for i in range(20):  # near copies, some on either side of the bar
        w = texts[i].split()
        for _ in range(rng.randrange(3)):
            w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    texts += [texts[3]] * 4 + [texts[5].upper(), None, "", "  \t ", "one", "One", "a b c d", "word " * 3000, prose(rng, 6000), "é \u2003x y z w v", "a@b.co, call +1 (555) 555-1234; card 4111 1111 1111 1111; ip 10.0.0.1; 300.1.1.1"]
    return [(i + 1, t, "en" if i % 3 else None, f"src{i % 4}", len(t or ""), "x", 9, "h", "r") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("options", [{}, dict(node_limit=2, cluster_docs=3)])
def test_near_dedup(spark, docs, options):
    got = near_dedup.near_duplicates(spark, docs, **options).toPandas().sort_values("doc_id").reset_index(drop=True)
    want = near_dedup.brute_force([(r[0], r[1]) for r in corpus()])
    assert (got.values == want.values).all() and list(got.columns) == list(want.columns)


def test_near_dedup_empty_and_repeats(spark, docs, none):
    assert near_dedup.near_duplicates(spark, none).count() == 0
    twice = docs.where("doc_id < 5")
    assert near_dedup.near_duplicates(spark, twice.unionByName(twice)).count() == 4


def test_near_dedup_one_id_with_two_texts(spark):
    a, b, c = (prose(random.Random(k), 60) for k in range(3))
    rows = [(7, a), (7, b), (3, b), (9, a), (7, a), (2, c), (None, c), (None, ""), (5, ""), (5, ""), (6, None), (6, None), (None, "lone words")]
    df = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, near_id long")
    got = sorted((r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(spark, df).collect())
    assert got == [(2, 2, True), (3, 3, True), (5, 5, True), (6, 6, True), (7, 3, False), (7, 7, True), (9, 7, False)]
    left = near_dedup.deduplicated(spark, df)
    assert left.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=str) == sorted([(7, a), (3, b), (2, c), (None, ""), (5, ""), (6, None), (None, "lone words")], key=str)
    assert near_dedup.deduplicated(spark, df.limit(0)).count() == 0


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(1)
    pool = np.unique(rng.integers(0, 2**63, 1200).astype(np.uint64))
    a, b = pool[:1000], pool[100:1100]
    same = np.mean([near_dedup.sketch(np.sort(near_dedup.mix(a ^ np.uint64(k)))) == near_dedup.sketch(np.sort(near_dedup.mix(b ^ np.uint64(k)))) for k in range(40)])
    assert abs(same - 900 / 1100) < 0.03


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7), (None, 3)]
    got = {r.id: r.component for r in components(spark, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 90: 90, 95: 90, 100: 90}


def _auc(y, s):
    y, r = np.asarray(y), np.argsort(np.argsort(s)) + 1
    n = y.sum()
    return (r[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


def labelled(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(400):
        good, bad = rng.random() < 0.7, rng.random() < 0.3
        text = prose(rng, rng.randint(30, 120))
        if not good:
            text = " ".join(w.upper() + "!!" for w in text.split())
        if bad:
            w = text.split()
            for _ in range(2):
                w.insert(rng.randrange(len(w)), rng.choice(["grumblefist", "snorkwad", "blatherskite"]))
            text = " ".join(w)
        rows.append((i, text, "en", "s", len(text), "p", 1, "h", "r"))
        labels.append((i, int(good), int(bad)))
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), labels


def test_quality(spark, none):
    d, lab, truth = labelled(spark)
    got = {r.doc_id: r for r in quality.quality(spark, d, lab).collect()}
    held = [t for t in truth if zlib.crc32(str(t[0]).encode()) % 3 == 1]
    assert len(got) == 400 and all(got[t[0]].held_out for t in held)
    assert _auc([t[1] for t in held], [got[t[0]].score for t in held]) > 0.95
    assert quality.quality(spark, none, lab).count() == 0
    odd = spark.createDataFrame([(1, None), (2, ""), (3, " \n"), (4, "w " * 30000), (None, "x")], "doc_id long, text string")
    out = {r.doc_id: r for r in quality.quality(spark, odd, lab.limit(0)).collect()}
    assert set(out) == {1, 2, 3, 4} and out[1].score == 0.5 and out[1].predicted == 1


def test_quality_by_words_alone(spark):
    """Good and bad texts of the same letters, lengths and repetition: only the words tell."""
    rng = random.Random(6)
    good = ["".join(rng.sample("abcdefgh", 6)) for _ in range(60)]
    bad = [w[::-1] for w in good]
    rows, labels = [], []
    for i in range(900):
        y = rng.random() < 0.5
        rows.append((i, " ".join(rng.choice(good if y else bad) if rng.random() < 0.4 else "".join(rng.sample("abcdefgh", 6)) for _ in range(rng.randint(40, 150)))))
        labels.append((i, int(y)))
    got = {r.doc_id: r for r in quality.quality(spark, spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    held = [(i, y) for i, y in labels if got[i].held_out]
    assert _auc([y for _, y in held], [got[i].score for i, _ in held]) > 0.95
    twice = spark.createDataFrame([rows[0], rows[0], (1, "x")], "doc_id long, text string")
    assert quality.quality(spark, twice, spark.createDataFrame(labels, "doc_id long, quality int")).count() == 3


def test_toxicity(spark, none):
    d, lab, truth = labelled(spark)
    got = {r.doc_id: r for r in toxicity.toxicity(spark, d, lab).collect()}
    held = [t for t in truth if zlib.crc32(str(t[0]).encode()) % 4 == 2]
    assert np.mean([got[t[0]].predicted == t[2] for t in held]) > 0.95
    assert toxicity.toxicity(spark, none, lab).count() == 0
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "you grumblefost, snorkwod and grumblefis"), (None, "x")], "doc_id long, text string")
    more = d.select("doc_id", "text").unionByName(odd.select((F.col("doc_id") - 10).alias("doc_id"), "text"))
    out = {r.doc_id + 10: r for r in toxicity.toxicity(spark, more, lab).where("doc_id < 0").collect()}
    assert out[1].predicted == out[2].predicted == 0 and out[3].predicted == 1 and out[3].n_hits == 3 and len(out) == 3
    assert toxicity.toxicity(spark, odd, lab.limit(0)).where("score <> 0").count() == 0


def test_automaton_is_exact():
    rng = random.Random(2)
    terms = ["clown", "moron", "loser"]
    auto = toxicity.Automaton([(t, False, 1) for t in terms] + [("zqx", True, 0), ("größe", True, 1), ("scum", False, 1)])

    def near(a, b):
        if abs(len(a) - len(b)) > 1:
            return 2
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            d, o = [i], d
            for j, y in enumerate(b, 1):
                d.append(min(o[j] + 1, d[-1] + 1, o[j - 1] + (x != y)))
        return d[-1]

    ws = ["".join(rng.choice("clownmrse") for _ in range(rng.randint(3, 7))) for _ in range(3000)] + terms + ["clowm", "cown", "cclown", "zqxabc", "zqx", "azqx", "größere", "grösseren", "größren", "gröser", "grüßer", "roße", "skum", "scum", "sc", "scam", "zqy"] + ["".join(rng.choice("größescum") for _ in range(rng.randint(2, 8))) for _ in range(3000)]
    data = " ".join(ws).encode()
    b, s, e, *_ = toxicity.words(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    hit, _, edits = auto.run(b, s, e)

    def least(w):
        whole = min(near(w, t) for t in [*terms, "scum"])
        prefix = min(near(w[:k], "größe") for k in range(len(w)))
        return 0 if w.startswith("zqx") and w != "zqx" else min(whole, prefix)

    assert dict(zip(hit.tolist(), edits.tolist())) == {i: least(w) for i, w in enumerate(ws) if least(w) <= 1}


def test_quotation_weighs_less(spark):
    auto = toxicity.Automaton([("snorkwad", False, 1)])
    import pyarrow as pa

    x = toxicity.hits(auto, pa.array(["you snorkwad", 'he wrote "snorkwad" there', None]))
    assert x[0, 0] > 0 and x[0, 1] == 0 and x[1, 1] > 0 and x[1, 0] == 0 and not x[2].any()


PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def base(text):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m[0])
            if k == 1 and any(int(x) > 255 for x in m[0].split(".")) or k == 2 and not (12 <= len(digits) <= 19 and pii.luhn(digits)) or k == 3 and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def test_pii(spark, docs, none):
    rng = random.Random(5)
    for _ in range(3000):
        t = "".join(rng.choice("a.@-+1 2()34.5%é\n") for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(t) == base(t), t
    got = {r.doc_id: r for r in pii.personal_data(spark, docs).collect()}
    for r in corpus():
        want = base(r[1] or "")
        assert got[r[0]].base_sha256 == hashlib.sha256(pii.joined(want).encode()).hexdigest()
        assert set(filter(None, pii.joined(want).split(","))) <= set(got[r[0]].spans.split(","))
    assert pii.personal_data(spark, none).count() == 0
    hidden = {r.doc_id: r.text for r in pii.personal_data(spark, docs, redact=True).collect()}
    assert hidden[len(corpus())].startswith("<EMAIL>, call <PHONE>; card <CARD>; ip <IP>;") and None in hidden.values()


def pii_weights():
    rng = random.Random(1)
    texts = [f"mail u{i}@b{i}.org ok. Phone +1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)} so. Card 4111111111111111 and {rng.randint(1, 5000)} cats in 2020, {rng.randint(10**10, 10**11)} ants, {10 * rng.randint(10**14, 10**15)} atoms at 10.0.0.{i}, 1.2.3" for i in range(150)]
    return pii.learn(*pii.patterns(pii.Graph(texts)))


def kinds_of(w, text):
    (b, s), = pii.all_spans([text], w)
    return [text[a:e] for a, k, e in s if (a, k, e) not in b]


def test_pii_repeats_are_added():
    w = pii_weights()
    text = "call +1 (555) 555-1234 or later (555) 555-1234 again, 17 cats"
    assert kinds_of(w, text) == ["(555) 555-1234"]
    for n in range(1, 7):  # every repeat, however many and however far
        filler = "so on " * 300
        text = "tel +15551234567 " + filler + " ".join(["15551234567 and"] * n) + " 15559999999 not"
        assert kinds_of(w, text) == ["15551234567"] * n, n
    assert kinds_of(w, "write a.b@c.org soon. a.b@c now, x.y@z never") == ["a.b@c"]
    without = {**w, "skip": np.zeros_like(w["skip"])}
    assert kinds_of(without, "tel +15551234567 " + "so on " * 9 + "15551234567 and 15551234567") == []


def test_pii_numbers_that_are_no_cards():
    w = pii_weights()
    assert not pii.luhn("4111111111111112") and kinds_of(w, "number 4111111111111112 twice 4111111111111112 so") == []


def test_pii_run_together():
    (b, s), = pii.all_spans(["see x@y.org +1 (578) 555-6437 4111111111111111 ok, 2020 cats"], pii_weights())
    assert len(b) == 1 and [k for _, k, _ in s] == [0, 3, 2]


def test_pii_repeated_and_null_ids(spark):
    df = spark.createDataFrame([(1, "a@b.co", "z"), (1, "a@b.co", "y"), (None, "10.0.0.1", "x"), (2, None, None)], "doc_id long, text string, spans string")
    got = sorted((str(r.doc_id), r.n_email, r.n_ip, r.spans) for r in pii.personal_data(spark, df).collect())
    assert got == [("1", 1, 0, "email:0:6"), ("1", 1, 0, "email:0:6"), ("2", 0, 0, ""), ("None", 0, 1, "ip:0:8")]
    assert sorted((str(r.text), str(r.spans)) for r in pii.personal_data(spark, df, redact=True).collect()) == [("<EMAIL>", "y"), ("<EMAIL>", "z"), ("<IP>", "x"), ("None", "None")]


def test_lm(spark, docs, none):
    got = {r.doc_id: r for r in lm_score.score(spark, docs).collect()}

    def toks(t):
        return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None]

    c = collections.Counter()
    for r in corpus():
        if zlib.crc32(str(r[0]).encode()) % 7 != 2:
            c.update(toks(r[1]))
    n, v = sum(c.values()), len(c)
    for r in corpus():
        t, g = toks(r[1]), got[r[0]]
        assert (g.n_tokens, g.n_known, g.train_tokens) == (len(t), sum(c[x] > 0 for x in t), n)
        assert g.base_score == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in t), rel=1e-9)
        assert g.score < 0
    assert lm_score.score(spark, none).count() == 0


def test_lm_score_against_exact_counts(spark, docs):
    """The model's score by its definition, from counts quantised as the filter quantises them (with bits enough for no false hit)."""
    rows = [(r[0], r[1]) for r in corpus()] + [(3, "alpha1 beta2 again"), (None, "x"), (None, None)]
    got = lm_score.score(spark, spark.createDataFrame(rows, "doc_id long, text string"), per_entry=64).collect()
    assert len(got) == len(rows) - 2

    def toks(t):
        return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None]

    c, pairs = collections.Counter(), collections.Counter()
    for i, t in rows:
        if i is not None and zlib.crc32(str(i).encode()) % 7 != 2:
            w = toks(t)
            c.update(w)
            pairs.update(zip([None, *w], w))
    quantised = lambda n: float(lm_score.counts_of(lm_score.levels_of(np.array([n])) * (n > 0))[0])
    total = sum(c.values()) + len(c) + 1
    want = collections.defaultdict(list)
    for i, t in rows:
        w = toks(t)
        p = [(min(quantised(pairs[a, b]), quantised(c[a])) + lm_score.MU * (quantised(c[b]) + 1) / total) / (quantised(c[a]) + lm_score.MU) for a, b in zip([None, *w], w)]
        want[i].append(sum(map(math.log10, p)))
    have = collections.defaultdict(list)
    for r in got:
        have[r.doc_id].append(r.score)
    assert all(sorted(have[i]) == pytest.approx(sorted(want[i]), rel=1e-9) for i in have)


def test_lm_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(5, "a b"), (5, None)], "doc_id long, text string")
    got = lm_score.score(spark, df, held_out=F.lit(True)).collect()
    assert [(r.n_known, r.train_tokens, r.base_score) for r in got] == [(0, 0, 0.0)] * 2 and sorted(r.n_tokens for r in got) == [1, 3]


def test_lm_rare_words_by_bucket(spark, docs, monkeypatch):
    want = {r.doc_id: (r.n_known, r.base_score) for r in lm_score.score(spark, docs).collect()}
    monkeypatch.setattr(lm_score, "HEAVY", 4)
    got = {r.doc_id: (r.n_known, r.base_score) for r in lm_score.score(spark, docs).collect()}
    assert all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1]) for k in want)


def test_filter_levels():
    keys = near_dedup.mix(np.arange(5000, dtype=np.uint64))
    levels = (np.arange(5000) % 7 + 1).astype(np.int32)
    seg = [lm_score.segment(keys[keys % np.uint64(5) == b], levels[keys % np.uint64(5) == b]) for b in range(4)] + [np.zeros(0, np.uint8)]
    keys, levels = keys[keys % np.uint64(5) != 4], levels[keys % np.uint64(5) != 4]
    size = np.array([len(x) for x in seg])
    f = lm_score.Filter(np.concatenate(seg), np.cumsum(size) - size, size)
    assert (f.level(keys) >= levels).all() and (f.level(keys) == levels).mean() > 0.97
    assert (f.level(near_dedup.mix(keys + np.uint64(1))) > 0).mean() < 0.03


VECS = "vec_id long, embedding array<float>, label int, list int, x string"


def vecs():
    rng = np.random.default_rng(0)
    rows, base = [], rng.normal(size=(40, 8))
    for i in range(300):
        v = (base[i % 40] + rng.normal(size=8) * (0.15 if i % 3 else 0.5)).astype(np.float32).tolist()
        rows.append((i, v, i % 2, 1, "x"))
    rows += [(300 + i, rows[0][1], 0, 1, "x") for i in range(5)]
    rows += [(400, None, 0, 1, "x"), (401, [0.0] * 8, 0, 1, "x"), (402, [float("nan")] * 8, 0, 1, "x"), (403, [None] * 8, 0, 1, "x"), (404, rows[0][1], None, 1, "x"), (405, [], 0, 1, "x"), (450, [1.0, 2.0], 1, 1, "x"), (451, [1.0, 2.1], 1, 1, "x"), (452, [float("inf")] * 8, 1, 1, "x")]
    return rows


def test_vector_dedup(spark):
    rows = vecs()
    got = {r.vec_id: r for r in vector_dedup.near_vectors(spark, spark.createDataFrame(rows, VECS), bar=0.93).collect()}
    assert len(got) == len(rows)
    ok = [(i, np.array(v, float), lab) for i, v, lab, *_ in rows if lab is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    links = collections.Counter()
    for i, a, x in ok:
        for j, b, y in ok:
            if i != j and x == y and len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.93:
                links[i] += 1
    total = sum(links.values())
    assert all(got[i].n_links <= links[i] for i in got) and sum(r.n_links for r in got.values()) >= 0.9 * total
    assert all(got[i].n_links == 0 and got[i].kept for i in (400, 401, 402, 403, 404, 405, 452)) and got[450].n_links == 1 and got[451].component_id == 450
    assert got[304].component_id <= 0 and vector_dedup.near_vectors(spark, spark.createDataFrame([], VECS)).count() == 0


def test_vector_dedup_recall_of_few_probes(spark):
    """12 of 100 lists are probed: at least 0.9 of the links of brute force, and none that is not one."""
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(300, 32))
    x = np.repeat(centre, 8, axis=0) + rng.normal(size=(2400, 32)) * rng.uniform(0.1, 0.35, (2400, 1))
    rows = [(i, v.tolist(), int(i % 8 > 5), 1, "x") for i, v in enumerate(x.astype(np.float32))]
    got = {r.vec_id: r for r in vector_dedup.near_vectors(spark, spark.createDataFrame(rows, VECS), lists=100).collect()}
    y = np.array([r[1] for r in rows])
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    link = (y @ y.T >= 0.93) & (label[:, None] == label)
    np.fill_diagonal(link, False)
    n = link.sum(1)
    assert n.sum() > 2000 and all(got[i].n_links <= n[i] for i in got)
    assert sum(r.n_links for r in got.values()) >= 0.9 * n.sum()


def test_topk(spark):
    rows = vecs()
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.top_k(spark, spark.createDataFrame(rows, VECS)).collect()}
    whole = {i: [math.floor(256 * float(np.float32(x))) for x in v] for i, v, *_ in rows if v and None not in v and np.isfinite(v).all()}
    want = {}
    for q in whole:
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q and len(v) == len(whole[q]))[:5]
            want |= {(q, k + 1): (i, -s) for k, (s, i) in enumerate(best)}
    assert got == want and topk.top_k(spark, spark.createDataFrame([], VECS)).count() == 0


def test_topk_blocks_ties_and_repeats(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(rng.randrange(400), [float(rng.randrange(3)) / 256 for _ in range(4)], 0, 0, "x") for _ in range(900)] + [(50, [0.0] * 4, 0, 0, "x")] * 3
    df = spark.createDataFrame(rows, VECS).repartition(7)
    want = []
    for q, v, *_ in rows:
        if q % 50 == 0:
            want.append((q, v, sorted((-sum(math.floor(256 * a) * math.floor(256 * b) for a, b in zip(v, w)), i) for i, w, *_ in rows if i != q)[:5]))
    one = {q: [x for _, _, x in g] for q, g in itertools.groupby(sorted(want, key=lambda x: x[0]), key=lambda x: x[0])}
    single = {q: x[0] for q, x in one.items() if len(x) == 1}
    for size in (16 << 20, 64):  # one block of queries, and many
        monkeypatch.setattr(topk, "QUERY_BYTES", size)
        got = collections.defaultdict(list)
        for r in topk.top_k(spark, df).orderBy("query_id", "rank").collect():
            got[r.query_id].append((-r.score, r.vec_id))
        assert set(got) == set(one) and all(got[q] == x for q, x in single.items())
        for q, x in one.items():  # rows that repeat a query's id share its list: the best of them all
            assert got[q] == sorted(itertools.chain(*x))[:5]


def test_url_filter(spark):
    urls = ["http://A.net/x", "https://m.example.net/en/1?q#f", "http://x.example.com/de/", "http://example.com/den", "http://z.org/fr/a", "http://net", "http://notnet/", None, "nothing", "http://a.b/c?d://e", "ftp://www.List.com/p.html#x", "", "http://"]
    pages = spark.createDataFrame([(i, u, "h", "v") for i, u in enumerate(urls)] + [(0, urls[0], "h", "v"), (None, urls[1], "h", "v")], "page_id long, url string, html string, verdict string")
    listed = spark.createDataFrame([("http://list.com/p", "block"), ("https://m.list.com/p/", "allow"), (None, "block"), ("no url", "block"), ("http://b.net/", "allow")], "url string, verdict string")
    want = {0: ("net/", "block"), 1: ("example.net/en/", "allow"), 2: ("example.com/de/", "block"), 4: ("org/fr/", "allow"), 10: (None, "block")}
    for more in (0, 9000):  # a list of more than one row of the packed filter
        long = listed.unionByName(spark.range(more).select(F.concat(F.lit("http://many.com/"), "id").alias("url"), F.lit("block").alias("verdict")))
        got = [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.url_filter(spark, pages, listed=long).collect()]
        assert len(got) == len(urls) + 2 and all(g[3:] == want.get(g[0], (None, "allow")) for g in got if g[0] is not None)
        assert [g[1:3] for g in got if g[0] == 9] == [("a.b", "/c")] and [g[1:3] for g in got if g[0] == 7] == [("", "")]
    assert url_filter.url_filter(spark, pages.limit(0), listed=listed).count() == 0
    assert url_filter.url_filter(spark, pages, listed=listed.limit(0)).count() == len(urls) + 2


def test_url_filter_has_no_false_hits(spark, monkeypatch):
    pages = spark.range(4000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://www.h.com/"), (F.col("id") % 3000).cast("string"), F.lit("/")).alias("url"))
    listed = spark.range(0, 3000, 3).select(F.concat(F.lit("https://h.com/"), "id", F.lit(".html")).alias("url"), F.lit("block").alias("verdict"))
    for limit in (32 << 20, 16):  # with the filter, and straight to the exact join
        monkeypatch.setattr(url_filter, "BROADCAST_BYTES", limit)
        got = {r.page_id: r.verdict for r in url_filter.url_filter(spark, pages, [], listed).collect()}
        assert got == {i: "block" if i % 3000 % 3 == 0 else "allow" for i in range(4000)}


def test_packing(spark, docs, none):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path("byte_bpe_50k.json"))
    odd = ["<|endoftext|> <| x", "a\u00a0b  \n\n c\t", "٣٤ 你好 🙂 don't I'll", "\r\n \x00"]
    rows = [(r[0], r[1]) for r in corpus()] + [(1000 + i, t) for i, t in enumerate(odd)] + [(None, "x"), (3, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = collections.Counter()
    for i, t in rows:
        ids = (tok.encode(t, add_special_tokens=False).ids if t else []) + [0]
        want[i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    pieces = packing.pack(spark, df, window=64, with_ids=True).toPandas().sort_values(["sequence_id", "offset"])
    assert (pieces.offset == pieces.groupby("sequence_id").length.cumsum() - pieces.length).all()
    assert (pieces.groupby("sequence_id").length.sum().iloc[:-1] == 64).all()
    stream, got = [x for ids in pieces.ids for x in ids], collections.Counter()
    at = 0
    while at < len(stream):
        row = pieces.iloc[int(np.searchsorted(np.cumsum(pieces.length.values), at, "right"))]
        n = int(row.doc_tokens)
        got[None if np.isnan(row.doc_id) else int(row.doc_id), n, zlib.crc32(np.array(stream[at : at + n], "<u4").tobytes())] += 1
        at += n
    assert got == want and packing.pack(spark, none).count() == 0


def test_budgets():
    leaves = {("a", "x", "1"): 100, ("a", "x", "2"): 10, ("a", "y", "3"): 1000, ("b", "x", "4"): 50}
    got = mixing.budgets(leaves, {"a": (0.5, {}), "b": (0.5, {})}, 400, 1)
    assert got[("b", "x", "4")] == 50 and got[("a", "x", "2")] == 10 and got[("a", "x", "1")] == 100 and got[("a", "y", "3")] == 240
    got = mixing.budgets(leaves, {}, 10**6, 2)
    assert got == {k: 2 * v for k, v in leaves.items()}


def test_mixing(spark, docs, none):
    got = mixing.mix(spark, docs, ratio=0.5, epochs=2).toPandas()
    words = {r[0]: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in corpus()}
    assert all(words[i] == t for i, t in zip(got.doc_id, got.mix_tokens)) and got.mix_copies.between(1, 2).all()
    leaves = collections.Counter()
    for r in corpus():
        dom = "web" if r[3] == "src0" else "books"
        leaves[dom, r[2] or "", r[3]] += words[r[0]]
    plan = mixing.budgets(dict(leaves), mixing.WEIGHTS, int(0.5 * sum(words.values())), 2)
    spent = collections.Counter()
    for r in got.itertuples():
        spent[r.mix_domain, r.mix_lang, r.mix_source] += r.mix_tokens * r.mix_copies
    assert all(spent[k] <= plan[k] for k in plan)
    again = mixing.mix(spark, docs.repartition(7), ratio=0.5, epochs=2).toPandas()
    assert sorted(zip(got.doc_id, got.mix_copies)) == sorted(zip(again.doc_id, again.mix_copies))
    assert mixing.mix(spark, none).count() == 0
    assert mixing.mixed(spark, docs, total=10**9, epochs=2).count() == 2 * len(corpus())
    assert sorted(r.doc_id for r in mixing.mixed(spark, docs, ratio=0.5, epochs=2).collect()) == sorted(i for i, n in zip(got.doc_id, got.mix_copies) for _ in range(n))


def test_budget_below_a_weight_of_nothing():
    leaves = {("a", "x", "1"): 900, ("a", "y", "2"): 10, ("b", "x", "3"): 5000}
    got = mixing.budgets(leaves, {"a": (0.5, {"x": (0.0, {})}), "b": (0.5, {})}, 1000, 1)
    assert got == {("a", "x", "1"): 0, ("a", "y", "2"): 10, ("b", "x", "3"): 990}


def test_mixing_takes_the_longest_prefix(spark):
    rng = random.Random(9)
    rows = [(rng.choice([None, k // 2]), " ".join("w" * rng.randint(1, 3) for _ in range(rng.randint(0, 30))), rng.choice(["en", "de", None]), rng.choice(["src0", "src1", None]), "x") for k in range(300)]
    rows += rows[:40] + [rows[7]] * 30
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, mix_tokens string")
    for ratio, epochs in ((0.5, 2), (0.9, 1), (1.3, 3)):
        light, _ = mixing.plan(spark, df, ratio=ratio, epochs=epochs)
        light = light.collect()
        chosen = mixing.mix(spark, df, ratio=ratio, epochs=epochs).collect()
        got = collections.Counter()
        for r in chosen:
            got[r.doc_id, r.mix_domain, r.mix_lang, r.mix_source, r.mix_tokens] += r.mix_copies
        sums = collections.Counter()
        for r in light:
            sums[r.mix_domain, r.mix_lang, r.mix_source] += r.mix_tokens
        shares = mixing.budgets(dict(sums), mixing.WEIGHTS, int(ratio * sum(sums.values())), epochs)
        want = collections.Counter()
        for leaf, budget in shares.items():
            full, rest = divmod(budget, sums[leaf]) if sums[leaf] else (0, 0)
            places = collections.defaultdict(list)
            for r in light:
                if (r.mix_domain, r.mix_lang, r.mix_source) == leaf:
                    places[r.mix_place].append(r)
                    want[r.doc_id, *leaf, r.mix_tokens] += full
            spent = 0
            for at in sorted(places):
                spent += sum(r.mix_tokens for r in places[at])
                if spent > rest or rest == 0:
                    break
                for r in places[at]:
                    want[r.doc_id, *leaf, r.mix_tokens] += 1
        assert got == +want and sum(k[-1] * n for k, n in got.items()) <= sum(shares.values())
        assert mixing.mixed(spark, df, ratio=ratio, epochs=epochs).count() == sum(got.values())
        assert mixing.mixed(spark, df, ratio=ratio, epochs=epochs).columns == df.columns


def test_pipeline(spark, tmp_path):
    d, lab, truth = labelled(spark)
    rows = d.collect() + [(1000 + r.doc_id, r.text, *list(r)[2:]) for r in d.limit(20).collect()]
    plain = spark.createDataFrame(rows, DOCS).select("doc_id", "text", "lang", "source", "n_chars")
    plain.write.parquet(str(tmp_path / "documents.parquet"))
    lab.write.parquet(str(tmp_path / "labels.parquet"))
    current = plain
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, current, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        ids = {r.doc_id for r in out.select("doc_id").collect()}
        if name == "toxicity":
            assert np.mean([(t[0] in ids) != t[2] for t in truth]) > 0.97
        if name == "near_dedup":
            assert not any(1000 + i in ids for i in ids) and all(i < 1000 or i - 1000 not in ids for i in ids)
        if name != "packing":
            assert out.columns == plain.columns
        current = out
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_packing_ids_of_four_bytes(spark, tmp_path):
    """A vocabulary above 65,535 ids, and columns that clash with those of the pieces."""
    import json

    vocab = {chr(i): i + 70_000 for i in range(97, 123)} | {"\u0120": 5}
    (tmp_path / "t.json").write_text(json.dumps({"version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": False, "use_regex": True}, "post_processor": None, "decoder": None, "model": {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False, "vocab": vocab, "merges": []}}))
    import base64

    (tmp_path / "t.tiktoken").write_text("\n".join(f"{base64.b64encode(bytes([i])).decode()} {i + 70_000 if 97 <= i < 123 else 5 if i == 32 else 90_000 + i}" for i in range(256)))
    df = spark.createDataFrame([(1, "ab c", 7, 8), (2, " ", 7, 8), (3, None, 7, 8)], "doc_id long, text string, start long, ids long")
    got = {r.doc_id: r for r in packing.pack(spark, df, with_ids=True, json_path=str(tmp_path / "t.json"), ranks_path=str(tmp_path / "t.tiktoken")).collect()}
    assert [got[i].ids for i in (1, 2, 3)] == [[70_097, 70_098, 5, 70_099, 0], [5, 0], [0]]
    assert got[1].ids_crc32 == zlib.crc32(np.array(got[1].ids, "<u4").tobytes())


def test_pipeline_of_odd_rows(spark, tmp_path):
    d, lab, _ = labelled(spark)
    plain = d.select("doc_id", "text", "lang", "source", "n_chars")
    odd = [(None, None, None, None, None), (None, "", "en", "s", 0), (900, None, "en", None, None), (901, "", None, "s", 0), (902, " \n", "en", "s", 2), (903, "mail a@b.co " + "long word " * 20_000, "en", "s", 9), (904, "rare words here", "en", "s", 15), (904, "rare words here", "en", "s", 15), (None, "rare words here", "en", "s", 15)]
    docs = plain.unionByName(spark.createDataFrame(odd, plain.schema))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    lab.write.parquet(str(tmp_path / "labels.parquet"))
    current = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, current, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        current = spark.read.parquet(str(tmp_path / name))
        left = [(r.doc_id, r.text) for r in current.where("doc_id IS NULL OR doc_id >= 900").collect()]
        ids = sorted(str(i) for i, _ in left)
        if name == "toxicity":
            assert ids == sorted(["900", "901", "902", "903", "904", "904", "None", "None", "None"])
        else:  # one of the three rows with the same words
            assert ids == sorted(["900", "901", "902", "903", "904", "None", "None"])
    assert dict(left)[900] is None and dict(left)[903].startswith("mail <EMAIL> long")
    for folder, rows in (("few", plain.limit(1)), ("empty", plain.limit(0))):
        (tmp_path / folder).mkdir()
        rows.write.parquet(str(tmp_path / folder / "documents.parquet"))
        lab.limit(0).write.parquet(str(tmp_path / folder / "labels.parquet"))
        assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path / folder)).collect()} <= {r.doc_id for r in rows.collect()}
