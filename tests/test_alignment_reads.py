"""The alignment queries over all reads of documents of several reads, against pair-by-pair tables."""

import random

import pytest

from helixframe.operators.alignment import Aligner
from helixframe.plans import catalog
from helixframe.plans.derive import reads

GLOBAL, LOCAL = ("global", 1, 0, -2, -1), ("local", 2, -1, -2, -1)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("abgt") for _ in range(n))
    rows = [(k, text(150 * k + 20)) for k in range(5)] + [(9, text(300) + "gattabagattaba" + text(136)), (10, None)]
    d = tmp_path_factory.mktemp("reads")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(d / "documents.parquet"))
    return str(d)


@pytest.mark.parametrize("options", [GLOBAL, LOCAL, ("global", 2, -3, -1, -1), ("global", 3, -1, -5, -2), ("global", 1, 0, -2, -1, 0, 0)])
def test_together_as_alone(options):
    rng, al = random.Random(1), Aligner(*options)
    for n, m in ((1, 1), (1, 9), (8, 3), (20, 21)):
        a, b = (["".join(rng.choice("ACGN-"[: 4 + (z == 1)]) for _ in range(z)) for _ in range(60)] for z in (n, m))
        a, b = [x.replace("-", "T") for x in a], [x.replace("-", "T") for x in b]
        assert al._batch(a, b, False)[0].tolist() == [al.score(x, y) for x, y in zip(a, b)]
        if al.mode == "global" and not al.free:
            want = [al.align(x, y) for x, y in zip(a, b)]
            assert al._paths(a, b) == [tuple(w[k] for k in ("score", "gapped_first", "gapped_second", "identities", "mismatches", "gaps")) for w in want]


def test_matrix_together_as_alone():
    rng, al = random.Random(2), Aligner("global", open_gap=-10, extend_gap=-1, substitution_matrix="BLOSUM62")
    a, b = (["".join(rng.choice("ARNDCQEGHILKMFPSTWYV") for _ in range(15)) for _ in range(40)] for _ in range(2))
    assert [r[0] for r in al._paths(a, b)] == [al.score(x, y) for x, y in zip(a, b)]


def test_columns_with_nulls(spark):
    rows = [("ACGT", "ACG")] * 9 + [(None, "A"), ("", "A"), ("A", None), ("ACGTT", "TT")]
    al = Aligner(*GLOBAL)
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", al.score_column("a", "b").alias("s"), al.align_column("a", "b").alias("r")).collect()
    for r in got:
        want = al.align(r.a, r.b) if r.a and r.b else None
        assert r.s == (want and want["score"])
        assert (r.r and r.r.asDict()) == (want and {k: v for k, v in want.items() if k not in ("start", "end")})


def test_every_read_is_scored(spark, folder):
    every = {r["name"]: r.sequence for r in reads(spark, folder).collect()}
    assert len(every) == 18 and {len(s) for s in every.values()} > {150}  # last reads are shorter
    got = {(r["name"], r.primer): r.score for r in catalog.QUERIES["l3_alignment_scores"](spark, folder).collect()}
    al = Aligner(*LOCAL)
    want = {(n, k): al.score(s, p) for n, s in every.items() for k, p in enumerate(catalog._PRIMERS)}
    assert got == want
    top = [(r["name"], r.primer, r.score) for r in catalog.QUERIES["a12_primer_ranking"](spark, folder).collect()]
    assert top == sorted(((*k, v) for k, v in want.items()), key=lambda r: (-r[2], r[0], r[1]))[:50]
    assert top[0] == ("9.2", 1, 28)


def test_all_letters_of_every_read_are_aligned(spark, folder):
    al, want = Aligner(*GLOBAL), {}
    for r in reads(spark, folder).collect():
        half = len(r.sequence) // 2
        if not half:
            continue
        x = al.align(r.sequence[:half], r.sequence[half:])
        want[r["name"]] = (x["score"], x["identities"], x["mismatches"], x["gaps"])
    got = {r["name"]: tuple(r)[1:] for r in catalog.QUERIES["l4_alignments"](spark, folder).collect()}
    assert got == want


@pytest.mark.parametrize("options", [GLOBAL, LOCAL, ("local", 2, 1, -2, -1), ("global", 5, -4, -9, -3), ("local", 5, -4, -1, -3), ("global", 60, -4, -9, -3), ("global", 1, 0, -2, -1, 0, 0)])
def test_pairs_of_all_lengths_go_together(options, monkeypatch):
    """Shorter pairs are filled up and share the tables of longer ones: the results of pair by pair, with few pairs left alone."""
    rng, al = random.Random(7), Aligner(*options)
    word = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    pairs = [(word(rng.randint(1, 40)), word(rng.randint(1, 14))) for _ in range(600)] + [(word(40), word(14)) for _ in range(300)] + [(None, "A"), ("", "A"), ("A", "")] * 3
    rng.shuffle(pairs)
    a, b = map(list, zip(*pairs))
    keys = ("score", "gapped_first", "gapped_second", "identities", "mismatches", "gaps")
    alone: list = []

    def one(p, q):
        alone.append(p)
        return al.score(p, q)

    want = [al.score(p, q) if p and q else None for p, q in pairs]
    assert al._each(a, b, one, lambda p, q: al._batch(p, q, False)[0].tolist()) == want
    mixed = al.mode == "global" and not al.free or al.mode == "local" and al.mismatch <= 0
    assert not mixed or len(alone) < 60
    parts = list(al._parts(a, b, False))
    assert sorted(r for p in parts for r in p) == [r for r, w in enumerate(want) if w is not None]
    if al.mode == "global" and not al.free:
        want = [tuple(al.align(p, q)[k] for k in keys) if p and q else None for p, q in pairs]
        assert al._each(a, b, lambda p, q: tuple(al.align(p, q)[k] for k in keys), al._paths, True) == want


def test_letters_that_fill_up_are_kept_apart():
    al = Aligner(*LOCAL)
    pairs = [("AC\0", "\0"), ("\0" * 9, "A\1")] * 20 + [("\1\1", "\1\0\1")] * 9
    a, b = map(list, zip(*pairs))
    assert al._each(a, b, al.score, lambda p, q: al._batch(p, q, False)[0].tolist()) == [al.score(p, q) for p, q in pairs]
    with pytest.raises(ValueError, match="above U"):
        al._each(["Ā"] * 9, ["A"] * 9, al.score, lambda p, q: al._batch(p, q, False)[0].tolist())
