import random

import pytest
from pyspark.sql import functions as F

from helixframe.operators import relational as rel
from helixframe.operators import restriction as rs
from helixframe.operators.alignment import Aligner


def table_score(a, b, al):
    low, n, m = -(10**9), len(a), len(b)
    d, x, y = ([[low] * (m + 1) for _ in range(n + 1)] for _ in range(3))
    d[0][0] = 0
    local = al.mode == "local"
    for i in range(n + 1):
        for j in range(m + 1):
            if i and j:
                d[i][j] = max(d[i - 1][j - 1], x[i - 1][j - 1], y[i - 1][j - 1]) + (al.match if a[i - 1] == b[j - 1] else al.mismatch)
            if local or (al.free and not (i and j)):
                d[i][j] = max(d[i][j], 0)
            if i:
                x[i][j] = max(d[i - 1][j] + al.open, x[i - 1][j] + al.extend, y[i - 1][j] + al.open)
            if j:
                y[i][j] = max(d[i][j - 1] + al.open, y[i][j - 1] + al.extend, x[i][j - 1] + al.open)
    best = [[max(d[i][j], x[i][j], y[i][j]) for j in range(m + 1)] for i in range(n + 1)]
    if local:
        return max(map(max, best))
    return max(*best[n], *(r[m] for r in best)) if al.free else best[n][m]


@pytest.mark.parametrize("options", [{}, dict(match=2, mismatch=-1, open_gap=-3), dict(mode="local", match=2, mismatch=-1, open_gap=-2), dict(match=2, mismatch=-3, open_gap=-5, extend_gap=-2, end_gap=0, extend_end_gap=0), dict(match=2, mismatch=-2, extend_gap=-3)])
def test_alignment(options):
    al, rng = Aligner(**options), random.Random(4)
    for _ in range(40):
        a, b = ("".join(rng.choice("ACGT") for _ in range(rng.randint(1, 12))) for _ in range(2))
        got = al.align(a, b)
        assert al.score(a, b) == got["score"] == table_score(a, b, al)
        assert len(got["gapped_first"]) == len(got["gapped_second"])
        if al.mode == "global":
            assert got["gapped_first"].replace("-", "") == a and got["gapped_second"].replace("-", "") == b


def test_alignment_refuses():
    for bad in (dict(match=1.5), dict(open_gap=1), dict(open_gap=-2, end_gap=-1), dict(mode="fogsaa")):
        with pytest.raises(NotImplementedError):
            Aligner(**bad)
    with pytest.raises(ValueError, match="zero length"):
        Aligner().score("", "A")


def test_restriction(spark):
    assert rs.cut_positions("EcoRI", "TTTGAATTCAAA") == [5] and rs.fragments("EcoRI", "TTTGAATTCAAA") == ["TTTG", "AATTCAAA"]
    assert rs.elucidate("EcoRI") == "G^AATT_C" and len(rs.names()) == 1088
    df = spark.createDataFrame([(1, "tttgaattcaaa"), (2, ""), (3, None)], "id long, sequence string")
    got = {(r.id, r.enzyme): r.cuts for r in rs.search(df, ["EcoRI", "AluI"]).collect()}
    assert got[1, "EcoRI"] == [5] and got[1, "AluI"] == [] and got[2, "EcoRI"] == []
    native = df.where("id < 3").select("id", rs.palindrome_cuts(F.upper("sequence"), "EcoRI").alias("c")).collect()
    assert {r.id: r.c for r in native} == {1: [5], 2: []}
    with pytest.raises(TypeError):
        rs.normalise("ACG!")
    assert rs.Batch(["EcoRI", "AluI"]).split(is_blunt=True).elements() == ["AluI"] and "EcoRI" not in rs.compatible_ends("EcoRI")


def test_circular_digest():
    whole = "AATTCTTTTTTTTG"  # the site spans the origin
    cuts = rs.cut_positions("EcoRI", whole, linear=False)
    assert cuts == [1] and rs.fragments("EcoRI", whole, linear=False) == [whole]


def test_codon_adaptation(spark):
    genes = spark.createDataFrame([(1, "AAAAAGAAA"), (2, "ATGTGG"), (3, "")], "id long, sequence string")
    index = rel.codon_adaptation_index(spark, genes)
    w = {r.codon: r.w for r in index.collect()}
    assert w["AAA"] == 1.0 and w["AAG"] == 0.5 and len(w) == 64
    cai = {r.id: r.cai for r in rel.codon_adaptation(genes, index).collect()}
    assert cai[1] == pytest.approx(0.5 ** (1 / 3)) and cai[2] is None and cai[3] is None


def test_kmers(spark):
    df = spark.createDataFrame([("AAAN",), ("aaC",)], "sequence string")
    assert {r.kmer: r.n for r in rel.count_kmers(df, 2).collect()} == {"AA": 3, "AC": 1}
    with pytest.raises(ValueError):
        rel.count_kmers(df, 17)


def test_codon_adaptation_of_repeated_keys(spark):
    genes = spark.createDataFrame([("g", "GCTGCTGCC"), ("g", "GCC"), ("h", "ATGTGG"), ("h", None)], "id string, sequence string")
    index = rel.codon_adaptation_index(spark, genes.where("sequence IS NOT NULL"))
    got = sorted((r.id, r.n_codons, r.cai and round(r.cai, 9)) for r in rel.codon_adaptation(genes, index).where("n_codons IS NOT NULL").collect())
    assert got == [("g", 1, 1.0), ("g", 3, 1.0)] and rel.codon_adaptation(genes, index).count() == 4
