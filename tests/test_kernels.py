"""Vector kernels and counts by replacing against plain Python over odd inputs; no step of an expression per letter is left."""

import math
import random

import pytest
from pyspark.sql import functions as F

from helixframe.dims import codes, load
from helixframe.functions import protein as pr
from helixframe.functions import sequence as sq
from helixframe.functions import translation as tr
from helixframe.operators import relational as rel

P = load("protein")
AAS = pr.AMINO_ACIDS
rng = random.Random(3)
PROTEINS = [None, "", "M", "ma", "MAEGEITTF", "MAEGEITTFT", "maegeittfta", *("".join(rng.choice(AAS) for _ in range(n)) for n in (9, 10, 11, 57, 400))]


def table(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), "id int, s string").coalesce(1)


def values(spark, rows, *cols):
    return [tuple(r)[1:] for r in table(spark, rows).select("id", *cols).orderBy("id").collect()]


def plan(spark, rows, col) -> str:
    return table(spark, rows).select(col)._jdf.queryExecution().optimizedPlan().toString()


def test_windows_and_pairs(spark):
    flex, kd = dict(zip(AAS, P["FLEX"])), pr.scale_values("KyteDoolitle")
    got = values(spark, PROTEINS, pr.flexibility("s"), pr.protein_scale("s", "kd", 9, 0.4), pr.protein_scale("s", "kd", 4, 1.0), pr.instability("s"))
    for s, (f, k9, k4, inst) in zip(PROTEINS, got):
        u = (s or "").upper()
        want = []
        for i in range(len(u) - 9):
            v, score = [flex[a] for a in u[i : i + 9]], 0.0
            for j, w in enumerate([0.25, 0.4375, 0.625, 0.8125]):
                score += (v[j] + v[8 - j]) * w
            want.append((score + v[5]) / 5.25)
        assert f == want
        for window, edge, out in ((9, 0.4, k9), (4, 1.0, k4)):
            unit = 2 * (1.0 - edge) / (window - 1)
            ws = [edge + unit * i for i in range(window // 2)]
            want = []
            for i in range(len(u) - window + 1):
                v, score = [kd[a] for a in u[i : i + window]], 0.0
                for j, w in enumerate(ws):
                    score += v[j] * w + v[window - 1 - j] * w
                want.append((score + (v[window // 2] if window % 2 else 0.0)) / (sum(ws) * 2 + 1))
            assert out == want
        total = 0.0
        for a, b in zip(u, u[1:]):
            total += P["DIWV"][AAS.index(a)][AAS.index(b)]
        assert inst == (10.0 / len(u) * total if u else None)
    for col in (pr.flexibility("s"), pr.protein_scale("s", "kd", 9), pr.instability("s")):
        assert "lambda" not in plan(spark, PROTEINS, col)


def test_residues_without_a_value(spark):
    s = "ACDEXFGHIKéLMN"
    (got,) = values(spark, [s], pr.protein_scale("s", "kd", 3, 0.5))
    kd = pr.scale_values("KyteDoolitle")
    want = []
    for i in range(len(s) - 2):
        a, b, c = (kd.get(x.upper()) for x in s[i : i + 3])
        want.append(((0.0 if a is None or c is None else a * 0.5 + c * 0.5) + (b or 0.0)) / 2.0)
    assert got[0] == want
    for bad, f, message in ((s, pr.flexibility, "unknown residue X"), ("AAAéA", pr.instability, "unknown dipeptide AÉ"), ("é", pr.gravy, "unknown residue É"), ("AX", pr.weight, "'X' is not a valid unambiguous letter for protein")):
        with pytest.raises(Exception, match=message):
            values(spark, ["ACD", bad], f("s"))
    assert values(spark, ["X", "AXé"], pr.flexibility("s"), F.length("s")) == [([], 1), ([], 3)]  # too short for a window
    assert values(spark, ["X"], pr.instability("s")) == [(0.0,)]


def test_counts(spark):
    rows = [*PROTEINS, "aéW W"]
    got = values(spark, rows, pr.residue_counts("s"), pr.residue_percent("s"), pr.secondary_structure("s"), sq.count_letters(F.col("s"), "Wé"), sq.count_letters(F.col("s"), "Aa"))
    for s, (n, pct, ss, we, aa) in zip(rows, got):
        u = s and s.upper()
        assert n == {a: u if u is None else u.count(a) for a in AAS} and we == (None if s is None else sum(c in "Wé" for c in s)) and aa == (None if s is None else sum(c in "Aa" for c in s))
        assert pct == ({a: u.count(a) * 100.0 / len(u) for a in AAS} if u else None)
        if u:
            assert ss.sheet == pytest.approx(sum(c in "VIYFWLT" for c in u) / len(u), abs=1e-12)
    for col in (pr.residue_counts("s"), pr.residue_percent("s"), pr.secondary_structure("s"), pr.gravy("s"), pr.weight("s"), sq.gc_fraction("s")):
        assert "translate(" not in plan(spark, PROTEINS, col)  # no search of every letter in a map, once per counted letter


DNA = [None, "", "A", "ac", "ACG", "atgaaatag", "AUGNNNRACtaX", *("".join(rng.choice("ACGTacgtNRY") for _ in range(n)) for n in (3, 4, 5, 299, 1000))]


def test_translation(spark):
    m, swap = codes.get(1).codon_map(), str.maketrans(sq._FROM, sq._TO)

    def read(x):
        x = x.upper().replace("U", "T")
        return "".join(m[x[i : i + 3]] for i in range(0, len(x) // 3 * 3, 3))

    got = values(spark, DNA, tr.translate("s"), tr.translate("s", to_stop=True), tr.translate("s", stop_symbol="<>"), tr.six_frames("s"))
    for s, (all_, stop, symbol, six) in zip(DNA, got):
        if s is None:
            assert (all_, stop, symbol) == (None, None, None) and [tuple(f) for f in six] == [(k, None) for k in (1, 2, 3, -1, -2, -3)]
            continue
        assert (all_, stop, symbol) == (read(s), read(s).split("*")[0], read(s).replace("*", "<>"))
        anti = s.translate(swap)[::-1]
        assert [tuple(f) for f in six] == [(k + 1, read(s[k:])) for k in range(3)] + [(-k - 1, read(anti[k:])) for k in range(3)]
    assert values(spark, ["ATGTAG!!!", "ATGé"], tr.translate("s", to_stop=True)) == [("M",), ("M",)]
    for bad, f in (("ATGA!G", tr.translate), ("ATGAéG", tr.translate), ("AC!", tr.six_frames)):
        with pytest.raises(Exception, match="is invalid"):
            values(spark, [bad], f("s"))
    assert "lambda" not in plan(spark, DNA, tr.six_frames("s"))


def test_codon_adaptation_kernel(spark):
    genes = table(spark, [None, "", "AT", "atgTGG", "AAAAAGaaaTAG", *("".join(rng.choice("ACGT") for _ in range(n)) for n in (300, 1001))])
    index = rel.codon_adaptation_index(spark, genes, "s")
    w = {r.codon: r.w for r in index.collect()}
    seqs = {r.id: (r.s or "").upper() for r in genes.collect()}
    parts = {k: [s[i : i + 3] for i in range(0, len(s) // 3 * 3, 3)] for k, s in seqs.items()}
    counts = {r.codon: r.n for r in index.collect()}
    every = [c for p in parts.values() for c in p]
    assert all(counts[c] == (every.count(c) or 0.5) for c in counts)
    df = rel.codon_adaptation(genes, index, "id", "s")
    for r in df.collect():
        used = [c for c in parts[r.id] if c not in ("ATG", "TGG")]
        total = 0.0
        for c in used:
            total += math.log(w[c])
        assert r.n_codons == (len(used) or None) and r.cai == (pytest.approx(math.exp(total / len(used)), rel=1e-15) if used else None)
    assert df.where("cai IS NOT NULL")._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1  # genes are read once
    for bad in ("ANA", "AéA"):
        with pytest.raises(Exception, match="illegal codon"):
            rel.codon_adaptation_index(spark, table(spark, ["AAA", bad]), "s").collect()
        with pytest.raises(Exception, match="illegal codon in sequence: A"):
            rel.codon_adaptation(table(spark, [bad]), index, "id", "s").collect()


def test_batches_are_bounded(spark):
    sizes = spark.range(5_000).select(F.repeat(F.lit("ACGT"), 5_000).alias("s")).coalesce(1)
    pr.flexibility("s")

    def run(parts):
        import pyarrow as pa

        for p in parts:
            yield pa.RecordBatch.from_arrays([pa.array([p.num_rows], pa.int64()), pa.array([p.nbytes], pa.int64())], ["rows", "size"])

    for r in sizes.mapInArrow(run, "rows long, size long").collect():
        assert r.rows <= 2_000 and r.size < 4 << 20


def test_digests_get_bounded_batches(spark):
    from helixframe.operators import restriction as rs

    def run(s):
        import pyarrow as pa

        return pa.array([len(s)] * len(s), pa.int64())

    for key, most in (("maxRecordsPerBatch", "10000"), ("maxBytesPerBatch", str(64 << 20))):
        spark.conf.set(f"spark.sql.execution.arrow.{key}", most)
    df = spark.range(4_000).select(F.concat(F.repeat(F.lit("ACGT"), 2_500), F.lit("GAATTC")).alias("s")).coalesce(1)
    found = rs.search(df, ["EcoRI"], "s")
    largest = df.select(F.arrow_udf(run, "bigint")("s").alias("n")).agg(F.max("n")).first()[0]
    assert largest < 1_000  # 10 KB each: about a megabyte, not 10,000 rows
    assert found.agg(F.sum("n_cuts")).first()[0] == 4_000
