"""Registered queries and their SQL: one entry per operator, over sequences derived from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import dims, streaming
from ..dims import codes
from ..functions import protein as pr
from ..functions import sequence as sq
from ..functions import translation as tr
from ..operators import relational as rel
from ..operators import restriction as rs
from ..operators.alignment import Aligner
from ..sources import readers, sinks
from .derive import D, P, R, dna, protein, reads, scratch

QUERIES: dict = {}
ORACLES: dict = {}


def _add(name: str, query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLES[name] = sql


def _dna(name: str, sql: str, **cols) -> None:
    _add(name, lambda s, d: dna(s, d).select("doc_id", *[c().alias(k) for k, c in cols.items()]), f"WITH {D} SELECT doc_id, {sql} FROM d")


def _protein(name: str, sql: str | None, **cols) -> None:
    _add(name, lambda s, d: protein(s, d).select("doc_id", *[c().alias(k) for k, c in cols.items()]), sql and f"WITH {P} SELECT doc_id, {sql} FROM p")


def _n(letters: str, seq: str = "seq") -> str:
    return f"(length({seq}) - length(translate({seq}, '{letters}', '')))"


def _share(top: str, bottom: str) -> str:
    return f"CASE WHEN {bottom} = 0 THEN 0.0 ELSE CAST({top} AS DOUBLE) / CAST({bottom} AS DOUBLE) END"


def _pick(values: dict) -> str:
    """The value of residue a, by its place in the alphabet."""
    return f"list_extract([{', '.join(f'CAST({values[x]} AS DOUBLE)' for x in pr.AMINO_ACIDS)}], strpos('{pr.AMINO_ACIDS}', a))"


# ------------------------------------------------------------------ scalar functions

_FROM, _TO = "ABCDGHKMRTUVYabcdghkmrtuvy", "TVGHCDMKYAABRtvghcdmkyaabr"
_dna("f1_reverse_complement", f"reverse(translate(seq, '{_FROM}', '{_TO}')) AS rc", rc=lambda: sq.reverse_complement("seq"))
_dna("f23_complement", f"translate(seq, '{_FROM}', '{_TO}') AS comp", comp=lambda: sq.complement("seq"))
_dna("f2_gc_fraction", _share(_n("GC"), "length(seq)") + " AS gc", gc=lambda: sq.gc_fraction("seq"))
_add("f3_gc_ignore", lambda s, d: reads(s, d).select("name", sq.gc_fraction("sequence", "ignore").alias("gc")), f"WITH {R} SELECT name, {_share(_n('GC', 'sequence'), 'length(sequence)')} AS gc FROM r")
_add("f4_gc_weighted", lambda s, d: reads(s, d).select("name", sq.gc_fraction("sequence", "weighted").alias("gc")), f"WITH {R} SELECT name, (CAST({_n('GC', 'sequence')} AS DOUBLE) + {_n('N', 'sequence')} * CAST(0.5 AS DOUBLE)) / length(sequence) AS gc FROM r")
_at3 = [f"list_aggregate(list_transform(range({p}, length(seq) + 1, 3), lambda i: CASE WHEN substr(seq, i, 1) IN ('G', 'C') THEN 1 ELSE 0 END), 'sum')" for p in (1, 2, 3)]
_len3 = [f"len(range({p}, length(seq) + 1, 3))" for p in (1, 2, 3)]
_add(
    "f10_gc123",
    lambda s, d: dna(s, d).withColumn("g", sq.gc123("seq")).select("doc_id", "g.gc", "g.gc1", "g.gc2", "g.gc3"),
    f"WITH {D} SELECT doc_id, CAST({_n('GC')} AS DOUBLE) * 100.0 / NULLIF(length(seq), 0) AS gc, " + ", ".join(f"CASE WHEN {n} = 0 THEN 0.0 ELSE CAST({a} AS DOUBLE) * 100.0 / {n} END AS gc{i + 1}" for i, (a, n) in enumerate(zip(_at3, _len3))) + " FROM d",
)
_w = "substr(seq, CAST(i * 100 + 1 AS BIGINT), 100)"
_add(
    "f11_gc_skew",
    lambda s, d: dna(s, d).select("doc_id", F.posexplode(sq.gc_skew("seq", 100)).alias("win", "skew")),
    f"WITH {D}, w AS (SELECT doc_id, CAST(i AS INTEGER) AS win, {_w} AS x FROM d, unnest(range(0, (length(seq) + 99) // 100)) AS t(i)) SELECT doc_id, win, CASE WHEN {_n('GC', 'x')} = 0 THEN 0.0 ELSE CAST({_n('G', 'x')} - {_n('C', 'x')} AS DOUBLE) / {_n('GC', 'x')} END AS skew FROM w",
)
_mw = dims.load("residues")["DNA_WEIGHTS"]
_dna("f12_molecular_weight", "round(" + " + ".join(f"{_n(a)} * CAST({v} AS DOUBLE)" for a, v in _mw.items()) + " - (length(seq) - 1) * CAST(18.0153 AS DOUBLE), 4) AS mass", mass=lambda: F.round(sq.molecular_weight("seq"), 4))
_three = dims.load("residues")["PROTEIN_1TO3"]
_protein("f13_seq3", f"array_to_string(list_transform(regexp_extract_all(seq, '.'), lambda a: list_extract({[_three[x] for x in pr.AMINO_ACIDS]}, strpos('{pr.AMINO_ACIDS}', a))), '') AS three", three=lambda: sq.seq3("seq"))
_protein("f14_seq1", "seq AS one", one=lambda: sq.seq1(sq.seq3("seq")))
_add("f15_nt_search", lambda s, d: dna(s, d).select("doc_id", F.explode(sq.nt_search("seq", "GANTC")).alias("pos")), f"WITH {D} SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos FROM d, unnest(range(1, length(seq) - 3)) AS t(i) WHERE substr(seq, i, 2) = 'GA' AND substr(seq, i + 3, 2) = 'TC'")
_add("f18_crc32", lambda s, d: dna(s, d).select("doc_id", sq.crc32("seq").alias("crc")))
_t64 = ", ".join(map(str, sq.crc64_table()))
_dna("f19_crc64", f"'CRC-' || format('{{:016X}}', list_reduce(list_prepend(CAST(0 AS UBIGINT), list_transform(regexp_extract_all(seq, '.'), lambda c: CAST(ascii(c) AS UBIGINT))), lambda acc, c: xor(acc >> 8, CAST(list_extract([{_t64}], CAST((xor(acc, c) & 255) AS BIGINT) + 1) AS UBIGINT) << 32))) AS crc", crc=lambda: sq.crc64("seq"))
_dna("f20_gcg", "CAST(coalesce(list_sum(list_transform(range(1, length(seq) + 1), lambda i: ((i - 1) % 57 + 1) * ascii(substr(seq, i, 1)))), 0) % 10000 AS INTEGER) AS gcg", gcg=lambda: sq.gcg("seq"))
_dna("f21_seguid", "rtrim(to_base64(unhex(sha1(upper(seq)))), '=') AS seguid", seguid=lambda: sq.seguid("seq"))
_one = {c: codes.get(1).forward.get(c, "*") for c in codes.ORDER}
_eleven = {c: codes.get(11).forward.get(c, "*") for c in codes.ORDER}


def _sql_translate(seq: str, table: dict = _one) -> str:
    aas = "".join(table[c] for c in codes.ORDER)
    place = " + ".join(f"{16 // 4**k} * (strpos('TCAG', substr({seq}, i + {k}, 1)) - 1)" for k in range(3))
    return f"array_to_string(list_transform(range(1, length({seq}) - 1, 3), lambda i: substr('{aas}', {place} + 1, 1)), '')"


_dna("f5_translate", f"{_sql_translate('seq')} AS prot", prot=lambda: tr.translate("seq"))
_dna("f6_translate_bacterial", f"{_sql_translate('seq', _eleven)} AS prot", prot=lambda: tr.translate("seq", 11))
_dna("f5_translate_to_stop", f"string_split({_sql_translate('seq')}, '*')[1] AS prot", prot=lambda: tr.translate("seq", to_stop=True))
_rc = f"reverse(translate(seq, '{_FROM}', '{_TO}'))"
_add(
    "f16_six_frames",
    lambda s, d: dna(s, d).select("doc_id", F.explode(tr.six_frames("seq")).alias("f")).select("doc_id", "f.frame", "f.protein"),
    f"WITH {D}, s AS (SELECT doc_id, sign * (k + 1) AS frame, substr(CASE WHEN sign = 1 THEN seq ELSE {_rc} END, CAST(k + 1 AS BIGINT)) AS x FROM d, (VALUES (1), (-1)) AS a(sign), (VALUES (0), (1), (2)) AS b(k)) SELECT doc_id, CAST(frame AS INTEGER) AS frame, {_sql_translate('x')} AS protein FROM s",
)

# ------------------------------------------------------------------ proteins

AAS = pr.AMINO_ACIDS
_add("a2_residue_counts", lambda s, d: protein(s, d).select("doc_id", F.explode(pr.residue_counts("seq")).alias("aa", "n")), f"WITH {P} SELECT doc_id, aa, CAST(length(seq) - length(replace(seq, aa, '')) AS INTEGER) AS n FROM p, unnest({list(AAS)}) AS t(aa)")
_pct = {a: f"(CAST({_n(a)} AS DOUBLE) * 100.0 / length(seq))" for a in AAS}
_add("p1_residue_percent", lambda s, d: protein(s, d).select("doc_id", F.explode(pr.residue_percent("seq")).alias("aa", "pct")), f"WITH {P} SELECT doc_id, aa, CAST(length(seq) - length(replace(seq, aa, '')) AS DOUBLE) * 100.0 / length(seq) AS pct FROM p, unnest({list(AAS)}) AS t(aa) WHERE length(seq) > 0")
_pw = dims.load("residues")["PROTEIN_WEIGHTS"]
_protein("p2_weight", "round(" + " + ".join(f"{_n(a)} * CAST({_pw[a]} AS DOUBLE)" for a in AAS) + " - (length(seq) - 1) * CAST(18.0153 AS DOUBLE), 4) AS mass", mass=lambda: F.round(pr.weight("seq"), 4))


def _sum(letters: str) -> str:
    return "(0.0 + " + " + ".join(f"{_pct[a]} / 100.0" for a in letters) + ")"


_protein("p3_aromaticity", f"CASE WHEN length(seq) > 0 THEN {_sum('YWF')} END AS arom", arom=lambda: pr.aromaticity("seq"))
_ss = {"helix": "EMALK", "turn": "NPGSD", "sheet": "VIYFWLT"}
_add("p10_secondary_structure", lambda s, d: protein(s, d).withColumn("s", pr.secondary_structure("seq")).select("doc_id", "s.helix", "s.turn", "s.sheet"), f"WITH {P} SELECT doc_id, " + ", ".join(f"CASE WHEN length(seq) > 0 THEN {_sum(x)} END AS {k}" for k, x in _ss.items()) + " FROM p")
_red = f"({_n('W')} * 5500 + {_n('Y')} * 1490)"
_add("p11_extinction", lambda s, d: protein(s, d).withColumn("e", pr.extinction("seq")).select("doc_id", "e.reduced", "e.cystines"), f"WITH {P} SELECT doc_id, CAST({_red} AS INTEGER) AS reduced, CAST({_red} + ({_n('C')} // 2) * 125 AS INTEGER) AS cystines FROM p")
_pairs = f"[{', '.join(f'CAST({w} AS DOUBLE)' for row in dims.load('protein')['DIWV'] for w in row)}]"
_protein("p4_instability", f"CASE WHEN length(seq) > 0 THEN round(10.0 / length(seq) * coalesce(list_sum(list_transform(range(1, length(seq)), lambda i: list_extract({_pairs}, (strpos('{AAS}', substr(seq, i, 1)) - 1) * 20 + strpos('{AAS}', substr(seq, i + 1, 1))))), 0.0), 6) END AS instability", instability=lambda: F.round(pr.instability("seq"), 6))
_kd = pr.scale_values("KyteDoolitle")
_protein("p6_gravy", "CASE WHEN length(seq) > 0 THEN round((" + " + ".join(f"{_n(a)} * CAST({v} AS DOUBLE)" for a, v in _kd.items()) + ") / length(seq), 6) END AS gravy", gravy=lambda: F.round(pr.gravy("seq"), 6))
_flex = dict(zip(AAS, dims.load("protein")["FLEX"]))
_f = f"list_transform(regexp_extract_all(seq, '.'), lambda a: {_pick(_flex)})"
_add(
    "p5_flexibility",
    lambda s, d: protein(s, d).select("doc_id", F.posexplode(pr.flexibility("seq")).alias("win", "flex")).withColumn("flex", F.round("flex", 9)),
    f"WITH {P}, x AS (SELECT doc_id, {_f} AS v FROM p WHERE length(seq) > 9) SELECT doc_id, CAST(i - 1 AS INTEGER) AS win, round(((v[i] + v[i + 8]) * 0.25 + (v[i + 1] + v[i + 7]) * 0.4375 + (v[i + 2] + v[i + 6]) * 0.625 + (v[i + 3] + v[i + 5]) * 0.8125 + v[i + 5]) / 5.25, 9) AS flex FROM x, unnest(range(1, len(v) - 8)) AS t(i)",
)
_add(
    "p7_protein_scale",
    lambda s, d: protein(s, d).select("doc_id", F.posexplode(pr.protein_scale("seq", "kd", 9, 0.4)).alias("win", "value")).withColumn("value", F.round("value", 9) + 0.0),
    f"WITH {P}, x AS (SELECT doc_id, list_transform(regexp_extract_all(seq, '.'), lambda a: {_pick(_kd)}) AS v FROM p WHERE length(seq) >= 9) SELECT doc_id, CAST(i - 1 AS INTEGER) AS win, round(((v[i] + v[i + 8]) * 0.4 + (v[i + 1] + v[i + 7]) * 0.55 + (v[i + 2] + v[i + 6]) * 0.7 + (v[i + 3] + v[i + 5]) * 0.85 + v[i + 4]) / 6.0, 9) + 0.0 AS value FROM x, unnest(range(1, len(v) - 7)) AS t(i)",
)
_pp = dims.load("protein")


def _sql_charge(ph: str) -> str:
    def end(table: dict, key: str, at: str, special: dict) -> str:
        return f"CASE {at} " + " ".join(f"WHEN '{a}' THEN {v}" for a, v in special.items()) + f" ELSE {table[key]} END"

    plus = [f"1.0 / (pow(10.0, {ph} - ({end(_pp['POSITIVE_PKS'], 'Nterm', 'seq[1]', _pp['PK_NTERMINAL'])})) + 1.0)"] + [f"{_n(a)} * (1.0 / (pow(10.0, {ph} - {v}) + 1.0))" for a, v in _pp["POSITIVE_PKS"].items() if a != "Nterm"]
    minus = [f"1.0 / (pow(10.0, ({end(_pp['NEGATIVE_PKS'], 'Cterm', 'seq[-1]', _pp['PK_CTERMINAL'])}) - {ph}) + 1.0)"] + [f"{_n(a)} * (1.0 / (pow(10.0, {v} - {ph}) + 1.0))" for a, v in _pp["NEGATIVE_PKS"].items() if a != "Cterm"]
    return f"({' + '.join(plus)}) - ({' + '.join(minus)})"


_protein("p9_charge", f"CASE WHEN length(seq) > 0 THEN round(CAST({_sql_charge('CAST(7.0 AS DOUBLE)')} AS DOUBLE), 6) END AS charge", charge=lambda: F.round(pr.charge("seq", 7.0), 6))
_add(
    "p8_isoelectric_point",
    lambda s, d: protein(s, d).select("doc_id", F.round(pr.isoelectric_point("seq"), 6).alias("pi")),
    f"WITH RECURSIVE {P}, b AS (SELECT doc_id, seq, CAST(7.775 AS DOUBLE) AS ph, CAST(4.05 AS DOUBLE) AS lo, CAST(12 AS DOUBLE) AS hi FROM p WHERE length(seq) > 0 UNION ALL SELECT doc_id, seq, ((CASE WHEN c > 0 THEN ph ELSE lo END) + (CASE WHEN c > 0 THEN hi ELSE ph END)) / 2, CASE WHEN c > 0 THEN ph ELSE lo END, CASE WHEN c > 0 THEN hi ELSE ph END FROM (SELECT *, {_sql_charge('ph')} AS c FROM b WHERE hi - lo > 0.0001)), z AS (SELECT doc_id, round(ph, 6) AS pi, hi - lo AS w, row_number() OVER (PARTITION BY doc_id ORDER BY hi - lo) AS k FROM b) SELECT doc_id, pi FROM z WHERE k = 1",
)
_add("p12_scales", lambda s, d: dims.scale_table(s))

# ------------------------------------------------------------------ aggregates

_kmer = "SELECT doc_id, substr(seq, i, {k}) AS kmer FROM d, unnest(range(1, length(seq) - {k} + 2)) AS t(i)"
_add("a1_kmer_counts", lambda s, d: rel.count_kmers(dna(s, d), 6, "seq"), f"WITH {D}, k AS ({_kmer.format(k=6)}) SELECT kmer, count(*) AS n FROM k GROUP BY kmer")
_add("a1_kmer_counts_by_document", lambda s, d: rel.count_kmers(dna(s, d), 3, "seq", ["doc_id"]), f"WITH {D}, k AS ({_kmer.format(k=3)}) SELECT doc_id, kmer, count(*) AS n FROM k GROUP BY ALL")
_syn = "(VALUES " + ", ".join(f"('{c}', '{a}')" for c, a in _one.items()) + ") AS m(codon, aa)"
_cod = "c AS (SELECT doc_id, substr(seq, i, 3) AS codon FROM d, unnest(range(1, length(seq) - 1, 3)) AS t(i))"
_idx = f"n AS (SELECT m.codon, aa, greatest(count(c.codon), CAST(0.5 AS DOUBLE)) AS n FROM {_syn} LEFT JOIN c ON c.codon = m.codon GROUP BY m.codon, aa), w AS (SELECT codon, aa, n, n / max(n) OVER (PARTITION BY aa) AS w FROM n)"
_add("a3_codon_adaptation_index", lambda s, d: rel.codon_adaptation_index(s, dna(s, d), "seq"), f"WITH {D}, {_cod}, {_idx} SELECT codon, aa, n, w FROM w")


def _cai(s: SparkSession, d: str) -> DataFrame:
    genes = dna(s, d)
    out = rel.codon_adaptation(genes, rel.codon_adaptation_index(s, genes, "seq"), "doc_id", "seq")
    return out.select("doc_id", F.round("cai", 9).alias("cai"), "n_codons")


_sql_cai = f"WITH {D}, {_cod}, {_idx}, g AS (SELECT doc_id, exp(sum(ln(w)) / count(*)) AS cai, count(*) AS n_codons FROM c JOIN w ON c.codon = w.codon WHERE c.codon NOT IN ('ATG', 'TGG') GROUP BY doc_id)"
_add("a4_codon_adaptation", _cai, f"{_sql_cai} SELECT d.doc_id, round(cai, 9) AS cai, n_codons FROM d LEFT JOIN g ON d.doc_id = g.doc_id")
_add("a5_adaptation_text", lambda s, d: rel.adaptation_text(rel.codon_adaptation_index(s, dna(s, d), "seq")), f"WITH {D}, {_cod}, {_idx} SELECT codon, codon || chr(9) || format('{{:.3f}}', w) AS line FROM w")
_add("a11_cai_ranking", lambda s, d: rel.rank_top(_cai(s, d).where("cai IS NOT NULL"), "cai", "doc_id", 20), f"{_sql_cai} SELECT doc_id, round(cai, 9) AS cai, n_codons FROM g ORDER BY 2 DESC, doc_id DESC LIMIT 20")
_add("a6_gc_counts", lambda s, d: reads(s, d).withColumn("c", sq.gc_counts("sequence")).select("name", "c.gc", "c.at"), f"WITH {R} SELECT name, CAST({_n('GC', 'sequence')} AS INTEGER) AS gc, CAST({_n('AT', 'sequence')} AS INTEGER) AS at FROM r")
_q = "list_sum(list_transform(range(1, length(sequence) + 1), lambda j: (ascii(substr(sequence, j, 1)) + j - 1) % 42)) / CAST(length(sequence) AS DOUBLE)"
_g = f"({_share(_n('GC', 'sequence'), _n('ACGT', 'sequence'))})"
_add(
    "a9_fastq_qc",
    lambda s, d: rel.fastq_qc(reads(s, d), most_n=2, gc=(0.45, 0.55), least_q=20.0),
    f"WITH {R} SELECT CASE WHEN {_n('N', 'sequence')} > 2 THEN 'n' WHEN {_g} < 0.45 OR {_g} > 0.55 THEN 'gc' WHEN {_q} < 20 THEN 'quality' ELSE 'kept' END AS reason, count(*) AS n_reads, CAST(sum(length(sequence)) AS BIGINT) AS n_bases FROM r GROUP BY 1",
)
_add(
    "a10_read_summary",
    lambda s, d: rel.read_summary(reads(s, d)),
    f"WITH {R} SELECT count(*) AS n_reads, CAST(sum(length(sequence)) AS BIGINT) AS n_bases, CAST(sum(length(sequence)) AS DOUBLE) / count(*) AS mean_length, CAST(sum({_n('GC', 'sequence')}) AS DOUBLE) / CAST(sum({_n('ACGT', 'sequence')}) AS DOUBLE) AS gc_share, CAST(min(length(sequence)) AS INTEGER) AS shortest, CAST(max(length(sequence)) AS INTEGER) AS longest FROM r",
)

# ------------------------------------------------------------------ dimensions

_codes = "(VALUES " + ", ".join(f"({t[0]}, '{t[3]}')" for t in dims.load("codes")) + ") AS c(table_id, aas)"
_add(
    "g1_genetic_codes",
    lambda s, d: codes.code_table(s).where("aa IS NOT NULL").select("table_id", "codon", "aa"),
    f"SELECT table_id, substr('TCAG', CAST((i // 16) + 1 AS BIGINT), 1) || substr('TCAG', CAST((i // 4) % 4 + 1 AS BIGINT), 1) || substr('TCAG', CAST(i % 4 + 1 AS BIGINT), 1) AS codon, substr(aas, CAST(i + 1 AS BIGINT), 1) AS aa FROM {_codes}, unnest(range(0, 64)) AS t(i) WHERE substr(aas, CAST(i + 1 AS BIGINT), 1) <> '*'",
)
_add("g4_back_table", lambda s, d: codes.code_table(s).where("aa IS NOT NULL").groupBy("table_id", "aa").agg(F.max("codon").alias("codon")))
_add("g7_ambiguous_codons", lambda s, d: codes.proteins_table(s))
_add("s34_matrices", lambda s, d: dims.matrix_table(s))
_add("r1_enzymes", lambda s, d: rs.enzymes(s).select("name", "site", "size", "ovhg", "ovhgseq", "overhang", *rs.FLAGS))
_add("r7_suppliers", lambda s, d: rs.suppliers(s))
for _kind in ("isoschizomers", "equischizomers", "neoschizomers"):
    _add(f"r11_{_kind}", lambda s, d, k=_kind: rs.relatives(s, k))

# ------------------------------------------------------------------ restriction

_batch = {"EcoRI": ("GAATTC", 1, -4), "BamHI": ("GGATCC", 1, -4), "AluI": ("AGCT", 2, 0), "PstI": ("CTGCAG", 5, 4)}
_sites = " UNION ALL ".join(f"SELECT doc_id, '{n}' AS enzyme, CAST(i + {f} AS INTEGER) AS cut FROM d, unnest(range(1, length(seq) - {len(x) - 2})) AS t(i) WHERE substr(seq, i, {len(x)}) = '{x}' AND i + {f} > 1 AND i + {f} <= length(seq) AND i + {f} - ({o}) > 1 AND i + {f} - ({o}) <= length(seq)" for n, (x, f, o) in _batch.items())
_add("r15_digest", lambda s, d: rs.search(dna(s, d), list(_batch), "seq").select("doc_id", "enzyme", F.explode("cuts").alias("cut")), f"WITH {D} {_sites}")
_add("r3_digest_native", lambda s, d: dna(s, d).select("doc_id", F.lit("EcoRI").alias("enzyme"), F.explode(rs.palindrome_cuts("seq", "EcoRI")).alias("cut")), f"WITH {D} SELECT * FROM ({_sites}) AS x WHERE enzyme = 'EcoRI'")
_add("r4_fragments", lambda s, d: dna(s, d).select("doc_id", F.posexplode(rs.catalyse("EcoRI")(F.col("seq"))).alias("k", "fragment")).select("doc_id", "k", F.length("fragment").alias("size")))
_add("a8_by_cut_number", lambda s, d: rs.by_cut_number(rs.search(dna(s, d), list(_batch), "seq").drop("seq")), f"WITH {D}, c AS ({_sites}), e(enzyme) AS (VALUES ('EcoRI'), ('BamHI'), ('AluI'), ('PstI')), n AS (SELECT d.doc_id, e.enzyme, CAST(count(c.cut) AS INTEGER) AS n_cuts FROM d CROSS JOIN e LEFT JOIN c ON c.doc_id = d.doc_id AND c.enzyme = e.enzyme GROUP BY ALL) SELECT doc_id, n_cuts, list_sort(list(enzyme)) AS enzymes FROM n GROUP BY ALL")
_add("r17_only_between", lambda s, d: rs.only_between(rs.search(dna(s, d), list(_batch), "seq"), 1, 500, "seq").select("doc_id", "enzyme", "n_cuts"), f"WITH {D}, c AS ({_sites}) SELECT doc_id, enzyme, CAST(count(*) AS INTEGER) AS n_cuts FROM c GROUP BY ALL HAVING max(cut) < 500")

# ------------------------------------------------------------------ alignment

_PRIMERS = ["ACGTACGTACGT", "GATTACAGATTACA", "TTGACCTTGACA"]


def _primer_rank(s: SparkSession, d: str) -> DataFrame:
    """Every primer against every read, best first."""
    pairs = reads(s, d).select("name", "sequence", F.posexplode(F.array(*map(F.lit, _PRIMERS))).alias("primer", "p"))
    scored = pairs.select("name", "primer", Aligner("local", 2, -1, -2, -1).score_column(F.col("sequence"), F.col("p")).alias("score"))
    return scored


_add("l3_alignment_scores", _primer_rank)
_add("a12_primer_ranking", lambda s, d: _primer_rank(s, d).orderBy(F.desc("score"), "name", "primer").limit(50))


def _halves(s: SparkSession, d: str) -> DataFrame:
    """L4: the first half of every read against its second; the halves hold all its letters, and a read of one has none."""
    half = F.expr("length(sequence) div 2").cast("int")
    first, second = F.col("sequence").substr(F.lit(1), half), F.col("sequence").substr(half + 1, F.length("sequence"))
    return reads(s, d).where("length(sequence) > 1").select("name", Aligner("global", 1, 0, -2, -1).align_column(first, second).alias("a")).select("name", "a.score", "a.identities", "a.mismatches", "a.gaps")


_add("l4_alignments", _halves)

# ------------------------------------------------------------------ sources and sinks


def _fastq_round_trip(s: SparkSession, d: str) -> DataFrame:
    path = scratch(s, "fastq")
    sinks.write_fastq(reads(s, d).withColumn("title", F.concat("name", F.lit(" derived read"))), path)
    return readers.read(s, "fastq", path).select("name", "description", "sequence", "quality")


def _fasta_round_trip(s: SparkSession, d: str) -> DataFrame:
    path = scratch(s, "fasta")
    sinks.write_fasta(dna(s, d).select(F.col("doc_id").cast("string").alias("title"), F.col("seq").alias("sequence")), path)
    return readers.read(s, "fasta", path).select("name", "sequence")


_add("s13_fastq_round_trip", _fastq_round_trip, f"WITH {R} SELECT name, 'derived read' AS description, sequence, quality FROM r")
_add("s14_fasta_round_trip", _fasta_round_trip, f"WITH {D} SELECT CAST(doc_id AS VARCHAR) AS name, seq AS sequence FROM d")
_wrap = "array_to_string(list_transform(range(0, (length(seq) + 59) // 60), lambda i: substr(seq, i * 60 + 1, 60)), chr(10))"
_dna("k1_format_fasta", f"'>' || doc_id || chr(10) || {_wrap} AS record", record=lambda: sinks.format_fasta(F.col("doc_id").cast("string"), "seq"))
_add("k2_format_fastq", lambda s, d: reads(s, d).select("name", sinks.format_fastq("name", "sequence", "quality").alias("record")), f"WITH {R} SELECT name, '@' || name || chr(10) || sequence || chr(10) || '+' || chr(10) || quality AS record FROM r")
_add("k3_format_qual", lambda s, d: reads(s, d).select("name", sinks.format_qual("name", "quality", 0).alias("record")), f"WITH {R} SELECT name, '>' || name || chr(10) || array_to_string(list_transform(regexp_extract_all(quality, '.'), lambda c: CAST(ascii(c) - 33 AS VARCHAR)), ' ') AS record FROM r")
_add("k5_phred_to_sanger", lambda s, d: reads(s, d).select("name", sinks.phred_to_sanger(sinks.phred("quality")).alias("quality")), f"WITH {R} SELECT name, quality FROM r")
_add("s5_grid_pileup", lambda s, d: readers.grid(reads(s, d).where("length(sequence) = 150")).select(F.posexplode("bases").alias("col", "base")).groupBy("col", "base").agg(F.count("*").alias("n")), f"WITH {R} SELECT CAST(j - 1 AS INTEGER) AS col, substr(sequence, j, 1) AS base, count(*) AS n FROM r, unnest(range(1, 151)) AS t(j) WHERE length(sequence) = 150 GROUP BY ALL")
_add("s7_slices", lambda s, d: reads(s, d).select("name", readers.slice_of("sequence", 10, 25).alias("part")), f"WITH {R} SELECT name, substr(sequence, 11, 15) AS part FROM r")


def _flat(fmt: str):
    """A flat file written from the documents and read back: records with one feature."""

    def query(s: SparkSession, d: str) -> DataFrame:
        path = scratch(s, fmt)
        rows = dna(s, d).where("length(seq) > 0")
        ident = F.format_string("DOC%08d", "doc_id")
        n = F.length("seq")
        if fmt == "genbank":
            starts = F.regexp_extract_all(F.lower("seq"), F.lit(".{1,60}"), F.lit(0))
            body = F.array_join(F.transform(starts, lambda x, i: F.concat(F.lpad((i * 60 + 1).cast("string"), 9, " "), F.lit(" "), F.array_join(F.regexp_extract_all(x, F.lit(".{1,10}"), F.lit(0)), " "))), "\n")
            record = F.concat(F.lit("LOCUS       "), F.rpad(ident, 16, " "), F.lpad(n.cast("string"), 12, " "), F.lit(" bp    DNA     linear   SYN 01-JAN-2020\nDEFINITION  derived sequence.\nACCESSION   "), ident, F.lit("\nVERSION     "), ident, F.lit(".1\nFEATURES             Location/Qualifiers\n     gene            complement(1.."), n.cast("string"), F.lit(')\n                     /note="all of it"\nORIGIN\n'), body, F.lit("\n//"))
        else:
            body = F.array_join(F.transform(F.regexp_extract_all(F.lower("seq"), F.lit(".{1,60}"), F.lit(0)), lambda x, i: F.concat(F.lit("     "), x, F.lit(" "), (i * 60 + F.length(x)).cast("string"))), "\n")
            record = F.concat(F.lit("ID   "), ident, F.lit("; SV 1; linear; genomic DNA; STD; SYN; "), n.cast("string"), F.lit(" BP.\nAC   "), ident, F.lit(";\nDE   derived sequence\nFH   Key             Location/Qualifiers\nFT   gene            complement(1.."), n.cast("string"), F.lit(')\nFT                   /note="all of it"\nSQ   Sequence '), n.cast("string"), F.lit(" BP;\n"), body, F.lit("\n//"))
        rows.select(record.alias("value")).write.text(path)
        f = F.col("features")[0]
        return readers.read(s, fmt, path, columns="features").select("id", "name", "description", "sequence", f["type"].alias("type"), f["location"]["parts"][0]["end"]["value"].alias("feature_end"), f["location"]["parts"][0]["strand"].alias("strand"))

    return query


_sql_flat = f"WITH {D} SELECT 'DOC' || lpad(CAST(doc_id AS VARCHAR), 8, '0') || '.1' AS id, 'DOC' || lpad(CAST(doc_id AS VARCHAR), 8, '0') AS name, 'derived sequence' AS description, seq AS sequence, 'gene' AS type, length(seq) AS feature_end, -1 AS strand FROM d WHERE length(seq) > 0"
_add("s16_genbank", _flat("genbank"), _sql_flat)
_add("s16_embl", _flat("embl"), _sql_flat)

# ------------------------------------------------------------------ streaming


def _stream_kmers(s: SparkSession, d: str) -> DataFrame:
    """Reads land as FASTQ files, the stream keeps k-mer counts as state, and its last answer is returned."""
    folder, name = scratch(s, "arrivals"), f"kmers_{abs(hash(d)) % 10**9}"
    sinks.write_fastq(reads(s, d).withColumn("title", F.col("name")), folder)
    counts = rel.kmer_counts_streaming(streaming.stream_fastq(s, folder), 4)
    run = counts.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", scratch(s, "stream")).trigger(availableNow=True).start()
    run.awaitTermination()
    return s.table(name)


_add("stream_kmer_counts", _stream_kmers, f"WITH {R}, k AS (SELECT substr(sequence, i, 4) AS kmer FROM r, unnest(range(1, length(sequence) - 2)) AS t(i)) SELECT kmer, count(*) AS n FROM k WHERE NOT contains(kmer, 'N') GROUP BY kmer")
