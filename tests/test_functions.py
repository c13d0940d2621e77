import pytest
from pyspark.sql import functions as F

from helixframe.dims import codes, matrix, matrix_names, read_matrix
from helixframe.functions import protein as pr
from helixframe.functions import sequence as sq
from helixframe.functions import translation as tr


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_literals(spark):
    s = F.lit("ACGTACGTACGT")
    got = one(spark, sq.gcg(s), sq.crc64(s), sq.crc32(s), sq.seguid(s), sq.reverse_complement(F.lit("ACGTNu")))
    assert tuple(got) == (5688, "CRC-C4FBB762C4A87EBD", 20049947, "If6HIvcnRSQDVNiAoefAzySc6i4", "aNACGT")


def test_composition(spark):
    got = one(spark, sq.gc123(F.lit("ACTGTN")), sq.gc_skew(F.lit("GGGCCC"), 3), sq.molecular_weight(F.lit("AGC")), sq.gc_fraction(F.lit("")))
    assert tuple(got[0]) == (40.0, 50.0, 50.0, 0.0) and got[1] == [1.0, -1.0]
    assert got[2] == pytest.approx(949.61, abs=0.01) and got[3] == 0.0


def test_compensated_sum(spark):
    assert one(spark, sq.compensated(F.array(*map(F.lit, [1.0, 1e100, 1.0, -1e100]))))[0] == 2.0


def test_translate(spark):
    s = F.lit("ATGAAATAG")
    got = one(spark, tr.translate(s), tr.translate(s, to_stop=True), tr.translate(s, cds=True), tr.translate(F.lit("TARNNNRAC")), tr.translate(F.lit("AUG---TG"), gap="-"))
    assert tuple(got) == ("MK*", "MK", "MK", "*XB", "M-")
    with pytest.raises(Exception, match="is invalid"):
        one(spark, tr.translate(F.lit("AT!")))
    with pytest.raises(ValueError), pytest.warns(UserWarning):
        tr.translate(s, 27), tr.translate(s, 27, to_stop=True)


def test_protein(spark):
    got = one(spark, pr.isoelectric_point(F.lit("INGAR")), pr.charge(F.lit("INGAR")), pr.extinction(F.lit("MAWYCC")), pr.gravy(F.lit("")))
    assert got[0] == pytest.approx(9.75, abs=0.001) and got[1] == pytest.approx(0.76, abs=0.001)
    assert tuple(got[2]) == (6990, 7115) and got[3] is None
    assert len(one(spark, pr.flexibility(F.lit("MAEGEITTFTA")))[0]) == 2


def test_search_overlaps(spark):
    assert one(spark, sq.nt_search(F.lit("AAAA"), "AA"), sq.nt_search(F.lit("ACGTACGT"), "ACGN"))[:] == ([0, 1, 2], [0, 4])


def test_codes():
    assert len(codes.tables()) >= 27 and codes.get("SGC1").id == 2 and codes.get("1").id == 1
    assert codes.get(1).residue("RAC") == "B" and "TAR" in codes.get(1).ambiguous_stops()
    with pytest.raises(KeyError):
        codes.get(1).possible("TAR")
    assert codes.get(1).back()["K"] == "AAG" and codes.get(1).back()[None] == "TAA"


def test_matrices():
    assert len(matrix_names()) == 30 and matrix("BLOSUM62")["W", "W"] == 11 and matrix("BLOSUM62")["A", "R"] == matrix("BLOSUM62")["R", "A"]
    assert read_matrix("# x\n A C\nA 1 2\nC 2 3\n")["C", "A"] == 2
