"""Files are read piece by piece: the same records and errors as from all bytes, and no more than a piece, a batch and a record held."""

import gzip
import tracemalloc

import pytest

from helixframe import streaming
from helixframe.sources import flatfile, readers, records

PLAIN = b"".join(b"@r%d u@h\n%s\n+\n%s\n" % (i, b"ACGT" * (i % 5 + 1), b"@I+@" * (i % 5 + 1)) for i in range(30))
MIXED = PLAIN + b"@w wrapped\nACGT\nAC\n+\n@III\nII\n" + PLAIN + b"@e\n\n+\n\n"


def cut(data: bytes, size: int) -> list[bytes]:
    return [data[i : i + size] for i in range(0, len(data), size)]


@pytest.mark.parametrize("data", [PLAIN, MIXED, MIXED.replace(b"\n", b"\r\n"), MIXED.replace(b"\n", b"\r"), b"", b"@a\nAC\n+\nII"])
def test_fastq_of_pieces(data, monkeypatch):
    want = list(records.parse_fastq(data))
    for size in (1, 2, 7, 64, 1000, 1 << 20):
        monkeypatch.setattr(records, "PIECE", size)
        assert list(records.parse_fastq(cut(data, size))) == want
        assert [r for t in records.fastq_tables(cut(data, size), 4) for r in zip(*t)] == want


def test_fastq_errors_of_pieces_have_the_same_place(monkeypatch):
    for bad in (b"@x\nACG\n+\nII\n", b"@x\nACG\n", b"oops\n", b"@x\nA C\n+\nIII\n", b"@x\nAC\n+y\nII\n"):
        before: list = []
        with pytest.raises(records.FormatError) as want:
            for r in records.parse_fastq(PLAIN + bad):
                before.append(r)
        for size in (5, 100, 1 << 20):
            monkeypatch.setattr(records, "PIECE", size)
            got: list = []
            with pytest.raises(records.FormatError) as e:
                for t in records.fastq_tables(cut(PLAIN + bad, size), 7):
                    got += zip(*t)
            assert str(e.value) == str(want.value) and got == before


def test_fasta_and_flat_files_of_pieces():
    fasta = b"; x\r\n>a b\r\nAC GT\r\nA\n;C\n>e\n>z\rTT\rGG"
    embl = b"".join(b"ID   X%d; SV 3; linear; genomic DNA; STD; SYN; 12 BP.\nAC   X%d;\nSQ   Sequence 12 BP;\n     acgtacgtac gt   12\n//\n" % (i, i) for i in range(5))
    for size in (1, 3, 10, 1000):
        assert list(records.parse_fasta(cut(fasta, size))) == list(records.parse_fasta(fasta))
        assert list(flatfile.parse(cut(embl, size), "embl")) == list(flatfile.parse(embl, "embl"))


def _peak(path, fmt: str, schema, monkeypatch) -> tuple[int, int]:
    monkeypatch.setattr(records, "PIECE", 1 << 16)
    monkeypatch.setattr(readers, "BATCH", 100)
    monkeypatch.setattr(readers, "BATCH_BYTES", 1 << 16, raising=False)
    monkeypatch.setattr(records.pieces, "__defaults__", (1 << 16,))
    reader = readers.SOURCES[fmt]({"path": str(path), "columns": "features"}).reader(schema)
    n = 0
    tracemalloc.start()
    for part in reader.partitions():
        for b in reader.read(part):
            n += b.num_rows
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return n, peak


@pytest.mark.parametrize("fmt, record", [("fastq", b"@r%d\n" + b"ACGT" * 500 + b"\n+\n" + b"I" * 2000 + b"\n"), ("fasta", b">r%d\n" + (b"ACGT" * 15 + b"\n") * 60), ("embl", b"ID   X%d; SV 1; linear; genomic DNA; STD; SYN; 3600 BP.\nSQ   Sequence\n" + (b"     " + b"acgt" * 15 + b" 60\n") * 60 + b"//\n"), ("genbank", b"LOCUS       X%d\nORIGIN\n" + (b"        1 " + b"acgtacgtac " * 6 + b"\n") * 60 + b"//\n")])
def test_memory_does_not_grow_with_the_file(spark, tmp_path, monkeypatch, fmt, record):
    from pyspark.sql.types import StructType

    path = tmp_path / "x"
    path.write_bytes(b"".join(record % i for i in range(2000)))  # 8 MB
    n, peak = _peak(path, fmt, StructType.fromDDL({"fastq": readers.FASTQ, "fasta": readers.FASTA}.get(fmt, readers.FLAT)), monkeypatch)
    assert n == 2000 and peak < 4 << 20


def test_stream_reads_large_files_by_splits(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "plain").write_bytes(PLAIN)
    (tmp_path / "in" / "zipped").write_bytes(gzip.compress(PLAIN))
    (tmp_path / "in" / "crlf").write_bytes(MIXED.replace(b"\n", b"\r\n"))
    (tmp_path / "in" / "none").write_bytes(b"")
    run = streaming.stream_fastq(spark, str(tmp_path / "in"), split_bytes=100).writeStream.format("memory").queryName("by_splits").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination()
    got = spark.table("by_splits").collect()
    want = [tuple(r) for r in records.parse_fastq(PLAIN)]
    for name, rows in (("plain", want), ("zipped", want), ("crlf", list(records.parse_fastq(MIXED)))):
        own = sorted((r for r in got if r.file.endswith(name)), key=lambda r: r.record_index)
        assert [(r.title, r.sequence, r.quality) for r in own] == rows
    assert len(got) == len({(r.file, r.record_index) for r in got})
    plan = run._jsq.explainInternal(False)
    assert "content" not in plan.split("Physical Plan")[-1]  # whole files don't pass through the stream
