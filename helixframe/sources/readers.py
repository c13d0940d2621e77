"""Spark data sources for sequence files: format("fastq"), "fasta", "genbank", "embl", "swiss".

Plain FASTQ of four-line records is cut into splits (a split starts at a verified record); FASTA and flat files are read
a file per task. All are read a few megabytes at a time and given out in record batches, so a task holds a piece, a batch and a
record whatever the size of the file. Gzip is recognised by its bytes, never by its name. A path with a scheme (hdfs, s3, gs) is read through the
file system that it names, on the driver and in tasks alike. Options: `columns` names the costly nested columns to parse
(flat files), `name` keeps one record, `split_bytes` sets the size of a split, `mode` is failfast or permissive
(a malformed file then ends at its first bad record).
"""

from __future__ import annotations

import fnmatch
import glob
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from . import flatfile, records

FASTQ = "file string, record_index long, name string, description string, title string, sequence string, quality string"
FASTA = "file string, record_index long, name string, description string, title string, sequence string"
POS = "struct<kind:string,value:bigint,left:bigint,right:bigint,choices:array<bigint>>"
LOCATION = f"struct<operator:string,parts:array<struct<start:{POS},end:{POS},strand:int,ref:string>>>"
FEATURE = f"struct<type:string,location:{LOCATION},status:string,message:string,warnings:array<struct<kind:string,text:string>>,qualifiers:array<struct<key:string,value:string,has_value:boolean,escape_warning:boolean,escape_text:string>>>"
REFERENCE = "struct<title:string,authors:string,consrtm:string,journal:string,pubmed_id:string,medline_id:string,comment:string,location:array<struct<start:bigint,end:bigint>>>"
ANNOTATIONS = f"struct<key_order:array<string>,molecule_type:string,topology:string,data_file_division:string,date:string,accessions:array<string>,sequence_version:bigint,gi:string,keywords:array<string>,source:string,organism:string,taxonomy:array<string>,references:array<{REFERENCE}>,comment:string>"
FLAT = f"file string, record_index long, id string, name string, description string, sequence string, features array<{FEATURE}>, features_error string, annotations {ANNOTATIONS}, annotations_error string"


class Split(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        super().__init__((path, start, end))
        self.path, self.start, self.end = path, start, end


def system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it; without a scheme, the local one."""
    if re.match("[A-Za-z][A-Za-z0-9+.-]+:/", path):
        scheme, _, rest = path.partition(":")
        if scheme == "file":
            return fs.LocalFileSystem(), "/" + rest.lstrip("/")
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def files(path: str) -> list[str]:
    """The files of a path: one file, a folder's visible files, or a pattern (in a remote folder, of its last part)."""
    where, inside = system(path)
    if isinstance(where, fs.LocalFileSystem):
        if os.path.isdir(inside):
            return sorted(f for f in glob.glob(f"{inside}/*") if os.path.isfile(f) and os.path.basename(f)[0] not in "._")
        found = sorted(glob.glob(inside))
    else:
        prefix = path[: len(path) - len(inside)] if path.endswith(inside) else path.split(":")[0] + "://"
        folder, _, last = inside.rstrip("/").rpartition("/")
        if where.get_file_info(inside).type == fs.FileType.Directory:
            folder, last = inside, "[!._]*"
        inner = where.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        found = sorted(prefix + f.path for f in inner if f.is_file and fnmatch.fnmatchcase(f.base_name, last))
    if not found:
        raise FileNotFoundError(path)
    return found


#: Records and bytes of sequence of an Arrow batch.
BATCH, BATCH_BYTES = 10_000, 8 << 20


class _FastqBatches:
    """Record batches of the FASTQ table, numbered from base."""

    NAMES = ["file", "record_index", "name", "description", "title", "sequence", "quality"]

    def __init__(self, path: str, base: int, name: str | None):
        self.path, self.at, self.name = path, base, name

    def put(self, titles: list[str], seqs: list[str], quals: list[str]) -> Iterator[pa.RecordBatch]:
        keys = list(map(records.key_of, titles))
        index = range(self.at, self.at + len(titles))
        self.at += len(titles)
        columns = [[self.path] * len(titles), list(index), [k for k, _ in keys], [d for _, d in keys], titles, seqs, quals]
        if self.name is not None:
            pick = [i for i, k in enumerate(columns[2]) if k == self.name]
            columns = [[c[i] for i in pick] for c in columns]
        if columns[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if n == "record_index" else pa.string()) for n, c in zip(self.NAMES, columns)], self.NAMES)


def _record_at(f, at: int, size: int) -> int:
    """The place of the first plain FASTQ record that starts at or after a byte, or the end of the file.

    It is looked for from the byte before, so the splits on both sides find the same place; more is read until it can be told.
    """
    if at <= 0 or at >= size:
        return max(0, min(at, size))
    f.seek(at - 1)
    data = f.read(1 << 16)
    while True:
        found = records.fastq_start(data, 1, at - 1 + len(data) >= size)
        if found is not None:
            return at - 1 + found
        data += f.read(max(1 << 20, len(data)))


def _span(f, start: int, end: int) -> Iterator[bytes]:
    """The bytes of a file from start to end, a piece at a time."""
    f.seek(start)
    while start < end and (piece := f.read(min(records.PIECE, end - start))):
        yield piece
        start += len(piece)


def plain_head(head: bytes) -> bool:
    """Whether a file that begins so may be cut into splits."""
    return head[:1] == b"@" and b"\r" not in head


def fastq_batches(path: str, start: int, end: int, name: str | None = None, strict: bool = True, label: str | None = None) -> Iterator[pa.RecordBatch]:
    """The record batches of a split of a FASTQ file, or of a whole one; label is the path that the records show."""
    where, inside = system(path)
    with where.open_input_file(inside) as f:
        size, base = f.size(), 0
        if start == 0 and end >= size:
            data = records.pieces(f)
        else:  # in a split the byte offset numbers the records: unique and in file order
            base, stop = _record_at(f, start, size), _record_at(f, end, size)
            data = _span(f, base, stop)
        batch = _FastqBatches(label or path, base, name)
        try:
            for table in records.fastq_tables(data, BATCH, base):
                yield from batch.put(*table)
        except records.FormatError:
            if strict:
                raise


class _Reader(DataSourceReader):
    def __init__(self, options: dict, fmt: str, schema: StructType | None = None):
        self.options, self.fmt, self.schema = dict(options), fmt, schema
        self.name = self.options.get("name")
        self.strict = self.options.get("mode", "failfast").lower() != "permissive"

    def pushFilters(self, filters):
        """Equality on the record's key is applied while parsing."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == (("id",) if self.fmt in flatfile.FORMATS else ("name",)):
                self.name = f.value
            yield f

    def partitions(self) -> list[Split]:
        out = []
        size = int(self.options.get("split_bytes", 64 << 20))
        for path in files(self.options["path"]):
            where, inside = system(path)
            with where.open_input_file(inside) as f:
                n, head = f.size(), f.read(1 << 16)
            plain = self.fmt == "fastq" and plain_head(head) and self.options.get("wrapped", "false") != "true"
            if plain and n > size:
                out += [Split(path, a, min(a + size, n)) for a in range(0, n, size)]
            else:
                out.append(Split(path, 0, n))
        return out or [Split("", 0, 0)]

    def read(self, part: Split) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        if self.fmt == "fastq":
            yield from fastq_batches(part.path, part.start, part.end, self.name, self.strict)
            return
        where, inside = system(part.path)
        with where.open_input_file(inside) as f:
            yield from self.batches(self.rows(part.path, f))

    def batches(self, rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        """Record batches of the rows that come before a bad record, bounded by number and by bytes of sequence."""
        kinds = to_arrow_schema(self.schema)
        at, held, size = self.schema.names.index("sequence"), [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*held), kinds)], self.schema.names)

        try:
            for r in rows:
                held.append(r)
                size += len(r[at])
                if len(held) == BATCH or size > BATCH_BYTES:
                    yield batch()
                    held, size = [], 0
        except records.FormatError:
            if self.strict:
                raise
        if held:
            yield batch()

    def rows(self, path: str, f) -> Iterator[tuple]:
        head = f.read(2)
        f.seek(0)
        if self.fmt == "fasta":
            if head == b"\x1f\x8b" and self.options.get("gzip", "refuse") != "allow":
                raise records.FormatError(f"{path}: gzip input is refused for FASTA; pass gzip=allow")
            for i, (title, seq) in enumerate(records.parse_fasta(records.pieces(f))):
                name, rest = records.key_of(title)
                if self.name is None or name == self.name:
                    yield path, i, name, rest, title, seq
        else:
            if head == b"\x1f\x8b":
                raise records.FormatError("gzip input is refused for flat files")
            want = frozenset(self.options.get("columns", "features,annotations").split(","))
            for i, r in enumerate(flatfile.parse(records.pieces(f), self.fmt, want)):
                if self.name is None or r["id"] == self.name:
                    yield path, i, r["id"], r["name"], r["description"], r["sequence"], r["features"], r["features_error"], r["annotations"], r["annotations_error"]


def _source(fmt: str, schema: str) -> type[DataSource]:
    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return fmt

        def schema(self) -> str:
            return schema

        def reader(self, schema):
            return _Reader(self.options, fmt, schema)

    Source.__name__ = f"{fmt.title()}Source"
    return Source


SOURCES = {f: _source(f, s) for f, s in (("fastq", FASTQ), ("fasta", FASTA), ("genbank", FLAT), ("embl", FLAT), ("swiss", FLAT))}


def register(spark: SparkSession) -> SparkSession:
    """Makes the formats known to spark.read.format."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for s in SOURCES.values():
        spark.dataSource.register(s)
    return spark


def read(spark: SparkSession, fmt: str, path: str, **options) -> DataFrame:
    return register(spark).read.format(fmt).options(**options).load(path)


def unique_keys(df: DataFrame, key: str = "name") -> DataFrame:
    """df, failing with the key that occurs twice in a file: what an index of records demands."""
    seen = df.groupBy("file", key).agg(F.count("*").alias("n"))
    bad = seen.where("n > 1").select(key).limit(1).collect()
    if bad:
        raise records.FormatError(f"Duplicate key '{bad[0][0]}'")
    return df


def fetch(df: DataFrame, name: str, key: str = "name") -> DataFrame:
    """One record by its key; an unknown key is a KeyError."""
    found = df.where(F.col(key) == name)
    if found.isEmpty():
        raise KeyError(name)
    return found


def slice_of(seq: str, start: int, end: int):
    """The half-open, 0-based slice of a sequence column, clamped to its ends."""
    if start < 0 or end < 0:
        raise ValueError("a slice counts from the start")
    return F.substring(seq, start + 1, max(0, end - start))


def grid(df: DataFrame) -> DataFrame:
    """Records as arrays of letters; ValueError if they are not all of one shape."""
    odd = df.agg(F.min(F.length("sequence")).alias("a"), F.max(F.length("sequence")).alias("b")).first()
    if odd.a != odd.b:
        first = df.where(F.length("sequence") != odd.b).select("name").first()
        raise ValueError(f"record {first.name if not isinstance(first, tuple) else first[0]} has another length than the rest")
    out = df.withColumn("bases", F.split("sequence", ""))
    return out.withColumn("qualities", F.transform(F.split("quality", ""), lambda c: F.ascii(c) - 33)) if "quality" in df.columns else out


def fasta_grid(df: DataFrame, width: int) -> DataFrame:
    """Rows (name, line, bases, length) of fixed width; only whole lines, a short last one included with its length."""
    pieces = F.posexplode(F.regexp_extract_all("sequence", F.lit(f".{{1,{width}}}"), F.lit(0))).alias("line", "bases")
    return df.select("name", pieces).withColumn("length", F.length("bases"))


def save_index(df: DataFrame, path: str) -> None:
    """Records kept as Parquet sorted by name, so a lookup skips row groups by their bounds."""
    df.sortWithinPartitions("name").write.mode("overwrite").option("parquet.bloom.filter.enabled#name", "true").parquet(path)
