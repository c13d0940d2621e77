"""Shared pieces of the training-data operators.

Everything here is bounded in memory: texts are hashed in chunks of about a megabyte, lineage is cut by
tables written to the folder that ``spark.checkpoint.dir`` names, and small sides are broadcast only after
their row count has been checked.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest side (bytes) that a checked broadcast may send to every executor.
BROADCAST_BYTES = 32 << 20
#: Rows and bytes of an Arrow batch of texts: bound what a Python worker holds when texts are long.
TEXT_ROWS, TEXT_BYTES = 500, 2 << 20
#: Text bytes that are hashed at once.
CHUNK = 1 << 18

_LOCAL: list[str] = []


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only where none is configured and all runs in one process (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="helixframe-"))
        atexit.register(shutil.rmtree, _LOCAL[0], True)
    return f"file://{_LOCAL[0]}"


def cut(spark: SparkSession, df: DataFrame, name: str = "t") -> DataFrame:
    """Writes df to the shared folder and reads it again: a lineage cut that outlives lost executors."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Deletes what cut() wrote, once nothing reads it any more."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def small(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """df, marked for broadcast if rows * row_bytes is within BROADCAST_BYTES; else the join shuffles."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def text_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches of whole texts by rows and bytes; a batch of very long texts stays within memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(TEXT_BYTES))


def bucket_of(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo: the fold of a document."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string").cast("binary")) % F.lit(modulus)


def spread(spark: SparkSession, df: DataFrame, per: int = 16 << 20) -> int:
    """A number of shuffle buckets that grows with the input: bytes of df's files over `per`, 16 at least."""
    size = 0
    for f in df.inputFiles():
        p = spark._jvm.org.apache.hadoop.fs.Path(f)
        size += p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).getLen()
    return max(16, -(-size // per))


# ---------------------------------------------------------------- words and hashes (executed on workers)

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_IP = np.uint64(pow(int(_P), -1, 1 << 64))
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (splitmix)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _tables() -> tuple[np.ndarray, np.ndarray]:
    low = np.arange(256, dtype=np.uint64)
    low[65:91] += np.uint64(32)
    space = np.zeros(256, bool)
    space[[0x20, *range(9, 14)]] = True
    return mix(low + np.uint64(0xD1B54A32D192ED03)), space


LETTER, SPACE = _tables()
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get("p")
    if have is None or len(have) < n + 1:
        size = max(n + 1, CHUNK + 1)
        p = np.full(size, _P, np.uint64)
        q = np.full(size, _IP, np.uint64)
        p[0] = q[0] = 1
        _POWERS["p"], _POWERS["q"] = np.multiply.accumulate(p), np.multiply.accumulate(q)
    return _POWERS["p"], _POWERS["q"]


def arrow_texts(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string column; null counts as empty."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf, offsets


def chunks(offsets: np.ndarray, most: int = CHUNK):
    """Ranges [i, j) of texts of about `most` bytes; a longer text makes a range alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_hashes(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of the texts: (hash, start, end, first word of each text and the total).

    Words are runs without ASCII white space. A polynomial over the bytes, read off prefix sums modulo 2**64,
    costs a few passes over the bytes and no loop over words.
    """
    base, stop = int(offsets[0]), int(offsets[-1])
    b = buf[base:stop]
    n = len(b)
    off = offsets - base
    if n == 0:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, np.zeros(len(off), np.int64)
    gap = SPACE[b]
    first = np.empty(n, bool)
    first[0] = True
    first[1:] = gap[:-1]
    edge = off[:-1][off[:-1] < n]
    first[edge] = True
    last = np.empty(n, bool)
    last[-1] = True
    last[:-1] = gap[1:]
    last[off[1:][off[1:] > 0] - 1] = True
    word = ~gap
    s = np.flatnonzero(first & word)
    e = np.flatnonzero(last & word) + 1
    p, q = _powers(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(LETTER[b] * p[:n], out=total[1:])
    h = (total[e] - total[s]) * q[s]
    h = mix(h + (e - s).astype(np.uint64) * _M2)
    return h, s + base, e + base, np.searchsorted(s, off)


def union_find(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (smallest index) of the components of n nodes under edges a-b."""
    label = np.arange(n)
    if len(a) == 0:
        return label
    while True:
        m = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, m)
        np.minimum.at(new, b, m)
        np.minimum.at(new, label[a], m)
        np.minimum.at(new, label[b], m)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def runs(batches, key: str):
    """Tables of one key each from Arrow batches that are sorted by key; a key may span batches."""
    import pyarrow as pa

    held = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        k = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(k[1:] != k[:-1]) + 1
        edges = [0, *cuts.tolist(), len(k)]
        for i, j in zip(edges, edges[1:]):
            part = batch.slice(i, j - i)
            if held and held[0].column(key)[0].as_py() != k[i]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)
