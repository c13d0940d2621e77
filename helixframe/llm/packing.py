"""Packing: concatenate and cut.

Pass 1 tokenizes each text once, keeps the ids (two bytes each, four where a document holds one above 65,535) in a table of the shared folder together with the
document's place inside its partition, and so the token total of every partition. The prefix sums of those
totals (one number per partition) give each document a global offset. Pass 2 cuts the stream at multiples of the window:
a document gets one record per window it touches, the first and last being boundary records. Nothing is shuffled.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, text_batches

_ENCODERS: dict = {}


def encoder(json_path: str | None = None, ranks_path: str | None = None):
    """text -> ids of the byte-level BPE; a faster reader of the same vocabulary does all but special strings."""
    import public_tokenizers

    json_path = json_path or public_tokenizers.path("byte_bpe_50k.json")
    ranks_path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    key = (json_path, ranks_path)
    if key not in _ENCODERS:
        import base64

        import tiktoken
        from tokenizers import Tokenizer

        slow = Tokenizer.from_file(json_path)
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        fast = tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

        def encode(text: str) -> list[int]:
            if "<|" in text:
                return slow.encode(text, add_special_tokens=False).ids
            return fast.encode_ordinary(text)

        _ENCODERS[key] = encode
    return _ENCODERS[key]


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(spark: SparkSession, docs: DataFrame, window: int = 1024, end_id: int = 0, with_ids: bool = False, json_path: str | None = None, ranks_path: str | None = None) -> DataFrame:
    """Pieces of documents in sequences of at most `window` tokens, all full but the last.

    One row per piece: doc_id, start (ids of the document before it), length, ids_crc32 (of little-endian unsigned
    32-bit ids), doc_tokens (with the end id), sequence_id, offset (in the sequence, gapless from 0), and with
    `with_ids` the ids. A null or empty text is the end id alone. Null and repeated doc_ids are packed as rows of
    their own; an empty table gives no rows; other columns are ignored.
    """
    text_batches(spark)

    def tokenize(batches):
        import pyarrow as pa

        encode = encoder(json_path, ranks_path)
        part = TaskContext.get().partitionId()
        at = 0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            blobs, counts = [], []
            for text in batch.column("text").to_pylist():
                ids = encode(text) if text else []
                ids.append(end_id)
                counts.append(len(ids))
                ids = np.array(ids, np.uint32)
                blobs.append((ids.astype(np.uint16) if ids.max() < 1 << 16 else ids).tobytes())
            n = np.array(counts, np.int64)
            begin = at + np.cumsum(n) - n
            at += int(n.sum())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.full(len(n), part, np.int32)), pa.array(begin), pa.array(n), pa.array(blobs, pa.binary())], ["doc_id", "part", "begin", "n", "ids"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    table = cut(spark, source.mapInArrow(tokenize, "doc_id long, part int, begin long, n long, ids binary"), "ids")
    totals = dict(table.groupBy("part").agg(F.sum("n").alias("n")).collect())  # one number per partition, not per document
    parts = np.array(sorted(totals), np.int64)
    sums = np.array([totals[p] for p in parts], np.int64)
    offsets = np.zeros(int(parts.max(initial=-1)) + 1, np.int64)
    offsets[parts] = np.cumsum(sums) - sums
    offsets = spark.sparkContext.broadcast(offsets)

    def slices(batches):
        import pyarrow as pa

        base = offsets.value
        for batch in batches:
            if batch.num_rows == 0:
                continue
            n = batch.column("n").to_numpy()
            g = base[batch.column("part").to_numpy()] + batch.column("begin").to_numpy()
            pieces = (g + n - 1) // window - g // window + 1
            row = np.repeat(np.arange(len(n)), pieces)
            k = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            seq = g[row] // window + k
            lo = np.maximum(g[row], seq * window)
            hi = np.minimum(g[row] + n[row], (seq + 1) * window)
            start, length = lo - g[row], hi - lo
            raw = batch.column("ids")
            crc, ids = np.empty(len(row), np.int64), []
            last = -1
            for i, (r, s, m) in enumerate(zip(row.tolist(), start.tolist(), length.tolist())):
                if r != last:
                    blob = raw[r].as_buffer()
                    doc = np.frombuffer(blob, "<u2" if blob.size == 2 * n[r] else "<u4").astype("<u4")
                    last = r
                crc[i] = zlib.crc32(doc[s : s + m].tobytes())
                if with_ids:
                    ids.append(doc[s : s + m].astype(np.int32))
            cols = [batch.column("doc_id").take(pa.array(row)), *map(pa.array, (start, length, crc, n[row], seq, lo - seq * window))]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                cols.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names)

    return table.mapInArrow(slices, PIECES + (", ids array<int>" if with_ids else ""))
