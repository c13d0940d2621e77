"""Sequence files as streams: whole files arrive as micro-batches, so no record is ever cut."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import readers

_SCHEMA = "file string, record_index long, name string, description string, title string, sequence string, quality string"


def stream_fastq(spark: SparkSession, folder: str, files_per_batch: int = 100, split_bytes: int = 16 << 20) -> DataFrame:
    """readStream of FASTQ files, plain or gzip, as they land in a folder.

    Only paths and sizes go through the stream; tasks read the files by splits of plain four-line records, others as a whole, a few
    megabytes at a time. In a file of several splits byte offsets number the records.
    """
    found = spark.readStream.format("binaryFile").option("maxFilesPerTrigger", files_per_batch).schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(split_bytes).cast("long")))
    splits = found.select("path", "length", starts.alias("start")).repartition("path", "start")

    def parse(batches) -> Iterator:
        for b in batches:
            for path, length, start in zip(*(b.column(k).to_pylist() for k in ("path", "length", "start"))):
                where, inside = readers.system(path)
                with where.open_input_file(inside) as f:
                    head = f.read(1 << 16)
                if length <= split_bytes or not readers.plain_head(head):
                    if start == 0:
                        yield from readers.fastq_batches(path, 0, length)
                else:
                    yield from readers.fastq_batches(path, start, min(start + split_bytes, length))

    return splits.mapInArrow(parse, _SCHEMA)
