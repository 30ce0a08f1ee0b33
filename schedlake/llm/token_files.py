"""Token ids as ORC: run-length encoded integers in stripes, with row indexes and a Bloom filter on document ids."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from schedlake.llm.shared import small_batches, written
from schedlake.llm.tokens import encoder, vocabulary_file

STRIPE_BYTES = 8 << 20
FILE_BYTES = 24 << 20
ROW_INDEX_STRIDE = 1000
MOST_FILES = 100_000
OPTIONS = {
    "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.create.index": "true",
    "orc.row.index.stride": str(ROW_INDEX_STRIDE), "compression": "zstd",
}


def encoded(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``doc_id, part, start, n_tokens, ids`` in the order of each partition's rows; ``start`` counts ids within the
    partition, whose number is ``part``."""
    vocabulary = vocabulary or vocabulary_file()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, base, part = encoder(vocabulary).encode_with_end, 0, TaskContext.get().partitionId()
        for batch in small_batches(batches, "text", 4 << 20):
            ids, places = encode(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.full(len(batch), part, np.int32)), pa.array(base + places[:-1], pa.int64()),
                 pa.array(np.diff(places), pa.int64()),
                 pa.ListArray.from_arrays(pa.array(places, pa.int32()), pa.array(ids.view(np.int32)))],
                names=["doc_id", "part", "start", "n_tokens", "ids"])
            base += int(places[-1])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, f"doc_id {kind}, part int, start long, n_tokens long, ids array<int>")


def write_tokens(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", files: int | None = None,
                 vocabulary: str | None = None, stripe_bytes: int = STRIPE_BYTES) -> None:
    """Writes all rows in ascending order of ``doc_id`` over numbered files; nulls come first.

    Texts are dealt out by ranges of (id, hash of the text) before they are encoded, so encoding runs once and in all
    tasks, and an id that repeats is no single task. Rows that repeat are written each. A null text is the end id alone.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    if files is None:
        held = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        files = max(1, -(-held // FILE_BYTES))
    tie = F.xxhash64("text")
    dealt = rows.repartitionByRange(int(files), "doc_id", tie).sortWithinPartitions("doc_id", tie)
    writer = encoded(dealt, vocabulary=vocabulary).write.format("orc")
    for key, value in (OPTIONS | {"orc.stripe.size": str(stripe_bytes)}).items():
        writer = writer.option(key, value)
    writer.save(path)


def read_tokens(spark: SparkSession, path: str, where: Column | None = None) -> DataFrame:
    """``doc_id, start, ids``; ``start`` counts the ids of all documents before it, over all files.

    Stripes are read by different tasks. ``where`` on ``doc_id`` reaches the file reader, which skips stripes and row
    groups by their statistics and Bloom filters. Totals of the files come from narrow columns; one row per file is
    gathered for the running total, in the order of the numbers that the rows carry, so that names do not matter. That
    table is sent to the readers, unless there are more files than ``MOST_FILES``.
    """
    files = spark.read.orc(path)
    last = files.groupBy("part").agg(F.max(F.col("start") + F.col("n_tokens")).alias("held"))
    base = written(last.select("part", F.expr("sum(held) OVER (ORDER BY part) - held").alias("base")), "file-totals")
    base = F.broadcast(base) if base.count() <= MOST_FILES else base
    rows = files.select("doc_id", "part", "start", "ids")
    rows = rows if where is None else rows.where(where)
    return rows.join(base, "part", "left").select("doc_id", (F.col("start") + F.col("base")).alias("start"), "ids")


def checksums(tokens: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of rows of token ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(2)
            ends = ids.offsets.to_numpy()
            raw = memoryview(ids.values.to_numpy(zero_copy_only=False).astype("<u4")).cast("B")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.diff(ends).astype(np.int64)),
                 pa.array([zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(ends[:-1], ends[1:])], pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"])

    kind = tokens.schema["doc_id"].dataType.simpleString()
    return tokens.select("doc_id", "start", "ids").mapInArrow(
        run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")
