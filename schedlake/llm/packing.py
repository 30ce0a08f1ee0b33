"""Best-fit packing of token sequences: large pieces are matched in pairs, small ones fill the tightest gaps."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from schedlake.llm.shared import small_batches, written
from schedlake.llm.tokens import encoder, vocabulary_file

CAPACITY = 2048


def pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
           vocabulary: str | None = None) -> DataFrame:
    """``doc_id, piece, start, length, nth, ids``: documents as token ids, cut only where longer than ``capacity``.

    All pieces but the first of a cut document are full, so that one remainder per document is left to pack. ``ids``
    are little-endian unsigned 32-bit integers; ``nth`` counts the pieces of the same length within a partition.
    """
    vocabulary = vocabulary or vocabulary_file()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seen = encoder(vocabulary).encode_with_end, np.zeros(capacity + 1, np.int64)
        for batch in small_batches(batches, "text", 4 << 20):
            ids, places = encode(batch.column(1))
            tokens = np.diff(places)
            parts = -(-tokens // capacity)
            source = np.repeat(np.arange(len(tokens)), parts)
            piece = np.arange(len(source)) - np.repeat(np.cumsum(parts) - parts, parts)
            first = np.where(tokens % capacity == 0, np.minimum(tokens, capacity), tokens % capacity)[source]
            start = np.where(piece == 0, 0, first + (piece - 1) * capacity)
            length = np.where(piece == 0, first, capacity)
            order = np.argsort(length, kind="stable")
            lengths, begin, times = np.unique(length[order], return_index=True, return_counts=True)
            nth = np.empty(len(length), np.int64)
            nth[order] = np.arange(len(length)) - np.repeat(begin, times) + np.repeat(seen[lengths], times)
            seen[lengths] += times
            ends = pa.array(np.append(places[source] + start, places[-1]) * 4, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(source)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                 pa.array(length, pa.int64()), pa.array(nth),
                 pa.Array.from_buffers(pa.binary(), len(source), [None, ends.buffers()[1], pa.py_buffer(ids)])],
                names=["doc_id", "piece", "start", "length", "nth", "ids"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        cut, f"doc_id {kind}, piece int, start long, length long, nth long, ids binary")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Runs ``(length, first, bin, step, offset)``: from its rank ``first`` on, the pieces of a length go to bins
    ``bin``, ``bin + 1``, ... at ``offset``, or all to one after another in steps of ``step`` pieces a bin.

    Works on the number of pieces of each length, of which there are at most ``capacity``, whatever the number of
    pieces. Bins with the same gap are one group of consecutive numbers.
    """
    left = {n: c for n, c in counts.items() if c}
    used: dict[int, int] = dict.fromkeys(left, 0)
    runs: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> groups (first bin, bins)
    order: list[int] = []
    bins = 0

    def put(length: int, first_bin: int, n: int, offset: int, each: int = 1) -> None:
        runs.append((length, used[length], first_bin, each, offset))
        used[length] += n * each
        left[length] -= n * each

    def open_gap(gap: int, first_bin: int, n: int) -> None:
        if gap:
            if gap not in gaps:
                gaps[gap] = []
                insort(order, gap)
            gaps[gap].append((first_bin, n))

    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for length in large:  # the longest is matched with the longest that still fits beside it; no bin takes three
        while left[length]:
            partner = next((m for m in large if m <= capacity - length and left[m]), None)
            if partner is None:
                n = left[length]
                put(length, bins, n, 0)
                open_gap(capacity - length, bins, n)
            else:
                n = left[length] // 2 if partner == length else min(left[length], left[partner])
                if n == 0:  # one piece is left and would be its own partner
                    partner = next((m for m in large if m < length and m <= capacity - length and left[m]), None)
                    n = 1
                put(length, bins, n, 0)
                if partner is not None:
                    put(partner, bins, n, length)
                open_gap(capacity - length - (partner or 0), bins, n)
            bins += n
    for length in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[length]:
            i = bisect_left(order, length)
            if i < len(order):
                gap = order[i]
                first_bin, n = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap]
                    order.pop(i)
                take = min(n, left[length])
                put(length, first_bin, take, capacity - gap)
                open_gap(gap - length, first_bin, take)
                if take < n:
                    open_gap(gap, first_bin + take, n - take)
            else:
                each = capacity // length
                n = left[length] // each
                if n:
                    put(length, bins, n, 0, each)
                    open_gap(capacity - each * length, bins, n)
                    bins += n
                if rest := left[length]:
                    put(length, bins, 1, 0, rest)
                    open_gap(capacity - rest * length, bins, 1)
                    bins += 1
    return runs


def written_pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
                   vocabulary: str | None = None) -> DataFrame:
    """The pieces as a table; ``part`` and (``length``, ``nth``) tell each from all others."""
    return written(pieces(docs, doc_id, text, capacity, vocabulary).withColumn("part", F.spark_partition_id()), "pieces")


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, part, nth, sequence_id, offset``: a place for each written piece.

    A null text is empty and so holds only the end id; rows that repeat, or share an id, are packed each for itself.
    Sequences have no gap before their last piece; which of several pieces of one length goes where is left open. An
    empty table gives no rows. The ids themselves are not moved: ``sequences`` does that.
    """
    # the rank within a length has two levels, so that a length that a third of the pieces share is no single task
    by_part = cut.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    by_part = written(by_part, "lengths")
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    before = by_part.select("length", "part", F.coalesce(F.sum("n").over(
        W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    light = cut.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "part", "nth")
    ranked = light.join(before, ["length", "part"]).withColumn("rank", F.col("nth") + F.col("before"))
    return _placed(ranked, plan(counts, capacity))


def _placed(ranked: DataFrame, runs: list[tuple[int, int, int, int, int]]) -> DataFrame:
    """Looks up each piece's run by length and rank; the runs are bounded by the capacity, not by the pieces."""
    table: dict[int, np.ndarray] = {}
    for length in {r[0] for r in runs}:
        table[length] = np.array(sorted(r[1:] for r in runs if r[0] == length), np.int64)
    shared = ranked.sparkSession.sparkContext.broadcast(table)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = shared.value
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False)
                            for c in ("length", "rank"))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
                n = int(length[own[0]])
                run = lookup[n][np.searchsorted(lookup[n][:, 0], rank[own], "right") - 1]
                nth = rank[own] - run[:, 0]
                sequence[own] = run[:, 1] + nth // run[:, 2]
                offset[own] = run[:, 3] + nth % run[:, 2] * n
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(offset)],
                                             names=[*columns, "sequence_id", "offset"])

    kinds = dict(ranked.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in columns) + ", sequence_id long, offset long"
    return ranked.select(*columns, "rank").mapInArrow(place, schema)


def with_ids(cut: DataFrame, packed: DataFrame) -> DataFrame:
    """The placed pieces and their token ids."""
    return packed.join(cut.select("part", "length", "nth", "ids"), ["part", "length", "nth"])


def sequences(cut: DataFrame, packed: DataFrame) -> DataFrame:
    """``sequence_id, ids, doc_ids``: the token ids of each sequence in order, at most ``capacity`` of them a row."""
    rows = with_ids(cut, packed).groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("p"))
    return rows.select(
        "sequence_id", F.unhex(F.array_join(F.transform("p", lambda x: F.hex(x["ids"])), "")).alias("ids"),
        F.col("p.doc_id").alias("doc_ids"))
