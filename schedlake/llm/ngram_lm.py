"""Scores texts with a bigram model whose counts are gathered from the whole corpus and kept in sharded tries.

Texts are cut into chunks. A chunk sends each of its distinct bigrams once, with its count in the training texts, to the
shard of the bigram's first word; there the counts of all chunks meet, become a trie, and answer the same bigrams. The
answers go back to the chunk in the order in which it asked, a byte for each bigram.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from schedlake.llm.elias_fano import Trie
from schedlake.llm.shared import ARROW_BYTES, setting, small_batches, written

#: Text of one chunk, and of the slices that it is gathered from.
CHUNK_BYTES, SLICE_BYTES = 5 << 20, 1 << 20
#: Distinct bigrams, summed over chunks, that one shard answers.
SHARD_BIGRAMS = 1_000_000
#: Bigrams that are looked up at a time.
LOOKUP = 1 << 18
#: Weight of the unigram model in each context, as a number of tokens.
PRIOR = 500.0
BEGIN, END = 0, 1  # numbers of the marks in each chunk; words follow
MARKS = np.array([0x8000000000000001, 0x8000000000000002], np.uint64)
WORD_BITS = np.uint64(24)  # a successor is told apart by the upper 40 bits of its fingerprint
BACKOFF_STEP = 0.0002
#: A context that takes this share of a chunk's bigrams is dealt out over several shards by its successors; so is one that
#: takes this share of a shard.
HOT_SHARE, HOT_PARTS, SHARD_SHARE = 0.002, 16, 0.25
#: Bytes after which Spark closes a batch for Python: a chunk then comes alone.
SENT_BYTES = 4 << 20


class Chunk(NamedTuple):
    words: np.ndarray  # fingerprint of each local word
    tokens: np.ndarray  # local words of all texts, an end mark after each
    sizes: np.ndarray  # tokens of each text
    train: np.ndarray  # whether each text counts


class Hot(NamedTuple):
    words: np.ndarray  # fingerprints of contexts that are dealt out, ascending
    parts: np.ndarray  # shards that each is dealt out over


class Dealt(NamedTuple):
    shards: np.ndarray  # the shards that get anything, ascending
    contexts: np.ndarray  # local contexts by shard, then number
    context_cuts: np.ndarray  # where each shard's contexts begin, and the end
    degrees: np.ndarray  # bigrams that each context's shard gets of it
    bigrams: np.ndarray  # bigrams by shard, then place among all
    bigram_cuts: np.ndarray


def chunks(docs: DataFrame) -> DataFrame:
    """Rows ``chunk, ids, train, sizes, words, tokens`` from ``doc_id, train, data``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, nth = TaskContext.get().partitionId() << 32, count()
        ids, train, streams, held = [], [], [], 0
        number: dict[bytes, int] = defaultdict(count(2).__next__)

        def flush() -> pa.RecordBatch:
            prints = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in number), np.uint64, len(number))
            return pa.RecordBatch.from_arrays([
                pa.array([base + next(nth)], pa.int64()), pa.array([pa.concat_arrays(ids).to_pylist()], pa.list_(ids[0].type)),
                pa.array([np.array(train, np.uint8).tobytes()]),
                pa.array([np.array([len(s) for s in streams], "<i4").tobytes()]),
                pa.array([np.concatenate([MARKS, prints]).tobytes()]), pa.array([np.concatenate(streams).tobytes()])],
                names=["chunk", "ids", "train", "sizes", "words", "tokens"])

        for batch in small_batches(batches, "data", SLICE_BYTES):
            ids.append(batch.column(0))
            train += batch.column(1).to_pylist()
            for text in batch.column(2).to_pylist():
                streams.append(np.array([*map(number.__getitem__, text.lower().split()), END], "<i4"))
                held += len(text)
            if held >= CHUNK_BYTES:
                yield flush()
                ids, train, streams, held = [], [], [], 0
                number = defaultdict(count(2).__next__)
        if streams:
            yield flush()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"chunk long, ids array<{kind}>, train binary, sizes binary, words binary, tokens binary")


def one_by_one(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows as dicts, one in memory at a time: a row is a whole chunk."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def chunk_of(row: dict) -> Chunk:
    return Chunk(np.frombuffer(row["words"], np.uint64), np.frombuffer(row["tokens"], "<i4"),
                 np.frombuffer(row["sizes"], "<i4"), np.frombuffer(row["train"], np.uint8).astype(bool))


def bigrams(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First word, second word and training count of each distinct bigram, and the bigram of each token."""
    before = np.concatenate([[BEGIN], chunk.tokens[:-1]])
    before[before == END] = BEGIN
    pair = before.astype(np.int64) * len(chunk.words) + chunk.tokens
    distinct, which = np.unique(pair, return_inverse=True)
    counted = np.repeat(chunk.train, chunk.sizes)
    times = np.bincount(which, counted, len(distinct)).astype(np.uint32)
    return distinct // len(chunk.words), distinct % len(chunk.words), times, which


def dealt(chunk: Chunk, first: np.ndarray, second: np.ndarray, shards: int, hot: Hot) -> Dealt:
    """Which shard gets which contexts and bigrams. A context that is dealt out goes to all of its shards."""
    home, n = (chunk.words % np.uint64(shards)).astype(np.int64), len(chunk.words)
    parts = np.ones(n, np.int64)
    if len(hot.words):
        place = np.minimum(np.searchsorted(hot.words, chunk.words), len(hot.words) - 1)
        parts = np.where(hot.words[place] == chunk.words, hot.parts[place], parts)
    shard = (home[first] + (chunk.words[second] >> WORD_BITS).astype(np.int64) % parts[first]) % shards
    order = np.argsort(shard, kind="stable")
    local = np.delete(np.arange(n), END)
    asked = np.repeat(local, parts[local])
    nth = np.arange(len(asked)) - np.repeat(np.cumsum(parts[local]) - parts[local], parts[local])
    asked = np.unique((home[asked] + nth) % shards * n + asked)
    given = shard[order] * n + first[order]
    degrees = (np.searchsorted(given, asked, "right") - np.searchsorted(given, asked)).astype(np.uint32)
    present, cuts = np.unique(asked // n, return_index=True)
    return Dealt(present, asked % n, np.append(cuts, len(asked)), degrees, order, np.append(np.searchsorted(given, present * n), len(order)))


def binaries(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Each stretch of the values between two cuts as one binary value."""
    size = values.nbytes // len(values) if len(values) else 1
    return pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [
        None, pa.py_buffer((cuts * size).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def joined(column: pa.ChunkedArray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The values that ``binaries`` cut, in a row, and where each binary value begins, and the end."""
    found, sizes = [np.zeros(0, kind)], [np.zeros(1, np.int64)]
    for part in column.cast(pa.large_binary()).chunks:
        if len(part):
            ends = np.frombuffer(part.buffers()[1], np.int64)[part.offset:part.offset + len(part) + 1]
            sizes.append(np.diff(ends) // np.dtype(kind).itemsize)
            if ends[-1] > ends[0]:
                found.append(np.frombuffer(part.buffers()[2], np.uint8)[ends[0]:ends[-1]].view(kind))
    return np.concatenate(found), np.cumsum(np.concatenate(sizes))


def questions(rows: DataFrame, shards: int, hot: Hot) -> DataFrame:
    """``shard, chunk, contexts, counts, degrees, successors, times``, one row per chunk and shard that has any."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in one_by_one(batches):
            chunk = chunk_of(row)
            first, second, times, which = bigrams(chunk)
            del which
            counts = np.bincount(first, times, len(chunk.words)).astype(np.uint32)  # a word is followed as often as it occurs
            to = dealt(chunk, first, second, shards, hot)
            successors = (chunk.words[second[to.bigrams]] >> WORD_BITS).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
            yield pa.RecordBatch.from_arrays(
                [pa.array(to.shards, pa.int32()), pa.array(np.full(len(to.shards), row["chunk"]), pa.int64()),
                 binaries(chunk.words[to.contexts], to.context_cuts), binaries(counts[to.contexts], to.context_cuts),
                 binaries(to.degrees, to.context_cuts), binaries(successors, to.bigram_cuts), binaries(times[to.bigrams], to.bigram_cuts)],
                names=["shard", "chunk", "contexts", "counts", "degrees", "successors", "times"])

    return rows.mapInArrow(run, "shard int, chunk long, contexts binary, counts binary, degrees binary, successors binary, times binary")


def _answer(shards: int):
    """Builds the trie of a shard from all chunks' counts and looks up every chunk's bigrams in it."""
    def run(table: pa.Table) -> pa.Table:
        contexts, context_cuts = joined(table["contexts"], "<u8")
        seen, cuts = joined(table["times"], "<u4")
        word = np.zeros((len(seen), 8), np.uint8)
        word[:, :5] = joined(table["successors"], "u1")[0].reshape(-1, 5)
        word = word.view("<u8").reshape(-1)
        known, number = np.unique(contexts, return_inverse=True)
        total = np.bincount(number, joined(table["counts"], "<u4")[0], len(known))
        owner = np.repeat(number, joined(table["degrees"], "<u4")[0])
        counted = np.flatnonzero(seen)
        order = counted[np.lexsort((word[counted], owner[counted]))]
        fresh = np.concatenate([[True], (np.diff(owner[order]) != 0) | (np.diff(word[order]) != 0)])[:len(order)]
        place = np.cumsum(fresh) - 1
        c = np.bincount(place, seen[order]) if len(order) else np.zeros(0)
        own, ends = owner[order][fresh], word[order][fresh]
        del contexts, seen, counted, order, place
        trie = Trie(own, ends, c / (total[own] + PRIOR), len(known))
        found = np.concatenate([np.zeros(0, np.uint8), *(
            trie.find(owner[i:i + LOOKUP], word[i:i + LOOKUP]) for i in range(0, len(word), LOOKUP))])
        backoff = np.rint(-np.log10(PRIOR / (total + PRIOR)) / BACKOFF_STEP).clip(0, 65535).astype("<u2")
        home = (known % np.uint64(shards)).astype(np.int64) == table["shard"][0].as_py()
        distinct = int(((total > 0) & home & (known != MARKS[BEGIN])).sum())
        return pa.Table.from_arrays(
            [table["chunk"], table["shard"], binaries(total[number].astype("<u8"), context_cuts), binaries(backoff[number], context_cuts),
             binaries(found, cuts), pa.array([distinct] * table.num_rows, pa.int64())],
            names=["chunk", "shard", "totals", "backoff", "found", "distinct"])

    return run


def _scores(shards: int, hot: Hot, train_tokens: int, train_texts: int, distinct: int, kind: pa.DataType):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        kinds = [kind, pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        if not left.num_rows:
            return pa.Table.from_arrays([pa.array([], k) for k in kinds], names=names)
        row = left.to_pylist()[0]
        chunk = chunk_of(row)
        first, second, _, which = bigrams(chunk)
        to = dealt(chunk, first, second, shards, hot)
        right = right.sort_by("shard")
        total, backoff = np.zeros(len(chunk.words)), np.zeros(len(chunk.words), np.uint16)
        found = np.zeros(len(first), np.uint8)
        total[to.contexts] = joined(right["totals"], "<u8")[0]
        backoff[to.contexts] = joined(right["backoff"], "<u2")[0]
        found[to.bigrams] = joined(right["found"], "u1")[0]
        total[END] = train_texts
        unigram = (total + 0.5) / (train_tokens + 0.5 * (distinct + 1))
        each = np.log10(Trie.probability(found) + 10.0 ** (-BACKOFF_STEP * backoff[first]) * unigram[second])
        starts = np.cumsum(chunk.sizes) - chunk.sizes
        n = len(chunk.sizes)
        base = np.add.reduceat(np.log10(unigram)[chunk.tokens], starts)
        known = np.add.reduceat((total[chunk.tokens] > 0).astype(np.int64), starts)
        return pa.Table.from_arrays(
            [pa.array(row["ids"], kind), pa.array(~chunk.train), pa.array(chunk.sizes, pa.int64()), pa.array(known),
             pa.array([train_tokens] * n, pa.int64()), pa.array(base), pa.array(np.add.reduceat(each[which], starts))], names=names)

    return run


def hot_contexts(rows: DataFrame, shards: int, all_tokens: int) -> Hot:
    """The contexts that take much of a chunk or of a shard; at most ``shards`` of them, the most frequent."""
    share = min(HOT_SHARE, SHARD_SHARE / shards)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in one_by_one(batches):
            words, tokens = np.frombuffer(row["words"], np.uint64), np.frombuffer(row["tokens"], "<i4")
            times = np.bincount(tokens, minlength=len(words))
            times[BEGIN], times[END] = times[END], 0
            much = np.flatnonzero(times > share * max(len(tokens), 1))
            yield pa.RecordBatch.from_arrays([pa.array(words[much].view(np.int64)), pa.array(times[much], pa.int64())],
                                             names=["word", "n"])

    found = rows.select("words", "tokens").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    top = found.orderBy(F.desc("n"), "word").limit(shards).collect()
    words, n = np.array([r["word"] for r in top], np.int64).view(np.uint64), np.array([r["n"] for r in top], np.int64)
    least = np.where(n > HOT_SHARE * all_tokens, HOT_PARTS, 2)
    parts = np.minimum(np.maximum(least, np.ceil(n / (SHARD_SHARE * SHARD_BIGRAMS)).astype(np.int64)), shards)
    order = np.argsort(words)
    return Hot(words[order], parts[order])


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", train=None) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``, one row per row of docs.

    ``train`` is a condition on docs; by default texts whose crc32 of the id is not 1 modulo 5 count. ``score`` is the
    sum of log10 ((c(v, w) + PRIOR p(w)) / (c(v) + PRIOR)) over tokens w after v, with the unigram model p of
    ``base_score``; a begin mark comes before the first token. Parts of it are kept quantised, see ``Trie.STEP`` and
    ``BACKOFF_STEP``. A null text is empty and is the end mark alone; a null id counts as an empty one; rows that repeat
    count each; without training texts all tokens are unknown; an empty table gives no rows.
    """
    if train is None:
        train = F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 != 1
    data = F.coalesce(F.col(text), F.lit("")).cast("binary")
    spark = docs.sparkSession
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(train, F.lit(True)).alias("train"), data.alias("data"))
    with setting(spark, ARROW_BYTES, str(SENT_BYTES)):
        rows = written(chunks(texts), "text-chunks")
        tokens = int(rows.agg(F.sum(F.length("tokens") / 4)).first()[0] or 0)
        shards = max(48, -(-tokens // SHARD_BIGRAMS))
        totals = _training(rows)
        hot = hot_contexts(rows, shards, tokens)
        answers = written(questions(rows.drop("ids"), shards, hot).groupBy("shard").applyInArrow(
            _answer(shards), "chunk long, shard int, totals binary, backoff binary, found binary, distinct long"), "answers")
    distinct = answers.groupBy("shard").agg(F.max("distinct").alias("n")).agg(F.sum("n")).first()[0] or 0
    kind = rows.schema["ids"].dataType.elementType
    scored = _scores(shards, hot, totals[0], totals[1], distinct + (totals[1] > 0), to_arrow_type(kind))
    schema = (f"doc_id {kind.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, "
              "base_score double, score double")
    return rows.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(scored, schema)


def _training(rows: DataFrame) -> tuple[int, int]:
    """Tokens and texts that count."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                train = np.frombuffer(row["train"], np.uint8).astype(bool)
                sizes = np.frombuffer(row["sizes"], "<i4")
                yield pa.RecordBatch.from_arrays([pa.array([int(sizes[train].sum())]), pa.array([int(train.sum())])], names=["a", "b"])

    out = rows.select("train", "sizes").mapInArrow(run, "a long, b long").agg(F.sum("a"), F.sum("b")).first()
    return out[0] or 0, out[1] or 0
