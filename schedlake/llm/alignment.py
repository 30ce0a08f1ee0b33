"""Alignment of the token ids that two tokenizers give for the same texts."""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame, functions as F

from schedlake.llm.shared import ARROW_ROWS, setting, small_batches, written
from schedlake.llm.tokens import LETTER, MARK, SPACE, ChunkMemory, Encoder, gathered, text_bytes, vocabulary_file

PIECE_SPACE = "▁"
#: Distinct chunks of either side that a worker remembers, and id pairs that it counts before it hands them on.
REMEMBERED, PAIRS_HELD = 120_000, 1_000_000
#: Bytes of text that are aligned at once; each distinct window in them is aligned once.
BATCH_BYTES = 2 << 20
#: Links that are counted or looked up at once, and rows of links that Spark hands to Python at once.
LINKS_AT_ONCE, ROWS_AT_ONCE = 1 << 20, "500"
#: Distinct id pairs whose counts are sent to all tasks, at 16 bytes each; more are joined.
BROADCAST_PAIRS = 2_000_000
#: An id pair is one number: the first id times this, plus the second.
SECOND = 1 << 20


class PieceEncoder:
    """Ids of a BPE of the sentencepiece library, asked once for each distinct chunk of text.

    A chunk begins at a space after anything else, and at an ASCII mark after a letter. No piece of the vocabulary holds
    such a place in its middle, so nothing is merged over it; that is looked up in the vocabulary, and kinds of places
    that a piece does hold are not cut.
    """

    def __init__(self, path: str):
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(self.library.piece_size())
        plain = [self.library.id_to_piece(i) for i in ids if not (self.library.is_byte(i) or self.library.is_control(i) or self.library.is_unknown(i))]
        pieces = [np.frombuffer(p.replace(PIECE_SPACE, " ").encode(), np.uint8) for p in plain]
        self.at_space = not any((_spaces(p)).any() for p in pieces)
        self.at_mark = not any((LETTER[p[:-1]] & MARK[p[1:]] & (p[1:] != SPACE)).any() for p in pieces)
        self.memory = ChunkMemory(self._learn, REMEMBERED)
        self.before = self.library.encode("a")

    def _learn(self, chunks: list[bytes]) -> list[bytes]:
        """The library puts a space before any text but an empty one: chunks that begin with a space leave theirs out, and
        others, or a space alone, stand after a letter, whose ids are taken off."""
        texts = [c.decode() for c in chunks]
        led = [len(t) > 1 and t[0] == " " for t in texts]
        found = self.library.encode([t[1:] if own else "a" + t for t, own in zip(texts, led)], num_threads=1)
        return [array("I", ids if own else ids[len(self.before):]).tobytes() for own, ids in zip(led, found)]

    def cuts(self, data: np.ndarray, places: np.ndarray) -> np.ndarray:
        begin = np.zeros(len(data) + 1, bool)
        if len(data) > 1:
            if self.at_space:
                begin[1:-1] |= _spaces(data)
            if self.at_mark:
                begin[1:-1] |= LETTER[data[:-1]] & MARK[data[1:]] & (data[1:] != SPACE)
        begin[places] = True
        return begin

    def encode_spaced(self, data: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts given with the space that the library would put before each."""
        return self.memory.encode(data, places, self.cuts(data, places))


def _spaces(data: np.ndarray) -> np.ndarray:
    return (data[1:] == SPACE) & (data[:-1] != SPACE)


def byte_level_pieces(encoder: Encoder) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary, where printable bytes stand for themselves and the others, in
    order, for the characters from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    byte_of = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}
    vocabulary = encoder.tokenizer.get_vocab()
    out = [b""] * (max(vocabulary.values()) + 1)
    for piece, i in vocabulary.items():
        out[i] = bytes(byte_of[c] for c in piece) if all(c in byte_of for c in piece) else piece.encode()
    return out


def sentence_pieces(encoder: PieceEncoder) -> list[bytes]:
    library = encoder.library
    pieces = [library.id_to_piece(i) for i in range(library.piece_size())]
    return [bytes([int(p[1:-1], 16)]) if library.is_byte(i) else p.replace(PIECE_SPACE, " ").encode() for i, p in enumerate(pieces)]


class Side:
    """The bytes of a vocabulary's ids, as a ragged table."""

    def __init__(self, pieces: list[bytes]):
        self.sizes = np.array([len(p) for p in pieces], np.int64)
        self.flat = np.frombuffer(b"".join(pieces), np.uint8)
        self.spaced = np.array([p[:1] == b" " for p in pieces])

    def agree(self, ids: np.ndarray, at: np.ndarray, data: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Whether the ids of each text spell it."""
        spelt, ends = gathered(ids.astype(np.int64), self.sizes, self.flat)
        ends = ends[at]
        if len(spelt) == len(data) and (ends == places).all() and (spelt == data).all():
            return np.ones(len(at) - 1, bool)
        return np.array([np.array_equal(spelt[a:b], data[c:d]) for a, b, c, d in zip(ends, ends[1:], places, places[1:])], bool)


class Aligner:
    """Aligns the ids of two encoders for batches of texts."""

    def __init__(self, first: Encoder, second: PieceEncoder):
        self.first, self.second = first, second
        self.a, self.b = Side(byte_level_pieces(first)), Side(sentence_pieces(second))
        # ids as text, each with a comma after it and then with what ends its side of a group
        written_out = [f"{i}{end}".encode() for side, last in ((self.a, "|"), (self.b, ";")) for i in range(len(side.sizes)) for end in (",", last)]
        self.text_sizes = np.array([len(x) for x in written_out], np.int64)
        self.text = np.frombuffer(b"".join(written_out), np.uint8)

    def _aligned(self, windows: pa.BinaryArray) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """Of windows, which hold a count and so many ids of the first side, then those of the second: the groups as text,
        each with a semicolon after it, and the linked pairs, both as ragged tables with a row per window."""
        _, places, data = windows.buffers()
        at = np.frombuffer(places, np.int32)[windows.offset:windows.offset + len(windows) + 1] // 4
        ids = np.frombuffer(data, np.int32) if len(windows) else np.zeros(0, np.int32)
        n_a = ids[at[:-1]].astype(np.int64)
        n = np.diff(at) - 1
        place = np.arange(at[-1]) - np.repeat(at[:-1], n + 1)
        first = place <= np.repeat(n_a, n + 1)
        a, b = ids[first & (place > 0)], ids[~first]
        end_a, end_b = np.cumsum(self.a.sizes[a]), np.cumsum(self.b.sizes[b])
        ends = np.zeros((2, (end_a[-1] if len(a) else 0) + 1), bool)
        ends[0, end_a] = ends[1, end_b] = True
        last_a, last_b = ends[1, end_a], ends[0, end_b]
        # groups in order, in each the ids of the first side before those of the second
        till_a, till_b = np.append(0, np.flatnonzero(last_a) + 1), np.append(0, np.flatnonzero(last_b) + 1)
        codes = np.empty(len(a) + len(b), np.int64)
        codes[np.arange(len(a)) + till_b[np.cumsum(last_a) - last_a]] = 2 * a + last_a
        codes[np.arange(len(b)) + till_a[np.cumsum(last_b) - last_b + 1]] = 2 * (len(self.a.sizes) + b) + last_b
        text, text_ends = gathered(codes, self.text_sizes, self.text)
        of_window = np.append(0, np.cumsum(n))
        groups = np.append(0, np.cumsum(last_a))[np.append(0, np.cumsum(n_a))]
        pairs = a[last_a].astype(np.int64) * SECOND + b[last_b]
        return (np.diff(text_ends[of_window]), text), (np.diff(groups), pairs)

    def tokens(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The ids of both sides for all texts and where each text's begin; none where either side does not spell it."""
        empty = pc.or_(pc.is_null(texts), pc.equal(pc.fill_null(texts, ""), ""))
        spaced = pc.if_else(empty, "", pc.binary_join_element_wise("", pc.fill_null(texts, ""), " "))
        data, places = text_bytes(spaced)
        a, at_a = self.first.encode(spaced)
        b, at_b = self.second.encode_spaced(data, places)
        good = self.a.agree(a, at_a, data, places) & self.b.agree(b, at_b, data, places)
        if not good.all():
            a, b = a[np.repeat(good, np.diff(at_a))], b[np.repeat(good, np.diff(at_b))]
            at_a, at_b = (np.append(0, np.cumsum(np.diff(at) * good)) for at in (at_a, at_b))
        return a.astype(np.int32), at_a, b.astype(np.int32), at_b

    def align(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array, pa.Array]:
        """The number of ids on both sides, the groups as text and the linked pairs of each text."""
        a, at_a, b, at_b = self.tokens(texts)
        n_a, n_b = np.diff(at_a), np.diff(at_b)
        begin_a, begin_b = (np.append(0, np.cumsum(side.sizes[ids])) for side, ids in ((self.a, a), (self.b, b)))
        # windows begin at texts, and where tokens of both sides that are marked by a space begin together
        anchor = np.zeros(begin_a[-1] + 1, np.uint8)
        anchor[begin_a[:-1][self.a.spaced[a]]] |= 1
        anchor[begin_b[:-1][self.b.spaced[b]]] |= 2
        anchor[begin_a[at_a]] = 3
        first_a, first_b = np.flatnonzero(anchor[begin_a] == 3), np.flatnonzero(anchor[begin_b] == 3)
        windows = len(first_a) - 1
        size_a, size_b = np.diff(first_a), np.diff(first_b)
        at = np.arange(windows + 1) + first_a + first_b
        keys = np.empty(at[-1], np.int32)
        keys[at[:-1]] = size_a
        keys[np.arange(len(a)) + np.repeat(np.arange(windows) + 1 + first_b[:-1], size_a)] = a
        keys[np.arange(len(b)) + np.repeat(np.arange(windows) + 1 + first_a[1:], size_b)] = b
        coded = pa.Array.from_buffers(pa.binary(), windows, [None, pa.py_buffer((4 * at).astype(np.int32)), pa.py_buffer(keys)]).dictionary_encode()
        codes, of_text = coded.indices.to_numpy(), np.searchsorted(first_a, at_a)
        out = []
        for sizes, table in self._aligned(coded.dictionary):
            values, ends = gathered(codes, sizes, table)
            out += [values, ends[of_text]]
        text, text_at, pairs, pairs_at = out
        keep = np.ones(len(text), bool)
        keep[text_at[1:][n_a > 0] - 1] = False  # the last semicolon of each text
        text_at = text_at - np.append(0, np.cumsum(n_a > 0))
        groups = pa.Array.from_buffers(pa.string(), len(n_a), [None, pa.py_buffer(text_at.astype(np.int32)), pa.py_buffer(text[keep])])
        return n_a, n_b, groups, pa.ListArray.from_arrays(pa.array(pairs_at, pa.int32()), pa.array(pairs))


@cache
def aligner(first: str, second: str) -> Aligner:
    """One per Python worker, so that tasks share what it remembers."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Aligner(Encoder(first, literal=True, remembered=REMEMBERED), PieceEncoder(second))


def align(docs: DataFrame, text: str = "text", carry: tuple[str, ...] | None = None, first: str | None = None,
          second: str | None = None) -> DataFrame:
    """``row, n_a, n_b, n_groups, groups, links`` of every text: how the ids of a byte-level vocabulary (a) and a piece
    vocabulary (b) for a space and the text fall together.

    ``groups`` is cut wherever tokens of both sides end together, as ``a1,a2|b1;a3|b2,b3``; ``links`` holds a number for
    each pair of tokens that end together, ``a * SECOND + b``. Names of special tokens are plain text. A null or empty
    text, and one that the ids of a side do not spell, has no tokens: zeros, an empty string and an empty list. ``row``
    holds the columns ``carry``, or all; rows that repeat are each answered; an empty table gives no rows. No row is
    shuffled, and a task holds one batch of texts, or one long text, at a time.
    """
    first, second = first or vocabulary_file(), second or vocabulary_file("piece_bpe_32k.model")
    row = F.struct(*(carry if carry is not None else docs.columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(first, second)
        for batch in small_batches(batches, "text", BATCH_BYTES):
            n_a, n_b, groups, links = own.align(batch.column(1))
            n_groups = pc.list_value_length(links).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_a, pa.int64()), pa.array(n_b, pa.int64()), n_groups, groups, links],
                                             names=["row", "n_a", "n_b", "n_groups", "groups", "links"])

    kind = docs.select(row.alias("row")).schema["row"].dataType.simpleString()
    return docs.select(row.alias("row"), F.col(text).alias("text")).mapInArrow(
        run, f"row {kind}, n_a long, n_b long, n_groups long, groups string, links array<long>")


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows, with about ``LINKS_AT_ONCE`` links a batch; ``links`` is the last column."""
    for batch in batches:
        ends = np.cumsum(pc.list_value_length(batch.column(batch.num_columns - 1)).to_numpy(zero_copy_only=False))
        cuts = np.flatnonzero(np.diff(ends // LINKS_AT_ONCE, prepend=0))
        for a, b in zip([0, *cuts], [*cuts, len(batch)]):
            yield batch.slice(a, b - a)


def link_counts(aligned: DataFrame) -> DataFrame:
    """``pair, n, best`` over all rows of ``links``: how often each pair is linked, and whether no pair with the same
    second id is linked more often. Tasks add up what they hold before anything is shuffled."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in _slices(batches):
            fresh, times = np.unique(batch.column(0).flatten().to_numpy(), return_counts=True)
            pairs, place = np.unique(np.concatenate([pairs, fresh]), return_inverse=True)
            n = np.bincount(place, np.concatenate([n, times]), len(pairs)).astype(np.int64)
            if len(pairs) > PAIRS_HELD:
                yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n)], names=["pair", "n"])
                pairs, n = pairs[:0], n[:0]
        yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n)], names=["pair", "n"])

    held = aligned.select("links").mapInArrow(count, "pair long, n long")
    with setting(aligned.sparkSession, ARROW_ROWS, ROWS_AT_ONCE):
        counts = written(held.groupBy("pair").agg(F.sum("n").alias("n")), "pair-counts")
    most = counts.groupBy(F.pmod("pair", F.lit(SECOND)).alias("second")).agg(F.max("n").alias("most"))
    joined = counts.withColumn("second", F.pmod("pair", F.lit(SECOND))).join(most, "second")
    return written(joined.select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "pair-counts")


def with_counts(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """A written table of ``align`` with ``n_links, n_best, count_sum``: over its links, how many are of a best pair, and
    the sum of their pairs' counts.

    Up to ``BROADCAST_PAIRS`` pairs are sent to the tasks. Beyond, each row's distinct pairs are joined: the few pairs
    that hold a ten-thousandth of all links or more are broadcast, the others are shuffled.
    """
    others = [c for c in aligned.columns if c != "links"]
    if counts.count() > BROADCAST_PAIRS:
        return _joined(aligned, counts, others)
    table = counts.toArrow().sort_by("pair")
    shared = aligned.sparkSession.sparkContext.broadcast(tuple(table.column(c).to_numpy() for c in ("pair", "n", "best")))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n, best = shared.value
        for batch in _slices(batches):
            links = batch.column(len(others))
            ends = np.append(0, np.cumsum(pc.list_value_length(links).to_numpy()))
            place = np.searchsorted(pairs, links.flatten().to_numpy())
            sums = (np.append(0, np.cumsum(x[place], dtype=np.int64)) for x in (best, n))
            columns = [pa.array(np.diff(ends), pa.int64()), *(pa.array(np.diff(s[ends])) for s in sums)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], names=[*others, "n_links", "n_best", "count_sum"])

    kinds = {f.name: f.dataType.simpleString() for f in aligned.schema}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in others) + ", n_links long, n_best long, count_sum long"
    with setting(aligned.sparkSession, ARROW_ROWS, ROWS_AT_ONCE):
        return written(aligned.select(*others, "links").mapInArrow(look_up, schema), "alignment-counts")


def _joined(aligned: DataFrame, counts: DataFrame, others: list[str]) -> DataFrame:
    row = F.struct(F.col("_metadata.file_name"), F.col("_metadata.row_index")).alias("__row")
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = counts.where(F.col("n") * 10_000 >= total)
    each = aligned.select(row, F.explode("links").alias("pair")).groupBy("__row", "pair").agg(F.count(F.lit(1)).alias("times"))
    known = each.join(F.broadcast(hot), "pair").unionByName(each.join(F.broadcast(hot.select("pair")), "pair", "left_anti").join(
        counts.where(F.col("n") * 10_000 < total), "pair"))
    sums = known.groupBy("__row").agg(F.sum("times").alias("n_links"), F.sum(F.when(F.col("best"), F.col("times"))).alias("n_best"),
                                      F.sum(F.col("n") * F.col("times")).alias("count_sum"))
    return aligned.select(row, *others).join(sums, "__row", "left").select(
        *others, *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_links", "n_best", "count_sum")))
