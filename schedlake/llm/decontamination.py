"""Benchmark decontamination: one Aho-Corasick automaton over the word windows of all items, run once over each text."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from schedlake.llm.shared import lower_ascii, small_batches

WINDOW = 13
#: Bytes of windows in one broadcast automaton; a larger benchmark is scanned for in as many automata, one at a time.
BLOCK_BYTES = 24 << 20
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bytes of UTF-8 that separate words become spaces, A-Z become lower case, all others stay.
NORMAL = bytes(b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


class Hits(NamedTuple):
    n_words: int
    n_hit: int
    items: list
    spans: list[tuple[int, int]]  # code points of the original text, end exclusive


def item_windows(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """``pattern, items``: each distinct window and the sorted ids (as strings) of the items that hold it."""
    words = F.regexp_extract_all(lower_ascii(F.coalesce(F.col(text), F.lit(""))), F.lit(WORD), 0)
    rows = benchmark.where(F.col(item_id).isNotNull()).select(F.col(item_id).cast("string").alias("item"), words.alias("w"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (window - 1), F.lit(1)))
    return (rows.where(F.size("w") > 0)
            .select("item", F.explode(F.transform(starts, lambda i: F.array_join(F.slice("w", i, F.lit(window)), " "))).alias("pattern"))
            .distinct().groupBy("pattern").agg(F.sort_array(F.collect_list("item")).alias("items")))


def automaton(windows: Iterable[tuple[str, list[str]]]):
    """Over text in which each word has one space before and after it; bytes stand as code points 0-255."""
    out = ahocorasick.Automaton()
    for pattern, items in windows:
        key = f" {pattern} ".encode().decode("latin-1")
        out.add_word(key, (len(key), pattern.count(" ") + 1, items))
    if len(out):
        out.make_automaton()
    return out


def scan(text: str | None, machines: Iterable) -> Hits:
    raw = (text or "").encode("utf-8", "surrogatepass").translate(NORMAL)
    words = raw.split()
    if not words:
        return Hits(0, 0, [], [])
    plain = " " + b" ".join(words).decode("latin-1") + " "
    items: set[str] = set()
    found: list[tuple[int, int]] = []
    for machine in machines:
        if len(machine):
            for last, (size, n, ids) in machine.iter(plain):
                found.append((last - size + 1, n))
                items.update(ids)
    if not found:
        return Hits(len(words), 0, [], [])
    spaces = np.flatnonzero(np.frombuffer(plain.encode("latin-1"), np.uint8) == 32)
    begin = np.searchsorted(spaces, [b for b, _ in found])
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, begin, 1)
    np.add.at(edge, begin + np.array([n for _, n in found]), -1)
    hit = np.cumsum(edge[:-1]) > 0
    return Hits(len(words), int(hit.sum()), sorted(items), _spans(text, raw, hit))


def _spans(text: str, raw: bytes, hit: np.ndarray) -> list[tuple[int, int]]:
    """Runs of hit words as places in the original text."""
    letters = np.frombuffer(raw, np.uint8) != 32
    edges = np.flatnonzero(np.diff(np.concatenate([[False], letters, [False]]).astype(np.int8)))
    first, last = edges[::2], edges[1::2]
    runs = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
    original = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    point = np.concatenate([[0], np.cumsum((original & 0xC0) != 0x80)])  # code points before each byte
    return [(int(point[first[a]]), int(point[last[b - 1]])) for a, b in zip(runs[::2], runs[1::2])]


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id",
                  item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``row`` (the whole row of docs as a struct) and ``n_words, n_hit, items, spans``, one row per row of docs.

    ``items`` are the ids, as sorted strings, of all items of which a window occurs; ``spans`` are the runs of hit words
    in the original text. Null and empty texts have no words; items without words or without an id have no windows;
    items that repeat count once. Nothing is shuffled but the benchmark: documents stay where they are read.
    """
    windows = item_windows(benchmark, item_id, item_text, window)
    size = F.octet_length("pattern") + 64 + F.aggregate("items", F.lit(0), lambda a, i: a + F.octet_length(i) + 16)
    held = windows.agg(F.sum(size)).first()[0] or 0
    n = max(1, -(-held // block_bytes))
    context = docs.sparkSession.sparkContext
    blocks = []
    for k in range(n):
        block = windows if n == 1 else windows.where(F.pmod(F.xxhash64("pattern"), F.lit(n)) == k)
        blocks.append(context.broadcast([(r["pattern"], list(r["items"])) for r in block.toLocalIterator()]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only = automaton(blocks[0].value) if n == 1 else None
        for batch in small_batches(batches, "scanned"):
            texts = batch.column(1).to_pylist()
            hits = [scan(t, [only]) for t in texts] if only is not None else _merged(texts, blocks)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([h.n_words for h in hits], pa.int64()),
                pa.array([h.n_hit for h in hits], pa.int64()), pa.array([h.items for h in hits], pa.list_(pa.string())),
                pa.array([[{"start": a, "end": b} for a, b in h.spans] for h in hits],
                         pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                names=["row", "n_words", "n_hit", "items", "spans"])

    rows = docs.select(F.struct("*").alias("row"), F.col(text).alias("scanned"))
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType([rows.schema["row"], T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
                           T.StructField("items", T.ArrayType(T.StringType())), T.StructField("spans", T.ArrayType(span))])
    return rows.mapInArrow(run, schema)


def _merged(texts: list, blocks: list) -> list[Hits]:
    """Hits of several automata, one in memory at a time; spans are joined where they overlap or touch as words."""
    every: list[list[Hits]] = [[] for _ in texts]
    for block in blocks:
        machine = automaton(block.value)
        for own, text in zip(every, texts):
            own.append(scan(text, [machine]))
    out = []
    for own, text in zip(every, texts):
        if sum(bool(h.n_hit) for h in own) < 2:
            out.append(max(own, key=lambda h: h.n_hit))
            continue
        hit = np.zeros(own[0].n_words, bool)
        raw = text.encode("utf-8", "surrogatepass").translate(NORMAL)
        letters = np.frombuffer(raw, np.uint8) != 32
        first = np.flatnonzero(np.diff(np.concatenate([[False], letters]).astype(np.int8)) == 1)
        original = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        place = np.cumsum((original & 0xC0) != 0x80)[first] - 1
        for h in own:
            for a, b in h.spans:
                hit[np.searchsorted(place, a):np.searchsorted(place, b)] = True
        out.append(Hits(own[0].n_words, int(hit.sum()), sorted({i for h in own for i in h.items}), _spans(text, raw, hit)))
    return out


def contaminated(n_hit: str = "n_hit", n_words: str = "n_words"):
    """At least one word in twenty is hit."""
    return (F.col(n_hit) > 0) & (20 * F.col(n_hit) >= F.col(n_words))
