"""Elias-Fano sequences and an n-gram trie of such levels in one memory-mapped file."""

from __future__ import annotations

import mmap
import tempfile
from collections.abc import Iterable

import numpy as np


def pack_bits(values: np.ndarray, width: int) -> np.ndarray:
    """``width`` bits of each value, the lowest first, and 8 spare bytes."""
    if not width:
        return np.zeros(8, np.uint8)
    shifts = np.arange(width, dtype=np.uint64)
    blocks = [np.packbits(((values[i:i + 65536, None] >> shifts) & np.uint64(1)).astype(np.uint8), bitorder="little")
              for i in range(0, len(values), 65536)]  # 65536 values fill whole bytes
    return np.concatenate([*blocks, np.zeros(8, np.uint8)])


def unpack_bits(data: np.ndarray, places: np.ndarray, width: int) -> np.ndarray:
    """The values at some places of ``pack_bits``; up to 56 bits each."""
    if not width:
        return np.zeros(len(places), np.uint64)
    bit = places.astype(np.int64) * width
    byte = bit >> 3
    out = np.zeros(len(places), np.uint64)
    for k in range((width + 14) // 8):
        out |= data[byte + k].astype(np.uint64) << np.uint64(8 * k)
    return (out >> (bit & 7).astype(np.uint64)) & np.uint64((1 << width) - 1)


class EliasFano:
    """A monotone sequence: low bits packed, high parts as a bit vector with a one for each value and a zero for each
    bucket. ``arrays`` are all that is stored."""

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray):
        self.n, self.width, self.low, self.high = n, width, low, high
        self.zeros: np.ndarray | None = None

    @classmethod
    def of(cls, values: np.ndarray, universe: int) -> EliasFano:
        n = len(values)
        width = min(56, max(0, (universe // max(n, 1)).bit_length() - 1))
        values = values.astype(np.uint64)
        buckets = (universe >> width) + 1
        bits = np.zeros(n + buckets, np.uint8)
        bits[(values >> np.uint64(width)).astype(np.int64) + np.arange(n)] = 1
        return cls(n, width, pack_bits(values & np.uint64((1 << width) - 1), width), np.packbits(bits, bitorder="little"))

    def find(self, values: np.ndarray) -> np.ndarray:
        """The place of the first value not below each given one, by a search in its bucket; ``n`` if there is none."""
        if self.zeros is None:  # the select directory
            self.zeros = np.flatnonzero(np.unpackbits(self.high, bitorder="little") == 0)
        bucket = (values.astype(np.uint64) >> np.uint64(self.width)).astype(np.int64)
        low = values.astype(np.uint64) & np.uint64((1 << self.width) - 1)
        begin = np.where(bucket > 0, self.zeros[np.maximum(bucket - 1, 0)] - np.maximum(bucket - 1, 0), 0)
        end = np.minimum(self.zeros[bucket] - bucket, self.n)
        begin = np.minimum(begin, end)
        open_ = np.flatnonzero(begin < end)
        while len(open_):  # halves the buckets; most hold a value or two
            middle = (begin[open_] + end[open_]) // 2
            less = unpack_bits(self.low, middle, self.width) < low[open_]
            begin[open_[less]] = middle[less] + 1
            end[open_[~less]] = middle[~less]
            open_ = open_[begin[open_] < end[open_]]
        return begin

    def at(self, places: np.ndarray) -> np.ndarray:
        if self.zeros is None:
            self.zeros = np.flatnonzero(np.unpackbits(self.high, bitorder="little") == 0)
        # a place lies in the bucket after as many zeros as stand before its one
        bucket = np.searchsorted(self.zeros - np.arange(len(self.zeros)), places, "right")
        return bucket.astype(np.uint64) << np.uint64(self.width) | unpack_bits(self.low, places, self.width)


class Levels:
    """Named arrays in an unnamed temporary file, mapped into memory; the file is gone when this is."""

    def __init__(self, arrays: Iterable[tuple[str, np.ndarray]]):
        self.file = tempfile.TemporaryFile()
        places, at = {}, 0
        for name, array in arrays:
            raw = np.ascontiguousarray(array).tobytes()
            places[name] = (at, len(raw), array.dtype)
            self.file.write(raw)
            at += len(raw)
        self.file.write(b"\0")
        self.file.flush()
        self.map = mmap.mmap(self.file.fileno(), 0, access=mmap.ACCESS_READ)
        self.size = at
        self.arrays = {k: np.frombuffer(self.map, d, n // d.itemsize, a) for k, (a, n, d) in places.items()}


class Trie:
    """Words after contexts with a quantised probability each.

    Levels: the word fingerprints; for each context a monotone pointer to its first successor; the successors as ranks
    among the words, relative to their context, made monotone by the context's number; a byte per probability.
    """

    STEP = 0.03  # log10 of a probability per unit; 255 stands for words that were not seen

    def __init__(self, context: np.ndarray, word: np.ndarray, probability: np.ndarray, contexts: int):
        words = np.unique(word)
        rank = np.searchsorted(words, word)
        self.n_words, self.contexts, self.n = max(len(words), 1), contexts, len(word)
        pointers = np.searchsorted(context, np.arange(contexts + 1))
        quantised = np.clip(np.rint(-np.log10(probability) / self.STEP), 0, 254).astype(np.uint8)
        sequences = {
            "words": EliasFano.of(words, 1 << 40), "pointers": EliasFano.of(pointers, self.n + 1),
            "successors": EliasFano.of(context.astype(np.int64) * self.n_words + rank, contexts * self.n_words + 1)}
        parts = [(f"{k}.{p}", getattr(s, p)) for k, s in sequences.items() for p in ("low", "high")]
        self.levels = Levels([*parts, ("quantised", quantised)])
        held = self.levels.arrays
        self.words, self.pointers, self.successors = (
            EliasFano(s.n, s.width, held[f"{k}.low"], held[f"{k}.high"]) for k, s in sequences.items())
        self.quantised = held["quantised"]

    def find(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The quantised probability of each word after its context; 255 if it was not seen there."""
        out = np.full(len(word), 255, np.uint8)
        if not self.n:
            return out
        rank = self.words.find(word)
        known = np.flatnonzero(rank < self.words.n)
        known = known[self.words.at(rank[known]) == word[known]]
        begin, end = self.pointers.at(context[known]), self.pointers.at(context[known] + 1)
        known = known[begin < end]
        end = end[begin < end]
        wanted = context[known].astype(np.int64) * self.n_words + rank[known]
        place = self.successors.find(wanted)
        inside = place.astype(np.uint64) < end
        known, wanted, place = known[inside], wanted[inside], place[inside]
        hit = self.successors.at(place) == wanted.astype(np.uint64)
        out[known[hit]] = self.quantised[place[hit]]
        return out

    @classmethod
    def probability(cls, quantised: np.ndarray) -> np.ndarray:
        return np.where(quantised == 255, 0.0, 10.0 ** (-cls.STEP * quantised.astype(np.float64)))
