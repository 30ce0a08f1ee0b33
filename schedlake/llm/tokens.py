"""Token ids of texts by a byte-level BPE of the tokenizers library, one call per distinct chunk of text."""

from __future__ import annotations

import os
from array import array
from collections.abc import Callable
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

#: Characters outside these ranges may be classed differently by other versions of Unicode; such a text goes to the
#: library as a whole.
PLAIN = "\t\n\r\x20-\x7e¡-¬®-ɏ‐-―‘-„•…€"
#: Distinct chunks that a worker remembers; beyond, it starts anew. Longer ones are not remembered.
REMEMBERED, LONGEST = 800_000, 64
END = 0

SPACE = 0x20
WHITE = np.isin(np.arange(256), [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
LETTER = np.isin(np.arange(256), list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"))
MARK = ~LETTER & (np.arange(256) < 0x80)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and the places where each begins, and the last ends; null is empty."""
    texts = pc.fill_null(texts, "")
    _, places, data = texts.buffers()
    places = np.frombuffer(places, np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[places[0]:places[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, places - places[0]


def word_cuts(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Whether a chunk begins at each byte: at a text, at a space before anything but white space, and at an ASCII mark,
    digit or white space after an ASCII letter."""
    begin = np.zeros(len(data) + 1, bool)
    if len(data) > 1:
        spaced = (data[:-1] == SPACE) & ~WHITE[data[1:]]
        inner = places[1:-1]
        spaced[inner[(inner > 0) & (inner < len(data))] - 1] = False  # the next byte is another text's
        begin[:-2] |= spaced
        begin[1:-1] |= LETTER[data[:-1]] & MARK[data[1:]]
    begin[places] = True
    return begin


def whole_texts(begin: np.ndarray, places: np.ndarray, which: np.ndarray) -> None:
    """Takes the cuts out of some texts."""
    for i in which:
        begin[places[i] + 1:places[i + 1]] = False


def gathered(codes: np.ndarray, sizes: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The concatenated values of entries ``codes`` of a ragged table, and where each entry ends, from 0 on."""
    n = sizes[codes]
    ends = np.concatenate([[0], np.cumsum(n)])
    begin = np.cumsum(sizes) - sizes
    return values[np.repeat(begin[codes] - ends[:-1], n) + np.arange(ends[-1])], ends


class ChunkMemory:
    """Ids of distinct chunks, as ``learn`` gives them for those not met before."""

    def __init__(self, learn: Callable[[list[bytes]], list[bytes]], most: int):
        self.learn, self.most = learn, most
        self.known: dict[bytes, bytes] = {}

    def ids(self, chunks: list[bytes]) -> list[bytes]:
        out = list(map(self.known.get, chunks))
        places = [i for i, ids in enumerate(out) if ids is None]
        fresh = [chunks[i] for i in places]
        if len(self.known) + len(fresh) > self.most:
            self.known = {}
        for i, chunk, ids in zip(places, fresh, self.learn(fresh)):
            out[i] = ids
            if len(chunk) <= LONGEST:
                self.known[chunk] = ids
        return out

    def encode(self, data: np.ndarray, places: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and where each text's begin and the last ends."""
        cut = np.flatnonzero(begin[:-1])
        bounds = np.append(cut, len(data)).astype(np.int32)
        chunks = pa.Array.from_buffers(pa.binary(), len(cut), [None, pa.py_buffer(bounds), pa.py_buffer(data)]).dictionary_encode()
        found = self.ids(chunks.dictionary.to_pylist())
        sizes = np.array([len(x) // 4 for x in found], np.int64)
        ids, ends = gathered(chunks.indices.to_numpy(), sizes, np.frombuffer(b"".join(found), "<u4"))
        return ids, ends[np.searchsorted(cut, places)]


class Encoder:
    """Cuts texts into chunks whose ids, in order, are those of the text, and asks the library once for each distinct one.

    A space that something other than white space follows begins a piece whatever stands before it, and a run of letters
    ends one before any ASCII mark, so nothing is merged over a cut. ``literal`` reads the names of special tokens in a
    text as plain characters; otherwise, as the library does by default, they are single ids, and such texts go to it as
    a whole.
    """

    def __init__(self, path: str, literal: bool = True, remembered: int | None = None):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = literal
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if not (literal and t.special)]
        self.memory = ChunkMemory(self._learn, remembered or REMEMBERED)

    def _learn(self, chunks: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast([c.decode() for c in chunks], add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in found]

    def odd(self, texts: pa.Array) -> np.ndarray:
        """The numbers of the texts that must not be cut."""
        odd = pc.match_substring_regex(texts, f"[^{PLAIN}]")
        for name in self.added:
            odd = pc.or_(odd, pc.match_substring(texts, name))
        return np.flatnonzero(pc.fill_null(odd, False).to_numpy(zero_copy_only=False))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and where each text's begin and the last ends; null is empty."""
        data, places = text_bytes(texts)
        begin = word_cuts(data, places)
        whole_texts(begin, places, self.odd(texts))
        return self.memory.encode(data, places, begin)

    def encode_with_end(self, texts: pa.Array, end: int = END) -> tuple[np.ndarray, np.ndarray]:
        """As ``encode``, with an end id after each text."""
        ids, places = self.encode(texts)
        out = np.full(len(ids) + len(texts), end, np.uint32)
        mine = np.ones(len(out), bool)
        places = places + np.arange(len(places))
        mine[places[1:] - 1] = False
        out[mine] = ids
        return out, places


@cache
def encoder(path: str) -> Encoder:
    """One per Python worker, so that tasks share what it remembers; its ids are the library's own."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(path, literal=False)


def vocabulary_file(name: str = "byte_bpe_50k.json") -> str:
    """A public vocabulary's place; operators take others as a parameter, and then do without this package."""
    import public_tokenizers

    return public_tokenizers.path(name)
