"""Suffix arrays by two-stage sorting, and repeated windows from the common prefixes of neighbours."""

from __future__ import annotations

import numpy as np

#: UTF-8 never holds bytes above 0xF4, so every byte moves up by one and 0 is free to part the texts.
PART = b"\0"
SHIFT = bytes(min(b + 1, 255) for b in range(256))


def words_at(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as one big-endian integer; zeros follow the end."""
    padded = np.concatenate([data, np.zeros(7, np.uint8)])
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 8)).view(">u8").ravel().astype(np.uint64)


def smaller_than_successor(data: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the one that begins a byte later; the last is larger than the empty one."""
    step = np.append(np.sign(np.diff(data.astype(np.int16))), -1)
    place = np.where(step != 0, np.arange(len(step)), len(step))
    return step[np.minimum.accumulate(place[::-1])[::-1]] > 0


def suffix_array(data: bytes, depth: int) -> np.ndarray:
    """Places of all suffixes in order of their first ``depth`` bytes; beyond, the order is left open.

    Suffixes that are smaller than their successors are sorted directly. The others follow by one scan over the buckets
    of first bytes: a sorted suffix puts the one that begins a byte earlier next in the bucket of its first byte.
    """
    text = np.frombuffer(data, np.uint8)
    small = smaller_than_successor(text)
    direct = _sorted(data, np.flatnonzero(small), words_at(text), depth)
    first = text[direct]
    bounds = np.searchsorted(first, np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[text[-1]].append(np.array([len(text) - 1]))
    out = []

    def induce(places: np.ndarray) -> np.ndarray:
        """Hands on the larger suffixes one byte earlier; returns those of the same bucket."""
        before = places[places > 0] - 1
        before = before[~small[before]]
        byte = text[before]
        order = np.argsort(byte, kind="stable")
        before, byte = before[order], byte[order]
        cuts = np.flatnonzero(np.diff(byte)) + 1
        same = before[:0]
        for group in np.split(before, cuts) if len(before) else []:
            c = text[group[0]]
            if c == bucket:
                same = group
            else:
                waiting[c].append(group)
        return same

    for bucket in range(256):
        larger = np.concatenate(waiting[bucket]) if waiting[bucket] else np.zeros(0, np.int64)
        while len(larger):
            out.append(larger)
            larger = induce(larger)
        own = direct[bounds[bucket]:bounds[bucket + 1]]
        if len(own):
            out.append(own)
            induce(own)
    return np.concatenate(out)


def _sorted(data: bytes, places: np.ndarray, word: np.ndarray, depth: int) -> np.ndarray:
    """Direct sorting: by two words at once, and what these leave equal by the bytes that follow."""
    padded = np.append(word, np.zeros(8, np.uint64))
    a, b = word[places], padded[places + 8]
    order = np.lexsort((b, a))
    places, a, b = places[order], a[order], b[order]
    fresh = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(places) else np.zeros(0, bool)
    starts = np.flatnonzero(fresh)
    ends = np.append(starts[1:], len(places))
    for begin, end in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist()):
        tied = places[begin:end].tolist()
        tied.sort(key=lambda i: data[i + 16:i + depth])
        places[begin:end] = tied
    return places


def common_prefixes(word: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Lengths of the common prefixes of suffixes, up to ``most``."""
    out = np.zeros(len(a), np.int64)
    alive = np.arange(len(a))
    padded = np.append(word, np.zeros(most + 8, np.uint64))
    for at in range(0, most, 8):
        differ = padded[a[alive] + at] ^ padded[b[alive] + at]
        for shift in (56, 48, 40, 32, 24, 16, 8, 0):
            equal = (differ >> np.uint64(shift)) == 0
            out[alive] += equal
        alive = alive[differ == 0]
        if not len(alive):
            break
    return np.minimum(out, most)


def repeated_starts(strings: list[bytes], weights: list[int], window: int) -> list[tuple[int, int, int]]:
    """``string, first, last``: runs of starts of windows that occur twice or more, each string counted by its weight."""
    data = PART.join(s.translate(SHIFT) for s in strings) + PART
    sizes = np.array([len(s) for s in strings])
    begin = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    order = suffix_array(data, window)
    owner = np.repeat(np.arange(len(strings)), sizes + 1)
    whole = order[begin[owner[order]] + sizes[owner[order]] - order >= window]
    if not len(whole):
        return []
    prefixes = common_prefixes(words_at(np.frombuffer(data, np.uint8)), whole[:-1], whole[1:], window)
    group = np.concatenate([[0], np.cumsum(prefixes < window)])
    count = np.bincount(group, np.array(weights, np.float64)[owner[whole]])
    starts = np.sort(whole[count[group] >= 2])
    if not len(starts):
        return []
    fresh = np.concatenate([[True], (np.diff(starts) > 1) | (np.diff(owner[starts]) > 0)])
    first = starts[fresh]
    last = starts[np.append(np.flatnonzero(fresh)[1:] - 1, len(starts) - 1)]
    own = owner[first]
    return list(zip(own.tolist(), (first - begin[own]).tolist(), (last - begin[own]).tolist()))
