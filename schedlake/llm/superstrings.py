"""Cuts texts into strings that can be compared apart: all windows of a length that hold the same least fingerprint."""

from __future__ import annotations

from functools import cache

import numpy as np

WINDOW = 200
#: Lengths of the fingerprinted substrings. Groups that are too large at one length are cut anew at the next; at the
#: last one a group holds equal windows only.
LENGTHS = (48, 120, 200)
#: Windows in one string; a text that repeats itself for long would else be a single one.
LONGEST = 4096
#: Bytes of text that are fingerprinted at once; longer texts are cut with an overlap of a window.
SPAN = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    value = np.random.default_rng(7).integers(1, 2 ** 63, 256, dtype=np.int64).astype(np.uint64)
    ones = np.ones(2 * SPAN + 1, np.uint64)
    power, inverse = ones * _BASE, ones * _INVERSE
    power[0] = inverse[0] = 1
    return value, np.multiply.accumulate(power), np.multiply.accumulate(inverse)


def fingerprints(data: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of each substring of ``length`` bytes."""
    value, power, inverse = _tables()
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(value[data] * power[:n], out=sums[1:])
    h = (sums[length:] - sums[:n - length + 1]) * inverse[:n - length + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def sliding_minimum(h: np.ndarray, width: int) -> np.ndarray:
    if width == 1:
        return h
    n = len(h) - width + 1
    full = -(-len(h) // width) * width
    padded = np.full(full, np.iinfo(np.uint64).max, np.uint64)
    padded[:len(h)] = h
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1:width - 1 + n])


def runs(texts: list[bytes], length: int = LENGTHS[0], window: int = WINDOW):
    """``text, key, first, last, times``: maximal runs of window starts of each text with the same least fingerprint.

    Every window of every text lies in exactly one run, and equal windows have equal keys. ``times`` counts the places
    of the key's substring within the run: a run with one place cannot repeat a window by itself. Texts that are shorter
    than a window have no runs.
    """
    out: list[tuple[np.ndarray, ...]] = []
    pending: list[tuple[int, int, bytes]] = []
    held = 0

    def flush() -> None:
        nonlocal pending, held
        if pending:
            out.append(_runs(pending, length, window))
        pending, held = [], 0

    for i, text in enumerate(texts):
        for at in range(0, max(len(text) - window + 1, 0), SPAN):
            part = text[at:at + SPAN + window - 1]
            if held + len(part) > 2 * SPAN:
                flush()
            pending.append((i, at, part))
            held += len(part)
    flush()
    if not out:
        return (np.zeros(0, np.int64),) * 5
    return tuple(np.concatenate(x) for x in zip(*out))


def _runs(parts: list[tuple[int, int, bytes]], length: int, window: int):
    data = np.frombuffer(b"".join(p for _, _, p in parts), np.uint8)
    width = window - length + 1
    prints = fingerprints(data, length)
    least = sliding_minimum(prints, width)
    sizes = np.array([len(p) for _, _, p in parts])
    starts = np.cumsum(sizes) - sizes
    ends = starts + sizes - window  # the last window of each part
    change = np.concatenate([[True], least[1:] != least[:-1]])
    change[starts] = True
    first = np.flatnonzero(change)
    part = np.searchsorted(starts, first, "right") - 1
    last = np.minimum(np.append(first[1:] - 1, len(least) - 1), ends[part])
    good = first <= last  # windows across two parts are none
    first, last, part = first[good], last[good], part[good]
    cuts = (last - first) // LONGEST
    if cuts.any():
        nth = np.arange(len(first) + cuts.sum()) - np.repeat(np.cumsum(cuts + 1) - cuts - 1, cuts + 1)
        first, last, part = (np.repeat(x, cuts + 1) for x in (first, last, part))
        first = first + nth * LONGEST
        last = np.minimum(last, first + LONGEST - 1)
    times = _times(prints, least, width, first, last)
    key = least[first].view(np.int64)
    offset = np.array([at for _, at, _ in parts]) - starts
    return np.array([i for i, _, _ in parts])[part], key, first + offset[part], last + offset[part], times


def _times(prints: np.ndarray, least: np.ndarray, width: int, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Places of each run's least fingerprint among the substrings of its windows."""
    # a place is the least of some window if it equals the greatest minimum of the windows that hold it
    padded = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
    chosen = np.flatnonzero(~sliding_minimum(~padded, width) == prints)
    keys, number = np.unique(prints[chosen], return_inverse=True)
    spot = np.sort(number.astype(np.int64) << 32 | chosen)
    own = np.searchsorted(keys, least[first]).astype(np.int64) << 32
    return np.searchsorted(spot, own | (last + width - 1), "right") - np.searchsorted(spot, own | first, "left")
