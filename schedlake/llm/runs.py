"""Periodic runs of words, found by Lyndon roots from the grouping phase of a suffix sorter."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from schedlake.llm.shared import small_batches
from schedlake.llm.tokens import SPACE, WHITE, text_bytes

#: A run has at least so many words and so many periods.
LEAST, PERIODS = 6, 4
RUNS = "array<struct<start: long, length: long, period: long>>"
CUT = -1


def word_ids(data: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Of texts as bytes: the texts with single spaces between words, each word followed by one space; where each text's
    begin and the last end there; where each word begins there, and its number in the dictionary that comes last.

    One text's words may touch another's, so a space is put after each text first.
    """
    n = len(places) - 1
    spaced = np.full(len(data) + n, SPACE, np.uint8)
    mine = np.ones(len(spaced), bool)
    places = places + np.arange(n + 1)
    mine[places[1:] - 1] = False
    spaced[mine] = data
    white = WHITE[spaced]
    keep = ~white
    keep[1:] |= ~white[:-1]
    joined = np.where(white, SPACE, spaced)[keep]
    places = np.concatenate([[0], np.cumsum(keep)])[places]
    ends = np.flatnonzero(joined == SPACE)
    bounds = np.append(0, ends + 1)
    words = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(joined)])
    coded = words.dictionary_encode()
    return joined, places, bounds, coded.indices.to_numpy().astype(np.int64), coded.dictionary


def window_size(least: int = LEAST, periods: int = PERIODS) -> int:
    """Words that any run has at least besides a period: a window of so many at its start occurs again a period later."""
    return min(max(least, periods * q) - q for q in range(1, least + 1))


def repeated_stretches(words: np.ndarray, text: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the longest stretches of words whose windows of ``size`` words occur twice in their text.

    Any run is covered by such windows, and so would be each word that extends it: the runs of a text are those of its
    stretches.
    """
    n = len(words) - size + 1
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key = text[:n].astype(np.uint64)
    for k in range(size):  # equal windows have equal keys; windows whose keys are equal by chance only add words
        key = (key ^ words[k:k + n].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    whole = text[:n] == text[size - 1:]
    twice = np.zeros(len(words) + 1, bool)
    twice[:n][whole] = pd.Series(key[whole]).duplicated(keep=False).to_numpy()
    seen = np.cumsum(twice[:-1])
    seen[size:] -= seen[:-size].copy()
    covered = np.concatenate([[False], seen > 0, [False]])
    other = np.concatenate([[True], text[1:] != text[:-1], [True]])
    begin = np.flatnonzero(covered[1:] & (~covered[:-1] | other))
    end = np.flatnonzero(covered[:-1] & (~covered[1:] | other))
    return begin, end


def lyndon_words(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The length of the longest Lyndon word at each place, and a number that only equal words share, for sequences that
    stand between places of ``CUT``.

    This is the first phase of a suffix sorter: suffixes are grouped by the Lyndon word they begin with. Groups are taken
    from the highest on; the places of those still to come are linked in text order, so that the word at a place ends
    where its right neighbour begins, and a group is final once it is taken. The place before its members takes their
    words over and moves to a new group just above its old one, the higher the more of them it takes.
    """
    n = len(words)
    names, group = np.unique(words, return_inverse=True)
    order = np.argsort(group, kind="stable")
    members = [m.tolist() for m in np.split(order, np.cumsum(np.bincount(group))[:-1])]
    above, below = list(range(1, len(names) + 1)), list(range(-1, len(names) - 1))
    group, left, right, length = group.tolist(), list(range(-1, n - 1)), list(range(1, n + 1)), [0] * n
    taken = len(names) - 1
    while taken > 0:  # group 0 holds the cuts
        before: dict[int, int] = {}
        for i in members[taken]:
            if group[i] == taken:
                j, r = left[i], right[i]
                length[i] = r - i
                right[j], left[r] = r, j
                before[j] = before.get(j, 0) + 1
        members[taken] = []
        moved: dict[tuple[int, int], list[int]] = {}
        for j, times in before.items():
            if group[j]:
                moved.setdefault((times, group[j]), []).append(j)
        for times, old in sorted(moved, reverse=True):
            new, own = len(members), moved[times, old]
            for j in own:
                group[j] = new
            members.append(own)
            below.append(old)
            above.append(above[old])
            below[above[old]] = new
            above[old] = new
        taken = below[taken]
    return np.array(length, np.int64), np.array(group, np.int64)


def extension(words: np.ndarray, i: int, j: int, step: int) -> int:
    """How many words are equal from ``i`` and ``j`` on, forwards or backwards; a cut ends them."""
    size, found = 16, 0
    while True:
        a, b = ((words[x:x + size] if step > 0 else words[max(x - size + 1, 0):x + 1][::-1]) for x in (i, j))
        n = min(len(a), len(b))
        unequal = np.flatnonzero(a[:n] != b[:n])
        if not n or len(unequal):
            return found + int(unequal[0]) if n else found
        found, i, j, size = found + n, i + n * step, j + n * step, size * 2


def find_runs(words: np.ndarray, least: int = LEAST, periods: int = PERIODS) -> np.ndarray:
    """``start, length, period`` of all runs of sequences that begin and end with ``CUT`` and stand between its places.

    A run is a longest stretch with a smallest period, of at least ``least`` words and ``periods`` periods. By one of two
    orders of the words, the one or the other way round, its period is a Lyndon word, and the longest at each place where
    it begins in the run. So the first of ``periods - 1`` such words in a row is extended both ways by common words.
    """
    found = set()
    for ordered in (words, np.where(words == CUT, CUT, words.max(initial=0) - words)):
        length, group = lyndon_words(ordered)
        at = np.flatnonzero(length)
        q = length[at]
        row = group[at - np.minimum(q, at)] != group[at]
        for k in range(1, periods - 1):
            row &= group[np.minimum(at + k * q, len(words) - 1)] == group[at]
        for i, p in zip(at[row].tolist(), q[row].tolist()):
            start = i - extension(words, i - 1, i + p - 1, -1)
            size = i + p + extension(words, i, i + p, 1) - start
            if size >= max(least, periods * p):
                found.add((start, size, p))
    return np.array(sorted(found), np.int64).reshape(-1, 3)


def _in_texts(words: np.ndarray, text: np.ndarray, least: int, periods: int) -> np.ndarray:
    """``start, length, period`` of the runs of many texts, by start, then period; starts count words of all texts."""
    begin, end = repeated_stretches(words, text, window_size(least, periods))
    long = end - begin >= least
    begin, end = begin[long], end[long]
    if not len(begin):
        return np.zeros((0, 3), np.int64)
    size = end - begin + 1  # each stretch and a cut after it
    first = np.cumsum(size) - size
    place = np.repeat(begin - first, size) + np.arange(size.sum())
    joined = words[np.minimum(place, len(words) - 1)]
    joined[first + size - 1] = CUT
    runs = find_runs(np.concatenate([[CUT], joined]), least, periods)
    runs[:, 0] = place[runs[:, 0] - 1]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def collapse(docs: DataFrame, text: str = "text", carry: tuple[str, ...] | None = None, least: int = LEAST,
             periods: int = PERIODS) -> DataFrame:
    """``row, n_words, runs, collapsed`` for every row: its runs of words by start, then period, and its text without the
    words that repeat them.

    Words are runs of anything but ASCII white space. A word is dropped where a run holds it after the run's first period;
    the others are joined by single spaces. ``row`` holds the columns ``carry``, or all. Texts are independent of each
    other: a null or empty text has no words, no runs and an empty result; rows that repeat are each answered; an empty
    table gives no rows. No row is shuffled, and a task holds one batch of texts, or one long text, at a time.
    """
    carry = tuple(carry if carry is not None else docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", 8 << 20):
            joined, places, bounds, words, _ = word_ids(*text_bytes(batch.column(1)))
            first = np.searchsorted(bounds, places)
            n = np.diff(first)
            owner = np.repeat(np.arange(len(n)), n)
            runs = _in_texts(words, owner, least, periods)
            source = owner[runs[:, 0]] if len(runs) else np.zeros(0, np.int64)
            step = np.zeros(len(words) + 1, np.int64)
            np.add.at(step, runs[:, 0] + runs[:, 2], 1)
            np.add.at(step, runs[:, 0] + runs[:, 1], -1)
            kept = np.cumsum(step[:-1]) == 0
            keep = np.repeat(kept, np.diff(bounds))
            last = np.flatnonzero(kept)
            last = last[np.append(owner[last][1:] != owner[last][:-1], True)] if len(last) else last
            keep[bounds[last + 1] - 1] = False  # the space after a text's last word
            left = np.concatenate([[0], np.cumsum(keep)])[places].astype(np.int32)
            out = pa.py_buffer(joined[keep])
            begin = np.searchsorted(source, np.arange(len(n) + 1)).astype(np.int32)
            found = pa.StructArray.from_arrays(
                [pa.array(runs[:, 0] - first[source]), pa.array(runs[:, 1]), pa.array(runs[:, 2])], names=["start", "length", "period"])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n), pa.ListArray.from_arrays(pa.array(begin), found),
                 pa.Array.from_buffers(pa.string(), len(n), [None, pa.py_buffer(left), out])],
                names=["row", "n_words", "runs", "collapsed"])

    row = F.struct(*carry)
    kind = docs.select(row.alias("row")).schema["row"].dataType.simpleString()
    return docs.select(row.alias("row"), F.col(text).alias("text")).mapInArrow(
        run, f"row {kind}, n_words long, runs {RUNS}, collapsed string")
