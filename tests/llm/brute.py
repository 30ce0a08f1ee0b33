"""Plain Python versions of the operators, and small inputs with every odd case."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Columns whose names the operators use themselves.
CLASHING = "doc_id long, text string, source string, row string, n_words long, spans string, n int, rid int, key string, data string, id long"


def texts() -> list[tuple[int | None, str | None, str | None]]:
    """Ids, texts and sources: nulls, empty and long texts, copies, near copies, shared passages, repeated rows."""
    random.seed(11)
    words = ["alpha", "Beta", "gamma,", "delta", "épsilon", "zeta", "eta", "theta", "iota", "kappa", "λάμδα", "mu", "日本"]

    def prose(n: int) -> str:
        return " ".join(random.choice(words) + random.choice(["", "", ".", "\n"]) for _ in range(n))

    base, passage = prose(120), prose(60)
    near = base.split(" ")
    near[50] = "changed"
    out: list = [(1, None, "a"), (2, "", "a"), (3, " \n\t ", None), (4, base, "b"), (5, base, "b"), (6, " ".join(near), "b"),
                 (7, prose(40) + "\n" + passage + "\n" + prose(30), "c"), (8, passage + prose(25), None), (9, "one two", "c"),
                 (10, "One  two", "c"), (11, "word " * 3000, "c"), (12, "x" * 5000, "d"), (13, prose(4000), "d"),
                 (14, "a\nb\na\nb\n\n\n###$$$", "d"), (None, prose(30), "d"), (None, base + " tail", "d"), (15, "🙂 é́ \x00 ok", "e")]
    out += [(16, prose(50), "e")] * 2
    out += [(20 + i, prose(random.randint(1, 90)), f"s{i % 5}") for i in range(25)]
    return out


def documents(spark, rows=None):
    """With columns that clash with the names that operators give."""
    rows = texts() if rows is None else rows
    return spark.createDataFrame([(i, t, s, "r", 7, "x", 3, 4, "k", "d", 9) for i, t, s in rows], CLASHING)


def components(sets: dict, percent: int) -> dict:
    """Smallest key that links reach."""
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(sets)
    for k, a in enumerate(keys):
        for b in keys[:k]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def shingles(text: str | None, n: int) -> frozenset:
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[k:k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset()


def signals(text: str | None) -> tuple[int, int, int, int, int]:
    t = text or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    times = collections.Counter(tuple(w[k:k + 8]) for k in range(len(w) - 7))
    hit = {j for k in range(len(w) - 7) if times[tuple(w[k:k + 8])] > 1 for j in range(k, k + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit)


def contamination(text: str | None, items: list[tuple], window: int = 13) -> tuple[int, int, list[str]]:
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    w = word.findall((text or "").translate(LOWER))
    hit, names = set(), set()
    for name, item in items:
        v = word.findall((item or "").translate(LOWER))
        for k in range(max(1, len(v) - window + 1) if v and name is not None else 0):
            part = v[k:k + window]
            for i in range(len(w) - len(part) + 1):
                if w[i:i + len(part)] == part:
                    hit.update(range(i, i + len(part)))
                    names.add(str(name))
    return len(w), len(hit), sorted(names)


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    t, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


def removed(rows: list[bytes], window: int = 200) -> list[tuple[int, int, int, str]]:
    times = collections.Counter(b[k:k + window] for b in rows for k in range(len(b) - window + 1))
    out = []
    for b in rows:
        mark, end = bytearray(len(b)), 0
        for k in range(len(b) - window + 1):
            if times[b[k:k + window]] > 1:
                for x in range(max(k, end), k + window):
                    mark[x] = 1
                end = k + window
        runs = sum(1 for x in range(len(mark)) if mark[x] and (x == 0 or not mark[x - 1]))
        out.append((len(b), sum(mark), runs, hashlib.sha256(bytes(x for x, y in zip(b, mark) if not y)).hexdigest()))
    return out


def bigram_scores(docs: list[tuple], prior: float) -> list[tuple[bool, int, int, int, float, float]]:
    split = [WORD.findall((t or "").translate(LOWER)) + [None] for _, t in docs]
    train = [zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1 for i, _ in docs]
    c, pairs, before = collections.Counter(), collections.Counter(), collections.Counter()
    for w, k in zip(split, train):
        if k:
            c.update(w)
            pairs.update(zip([0] + w[:-1], w))
            before.update([0] + w[:-1])
    total, distinct = sum(c.values()), len(c)

    def unigram(x):
        return (c[x] + 0.5) / (total + 0.5 * (distinct + 1))

    return [(not k, len(w), sum(c[x] > 0 for x in w), total, sum(math.log10(unigram(x)) for x in w),
             sum(math.log10((pairs[p, x] + prior * unigram(x)) / (before[p] + prior)) for p, x in zip([0] + w[:-1], w)))
            for w, k in zip(split, train)]
