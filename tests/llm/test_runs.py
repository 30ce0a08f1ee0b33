"""Periodic runs against a scan of all periods, over small alphabets, odd texts and the registered query's texts."""

import hashlib
import random
import zlib
from collections import Counter

import brute
import numpy as np
import pytest

from schedlake.llm import queries, runs
from schedlake.llm.shared import written


def scanned(words, least=6, periods=4):
    """All runs, by comparing words of each distance."""
    words, out = np.unique(np.array([*words, 0]).astype(str), return_inverse=True)[1][:-1], []
    for q in range(1, len(words) // periods + 1):
        equal = np.diff(np.concatenate([[0], words[:-q] == words[q:], [0]]))
        for start, end in zip(np.flatnonzero(equal == 1).tolist(), (np.flatnonzero(equal == -1) + q).tolist()):
            if end - start >= max(least, periods * q) and not any(a <= start and end <= a + n for a, n, _ in out):
                out.append((start, end - start, q))  # else it has a smaller period
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words, found):
    drop = {k for start, length, q in found for k in range(start + q, start + length)}
    return " ".join(w for k, w in enumerate(words) if k not in drop)


@pytest.mark.parametrize("least, periods", [(6, 4), (2, 2), (5, 3)])
def test_runs_of_small_alphabets(least, periods):
    rng = random.Random(least)
    for _ in range(600):
        k, n = rng.choice([1, 2, 2, 3, 4]), rng.randint(0, 40)
        words = [rng.randrange(k) for _ in range(n)]
        if rng.random() < 0.5:
            words[n // 2:n // 2] = [rng.randrange(k) for _ in range(rng.randint(1, 6))] * rng.randint(3, 7)
        found = runs.find_runs(np.array([runs.CUT, *words, runs.CUT]), least, periods)
        assert sorted((a - 1, n, q) for a, n, q in found.tolist()) == sorted(scanned(words, least, periods))


def test_lyndon_words():
    rng = random.Random(5)
    for _ in range(300):
        words = [rng.randrange(3) for _ in range(rng.randint(1, 25))]
        length, group = runs.lyndon_words(np.array([runs.CUT, *words, runs.CUT]))
        each = []
        for i in range(len(words)):
            n = max(n for n in range(1, len(words) - i + 1) if all(words[i:i + n] < words[i + k:i + n] for k in range(1, n)))
            each.append(tuple(words[i:i + n]))
        assert length.tolist() == [0, *map(len, each), 0]
        assert len(set(zip(each, group[1:].tolist()))) == len(set(each)) == len(set(group[1:-1].tolist()))


def odd_texts():
    rng = random.Random(8)
    out = brute.texts() + [(100, "a " * 5, "x"), (101, " a\ta\na a\x0ba\x0ca ", "x"), (102, "é日 " * 9 + "x", "x"),
                           (103, "a b a b a b a b c a b a b a b a b", "x"), (104, "x y z " * 2000, "x")]
    out += [(200 + i, " ".join(rng.choice("ab") for _ in range(rng.randint(1, 60))), "x") for i in range(60)]
    return out


def test_texts_with_all_odd_cases(spark):
    docs = written(brute.documents(spark, odd_texts()), "docs")
    got = runs.collapse(docs).collect()
    want = Counter()
    for i, t, _ in odd_texts():
        words = brute.WORD.findall(t or "")
        found = scanned(words)
        want[i, len(words), tuple(found), collapsed(words, found)] += 1
    assert Counter((r["row"]["doc_id"], r["n_words"], tuple(map(tuple, r["runs"])), r["collapsed"]) for r in got) == want
    assert any(r["runs"] for r in got) and runs.collapse(docs.limit(0)).count() == 0
    assert got[0]["row"].__fields__ == docs.columns


def test_registered_query(spark, small):
    got = {r["doc_id"]: r for r in queries.QUERIES["op12_periodic_runs"](spark, small).collect()}
    rows = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for i, t in rows:
        words = brute.WORD.findall(t or "")
        n, h = len(words), zlib.crc32(str(i).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
        found = scanned(words)
        r, digest = got[i], hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in found).encode()).hexdigest()
        top = min(found, key=lambda x: (-x[1], x[0], x[2]), default=(None,) * 3)
        milli = 1000 * top[1] // top[2] if found else None
        assert (r["n_runs"], r["start"], r["length"], r["period"], r["exponent_milli"], r["runs_sha256"]) == (len(found), *top, milli, digest)
        assert r["collapsed_sha256"] == hashlib.sha256(collapsed(words, found).encode()).hexdigest()
