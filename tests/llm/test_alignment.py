"""Alignment of two tokenizers against the libraries' own ids and a plain walk over byte offsets."""

import hashlib
from collections import Counter, defaultdict

import brute
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from schedlake.llm import alignment, queries, tokens
from schedlake.llm.shared import written

A = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
DECODE = {chr(b): b for b in PRINTABLE} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - PRINTABLE))}


def bytes_a(i):
    return bytes(DECODE[c] for c in A.id_to_token(i))


def bytes_b(i):
    return bytes([int(B.id_to_piece(i)[1:-1], 16)]) if B.is_byte(i) else B.id_to_piece(i).replace("▁", " ").encode()


def plain(text):
    """Ids of both sides, groups and links of a text."""
    if not text:
        return [], [], [], []
    a, b = A.encode(" " + text, add_special_tokens=False).ids, B.encode(text)
    whole = (" " + text).encode()
    if b"".join(map(bytes_a, a)) != whole or b"".join(map(bytes_b, b)) != whole:
        return [], [], [], []
    ends_a, ends_b = (np.cumsum([len(f(i)) for i in ids]).tolist() for f, ids in ((bytes_a, a), (bytes_b, b)))
    groups, links, i, j = [], [], 0, 0
    for end in sorted(set(ends_a) & set(ends_b)):
        k, m = ends_a.index(end, i) + 1, ends_b.index(end, j) + 1
        groups.append(f"{','.join(map(str, a[i:k]))}|{','.join(map(str, b[j:m]))}")
        links.append((a[k - 1], b[m - 1]))
        i, j = k, m
    return a, b, groups, links


def expected(rows):
    """The contract's columns for (doc_id, text) rows."""
    found = [(i, *plain(t)) for i, t in rows]
    count = Counter(link for *_, links in found for link in links)
    most = defaultdict(int)
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    return Counter((i, len(a), len(b), len(groups), len(links), sum(count[x] == most[x[1]] for x in links), sum(count[x] for x in links),
                    hashlib.sha256(";".join(groups).encode()).hexdigest() if a else "") for i, a, b, groups, links in found)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
ODD = [" ", "  ", "\n", " a", "a ", "a  b", "a▁b", "▁", "▁ b", " ▁x", "<|endoftext|>", "<s> </s> <unk>", "<0x41>", "a <0x0A> b",
       "日本語 テキスト", "🙂🙂 é", "é", "\x00", "a\x00b", " x", "x y", "word" * 500, "don't stop. 3.14, 1,000!", "A.B.C", "tab\tend\r\n\r\nx",
       "ﬁ ligature", "a​b", "ﷺ", " " * 40 + "x", "x" + " " * 17, ".,;:!?", "﻿x", "100%", "a1b2 c3"]


def random_texts(n):
    rng = np.random.default_rng(2)
    parts = [" ", " ", " ", "  ", "\n", "\t", "the", "Quick", "foo", "é", "1", "23", ",", ".", "'s", "!?", "日本", "🙂", "▁", "-", "<s>", "“", "x" * 9]
    return ["".join(rng.choice(parts, rng.integers(0, 30))) for _ in range(n)]


def test_pieces_equal_the_library(monkeypatch):
    monkeypatch.setattr(alignment, "REMEMBERED", 60)
    texts = [t for t in random_texts(3000) + ODD + [t or "" for _, t, _ in brute.texts()] if t and "▁" not in t]
    own = alignment.PieceEncoder(public_tokenizers.path("piece_bpe_32k.model"))
    assert own.at_space and own.at_mark
    ids, at = own.encode_spaced(*tokens.text_bytes(pa.array([" " + t for t in texts])))
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == B.encode(texts)


@pytest.mark.parametrize("most", [0, 1 << 20])
def test_alignment(spark, monkeypatch, no_broadcast, most):
    monkeypatch.setattr(alignment, "BROADCAST_PAIRS", most)
    rows = brute.texts() + [(1000 + i, t, "x") for i, t in enumerate(ODD + random_texts(300))]
    docs = brute.documents(spark, rows)
    aligned = written(alignment.align(docs), "aligned")
    assert aligned.schema["row"].dataType.names == docs.columns
    scored = alignment.with_counts(aligned.select("row", *aligned.columns[1:]), alignment.link_counts(aligned))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)).alias("groups_sha256")
    got = scored.select("row.doc_id", *COLUMNS[1:-1], digest).collect()
    assert Counter(map(tuple, got)) == expected([(i, t) for i, t, _ in rows])
    none = written(alignment.align(docs.limit(0)), "aligned")
    assert alignment.with_counts(none, alignment.link_counts(none)).count() == 0
    blank = written(alignment.align(docs.where("doc_id < 3")), "aligned")
    assert [tuple(r) for r in alignment.with_counts(blank, alignment.link_counts(blank)).select("n_a", "n_links", "groups").collect()] == [(0, 0, "")] * 2


def test_counts_are_handed_on_in_parts(spark, monkeypatch):
    monkeypatch.setattr(alignment, "PAIRS_HELD", 5)
    monkeypatch.setattr(alignment, "REMEMBERED", 3)
    rows = [(i, t) for i, t in enumerate(random_texts(200))]
    aligned = written(alignment.align(spark.createDataFrame(rows, "doc_id long, text string")), "aligned")
    got = {(r["pair"] // alignment.SECOND, r["pair"] % alignment.SECOND): r["n"] for r in alignment.link_counts(aligned).collect()}
    assert got == Counter(link for _, t in rows for link in plain(t)[3])


def test_registered_query(spark, small):
    got = queries.QUERIES["op11_token_alignment"](spark, small)
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    assert Counter(map(tuple, got.select(*COLUMNS).collect())) == expected(rows)
