"""Removes passages that occur elsewhere, found as common prefixes of neighbours in suffix arrays.

One suffix array of a whole corpus would be one task. So texts are cut into strings such that equal windows of
``window`` bytes share a key (see ``superstrings``); the strings of a key meet in one group, and only keys that occur
twice are looked at. Each group's suffix array tells which of its windows are repeated.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from schedlake.llm.shared import small_batches, written
from schedlake.llm.suffixes import repeated_starts
from schedlake.llm.superstrings import LENGTHS, WINDOW, runs

#: Strings of one group. A key with more is pre-aggregated by content before its strings meet.
HOT = 4000
#: Bytes of distinct strings of one key; a key with more is cut anew by longer fingerprints.
GROUP_BYTES = 8 << 20
MARKS = "t1 long, t2 long, first long, last long"


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``key, t1, t2, n``: at how many places each key occurs in each text."""
    for batch in small_batches(batches, "data"):
        text, key, _, _, times = runs(batch.column(2).to_pylist())
        order = np.lexsort((key, text))
        text, key = text[order], key[order]
        held = np.concatenate([[0], np.cumsum(times[order])])
        fresh = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (key[1:] != key[:-1])])) if len(key) else []
        own = pa.array(text[fresh] if len(key) else [], pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(key[fresh] if len(key) else [], pa.int64()), batch.column(0).take(own), batch.column(1).take(own),
             pa.array(np.diff(held[np.append(fresh, len(key)).astype(np.int64)]), pa.int64())], names=["key", "t1", "t2", "n"])


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``key, c1, c2, data, t1, t2, first, w`` of the strings of wanted keys; c1 and c2 tell contents apart."""
    for batch in small_batches(batches, "data"):
        t1, t2, texts, wanted, copies = (c.to_pylist() for c in batch.columns)
        out = []
        text, key, first, last, _ = runs(texts)
        edges = np.searchsorted(text, np.arange(len(texts) + 1))
        for i, data in enumerate(texts):
            own = slice(edges[i], edges[i + 1])
            hit = np.isin(key[own], np.array(wanted[i], np.int64))
            for k, a, b in zip(key[own][hit].tolist(), first[own][hit].tolist(), last[own][hit].tolist()):
                string = data[a:b + WINDOW]
                c = np.frombuffer(hashlib.blake2b(string, digest_size=16).digest(), np.int64)
                out.append((k, int(c[0]), int(c[1]), string, t1[i], t2[i], a, copies[i]))
        names = ["key", "c1", "c2", "data", "t1", "t2", "first", "w"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        columns = list(zip(*out)) if out else [()] * 8
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def _places(frame: pd.DataFrame) -> pd.DataFrame:
    """Repeated starts of the texts of a group; equal strings are sorted once."""
    number: dict[bytes, int] = {}
    own = [number.setdefault(d, len(number)) for d in frame["data"]]
    weights = np.bincount(own, frame["w"].to_numpy())
    found = pd.DataFrame(repeated_starts(list(number), weights.tolist(), WINDOW), columns=["own", "a", "b"], dtype="int64")
    at = pd.DataFrame({"own": own, "t1": frame["t1"].to_numpy(), "t2": frame["t2"].to_numpy(), "at": frame["first"].to_numpy()})
    at = at.merge(found, on="own")
    return pd.DataFrame({"t1": at["t1"], "t2": at["t2"], "first": at["at"] + at["a"], "last": at["at"] + at["b"]})


def _marked(frame: pd.DataFrame) -> pd.DataFrame:
    """The same for contents: ``c1, c2, first, last``."""
    found = repeated_starts(list(frame["data"]), frame["w"].tolist(), WINDOW)
    own = [i for i, _, _ in found]
    at = frame["at"].to_numpy()[own]
    return pd.DataFrame({"c1": frame["c1"].to_numpy()[own], "c2": frame["c2"].to_numpy()[own],
                         "first": at + [a for _, a, _ in found], "last": at + [b for _, _, b in found]})


def _grouped(strings: DataFrame, groups: int) -> DataFrame:
    return strings.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(groups))).groupBy("bucket")


def _contents(contents: DataFrame, level: int = 0) -> DataFrame:
    """``c1, c2, first, last`` of ``key, c1, c2, at, data, w``; groups that are too large are cut by longer fingerprints.

    At the last length a string is one window, or a run of equal ones, and its first window is counted by content.
    """
    if level == len(LENGTHS) - 1:
        rows = contents.withColumn("window", F.substring("data", 1, WINDOW))
        times = F.sum(F.col("w") * (F.length("data") - (WINDOW - 1)))
        total = rows.groupBy("window").agg(times.alias("total")).where("total > 1").select("window")
        return rows.join(total, "window").select(
            "c1", "c2", F.col("at").alias("first"), (F.col("at") + F.length("data") - WINDOW).alias("last"))
    sizes = written(contents.groupBy("key").agg(F.sum(F.length("data")).alias("held")), "content-sizes")
    total = sizes.agg(F.sum("held")).first()[0] or 0
    large = sizes.where(F.col("held") > GROUP_BYTES)
    groups = int(max(64, total >> 20))
    if large.isEmpty():
        return _grouped(contents, groups).applyInPandas(lambda f: _marked(f), "c1 long, c2 long, first long, last long")
    small = _grouped(contents.join(large, "key", "left_anti"), groups).applyInPandas(
        lambda f: _marked(f), "c1 long, c2 long, first long, last long")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c1, c2, at, data, w = (c.to_pylist() for c in batch.columns)
            own, key, first, last, _ = runs(data, LENGTHS[level + 1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(key), *(pa.array([x[i] for i in own], pa.int64()) for x in (c1, c2)),
                 pa.array([at[i] + a for i, a in zip(own, first)], pa.int64()),
                 pa.array([data[i][a:b + WINDOW] for i, a, b in zip(own, first, last)], pa.binary()),
                 pa.array([w[i] for i in own], pa.int64())], names=["key", "c1", "c2", "at", "data", "w"])

    finer = contents.join(large.select("key"), "key").select("c1", "c2", "at", "data", "w").mapInArrow(
        cut, "key long, c1 long, c2 long, at long, data binary, w long")
    return small.union(_contents(written(finer, "finer-strings"), level + 1))


def repeated_passages(keyed: DataFrame) -> DataFrame:
    """``t1, t2, first, last``: runs of starts of repeated windows of each distinct text, from ``t1, t2, data``."""
    keys = keyed.mapInArrow(_keys, "key long, t1 long, t2 long, n long")
    repeated = written(keys.groupBy("key").agg(F.sum("n").alias("c")).where("c > 1"), "repeated-keys")
    held = repeated.agg(F.sum(F.when(F.col("c") <= HOT, F.col("c"))), F.max("c")).first()
    wanted = written(keys.select("key", "t1", "t2").join(repeated, "key").groupBy("t1", "t2").agg(
        F.collect_set(F.when(F.col("c") <= HOT, F.col("key"))).alias("keys"),
        F.collect_set(F.when(F.col("c") > HOT, F.col("key"))).alias("hot")), "wanted-keys")
    texts = keyed.groupBy("t1", "t2").agg(F.first("data").alias("data"), F.count(F.lit(1)).alias("copies"))
    texts = texts.join(wanted, ["t1", "t2"])
    schema = "key long, c1 long, c2 long, data binary, t1 long, t2 long, first long, w long"
    usual = texts.select("t1", "t2", "data", "keys", "copies").where(F.size("keys") > 0).mapInArrow(_strings, schema)
    out = _grouped(usual.select("key", "data", "t1", "t2", "first", "w"), int(max(64, (held[0] or 0) // HOT))).applyInPandas(
        lambda f: _places(f), MARKS)
    if (held[1] or 0) <= HOT:
        return out
    hot = written(texts.select("t1", "t2", "data", F.col("hot").alias("keys"), "copies").where(F.size("keys") > 0).mapInArrow(
        _strings, schema), "hot-strings")
    contents = written(hot.groupBy("key", "c1", "c2").agg(F.first("data").alias("data"), F.sum("w").alias("w")).withColumn(
        "at", F.lit(0).cast("long")), "hot-contents")
    marks = _contents(contents).select("c1", "c2", F.col("first").alias("a"), F.col("last").alias("b"))
    return out.union(hot.select("c1", "c2", "t1", "t2", "first").join(marks, ["c1", "c2"]).select(
        "t1", "t2", (F.col("first") + F.col("a")).alias("first"), (F.col("first") + F.col("b")).alias("last")))


def remove_repeats(docs: DataFrame, text: str = "text", carry: tuple[str, ...] = ("*",)) -> DataFrame:
    """``row`` (the columns ``carry`` as a struct), ``n_bytes, spans, kept``, one row per row of docs.

    Every byte that is covered by ``WINDOW`` bytes which also start anywhere else is removed; ``spans`` are the removed
    runs as byte places, end exclusive, ``kept`` the other bytes. All rows count, those that repeat too, so both copies
    of a text lose all of it. Null is empty; texts shorter than a window lose nothing; an empty table gives no rows.
    """
    data = F.coalesce(F.col(text), F.lit("")).cast("binary")
    keyed = docs.select(F.struct(*carry).alias("row"), F.xxhash64(data).alias("t1"), F.xxhash64(F.lit(1), data).alias("t2"),
                        data.alias("data"))
    marks = repeated_passages(keyed.select("t1", "t2", "data")).groupBy("t1", "t2").agg(
        F.sort_array(F.collect_set(F.struct("first", "last"))).alias("marks"))
    marks = written(marks, "repeated-passages")
    joined = keyed.join(marks, ["t1", "t2"], "left").select("row", "data", "marks")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "data"):
            sizes, spans, kept = [], [], []
            for text, own in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                merged: list[list[int]] = []
                for mark in own or []:
                    begin, end = mark["first"], mark["last"] + WINDOW
                    if merged and begin <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], end)
                    else:
                        merged.append([begin, end])
                edges = [0, *(x for span in merged for x in span), len(text)]
                sizes.append(len(text))
                spans.append([{"start": a, "end": b} for a, b in merged])
                kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()),
                 pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())],
                names=["row", "n_bytes", "spans", "kept"])

    row = joined.schema["row"].dataType.simpleString()
    return joined.mapInArrow(cut, f"row {row}, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
