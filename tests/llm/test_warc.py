"""Archives: round trips through both forms, odd rows, revisits, damage, and restarts."""

import gzip
import hashlib
import io
import json
import os
import random
import zlib
from collections import Counter

import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from schedlake.llm import warc
from schedlake.session import run_folder

BIG = "<html>é " + "x" * 1200
ROWS = [(1, "http://a.org/", BIG), (2, None, BIG), (3, "http://a.org/\r\nX: y %41", "small"), (4, "u", "small"), (5, "u", None), (6, "", ""),
        (7, "日本", "a\r\n\r\nWARC/1.1\r\n\r\n"), (8, "u", "y" * 3_000_000), (9, "u", "z" * 1500), (9, "u", "z" * 1500), (10, "v", "z" * 1500),
        (None, "n", BIG), (None, "n", "w" * 1000), (None, "n", "w" * 1000), (11, "u", "q" * 999), (12, "u", "q" * 999), (-3, "u", "\x00\x01" * 600)]


def wanted(rows, least=1000):
    last = {}
    for i, _, html in rows:
        data = (html or "").encode()
        if len(data) >= least and i is not None:
            last[data] = max(last.get(data, i), i)
    out = []
    for i, url, html in rows:
        data = (html or "").encode()
        to = last.get(data) if len(data) >= least and last.get(data) != i else None
        out.append((i, url, len(data), hashlib.sha1(data).hexdigest(), "response" if to is None else "revisit", to, data if to is None else None))
    return Counter(out)


def got(records):
    number = lambda x: int(x.removeprefix("urn:page:")) if x and x != "urn:page:" else None
    return Counter((number(r["record_id"]), r["url"], r["payload_bytes"], r["payload_digest"], r["record_type"], number(r["refers_to"]),
                    None if r["payload"] is None else bytes(r["payload"])) for r in records)


def archived(spark, rows, **sizes):
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, file string, payload long")
    files = warc.write_archives(warc.with_revisits(pages), run_folder(spark, "streams"), **sizes)
    folder = run_folder(spark, "members")
    return files, warc.normalise(files, folder), warc.read_index(spark, folder)


@pytest.mark.parametrize("file_bytes", [1 << 30, 2000])
def test_round_trip(spark, no_broadcast, file_bytes):
    files, members, index = archived(spark, ROWS, file_bytes=file_bytes)
    pages = index.where("record_type <> 'warcinfo'")
    records = warc.read_records(pages).collect()
    assert got(records) == wanted(ROWS)
    assert all(r["intact"] is (None if r["record_type"] == "revisit" else True) for r in records)
    assert files.agg(F.sum("records")).first()[0] == len(ROWS) == index.count() - files.count()
    for r in files.collect():  # one member each
        unpack = zlib.decompressobj(31)
        with open(r["file"], "rb") as f:
            unpack.decompress(f.read())
        assert unpack.eof and not unpack.unused_data
    for r in index.collect():  # each place is one whole member
        with open(r["file"], "rb") as f:
            f.seek(r["offset"])
            data = f.read(r["length"])
        unpack = zlib.decompressobj(31)
        assert unpack.decompress(data).startswith(b"WARC/1.1\r\n") and unpack.eof and not unpack.unused_data
    for r in members.collect():  # the places leave nothing out
        assert os.path.getsize(r["file"]) == index.where(F.col("file") == r["file"]).agg(F.sum("length")).first()[0]
    assert not [f for r in members.collect() for f in os.listdir(os.path.dirname(r["file"])) if f.startswith(".") and not f.endswith(".crc")]


def test_a_part_of_an_index(spark):
    _, _, index = archived(spark, ROWS, file_bytes=4000)
    some = index.where(F.col("record_id").isin("urn:page:8", "urn:page:1", "urn:page:6"))
    assert {r["record_id"] for r in warc.read_records(some).collect()} == {"urn:page:8", "urn:page:1", "urn:page:6"}
    assert "payload" not in warc.read_records(some, payload=False).columns


def test_empty_tables(spark):
    _, members, index = archived(spark, ROWS[:0])
    assert members.count() == index.count() == warc.read_records(index).count() == 0


def test_hot_payloads(spark, no_broadcast):
    rows = [(i, "u", BIG if i % 3 == 0 else f"page {i}" * (200 if i % 7 == 0 else 1)) for i in range(3000)]
    _, _, index = archived(spark, rows)
    assert got(warc.read_records(index.where("record_type <> 'warcinfo'")).collect()) == wanted(rows)


def test_the_same_names_and_bytes_on_every_run(spark):
    files, members, _ = archived(spark, ROWS, file_bytes=3000)
    folder = members.first()["file"].rpartition("/")[0]
    before = {f: open(f"{folder}/{f}", "rb").read() for f in os.listdir(folder) if not f.startswith(".")}
    warc.normalise(files, folder)
    assert {f: open(f"{folder}/{f}", "rb").read() for f in os.listdir(folder) if not f.startswith(".")} == before


def test_archives_of_others(spark, tmp_path):
    """Many members, other header forms, records without HTTP, line ends between records."""
    body = b"plain text"
    other = (b"WARC/1.0\r\nwarc-type:resource\r\nWARC-Record-ID: <urn:x>\r\nContent-Type: text/plain\r\nContent-Length: 10\r\n\r\n" + body + b"\r\n\r\n")
    bad = warc.record("response", "urn:bad", b"HTTP/1.1 200 OK\r\n\r\nbody", [("Content-Type", "application/http"), ("WARC-Payload-Digest", "sha1:" + "A" * 32)])
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(other) + gzip.compress(b"\r\n" + bad))
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(other * 3))
    folder = run_folder(spark, "others")
    warc.normalise(warc.archives_in(spark, str(tmp_path)), folder)
    records = warc.read_records(warc.read_index(spark, folder)).collect()
    assert Counter((r["record_type"], r["record_id"], bytes(r["payload"]), r["intact"]) for r in records) == Counter(
        {("resource", "urn:x", body, None): 4, ("response", "urn:bad", b"body", False): 1})


@pytest.mark.parametrize("damage", [lambda d: d[:-30], lambda d: gzip.compress(gzip.decompress(d)[:-10]), lambda d: gzip.compress(b"HTTP/1.1\r\n\r\n")])
def test_damaged_archives_leave_no_index(spark, tmp_path, damage):
    whole = gzip.compress(b"".join(warc.record("resource", f"urn:{i}", random.Random(i).randbytes(5000)) for i in range(9)))
    (tmp_path / "a.warc.gz").write_bytes(damage(whole))
    folder = run_folder(spark, "damaged")
    with pytest.raises(PythonException):
        warc.normalise(warc.archives_in(spark, str(tmp_path)), folder)
    assert not [f for f in os.listdir(folder) if f.endswith(".json") and not f.startswith(".")]


def test_large_records_pass_in_chunks():
    class Sink(io.BytesIO):
        largest = 0

        def write(self, data):
            self.largest = max(self.largest, len(data))
            return super().write(data)

    body, sink = random.Random(1).randbytes(9_000_000), Sink()
    places = list(warc.normalise_file(io.BytesIO(gzip.compress(warc.record("resource", "urn:1", body))), sink))
    assert len(places) == 1 and sink.largest <= 2 * warc.CHUNK and body in gzip.decompress(sink.getvalue())
    assert json.dumps(places[0])
