"""WARC archives: writing them, normalising monolithic gzip files into one member a record with an index, reading them."""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from schedlake.llm.shared import small_batches, written

#: Equal payloads of at least so many bytes are stored once.
LEAST_REVISIT = 1000
#: Bytes of payloads after which a task begins another archive, and bytes of archives in a reading task.
FILE_BYTES, SPLIT_BYTES = 64 << 20, 16 << 20
#: Bytes that are read, inflated or handed over at once.
CHUNK, READ_BYTES = 1 << 20, 4 << 20
#: Parts of a payload that many rows share, and of all rows without one, in a join.
SALTS, NULL_SPREAD = 16, 512
LEVEL = 6
DATE = "1970-01-01T00:00:00Z"
INDEX = "file string, offset long, length long, record_type string, record_id string"
RECORD = {"record_type": pa.string(), "record_id": pa.string(), "refers_to": pa.string(), "url": pa.string(),
          "payload_digest": pa.string(), "payload_bytes": pa.int64(), "intact": pa.bool_(), "payload": pa.binary()}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def with_revisits(pages: DataFrame, page_id: str = "page_id", payload: str = "html", least: int = LEAST_REVISIT) -> DataFrame:
    """The rows with ``payload_bytes, payload_digest, refers_to``: the largest id among those with an equal payload of at
    least ``least`` bytes, where that is another row's.

    A null payload is empty. Rows with the largest id refer to none, also where it repeats; nor do those of a payload
    whose rows all lack an id. Payloads are combined by digest before any shuffle, and only those that occur twice are
    joined back, each in ``SALTS`` copies so that one that a third of all rows share is no single task.
    """
    data = F.encode(F.coalesce(F.col(payload), F.lit("")), "UTF-8")
    known = pages.withColumns({"payload_bytes": F.octet_length(data).cast("long"), "payload_digest": F.sha1(data)})
    large = known.where(F.col("payload_bytes") >= least)
    groups = large.groupBy(F.col("payload_digest").alias("__digest")).agg(F.max(page_id).alias("__last"), F.count(F.lit(1)).alias("n"))
    groups = written(groups.where("n > 1").select("__digest", "__last"), "equal-payloads")
    salted = groups.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    has = F.col("payload_bytes") >= least
    salt = F.pmod(F.xxhash64(page_id), F.when(has, F.lit(SALTS)).otherwise(F.lit(NULL_SPREAD))).cast("int")
    joined = known.withColumns({"__digest": F.when(has, F.col("payload_digest")), "__salt": salt}).join(salted, ["__digest", "__salt"], "left")
    other = ~F.col(page_id).eqNullSafe(F.col("__last"))
    return joined.withColumn("refers_to", F.when(other, F.col("__last"))).select(*known.columns, "refers_to")


def _line(value: str) -> str:
    """A header value without the characters that would end its line."""
    return re.sub(r"[\x00-\x20\x7f%]", lambda m: f"%{ord(m[0]):02X}", value)


def _value(line: str) -> str:
    return re.sub(r"%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), line)


def record(kind: str, record_id: str, body: bytes, headers: list[tuple[str, str]] = (), date: str = DATE) -> bytes:
    """A WARC/1.1 record."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}",
             *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str = DATE) -> bytes:
    """A response, or a revisit of the one that ``refers_to`` names: then the payload itself is left out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = [] if url is None else [("WARC-Target-URI", _line(url))]
    headers += [("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()),
                ("Content-Type", "application/http; msgtype=response")]
    if refers_to is None:
        return record("response", _urn(page_id), http + payload, headers, date)
    return record("revisit", _urn(page_id), http, [*headers, ("WARC-Refers-To", f"<{_urn(refers_to)}>"), ("WARC-Profile", REVISIT_PROFILE)], date)


def _urn(page_id: int | None) -> str:
    return f"urn:page:{'' if page_id is None else page_id}"


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


class _Placed:
    """A stream to a file that gets its name once it is whole: a task that dies leaves none by that name."""

    def __init__(self, path: str):
        self.store, self.path = _store(path)
        folder, _, name = self.path.rpartition("/")
        self.own = f"{folder}/.{name}.{uuid.uuid4().hex}"
        self.store.create_dir(folder)

    def __enter__(self):
        self.out = self.store.open_output_stream(self.own, compression=None)
        return self.out

    def __exit__(self, error, *_):
        self.out.close()
        if error is None:
            self.store.move(self.own, self.path)


def write_archives(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", payload: str = "html",
                   file_bytes: int = FILE_BYTES, level: int = LEVEL, date: str = DATE) -> DataFrame:
    """Writes a record for each row of ``with_revisits`` to archives that are one gzip stream each, as crawlers leave them
    that pipe their output through gzip; returns ``file, records`` of them.

    Tasks write what they hold, without a shuffle, and begin another archive after ``file_bytes`` of payloads. Names are
    new for each attempt of a task, and the returned table, which only whole tasks add to, tells which files count.
    """
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for part in small_batches([batch], "payload", CHUNK)
                for row in zip(*(column.to_pylist() for column in part.columns)))
        name, number, row = f"part-{TaskContext.get().partitionId():08d}-{uuid.uuid4().hex[:8]}", 0, next(rows, None)
        while row is not None:
            path, records, held = f"{folder}/{name}-{number:05d}.warc.gz", 0, 0
            packer = zlib.compressobj(level, zlib.DEFLATED, 31)
            with _Placed(path) as out:
                about = record("warcinfo", f"urn:file:{name}-{number:05d}", b"format: WARC/1.1\r\n", [("Content-Type", "application/warc-fields")], date)
                out.write(packer.compress(about))
                while row is not None and (held < file_bytes or not records):
                    out.write(packer.compress(page_record(*row, date)))
                    records, held, row = records + 1, held + len(row[2]), next(rows, None)
                out.write(packer.flush())
            yield pa.RecordBatch.from_pydict({"file": [path], "records": [records]})
            number += 1

    data = F.encode(F.coalesce(F.col(payload), F.lit("")), "UTF-8")
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), data.alias("payload"), "payload_digest", "refers_to")
    return written(rows.mapInArrow(write, "file string, records long"), "archives")


def archives_in(spark: SparkSession, folder: str) -> DataFrame:
    """``file`` of the archives below a folder."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").option("recursiveFileLookup", "true").load(folder)
    return found.select(F.col("path").alias("file"))


def inflated(source) -> Iterator[bytes]:
    """What a gzip file holds, in chunks, whether it has one member or many."""
    unpack, data = zlib.decompressobj(31), b""
    while data := data or source.read(CHUNK):
        if unpack.eof:
            unpack = zlib.decompressobj(31)
        out = unpack.decompress(data, CHUNK)
        data = unpack.unused_data if unpack.eof else unpack.unconsumed_tail
        if out:
            yield out
    while not unpack.eof:  # what is left of a full chunk
        out = unpack.decompress(b"", CHUNK)
        if not out:
            raise ValueError("the gzip stream ends early")
        yield out


class Stream:
    """Record heads and stretches of bytes from chunks; holds little more than a chunk."""

    def __init__(self, chunks: Iterator[bytes]):
        self.chunks, self.held = chunks, b""

    def _more(self) -> bool:
        chunk = next(self.chunks, b"")
        self.held += chunk
        return bool(chunk)

    def head(self) -> bytes | None:
        """The lines of a record's headers, to the empty one; None at the end."""
        while not (held := self.held.lstrip(b"\r\n")):
            if not self._more():
                return None
        self.held = held
        while (end := self.held.find(b"\r\n\r\n")) < 0:
            if not self._more():
                raise ValueError("the archive ends within a record's headers")
        out, self.held = self.held[:end + 4], self.held[end + 4:]
        return out

    def stretch(self, size: int) -> Iterator[bytes]:
        while size:
            if not self.held and not self._more():
                raise ValueError("the archive ends within a record")
            out, self.held = self.held[:size], self.held[size:]
            size -= len(out)
            yield out


def headers_of(head: bytes) -> dict[str, str]:
    first, *lines = head.decode("utf-8", "replace").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"not a WARC record: {first[:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines if line)}


def normalise_file(source, out, level: int = LEVEL) -> Iterator[tuple[int, int, str, str]]:
    """Rewrites each record of a gzip stream as a member of its own; yields ``offset, length, record_type, record_id``.

    The stream is inflated once from end to end, and records pass in chunks whatever their size.
    """
    stream, at = Stream(inflated(source)), 0
    while (head := stream.head()) is not None:
        headers = headers_of(head)
        packer, size = zlib.compressobj(level, zlib.DEFLATED, 31), 0
        for part in chain([head], stream.stretch(int(headers["content-length"])), [b"\r\n\r\n", None]):
            packed = packer.flush() if part is None else packer.compress(part)
            out.write(packed)
            size += len(packed)
        yield at, size, headers["warc-type"], headers["warc-record-id"].strip("<>")
        at += size


def normalise(files: DataFrame, folder: str, level: int = LEVEL) -> DataFrame:
    """Rewrites archives (``file``) with each record as its own gzip member, each beside a sidecar ``.index.json`` of its
    records' places; returns ``file, records`` of the new archives.

    A whole-file stream cannot be entered in its middle, so a file is one task; it holds a chunk at a time. A file has the
    same new name and content however often its task runs, and its sidecar appears after it.
    """
    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, place = _store(path)
                name = f"{folder}/{hashlib.blake2b(path.encode(), digest_size=8).hexdigest()}-{place.rpartition('/')[2]}"
                records = 0
                with _Placed(f"{name}.index.json") as sidecar, _Placed(name) as out, store.open_input_stream(place, compression=None) as source:
                    for offset, length, kind, record_id in normalise_file(source, out, level):
                        line = {"file": name, "offset": offset, "length": length, "record_type": kind, "record_id": record_id}
                        sidecar.write(json.dumps(line).encode() + b"\n")
                        records += 1
                yield pa.RecordBatch.from_pydict({"file": [name], "records": [records]})

    store, place = _store(folder)
    store.create_dir(place)
    files = files.select("file")
    spread = files.repartitionByRange(max(1, files.count()), "file")
    return written(spread.mapInArrow(rewrite, "file string, records long"), "normalised")


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """``file, offset, length, record_type, record_id`` of all records, from the sidecars."""
    return spark.read.schema(INDEX).option("pathGlobFilter", "*.index.json").json(folder)


def read_records(index: DataFrame, payload: bool = True) -> DataFrame:
    """The records that an index names, which may be any part of one, as the columns ``RECORD``.

    Tasks take neighbouring places of a file and read those that touch together. ``payload_digest`` is lower-case hex: of
    the payload where the record has one, and then ``intact`` tells whether its header agrees; else the header's. HTTP
    headers are not part of a payload, and ``payload_bytes`` of a revisit is what they say. An empty index gives no rows.
    """
    columns = [c for c in RECORD if payload or c != "payload"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for member in _members(batches):
            rows.append(parsed(member))
            held += len(rows[-1]["payload"] or b"")
            if held >= READ_BYTES or len(rows) >= 10_000:
                yield pa.RecordBatch.from_pylist(rows, pa.schema([(c, RECORD[c]) for c in columns]))
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, pa.schema([(c, RECORD[c]) for c in columns]))

    size = index.agg(F.sum("length")).first()[0] or 0
    places = index.select("file", "offset", "length").repartition(max(1, -(-size // SPLIT_BYTES)), "file", F.floor(F.col("offset") / SPLIT_BYTES))
    kinds = {pa.string(): "string", pa.int64(): "long", pa.bool_(): "boolean", pa.binary(): "binary"}
    return places.sortWithinPartitions("file", "offset").mapInArrow(read, ", ".join(f"{c} {kinds[RECORD[c]]}" for c in columns))


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
    """The inflated records at the places in order; those that touch are read together."""
    places = (place for batch in batches for place in zip(*(column.to_pylist() for column in batch.columns)))
    path, source, place = None, None, next(places, None)
    while place is not None:
        name, begin, length = place
        together = [length]
        while (place := next(places, None)) is not None and place[:2] == (name, begin + sum(together)) and sum(together) < READ_BYTES:
            together.append(place[2])
        if name != path:
            store, at = _store(name)
            path, source = name, store.open_input_file(at)
        data = memoryview(source.read_at(sum(together), begin))
        at = 0
        for n in together:
            yield zlib.decompress(data[at:at + n], 31)
            at += n


def parsed(member: bytes) -> dict:
    """A record's fields; chunked transfer is not undone."""
    head, _, rest = member.partition(b"\r\n\r\n")
    headers = headers_of(head)
    body = rest[:int(headers["content-length"])]
    kind, said = headers["warc-type"], None
    if headers.get("content-type", "").startswith("application/http"):
        http, _, body = body.partition(b"\r\n\r\n")
        sizes = re.findall(rb"(?im)^content-length:[ \t]*([0-9]+)", http)
        said = int(sizes[0]) if sizes else None
    digest = headers.get("warc-payload-digest", "").removeprefix("sha1:")
    if len(digest) == 32:
        digest = base64.b32decode(digest, casefold=True).hex()
    digest, own = digest.lower() or None, None if kind == "revisit" else hashlib.sha1(body).hexdigest()
    urls = headers.get("warc-target-uri")
    refers_to = headers.get("warc-refers-to")
    return {"record_type": kind, "record_id": headers["warc-record-id"].strip("<>"), "refers_to": refers_to and refers_to.strip("<>"),
            "url": None if urls is None else _value(urls.strip("<>")), "payload_digest": own or digest,
            "payload_bytes": len(body) if own else said, "intact": digest and own and digest == own,
            "payload": body if own else None}
