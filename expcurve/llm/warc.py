"""WARC archives with one Zstandard frame per record and a dictionary up front.

An archive starts with a skippable frame (magic 0x184D2A5D) that holds the
dictionary, itself compressed without one.  Every record is one frame that
states its content size.  The reader loads the dictionary, decodes one frame
for each record, and checks every header and length; anything else raises.

Scale: a task writes the archives of its own rows and returns their names; a
name is new for each attempt, and only the names returned by the attempts that
Spark accepted are read.  Reading streams an archive frame by frame.  Payloads
are grouped by digest with a partially aggregated maximum, so equal payloads
meet as one row per task, however many there are.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from expcurve.llm.common import map_arrow, shared_folder, stored

DICT_MAGIC = 0x184D2A5D
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
VERSION = b"WARC/1.1\r\n"
CRLF = b"\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2020-01-01T00:00:00Z"
ARCHIVE_BYTES = 256 << 20
DICT_BYTES = 16 << 10
SAMPLE_BYTES = 2 << 20
READ_BYTES = 1 << 18


class WarcError(ValueError):
    """A damaged archive: wrong frame, header, length or digest."""


def filesystem(url: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(url) if "://" in url else fs.FileSystem.from_uri("file://" + url)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(kind: str, record_id: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", DATE), *headers,
            ("WARC-Block-Digest", "sha1:" + digest(block)), ("Content-Length", str(len(block)))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in head).encode("utf-8", "replace")
    return VERSION + lines + CRLF + block + CRLF + CRLF


def http_head(length: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers by lower-case name, block) of one decoded record; raises WarcError."""
    if not data.startswith(VERSION):
        raise WarcError("no WARC version line")
    end = data.find(CRLF + CRLF)
    if end < 0:
        raise WarcError("the headers do not end")
    headers = {}
    for line in data[len(VERSION):end].split(CRLF):
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            raise WarcError(f"not a header: {line[:60]!r}")
        headers[name.strip().lower().decode()] = value.strip().decode("utf-8", "replace")
    missing = {"warc-type", "warc-record-id", "warc-date", "content-length"} - headers.keys()
    if missing:
        raise WarcError(f"headers missing: {sorted(missing)}")
    if not headers["content-length"].isdigit():
        raise WarcError("Content-Length is no number")
    start, length = end + 4, int(headers["content-length"])
    if len(data) != start + length + 4 or data[start + length:] != CRLF + CRLF:
        raise WarcError("the block's length is not Content-Length")
    block = data[start:start + length]
    stated = headers.get("warc-block-digest", "")
    if stated and stated != "sha1:" + digest(block):
        raise WarcError("the block differs from its digest")
    return headers, block


def train_dictionary(samples: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """A dictionary from a bounded sample of records; None where too few are there to train one."""
    try:
        return zstandard.train_dictionary(min(DICT_BYTES, sum(map(len, samples)) // 8), samples)
    except (zstandard.ZstdError, ValueError):
        return None


def dictionary_frame(dictionary: zstandard.ZstdCompressionDict) -> bytes:
    body = zstandard.ZstdCompressor(level=9).compress(dictionary.as_bytes())
    return struct.pack("<II", DICT_MAGIC, len(body)) + body


class ArchiveWriter:
    """Archives of one task: a new one starts when the open one holds ``archive_bytes``."""

    def __init__(self, folder: str, archive_bytes: int = ARCHIVE_BYTES, level: int = 3):
        self.fs, self.root = filesystem(folder)
        self.folder, self.archive_bytes, self.level = folder, archive_bytes, level
        self.out: BinaryIO | None = None
        self.waiting: list[bytes] = []
        self.waiting_bytes = self.size = self.records = 0
        self.name = ""

    def add(self, record: bytes) -> Iterator[tuple[str, int, int]]:
        if self.out is None:
            self.waiting.append(record)
            self.waiting_bytes += len(record)
            if self.waiting_bytes >= SAMPLE_BYTES:
                self._open()
        else:
            self._write(record)
        if self.size >= self.archive_bytes:
            yield self._close()

    def finish(self) -> Iterator[tuple[str, int, int]]:
        if self.out is None and self.waiting:
            self._open()
        if self.out is not None:
            yield self._close()

    def _open(self) -> None:
        part = TaskContext.get().partitionId() if TaskContext.get() else 0
        self.name = f"part-{part:05d}-{uuid.uuid4().hex}.warc.zst"
        self.fs.create_dir(self.root, recursive=True)
        self.out = self.fs.open_output_stream(f"{self.root}/{self.name}", compression=None)
        dictionary = train_dictionary(self.waiting)
        self.compressor = zstandard.ZstdCompressor(level=self.level, dict_data=dictionary, write_content_size=True,
                                                   write_checksum=True)
        if dictionary is not None:
            self._put(dictionary_frame(dictionary))
        records, self.waiting, self.waiting_bytes = self.waiting, [], 0
        for r in records:
            self._write(r)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def _write(self, record: bytes) -> None:
        self._put(self.compressor.compress(record))
        self.records += 1

    def _close(self) -> tuple[str, int, int]:
        self.out.close()
        done = (f"{self.folder}/{self.name}", self.records, self.size)
        self.out, self.size, self.records = None, 0, 0
        return done


class _Buffered:
    """Bytes of a stream, read in blocks."""

    def __init__(self, stream: BinaryIO):
        self.stream, self.data, self.ended = stream, b"", False

    def more(self) -> bool:
        block = self.stream.read(READ_BYTES)
        self.ended = not block
        self.data += block
        return bool(block)

    def need(self, n: int) -> bytes:
        while len(self.data) < n:
            if not self.more():
                raise WarcError("the archive ends inside a frame")
        return self.data[:n]

    def take(self, n: int) -> bytes:
        out = self.need(n)
        self.data = self.data[n:]
        return out


def read_records(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of an archive in order, each from a frame of its own.

    Raises WarcError on a truncated or foreign frame, a frame that holds less
    or more than one record, or a wrong header, length or digest.  Skippable
    frames after the first are passed over.  An empty stream has no records.
    """
    source, dictionary, first = _Buffered(stream), None, True
    while source.data or source.more():
        magic = struct.unpack("<I", source.need(4))[0]
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            body = source.take(8 + struct.unpack("<II", source.need(8))[1])[8:]
            if first and magic == DICT_MAGIC:
                if body.startswith(FRAME_MAGIC):
                    try:
                        body = zstandard.ZstdDecompressor().decompress(body)
                    except zstandard.ZstdError as e:
                        raise WarcError(f"damaged dictionary: {e}") from e
                dictionary = zstandard.ZstdCompressionDict(body)
            first = False
            continue
        first = False
        if source.data[:4] != FRAME_MAGIC:
            raise WarcError("not a Zstandard frame")
        decoder = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj()
        parts = []
        try:
            while not decoder.eof:
                if not source.data and not source.more():
                    raise WarcError("the archive ends inside a frame")
                parts.append(decoder.decompress(source.data))
                source.data = decoder.unused_data if decoder.eof else b""
        except zstandard.ZstdError as e:
            raise WarcError(f"damaged frame: {e}") from e
        yield parse_record(b"".join(parts))


def with_revisits(pages: DataFrame, id_col: str = "page_id", text_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """(page_id, url, html, refers_to): refers_to names the response that a revisit repeats, else null.

    Payloads are equal when both SHA-1 and length are.  Of the rows of such a
    group the largest id is the response; of rows that repeat that id too, all
    are responses.  Payloads under ``min_bytes`` are always responses, and so
    are rows without an id.
    """
    payload = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.coalesce(F.col(text_col), F.lit("")).alias("html"),
                        F.sha1(payload).alias("_sha1"), F.octet_length(payload).alias("_bytes"))
    groups = (rows.where(F.col("_bytes") >= min_bytes).groupBy("_sha1", "_bytes")
              .agg(F.max("page_id").alias("_last"), F.count("*").alias("_n")).where("_n > 1").drop("_n"))
    groups = stored(groups, "payloads")
    return (rows.join(groups, ["_sha1", "_bytes"], "left")
            .select("page_id", "url", "html",
                    F.when(F.col("page_id") < F.col("_last"), F.col("_last")).alias("refers_to")))


def write_archives(pages: DataFrame, folder: str | None = None, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write one record per row of ``with_revisits``; returns (path, records, bytes) per archive.

    A response's block is the HTTP head and the payload; a revisit's block is
    the head alone, whose Content-Length still states the full payload.
    """
    folder = folder or shared_folder(pages.sparkSession, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, done = ArchiveWriter(folder, archive_bytes), []
        for b in batches:
            for page_id, url, html, refers in zip(*(b.column(i) for i in range(4)), strict=True):
                payload = html.as_py().encode("utf-8", "replace")
                refers = refers.as_py()
                headers = [("WARC-Payload-Digest", "sha1:" + digest(payload)),
                           ("Content-Type", "application/http; msgtype=response")]
                if url.as_py():
                    headers.append(("WARC-Target-URI", " ".join(url.as_py().split())))
                if refers is not None:
                    headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{record_id(refers)}>")]
                block = http_head(len(payload)) + (b"" if refers is not None else payload)
                kind = "response" if refers is None else "revisit"
                done += writer.add(record_bytes(kind, record_id(page_id.as_py()), headers, block))
        done += writer.finish()
        names, records, sizes = zip(*done, strict=True) if done else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(records, pa.int64()),
                                          pa.array(sizes, pa.int64())], ["path", "records", "bytes"])

    rows = pages.select("page_id", "url", "html", "refers_to")
    return stored(map_arrow(rows, run, "path string, records long, bytes long"), "archives")


def record_id(page_id: int | None) -> str:
    return f"urn:page:{'' if page_id is None else page_id}"


def _page_of(value: str) -> int | None:
    number = value.strip("<>").removeprefix("urn:page:")
    return int(number) if number else None


def checked_payload(headers: dict[str, str], block: bytes) -> tuple[int, str]:
    """(bytes, digest) of the full payload; raises WarcError when block and headers disagree."""
    head, blank, payload = block.partition(CRLF + CRLF)
    lengths = [x.split(b":", 1)[1].strip() for x in head.split(CRLF) if x.lower().startswith(b"content-length:")]
    if not blank or not head.startswith(b"HTTP/") or len(lengths) != 1 or not lengths[0].isdigit():
        raise WarcError("the block has no HTTP head with one Content-Length")
    kind, stated = headers["warc-type"], headers.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind == "response":
        if int(lengths[0]) != len(payload):
            raise WarcError("the payload's length is not the HTTP Content-Length")
        if stated != digest(payload):
            raise WarcError("the payload differs from its digest")
    elif kind == "revisit":
        if payload or "warc-refers-to" not in headers or headers.get("warc-profile") != PROFILE:
            raise WarcError("not a revisit of an identical payload")
    else:
        raise WarcError(f"unexpected record type {kind}")
    return int(lengths[0]), stated


def read_archives(archives: DataFrame) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, path, html) per record.

    html is null for a revisit.  Archives are read where they lie, one stream
    each; an archive with another number of records than was written raises.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, records in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                store, name = filesystem(path)
                found, rows, size = 0, [], 0
                with store.open_input_stream(name, compression=None) as stream:
                    for headers, block in read_records(stream):
                        length, stated = checked_payload(headers, block)
                        kind = headers["warc-type"]
                        body = block[len(block) - length:].decode("utf-8") if kind == "response" else None
                        rows.append((_page_of(headers["warc-record-id"]), headers.get("warc-target-uri"), length,
                                     stated, kind, _page_of(headers["warc-refers-to"]) if kind == "revisit" else None,
                                     path, body))
                        found, size = found + 1, size + len(block)
                        if size > 8 << 20 or len(rows) >= 5000:
                            yield _rows(rows)
                            rows, size = [], 0
                if found != records:
                    raise WarcError(f"{path}: {found} records, {records} written")
                yield _rows(rows)

    n = max(1, archives.count())
    return map_arrow(archives.select("path", "records").repartition(n, "path"), run, _READ)


_READ = ("page_id long, url string, payload_bytes long, payload_digest string, record_type string, "
         "refers_to long, path string, html string")
_TYPES = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
_NAMES = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "path", "html"]


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(_TYPES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], _NAMES)


def archive_round_trip(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives and read them back: one row per page.

    A null html is an empty payload and a null url has no target; an empty
    table writes no archive and gives no row.  Repeated rows are each kept.
    Other columns are ignored.
    """
    return read_archives(write_archives(with_revisits(pages), archive_bytes=archive_bytes))
