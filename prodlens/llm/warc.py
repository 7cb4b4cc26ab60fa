"""WARC archives compressed with Zstandard: a writer that stores equal payloads once, and a reader.

An archive starts with a skippable frame that holds the compression dictionary; after it comes one
frame for each record, so that a reader can decode any record by itself. Archives are rows (path,
content), as Spark's binaryFile source gives them, so that they can lie in any store Spark reads.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, sliced

#: Fixed values of the formats.
DICTIONARY_FRAME = 0x184D2A5D
FRAME = 0xFD2FB528
CRLF = b"\r\n"
MANDATORY = ("WARC-Record-ID", "Content-Length", "WARC-Date", "WARC-Type")
RECORD_TYPES = {"warcinfo", "response", "resource", "request", "metadata", "revisit", "conversion", "continuation"}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID = "urn:x-page:"

#: Bytes of records in an archive, about.
ARCHIVE_BYTES = 8 << 20
#: Pages that the dictionary is trained on, at most, and the bytes of it.
SAMPLE_PAGES, DICTIONARY_BYTES = 400, 32 << 10

ARCHIVES = "path string, content binary"
RECORDS = "path string, offset long, record_id string, record_type string, uri string, date string, content_length long, payload binary, payload_bytes long, payload_digest string, refers_to string"


class WarcError(ValueError):
    """An archive or a record that breaks the format."""


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def train(samples: list[bytes]) -> bytes:
    """A dictionary from sample records; with too few to train on, none."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def dictionary_frame(dictionary: bytes) -> bytes:
    """The leading skippable frame, its content compressed where that is shorter."""
    packed = zstandard.ZstdCompressor(level=9).compress(dictionary)
    body = packed if len(packed) < len(dictionary) else dictionary
    return struct.pack("<II", DICTIONARY_FRAME, len(body)) + body


def record(kind: str, record_id: str, uri: str | None, payload: bytes, date: str, refers_to: str | None = None) -> bytes:
    """One record. A revisit has its payload's digest and length, but not the payload."""
    full = kind != "revisit"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if full else http
    named = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", date)]
    named += [("WARC-Target-URI", re.sub(r"[\r\n]", " ", uri))] if uri is not None else []
    named += [("WARC-Payload-Digest", f"sha1:{digest(payload)}"), ("WARC-Block-Digest", f"sha1:{digest(block)}")]
    named += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{refers_to}>")] if refers_to else []
    named += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in named) + CRLF + block + CRLF + CRLF


def frame_end(data: memoryview, at: int) -> int:
    """Where the Zstandard frame that starts at `at` ends, from its header and the headers of its blocks."""
    try:
        if struct.unpack_from("<I", data, at)[0] != FRAME:
            raise WarcError(f"no Zstandard frame at byte {at}")
        flags = data[at + 4]
        single = flags >> 5 & 1
        size_bytes = (single, 2, 4, 8)[flags >> 6]
        at += 5 + (1 - single) + (0, 1, 2, 4)[flags & 3] + size_bytes
        while True:
            head = int.from_bytes(data[at : at + 3], "little")
            if at + 3 > len(data):
                raise WarcError("an archive ends inside a frame")
            at += 3 + (1 if head >> 1 & 3 == 1 else head >> 3)
            if head & 1:
                break
        at += 4 * (flags >> 2 & 1)
    except (struct.error, IndexError):
        raise WarcError("an archive ends inside a frame") from None
    if at > len(data):
        raise WarcError("an archive ends inside a frame")
    return at


@dataclass
class Record:
    offset: int
    headers: dict[str, str]
    block: bytes
    payload: bytes

    def id(self, name: str) -> str | None:
        v = self.headers.get(name.lower())
        return None if v is None else v.strip("<>")


def parse(data: bytes, offset: int = 0) -> Record:
    """A record's headers and block, with its headers, lengths and digests checked."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.split(CRLF)
    if not gap or lines[0] not in (b"WARC/1.0", b"WARC/1.1"):
        raise WarcError(f"no WARC version line at byte {offset}")
    headers: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon or not name or name != name.strip():
            raise WarcError(f"a header line is malformed at byte {offset}")
        headers[name.decode().lower()] = value.strip().decode()
    if missing := [n for n in MANDATORY if n.lower() not in headers]:
        raise WarcError(f"{', '.join(missing)} missing at byte {offset}")
    if headers["warc-type"] not in RECORD_TYPES:
        raise WarcError(f"unknown record type at byte {offset}")
    if not headers["content-length"].isascii() or not headers["content-length"].isdigit():
        raise WarcError(f"Content-Length is no number at byte {offset}")
    n = int(headers["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise WarcError(f"Content-Length is {n}, but the block has {len(rest) - 4} bytes at byte {offset}")
    block, payload = rest[:n], rest[:n]
    if headers.get("content-type", "").startswith("application/http"):
        payload = block.partition(b"\r\n\r\n")[2]
    for name, part in (("warc-block-digest", block), ("warc-payload-digest", payload)):
        said = headers.get(name, "")
        if said.startswith("sha1:") and not (headers["warc-type"] == "revisit" and name == "warc-payload-digest") and said[5:] != digest(part):
            raise WarcError(f"{name} does not match at byte {offset}")
    return Record(offset, headers, block, payload)


def read_archive(content: bytes) -> Iterator[Record]:
    """The records of an archive, decoded one frame at a time with the dictionary of its leading frame."""
    data, at = memoryview(content), 0
    dictionary = None
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == DICTIONARY_FRAME:
        at = 8 + struct.unpack_from("<I", data, 4)[0]
        if at > len(data):
            raise WarcError("the dictionary frame is cut off")
        body = bytes(data[8:at])
        if body[:4] == struct.pack("<I", FRAME):
            body = zstandard.ZstdDecompressor().decompressobj().decompress(body)
        dictionary = zstandard.ZstdCompressionDict(body) if body else None
    decode = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    while at < len(data):
        end = frame_end(data, at)
        try:
            raw = decode.decompressobj().decompress(data[at:end])
        except zstandard.ZstdError as e:
            raise WarcError(f"a frame at byte {at} cannot be decoded: {e}") from e
        yield parse(raw, at)
        at = end


@lru_cache(2)
def compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=6, dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdCompressor(level=6)


def write_archives(records: DataFrame, dictionary: bytes, date: str) -> DataFrame:
    """Archives (path, content) of rows (record_id, uri, payload string, refers_to); a row with refers_to is a revisit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n, out, size, pack = TaskContext.get().partitionId(), 0, [dictionary_frame(dictionary)], 0, compressor(dictionary)

        def archive() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"part-{part:05d}-{n:05d}.warc.zst"]), pa.array([b"".join(out)], pa.binary())], names=["path", "content"])

        for b in sliced(batches):
            for rid, uri, text, to in zip(*(c.to_pylist() for c in b.columns), strict=True):
                frame = pack.compress(record("revisit" if to else "response", rid, uri, (text or "").encode(), date, to))
                out.append(frame)
                size += len(frame)
                if size >= ARCHIVE_BYTES:
                    yield archive()
                    n, out, size = n + 1, out[:1], 0
        if size:
            yield archive()

    return records.select("record_id", "uri", "payload", "refers_to").mapInArrow(run, ARCHIVES)


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """A row for each record of archives (path, content), in the form RECORDS. A broken archive fails the read with its place.

    payload is the stored payload (null for a revisit, or with payloads=False); payload_bytes is the stored payload's
    length and null for a revisit.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RECORDS.split(", ")]
        kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        schema = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in RECORDS.split(", ")])
        for b in sliced(batches, 1):
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows: list[tuple] = []
                for r in read_archive(content):
                    revisit = r.headers["warc-type"] == "revisit"
                    rows.append((path, r.offset, r.id("warc-record-id"), r.headers["warc-type"], r.headers.get("warc-target-uri"), r.headers["warc-date"], len(r.block), None if revisit or not payloads else r.payload, None if revisit else len(r.payload), r.headers.get("warc-payload-digest", "").removeprefix("sha1:") or None, r.id("warc-refers-to")))
                    if len(rows) >= 256:
                        yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*rows, strict=True)), strict=True)), schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*rows, strict=True)), strict=True)), schema)

    return archives.select("path", "content").mapInArrow(run, RECORDS)


def archive_pages(pages: DataFrame, scratch: Scratch, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", id_col: str = "page_id", html_col: str = "html", url_col: str = "url") -> DataFrame:
    """Archives with one record for each page, null html counting as empty, written to the shared folder.

    Of pages with equal html of at least min_bytes bytes the one with the smallest id is the response and the others
    revisit it. Rows that repeat an id and html are equal records: one of them cannot be told from the other, so all are
    responses if that id is the smallest. A null id keeps its record, which revisits the smallest id if there is one.
    """
    rows = pages.select(F.col(id_col).alias("k"), F.col(url_col).alias("uri"), F.coalesce(F.col(html_col), F.lit("")).alias("payload"))
    keyed = rows.select("k", F.sha2("payload", 256).alias("same"), F.octet_length("payload").alias("size"))
    first = scratch.keep(keyed.filter(F.col("size") >= min_bytes).groupBy("same").agg(F.min("k").alias("first"), F.count("*").alias("n")).filter("n > 1").select("same", "first"))
    sample = rows.select("payload").limit(SAMPLE_PAGES).toLocalIterator()
    dictionary = train([r.payload.encode()[:20_000] for r in sample])
    size = F.octet_length("payload")
    joined = rows.withColumn("same", F.when(size >= min_bytes, F.sha2("payload", 256))).join(first, "same", "left")
    to = F.when(F.col("first").isNotNull() & ~F.col("k").eqNullSafe(F.col("first")), F.concat(F.lit(ID), F.col("first").cast("string")))
    records = joined.select(F.concat(F.lit(ID), F.coalesce(F.col("k").cast("string"), F.lit(""))).alias("record_id"), "uri", F.col("payload"), to.alias("refers_to"))
    return scratch.keep(write_archives(records, dictionary, date))


def page_records(pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id") -> DataFrame:
    """Write the pages' archives, read them back, and give each record as a page: id, payload_bytes, payload_digest, record_type, refers_to.

    A revisit's payload_bytes are those of the response it refers to. An empty table gives an empty table.
    """
    scratch = Scratch(pages.sparkSession, "warc")
    read = scratch.keep(read_archives(archive_pages(pages, scratch, min_bytes, id_col=id_col), payloads=False).select("record_id", "record_type", "payload_bytes", "payload_digest", "refers_to"))
    kind = pages.schema[id_col].dataType
    page = lambda c: F.nullif(F.substring(F.col(c), len(ID) + 1, 1 << 20), F.lit("")).cast(kind)
    targets = scratch.keep(read.filter("refers_to is not null").select(F.col("refers_to").alias("target")).distinct())
    sizes = scratch.keep(read.filter("record_type = 'response'").join(targets, F.col("record_id") == F.col("target"), "left_semi").groupBy("record_id").agg(F.min("payload_bytes").alias("full")))
    sizes = sizes.withColumnRenamed("record_id", "target")
    out = read.join(sizes, read.refers_to == sizes.target, "left")
    return out.select(page("record_id").alias(id_col), F.coalesce("payload_bytes", "full").alias("payload_bytes"), "payload_digest", "record_type", page("refers_to").alias("refers_to"))
