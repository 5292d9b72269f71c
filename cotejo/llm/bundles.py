"""Operator 6: WARC archives as seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each of whole records, then a
skippable frame that maps record identifiers to (frame, offset within the
frame's content), then a skippable frame with the seek table: compressed and
decompressed size of each frame, their number and a magic number at the end of
the file.  Any Zstandard reader sees the records one after the other; a reader
of one record takes the footer, the index and one frame.

Bundles are written by tasks into the shared folder, under a name of their own
for each attempt.  A table of the bundles is written by Spark after them, so
what a lost or repeated task left behind is never read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_folder, written

#: Content of a frame and bytes of a bundle at which a new one begins; a record is never divided.
FRAME, BUNDLE, LEAST, LEVEL = 1 << 18, 1 << 26, 0, 3
# Fixed values of the Zstandard seekable format.
_SKIPPABLE, _SEEKABLE = 0x184D2A5E, 0x8F92EAB1
_DATE = "1970-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page(identifier: str) -> int | None:
    return int(identifier[10:-1]) if identifier[10:-1] else None


def _line(value: str | None) -> str:
    """A header value on one line: control characters and blanks as percent signs and hex digits."""
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in value or "")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record; a revisit has the HTTP head only."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Target-URI: {_line(url)}", f"WARC-Date: {_DATE}"]
    head.append(f"WARC-Payload-Digest: sha1:{digest(payload)}")
    if revisit:
        head += [f"WARC-Refers-To: {record_id(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    else:
        block += payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(content: bytes, at: int = 0) -> Iterator[tuple[dict[str, str], dict[str, str], bytes]]:
    """Records of a frame from offset ``at`` on: WARC head, HTTP head, payload."""

    def fields(lines: list[bytes]) -> dict[str, str]:
        return {k.decode().lower(): v.strip().decode() for k, _, v in (x.partition(b":") for x in lines[1:])}

    while at < len(content):
        end = content.index(b"\r\n\r\n", at)
        head = fields(content[at:end].split(b"\r\n"))
        stop = end + 4 + int(head["content-length"])
        http = content.index(b"\r\n\r\n", end + 4)
        yield head, fields(content[end + 4 : http].split(b"\r\n")), content[http + 4 : stop]
        at = stop + 4


class Writer:
    """Writes bundles into a folder; ``done`` has (path, bytes, frames, records) of each."""

    def __init__(self, folder: str, frame: int = FRAME, bundle: int = BUNDLE):
        self.folder, self.frame, self.bundle, self.done = folder, frame, bundle, []
        self.fs, self.inner = pafs.FileSystem.from_uri(folder)
        self.fs.create_dir(self.inner, recursive=True)
        self.out, self.press = None, zstandard.ZstdCompressor(LEVEL)

    def add(self, identifier: str, content: bytes) -> None:
        if self.out is None:
            self.name = f"{uuid.uuid4().hex}.warc.zst"
            self.out, self.size, self.table, self.index, self.held, self.held_size = self.fs.open_output_stream(f"{self.inner}/{self.name}", compression=None), 0, [], [], [], 0
        self.index.append(f"{identifier}\t{len(self.table)}\t{self.held_size}\n")
        self.held.append(content)
        self.held_size += len(content)
        if self.held_size >= self.frame:
            self._flush()
            if self.size >= self.bundle:
                self.close()

    def _put(self, data: bytes, content: int) -> None:
        self.out.write(data)
        self.size += len(data)
        self.table.append((len(data), content))

    def _flush(self) -> None:
        if self.held:
            self._put(self.press.compress(b"".join(self.held)), self.held_size)
            self.held, self.held_size = [], 0

    def close(self) -> None:
        if self.out is None:
            return
        self._flush()
        frames, index = len(self.table), self.press.compress("".join(self.index).encode())
        self._put(struct.pack("<II", _SKIPPABLE, len(index)) + index, 0)
        seek = b"".join(struct.pack("<II", *x) for x in self.table) + struct.pack("<IBI", len(self.table), 0, _SEEKABLE)
        self.out.write(struct.pack("<II", _SKIPPABLE, len(seek)) + seek)
        self.out.close()
        self.done.append((f"{self.folder}/{self.name}", self.size + 8 + len(seek), frames, len(self.index)))
        self.out = None


class Bundle:
    """Reads a bundle: all frames in turn, or one record by its identifier."""

    def __init__(self, path: str):
        fs, inner = pafs.FileSystem.from_uri(path)
        self.file = fs.open_input_file(inner)
        size = self.file.size()
        n, _, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != _SEEKABLE:
            raise ValueError(f"no seek table at the end of {path}")
        table = self.file.read_at(8 * n, size - 9 - 8 * n)
        self.frames, at = [], 0
        for packed, content in struct.iter_unpack("<II", table):
            self.frames.append((at, packed, content))
            at += packed
        self.unpress = zstandard.ZstdDecompressor()

    def frame(self, i: int) -> bytes:
        at, packed, content = self.frames[i]
        return self.unpress.decompress(self.file.read_at(packed, at), max_output_size=content)

    def contents(self) -> Iterator[bytes]:
        """The frames of records; the last entry of the table is the index."""
        return map(self.frame, range(len(self.frames) - 1))

    def index(self) -> dict[str, list[tuple[int, int]]]:
        """Places of the records of each identifier, in the order of the bundle; several where it is repeated."""
        at, packed, _ = self.frames[-1]
        lines = self.unpress.decompressobj().decompress(self.file.read_at(packed - 8, at + 8)).decode().splitlines()
        out: dict[str, list[tuple[int, int]]] = {}
        for k, i, o in (x.split("\t") for x in lines):
            out.setdefault(k, []).append((int(i), int(o)))
        return out

    def records(self, identifier: str) -> list:
        """All records with an identifier; each takes one frame."""
        return [next(parsed(self.frame(i), at)) for i, at in self.index().get(identifier, [])]

    def record(self, identifier: str):
        """The first record with an identifier."""
        i, at = self.index()[identifier][0]
        return next(parsed(self.frame(i), at))

    def close(self) -> None:
        self.file.close()


def write_bundles(pages: DataFrame, folder: str, least: int = LEAST, frame: int = FRAME, bundle: int = BUNDLE) -> DataFrame:
    """Writes a record per row of ``pages`` (page_id, url, html); returns (path, bytes, frames, records) per bundle.

    Of rows with equal payloads of at least ``least`` bytes that with the smallest
    page_id is a response and the others are revisits of it; all smaller ones
    are responses.  A null html is empty.  Rows equal in payload and smallest page_id are
    all responses; a null page_id comes after all others.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("sha", F.sha2("payload", 256))
    first = rows.groupBy("sha").agg(F.min("page_id").alias("first"))
    revisit = ~F.col("page_id").eqNullSafe(F.col("first")) & (F.octet_length("payload") >= least)
    told = rows.join(first, "sha").select("page_id", "url", "payload", "first", revisit.alias("revisit"))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Writer(folder, frame, bundle)
        for batch in it:
            for page, url, data, ref, again in zip(*(c for c in batch.columns)):
                page, ref, again = page.as_py(), ref.as_py(), again.as_py()
                out.add(record_id(page), record(page, url.as_py(), data.as_py(), ref if again else None, again))
        out.close()
        if out.done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out.done)], names=["path", "bytes", "frames", "records"])

    return written(told.mapInArrow(batches, "path string, bytes long, frames long, records long"), "bundles")


def read_bundles(bundles: DataFrame) -> DataFrame:
    """Every record of the bundles: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload.

    Responses are measured anew; length and digest of a revisit's payload are
    those that the record states.  A task reads one bundle, a frame at a time; a very long
    record is a frame of its own.
    """

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        for batch in it:
            for path in batch.column(0).to_pylist():
                source = Bundle(path)
                for content in source.contents():
                    rows = []
                    for head, http, payload in parsed(content):
                        again, stated = head["warc-type"] == "revisit", head["warc-payload-digest"].removeprefix("sha1:")
                        if not again and digest(payload) != stated:
                            raise ValueError(f"payload of {head['warc-record-id']} in {path} does not fit its digest")
                        size = int(http["content-length"]) if again else len(payload)
                        ref = _page(head["warc-refers-to"]) if again else None
                        rows.append((_page(head["warc-record-id"]), head["warc-target-uri"], size, stated, head["warc-type"], ref, None if again else payload))
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=names)
                source.close()

    # A given number of partitions is not merged, however short the paths are.
    spread = bundles.select("path").repartition(max(1, bundles.count()))
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    return spread.mapInArrow(batches, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return read_bundles(write_bundles(pages, new_folder(spark, "archives"))).drop("url", "payload")


SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h
  FROM pages
), f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      CAST((CAST('0x' || substr(h, CAST(i // 4 * 5 + 1 AS INTEGER), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31 AS INTEGER) + 1, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM f
"""
