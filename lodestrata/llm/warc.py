"""WARC archives: a deduplicating writer, and a Spark data source that parses headers first and skips what isn't wanted."""

from __future__ import annotations

import base64
import hashlib
import posixpath
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as pafs

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringStartsWith

from . import storage
from .common import small_batches

EPOCH = "1970-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: A gzip member's extra field with its own length and that of what it holds, so that a reader can step over it.
SKIP = b"sl"
#: Bytes of a member that are unpacked to find its headers, at first.
PEEK = 4096


def base32_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_name(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_of(name: str | None) -> int | None:
    inner = (name or "").removeprefix("<urn:page:").removesuffix(">")
    return int(inner) if inner else None


def member(record: bytes) -> bytes:
    """The record as one gzip member with a skip-length field."""
    pack = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = pack.compress(record) + pack.flush()
    head = 10 + 2 + 4 + 8
    extra = SKIP + struct.pack("<HII", 8, head + len(body) + 8, len(record))
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None = None, revisit: bool = False) -> bytes:
    """A WARC/1.1 response, or a revisit that names the response with the same payload and holds the HTTP headers only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_name(page_id)}", f"WARC-Date: {EPOCH}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe=''.join(chr(c) for c in range(33, 127)))}")
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        lines += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {record_name(refers_to)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_warc(pages: DataFrame, folder: str | None = None, page: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0) -> str:
    """Writes a record for each row and returns the folder's URI; one file a task, named by its partition.

    Of rows with equal payloads of at least least_bytes, those with the largest page_id are responses and the others
    revisits of it; smaller payloads are all responses. Null html is an empty payload, null url leaves out its header, a
    null page_id never is the largest; rows alike in page_id and payload are both responses. The payloads move only if
    the table of repeated digests is too large to send to all executors. An empty table makes no files.
    """
    spark = pages.sparkSession
    small_batches(spark)
    folder = folder or storage.new_folder(spark, "warc")
    payload = F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")
    rows = pages.select(F.col(page).cast("long").alias("page_id"), F.col(url).alias("url"), payload.alias("payload"))
    digest = F.sha1("payload").alias("digest")
    again = rows.select("page_id", digest, F.octet_length("payload").alias("size")).where(F.col("size") >= least_bytes)
    again = again.groupBy("digest").agg(F.max("page_id").alias("target"), F.count("*").alias("n")).where("n > 1 AND target IS NOT NULL").select("digest", "target")
    dealt = rows.select("*", digest).join(again, "digest", "left").select("page_id", "url", "payload", "digest", "target")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        n = 0
        with storage.written(f"{folder}/part-{TaskContext.get().partitionId():06d}.warc.gz") as out:
            for batch in (b for group in ([first], batches) for b in group):
                for at in range(batch.num_rows):
                    page_id, link, body, hexed, target = (batch.column(c)[at].as_py() for c in range(5))
                    revisit = target is not None and target != page_id
                    out.write(member(record(page_id, link, body, base64.b32encode(bytes.fromhex(hexed)).decode(), target, revisit)))
                    n += 1
        yield pa.RecordBatch.from_pydict({"records": [n]}, schema=pa.schema([("records", pa.int64())]))

    dealt.mapInArrow(write, "records long").agg(F.sum("records")).first()
    return folder


COLUMNS = "record_type string, record_id string, target_uri string, date string, refers_to string, payload_digest string, content_type string, http_length long, payload binary, file string, offset long"
HEADERS = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "date": "warc-date", "refers_to": "warc-refers-to", "content_type": "content-type", "payload_digest": "warc-payload-digest"}


@dataclass
class File(InputPartition):
    uri: str


def listed(path: str) -> list[str]:
    """URIs of the archives in a folder, or the one file itself."""
    system, at = (pafs.LocalFileSystem(), storage.local_path(path)) if storage.local_path(path) else pafs.FileSystem.from_uri(path)
    info = system.get_file_info(at)
    if info.type == pafs.FileType.File:
        return [path]
    found = system.get_file_info(pafs.FileSelector(at, recursive=False, allow_not_found=True))
    return sorted(posixpath.join(path, f.base_name) for f in found if f.base_name.endswith((".warc", ".warc.gz")))


def fields(head: bytes) -> dict[str, str]:
    """Header lines by lower-case name."""
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])}


class Wanted:
    """The pushed predicates, as tests of a record's headers."""

    def __init__(self, tests: list) -> None:
        self.tests = tests

    def __call__(self, head: dict[str, str]) -> bool:
        for f in self.tests:
            v = head.get(HEADERS[f.attribute[0]])
            if v is None:
                return False
            if f.attribute[0] == "payload_digest":
                v = v.removeprefix("sha1:")
            match f:
                case EqualTo(value=x) if v != x:
                    return False
                case In(value=x) if v not in x:
                    return False
                case StringStartsWith(value=x) if not v.startswith(x):
                    return False
                case GreaterThan(value=x) if not v > x:
                    return False
                case GreaterThanOrEqual(value=x) if not v >= x:
                    return False
                case LessThan(value=x) if not v < x:
                    return False
                case LessThanOrEqual(value=x) if not v <= x:
                    return False
        return True


def _unpacked(raw: bytes, wanted: int) -> bytes:
    return zlib.decompressobj(31).decompress(raw, wanted)


def records(uri: str, wanted, payloads: bool) -> Iterator[tuple[dict[str, str], bytes | None, int]]:
    """(headers, block or None, offset) of the records whose headers are wanted.

    Headers are parsed first. Members with a skip length are stepped over without unpacking the rest, as are plain
    records, by their Content-Length; other gzip members are unpacked to find their end.
    """
    with storage.opened(uri) as f:
        at = 0
        while head := f.read(24):
            if head[:2] == b"\x1f\x8b":
                size = struct.unpack("<I", head[16:20])[0] if head[3] & 4 and head[12:14] == SKIP else 0
                raw = head + f.read(min(size, PEEK) - 24) if size else b""
                if not size:
                    whole, raw, size = _next_member(f, at)
                else:
                    whole = _unpacked(raw, PEEK)
                    while b"\r\n\r\n" not in whole:
                        if len(raw) < size:
                            raw += f.read(size - len(raw))
                        more = _unpacked(raw, 2 * max(len(whole), 1))
                        if len(more) == len(whole):
                            raise ValueError(f"{uri}: no header's end in the record at {at}")
                        whole = more
                end = whole.index(b"\r\n\r\n")
                told = fields(whole[:end])
                if wanted(told):
                    block = None
                    if payloads:
                        if len(raw) < size:
                            raw += f.read(size - len(raw))
                        whole = zlib.decompressobj(31).decompress(raw)
                        block = whole[end + 4 : end + 4 + int(told["content-length"])]
                    else:
                        block = whole[end + 4 : end + 4 + int(told["content-length"])]
                    yield told, block, at
                at += size
                f.seek(at)
            else:
                text = head
                while b"\r\n\r\n" not in text:
                    if not (more := f.read(PEEK)):
                        if text.strip():
                            raise ValueError(f"{uri}: no header's end in the record at {at}")
                        return
                    text += more
                end = text.index(b"\r\n\r\n")
                told = fields(text[:end])
                size = int(told["content-length"])
                if wanted(told):
                    f.seek(at + end + 4)
                    yield told, f.read(size if payloads else min(size, PEEK)), at
                at += end + 4 + size + 4
                f.seek(at)


def _next_member(f, at: int) -> tuple[bytes, bytes, int]:
    """The gzip member at a place: unpacked, packed and its length."""
    f.seek(at)
    pack, out, raw = zlib.decompressobj(31), [], []
    while not pack.eof:
        if not (some := f.read(1 << 16)):
            raise ValueError(f"the archive ends within the record at {at}")
        raw.append(some)
        out.append(pack.decompress(some))
    packed = b"".join(raw)
    packed = packed[: len(packed) - len(pack.unused_data)]
    return b"".join(out), packed, len(packed)


class WarcReader(DataSourceReader):
    """Options: path; payload (true): whether payload is filled, whose records are then unpacked whole."""

    SUPPORTED = (EqualTo, In, StringStartsWith, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, IsNotNull)

    def __init__(self, options) -> None:
        self.path, self.payloads = options["path"], str(options.get("payload", "true")).lower() == "true"
        self.tests: list = []

    def pushFilters(self, filters: list) -> Iterable:  # noqa: N802
        for f in filters:
            if isinstance(f, self.SUPPORTED) and len(f.attribute) == 1 and f.attribute[0] in HEADERS:
                self.tests.append(f)
            else:
                yield f

    def partitions(self) -> list[File]:
        return [File(uri) for uri in listed(self.path)] or [File("")]

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        if not partition.uri:
            return
        schema = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[k]) for n, k in (x.strip().split(" ") for x in COLUMNS.split(","))])
        rows: list[tuple] = []
        held = 0
        for told, block, at in records(partition.uri, Wanted(self.tests), self.payloads):
            payload, length = None, None
            if told.get("content-type", "").startswith("application/http") and b"\r\n\r\n" in block:
                http, _, payload = block.partition(b"\r\n\r\n")
                length = fields(http).get("content-length")
            elif self.payloads:
                payload = block
            if not self.payloads or told.get("warc-type") == "revisit":
                payload = None
            digest = told.get("warc-payload-digest")
            rows.append((*(told.get(h) for n, h in HEADERS.items() if n not in ("payload_digest", "content_type")), digest and digest.removeprefix("sha1:"), told.get("content-type"), length and int(length), payload, partition.uri, at))
            held += len(payload or b"")
            if len(rows) >= 1000 or held > 1 << 22:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


class WarcSource(DataSource):
    """spark.read.format("lodestrata_warc").load(folder): a row for each record of the archives in a folder."""

    @classmethod
    def name(cls) -> str:
        return "lodestrata_warc"

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)


def read_warc(spark: SparkSession, folder: str, payload: bool = True) -> DataFrame:
    """The archives' records; filters on record_type and other header columns are answered from the headers."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("lodestrata_warc").option("path", folder).option("payload", str(payload).lower()).load()


def pages_of(found: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of records that write_warc made.

    Lengths and digests of responses are those of the payloads read; a payload that doesn't have the digest its header
    names raises. Revisits have those of their headers.
    """
    number = lambda c: F.expr(f"try_cast(regexp_extract({c}, '<urn:page:(-?[0-9]*)>', 1) AS BIGINT)")
    response = F.col("record_type") == "response"

    @F.arrow_udf("string")
    def sha(payloads: pa.Array) -> pa.Array:
        return pa.array([None if p is None else base32_digest(p) for p in payloads.to_pylist()], pa.string())

    seen = found.select(number("record_id").alias("page_id"), F.when(response, F.octet_length("payload")).otherwise(F.col("http_length")).cast("long").alias("payload_bytes"), sha("payload").alias("read"), F.col("payload_digest").alias("told"), "record_type", number("refers_to").alias("refers_to"))
    digest = F.when(F.col("read").isNull() | (F.col("read") == F.col("told")), F.col("told")).otherwise(F.raise_error(F.concat(F.lit("payload differs from its digest: "), "told")))
    return seen.select("page_id", "payload_bytes", digest.alias("payload_digest"), "record_type", "refers_to")
