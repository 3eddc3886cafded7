"""A content-addressed archive of WARC records.

A record is an exact header (the WARC fields and, for HTTP, the header lines of the message) and a payload. The archive
keeps two tables: ``payloads`` has the bytes of every payload once, by their SHA-256, and ``headers`` has every record's
header bytes as they were, with the digest of its payload. Joining them gives the records back, byte for byte; what is
read is hashed again, so a damaged payload is an error.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
TAIL = b"\r\n\r\n"
#: Payload bytes after which a task passes its records on.
BATCH_BYTES = 16 << 20
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"

#: A record: its place, exact header bytes, payload, and whether the payload follows the header in the file.
RECORDS = "file string, at long, header binary, payload binary, held boolean"
PARSED = "page_id long, record_id string, record_type string, uri string, payload_bytes long, payload_digest string, refers_to_id string"


_KINDS = {"file": pa.string(), "at": pa.int64(), "header": pa.binary(), "payload": pa.binary(), "held": pa.bool_()}


def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Records (file, at, header, payload, held) in batches of bounded size."""
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += len(row[2]) + len(row[3])
        if size >= BATCH_BYTES or len(held) >= 4096:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), _KINDS.values(), strict=True)], names=list(_KINDS))
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), _KINDS.values(), strict=True)], names=list(_KINDS))


class ArchiveError(ValueError):
    """A record or payload that is not what its header or digest says."""


class Archive(NamedTuple):
    headers: DataFrame
    payloads: DataFrame


def base32_sha1(data: Column) -> Column:
    """SHA-1 in upper-case base 32, as WARC digests are written: eight digits for every ten of base 16."""
    hexed = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(hexed, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), _DIGITS, _BASE32)


def _field(name: str, value: Column) -> Column:
    """A header line, or nothing for null. Line breaks, which would end the line, become percent codes."""
    value = F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def capture(pages: DataFrame, least_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """The records of ``pages`` (``page_id, url, html``) without their payloads: ``at, page_id, record_type, header, digest``.

    The payload is the html in UTF-8, null counts as empty. Of records whose equal payloads have ``least_bytes`` at
    least, the one with the smallest ``page_id`` (nulls last; then by url, then by place) is a response, the others
    revisit it. Repeated rows are records of their own. A null id or url has no header line. Only digests are shuffled.
    """
    payload = F.coalesce("html", F.lit("")).cast("binary")
    seen = pages.select(
        F.monotonically_increasing_id().alias("at"), F.col("page_id").cast("long").alias("page_id"), "url",
        F.sha2(payload, 256).alias("digest"), base32_sha1(payload).alias("sha1"), F.octet_length(payload).cast("long").alias("size"),
    )
    uuid = F.md5(F.concat_ws("\x00", F.coalesce(F.col("page_id").cast("string"), F.lit("-")), F.coalesce("url", F.lit("-")), "digest", F.col("at").cast("string")).cast("binary"))
    record_id = F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(uuid, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))
    seen = written(seen.withColumn("record_id", record_id))
    place = F.struct(F.col("page_id").isNull().alias("a"), "page_id", F.col("url").isNull().alias("b"), "url", "at", "record_id")
    firsts = seen.filter(F.col("size") >= least_bytes).groupBy("digest").agg(F.min(place).alias("first"), F.min(F.struct("size", "sha1")).alias("least"), F.max(F.struct("size", "sha1")).alias("most"))
    agreed = F.when(F.col("least") == F.col("most"), F.col("first")).otherwise(F.raise_error(F.lit("different payloads share a SHA-256")))
    joined = seen.join(firsts.select("digest", agreed.alias("first")), "digest", "left")
    revisit = (F.col("size") >= least_bytes) & (F.col("first.at") != F.col("at"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit("\r\n\r\n"))
    length = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("size"))
    kind = F.when(revisit, "revisit").otherwise("response")
    lines = [
        F.lit(VERSION + "\r\n"), _field("WARC-Type", kind), _field("WARC-Record-ID", F.col("record_id")), _field("WARC-Date", F.lit(date)),
        _field("WARC-Target-URI", F.col("url")), _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        _field("WARC-Refers-To", F.when(revisit, F.col("first.record_id"))), _field("WARC-Profile", F.when(revisit, PROFILE)),
        _field("Page-ID", F.col("page_id").cast("string")), _field("Content-Type", F.lit("application/http; msgtype=response")),
        _field("Content-Length", length.cast("string")), F.lit("\r\n"), http,
    ]
    return joined.select("at", "page_id", kind.alias("record_type"), F.concat(*lines).cast("binary").alias("header"), "digest")


def _stored(rows: DataFrame) -> DataFrame:
    """``digest, size, body``: each payload once, compressed; ``rows`` has ``digest, payload``. Copies meet before the shuffle."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            payloads = batch.column(1).cast(pa.binary()).to_pylist()
            columns = [batch.column(0), pa.array([len(p) for p in payloads], pa.int64()), pa.array([press.compress(p) for p in payloads], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["digest", "size", "body"])

    return rows.mapInArrow(pack, "digest string, size long, body binary").dropDuplicates(["digest"])


def store_pages(pages: DataFrame, folder: str, least_bytes: int = 0) -> Archive:
    """Archives one record for every page (:func:`capture`) in ``folder``."""
    spark = pages.sparkSession
    headers = capture(pages, least_bytes)
    headers.select(F.lit("pages").alias("file"), "at", "header", "digest", (F.col("record_type") == "response").alias("held")).write.parquet(f"{folder}/headers")
    payload = F.coalesce("html", F.lit(""))
    _stored(pages.select(F.sha2(payload.cast("binary"), 256).alias("digest"), payload.alias("payload"))).write.option("compression", "none").parquet(f"{folder}/payloads")
    return open_archive(spark, folder)


def store_records(records: DataFrame, folder: str) -> Archive:
    """Archives records as :func:`read_files` gives them; what had no payload in its file keeps none."""
    digest = F.sha2("payload", 256)
    records.select("file", "at", "header", digest.alias("digest"), "held").write.parquet(f"{folder}/headers")
    _stored(records.select(digest.alias("digest"), "payload")).write.option("compression", "none").parquet(f"{folder}/payloads")
    return open_archive(records.sparkSession, folder)


def open_archive(spark: SparkSession, folder: str) -> Archive:
    headers = spark.read.schema("file string, at long, header binary, digest string, held boolean").parquet(f"{folder}/headers")
    return Archive(headers, spark.read.schema("digest string, size long, body binary").parquet(f"{folder}/payloads"))


def restore(archive: Archive) -> DataFrame:
    """``RECORDS``: headers joined to payloads again. A payload that is missing or not what its digest says is an error.

    Both sides of the join are shuffled, so that a payload of very many records is split among tasks.
    """
    joined = archive.headers.join(archive.payloads.hint("merge"), "digest", "left").select("file", "at", "header", "digest", "held", "size", "body")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor()

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for file, at, header, digest, held, size, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if body is None:
                        raise ArchiveError(f"no payload {digest}")
                    payload = open_.decompress(body, max_output_size=max(size, 1))
                    if len(payload) != size or hashlib.sha256(payload).hexdigest() != digest:
                        raise ArchiveError(f"the payload {digest} is damaged")
                    yield file, at, header, payload, held

        yield from _batches(rows())

    return joined.mapInArrow(unpack, RECORDS)


def record_bytes(records: DataFrame) -> DataFrame:
    """``file, at, record``: the bytes of each record with the two empty lines behind it."""
    return records.select("file", "at", F.concat("header", F.when(F.col("held"), F.col("payload")).otherwise(F.lit(b"")), F.lit(TAIL)).alias("record"))


def _fields(header: bytes) -> dict[bytes, bytes]:
    lines = header.split(b"\r\n\r\n", 1)[0].split(b"\r\n")
    return {k.strip().lower(): v.strip() for k, v in (line.split(b":", 1) for line in lines[1:] if b":" in line)}


def parse(records: DataFrame) -> DataFrame:
    """``PARSED`` from the bytes of restored records: lengths and digests are computed anew and held against the header."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_parsed(h, p, held) for h, p, held in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True)]
            kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
            names = [f.split()[0] for f in PARSED.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    return records.select("file", "at", "header", "payload", "held").mapInArrow(scan, PARSED)


def _parsed(header: bytes, payload: bytes, held: bool) -> tuple:
    fields = _fields(header)
    text = lambda name: fields[name].decode("utf-8", "replace") if name in fields else None
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    told = text(b"warc-payload-digest")
    block = len(header) - header.index(TAIL) - len(TAIL) + (len(payload) if held else 0)
    if block != int(fields[b"content-length"]):
        raise ArchiveError(f"record {text(b'warc-record-id')} has {block} bytes instead of {text(b'content-length')}")
    if held and told is not None and told.lower().startswith("sha1:") and told[5:] != digest:
        raise ArchiveError(f"record {text(b'warc-record-id')} has another payload than its digest says")
    page = text(b"page-id")
    return page and int(page), text(b"warc-record-id"), text(b"warc-type"), text(b"warc-target-uri"), len(payload), digest, text(b"warc-refers-to")


def resolve_revisits(parsed: DataFrame) -> DataFrame:
    """Adds ``refers_to``: the ``page_id`` of the record that a revisit names, null for others."""
    named = parsed.filter("record_type = 'response'").select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"))
    return parsed.join(named, "refers_to_id", "left")


def write_files(records: DataFrame, path: str, most_records: int = 10_000) -> None:
    """The records as WARC files of ``most_records`` at most, in the order of ``file, at`` within each task's range."""
    rows = record_bytes(records).repartitionByRange("file", "at").sortWithinPartitions("file", "at")
    whole = F.substring("record", F.lit(1), F.octet_length("record") - len(TAIL))  # the line separator puts it back
    rows.select(whole.cast("string").alias("value")).write.option("lineSep", TAIL.decode()).option("maxRecordsPerFile", most_records).text(path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """``RECORDS`` of WARC files, plain or gzipped by record or whole; a file of more than 2 GB can't be read.

    The header takes in the HTTP header of ``application/http`` blocks, so payloads are equal whatever a server said
    about them. Revisits and other records without a block have an empty payload. A broken record is an error.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = (f for batch in batches for f in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        yield from _batches((file, at, header, payload, True) for file, content in files for at, header, payload in split_records(_plain(content)))

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(scan, RECORDS)


def _plain(content: bytes) -> bytes:
    if content[:2] != b"\x1f\x8b":
        return content
    out = []
    while content:
        member = zlib.decompressobj(31)
        out.append(member.decompress(content) + member.flush())
        if not member.eof:
            raise ArchiveError("a gzip member ends early")
        content = member.unused_data
    return b"".join(out)


def split_records(content: bytes) -> Iterator[tuple[int, bytes, bytes]]:
    """Offset, header and payload of every record of a WARC file."""
    at = 0
    while at < len(content):
        end = content.find(TAIL, at)
        if end < 0 or not content.startswith(b"WARC/", at):
            raise ArchiveError(f"no record at {at}")
        fields = _fields(content[at:end])
        start, length = end + len(TAIL), int(fields.get(b"content-length", -1))
        if length < 0 or content[start + length : start + length + len(TAIL)] != TAIL:
            raise ArchiveError(f"the record at {at} has no or a wrong length")
        body = start
        if fields.get(b"content-type", b"").startswith(b"application/http"):
            close = content.find(TAIL, start, start + length)
            body = close + len(TAIL) if close >= 0 else start + length
        yield at, content[at:body], content[body : start + length]
        at = start + length + len(TAIL)
