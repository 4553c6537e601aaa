"""A converter of legacy archives (ARC) to WARC, and a reader of both.

An ARC file begins with a version block that names the fields of its record headers; version 1 headers have URL, IP
address, date, type and length, version 2 headers also result code, checksum, location, offset and file name. Each header
line is followed by as many bytes as it declares. For each record the converter synthesises what WARC wants and ARC
lacks: a record identifier (a name-based UUID of what the ARC header says, so that reruns agree), an ISO time, a record type
and payload digests.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, remove, work_dir

# Fixed values of the two formats.
ARC_FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
WARC_VERSION = "WARC/1.0"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
#: Names the identifiers of records.
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:lexforge:arc")
#: Bytes of a file that is written, unless one record has more.
FILE_BYTES = 16 << 20
#: Digests of repeated payloads, with what they are repeats of, that may be broadcast: about 20 MB.
DIGESTS_SENT = 200_000
#: A gzip member without content. Text writers put one after each file, as they must end lines with something.
EMPTY_MEMBER = b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\x03\x03\x00" + bytes(8)


class ArchiveError(ValueError):
    """A record that does not keep to its format."""


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes
    version: int = 0
    http: dict[str, str] = field(default_factory=dict)
    payload: bytes = b""


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def split_http(block: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and body of an HTTP response; a block that is none is all body."""
    if not block.startswith(b"HTTP/"):
        return {}, block
    head, found, body = block.partition(b"\r\n\r\n")
    if not found:
        return {}, block
    lines = head.decode("latin-1").split("\r\n")
    return {"": lines[0], **{k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}}, body


class Stream:
    """Lines and stretches of an archive, plain or gzipped, of which as much is unpacked as is asked for."""

    def __init__(self, data: bytes):
        self.at, self.have, self.pieces = 0, bytearray(), self._pieces(data)

    @staticmethod
    def _pieces(data: bytes, step: int = 1 << 18) -> Iterator[bytes]:
        if not data.startswith(b"\x1f\x8b"):
            yield data
            return
        at, view = 0, memoryview(data)
        while data.startswith(b"\x1f\x8b", at):
            member = zlib.decompressobj(31)
            while not member.eof and at < len(data):
                part = view[at : at + step]
                out = member.decompress(part)
                at += len(part) - len(member.unused_data)
                yield out
            if not member.eof:
                raise ArchiveError(f"gzip member before {at} has no end")
            while data.startswith(b"\0", at):  # padding
                at += 1

    def fill(self, n: int) -> bool:
        """Are ``n`` bytes there?"""
        while len(self.have) < n:
            piece = next(self.pieces, None)
            if piece is None:
                return False
            self.have += piece
        return True

    def find(self, what: bytes) -> int:
        """Where ``what`` begins, from here; -1 if it does not come."""
        start = 0
        while (k := self.have.find(what, start)) < 0:
            start = max(0, len(self.have) - len(what) + 1)
            if not self.fill(len(self.have) + 1):
                return -1
        return k

    def take(self, n: int) -> bytes:
        out = bytes(self.have[:n])
        del self.have[:n]
        self.at += n
        return out


# --- ARC


def arc_url(url: str | None) -> str:
    """A URL that can stand in a header line: white space and control characters are escaped, none is ``-``."""
    return re.sub(r"[\x00-\x20\x7f]|[^\x00-\x7f]", lambda m: quote(m[0].encode("utf-8", "surrogatepass")), url or "") or "-"


def arc_file(version: int, records: Iterator[tuple[str, str, str, str, bytes]], name: str = "pages.arc") -> Iterator[bytes]:
    """An ARC file of (URL, IP, 14-digit date, type, block), as its parts: the version block, then each record."""
    fields = " ".join(ARC_FIELDS[version])
    text = f"{version} {0 if version == 1 else 1} lexforge\n{fields}\n".encode()
    tail = f"text/plain {len(text)}" if version == 1 else f"text/plain 200 - - 0 {name} {len(text)}"
    part = f"filedesc://{name} 0.0.0.0 19960923142103 {tail}\n".encode() + text + b"\n"
    offset = len(part)
    yield part
    for url, ip, date, kind, block in records:
        tail = f"{len(block)}" if version == 1 else f"200 {hashlib.md5(block, usedforsecurity=False).hexdigest()} - {offset} {name} {len(block)}"
        part = f"{url} {ip} {date} {kind} {tail}\n".encode() + block + b"\n"
        offset += len(part)
        yield part


def parse_arc(data: bytes) -> Iterator[Record]:
    """The records of an ARC file, gzipped or not, by the header fields of its version and the declared lengths. Blank lines
    between records are skipped; a header that has other fields than its version's, or a length that goes past the end, is an
    error. Fields are parted by single spaces from the right, as URLs of old archives may hold some."""
    stream, version = Stream(data), 0
    while stream.fill(1):
        if stream.have[:1] in (b"\n", b"\r"):
            stream.take(1)
            continue
        at, end = stream.at, stream.find(b"\n")
        if end < 0:
            raise ArchiveError(f"header line at {at} has no end")
        line = stream.take(end + 1).rstrip(b"\r\n").decode("utf-8", "replace")
        names = ARC_FIELDS[version or (1 if line.count(" ") == len(ARC_FIELDS[1]) - 1 else 2)]
        parts = line.rsplit(" ", len(names) - 1)
        if len(parts) != len(names) or not parts[-1].isdigit():
            raise ArchiveError(f"header line at {at} is not of version {version or '1 or 2'}: {line[:80]!r}")
        length = int(parts[-1])
        if not stream.fill(length):
            raise ArchiveError(f"record at {at} declares {length} bytes; {len(stream.have)} are left")
        block = stream.take(length)
        if not version:
            first = block.split(b"\n", 1)[0].split(b" ")[0]
            if not line.startswith("filedesc://") or first not in (b"1", b"2"):
                raise ArchiveError("the file does not begin with a version block")
            version = int(first)
            continue
        yield Record(dict(zip(names, parts, strict=True)), block, version)


def iso_time(date: str) -> str:
    """ISO time of an ARC date of 14 digits, or of 12 (no seconds); others are an error."""
    if not re.fullmatch(r"\d{12}(\d\d)?", date):
        raise ArchiveError(f"date {date!r}")
    d = date.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(record: Record) -> str:
    """The identifier synthesised for an ARC record: of its URL, date and the key it carries, if any."""
    http, payload = split_http(record.block)
    own = http.get("x-page-id", "")
    return uuid_of(record.headers["URL"], record.headers["Archive-date"], own if own else digest(payload))


def uuid_of(url: str, date: str, own: str) -> str:
    return f"urn:uuid:{uuid.uuid5(NAMESPACE, f'{url} {date} {own}')}"


def convert(record: Record, refers_to: str | None = None) -> tuple[dict[str, str], bytes]:
    """WARC headers and block of an ARC record. ``refers_to`` makes it a revisit of that record: its block then ends with
    the HTTP headers, while its payload digest is still that of the full payload."""
    http, payload = split_http(record.block)
    # What is no HTTP response is kept whole, as the resource it is.
    kind = "revisit" if refers_to else "response" if http else "resource"
    block = record.block[: len(record.block) - len(payload)] if refers_to else record.block
    headers = {
        "WARC-Type": kind,
        "WARC-Record-ID": f"<{record_id(record)}>",
        "WARC-Date": iso_time(record.headers["Archive-date"]),
        "WARC-Target-URI": record.headers["URL"],
        "WARC-IP-Address": record.headers["IP-address"],
        "WARC-Payload-Digest": f"sha1:{digest(payload)}",
        "WARC-Block-Digest": f"sha1:{digest(block)}",
        "Content-Type": "application/http; msgtype=response" if http else record.headers["Content-type"],
        "Content-Length": str(len(block)),
    }
    if record.headers["IP-address"] in ("0.0.0.0", "-"):
        del headers["WARC-IP-Address"]
    if refers_to:
        headers |= {"WARC-Refers-To": f"<{refers_to}>", "WARC-Profile": REVISIT_PROFILE}
    return headers, block


# --- WARC


def warc_bytes(headers: dict[str, str], block: bytes) -> bytes:
    """A record without the two line ends that close it."""
    return (WARC_VERSION + "\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers.items()) + "\r\n").encode() + block


def parse_warc(data: bytes) -> Iterator[Record]:
    """The records of a WARC file, gzipped or not, by the declared lengths, whatever a block may hold."""
    stream = Stream(data)
    while stream.fill(1):
        at, end = stream.at, stream.find(b"\r\n\r\n")
        if end < 0 or not stream.have.startswith(b"WARC/"):
            if end < 0 and not bytes(stream.have).strip():
                return
            raise ArchiveError(f"no record at {at}")
        lines = stream.take(end + 4).decode("utf-8", "replace").split("\r\n")
        headers = {k.strip(): v.strip() for k, found, v in (x.partition(":") for x in lines[1:]) if found}
        length = int(headers["Content-Length"])
        if not stream.fill(length):
            raise ArchiveError(f"record at {at} declares {length} bytes; {len(stream.have)} are left")
        block = stream.take(length)
        http, payload = split_http(block)
        yield Record(headers, block, 0, http, payload)
        for _ in range(2):
            if stream.fill(2) and stream.have.startswith(b"\r\n"):
                stream.take(2)


# --- files


def member(data: bytes) -> bytes:
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def in_files(parts: Iterator[bytes], first: bytes = b"") -> Iterator[bytes]:
    """Contents of files of about ``FILE_BYTES``, of packed records; each begins with ``first``."""
    held, size = [first], len(first)
    for part in parts:
        if size + len(part) > FILE_BYTES and len(held) > 1:
            yield b"".join(held)
            held, size = [first], len(first)
        held.append(part)
        size += len(part)
    if len(held) > 1:
        yield b"".join(held)


def write_files(contents: DataFrame, path: str) -> None:
    """Write each row's bytes (``value``) as a file of its own. They are cast to a string, which a text writer writes as it is."""
    lines = contents.select(F.col("value").cast("string").alias("value"))
    lines.write.option("lineSep", EMPTY_MEMBER.decode("latin-1")).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", 1).text(path)


def read_files(spark, path: str, parse: Callable[[bytes], Iterator[Record]], row: Callable[[Record], tuple], schema: pa.Schema, ddl: str) -> DataFrame:
    """A row for each record of the archives in a folder. A file is read in one task, as a whole, and unpacked record by
    record; files of more than 2 GB are beyond the reader of binary files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where("length > 0").select("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for r in parse(content.as_py()):
                    rows.append(row(r))
                    size += len(r.block)
                    if len(rows) == 512 or size > 4 << 20:
                        yield batch_of(rows)
                        rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    return files.mapInArrow(run, ddl)


# --- tables


def write_arc(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html", date: str = "20240101000000") -> None:
    """Write a legacy archive of pages: an ARC record for each row, its key in a header of its HTTP response. Files of both
    versions are written, a gzip member for each record. A null payload is empty."""
    rows = pages.select(F.col(key).cast("string").alias("k"), F.col(url).cast("string").alias("u"), F.coalesce(F.col(html).cast("string"), F.lit("")).alias("p"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, batch in enumerate(batches):
            version = 1 + number % 2

            def records(batch=batch) -> Iterator[tuple[str, str, str, str, bytes]]:
                for k, u, p in zip(*batch.columns, strict=True):
                    body = p.as_py().encode("utf-8", "surrogatepass")
                    own = "" if k.as_py() is None else k.as_py()
                    head = f"HTTP/1.0 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page-Id: {own}\r\nContent-Length: {len(body)}\r\n\r\n"
                    yield arc_url(u.as_py()), "0.0.0.0", date, "text/html", head.encode() + body

            parts = map(member, arc_file(version, records()))
            first = next(parts)
            for content in in_files(parts, first):
                yield pa.RecordBatch.from_arrays([pa.array([content], pa.binary())], ["value"])

    write_files(rows.mapInArrow(run, "value binary"), path)


def read_arc(spark, path: str) -> DataFrame:
    """The records of the ARC archives in a folder, of either version, gzipped or not: ``version`` int, ``url``, ``ip``, ``date``,
    ``content_type``, ``result_code`` (null in version 1), ``record_id`` (as the converter synthesises it), ``page_id`` (what the
    response says of it, or null), ``payload_digest`` (bare base32 SHA-1), ``payload_bytes`` long and ``block`` binary (HTTP
    headers and payload, as declared)."""
    names = ["version", "url", "ip", "date", "content_type", "result_code", "record_id", "page_id", "payload_digest", "payload_bytes", "block"]
    schema = pa.schema(list(zip(names, [pa.int32(), *[pa.string()] * 8, pa.int64(), pa.binary()], strict=True)))

    def row(r: Record) -> tuple:
        http, payload = split_http(r.block)
        h = r.headers
        code = h.get("Result-code")
        return r.version, h["URL"], h["IP-address"], h["Archive-date"], h["Content-type"], code, record_id(r), http.get("x-page-id") or None, digest(payload), len(payload), r.block

    strings = ", ".join(f"{c} string" for c in names[1:9])
    return read_files(spark, path, parse_arc, row, schema, f"version int, {strings}, payload_bytes bigint, block binary")


def convert_archives(spark, source: str, path: str, least: int = 0, order: Column | None = None) -> None:
    """Convert the ARC archives in the folder ``source`` to WARC files in ``path``, a record for each.

    Of records with equal payloads of at least ``least`` bytes, the one that is last in ``order`` (of the columns of ``read_arc``;
    by default the date, then the URL) is written whole and the others are revisits of it; records with its identifier
    are written whole too. What repeats is sent to the records while it is small; else payloads are moved once, to where
    equal ones meet."""
    records = read_arc(spark, source)
    rank = F.struct((order if order is not None else F.struct("date", "url")).alias("rank"), F.col("record_id").alias("id"))
    # The first of each payload, summed per task before the shuffle; a hot payload is one row here.
    best = records.where(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.max(rank).alias("best"), F.count(F.lit(1)).alias("n"))
    best = durable(best.where("n > 1").select("payload_digest", F.col("best.id").alias("best_id")), "repeated")
    best = F.broadcast(best) if best.count() <= DIGESTS_SENT else best
    names = ["version", "url", "ip", "date", "content_type", "block"]
    joined = records.join(best, "payload_digest", "left").select(*names, F.when(F.col("best_id") != F.col("record_id"), F.col("best_id")).alias("refers"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed() -> Iterator[bytes]:
            for batch in batches:
                for version, url, ip, date, kind, block, refers in zip(*batch.columns, strict=True):
                    fields = {"URL": url.as_py(), "IP-address": ip.as_py(), "Archive-date": date.as_py(), "Content-type": kind.as_py()}
                    headers, out = convert(Record(fields, block.as_py(), version.as_py()), refers.as_py())
                    yield member(warc_bytes(headers, out) + b"\r\n\r\n")

        for content in in_files(packed()):
            yield pa.RecordBatch.from_arrays([pa.array([content], pa.binary())], ["value"])

    write_files(joined.mapInArrow(run, "value binary"), path)


def to_warc(pages: DataFrame, path: str, least: int = 0, key: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Write a WARC record for each row: pages are written as a legacy archive, which is read from storage and converted.

    Of records with equal payloads of at least ``least`` bytes, the one with the largest key is the response, and the
    others are revisits of it; null keys come before all others. A null payload is empty."""
    spark = pages.sparkSession
    legacy = f"{work_dir(spark)}/arc-{uuid.uuid4().hex}"
    write_arc(pages, legacy, key, url, html)
    kind = pages.schema[key].dataType.simpleString()
    convert_archives(spark, legacy, path, least, F.struct(F.col("page_id").cast(kind).alias("k"), F.col("url").alias("u")))
    remove(spark, legacy)


def read_warc(spark, path: str) -> DataFrame:
    """The records of the WARC files in a folder: ``record_id``, ``record_type``, ``refers_to_id``, ``target_uri``,
    ``warc_date``, ``payload_digest`` (without its label), ``page_id`` string (null if the response has none),
    ``payload_bytes`` long (of the full payload, for revisits as the HTTP headers declare it), ``payload`` binary (as
    stored, so empty for revisits)."""
    names = ["record_id", "record_type", "refers_to_id", "target_uri", "warc_date", "payload_digest", "page_id", "payload_bytes", "payload"]
    schema = pa.schema(list(zip(names, [*[pa.string()] * 7, pa.int64(), pa.binary()], strict=True)))

    def row(r: Record) -> tuple:
        h = r.headers
        strip = lambda v: v and v.strip("<>")
        size = int(r.http.get("content-length", len(r.payload))) if h["WARC-Type"] == "revisit" else len(r.payload)
        told = h.get("WARC-Payload-Digest")
        return strip(h["WARC-Record-ID"]), h["WARC-Type"], strip(h.get("WARC-Refers-To")), h.get("WARC-Target-URI"), h["WARC-Date"], told and told.removeprefix("sha1:"), r.http.get("x-page-id") or None, size, r.payload

    strings = ", ".join(f"{c} string" for c in names[:7])
    return read_files(spark, path, parse_warc, row, schema, f"{strings}, payload_bytes bigint, payload binary")


def archive_pages(pages: DataFrame, least: int = 0, key: str = "page_id", url: str = "url", html: str = "html", path: Callable[[], str] | None = None) -> DataFrame:
    """Write pages as WARC, read the archives back, and say what became of each page.

    Returns ``key``, ``payload_bytes`` long, ``payload_digest`` (bare base32 SHA-1 of the full payload), ``record_type``
    (``response`` or ``revisit``) and ``refers_to`` (the key of the response that a revisit names, else null). All
    from the records as read back. Rows that repeat a key and a URL are written once each; those equal to the response
    in key, URL and payload count as responses. Null payloads are empty; null keys come back as null.
    """
    spark = pages.sparkSession
    where = path() if path else f"{work_dir(spark)}/warc-{uuid.uuid4().hex}"
    to_warc(pages, where, least, key, url, html)
    kind = pages.schema[key].dataType.simpleString()
    records = read_warc(spark, where).drop("payload")
    named = records.where("record_type != 'revisit'").select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to")).dropDuplicates(["refers_to_id"])
    # A record that refers to none looks itself up, so that these do not meet in one task.
    is_revisit = F.col("record_type") == "revisit"
    records = records.withColumn("refers_to_id", F.when(is_revisit, F.col("refers_to_id")).otherwise(F.col("record_id")))
    out = records.join(named, "refers_to_id", "left").withColumn("refers_to", F.when(is_revisit, F.col("refers_to")))
    return out.select(F.col("page_id").cast(kind).alias(key), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))
