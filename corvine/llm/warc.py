"""Legacy archive converter: ARC records to WARC records, and a reader for both.

ARC headers are parsed by the version that the archive's first record declares (one
line of five fields in version 1, of ten in version 2) and content is taken by its
declared length. WARC identifiers, timestamps, types and digests are synthesised from
that alone, so that converting again gives the same bytes.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvine.session import materialize

#: An archive is closed at so many bytes of content, so a task holds one at a time.
ARCHIVE_BYTES = 8 << 20
#: Payloads below this are never revisits.
LEAST_REVISIT = 100
PAGE_HEADER = "X-Page-Id"
REFERS_PAGE = "X-Refers-To-Page-Id"
#: Compressed bytes that the reader takes at a time.
READ_BYTES = 1 << 14
# Fixed values of the two formats.
ARC_FIELDS = {1: "URL IP-address Archive-date Content-type Archive-length", 2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass
class ArcRecord:
    url: str
    ip: str
    date: str  # YYYYMMDDhhmmss
    content_type: str
    content: bytes
    more: dict[str, str] = field(default_factory=dict)  # version 2's further fields


def _clean(s: str) -> str:
    """Header fields are parted by spaces: white space and controls are escaped."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", s) or "-"


def write_arc(records: list[ArcRecord], name: str, version: int = 1) -> bytes:
    """An ARC archive: its version block, then header line, content, line feed."""
    block = f"{version} 0 corvine\n{ARC_FIELDS[version]}\n\n".encode()
    first = ArcRecord(f"filedesc://{_clean(name)}", "0.0.0.0", records[0].date if records else "20000101000000", "text/plain", block)
    out = []
    for r in [first, *records]:
        fields = [_clean(r.url), _clean(r.ip), r.date, _clean(r.content_type)]
        if version == 2:
            fields += [_clean(r.more.get(k, "-")) for k in ("result", "checksum", "location", "offset")] + [_clean(name)]
        out += [" ".join([*fields, str(len(r.content))]).encode(), b"\n", r.content, b"\n"]
    return b"".join(out)


def parse_arc(raw: bytes) -> Iterator[ArcRecord]:
    """The records after the version block. Raises ValueError at a header that doesn't
    have its version's fields or a length beyond the archive."""
    at, version = 0, 0
    while at < len(raw):
        if raw[at : at + 1] == b"\n":  # between records
            at += 1
            continue
        end = raw.find(b"\n", at)
        if end < 0:
            raise ValueError("ARC header line without an end")
        line = raw[at:end].decode("utf-8", "surrogateescape").rstrip("\r")
        # The URL may hold spaces in archives of others: fields count from the right.
        parts = line.rsplit(" ", 4 if version < 2 else 9)
        if version == 0 and line.startswith("filedesc://") and len(line.split(" ")) == 10:
            parts = line.split(" ")
        if len(parts) != (10 if version == 2 or len(parts) == 10 else 5) or not parts[-1].isdigit() or not re.fullmatch(r"\d{14}|\d{12}|\d{8}", parts[2]):
            raise ValueError(f"not an ARC header of version {version or 1}: {line[:200]!r}")
        n = int(parts[-1])
        at = end + 1
        if at + n > len(raw):
            raise ValueError("ARC record longer than its archive")
        content = raw[at : at + n]
        at += n
        if version == 0:
            version = int(content[:1]) if content[:1] in (b"1", b"2") else 0
            if not version:
                raise ValueError("unknown ARC version")
            continue
        more = dict(zip(("result", "checksum", "location", "offset", "filename"), parts[4:9], strict=False)) if version == 2 else {}
        yield ArcRecord(parts[0], parts[1], parts[2], parts[3], content, more)


def split_http(content: bytes) -> tuple[bytes, bytes]:
    """Status line and headers (with the empty line), and payload."""
    at = content.find(b"\r\n\r\n")
    return (content[: at + 4], content[at + 4 :]) if content.startswith(b"HTTP/") and at >= 0 else (b"", content)


def http_header(head: bytes, name: str) -> str | None:
    m = re.search(rb"(?im)^" + re.escape(name.encode()) + rb":[ \t]*([^\r\n]*)", head)
    return m[1].decode("utf-8", "replace") if m else None


def iso_date(date: str) -> str:
    """14, 12 or 8 digits of an ARC date as a WARC timestamp."""
    d = date.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(*parts: str) -> str:
    """An identifier that depends on the parts alone."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256('\0'.join(parts).encode('utf-8', 'surrogateescape')).digest()[:16], version=5)}>"


@dataclass
class WarcRecord:
    headers: dict[str, str]
    block: bytes

    def render(self) -> bytes:
        lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in self.headers.items()), f"Content-Length: {len(self.block)}"]
        return "\r\n".join(lines).encode("utf-8", "surrogateescape") + b"\r\n\r\n" + self.block + b"\r\n\r\n"


def to_warc(r: ArcRecord, refers_to: tuple[str, str] | None = None) -> WarcRecord:
    """The WARC record of an ARC record. With ``refers_to`` (page and URL of the response
    with an equal payload, of the same date) a revisit: the HTTP headers without the
    payload, and that record's identifier, URL and date."""
    head, payload = split_http(r.content)
    digest = hashlib.sha256(payload).hexdigest()
    page = http_header(head, PAGE_HEADER) or ""
    kind = "revisit" if refers_to is not None else "response" if head else "resource"
    block = head if kind == "revisit" else r.content
    h = {
        "WARC-Type": kind,
        "WARC-Record-ID": record_id(page, r.url, r.date, digest),
        "WARC-Date": iso_date(r.date),
        "WARC-Target-URI": r.url,
        "WARC-IP-Address": r.ip,
        "WARC-Payload-Digest": f"sha256:{digest}",
        "WARC-Block-Digest": "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode(),
        "Content-Type": "application/http; msgtype=response" if head else r.content_type,
    }
    if kind == "revisit":
        page, url = refers_to
        h |= {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": record_id(page, url, r.date, digest), "WARC-Refers-To-Target-URI": url, "WARC-Refers-To-Date": iso_date(r.date), REFERS_PAGE: page}
    return WarcRecord(h, block)


def write_warc(records: list[WarcRecord]) -> bytes:
    """A .warc.gz: each record a gzip member of its own, readable from any of them."""
    return b"".join(gzip.compress(r.render(), 6, mtime=0) for r in records)


def read_warc(raw: bytes) -> Iterator[WarcRecord]:
    """The records of a .warc.gz. Raises ValueError where it isn't one."""
    rest, read = memoryview(raw), 0
    while read < len(raw):
        z, got = zlib.decompressobj(31), []
        while not z.eof:
            if read >= len(raw):
                raise ValueError("gzip member without an end")
            got.append(z.decompress(rest[read : read + READ_BYTES]))
            read = min(read + READ_BYTES, len(raw))
        read -= len(z.unused_data)
        data = b"".join(got)
        at = data.find(b"\r\n\r\n")
        if not data.startswith(b"WARC/") or at < 0:
            raise ValueError("not a WARC record")
        lines = data[:at].decode("utf-8", "surrogateescape").split("\r\n")[1:]
        headers = dict(x.split(": ", 1) for x in lines)
        n = int(headers.pop("Content-Length"))
        if len(data) != at + 4 + n + 4:
            raise ValueError("WARC record of another length than declared")
        yield WarcRecord(headers, data[at + 4 : at + 4 + n])


def _page_url(page: str, url: str | None) -> str:
    return _clean(url or f"urn:page:{page}")


def _page_record(page: str, url: str | None, html: bytes, date: str) -> ArcRecord:
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{PAGE_HEADER}: {page}\r\nContent-Length: {len(html)}\r\n\r\n"
    return ArcRecord(_page_url(page, url), "0.0.0.0", date, "text/html", head.encode() + html, {"result": "200"})


def mark_revisits(pages: DataFrame) -> DataFrame:
    """Add payload_digest, refers_to (the smallest page_id of an equal payload of at
    least LEAST_REVISIT bytes, null for that page itself and for single payloads) and
    refers_url, that page's URL.

    Only digests and ids are aggregated, with partial minima before the shuffle. The
    table of repeated digests is written, so its size is known: the pages, which carry
    the payloads, are shuffled only if it is too large to broadcast, and then Spark can
    split a digest that many pages share.
    """
    body = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    p = pages.select("page_id", "url", body.alias("payload")).withColumn("payload_digest", F.sha2("payload", 256))
    long = p.where(F.octet_length("payload") >= LEAST_REVISIT)
    firsts = long.groupBy("payload_digest").agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("first"), F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) & F.col("first").isNotNull())
    firsts = materialize(firsts.select(F.col("payload_digest").alias("d"), F.col("first.page_id").alias("first_page"), F.col("first.url").alias("first_url")), "firsts")
    out = p.join(firsts, (p["payload_digest"] == firsts["d"]) & (F.octet_length("payload") >= LEAST_REVISIT), "left")
    other = ~F.col("first_page").eqNullSafe(F.col("page_id"))
    return out.select("page_id", "url", "payload", "payload_digest", F.when(other, F.col("first_page")).alias("refers_to"), F.when(other, F.col("first_url")).alias("refers_url"))


def write_archives(marked: DataFrame, version: int | None = None, date: str = "20000101000000") -> DataFrame:
    """Pack the pages into ARC archives of bounded size and convert those; one row an
    archive: name, arc_bytes, records, warc (the .warc.gz). Without a version an archive
    has either, by its name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[ArcRecord] = []
        refers: list[tuple[str, str] | None] = []
        size = 0

        def close() -> pa.RecordBatch:
            nonlocal size
            name = hashlib.sha256("".join(http_header(split_http(r.content)[0], PAGE_HEADER) or "" for r in held).encode()).hexdigest()[:16]
            arc = write_arc(held, f"{name}.arc", version or 1 + int(name, 16) % 2)
            warc = write_warc([to_warc(r, to) for r, to in zip(parse_arc(arc), refers, strict=True)])
            batch = pa.RecordBatch.from_arrays([pa.array([f"{name}.warc.gz"]), pa.array([len(arc)], pa.int64()), pa.array([len(held)], pa.int64()), pa.array([warc], pa.binary())], names=["name", "arc_bytes", "records", "warc"])
            held.clear()
            refers.clear()
            size = 0
            return batch

        for b in batches:
            for page, url, html, to, to_url in zip(*(b.column(c) for c in ("page_id", "url", "payload", "refers_to", "refers_url")), strict=True):
                held.append(_page_record("null" if page.as_py() is None else str(page.as_py()), url.as_py(), html.as_py(), date))
                refers.append(None if to.as_py() is None else (str(to.as_py()), _page_url(str(to.as_py()), to_url.as_py())))
                size += len(held[-1].content)
                if size >= ARCHIVE_BYTES:
                    yield close()
        if held:
            yield close()

    return marked.select("page_id", "url", "payload", "refers_to", "refers_url").mapInArrow(run, "name string, arc_bytes long, records long, warc binary")


def read_archives(archives: DataFrame) -> DataFrame:
    """One row a record of the archives: page_id, payload_bytes, payload_digest,
    record_type, refers_to, record_id, target_uri, warc_date, digest_ok, refers_id.

    A response's digest and length are those of the payload read; a revisit's are those
    that its headers state.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for w in b.column("warc"):
                for r in read_warc(w.as_py()):
                    head, payload = split_http(r.block)
                    page = http_header(head, PAGE_HEADER)
                    stated = r.headers["WARC-Payload-Digest"].removeprefix("sha256:")
                    revisit = r.headers["WARC-Type"] == "revisit"
                    digest = stated if revisit else hashlib.sha256(payload).hexdigest()
                    n = int(http_header(head, "Content-Length") or 0) if revisit else len(payload)
                    to = r.headers.get(REFERS_PAGE)
                    rows.append((int(page) if page not in (None, "null") else None, n, digest, r.headers["WARC-Type"], int(to) if to else None, r.headers["WARC-Record-ID"], r.headers["WARC-Target-URI"].encode("utf-8", "replace").decode(), r.headers["WARC-Date"], digest == stated, r.headers.get("WARC-Refers-To")))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.string())
            names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "target_uri", "warc_date", "digest_ok", "refers_id")
            cols = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=list(names))

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, target_uri string, warc_date string, digest_ok boolean, refers_id string"
    return archives.select("warc").mapInArrow(run, schema)


def archive_pages(pages: DataFrame, version: int | None = None) -> DataFrame:
    """Write every page as a WARC record by way of ARC, and read the archives back.

    The archives are a table in the shared folder, one row an archive, committed by
    Spark's writer: a lost executor leaves no half archive. Null html is an empty
    payload; a null url becomes urn:page:<id>; rows that repeat the smallest page_id of a
    payload are all responses, and a null page_id is never one that others refer to.
    """
    return read_archives(materialize(write_archives(mark_revisits(pages), version), "warc"))
