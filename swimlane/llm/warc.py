"""Legacy web archives (ARC) converted to WARC records.

Method: an ARC file opens with a version block (``filedesc://``) whose second
line tells the version; version 1 headers have five fields (URL, IP address,
date, content type, length), version 2 headers ten (result code, checksum,
location, offset and file name besides).  Each record's length is the one its
header declares.  From every record an equivalent WARC record is made: the
version block becomes a ``warcinfo`` record, HTTP responses ``response`` records,
other content ``resource`` records; the fourteen-digit date becomes the
WARC-Date, the SHA-1 of the block and of the payload the digests, and the record
id is a UUID derived from date, URL and block digest, so a repeated conversion
gives the same ids.

Plan: a file is parsed by the task that reads it, unzipped piece by piece; nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator
from datetime import datetime, timezone
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import batch

FIELDS = {1: "URL IP-address Archive-date Content-type Archive-length", 2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
SCHEMA = (
    "file string, nth int, warc_type string, record_id string, warc_date string, target_uri string, ip string, content_type string, "
    "block_digest string, payload_digest string, content_length long, block binary, error string"
)


class Record(NamedTuple):
    """One ARC record: its header's fields and its block."""

    url: str
    ip: str
    date: str
    kind: str
    block: bytes
    is_version: bool


class Damage(Exception):
    """What is wrong with an archive, and where."""


class Source:
    """An archive's bytes from front to back, plain or unzipped member by member; what was read is let go."""

    def __init__(self, data: bytes, piece: int = 1 << 16):
        self.data, self.piece, self.zipped = data, piece, data[:2] == b"\x1f\x8b"
        self.at, self.member, self.press, self.spoilt = 0, 0, None, None  # in the file: what comes next, the member it belongs to
        self.held, self.pos, self.before = b"", 0, 0  # unzipped: bytes at hand, how many of them were read, how many were let go

    @property
    def place(self) -> int:
        return self.before + self.pos

    def _more(self) -> bool:
        """Hold further bytes; false at the end."""
        if self.spoilt:
            raise Damage(self.spoilt)
        if self.zipped and self.press is None:
            while self.data[self.at : self.at + 1] == b"\0":  # padding
                self.at += 1
            if self.at < len(self.data):
                self.member, self.press = self.at, zlib.decompressobj(31)
        new = piece = self.data[self.at : self.at + self.piece]
        if self.press:
            if not piece:
                raise Damage(f"gzip member at byte {self.member}: cut")
            before = self.press.copy()
            try:
                new = self.press.decompress(piece)
            except zlib.error as e:
                new, self.spoilt = b"".join(self._until_damage(before, piece)), f"gzip member at byte {self.member}: {e}"
            else:
                self.at += len(piece) - len(self.press.unused_data)
                self.press = None if self.press.eof else self.press
        else:
            self.at += len(piece)
        self.held, self.before, self.pos = self.held[self.pos :] + new, self.before + self.pos, 0
        return bool(piece)

    @staticmethod
    def _until_damage(press, piece: bytes) -> Iterator[bytes]:
        """What the bytes before the wrong one hold."""
        for i in range(len(piece)):
            try:
                yield press.decompress(piece[i : i + 1])
            except zlib.error:
                return

    def skip(self, these: bytes) -> bool:
        """Pass over such bytes; false at the end."""
        while True:
            while self.pos < len(self.held):
                if self.held[self.pos] not in these:
                    return True
                self.pos += 1
            if not self._more():
                return False

    def line(self) -> tuple[bytes, bool]:
        """The bytes up to the next line feed, and whether there is one."""
        looked = 0
        while (end := self.held.find(b"\n", self.pos + looked)) < 0:
            looked = len(self.held) - self.pos
            if not self._more():
                out, self.pos = self.held[self.pos :], len(self.held)
                return out, False
        out, self.pos = self.held[self.pos : end], end + 1
        return out, True

    def block(self, n: int) -> bytes:
        """The next n bytes, or as many as there are."""
        parts, have = [], 0
        while True:
            part = self.held[self.pos : self.pos + n - have]
            parts.append(part)
            have, self.pos = have + len(part), self.pos + len(part)
            if have == n or not self._more():
                return b"".join(parts)

    def next_member(self) -> bool:
        """Go on where a gzip member seems to begin after the one at hand."""
        at = self.data.find(b"\x1f\x8b\x08", self.member + 1) if self.zipped else -1
        if at < 0:
            return False
        self.before, self.held, self.pos, self.at, self.press, self.spoilt = self.place, b"", 0, at, None, None
        self.member = at
        return True


def parse(data: bytes) -> Iterator[Record | str]:
    """The records of an ARC file.  Where a header, a length or the compression is wrong, a text says so: a plain file ends there, in a zipped one the next gzip member is tried."""
    source, version, told = Source(data), 1, False
    while True:
        try:
            r = read_record(source, version)
        except Damage as e:
            if not told:  # of bytes that only look like a member nothing is said
                yield str(e)
            told = True
            if not source.next_member():
                return
            continue
        if r is None:
            return
        if r.is_version:
            version = 2 if r.block.split(b"\n", 1)[0].split(b" ")[:1] == [b"2"] else 1
        told = False
        yield r


def read_record(source: Source, version: int) -> Record | None:
    if not source.skip(b"\r\n"):
        return None
    at = source.place
    line, ended = source.line()
    parts = line.rstrip(b"\r").decode("utf-8", "replace").split(" ")
    is_version = line.startswith(b"filedesc://")
    want = 5 if is_version else len(FIELDS[version].split())
    # a version block's own header has version 1's five fields in either version; a content type may hold spaces
    if not ended or len(parts) < want or not re.fullmatch("[0-9]{1,18}", parts[-1]):
        raise Damage(f"header at byte {at}: {line[:80].decode('utf-8', 'replace')}")
    length = int(parts[-1])
    block = source.block(length)
    if len(block) < length:
        raise Damage(f"record at byte {at}: {length} bytes declared, {len(block)} there")
    kind = " ".join(parts[3 : len(parts) - (want - 4)]) if not is_version and len(parts) > want else parts[3]
    return Record(parts[0], parts[1], parts[2], kind, block, is_version)


def warc_date(date: str) -> str | None:
    """YYYYMMDDhhmmss, or its first digits, as an ISO 8601 instant; None where it is no date."""
    if not re.fullmatch(r"\d{4,14}", date):
        return None
    try:
        return datetime.strptime((date + "00000101000000"[len(date) :])[:14], "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")
    except ValueError:
        return None


def record_id(date: str, url: str, digest: str) -> str:
    """urn:uuid of the MD5 of date, URL and block digest."""
    h = hashlib.md5(f"{date} {url} {digest}".encode()).hexdigest()
    return f"urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}"


def payload(block: bytes) -> bytes:
    """What follows an HTTP response's headers."""
    ends = [(p, p + len(s)) for s in (b"\r\n\r\n", b"\n\n") if (p := block.find(s)) >= 0]
    return block[min(ends)[1] :] if ends else b""


def convert(name: str | None, data: bytes | None) -> Iterator[tuple]:
    """A file's WARC rows, in SCHEMA's order."""
    for nth, r in enumerate(parse(data or b"")):
        if isinstance(r, str):
            yield (name, nth, *[None] * 10, r)
            continue
        block, date = hashlib.sha1(r.block).hexdigest(), warc_date(r.date)
        http = r.block.startswith(b"HTTP/") and r.url[:4].lower() == "http"
        kind = "warcinfo" if r.is_version else "response" if http else "resource"
        of_payload = f"sha1:{hashlib.sha1(payload(r.block)).hexdigest()}" if http else None if r.is_version else f"sha1:{block}"
        content = "text/plain" if r.is_version else "application/http; msgtype=response" if http else r.kind
        ip = None if r.is_version or r.ip in ("0.0.0.0", "-", "") else r.ip
        yield (name, nth, kind, record_id(date or r.date, r.url, block), date, None if r.is_version else r.url, ip, content, f"sha1:{block}", of_payload, len(r.block), r.block, None if date else f"date: {r.date}")


def arc_to_warc(files: DataFrame, name_col: str = "path", data_col: str = "content") -> DataFrame:
    """One row for every record of every ARC file (as of Spark's binaryFile source), in the columns of ``SCHEMA``.

    ``nth`` is the record's place in its file.  Where a file is damaged (a wrong header or
    length, a cut or corrupt gzip member), a row has only file, nth and ``error``; the records before it stand,
    a zipped file's later members are still read, a plain file ends there.  A date that is
    none gives a null ``warc_date`` and an error beside the other columns.  Null and
    empty files have no record; a null name stays null; repeated files are
    converted each; an empty table gives an empty result.
    """
    types = [pa.string(), pa.int32(), *[pa.string()] * 8, pa.int64(), pa.binary(), pa.string()]
    schema = pa.schema([(c.split()[0], t) for c, t in zip(SCHEMA.split(", "), types)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, held = [], 0
            for name, data in zip(b.column(0), b.column(1)):
                for row in convert(name.as_py(), data.as_py()):
                    rows.append(row)
                    held += len(row[11] or b"")
                    if held > 8 << 20:
                        yield batch(schema, list(zip(*rows)))
                        rows, held = [], 0
            if rows:
                yield batch(schema, list(zip(*rows)))

    return files.select(F.col(name_col).cast("string").alias("file"), F.col(data_col).cast("binary").alias("data")).mapInArrow(run, SCHEMA)


def warc_bytes(row) -> bytes:
    """A row of ``arc_to_warc`` as a WARC/1.0 record."""
    fields = [("WARC-Type", row.warc_type), ("WARC-Record-ID", f"<{row.record_id}>"), ("WARC-Date", row.warc_date), ("WARC-Target-URI", row.target_uri), ("WARC-IP-Address", row.ip), ("WARC-Block-Digest", row.block_digest), ("WARC-Payload-Digest", row.payload_digest), ("Content-Type", row.content_type), ("Content-Length", str(row.content_length))]
    head = "WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return head.encode() + b"\r\n" + bytes(row.block) + b"\r\n\r\n"


START = datetime(2001, 1, 1, tzinfo=timezone.utc)


def pages_as_arc(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(path, content): each page as an ARC file of a version block and one HTTP response, version 1 for even ids and 2 for odd ones.

    A stand-in for archives, made of whole pages: a page's id gives the date (so
    many seconds after 2001 began) and the IP address.  A null URL or html counts as an empty one; a null id is left out.
    """
    k = F.col(id_col).cast("long")
    date = F.date_format(F.timestamp_seconds(F.lit(int(START.timestamp())) + k), "yyyyMMddHHmmss")
    bytes_ = lambda c: F.encode(c, "UTF-8")
    url = F.regexp_replace(F.coalesce(F.col(url_col).cast("string"), F.lit("")), r"\s", "%20")
    block = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"), F.coalesce(F.col(html_col).cast("string"), F.lit("")))
    ip = F.concat_ws(".", F.lit("10"), F.pmod(F.floor(k / 65536), F.lit(256)), F.pmod(F.floor(k / 256), F.lit(256)), F.pmod(k, F.lit(256)))
    odd = F.pmod(k, F.lit(2)) == 1
    name = F.concat(F.lit("page-"), k.cast("string"), F.lit(".arc"))
    about = F.when(odd, F.lit(f"2 0 archive\n{FIELDS[2]}\n")).otherwise(F.lit(f"1 0 archive\n{FIELDS[1]}\n"))
    size = F.octet_length(bytes_(block)).cast("string")
    one = F.concat_ws(" ", url, ip, date, F.lit("text/html"), size)
    two = F.concat_ws(" ", url, ip, date, F.lit("text/html"), F.lit("200"), F.lit("-"), F.lit("-"), F.lit("0"), name, size)
    head = F.concat(F.lit("filedesc://"), name, F.lit(" 0.0.0.0 "), date, F.lit(" text/plain "), F.octet_length(bytes_(about)).cast("string"), F.lit("\n"), about, F.lit("\n"), F.when(odd, two).otherwise(one), F.lit("\n"), block, F.lit("\n"))
    return pages.where(k.isNotNull()).select(name.alias("path"), bytes_(head).alias("content"))
