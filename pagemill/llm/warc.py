"""Operator 3: legacy ARC archives to WARC.

An ARC file starts with a version block (``filedesc://``) that says how its header lines read: version 1 has five fields, version
2 ten; the last is the record's declared length. The converter parses them and synthesises what WARC asks for: record ids (UUIDs
from the archive, offset and address), timestamps (ARC's 14 digits), record types (from the address and the block) and digests
(base32 SHA-1 of block and payload). Of the records whose payloads are equal and of at least ``least_bytes`` bytes, that with the
smallest source id stays a response; the others become revisits that refer to it and leave the payload out.

An archive is a row (archive, content) of a table, so any store that Spark reads and writes will do; ``arc_bytes`` and
``warc_records`` work on plain files too. The index of repeated payloads is grouped with partial sums and joined; Spark broadcasts
it if it is small by its measured size and else splits hot keys (adaptive skew join).

Defined results: a null payload counts as empty; a null address becomes ``urn:source:<id>``; spaces and control characters in
addresses are percent-encoded; of rows that repeat the smallest id all are responses; rows without an id come last among equal
payloads, and are all responses if no row has one. A record cut short by its file's end is kept and marked
``WARC-Truncated: length``; a header line that can't be read raises ``ValueError`` with its offset. Empty tables give no archives.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.common import arrow_map, batch, stored

#: The field lists of the two published ARC versions, and WARC's revisit profile.
FIELDS = {1: b"URL IP-address Archive-date Content-type Archive-length", 2: b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ARCHIVES = "archive string, n_records long, content binary"
ARCHIVE_BYTES = 4 << 20
SOURCE = b"X-Source-Id"


@dataclass(slots=True)
class ArcRecord:
    version: int
    offset: int
    url: bytes
    ip: bytes
    date: bytes
    mime: bytes
    block: bytes
    truncated: bool = False

    def split(self) -> tuple[bytes, bytes]:
        """HTTP header lines with the empty line (or nothing), and the payload."""
        if self.block.startswith(b"HTTP/"):
            ends = [(k, n) for mark in (b"\r\n\r\n", b"\n\n") if (k := self.block.find(mark)) >= 0 for n in [len(mark)]]
            if ends:
                k, n = min(ends)
                return self.block[: k + n], self.block[k + n :]
        return b"", self.block


def plain_url(url: str | None, source: int | None) -> bytes:
    raw = (url or f"urn:source:{source}").encode("utf-8", "replace")
    return re.sub(rb"[\x00-\x20\x7f]", lambda m: b"%%%02X" % m[0][0], raw)


def arc_bytes(records: list[tuple[bytes, bytes, bytes, bytes, bytes]], version: int, name: str) -> bytes:
    """An ARC file of records (url, ip, date, mime, block)."""
    about = b"%d 0 Pagemill\n%s\n" % (version, FIELDS[version])
    name = name.encode()

    def line(url, ip, date, mime, length, offset, block=b""):
        if version == 1:
            return b"%s %s %s %s %d\n" % (url, ip, date, mime, length)
        return b"%s %s %s %s 200 %s - %d %s %d\n" % (url, ip, date, mime, hashlib.md5(block).hexdigest().encode(), offset, name, length)

    # The first line is short in either version's file: readers learn the version from what follows it.
    out = [b"filedesc://%s 0.0.0.0 %s text/plain %d\n" % (name, b"19960101000000", len(about)), about, b"\n"]
    at = sum(map(len, out))
    for url, ip, date, mime, block in records:
        out += [line(url, ip, date, mime, len(block), at, block), block, b"\n"]
        at += sum(map(len, out[-3:]))
    return b"".join(out)


def arc_records(content: bytes) -> Iterator[ArcRecord]:
    """The records of an ARC file, without its version block."""
    at, version = 0, 0
    while at < len(content):
        if content[at] in b"\r\n":
            at += 1
            continue
        end = content.find(b"\n", at)
        fields = content[at : end if end >= 0 else len(content)].rstrip(b"\r").split(b" ")
        first = version == 0
        want = 5 if first and len(fields) < 10 else {1: 5, 2: 10}.get(version, 10)
        try:
            if end < 0 or len(fields) < want:
                raise ValueError
            url, rest, length = b" ".join(fields[: len(fields) - want + 1]), fields[len(fields) - want + 1 :], int(fields[-1])
            if length < 0:
                raise ValueError
        except ValueError:
            raise ValueError(f"no ARC header line at offset {at}") from None
        block = content[end + 1 : end + 1 + length]
        if first:
            about = block.split(b"\n", 1)[0].split(b" ")
            if not url.startswith(b"filedesc:") or about[0] not in (b"1", b"2"):
                raise ValueError("no ARC version block")
            version = int(about[0])
        else:
            yield ArcRecord(version, at, url, rest[0], rest[1], rest[2], block, len(block) < length)
        at = end + 1 + length


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def warc_date(date: bytes) -> bytes:
    d = re.sub(rb"\D", b"", date)[:14].ljust(14, b"0") if date else b"19700101000000"
    month, day = max(d[4:6], b"01"), max(d[6:8], b"01")
    return b"%s-%s-%sT%s:%s:%sZ" % (d[:4], month, day, d[8:10], d[10:12], d[12:14])


def record_id(archive: str, offset: int, url: bytes) -> bytes:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{archive}#{offset}#{url.decode("latin-1")}')}>".encode()


def source_id(head: bytes) -> int | None:
    m = re.search(rb"(?im)^%s: *(-?\d+)" % SOURCE, head)
    return int(m[1]) if m else None


def warc_record(kind: bytes, fields: list[tuple[bytes, bytes]], block: bytes) -> bytes:
    lines = [b"WARC/1.1", b"WARC-Type: " + kind, *[k + b": " + v for k, v in fields], b"WARC-Block-Digest: sha1:" + base32_sha1(block).encode(), b"Content-Length: %d" % len(block)]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def convert_record(archive: str, r: ArcRecord, original: tuple[str, str, str, int | None] | None) -> bytes:
    """The WARC record of r; original, for a revisit: record id, address, date and source id of the response."""
    head, payload = r.split()
    kind = b"response" if head else b"resource"
    fields = [
        (b"WARC-Record-ID", record_id(archive, r.offset, r.url)),
        (b"WARC-Date", warc_date(r.date)),
        (b"WARC-Target-URI", r.url),
        (b"WARC-IP-Address", r.ip),
        (b"WARC-Payload-Digest", b"sha1:" + base32_sha1(payload).encode()),
        (b"Content-Type", b"application/http;msgtype=response" if head else r.mime),
    ]
    if r.truncated:
        fields.append((b"WARC-Truncated", b"length"))
    if (source := source_id(head)) is not None:
        fields.append((b"WARC-Source-Id", b"%d" % source))
    if original and head:
        fields += [(b"WARC-Profile", PROFILE), (b"WARC-Refers-To", original[0].encode()), (b"WARC-Refers-To-Target-URI", original[1].encode("latin-1")), (b"WARC-Refers-To-Date", original[2].encode())]
        if original[3] is not None:
            fields.append((b"WARC-Refers-To-Source-Id", b"%d" % original[3]))
        return warc_record(b"revisit", fields, head)
    return warc_record(kind, fields, r.block)


def warc_records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each record; the block's digest is verified."""
    at = 0
    while at < len(content):
        end = content.find(b"\r\n\r\n", at)
        first, *lines = content[at:end].split(b"\r\n")
        if end < 0 or not first.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at offset {at}")
        fields = {k.decode("latin-1"): v.strip().decode("latin-1") for k, _, v in (x.partition(b":") for x in lines)}
        n = int(fields["Content-Length"])
        block = content[end + 4 : end + 4 + n]
        if "sha1:" + base32_sha1(block) != fields.get("WARC-Block-Digest", "sha1:" + base32_sha1(block)):
            raise ValueError(f"the block at offset {at} isn't what its digest says")
        yield fields, block
        at = end + 8 + n


def write_arcs(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = "19970214093000") -> DataFrame:
    """ARC archives of the rows of pages, versions 1 and 2 in turn: (archive, n_records, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        schema = pa.schema([("archive", pa.string()), ("n_records", pa.int64()), ("content", pa.binary())])
        part, k, rows, held = TaskContext.get().partitionId(), 0, [], 0

        def out():
            name = f"part-{part:06d}-{k:06d}"
            return batch(schema, [name + ".arc"], [len(rows)], [arc_bytes(rows, 1 + k % 2, name + ".arc")])

        for b in batches:
            for source, url, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist(), strict=True):
                payload = payload or b""
                own = b"" if source is None else b"%s: %d\r\n" % (SOURCE, source)
                head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n%s\r\n" % (len(payload), own)
                rows.append((plain_url(url, source), b"0.0.0.0", date.encode(), b"text/html", head + payload))
                held += len(payload) + 256
                if held >= ARCHIVE_BYTES:
                    yield out()
                    k, rows, held = k + 1, [], 0
        if rows:
            yield out()

    return arrow_map(pages.select(pages[id_col].cast("long"), pages[url_col].cast("string"), pages[payload_col].cast("string")), run, ARCHIVES)


def repeated_payloads(arcs: DataFrame, least_bytes: int = 0) -> DataFrame:
    """For every payload that occurs again: digest, and the record that the others refer to."""

    def run(batches):
        schema = pa.schema([("digest", pa.string()), ("source", pa.int64()), ("record", pa.string()), ("url", pa.string()), ("date", pa.string())])
        for b in batches:
            for archive, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = []
                for r in arc_records(content):
                    head, payload = r.split()
                    if head and len(payload) >= least_bytes:
                        rows.append((base32_sha1(payload), source_id(head), record_id(archive, r.offset, r.url).decode(), r.url.decode("latin-1"), warc_date(r.date).decode()))
                if rows:
                    yield batch(schema, *zip(*rows, strict=True))

    seen = arrow_map(arcs.select("archive", "content"), run, "digest string, source long, record string, url string, date string")
    first = F.min(F.struct(F.col("source").isNull().alias("last"), "source", "record", "url", "date")).alias("first")
    return seen.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), first).where("n > 1").select("digest", "first.source", "first.record", "first.url", "first.date")


def convert(arcs: DataFrame, least_bytes: int = 0) -> DataFrame:
    """WARC archives of ARC archives (archive, content): (archive, n_records, content)."""

    def parse(batches):
        schema = pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("digest", pa.string()), ("source", pa.int64()), ("header", pa.list_(pa.field("element", pa.binary()))), ("block", pa.binary()), ("truncated", pa.bool_())])
        for b in batches:
            for archive, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = []
                for r in arc_records(content):
                    head, payload = r.split()
                    rows.append((archive, r.offset, base32_sha1(payload) if head and len(payload) >= least_bytes else None, source_id(head), [b"%d" % r.version, r.url, r.ip, r.date, r.mime], r.block, r.truncated))
                if rows:
                    yield batch(schema, *zip(*rows, strict=True))

    records = arrow_map(arcs.select("archive", "content"), parse, "archive string, offset long, digest string, source long, header array<binary>, block binary, truncated boolean")
    again = repeated_payloads(arcs, least_bytes).select("digest", F.struct("record", "url", "date", F.col("source").alias("source")).alias("original"))
    own = F.col("source").eqNullSafe(F.col("original.source"))
    joined = records.join(again, "digest", "left").select("archive", "offset", "header", "block", "truncated", F.when(own, F.lit(None)).otherwise(F.col("original")).alias("original"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        schema = pa.schema([("archive", pa.string()), ("n_records", pa.int64()), ("content", pa.binary())])
        part, k, out, held = TaskContext.get().partitionId(), 0, [], 0

        def done():
            name = f"part-{part:06d}-{k:06d}.warc"
            info = b"software: pagemill\r\nformat: WARC File Format 1.1\r\n"
            fields = [(b"WARC-Record-ID", record_id(name, 0, b"")), (b"WARC-Date", b"1997-02-14T09:30:00Z"), (b"WARC-Filename", name.encode()), (b"Content-Type", b"application/warc-fields")]
            return batch(schema, [name], [len(out)], [b"".join([warc_record(b"warcinfo", fields, info), *out])])

        for b in batches:
            for archive, offset, header, block, truncated, original in zip(*(c.to_pylist() for c in b.columns), strict=True):
                version, url, ip, date, mime = header
                r = ArcRecord(int(version), offset, url, ip, date, mime, block, truncated)
                out.append(convert_record(archive, r, original and (original["record"], original["url"], original["date"], original["source"])))
                held += len(out[-1])
                if held >= ARCHIVE_BYTES:
                    yield done()
                    k, out, held = k + 1, [], 0
        if out:
            yield done()

    return arrow_map(joined, write, ARCHIVES)


def read_warcs(warcs: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url, warc_date of every record but warcinfo."""

    def run(batches):
        schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("warc_date", pa.string())])
        number = lambda fields, k: int(fields[k]) if k in fields else None
        for b in batches:
            for content in b.column(0).to_pylist():
                rows = []
                for fields, block in warc_records(content):
                    kind, digest = fields["WARC-Type"], fields.get("WARC-Payload-Digest", "").removeprefix("sha1:")
                    if kind == "warcinfo":
                        continue
                    if kind == "revisit":
                        m = re.search(rb"(?im)^Content-Length: *(\d+)", block)
                        n = int(m[1]) if m else None
                    else:
                        payload = block.split(b"\r\n\r\n", 1)[1] if block.startswith(b"HTTP/") and b"\r\n\r\n" in block else block
                        n = len(payload)
                        if base32_sha1(payload) != digest:
                            raise ValueError(f"the payload of {fields['WARC-Record-ID']} isn't what its digest says")
                    rows.append((number(fields, "WARC-Source-Id"), n, digest, kind, number(fields, "WARC-Refers-To-Source-Id"), fields["WARC-Target-URI"], fields["WARC-Date"]))
                if rows:
                    yield batch(schema, *zip(*rows, strict=True))

    return arrow_map(warcs.select("content"), run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, warc_date string")


def op3_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    arcs = stored(write_arcs(spark.read.parquet(f"{sf_dir}/pages.parquet")), "arc", "zstd")
    return read_warcs(stored(convert(arcs), "warc", "zstd"))
