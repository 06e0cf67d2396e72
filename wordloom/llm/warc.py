"""Legacy archives to WARC: ARC versions 1 and 2 are parsed by their header lines and declared
lengths, and equivalent WARC records are synthesised: identifiers, timestamps, types, digests.

An ARC file begins with a version block, `filedesc://` with a body that names the version and
the fields of the header lines that follow. Version 1: URL IP date type length. Version 2:
URL IP date type result-code checksum location offset filename length. A record's body has the
declared length; a line feed ends it.

Archives of pages are written by Spark's own text writer; converted archives, which hold any bytes,
by the tasks themselves. Both are read by binaryFile, packed, and unpacked a record at a time. All identifiers are derived from content: reruns agree.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator
from typing import BinaryIO, NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, staged, table

LEAST = 1000  # payload bytes from which equal payloads become revisits
#: Records of a file by the most bytes of a page in it, so that a file has 256 MB before it is packed; larger pages have as
#: many as fit, or one. A file is read packed, and unpacked record by record.
FILE_BYTES = 256 << 20
CLASSES = [64 << 10, 4 << 20]
ARC_BYTES = 8 << 20  # pages that a task lays out as one ARC file, or a single larger one
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:wordloom:warc")
EPOCH = "20240101000000"


class ArcRecord(NamedTuple):
    url: str
    ip: str
    date: str
    mime: str
    body: bytes


def arc_version_block(version: int, name: str = "archive.arc") -> bytes:
    body = f"{version} 0 wordloom\n{FIELDS[version]}\n".encode()
    tail = "" if version == 1 else f"200 - - 0 {name} "
    return f"filedesc://{name} 0.0.0.0 {EPOCH} text/plain {tail}{len(body)}\n".encode() + body + b"\n"


def arc_record(version: int, r: ArcRecord, offset: int = 0, name: str = "archive.arc") -> bytes:
    """A record; white space in the URL is percent-encoded, as a header line is split by it."""
    url = percent_encoded(r.url)
    tail = "" if version == 1 else f"200 {hashlib.md5(r.body).hexdigest()} - {offset} {name} "
    return f"{url} {r.ip} {r.date} {r.mime} {tail}{len(r.body)}\n".encode() + r.body + b"\n"


def opened(source: bytes | pa.Buffer | BinaryIO) -> BinaryIO:
    """A stream of an archive's bytes, inflated as they are read where it is gzip, of one member or many."""
    if not hasattr(source, "read"):
        source = pa.BufferReader(source)
    start = source.read(2)
    source.seek(0)
    return io.BufferedReader(gzip.GzipFile(fileobj=source) if start == b"\x1f\x8b" else source, 1 << 16)


def parse_arc(source: bytes | pa.Buffer | BinaryIO, with_version: bool = False) -> Iterator[ArcRecord]:
    """The records of a file, one in memory at a time; its version block first, if that is asked for. Lengths are trusted, not line
    ends: a body may hold lines that look like headers. A truncated last body is given as far as it goes."""
    stream, fields = opened(source), 5
    while line := stream.readline():
        if not line.endswith(b"\n"):
            return
        line = line.decode("utf-8", "replace").rstrip("\r\n")
        if not line.strip():
            continue
        parts = line.split(" ")
        if line.startswith("filedesc://"):
            body = stream.read(int(parts[-1]))
            fields = len(FIELDS[2 if body.split(b"\n", 1)[0].split()[:1] == [b"2"] else 1].split())
            if with_version:
                yield ArcRecord(*parts[:4], body)
        elif len(parts) < fields or not parts[-1].isdigit():
            raise ValueError(f"not an ARC header line of {fields} fields: {line[:200]!r}")
        else:
            yield ArcRecord(*parts[:4], stream.read(int(parts[-1])))


def warc_date(date: str) -> str:
    """YYYYMMDDhhmmss, or its first digits, as an ISO time."""
    d = (date + EPOCH[len(date) :])[:14] if date.isdigit() else EPOCH
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def split_http(body: bytes) -> tuple[bytes, bytes]:
    """HTTP head (with its blank line) and payload; without a head all is payload."""
    if body.startswith(b"HTTP/"):
        head, gap, payload = body.partition(b"\r\n\r\n")
        return head + gap, payload
    return b"", body


def record_id(r: ArcRecord, head: bytes, payload_digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, '|'.join((r.url, r.date, head.decode('latin-1'), payload_digest)))}>"


class Original(NamedTuple):
    """The record that holds a revisit's payload. All three go into the revisit's header."""

    id: str
    url: str
    date: str


def to_warc(r: ArcRecord, revisit_of: Original | None = None) -> bytes:
    """The equivalent record, without the blank lines after it: a response where the body has an HTTP
    head, else (dns:, ftp:) a resource. revisit_of: the record that holds the same payload; this one
    is then a revisit of it, with the HTTP head only."""
    head, payload = split_http(r.body)
    pd = digest(payload)
    block = r.body if revisit_of is None else head
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit_of is not None else 'response' if head else 'resource'}",
        f"WARC-Record-ID: {record_id(r, head, pd)}",
        f"WARC-Date: {warc_date(r.date)}",
        f"WARC-Target-URI: {r.url}",
        f"WARC-IP-Address: {r.ip}",
        f"WARC-Payload-Digest: {pd}",
        f"WARC-Block-Digest: {digest(block)}",
        f"WARC-Identified-Payload-Type: {r.mime}",
        "Content-Type: application/http; msgtype=response" if head else f"Content-Type: {r.mime}",
    ]
    if revisit_of is not None:
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {revisit_of.id}",
            f"WARC-Refers-To-Target-URI: {revisit_of.url}",
            f"WARC-Refers-To-Date: {warc_date(revisit_of.date)}",
            f"X-Payload-Length: {len(payload)}",
        ]
    return "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode() + block


def to_warcinfo(version: ArcRecord) -> bytes:
    """The record of an ARC file's version block, which it quotes."""
    said = version.body.decode("utf-8", "replace").strip().splitlines()
    block = "".join(f"{x}\r\n" for x in ("software: wordloom", "format: WARC File Format 1.1", *(f"description: ARC {x}" for x in said))).encode()
    lines = [
        "WARC/1.1",
        "WARC-Type: warcinfo",
        f"WARC-Record-ID: {record_id(version, b'', digest(version.body))}",
        f"WARC-Date: {warc_date(version.date)}",
        f"WARC-Filename: {version.url.removeprefix('filedesc://')}",
        f"WARC-Block-Digest: {digest(block)}",
        "Content-Type: application/warc-fields",
    ]
    return "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode() + block


def parse_warc(source: bytes | pa.Buffer | BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields in lower case, block) of each record, by declared lengths, one in memory at a time."""
    stream = opened(source)
    while version := stream.readline():
        if not version.strip():
            continue
        if not version.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {version[:100]!r}")
        head = {}
        while (line := stream.readline()).strip():
            k, _, v = line.decode("utf-8", "replace").partition(":")
            head[k.strip().lower()] = v.strip()
        yield head, stream.read(int(head["content-length"]))


def http_field(head: bytes, name: bytes) -> str | None:
    for line in head.split(b"\r\n"):
        k, _, v = line.partition(b":")
        if k.strip().lower() == name:
            return v.strip().decode()
    return None


def page_head(page_id: int | None, length: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page-Id: {'-' if page_id is None else page_id}\r\nContent-Length: {length}\r\n\r\n".encode()


def percent_encoded(url: str | None) -> str:
    """A URL as it stands in an ARC header line, which white space splits."""
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url or "") or "-"


def page_to_arc(page_id: int | None, url: str | None, html: str | None) -> ArcRecord:
    payload = (html or "").encode("utf-8", "surrogatepass")
    return ArcRecord(url or "-", "0.0.0.0", EPOCH, "text/html", page_head(page_id, len(payload)) + payload)


def page_original(page_id: int, url: str | None, payload: bytes) -> Original:
    """What a revisit says of the record that page_to_arc and to_warc make of a page with this payload."""
    r = ArcRecord(percent_encoded(url), "0.0.0.0", EPOCH, "text/html", b"")
    return Original(record_id(r, page_head(page_id, len(payload)), digest(payload)), r.url, r.date)


def decisions(pages: DataFrame) -> DataFrame:
    """(__row, refers_to: page_id and url of the response) of the pages that are revisits, staged: where they
    are few, Spark can send them to the pages. Only ids, URLs and digests move."""
    light = pages.select("__row", "page_id", "url", F.sha1(F.encode(html(), "utf-8")).alias("d")).where(F.octet_length(html()) >= LEAST)
    said = F.struct("page_id", F.coalesce("url", F.lit("")).alias("url"))
    most = staged(light.groupBy("d").agg(F.count("*").alias("n"), F.max(said).alias("refers_to")).where("n > 1 and refers_to.page_id is not null").select("d", "refers_to"), "copies")
    later = light.select("__row", "page_id", "d").join(most, "d").where(~F.col("page_id").eqNullSafe(F.col("refers_to.page_id")))
    return staged(later.groupBy("__row").agg(F.max("refers_to").alias("refers_to")), "revisits")


def html() -> Column:
    return F.coalesce(F.col("html"), F.lit(""))


def with_row(pages: DataFrame) -> DataFrame:
    return pages.withColumn("__row", F.concat_ws(":", F.coalesce(F.col("page_id").cast("string"), F.lit("-")), F.hex(F.xxhash64("html")), F.hex(F.xxhash64("url"))))


def pages_to_warc(pages: DataFrame, path: str) -> None:
    """Write the pages (page_id, url, html) as WARC files. Each task lays its pages out as an ARC
    file, version 1 or 2 by turns of tasks, and converts that: the converter sees real archives.

    A null html is an empty payload, a null id or url is '-'. Of equal payloads of at least LEAST
    bytes the page with the largest id is the response; rows that repeat it are responses too.
    Rows alike in id, URL and html are one record, written as often, under one identifier.
    """
    rows = with_row(pages.select("page_id", "url", "html"))
    rows = rows.join(decisions(rows), "__row", "left").select("page_id", "url", "html", "refers_to")

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        version = 1 + TaskContext.get().partitionId() % 2
        for batch in batches:
            for low, high in stretches(pc.coalesce(pc.binary_length(batch.column(2)), pa.scalar(0, pa.int32())).to_pylist()):
                ids, urls, texts, refers = (c.to_pylist() for c in batch.slice(low, high - low).columns)
                arc = b"".join([arc_version_block(version), *(arc_record(version, page_to_arc(*x)) for x in zip(ids, urls, texts))])
                records = [to_warc(r, None if x is None else page_original(x["page_id"], x["url"], split_http(r.body)[1])) for r, x in zip(parse_arc(arc), refers, strict=True)]
                yield pa.record_batch([pa.array([x.decode("utf-8") for x in records], pa.string())], ["value"])

    size = F.coalesce(F.octet_length("html"), F.lit(0))
    of = F.when(size <= CLASSES[0], 0).when(size <= CLASSES[1], 1).otherwise(2)
    held = pages.select(of.alias("c"), size.alias("n")).groupBy("c").agg(F.max("n").alias("n")).collect()  # three rows at most
    for c, n in sorted(tuple(x) for x in held) or [(0, 0)]:
        records = max(1, FILE_BYTES // max([*CLASSES, n][c], 1))
        rows.where(of == c).mapInArrow(convert, "value string").write.mode("append").option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", records).text(path)


def stretches(sizes: list[int], most: int = ARC_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of items that together have at most so many bytes, or one item each."""
    low = held = 0
    for i, n in enumerate(sizes):
        if i > low and held + n > most:
            yield low, i
            low, held = i, 0
        held += n
    if sizes:
        yield low, len(sizes)


def arc_revisits(files: DataFrame) -> DataFrame:
    """(path, revisits: number in the file, id, url and date of the original) of files (path, content). Of
    responses with equal payloads of at least LEAST bytes the earliest is the original. Contents are read
    and not moved."""
    schema = "path string, n long, digest string, id string, url string, date string"

    def light(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = []
                for n, r in enumerate(parse_arc(data.as_buffer())):
                    head, payload = split_http(r.body)
                    if head and len(payload) >= LEAST:
                        pd = digest(payload)
                        rows.append((path, n, pd, record_id(r, head, pd), r.url, r.date))
                if rows:
                    yield pa.record_batch([pa.array(c) for c in zip(*rows)], ["path", "n", "digest", "id", "url", "date"])

    rows = staged(files.mapInArrow(light, schema), "arc-payloads")
    first = rows.groupBy("digest").agg(F.count("*").alias("k"), F.min(F.struct("date", "path", "n", "id", "url")).alias("o")).where("k > 1").drop("k")
    later = rows.select("path", "n", "digest").join(first, "digest").where((F.col("path") != F.col("o.path")) | (F.col("n") != F.col("o.n")))
    return later.groupBy("path").agg(F.collect_list(F.struct("n", "o.id", "o.url", "o.date")).alias("revisits"))


def convert_arcs(spark: SparkSession, arcs: str, path: str) -> None:
    """Convert ARC files (plain or .gz) to WARC files, a gzip member a record: the version block becomes a
    warcinfo, bodies of any bytes responses or resources, repeated payloads revisits.

    A task writes its files' bytes itself. A file is named after its source and gets its name when it
    is complete, so a retried task replaces it by the same.
    """
    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.fs as pafs

        fs, root = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
        fs.create_dir(root, recursive=True)
        for batch in batches:
            for source, data, later in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                found, n = {x["n"]: Original(x["id"], x["url"], x["date"]) for x in later or []}, 0
                at = f"{root}/_{uuid.uuid4().hex}.tmp"
                with fs.open_output_stream(at) as out:
                    put = lambda record: out.write(gzip.compress(record + b"\r\n\r\n", mtime=0))  # noqa: B023, E731
                    for r in parse_arc(data.as_buffer(), with_version=True):
                        if r.url.startswith("filedesc://"):
                            put(to_warcinfo(r))
                            continue
                        put(to_warc(r, found.get(n)))
                        n += 1
                fs.move(at, f"{root}/{hashlib.sha1(source.encode()).hexdigest()}.warc.gz")
                yield pa.record_batch([pa.array([source])], ["path"])

    files = spark.read.format("binaryFile").load(arcs).select("path", "content")
    files.join(arc_revisits(files), "path", "left").select("path", "content", "revisits").mapInArrow(convert, "path string").write.format("noop").mode("overwrite").save()


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to) of each record but warcinfo.
    Digests of responses and resources are taken anew from the payload and must agree with the header's.
    refers_to is the page of the record that a revisit names: null where that is none of these archives'
    or no page."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("record_id", pa.string()), ("original", pa.string())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                rows = []
                for head, block in parse_warc(data.as_buffer()):
                    if head["warc-type"] == "warcinfo":
                        continue
                    http, payload = split_http(block)
                    said, kind = head["warc-payload-digest"], head["warc-type"]
                    if kind != "revisit" and digest(payload) != said:
                        raise ValueError(f"payload of {head['warc-record-id']} differs from its digest")
                    page = http_field(http, b"x-page-id")
                    rows.append({
                        "page_id": int(page) if page not in (None, "-") else None, "url": head["warc-target-uri"],
                        "payload_bytes": len(payload) if kind != "revisit" else int(head.get("x-payload-length") or http_field(http, b"content-length") or 0),
                        "payload_digest": base64.b32decode(said.removeprefix("sha1:")).hex(), "record_type": kind,
                        "record_id": head["warc-record-id"], "original": head.get("warc-refers-to"),
                    })
                yield pa.RecordBatch.from_pylist(rows, schema)

    files = spark.read.format("binaryFile").load(path).select("content")
    rows = staged(files.mapInArrow(read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, record_id string, original string"), "warc-records")
    # Each original once, with its page; revisits meet them by identifier.
    named = rows.where("original is not null").select("original").distinct()
    pages = rows.select(F.col("record_id").alias("original"), F.col("page_id").alias("refers_to")).join(named, "original").groupBy("original").agg(F.max("refers_to").alias("refers_to"))
    return rows.join(staged(pages, "originals"), "original", "left").select("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = scratch(spark, "warc")
    pages_to_warc(table(spark, sf_dir, "pages"), at)
    return read_warc(spark, at).drop("url")


SQL = f"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
m AS (SELECT page_id, n, sha1(h) AS d, max(page_id) OVER (PARTITION BY h) AS last FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
  CASE WHEN n >= {LEAST} AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= {LEAST} AND page_id <> last THEN last END AS refers_to
FROM m
"""
