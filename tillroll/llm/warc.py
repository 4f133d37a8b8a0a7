"""Legacy archives to WARC: parse ARC files, convert their records, write and read WARC.

An ARC file begins with a version block that declares its version and names the fields of its
records' header lines: version 1 has URL, address, date, type and length, version 2 also result
code, checksum, location, offset and file name.  A header line is followed by as many bytes as
it declares and a line end.  Each record gets an equivalent WARC record: an identifier made
from its content (so a second conversion gives the same), the date in ISO form, the type by its
scheme, and SHA-256 digests of block and payload.  ``filedesc:`` becomes ``warcinfo``, http(s)
``response``, other schemes ``resource``.

Of records with equal payloads of at least ``min_bytes`` the one with the least source id (then
the first) keeps its payload, the others become ``revisit`` records that refer to it.

WARC files are gzip with a member for each record, written by Spark's own writer, so they can
go wherever Spark can write.  That writer ends each record with a separator byte; as a gzip
member of a record under 16 MiB ends in a zero byte, the separator is that byte, and a larger
record is followed by an empty member, which ends so too.

HTTP heads end at the first empty line, whether lines end in CR LF or, as in early archives, in
LF alone; a record without a status line is all payload.  Version 2's result code, checksum and
location become ``X-Archive-`` headers.

A null payload is empty, and a null URL becomes ``urn:page:`` and the id.  Very long payloads are
read whole, a record at a time, and lie in files of their own.  Ids may be of any type that casts
to text and back.  Repeated rows have records of their own; a null id is kept as null and sorts
last.  Ties: of equal ids the record read first is the response.  An empty table gives no records.
Pages may have further columns of any names.  Malformed archives raise ValueError with the offset.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterable, Iterator
from typing import BinaryIO, NamedTuple
from urllib.parse import quote, unquote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm._common import by_position, position, release, staged, staging_path

#: Field names of the two versions' header lines.
ARC_FIELDS = {
    "1": "URL IP-address Archive-date Content-type Archive-length",
    "2": "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:tillroll:arc")
SEGMENT_BYTES = 4 << 20
#: Payloads up to so many bytes, and how many of their records a file has: a file holds about 256 MB, or one larger record.
FILES = ((64 << 10, 4096), (4 << 20, 64), (None, 1))
HEAD_END = re.compile(rb"\r?\n\r?\n")
DATE = "20240101000000"


class Record(NamedTuple):
    uri: str
    date: str
    ip: str
    kind: str
    mime: str
    head: bytes  # of the HTTP message, with its empty line
    payload: bytes
    extra: tuple[tuple[str, str], ...] = ()  # headers from version 2's fields


def http_parts(block: bytes) -> tuple[bytes, bytes]:
    """Head and payload of an HTTP message; no head if it doesn't begin with a status line."""
    end = HEAD_END.search(block) if block.startswith(b"HTTP/") else None
    return (block[: end.end()], block[end.end() :]) if end else (b"", block)


# ---- ARC ------------------------------------------------------------------------------------


def write_arc(rows: Iterable[tuple[object, str | None, bytes]], version: str = "1", date: str = DATE) -> bytes:
    """An ARC file of (source id, url, html) rows; the id is kept as an HTTP header."""
    fields = ARC_FIELDS[version]
    about = f"{version} 0 tillroll\n{fields}\n".encode()
    extra = "200 - - 0 pages.arc " if version == "2" else ""
    out = [f"filedesc://pages.arc 0.0.0.0 {date} text/plain {extra}{len(about)}\n".encode(), about, b"\n"]
    at = sum(map(len, out))
    for i, url, html in rows:
        head = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + ("" if i is None else f"X-Source-ID: {quote(str(i), safe='')}\r\n") + f"Content-Length: {len(html)}\r\n\r\n"
        block = head.encode() + html
        uri = (url or "").replace(" ", "%20").replace("\n", "%0A").replace("\r", "%0D") or f"urn:page:{i if i is None else quote(str(i), safe='')}"
        extra = f"200 - - {at} pages.arc " if version == "2" else ""
        line = f"{uri} 0.0.0.0 {date} text/html {extra}{len(block)}\n".encode()
        out += [line, block, b"\n"]
        at += len(line) + len(block) + 1
    return b"".join(out)


def read_arc(stream: BinaryIO) -> Iterator[Record]:
    """Records of an ARC file of either version, in constant memory but for one record."""
    fields, at = None, 0
    while line := stream.readline():
        at += len(line)
        if not line.strip():
            continue
        n = len(fields) if fields else (5 if len(line.split()) == 5 else 10)
        parts = line.decode("utf-8", "surrogateescape").rstrip("\r\n").rsplit(" ", n - 1)
        if len(parts) != n or not parts[-1].isdigit():
            raise ValueError(f"no ARC header line before offset {at}: {line[:80]!r}")
        block = stream.read(int(parts[-1]))
        if len(block) != int(parts[-1]):
            raise ValueError(f"ARC record at offset {at} declares {parts[-1]} bytes and has {len(block)}")
        at += len(block)
        if fields is None:
            declared = block.decode("utf-8", "replace").split("\n")
            fields = declared[1].split() if len(declared) > 1 and declared[1].startswith("URL ") else ARC_FIELDS.get(declared[0].split(" ")[0], "").split()
            if not fields or len(fields) not in (5, 10):
                raise ValueError(f"no known ARC version: {block[:60]!r}")
            yield Record(parts[0], iso_date(parts[2]), parts[1], "warcinfo", "text/plain", b"", block)
            continue
        uri, scheme = parts[0], parts[0].partition(":")[0].lower()
        head, payload = http_parts(block) if scheme in ("http", "https") or block.startswith(b"HTTP/") else (b"", block)
        named = zip(("Result-Code", "Checksum", "Location"), parts[4:7], strict=False) if n == 10 else ()
        extra = tuple((f"X-Archive-{name}", value) for name, value in named if value != "-")
        yield Record(uri, iso_date(parts[2]), parts[1], "response" if head else "resource", parts[3], head, payload, extra)


def iso_date(digits: str) -> str:
    """From 14 digits, or the first of them, to ISO 8601."""
    d = (digits + "00000101000000"[len(digits) :]) if digits.isdigit() and len(digits) <= 14 else "19700101000000"
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def header(head: bytes, name: str) -> str | None:
    """The first value of an HTTP or WARC header."""
    want = name.lower().encode()
    for line in head.split(b"\n")[1:]:
        key, colon, value = line.partition(b":")
        if colon and key.strip().lower() == want:
            return value.strip().decode("utf-8", "surrogateescape")
    return None


# ---- WARC -----------------------------------------------------------------------------------


def record_id(uri: str, date: str, digest: str, source: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{uri} {date} {digest} {source}')}>"


def member(data: bytes) -> bytes:
    """A gzip member that ends in a zero byte, without that byte."""
    made = gzip.compress(data, 6, mtime=0)
    return (made if made[-1] == 0 else made + gzip.compress(b"", mtime=0))[:-1]


def write_record(kind: str, rid: str, uri: str, date: str, ip: str, mime: str, head: bytes, payload: bytes, digest: str, size: int, extra: list[tuple[str, str]]) -> bytes:
    block = head if kind == "revisit" else head + payload
    content = "application/http; msgtype=response" if head else mime
    lines = [("WARC-Type", kind), ("WARC-Record-ID", rid), ("WARC-Date", date), ("WARC-Target-URI", uri), ("WARC-IP-Address", ip), *extra, ("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Payload-Length", str(size)), ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"), ("Content-Type", content), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines).encode("utf-8", "surrogateescape") + b"\r\n" + block + b"\r\n\r\n"


def read_warc(stream: BinaryIO) -> Iterator[tuple[bytes, bytes]]:
    """(header lines, block) of each record of an uncompressed stream."""
    while first := stream.readline():
        if not first.strip():
            continue
        if not first.startswith(b"WARC/"):
            raise ValueError(f"no WARC record: {first[:60]!r}")
        lines = [first]
        while (line := stream.readline()).strip():
            lines.append(line)
        head = b"".join(lines)
        size = int(header(head, "Content-Length") or -1)
        block = stream.read(size)
        if size < 0 or len(block) != size:
            raise ValueError(f"a WARC record declares {size} bytes and has {len(block)}")
        yield head, block


# ---- DataFrames -----------------------------------------------------------------------------


def arc_segments(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Rows of ``content``, each an ARC file of some pages; versions 1 and 2 by turns."""
    docs = by_position(pages)
    rows = docs.select(F.col(position(pages, id_col)).cast("string").alias("i"), F.col(position(pages, url_col)).alias("u"), F.coalesce(F.col(position(pages, html_col)), F.lit("")).cast("binary").alias("h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = 0
        for batch in batches:
            held, size = [], 0
            for row in zip(*(batch.column(c).to_pylist() for c in "iuh"), strict=True):
                held.append(row)
                size += len(row[2])
                if size >= SEGMENT_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([write_arc(held, "12"[turn % 2])], pa.binary())], names=["content"])
                    held, size, turn = [], 0, turn + 1
            if held:
                yield pa.RecordBatch.from_arrays([pa.array([write_arc(held, "12"[turn % 2])], pa.binary())], names=["content"])
                turn += 1

    return rows.mapInArrow(run, "content binary")


_RECORD = "source string, uri string, date string, ip string, kind string, mime string, head binary, packed binary, extra string, payload_bytes long, payload_digest string, warc_id string"


def convert_arc(archives: DataFrame, content_col: str = "content") -> DataFrame:
    """A row for each record of ARC files (plain or gzip) in a binary column; ``packed`` is the payload under zstd.

    The binaryFile source gives such a column, so archives can come from wherever Spark can read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor().compress
        names = [f.split(" ")[0] for f in _RECORD.split(", ")]

        def table(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64() if f.endswith("long") else pa.binary() if f.endswith("binary") else pa.string() for f in _RECORD.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            rows, size = [], 0
            for content in batch.column(0):
                data = content.as_py() or b""
                for r in read_arc(gzip.open(io.BytesIO(data)) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)):
                    source = header(r.head, "X-Source-ID")
                    digest = hashlib.sha256(r.payload).hexdigest()
                    extra = "\n".join(f"{k}: {v}" for k, v in r.extra)
                    rows.append((None if source is None else unquote(source), r.uri, r.date, r.ip, r.kind, r.mime, r.head, pack(r.payload), extra, len(r.payload), digest, record_id(r.uri, r.date, digest, source)))
                    size += len(r.payload)
                    if size >= SEGMENT_BYTES:
                        yield table(rows)
                        rows, size = [], 0
            if rows:
                yield table(rows)

    return archives.select(content_col).mapInArrow(run, _RECORD)


def with_revisits(records: DataFrame, min_bytes: int = 100, id_type: str = "string") -> DataFrame:
    """Add ``rep``, the record that a repeated payload refers to, or null; sources are ordered as id_type.

    Digests are counted from narrow rows, pre-aggregated; only those found twice are joined, so
    payloads meet the answers by row id, evenly, not by a digest that half of them may share.
    """
    records = staged(records.withColumn("rid", F.monotonically_increasing_id()), "records")
    narrow = records.where((F.col("kind") == "response") & (F.col("payload_bytes") >= min_bytes)).select("rid", "source", "uri", "date", "warc_id", "payload_digest")
    # Least first by hash aggregation on plain columns, then its other fields by a join on rid.
    order = F.struct(F.col("source").isNull(), F.col("source").cast(id_type).alias("source"), "rid")
    twice = narrow.groupBy("payload_digest").agg(F.count("*").alias("c"), F.min(order).alias("o")).where("c > 1").select("payload_digest", F.col("o.rid").alias("r_rid"))
    reps = twice.join(narrow.select(F.col("rid").alias("r_rid"), F.struct("source", "uri", "date", "warc_id").alias("rep")), "r_rid")
    again = narrow.select("rid", "payload_digest").join(reps, "payload_digest").where("rid != r_rid").select("rid", "rep")
    # Staged, so that its size is known before the join is planned: only if it is small is it broadcast and no payload shuffled.
    again = staged(again, "revisits")
    return records.join(again, "rid", "left").drop("rid")


def write_warcs(records: DataFrame, path: str, files: tuple[tuple[int | None, int], ...] = FILES) -> None:
    """Write WARC files (gzip, a member for each record) in folders under path, one for each size of payloads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                rep, extra = r["rep"], []
                if r["source"] is not None:
                    extra.append(("X-Source-ID", quote(r["source"], safe="")))
                extra += [tuple(x.split(": ", 1)) for x in (r["extra"] or "").split("\n") if x]
                if rep:
                    extra += [("WARC-Profile", REVISIT), ("WARC-Refers-To", rep["warc_id"]), ("WARC-Refers-To-Target-URI", rep["uri"]), ("WARC-Refers-To-Date", rep["date"])]
                    if rep["source"] is not None:
                        extra.append(("X-Refers-To-Source-ID", quote(rep["source"], safe="")))
                payload = b"" if rep else unpack.decompress(r["packed"], max_output_size=max(1, r["payload_bytes"]))
                out.append(member(write_record("revisit" if rep else r["kind"], r["warc_id"], r["uri"], r["date"], r["ip"], r["mime"], r["head"], payload, r["payload_digest"], r["payload_bytes"], extra)))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    least = -1
    for k, (most, records_a_file) in enumerate(files):
        size = F.when(F.col("rep").isNotNull(), 0).otherwise(F.col("payload_bytes"))
        part = records.where((size > least) & (size <= most) if most is not None else size > least)
        part.mapInArrow(run, "value binary").select(F.col("value").cast("string")).write.option("lineSep", "\0").option("maxRecordsPerFile", records_a_file).text(f"{path}/size={k}")
        least = most


_READ = "source string, payload_bytes long, payload_digest string, record_type string, refers_to string, warc_id string, uri string, date string, verified boolean"


def read_warcs(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record of the WARC files under path; ``verified`` says that block and payload have the declared digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
        names, types = zip(*(f.split(" ") for f in _READ.split(", ")), strict=True)
        for batch in batches:
            for content in batch.column(0):
                rows = []
                data = content.as_py()
                stream = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(data))) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
                for head, block in read_warc(stream):
                    kind, declared = header(head, "WARC-Type"), (header(head, "WARC-Payload-Digest") or "").removeprefix("sha256:")
                    number = lambda x: int(x) if x else None
                    source = lambda x: None if x is None else unquote(x)
                    good = header(head, "WARC-Block-Digest") == f"sha256:{hashlib.sha256(block).hexdigest()}"
                    size, digest = number(header(head, "X-Payload-Length")), declared
                    if kind != "revisit":
                        payload = http_parts(block)[1] if (header(head, "Content-Type") or "").startswith("application/http") else block
                        size, digest = len(payload), hashlib.sha256(payload).hexdigest()
                        good = good and digest == declared
                    rows.append((source(header(head, "X-Source-ID")), size, digest, kind, source(header(head, "X-Refers-To-Source-ID")), header(head, "WARC-Record-ID"), header(head, "WARC-Target-URI"), header(head, "WARC-Date"), good))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), kinds[t]) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=list(names))

    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content").mapInArrow(run, _READ)


def archive_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 100) -> DataFrame:
    """Pages into ARC files, those into WARC files in the shared folder, and these read back, without warcinfo records."""
    spark = pages.sparkSession
    path, kind = staging_path(spark, "warc"), by_position(pages).schema[position(pages, id_col)].dataType
    write_warcs(with_revisits(convert_arc(arc_segments(pages, id_col, url_col, html_col)), min_bytes, kind.simpleString()), path)
    release(spark)
    read = read_warcs(spark, path).where("record_type != 'warcinfo'")
    return read.withColumns({"source": F.col("source").cast(kind), "refers_to": F.col("refers_to").cast(kind)})
