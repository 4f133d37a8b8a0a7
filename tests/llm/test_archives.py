"""Archives that others wrote, and our files read by code that shares nothing with the writer."""

import gzip
import hashlib
import io
import re
import zlib

from tillroll.llm import warc


def members(raw):
    """The gzip members of a file, one by one."""
    while raw:
        one = zlib.decompressobj(31)
        yield one.decompress(raw)
        raw = one.unused_data


def record(raw):
    """(headers, block) of one uncompressed record."""
    m = re.fullmatch(rb"WARC/1\.1\r\n((?:[^\r\n]+\r\n)+)\r\n(.*)\r\n\r\n", raw, re.S)
    return dict(x.decode().split(": ", 1) for x in m[1].split(b"\r\n") if x), m[2]


def test_early_archives_with_bare_line_feeds():
    page = b"HTTP/1.0 200 OK\nServer: NCSA\nContent-type: text/html\n\n<html>\n\nold\r\n\r\n</html>"
    raw = b"filedesc://f.arc 0.0.0.0 19961001000000 text/plain 76\n1 0 Some Archive\nURL IP-address Archive-date Content-type Archive-length\n\n\n"
    raw += b"http://old.example/ 1.2.3.4 19961001120000 text/html %d\n" % len(page) + page + b"\n"
    raw += b"http://bare.example/ 1.2.3.4 19961001120000 text/html 13\n<html>\n\nno</h\n"
    info, one, two = warc.read_arc(io.BytesIO(raw))
    assert info.kind == "warcinfo" and (one.kind, one.payload, one.head) == ("response", b"<html>\n\nold\r\n\r\n</html>", page[: page.index(b"<html>")])
    assert warc.header(one.head, "server") == "NCSA" and (two.kind, two.payload) == ("resource", b"<html>\n\nno</h")


def test_fields_of_version_2_become_headers(spark, tmp_path):
    head = b"filedesc://g.arc 0.0.0.0 20010101000000 text/plain 200 - - 0 g.arc %d\n"
    about = b"2 0 X\nURL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length\n"
    page = b"HTTP/1.1 302 Found\r\nX-Source-ID: a%2Fb\r\n\r\nmoved"
    raw = head % len(about) + about + b"\nhttp://v2.example/ 9.9.9.9 20010203040506 text/html 302 0a1b http://to.example/ 120 g.arc %d\n" % len(page) + page + b"\n"
    df = spark.createDataFrame([(raw,), (gzip.compress(raw),)], "content binary")
    warc.write_warcs(warc.with_revisits(warc.convert_arc(df), 1), str(tmp_path / "out"))
    found = [record(m) for f in (tmp_path / "out").rglob("part-*") for m in members(f.read_bytes()) if m]
    pages = [(h, b) for h, b in found if h["WARC-Type"] != "warcinfo"]
    assert sorted(h["WARC-Type"] for h, _ in pages) == ["response", "revisit"]
    for h, b in pages:
        assert (h["X-Archive-Result-Code"], h["X-Archive-Checksum"], h["X-Archive-Location"], h["WARC-Date"], h["X-Source-ID"]) == ("302", "0a1b", "http://to.example/", "2001-02-03T04:05:06Z", "a%2Fb")
        assert h["WARC-Block-Digest"] == "sha256:" + hashlib.sha256(b).hexdigest() and int(h["Content-Length"]) == len(b)
        assert h["WARC-Payload-Digest"] == "sha256:" + hashlib.sha256(b"moved").hexdigest()


def test_files_are_read_by_another_reader_and_cut_by_size(spark, tmp_path):
    rows = [(f"id {i}/ü", f"http://h/{i}", "x" * (5 if i else 5_000_000) + str(i)) for i in range(30)] + [("id 31", None, None), ("id 30", "u:", "x" * 5 + "7" + "y" * 200), ("id 29", "u:", "x" * 5 + "7" + "y" * 200)]
    pages = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "page_id string, url string, html string, i string, u string")
    path = str(tmp_path / "out")
    records = warc.with_revisits(warc.convert_arc(warc.arc_segments(pages)))
    warc.write_warcs(records, path, files=((1000, 10), (None, 1)))
    files = [f for f in (tmp_path / "out").rglob("part-*") if f.stat().st_size]
    listed = [[record(m) for m in members(f.read_bytes()) if m] for f in files]
    assert all(len(x) <= 10 for x in listed) and sum(map(len, listed)) == records.count()
    assert gzip.decompress(files[0].read_bytes()).startswith(b"WARC/1.1\r\n")
    for h, b in (x for f in listed for x in f):
        assert h["WARC-Block-Digest"] == "sha256:" + hashlib.sha256(b).hexdigest()
    got = {(r.source, r.record_type, r.refers_to, r.verified) for r in warc.archive_pages(pages).collect()}
    assert got == {(r[0], "revisit" if r[0] == "id 30" else "response", "id 29" if r[0] == "id 30" else None, True) for r in rows}
