from __future__ import annotations

import hashlib

import pytest

from attesta.llm import archives


@pytest.mark.parametrize("version", [1, 2])
def test_arc_round_trip(version):
    records = [archives.ArcRecord("http://a/b", "1.2.3.4", "19970101123456", "text/html", b"HTTP/1.0 200 OK\r\nA: b\r\n\r\nbody\n\n"), archives.ArcRecord("dns:a", "1.2.3.4", "1997", "text/dns", b""),
               archives.ArcRecord("http://a/with space", "1.2.3.4", "19970101123456", "text/html", b"http://x 1.2.3.4 19970101123456 text/html 9999\n")]
    got = list(archives.read_arc(archives.arc_archive(records, "x.arc", version)))
    assert got[0].is_version_block and got[0].url == "filedesc://x.arc" and got[1:] == records
    with pytest.raises(ValueError):
        list(archives.read_arc(archives.arc_archive(records, "x.arc", version)[:-20]))


def test_synthesised_fields():
    page = archives.ArcRecord("http://a", "1.2.3.4", "19970101123456", "text/html", b"HTTP/1.0 200 OK\r\n\r\nx")
    record_id, kind, content_type, digest = archives.warc_identity(page)
    assert kind == "response" and content_type.startswith("application/http") and digest == hashlib.sha256(page.content).hexdigest() and record_id == archives.warc_identity(page)[0]
    assert archives.warc_identity(archives.ArcRecord("dns:a", "", "1997", "text/dns", b"x"))[1:3] == ("resource", "text/dns")
    assert archives.iso_date("19970203040506") == "1997-02-03T04:05:06Z" and archives.iso_date("199702") == "1997-02-01T00:00:00Z"


def test_pages_through_archives(spark):
    same, crlf = "<p>é</p>" * 30, "a\r\n\r\nWARC/1.1\r\n\r\n" * 20
    rows = [(5, "http://a", same), (3, "http://b", same), (9, None, same), (3, "http://b", same), (1, "x y\n", None), (2, "u", ""), (4, "v", "short"), (6, "w", "short"), (None, "n", same), (7, "c", crlf), (8, "d", crlf), (10, "long", "z" * 3_000_000)]
    pages = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, block string")
    place = archives.write_archives(archives.legacy_archives(pages))
    got = sorted(((r["page_id"] or -1, r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in archives.read_archives(spark, place).collect()), key=str)
    first = {same: 3, crlf: 7}
    want = []
    for page, _, html in rows:
        data = (html or "").encode()
        again = page is not None and html in first and page > first[html]
        want.append((page or -1, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first[html] if again else None))
    assert got == sorted(want, key=str)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(place).select("content").collect()
    assert all(bytes(f["content"][:2]) == b"\x1f\x8b" for f in files)


def test_no_pages(spark):
    place = archives.write_archives(archives.legacy_archives(spark.createDataFrame([], "page_id long, url string, html string")))
    assert archives.read_archives(spark, place).count() == 0
