"""Legacy archive converter: ARC archives to WARC records, archives of them, and their reading.

An ARC archive opens with a version block that names the fields of its header lines; version 1 lines
have five fields and version 2 lines ten, the last of which is the declared length of the content. The
converter follows the declared lengths and synthesises what WARC asks for: record ids (from the content,
so a rerun gives the same), ISO timestamps, record types and digests.

Records with equal payloads of at least MIN_REVISIT bytes are written once; later ones become revisits.
The archives are written by Spark's text writer with WARC's record end as line separator.

Cases: a null payload is empty, a null url is written as `unknown:`, white space in urls is escaped, rows
without page_id are responses, repeated rows are records of their own with one id, a record that declares
more than its archive holds raises, an empty table gives no rows, and other columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm import columns, tables

MIN_REVISIT = 100
ARCHIVE_BYTES = 32 << 20
ARC_BYTES = 4 << 20
CRAWL_DATE = "20000101000000"

# Fixed values of the formats.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
RECORD_END = "\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass(frozen=True)
class ArcRecord:
    url: str
    ip: str
    date: str
    mime: str
    content: bytes
    is_version_block: bool = False


def arc_archive(records: list[ArcRecord], name: str, version: int) -> bytes:
    """An archive of the given version around the records."""
    about = f"{version} 0 converter\n{ARC_FIELDS[version]}\n".encode()
    parts = [_arc_line(ArcRecord(f"filedesc://{name}", "0.0.0.0", CRAWL_DATE, "text/plain", about), version, 0, name), about, b"\n"]
    at = sum(map(len, parts))
    for r in records:
        piece = [_arc_line(r, version, at, name), r.content, b"\n"]
        at += sum(map(len, piece))
        parts += piece
    return b"".join(parts)


def _arc_line(r: ArcRecord, version: int, offset: int, name: str) -> bytes:
    extra = "" if version == 1 else f" 200 {hashlib.md5(r.content).hexdigest()} - {offset} {name}"
    return f"{r.url} {r.ip} {r.date} {r.mime}{extra} {len(r.content)}\n".encode()


def read_arc(archive: bytes) -> Iterator[ArcRecord]:
    """The records of an archive, its version block first."""
    at, fields = 0, None
    while at < len(archive):
        if archive[at] in b"\r\n":
            at += 1
            continue
        stop = archive.index(b"\n", at)
        line = archive[at:stop].rstrip(b"\r").decode("utf-8", "replace")
        first = fields is None
        if first:  # the first line has the same form in both versions but for its number of fields
            length = int(line.rsplit(" ", 1)[1])
            version = int(archive[stop + 1 : stop + 1 + length].split(b" ", 1)[0])
            fields = ARC_FIELDS[version].split(" ")
        values = dict(zip(fields, line.rsplit(" ", len(fields) - 1)))
        length = int(values["Archive-length"])
        at = stop + 1 + length
        if at > len(archive):
            raise ValueError(f"{values['URL']}: the archive ends inside the record")
        yield ArcRecord(values["URL"], values["IP-address"], values["Archive-date"], values["Content-type"], archive[stop + 1 : at], first)


def http_payload(content: bytes) -> tuple[bytes, bytes]:
    """Head (with its empty line) and body of an HTTP message; other content has no head."""
    if not content.startswith(b"HTTP/"):
        return b"", content
    cut = content.find(b"\r\n\r\n")
    return (content, b"") if cut < 0 else (content[: cut + 4], content[cut + 4 :])


def iso_date(stamp: str) -> str:
    """14 digits, or fewer, to an ISO timestamp."""
    full = (stamp + "19700101000000"[len(stamp) :])[:14]
    return f"{full[:4]}-{full[4:6]}-{full[6:8]}T{full[8:10]}:{full[10:12]}:{full[12:14]}Z"


def warc_identity(r: ArcRecord) -> tuple[str, str, str, str]:
    """Record id, type, content type and block digest that stand for an ARC record."""
    digest = hashlib.sha256(r.content).hexdigest()
    record_id = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{r.url} {r.date} {digest}')}>"
    if r.is_version_block:
        return record_id, "warcinfo", "application/warc-fields", digest
    if r.content.startswith(b"HTTP/"):
        return record_id, "response", "application/http; msgtype=response", digest
    return record_id, "resource", r.mime, digest


def legacy_archives(pages: DataFrame) -> DataFrame:
    """Pages as ARC archives of bounded size, versions 1 and 2 in turn: one row per archive, content as binary."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = 0
        for block in columns.blocks(batches, "html", ARC_BYTES):
            records = []
            for page_id, url, html in zip(*[block.column(c).to_pylist() for c in ("page_id", "url", "html")]):
                head = f"HTTP/1.0 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page-Id: {'' if page_id is None else page_id}\r\n\r\n"
                target = "".join(f"%{ord(c):02X}" if c.isspace() else c for c in url) if url else "unknown:"
                records.append(ArcRecord(target, "0.0.0.0", CRAWL_DATE, "text/html", head.encode() + (html or "").encode("utf-8")))
            made += 1
            yield pa.RecordBatch.from_arrays([pa.array([arc_archive(records, f"pages-{made}.arc", 1 + made % 2)], pa.binary())], ["archive"])

    return pages.select("page_id", "url", "html").mapInArrow(pack, "archive binary")


RECORDS = "record_id string, warc_type string, target_uri string, date string, content_type string, ip string, page_id long, payload_digest string, payload_bytes long"


def convert(archives: DataFrame, with_block: bool = True) -> DataFrame:
    """The records of ARC archives with everything a WARC record needs; `block` only where asked for."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column("archive"):
                rows = []
                for r in read_arc(archive.as_py()):
                    record_id, kind, content_type, _ = warc_identity(r)
                    head, body = http_payload(r.content)
                    row = (record_id, kind, r.url, iso_date(r.date), content_type, r.ip, _page_id(head), hashlib.sha256(body).hexdigest(), len(body))
                    rows.append((*row, r.content) if with_block else row)
                yield pa.RecordBatch.from_pylist([dict(zip(names, row)) for row in rows], schema)

    fields = [(f.split()[0], pa.int64() if f.split()[1] == "long" else pa.string()) for f in RECORDS.split(", ")]
    schema = pa.schema([*fields, ("block", pa.binary())] if with_block else fields)
    names = schema.names
    return archives.mapInArrow(each, RECORDS + (", block binary" if with_block else ""))


def _page_id(head: bytes) -> int | None:
    at = head.find(b"\r\nX-Page-Id: ")
    value = head[at + 13 : head.index(b"\r\n", at + 13)] if at >= 0 else b""
    return int(value) if value else None


def write_archives(archives: DataFrame) -> str:
    """Convert, mark revisits, and write compressed WARC archives to the shared folder; returns their place."""
    spark = archives.sparkSession
    listed = tables.keep(convert(archives, with_block=False), "warc-list")
    alike = (F.col("warc_type") == "response") & (F.col("payload_bytes") >= MIN_REVISIT) & F.col("page_id").isNotNull()
    firsts = listed.where(alike).groupBy("payload_digest").agg(F.min_by(F.struct("page_id", "record_id", "target_uri"), "page_id").alias("first"))
    later = listed.where(alike).join(firsts, "payload_digest").where(F.col("page_id") > F.col("first.page_id"))
    revisits = later.select("record_id", F.col("first.page_id").alias("_page"), F.col("first.record_id").alias("_refers"), F.col("first.target_uri").alias("_uri")).dropDuplicates(["record_id"])
    total = listed.agg(F.sum("payload_bytes")).first()[0] or 0
    number = max(1, -(-total // ARCHIVE_BYTES))
    # The records are dealt once, by id: the join reuses that, and every part is one archive.
    records = convert(archives).repartition(number, "record_id").join(revisits, "record_id", "left")
    again = F.col("_refers").isNotNull()
    body = F.when(again, F.expr("substring(block, 1, position(unhex('0D0A0D0A'), block) + 3)")).otherwise(F.col("block"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(again, F.lit("revisit")).otherwise(F.col("warc_type"))),
        line("WARC-Record-ID", F.col("record_id")),
        line("WARC-Target-URI", F.col("target_uri")),
        line("WARC-Date", F.col("date")),
        line("WARC-IP-Address", F.col("ip")),
        line("WARC-Block-Digest", F.concat(F.lit("sha256:"), F.sha2("body", 256))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        F.when(
            again,
            F.concat(
                line("WARC-Profile", F.lit(REVISIT_PROFILE)), line("WARC-Refers-To", F.col("_refers")), line("WARC-Refers-To-Target-URI", F.col("_uri")),
                line("X-Refers-To-Page-Id", F.col("_page").cast("string")), line("X-Payload-Length", F.col("payload_bytes").cast("string")),
            ),
        ).otherwise(F.lit("")),
        line("Content-Type", F.col("content_type")),
        line("Content-Length", F.octet_length("body").cast("string")),
        F.lit("\r\n"),
    )
    whole = records.withColumn("body", body).select(F.concat(F.encode(head, "UTF-8"), F.col("body")).cast("string").alias("value"))
    place = tables.new_folder(spark, "warc")
    whole.write.option("lineSep", RECORD_END).option("compression", "gzip").text(place)
    return place


def read_warc(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Fields (names in lower case) and block of each record."""
    at = 0
    while at < len(archive):
        stop = archive.index(b"\r\n\r\n", at)
        first, *lines = archive[at:stop].decode("utf-8", "replace").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError("not the start of a WARC record")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        end = stop + 4 + int(fields["content-length"])
        if archive[end : end + 4] != b"\r\n\r\n":
            raise ValueError("a record does not end where its length says")
        yield fields, archive[stop + 4 : end]
        at = end + 4


def read_archives(spark, place: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of the page records in WARC archives.

    Digests and sizes of responses are taken from the block and checked against the header; a revisit has those of the record it refers to.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                data = content.as_py()
                if data[:2] == b"\x1f\x8b":
                    data = zlib.decompress(data, 31)
                rows = []
                for fields, block in read_warc(data):
                    kind = fields["warc-type"]
                    if kind not in ("response", "revisit"):
                        continue
                    head, body = http_payload(block)
                    said = fields["warc-payload-digest"].removeprefix("sha256:")
                    if kind == "response" and hashlib.sha256(body).hexdigest() != said:
                        raise ValueError(f"{fields['warc-record-id']}: the payload differs from its digest")
                    size = len(body) if kind == "response" else int(fields["x-payload-length"])
                    refers = int(fields["x-refers-to-page-id"]) if kind == "revisit" else None
                    rows.append({"page_id": _page_id(head), "payload_bytes": size, "payload_digest": said, "record_type": kind, "refers_to": refers})
                yield pa.RecordBatch.from_pylist(rows, schema)

    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(place)
    return files.select("content").mapInArrow(each, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


SQL = f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= {MIN_REVISIT} GROUP BY payload_digest)
SELECT page_id, payload_bytes, p.payload_digest, CASE WHEN f.first < page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN f.first < page_id THEN f.first END AS refers_to
FROM p LEFT JOIN f ON f.payload_digest = p.payload_digest
"""
