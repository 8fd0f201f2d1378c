"""Legacy archive converter: ARC files (versions 1 and 2) to WARC files, and readers of both.

An ARC record is one header line of blank-separated fields, whose names and number depend on the version that the
file's first record declares, and a body of the declared length. The converter makes WARC records of the same
content: an identifier derived from what the record is (so that a task run again gives the same one), a timestamp from
the archive date, a type, and digests of block and payload. Records whose payload an earlier record has in full
become revisits.

Archives are written by Spark's text writer (each record is one value; the separator ends it) with gzip, and read as
binary files, so any store that Spark reaches can hold them, and a task that runs twice leaves one file.

Defined cases: a null html is an empty payload; a null url is "unknown:"; white space in a url is percent-encoded; a
record cut short is kept and marked as truncated; a date that is no date gives the start of 1970; equal page_ids are
pages of their own, and a null page_id is always a response; an empty table gives no rows. Columns other than page_id,
url and html are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import datetime

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.storage import materialize, new_path, release

# Field names of header lines by version: fixed values of the ARC format.
ARC_FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
# Profile of revisit records: a fixed value of the WARC format.
IDENTICAL_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURED = "20240101000000"
MIN_REVISIT_BYTES = 100
RECORDS_PER_FILE = 4096  # an archive is read as one value: pages of 100 kB on average make 400 MB before gzip


@dataclass
class ArcRecord:
    fields: dict[str, str]
    body: bytes
    truncated: bool = False


@dataclass
class WarcRecord:
    headers: dict[str, str] = field(default_factory=dict)
    block: bytes = b""
    truncated: bool = False


def _opened(data: bytes) -> io.BufferedIOBase:
    raw = io.BytesIO(data)
    return gzip.GzipFile(fileobj=raw) if data[:2] == b"\x1f\x8b" else raw


def read_arc(data: bytes) -> Iterator[ArcRecord]:
    """Records of an ARC file, plain or gzipped (by file or by record), the version block first."""
    source, names = _opened(data), ARC_FIELDS[1]
    while line := source.readline():
        if not line.strip():
            continue
        parts = line.decode("utf-8", "replace").rstrip("\r\n").split(" ")
        if parts[0].startswith("filedesc:"):
            names = ARC_FIELDS[1]
        extra = len(parts) - len(names)
        if extra > 0:  # blanks within the content type, the only free field
            parts[3 : 4 + extra] = [" ".join(parts[3 : 4 + extra])]
        if len(parts) != len(names) or not parts[-1].isdigit():
            raise ValueError(f"not an ARC header line: {line[:80]!r}")
        fields = dict(zip(names, parts))
        length = int(fields["Archive-length"])
        body = source.read(length)
        yield ArcRecord(fields, body, len(body) < length)
        if parts[0].startswith("filedesc:"):
            version = int(body.split(b" ", 1)[0] or b"1")
            if version not in ARC_FIELDS:
                raise ValueError(f"ARC version {version} is unknown")
            names = ARC_FIELDS[version]


def arc_version_block(name: str, version: int) -> bytes:
    body = f"{version} 0 kindred\n{' '.join(ARC_FIELDS[version])}\n".encode()
    return f"filedesc://{name} 0.0.0.0 {CAPTURED} text/plain {len(body)}\n".encode() + body


def arc_record(version: int, url: str, body: bytes, date: str = CAPTURED, mime: str = "text/html", code: int = 200, name: str = "-") -> bytes:
    values = {
        "URL": re.sub(r"\s", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url) or "unknown:",
        "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": mime, "Result-code": str(code),
        "Checksum": hashlib.md5(body).hexdigest(), "Location": "-", "Offset": "0", "Filename": name, "Archive-length": str(len(body)),
    }
    return " ".join(values[f] for f in ARC_FIELDS[version]).encode() + b"\n" + body


def http_payload(block: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and entity of an HTTP response; all of the block if it is none."""
    if not block.startswith(b"HTTP/"):
        return {}, block
    head, _, entity = block.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}, entity


def warc_date(date: str) -> str:
    try:
        return datetime.strptime(date.ljust(14, "0")[:14], "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")
    except ValueError:
        return "1970-01-01T00:00:00Z"


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(10).join(parts))}>"


def convert(record: ArcRecord, revisit_of: tuple[str, str] | None = None) -> WarcRecord:
    """The WARC record of an ARC record; revisit_of: identifier and url of the record that has the payload."""
    f = record.fields
    url, block = f["URL"], record.body
    http, payload = http_payload(block)
    digest = "sha256:" + hashlib.sha256(payload).hexdigest()
    if url.startswith("filedesc:"):
        kind, mime = "warcinfo", "application/warc-fields"
        block = f"software: kindred\r\nformat: WARC File Format 1.1\r\ndescription: converted from {url}\r\n".encode()
    elif block.startswith(b"HTTP/"):
        kind, mime = "response", "application/http; msgtype=response"
    else:
        kind, mime = "resource", f["Content-type"] or "application/octet-stream"
    headers = {
        "WARC-Type": kind, "WARC-Record-ID": record_id(kind, url, f["Archive-date"], digest, http.get("x-page-id", "")),
        "WARC-Date": warc_date(f["Archive-date"]),
    }
    if kind != "warcinfo":
        headers |= {"WARC-Target-URI": url, "WARC-IP-Address": f["IP-address"], "WARC-Payload-Digest": digest}
    if revisit_of and kind == "response":
        block = block[: len(block) - len(payload)]
        headers |= {"WARC-Type": "revisit", "WARC-Profile": IDENTICAL_PAYLOAD, "WARC-Refers-To": revisit_of[0], "WARC-Refers-To-Target-URI": revisit_of[1], "WARC-Truncated": "length"}
    elif record.truncated:
        headers["WARC-Truncated"] = "unspecified"
    headers |= {"WARC-Block-Digest": "sha256:" + hashlib.sha256(block).hexdigest(), "Content-Type": mime, "Content-Length": str(len(block))}
    return WarcRecord(headers, block)


def write_warc(record: WarcRecord) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in record.headers.items())
    return head.encode() + b"\r\n" + record.block + b"\r\n\r\n"


def read_warc(data: bytes) -> Iterator[WarcRecord]:
    source = _opened(data)
    while line := source.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:80]!r}")
        headers = {}
        while (line := source.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip()] = value.strip()
        length = int(headers["Content-Length"])
        block = source.read(length)
        yield WarcRecord(headers, block, len(block) < length)


def _write_archives(values: DataFrame, path: str, per_file: int) -> None:
    """values: one binary column; each value ends with a line feed that the writer adds. A task begins another file
    after per_file values."""
    text = values.select(F.col(values.columns[0]).cast("string").alias("value"))
    text.write.option("maxRecordsPerFile", per_file).option("lineSep", "\n").option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(path)


def _archives(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")


def pages_to_arc(pages: DataFrame, path: str, per_file: int = RECORDS_PER_FILE) -> None:
    """Write pages (page_id, url, html) as ARC files of per_file records at most, each with a version block first; those
    of even partitions have version 1, the others 2."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition, place = TaskContext.get().partitionId(), 0
        version = partition % 2 + 1
        for batch in batches:
            values = []
            for page_id, url, html in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html"))):
                name = f"kindred-{partition:05d}-{place // per_file:05d}.arc"
                if place % per_file == 0:
                    values.append(arc_version_block(name, version))
                    place += 1
                payload = (html or "").encode("utf-8", "surrogatepass")
                known = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n{known}\r\n"
                values.append(arc_record(version, url or "unknown:", head.encode() + payload, name=name))
                place += 1
            yield pa.RecordBatch.from_arrays([pa.array(values, pa.binary())], names=["value"])

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    _write_archives(rows.mapInArrow(build, "value binary"), path, per_file)


def _page(headers: dict[str, str]) -> int | None:
    return int(headers["x-page-id"]) if "x-page-id" in headers else None


def _arc_rows(spark: SparkSession, path: str, with_record: bool) -> DataFrame:
    """page_id, url, date, digest and n_bytes of the payload of every page in ARC files; the record itself if wanted."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows: list[tuple] = []
                size = 0
                for record in read_arc(content.as_py()):
                    if record.fields["URL"].startswith("filedesc:"):
                        continue
                    http, payload = http_payload(record.body)
                    row = (_page(http), record.fields["URL"], record.fields["Archive-date"], hashlib.sha256(payload).hexdigest(), len(payload))
                    rows.append((*row, *([record.fields["Content-type"], record.truncated, record.body] if with_record else [])))
                    size += len(record.body) if with_record else 0
                    if size > 4_000_000:
                        yield out(rows)
                        rows, size = [], 0
                yield out(rows)

    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.binary()]
    names = ["page_id", "url", "date", "digest", "n_bytes", "mime", "truncated", "body"]
    if not with_record:
        kinds, names = kinds[:5], names[:5]
    schema = pa.schema(list(zip(names, kinds)))

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows) if rows else [[]] * len(kinds), kinds)], schema=schema)

    ddl = "page_id long, url string, date string, digest string, n_bytes long" + (", mime string, truncated boolean, body binary" if with_record else "")
    return _archives(spark, path).mapInArrow(parse, ddl)


def arc_to_warc(spark: SparkSession, arc_path: str, warc_path: str, min_bytes: int = MIN_REVISIT_BYTES, per_file: int = RECORDS_PER_FILE) -> None:
    """Convert ARC files to WARC files of per_file records at most, each with a warcinfo record first. Of equal payloads of min_bytes or more the smallest page_id's is the response."""
    known = materialize(_arc_rows(spark, arc_path, False), "arc-rows")  # archives are read once for it
    first = known.filter(F.col("n_bytes") >= min_bytes).groupBy("digest").agg(F.count("*").alias("n"), F.min("page_id").alias("first_id")).filter("n > 1 AND first_id IS NOT NULL")
    later = known.select("page_id", "digest").join(first.select("digest", "first_id"), "digest").filter("page_id > first_id")
    later = later.groupBy("page_id", "digest").agg(F.min("first_id").alias("first_id"))
    # what a revisit must say of its response: identifier and url follow from the response's own row
    named = known.select(F.col("page_id").alias("first_id"), "digest", F.col("url").alias("first_url"), F.col("date").alias("first_date"))
    named = named.join(later.select("first_id", "digest").distinct(), ["first_id", "digest"]).groupBy("first_id", "digest").agg(F.min("first_url").alias("first_url"), F.min("first_date").alias("first_date"))
    later = materialize(later.join(named, ["first_id", "digest"]), "revisits")
    release(known)
    rows = _arc_rows(spark, arc_path, True).join(later, ["page_id", "digest"], "left")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition, place = TaskContext.get().partitionId(), 0
        for batch in batches:
            values = []
            for r in batch.to_pylist():
                if place % per_file == 0:
                    name = f"filedesc://kindred-{partition:05d}-{place // per_file:05d}.warc"
                    values.append(write_warc(convert(ArcRecord(dict(zip(ARC_FIELDS[1], [name, "0.0.0.0", CAPTURED, "text/plain", "0"])), b""))))
                    place += 1
                arc = ArcRecord({"URL": r["url"], "IP-address": "0.0.0.0", "Archive-date": r["date"], "Content-type": r["mime"]}, r["body"], r["truncated"])
                of = None
                if r["first_id"] is not None:
                    of = (record_id("response", r["first_url"], r["first_date"], "sha256:" + r["digest"], str(r["first_id"])), r["first_url"])
                record = convert(arc, of)
                if of:
                    record.headers["X-Refers-To-Page-Id"] = str(r["first_id"])
                values.append(write_warc(record))
                place += 1
            # the writer adds the line feed that ends each value
            yield pa.RecordBatch.from_arrays([pa.array([v[:-1] for v in values], pa.binary())], names=["value"])

    _write_archives(rows.mapInArrow(build, "value binary"), warc_path, per_file)
    release(later)


def warc_pages(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every response and revisit in WARC files."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows = []
                for record in read_warc(content.as_py()):
                    kind = record.headers["WARC-Type"]
                    if kind not in ("response", "revisit"):
                        continue
                    http, payload = http_payload(record.block)
                    digest = record.headers["WARC-Payload-Digest"].removeprefix("sha256:")
                    if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"the payload of {record.headers['WARC-Record-ID']} does not match its digest")
                    size = len(payload) if kind == "response" else int(http["content-length"])
                    to = record.headers.get("X-Refers-To-Page-Id")
                    rows.append((_page(http), size, digest, kind, None if to is None else int(to)))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                columns = list(zip(*rows)) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return _archives(spark, path).mapInArrow(parse, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def pages_through_warc(pages: DataFrame) -> DataFrame:
    """Write pages as ARC files, convert these to WARC files, and read those back."""
    spark = pages.sparkSession
    arc, warc = new_path(spark, "arc"), new_path(spark, "warc")
    pages_to_arc(pages, arc)
    arc_to_warc(spark, arc, warc)
    return warc_pages(spark, warc)


def oracle_sql() -> str:
    return f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha256(html) AS payload_digest, min(page_id) OVER (PARTITION BY sha256(html)) AS first_id FROM p),
r AS (SELECT *, coalesce(payload_bytes >= {MIN_REVISIT_BYTES} AND page_id > first_id, false) AS again FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first_id END AS refers_to FROM r"""
