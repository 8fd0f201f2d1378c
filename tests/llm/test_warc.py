import gzip
import hashlib

import pytest
from helpers import SF
from pyspark.sql import functions as F

from kindred.llm import queries, warc

HEAD = b"HTTP/1.1 200 OK\r\nX-Page-Id: 5\r\nContent-Length: 3\r\n\r\n"


def brute(rows):
    out, first = [], {}
    for page_id, html in rows:
        body = (html or "").encode()
        if page_id is not None:
            first[body] = min(first.get(body, page_id), page_id)
    for page_id, html in rows:
        body = (html or "").encode()
        again = page_id is not None and len(body) >= 100 and page_id > first[body]
        out.append((page_id, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", first[body] if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("version", [1, 2])
@pytest.mark.parametrize("packed", ["plain", "file", "records"])
def test_versions_and_lengths(version, packed):
    bodies = [HEAD + b"a\nb", b"", b"http://x 1 2 3 4\n\n", "é \r\n".encode() * 50]
    parts = [warc.arc_version_block("x.arc", version)] + [warc.arc_record(version, f"http://h/{i} a", b, mime="text/html; charset=x") for i, b in enumerate(bodies)]
    parts = [p + b"\n" for p in parts]
    data = b"".join(parts) if packed == "plain" else gzip.compress(b"".join(parts)) if packed == "file" else b"".join(map(gzip.compress, parts))
    records = list(warc.read_arc(data))
    assert [r.body for r in records[1:]] == bodies
    assert records[1].fields["URL"] == "http://h/0%20a" and records[1].fields["Content-type"] == "text/html; charset=x"
    back = list(warc.read_warc(b"".join(warc.write_warc(warc.convert(r)) for r in records)))
    assert [r.headers["WARC-Type"] for r in back] == ["warcinfo", "response", "resource", "resource", "resource"]
    assert [r.block for r in back[1:]] == bodies
    assert back[1].headers["WARC-Payload-Digest"] == "sha256:" + hashlib.sha256(b"a\nb").hexdigest()
    assert len({r.headers["WARC-Record-ID"] for r in back}) == 5


def test_odd_records():
    assert warc.warc_date("20070102030405") == "2007-01-02T03:04:05Z" and warc.warc_date("no date") == "1970-01-01T00:00:00Z"
    cut = warc.arc_version_block("x", 1) + b"\n" + warc.arc_record(1, "http://h", b"123456789")[:-4]
    *_, last = warc.read_arc(cut)
    assert last.truncated and warc.convert(last).headers["WARC-Truncated"] == "unspecified"
    with pytest.raises(ValueError):
        list(warc.read_arc(b"no header line\n"))
    revisit = warc.convert(warc.ArcRecord(dict.fromkeys(warc.ARC_FIELDS[1], "http://h"), HEAD + b"abc"), ("<urn:uuid:1>", "http://g"))
    assert revisit.block == HEAD and revisit.headers["WARC-Type"] == "revisit" and revisit.headers["WARC-Refers-To"] == "<urn:uuid:1>"


def test_pages(spark):
    long = "<p>same</p>" * 20
    rows = [(3, long), (1, long), (2, long), (4, None), (5, ""), (6, "short"), (7, "short"), (8, "WARC/1.1\r\n\r\n\r\n" * 9 + "é\n"), (9, "x" * 3_000_000), (None, long), (None, None), (2, long), (2, "other" * 30)]
    urls = ["http://a b/%d" % i if i % 3 else None for i in range(len(rows))]
    df = spark.createDataFrame([(p, u, h, "x") for (p, h), u in zip(rows, urls)], "page_id long, url string, html string, digest string").withColumn("body", F.lit(1))
    assert sorted((tuple(r) for r in warc.pages_through_warc(df).collect()), key=str) == brute(rows)
    assert warc.pages_through_warc(df.limit(0)).count() == 0


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html").collect()]
    assert sorted((tuple(r) for r in queries.QUERIES["op5_warc"](spark, SF).collect()), key=str) == brute(rows)


@pytest.mark.parametrize("per_file", [2, 3, 4])
def test_archives_roll_over(spark, tmp_path, per_file):
    """Files of few records, each of which begins with its version block or warcinfo record, hold the same pages."""
    rows = [(i, "<p>text</p>" * (10 + i % 4)) for i in range(23)]
    pages = spark.createDataFrame([(i, f"http://h/{i}", h) for i, h in rows], "page_id long, url string, html string").repartition(2)
    arc, out = str(tmp_path / "arc"), str(tmp_path / "warc")
    warc.pages_to_arc(pages, arc, per_file)
    warc.arc_to_warc(spark, arc, out, per_file=per_file)
    for path, read, start in ((arc, warc.read_arc, lambda r: r.fields["URL"].startswith("filedesc:")), (out, warc.read_warc, lambda r: r.headers["WARC-Type"] == "warcinfo")):
        files = [list(read(r["content"])) for r in warc._archives(spark, path).collect()]
        files = [f for f in files if f]
        assert len(files) >= 23 // (per_file - 1) and all(len(f) <= per_file and [start(r) for r in f] == [True] + [False] * (len(f) - 1) for f in files)
    assert sorted((tuple(r) for r in warc.warc_pages(spark, out).collect()), key=str) == brute(rows)
