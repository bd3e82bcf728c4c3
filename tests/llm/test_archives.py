import base64
import gzip
import hashlib
import io

import pytest

from tablewright.llm import archives
from tablewright.llm.queries import QUERIES
from tablewright.session import scratch_path
from tests.conftest import SF_DIR

ODD = [
    (5, "http://a b/x\n", "<p>one\r\n\r\nWARC/1.1\n</p>"),
    (3, "http://a/3", "<p>one\r\n\r\nWARC/1.1\n</p>"),
    (None, "http://a/n", "<p>one\r\n\r\nWARC/1.1\n</p>"),
    (7, None, None),
    (6, "http://a/6", ""),
    (8, "dns:a", "é😀\x00" * 3),
    (9, "http://a/9", "long " * 200_000),
    (9, "http://a/9", "long " * 200_000),
    (None, "http://a/m", "alone"),
]


def brute(rows):
    first, out = {}, []
    for page, _, html in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        raw = (html or "").encode()
        sha1 = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        known = sha1 in first
        out.append((page, len(raw), sha1, "revisit" if known else "response", first[sha1] if known else None))
        first.setdefault(sha1, page)
    return sorted(out, key=str)


def got(df):
    return sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()], key=str)


@pytest.mark.parametrize("parts", [1, 4])
def test_odd_pages(spark, parts):
    pages = spark.createDataFrame([(*r, 1) for r in ODD], "page_id long, url string, html string, `a.b` int").repartition(parts)
    assert got(archives.archive_round_trip(pages, scratch_path(spark))) == brute(ODD)


def test_query_matches_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/pages.parquet").select("page_id", "url", "html").collect()]
    assert got(QUERIES["op5_archives"](spark, SF_DIR)) == brute(rows)


def test_empty_table(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert archives.archive_round_trip(pages, scratch_path(spark)).count() == 0


def test_payloads_survive(spark):
    folder = scratch_path(spark)
    archives.archive_round_trip(spark.createDataFrame(ODD, "page_id long, url string, html string"), folder).count()
    back = {r.page_id: bytes(r.payload) for r in archives.read_warc(spark, f"{folder}/warc").where("type = 'response'").collect()}
    assert back[3] == ODD[0][2].encode() and back[8] == ODD[5][2].encode() and back[9] == ODD[6][2].encode()
    infos = archives.read_warc(spark, f"{folder}/warc").where("type = 'warcinfo'").count()
    assert infos >= 1


@pytest.mark.parametrize("version", [1, 2])
def test_both_versions(version):
    more = "200 CHECK - 0 f.arc " if version == 2 else ""
    block = f"{version} 0 org\n{archives.ARC_FIELDS[version]}\n"
    body = b"HTTP/1.0 404 Not\r\nX: y\r\n\r\nbody\n\nhttp://fake 1 2 3 4\n"
    raw = f"filedesc://f.arc 0.0.0.0 20010203040506 text/plain {more}{len(block)}\n{block}\n".encode()
    raw += f"http://x/a b 1.2.3.4 20010203 text/html {more}{len(body)}\n".encode() + body + b"\n" + f"dns:x 1.2.3.4 200102030405 text/dns {more}3\nabc\n".encode()
    records = list(archives.parse_arc(io.BufferedReader(io.BytesIO(raw))))
    assert [r["version"] for r in records] == [version] * 3
    assert records[1]["body"] == body and records[1]["fields"]["URL"] == "http://x/a b"
    assert [archives.warc_type(r["fields"]["URL"], r["body"])[0] for r in records] == ["warcinfo", "response", "resource"]
    assert [archives.warc_date(r["fields"]["Archive-date"]) for r in records] == ["2001-02-03T04:05:06Z", "2001-02-03T00:00:00Z", "2001-02-03T04:05:00Z"]
    assert list(archives.parse_arc(gzip.GzipFile(fileobj=io.BytesIO(gzip.compress(raw[:200]) + gzip.compress(raw[200:]))))) == records


@pytest.mark.parametrize("raw", [b"http://x 1 2 3 4\nabcd", b"filedesc://f 0 0 t 8\n3 0 org\nx", b"filedesc://f 0 0 t 8\n1 0 org\n\nhttp://x 1 2 t 50\nshort", b"filedesc://f 0 0 t 8\n1 0 org\n\nnonsense\n"])
def test_broken_files_raise(raw):
    with pytest.raises(ValueError):
        list(archives.parse_arc(io.BufferedReader(io.BytesIO(raw))))
