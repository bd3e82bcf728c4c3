"""Legacy web archives to WARC (operator 5).

ARC files open with a version block that names the fields of the header lines; each record is a header line and as many
bytes as it declares. The converter reads both versions, makes WARC identifiers, timestamps, types and
digests, and turns later records of a payload into revisits. Files are written and read by Spark alone, so any
store that the cluster sees will do.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.functions.parsing import column
from tablewright.llm.common import map_arrow
from tablewright.session import stored

# The field names of the header lines, by version.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CRLF = "\r\n"
#: Date of pages that carry none.
CAPTURED = "19990101000000"


def digest(payload: bytes) -> str:
    """Bare base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def http_response(payload: bytes, page_id: int | None, row: int) -> bytes:
    """An HTTP response that carries the page's id and row number in headers of its own."""
    page = "" if page_id is None else str(page_id)
    head = f"HTTP/1.1 200 OK{_CRLF}Content-Type: text/html; charset=utf-8{_CRLF}Content-Length: {len(payload)}{_CRLF}X-Page-Id: {page}{_CRLF}X-Row: {row}{_CRLF}{_CRLF}"
    return head.encode() + payload


def _text_files(df: DataFrame, path: str, ending: str) -> None:
    """One binary column as gzipped files, every row followed by ``ending``; a file has the rows of one task."""
    column_ = F.col(df.columns[0]).cast("string").alias("value")  # bytes pass unchanged
    df.select(column_).write.option("lineSep", ending).option("compression", "gzip").text(path)


def write_arc(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Writes pages as ARC files; files of even tasks have version 1, those of odd tasks version 2."""
    rows = pages.select(column(page_id).cast("long"), column(url).cast("string"), column(html).cast("string"), F.monotonically_increasing_id(), F.spark_partition_id())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        offset, version, name = 0, 0, ""
        for batch in batches:
            out = []
            for page, address, text, row, part in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if not version:
                    version, name = 1 + part % 2, f"pages-{part:06d}.arc"
                    block = f"{version} 0 pages\n{ARC_FIELDS[version]}\n"
                    out.append(f"filedesc://{name} 0.0.0.0 {CAPTURED} text/plain {'200 - - 0 ' + name + ' ' if version == 2 else ''}{len(block)}\n{block}".encode())
                    offset += len(out[-1]) + 1
                payload = (text or "").encode()
                body = http_response(payload, page, row)
                uri = re.sub(r"\s", lambda m: f"%{ord(m.group(0)):02X}", address or "urn:unknown")
                more = f"200 {digest(payload)} - {offset} {name} " if version == 2 else ""
                out.append(f"{uri} 0.0.0.0 {CAPTURED} text/html {more}{len(body)}\n".encode() + body)
                offset += len(out[-1]) + 1
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    plain = rows.toDF("page", "uri", "html", "number", "part")
    _text_files(map_arrow(plain, write, "record binary"), path, "\n")


def parse_arc(stream: io.BufferedIOBase) -> Iterator[dict]:
    """Records of one ARC file; the version block says which fields header lines have. A broken file raises ValueError."""
    fields: list[str] = []
    while line := stream.readline():
        if line in (b"\n", b"\r\n"):
            continue
        parts = line.decode("utf-8", "replace").rstrip("\r\n")
        if not fields:
            if not parts.startswith("filedesc://"):
                raise ValueError("an ARC file must open with its version block")
            block = stream.read(int(parts.rsplit(" ", 1)[1])).decode("utf-8", "replace").splitlines()
            version = int(block[0].split()[0])
            if version not in ARC_FIELDS:
                raise ValueError(f"ARC version {version} is unknown")
            fields = (block[1] if len(block) > 1 else ARC_FIELDS[version]).split(" ")
            yield {"version": version, "fields": dict(zip(fields, parts.rsplit(" ", len(fields) - 1), strict=False)), "body": "\n".join(block).encode()}
            continue
        values = parts.rsplit(" ", len(fields) - 1)  # an address may hold blanks, the other fields can't
        if len(values) != len(fields) or not values[-1].isdigit():
            raise ValueError(f"not an ARC header line: {parts[:100]!r}")
        body = stream.read(int(values[-1]))
        if len(body) != int(values[-1]):
            raise ValueError("a record is shorter than it declares")
        yield {"version": version, "fields": dict(zip(fields, values, strict=True)), "body": body}


def warc_date(date: str) -> str:
    """14-digit, 12-digit or 8-digit ARC dates as WARC dates."""
    d = (date + "01010000000000"[len(date) - 4 :] if len(date) in (4, 6) else date.ljust(14, "0"))[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def warc_type(uri: str, body: bytes) -> tuple[str, str]:
    """Type and content type of the WARC record for an ARC record."""
    if uri.startswith("filedesc:"):
        return "warcinfo", "text/plain"
    if body.startswith(b"HTTP/"):
        return "response", "application/http;msgtype=response"
    return "resource", "text/dns" if uri.startswith("dns:") else "application/octet-stream"


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """Head (with its blank line) and payload of an HTTP message; other blocks are all payload."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    at = block.find(b"\r\n\r\n")
    return (block, b"") if at < 0 else (block[: at + 4], block[at + 4 :])


def _http_field(head: bytes, name: str) -> str | None:
    m = re.search(rb"\r\n" + name.encode() + rb": *([^\r\n]*)", head)
    return m.group(1).decode() if m and m.group(1) else None


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


_ARC_RECORD = "record_id string, type string, content_type string, uri string, ip string, date string, head binary, payload binary, digest string, page_id long, number long"


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """Converted records of all ARC files below ``path``: WARC identifier, type, date and digest, and the content."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _arrow(_ARC_RECORD)
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows, held = [], 0
                for k, record in enumerate(parse_arc(gzip.GzipFile(fileobj=io.BytesIO(memoryview(raw.as_buffer()))))):
                    f, body = record["fields"], record["body"]
                    kind, content_type = warc_type(f["URL"], body)
                    head, payload = split_http(body)
                    page, number = _http_field(head, "X-Page-Id"), _http_field(head, "X-Row")
                    sha1 = digest(payload)
                    date = warc_date(f["Archive-date"])
                    ident = uuid.uuid5(uuid.NAMESPACE_URL, f"{f['URL']} {date} {sha1} {number if number is not None else f'{name} {k}'}")
                    rows.append((f"<urn:uuid:{ident}>", kind, content_type, f["URL"], f["IP-address"], date, head, payload, sha1, int(page) if page else None, int(number) if number else None))
                    held += len(body)
                    if held > 4 << 20:
                        yield _batch(rows, schema)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows, schema)

    return map_arrow(_files(spark, path), read, _ARC_RECORD)


def _arrow(schema: str) -> pa.Schema:
    kinds = {"string": pa.string(), "binary": pa.binary(), "long": pa.int64()}
    return pa.schema([(c.split(" ")[0], kinds[c.split(" ")[1]]) for c in schema.split(", ")])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(values, f.type) for values, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _order() -> Column:
    """Smallest page id first, records without one last, then the row they came in."""
    return F.struct(F.col("page_id").isNull().alias("unnamed"), "page_id", "number", "record_id", "uri", "date")


def convert_arc(spark: SparkSession, source: str, target: str, least_bytes: int = 0) -> None:
    """Writes the records of the ARC files below ``source`` as gzipped WARC files.

    Of the responses with equal payloads of at least ``least_bytes`` bytes, the one with the smallest page id stays a response; the others
    become revisits, which keep the HTTP head alone and point to it.
    """
    records = read_arc(spark, source)
    responses = records.where((F.col("type") == "response") & (F.length("payload") >= least_bytes))
    first = responses.groupBy("digest").agg(F.min(_order()).alias("first"))
    joined = records.join(first, "digest", "left").withColumn(
        "revisits", (F.col("type") == "response") & (F.length("payload") >= least_bytes) & (F.col("first.record_id") != F.col("record_id"))
    )
    cells = joined.select("record_id", "type", "content_type", "uri", "ip", "date", "head", F.when(~F.col("revisits"), F.col("payload")).alias("payload"), "digest", "revisits", "first.record_id", "first.uri", "first.date")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([_warc(*row) for row in zip(*[c.to_pylist() for c in batch.columns], strict=True)], pa.binary())], ["record"])

    plain = cells.toDF(*[f"c{i}" for i in range(len(cells.columns))])
    _text_files(map_arrow(plain, write, "record binary"), target, _CRLF * 2)


def _warc(ident, kind, content_type, uri, ip, date, head, payload, sha1, revisits, first_id, first_uri, first_date) -> bytes:
    """One WARC record, without the two line ends that follow it."""
    block = head + (payload or b"")
    fields = [("WARC-Type", "revisit" if revisits else kind), ("WARC-Record-ID", ident), ("WARC-Date", date)]
    if kind == "warcinfo":
        fields += [("WARC-Filename", uri.removeprefix("filedesc://"))]
    else:
        fields += [("WARC-Target-URI", uri), ("WARC-IP-Address", ip), ("WARC-Payload-Digest", f"sha1:{sha1}")]
    fields += [("WARC-Block-Digest", f"sha1:{digest(block)}")]
    if revisits:
        fields += [("WARC-Refers-To", first_id), ("WARC-Refers-To-Target-URI", first_uri), ("WARC-Refers-To-Date", first_date), ("WARC-Profile", REVISIT_PROFILE)]
    fields += [("Content-Type", content_type), ("Content-Length", str(len(block)))]
    return ("WARC/1.1" + _CRLF + "".join(f"{k}: {v}{_CRLF}" for k, v in fields) + _CRLF).encode() + block


def parse_warc(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record. A broken file, or a block that differs from its digest, raises ValueError."""
    while line := stream.readline():
        if line == b"\r\n":
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not the start of a WARC record: {line[:60]!r}")
        fields = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        size = int(fields["content-length"])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError("a record is shorter than it declares")
        if fields.get("warc-block-digest", f"sha1:{digest(block)}") != f"sha1:{digest(block)}":
            raise ValueError(f"the block of {fields.get('warc-record-id')} differs from its digest")
        yield fields, block


_WARC_RECORD = "record_id string, type string, uri string, date string, refers_to_id string, payload_digest string, payload binary, payload_bytes long, page_id long"


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records of all WARC files below ``path``; digests of payloads that are there are computed anew.

    ``payload_bytes`` of a revisit is the length that its HTTP head declares. Without ``payloads`` that column is null.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _arrow(_WARC_RECORD)
        for batch in batches:
            for raw in batch.column(1):
                rows, held = [], 0
                for fields, block in parse_warc(gzip.GzipFile(fileobj=io.BytesIO(memoryview(raw.as_buffer())))):
                    kind = fields["warc-type"]
                    head, payload = split_http(block)
                    stated = fields.get("warc-payload-digest", "").removeprefix("sha1:")
                    if kind == "revisit":
                        size, sha1 = int(_http_field(head, "Content-Length") or 0), stated
                    else:
                        size, sha1 = len(payload), digest(payload)
                        if stated and stated != sha1:
                            raise ValueError(f"the payload of {fields['warc-record-id']} differs from its digest")
                    page = _http_field(head, "X-Page-Id")
                    kept = payload if payloads and kind != "revisit" else None
                    rows.append((fields["warc-record-id"], kind, fields.get("warc-target-uri"), fields["warc-date"], fields.get("warc-refers-to"), sha1, kept, size, int(page) if page else None))
                    held += len(kept or b"") + 500
                    if held > 4 << 20:
                        yield _batch(rows, schema)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows, schema)

    return map_arrow(_files(spark, path), read, _WARC_RECORD)


def archive_round_trip(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0) -> DataFrame:
    """Writes pages as ARC files below ``folder``, converts them to WARC files there, and returns a row for each page as read back.

    ``page_id``, ``url``, ``payload_bytes``, ``payload_digest``, ``record_type`` and ``refers_to``, the page id of the response that a
    revisit points to. A null html is an empty payload. Repeated rows are records of their own: the first stays a response.
    Null page ids come after all others and stay null. An empty table gives no rows. ``folder`` must be shared by all executors.
    """
    spark = pages.sparkSession
    write_arc(pages, f"{folder}/arc", page_id, url, html)
    convert_arc(spark, f"{folder}/arc", f"{folder}/warc", least_bytes)
    # The archives are read once: the narrow rows are written, and revisits alone are joined to the responses they point to.
    back = stored(read_warc(spark, f"{folder}/warc", payloads=False).where("type in ('response', 'revisit')").drop("payload", "date"))
    ids = back.where("type = 'response'").select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"))
    responses = back.where("type = 'response'").withColumn("refers_to", F.lit(None).cast("long"))
    revisits = back.where("type = 'revisit'").join(ids, "refers_to_id", "left")
    read = responses.unionByName(revisits)
    return read.select("page_id", F.col("uri").alias("url"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers_to")
