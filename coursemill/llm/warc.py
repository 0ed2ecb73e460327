"""WARC archives of captures, and their assembly into one nested row per capture.

Writing is a DataFrame job: every row of `write_archive` is one record, and Spark's text
writer puts the blank lines that end a record after each. A capture has a request, a
response (or, for a payload that a capture with a smaller id already stored, a revisit) and
a metadata record; request and metadata name the response in WARC-Concurrent-To. Reading
streams the pieces between blank lines through Spark's text reader, so a compressed archive
of any size passes in batches, and walks the records by Content-Length; the three are then
joined by that identifier.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

CRLF, GAP = "\r\n", b"\r\n\r\n"
#: The digits of base 32 in Spark's numbers and in RFC 4648.
DIGITS, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
RECORDS_PER_FILE = 20_000


def sha1_base32(c: Column) -> Column:
    """Bare upper-case base-32 SHA-1 of a string's UTF-8 bytes or of a binary: 40 bits, 8 digits, at a time."""
    h = F.sha1(c.cast("binary"))
    part = [F.lpad(F.conv(F.substring(h, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.upper(F.concat(*part)), DIGITS, BASE32)


def records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(record string) per WARC record of pages(page_id, url, html).

    Of payloads with equal digest and at least `least_bytes`, the smallest page_id holds the
    response; rows that share that id are all responses. A null html is an empty payload, a
    null url an empty target; a null page_id never holds the response for other rows.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), html.alias("html"))
    rows = rows.withColumn("digest", sha1_base32(F.col("html"))).withColumn("bytes", F.octet_length("html").cast("long"))
    first = rows.select("page_id", "digest", "bytes").where(F.col("bytes") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    # Written, so that Spark knows their size and doesn't shuffle payloads for few of them.
    first = written(first.where("n > 1").select("digest", "first"), "repeated-payloads")
    rows = rows.join(first, "digest", "left").withColumn("row", F.monotonically_increasing_id())
    revisit = (F.col("bytes") >= least_bytes) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    urn = lambda kind: F.concat(F.lit(f"<urn:capture:{kind}:"), F.col("row").cast("string"), F.lit(">"))
    page = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    # A line break in a url would end its header line.
    head = lambda kind, more: F.concat(F.lit(f"WARC/1.0{CRLF}WARC-Type: "), kind, F.lit(f"{CRLF}WARC-Record-ID: "), more, F.lit(f"{CRLF}WARC-Date: 2024-01-01T00:00:00Z{CRLF}WARC-Target-URI: "), F.regexp_replace("url", r"[\r\n]", "%0A"))
    body = lambda h, kind, b: F.concat(h, F.lit(f"{CRLF}Content-Type: {kind}{CRLF}Content-Length: "), F.octet_length(b).cast("string"), F.lit(CRLF * 2), b)
    concurrent = F.concat(F.lit(f"{CRLF}WARC-Concurrent-To: "), urn("response"))
    status = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("bytes").cast("string"), F.lit(CRLF * 2))
    refers = F.when(F.col("revisit"), F.concat(F.lit(f"{CRLF}WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest{CRLF}WARC-Refers-To: <urn:page:"), F.col("first").cast("string"), F.lit(">"))).otherwise(F.lit(""))
    response = F.concat(head(F.when(F.col("revisit"), F.lit("revisit")).otherwise(F.lit("response")), urn("response")), F.lit(f"{CRLF}WARC-Payload-Digest: sha1:"), F.col("digest"), refers)
    request = F.concat(F.lit("GET "), F.regexp_replace("url", r"[\r\n]", "%0A"), F.lit(f" HTTP/1.1{CRLF * 2}"))
    meta = F.concat(F.lit("page-id: "), page, F.lit(CRLF))
    http = "application/http; msgtype="
    three = F.array(
        body(F.concat(head(F.lit("request"), urn("request")), concurrent), f"{http}request", request),
        body(response, f"{http}response", F.concat(status, F.when(F.col("revisit"), F.lit("")).otherwise(F.col("html")))),
        body(F.concat(head(F.lit("metadata"), urn("metadata")), concurrent), "application/warc-fields", meta),
    )
    return rows.withColumn("revisit", revisit).select(F.explode(three).alias("record"))


def write_archive(pages: DataFrame, path: str, least_bytes: int = 0, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Write pages as gzip-compressed WARC files of a bounded number of records under `path`, by Spark's own writer."""
    out = records(pages, least_bytes).write.option("lineSep", CRLF * 2).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED")
    out.option("maxRecordsPerFile", records_per_file).mode("overwrite").text(path)


def _pieces(data: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    view = memoryview(data)
    return (bytes(view[at : at + step]) for at in range(0, len(view), step))


def _walk(chunks: Iterator[bytes]) -> Iterator[tuple[dict, bytes]]:
    """(header fields by lower-case name, block) of each record of one archive's bytes, which come in chunks."""
    buf = bytearray()

    def need(n: int) -> bool:
        while len(buf) < n:
            more = next(chunks, None)
            if more is None:
                return False
            buf.extend(more)
        return True

    while True:
        while (end := buf.find(GAP)) < 0 or not end:
            if not end:
                del buf[: len(GAP)]
            elif not need(len(buf) + 1):
                return
        fields = {}
        for line in bytes(buf[:end]).split(b"\r\n")[1:]:
            k, _, v = line.partition(b":")
            fields[k.strip().lower().decode("latin-1")] = v.strip().decode("utf-8", "replace")
        size = int(fields["content-length"])
        if not need(end + 4 + size):
            raise ValueError(f"a record of {size} bytes is cut off")
        yield fields, bytes(buf[end + 4 : end + 4 + size])
        del buf[: end + 4 + size]


RECORD = "kind string, id string, concurrent_to string, refers_to string, uri string, declared_digest string, payload_bytes long, payload_digest string, page_id long, payload binary"


def read_records(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row per WARC record under `path`. payload_bytes and payload_digest come from a response's own payload; a revisit has its header's.

    Archives compressed with gzip, as one member or one per record, are read as streams; an
    archive that isn't compressed is one value of a task, so it has to be under 2 GB.
    """
    names = [x.split()[0] for x in RECORD.split(", ")]
    types = [pa.string()] * 6 + [pa.int64(), pa.string(), pa.int64(), pa.binary()]

    def parsed(archives: Iterator[Iterator[bytes]]) -> Iterator[pa.RecordBatch]:
        rows: list = []
        size = 0
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
        for chunks in archives:
            for f, block in _walk(chunks):
                kind, n, digest, page, payload = f["warc-type"], None, None, None, None
                if kind in ("response", "revisit"):
                    head, _, payload = block.partition(GAP)
                    if kind == "response":
                        n, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    else:
                        digest = f["warc-payload-digest"].removeprefix("sha1:")
                        n = int(next(x.split(b":")[1] for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")))
                elif kind == "metadata":
                    value = block.decode().partition("page-id:")[2].strip()
                    page = int(value) if value else None
                rows.append((kind, f["warc-record-id"], f.get("warc-concurrent-to"), f.get("warc-refers-to"), f.get("warc-target-uri"), f.get("warc-payload-digest"), n, digest, page, payload if with_payload else None))
                size += len(block)
                if size > 8 << 20 or len(rows) >= 10_000:
                    yield flush()
                    rows, size = [], 0
        if rows:
            yield flush()

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (file, piece) in the order of each file; a file is never in two tasks."""
        each = ((f, p) for b in batches for f, p in zip(b.column(0).to_pylist(), b.column(1), strict=True))
        return parsed((p.as_py() + GAP for _, p in of_file) for _, of_file in groupby(each, lambda r: r[0]))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return parsed(_pieces(content.as_py()) for b in batches for content in b.column(0))

    text = spark.read.option("lineSep", CRLF * 2).option("pathGlobFilter", "*.gz").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("piece"))
    plain = spark.read.format("binaryFile").option("pathGlobFilter", "*[^z]").load(path).select("content")
    return text.mapInArrow(streamed, RECORD).unionByName(plain.mapInArrow(whole, RECORD))


def assemble(recs: DataFrame) -> DataFrame:
    """One nested row per capture: (id, response struct, request struct, metadata struct).

    Captures without a request or metadata keep a null there; requests and metadata that name
    no response of the archive belong to no capture. The records are read three times, so
    give them written where reading archives is dear.
    """
    part = F.struct("id", "uri", "page_id")
    response = recs.where("kind in ('response', 'revisit')").select("id", F.struct("kind", "uri", "refers_to", "declared_digest", "payload_bytes", "payload_digest", "payload").alias("response"))
    request = recs.where("kind = 'request'").select(F.col("concurrent_to").alias("id"), part.alias("request"))
    meta = recs.where("kind = 'metadata'").select(F.col("concurrent_to").alias("id"), part.alias("metadata"))
    return response.join(request, "id", "left").join(meta, "id", "left")
