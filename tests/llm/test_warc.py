import base64
import gzip
import hashlib

from coursemill.llm import warc

PAGES = "page_id long, url string, html string, digest string"


def test_round_trip(spark, tmp_path):
    big = "<p>é😀</p>\r\n\r\nWARC/1.0\r\nContent-Length: 5\r\n\r\n" * 20_000
    rows = [(5, "http://a/5", "same"), (3, "http://a/3", "same"), (9, None, "same"), (1, "http://a/\r\n1", big), (2, "http://b", ""), (4, "http://c", None), (7, "http://d", "twice"), (7, "http://d", "twice"), (None, "http://e", "same")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], PAGES)
    path = f"{tmp_path}/w"
    warc.write_archive(df, path, records_per_file=4)
    recs = warc.read_records(spark, path)
    assert recs.count() == 3 * len(rows)
    got = warc.assemble(recs).collect()
    assert len(got) == len(rows)
    sha = lambda s: base64.b32encode(hashlib.sha1(s.encode()).digest()).decode()
    seen = [(r.metadata.page_id or 0, r.response.kind, r.response.payload_bytes, r.response.payload_digest, r.response.refers_to) for r in got]
    ref = lambda i: f"<urn:page:{i}>"
    n = len(big.encode())
    want = [
        (0, "revisit", 4, sha("same"), ref(3)), (1, "response", n, sha(big), None), (2, "response", 0, sha(""), None), (3, "response", 4, sha("same"), None), (4, "revisit", 0, sha(""), ref(2)),
        (5, "revisit", 4, sha("same"), ref(3)), (7, "response", 5, sha("twice"), None), (7, "response", 5, sha("twice"), None), (9, "revisit", 4, sha("same"), ref(3)),
    ]
    assert sorted(map(str, seen)) == sorted(map(str, want))
    assert all(r.request.id and r.response.declared_digest.endswith(r.response.payload_digest) for r in got)
    payload = {r.metadata.page_id: bytes(r.response.payload) for r in got}
    assert payload[1] == big.encode() and payload[5] == b""


def test_least_bytes_keeps_small_payloads(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "abc"), (2, "u", "abc"), (3, "u", "abcdef"), (4, "u", "abcdef")], "page_id long, url string, html string")
    warc.write_archive(df, f"{tmp_path}/w", least_bytes=4)
    got = warc.assemble(warc.read_records(spark, f"{tmp_path}/w", with_payload=False))
    assert sorted((r.metadata.page_id, r.response.kind) for r in got.collect()) == [(1, "response"), (2, "response"), (3, "response"), (4, "revisit")]


def test_empty_and_members(spark, tmp_path):
    warc.write_archive(spark.createDataFrame([], "page_id long, url string, html string"), f"{tmp_path}/w")
    assert warc.assemble(warc.read_records(spark, f"{tmp_path}/w")).count() == 0
    rec = b"WARC/1.0\r\nWARC-Type: metadata\r\nWARC-Record-ID: <x>\r\nWARC-Concurrent-To: <r>\r\nContent-Length: 12\r\n\r\npage-id: 7\r\n\r\n\r\n"
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "a.warc.gz").write_bytes(gzip.compress(rec) * 3)  # a member per record
    (tmp_path / "m" / "b.warc.gz").write_bytes(gzip.compress(rec * 3))
    (tmp_path / "m" / "c.warc").write_bytes(rec * 3)
    assert [(r.kind, r.page_id, r.concurrent_to) for r in warc.read_records(spark, f"{tmp_path}/m").collect()] == [("metadata", 7, "<r>")] * 9


def test_blocks_that_end_or_begin_with_blank_lines(spark, tmp_path):
    bodies = ["\r\n\r\n", "\r\n", "a\r\n", "\r\n\r\n\r\n\r\na", "\r\r\n\r\n\r", "\r\n\r", "\n\r\n\r\n" * 5]
    warc.write_archive(spark.createDataFrame(list(enumerate(bodies)), "page_id long, html string").selectExpr("page_id", "'u' as url", "html"), f"{tmp_path}/w", records_per_file=5)
    got = {r.metadata.page_id: bytes(r.response.payload).decode() for r in warc.assemble(warc.read_records(spark, f"{tmp_path}/w")).collect()}
    assert got == dict(enumerate(bodies))
