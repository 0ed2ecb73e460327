"""Paginated sources over stored pages and over a local server."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from coursemill.sources import paged
from coursemill.streaming import flows


def store(folder, listing, n, pages, items=2):
    """Pages 0 to n - 1 of a listing; the last has no link."""
    for i in range(n):
        at = folder / f"{listing}-{i}"
        to = {"link": f'<x>; rel="prev", <{folder}/{listing}-{i + 1}>; rel="next"'} if i + 1 < pages else {}
        at.write_text(json.dumps(to | {"items": [{"id": i * items + j, "é": None} for j in range(items)]}))
    return f"{folder}/{listing}-0"


def ids(df):
    return sorted((r.start.rpartition("/")[2], r.page, r.place, json.loads(r.item)["id"]) for r in df.collect())


def want(pages, names=("a-0", "b-0")):
    return [(n, i // 2, i % 2, i) for n in names for i in range(2 * pages)]


def test_links():
    assert paged.next_link('<a>; rel="prev", <b?x=1>; rel="next"') == "b?x=1"
    assert paged.next_link("<b>; rel=next") == "b"
    assert paged.next_link('b; rel="next"') is None
    assert paged.next_link('<a>; rel="last"') is None and paged.next_link(None) is None


def test_listings_are_followed_to_their_ends(spark, tmp_path):
    starts = [store(tmp_path, "a", 3, 3), store(tmp_path, "b", 3, 3)]
    df = paged.paged(spark, starts)
    assert df.rdd.getNumPartitions() == 2 and ids(df) == want(3)
    assert paged.paged(spark, []).count() == 0


def test_a_page_that_links_to_itself_is_the_last(spark, tmp_path):
    (tmp_path / "a-0").write_text(json.dumps({"link": f'<{tmp_path}/a-0>; rel="next"', "items": [{"id": 0}, {"id": 1}]}))
    assert ids(paged.roster_members(spark, [f"{tmp_path}/a-0"])) == want(1, ("a-0",))


def test_a_roster_has_fifty_pages_at_most(spark, tmp_path):
    assert paged.roster_members(spark, [store(tmp_path, "a", 50, 50)]).count() == 100
    with pytest.raises(Exception, match="more than 50 pages"):
        paged.roster_members(spark, [store(tmp_path, "b", 51, 51)]).count()


def test_rosters_of_more_than_fifty_pages(spark, tmp_path):
    from coursemill.plans import queries

    members = spark.range(5101).select(F.col("id").alias("c_custkey"), F.lit(3).alias("c_nationkey"), F.lit(1.0).alias("c_acctbal"), F.lit("BUILDING").alias("c_mktsegment"))
    members.write.parquet(f"{tmp_path}/customer.parquet")
    got = queries()["s8_roster"](spark, str(tmp_path)).groupBy("page").count().collect()
    assert sorted((r["page"], r["count"]) for r in got) == [(i, 100) for i in range(51)] + [(51, 1)]


@pytest.mark.parametrize("stream", [False, True])
def test_links_in_a_circle_are_an_error(spark, tmp_path, stream):
    for a, b in ("xy", "yx"):
        (tmp_path / a).write_text(json.dumps({"link": f'<{tmp_path}/{b}>; rel="next"', "items": [{"id": 0}]}))
    with pytest.raises(Exception, match="comes back to"):
        rows = paged.paged(spark, [f"{tmp_path}/x"], stream=stream)
        (flows.run_to_end(rows, str(tmp_path / "out")) if stream else rows).count()


def test_missing_page_is_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="a-2"):
        paged.paged(spark, [store(tmp_path, "a", 2, 3)]).count()


def test_stream_reads_each_page_once(spark, tmp_path):
    run = lambda: ids(flows.run_to_end(paged.paged(spark, [store(tmp_path, "a", n, n), store(tmp_path, "b", n, n)], stream=True), str(tmp_path / "out")))
    for n in (1, 1, 3, 3, 4):  # a restart, pages that came meanwhile, and again
        assert run() == want(n)


class Pages(BaseHTTPRequestHandler):
    def do_GET(self):  # noqa: N802
        n = int(self.path.rpartition("=")[2])
        ok = self.headers["Authorization"] == "Bearer secret"
        self.send_response(200 if ok else 401)
        if n < 2:
            self.send_header("Link", f'</members?page={n + 1}>; rel="next"')
        self.end_headers()
        self.wfile.write(json.dumps({"members": [{"id": 2 * n}, {"id": 2 * n + 1}]}).encode())

    def log_message(self, *_):
        pass


def test_pages_over_http(spark):
    server = HTTPServer(("127.0.0.1", 0), Pages)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    start = f"http://127.0.0.1:{server.server_port}/members?page=0"
    try:
        assert ids(paged.roster_members(spark, [start], field="members", token="secret")) == [(start.rpartition("/")[2], *x[1:]) for x in want(3, ("a-0",))]
        with pytest.raises(Exception, match="401"):
            paged.paged(spark, [start], field="members", token="wrong").count()
    finally:
        server.shutdown()
