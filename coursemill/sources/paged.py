"""Paginated listings as a Spark data source: each listing is a partition, whose reader follows next links.

A link is an http(s) address, or a file or folder of any file system that Arrow can open. A
page that comes over http is a JSON list (or an object that holds one under `field`), with its
next link in the Link header; a stored page is an object {"link": "<...>; rel=\"next\"", "items": [...]}.
"""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Iterator
from urllib.parse import urljoin

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "start string, page int, place int, item string"


def next_link(header: str | None) -> str | None:
    """Target of the first part of a Link header whose rel is next."""
    for part in (header or "").split(","):
        if 'rel="next"' in part or "rel=next" in part:
            a, b = part.find("<"), part.find(">")
            return part[a + 1 : b] if -1 < a < b else None
    return None


def _stored(link: str) -> bytes:
    at, path = fs.FileSystem.from_uri(link)
    if at.get_file_info(path).type != fs.FileType.Directory:
        return at.open_input_stream(path).read()
    inside = sorted((f for f in at.get_file_info(fs.FileSelector(path)) if f.is_file and not f.base_name.startswith(("_", "."))), key=lambda f: f.path)
    return b"".join(at.open_input_stream(f.path).read() for f in inside)


def fetch(link: str, field: str | None = None, token: str | None = None) -> tuple[list, str | None]:
    """(items, next link) of a page. A page that links to itself is the last; any other answer than a page is an error."""
    if link.startswith(("http://", "https://")):
        ask = urllib.request.Request(link, headers={"Accept": "application/json"} | ({"Authorization": f"Bearer {token}"} if token else {}))
        with urllib.request.urlopen(ask, timeout=60) as got:  # an error status raises
            body, header = json.load(got), got.headers.get("Link")
        items = body[field] if field else body
    else:
        body = json.loads(_stored(link))
        items, header = body["items"], body.get("link")
    to = next_link(header)
    to = urljoin(link, to) if to and link.startswith("http") else to
    return items, None if to == link else to


class Listing(InputPartition):
    """Pages to read: those from `link` on, numbered from `first`, `count` of them or all."""

    def __init__(self, start: str, link: str, first: int, count: int | None):
        self.start, self.link, self.first, self.count = start, link, first, count


class _Options:
    def __init__(self, options: dict):
        starts = options.get("starts")
        self.starts = json.loads(starts) if starts else [options["path"]]
        self.most, self.field, self.token = int(options.get("maxPages", 0)), options.get("field"), options.get("token")

    def read(self, p: Listing) -> Iterator[tuple]:
        link, number, seen = p.link, p.first, set()
        while link and (p.count is None or number < p.first + p.count):
            if self.most and number >= self.most:
                raise ValueError(f"{p.start} has more than {self.most} pages")
            if link in seen:
                raise ValueError(f"{p.start} comes back to {link}")
            seen.add(link)
            items, link = fetch(link, self.field, self.token)
            for i, item in enumerate(items):
                yield p.start, number, i, json.dumps(item, ensure_ascii=False, sort_keys=True)
            number += 1


class PagedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.o = _Options(options)

    def partitions(self) -> list[InputPartition]:
        return [Listing(s, s, 0, None) for s in self.o.starts]

    def read(self, partition: Listing) -> Iterator[tuple]:
        yield from self.o.read(partition)


class PagedStreamReader(DataSourceStreamReader):
    """Listings that grow by pages. An offset has, for each listing, its last page that was read and how many were.

    A page is final once it was read; a later page is found by the link that the last one then
    has. After a restart the links are walked once from the first, as the engine asks for the
    newest offset without saying which one it has; a batch reads what is beyond that one only.
    """

    def __init__(self, options: dict):
        self.o = _Options(options)
        self.seen = self.initialOffset()

    def initialOffset(self) -> dict:
        return {s: {"last": None, "pages": 0} for s in self.o.starts}

    def _after(self, start: str, at: dict) -> str | None:
        return start if at["last"] is None else fetch(at["last"], self.o.field, self.o.token)[1]

    def latestOffset(self) -> dict:
        out = {}
        for s in self.o.starts:
            link, last, n, seen = self._after(s, self.seen[s]), self.seen[s]["last"], self.seen[s]["pages"], set()
            while link:
                if self.o.most and n >= self.o.most:
                    raise ValueError(f"{s} has more than {self.o.most} pages")
                if link in seen:
                    raise ValueError(f"{s} comes back to {link}")
                seen.add(link)
                last, n, link = link, n + 1, fetch(link, self.o.field, self.o.token)[1]
            out[s] = {"last": last, "pages": n}
        self.seen = out
        return out

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        before = self.initialOffset() | start
        return [Listing(s, self._after(s, at), at["pages"], to["pages"] - at["pages"]) for s, to in end.items() if to["pages"] > (at := before[s])["pages"]]

    def read(self, partition: Listing) -> Iterator[tuple]:
        yield from self.o.read(partition)


class PagedSource(DataSource):
    """format("paged"): options path or starts (a JSON list of first links), field, token, maxPages (0: no limit; beyond it the read fails). Links that come back to a page that was read fail, too."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return PagedReader(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return PagedStreamReader(self.options)


def paged(spark: SparkSession, starts: list[str], stream: bool = False, **options: str) -> DataFrame:
    """(start, page, place, item): items as JSON, in the order of pages (from 0) and of items in them. No start: no row.

    The first links are options of the source, so their list goes through the driver; what
    they list doesn't.
    """
    spark.dataSource.register(PagedSource)
    if not starts:
        return spark.createDataFrame([], SCHEMA)
    read = spark.readStream if stream else spark.read
    return read.format("paged").options(starts=json.dumps(starts), **options).load()


#: Most pages of a roster where no other number is given; a fixed value.
ROSTER_PAGES = 50


def roster_members(spark: SparkSession, containers: list[str], most: int = ROSTER_PAGES, **options: str) -> DataFrame:
    """Members of roster containers, read by paged() with at most `most` pages each; 0: all, however many."""
    return paged(spark, containers, maxPages=str(most), **options)


def store_pages(rows: DataFrame, listing: str, order: str, item, per_page: int, path: str, self_link: bool = False) -> None:
    """Write rows as stored pages, folder listing=<l>/page=<n> under path; a last page has no link, or one to itself."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    numbered = rows.select(F.col(listing).alias("listing"), F.col(order).alias("o"), F.to_json(item).alias("item"))
    numbered = numbered.withColumn("page", F.expr(f"(row_number() OVER (PARTITION BY listing ORDER BY o) - 1) div {per_page}").cast("int"))
    pages = numbered.groupBy("listing", "page").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "item"))), lambda x: x["item"]).alias("items"))
    last = F.max("page").over(Window.partitionBy("listing"))
    at = lambda n: F.concat(F.lit(f'<{path}/listing='), "listing", F.lit("/page="), n.cast("string"), F.lit('>; rel=\\"next\\"'))
    to = F.when(F.col("page") < last, at(F.col("page") + 1)).when(F.lit(self_link), at(F.col("page")))
    link = F.coalesce(F.concat(F.lit('"link": "'), to, F.lit('", ')), F.lit(""))
    body = F.concat(F.lit("{"), link, F.lit('"items": ['), F.array_join("items", ", "), F.lit("]}"))
    pages.select("listing", "page", body.alias("value")).write.partitionBy("listing", "page").text(path)
