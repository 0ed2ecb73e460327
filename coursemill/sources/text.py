"""Sources of text: files as rows, HTML as text."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import extension

#: Extensions that are read as plain text.
PLAIN = ("txt", "md", "rst", "csv", "tsv")


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, text): one row per plain-text file under a folder; other files are left out, and CSV isn't parsed."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.regexp_extract("path", "([^/]*)$", 1)
    return files.where(extension(name).isin(*PLAIN)).select("path", name.alias("name"), F.decode("content", "UTF-8").alias("text"))


class _Nodes(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []

    def handle_data(self, data: str) -> None:
        self.parts.append(data)


def html_text(page: str | None) -> str:
    """All text nodes of a page, those of scripts and styles too, with single spaces."""
    if not page:
        return ""
    p = _Nodes()
    p.feed(page)
    p.close()
    return " ".join(" ".join(p.parts).split())


def html_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id_col, text): html_text() of every page."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "text": b["html"].map(html_text)})

    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(html_col).alias("html"))
    return rows.mapInPandas(of, "id long, text string").withColumnRenamed("id", id_col)
