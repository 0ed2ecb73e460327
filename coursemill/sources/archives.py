"""Course backups: gzip-compressed tar archives of XML files."""

from __future__ import annotations

import io
import tarfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import slug
from ..operators.rules import visible

FILE_FIELDS = ("contenthash", "contextid", "component", "filearea", "filename", "filesize", "mimetype")


def archive_files(files: DataFrame, contexts: DataFrame) -> DataFrame:
    """Files of modules' content areas with a name, a size and a hash, in contexts that are visible."""
    real = files.where("component like 'mod\\\\_%' and area = 'content' and name not in ('', '.') and size > 0 and length(hash) >= 3")
    return real.join(contexts.select("context_id").distinct(), "context_id", "left_semi")


def _members(content: bytes) -> Iterator[tuple[str, ElementTree.Element]]:
    with tarfile.open(fileobj=io.BytesIO(content), mode="r:*") as tar:
        for m in tar:
            if m.isfile() and m.name.endswith(".xml"):
                try:
                    yield m.name.lstrip("./"), ElementTree.parse(tar.extractfile(m)).getroot()
                except ElementTree.ParseError:
                    continue


def archive_rows(files: DataFrame) -> DataFrame:
    """files(path, content) -> (archive, entry, tag, key, fields map): one row per section, activity module, activity body and file record of the archives."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for archive, content in zip(b["path"], b["content"], strict=True):
                rows = []
                for name, root in _members(content):
                    for node in root.iter("file") if name == "files.xml" else [root]:
                        inner = node if name.endswith(("module.xml", "section.xml", "files.xml")) else next(iter(node), node)
                        fields = {k: v for k, v in node.attrib.items()} | {c.tag: (c.text or "") for c in inner}
                        rows.append((archive, name, node.tag, node.attrib.get("id"), fields))
                yield pd.DataFrame(rows, columns=["archive", "entry", "tag", "key", "fields"])

    return files.select("path", "content").mapInPandas(of, "archive string, entry string, tag string, key string, fields map<string,string>")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """archive_rows() of the files under a folder."""
    return archive_rows(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path))


def visible_items(rows: DataFrame, now: int) -> DataFrame:
    """archive_rows() -> (archive, folder, kind, title, text): the visible activities of each archive, by their own module's visibility and availability, whatever their section's; `title` is a safe file name."""
    f = F.col("fields")
    folder = F.regexp_extract("entry", "^(activities/[^/]+)/", 1)
    seen = visible(f["visible"].cast("int"), F.coalesce(f["availability"], f["availabilityjson"]), now)
    module = rows.where("tag = 'module'").select("archive", folder.alias("folder"), f["modulename"].alias("kind"), seen.alias("shown")).where("shown")
    body = rows.where("tag = 'activity'").select("archive", folder.alias("folder"), f["name"].alias("name"), F.coalesce(f["content"], f["intro"], F.lit("")).alias("text"))
    return module.join(body, ["archive", "folder"]).select("archive", "folder", "kind", slug(F.col("name")).alias("title"), "text")


def archive_items(spark: SparkSession, path: str, now: int) -> DataFrame:
    """visible_items() of the archives under a folder."""
    return visible_items(read_archives(spark, path), now)
