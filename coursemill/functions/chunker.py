"""Chunks of about 2000 bytes with overlap, in UTF-8 bytes that never split a character.

A text is cleaned of boilerplate lines, cut into paragraphs, and packed: paragraphs share a
chunk while they fit, not counting the line break between them; the next chunk begins with
the end of the one before, and what is then too long is cut at a blank line, a sentence or a
space. Every step moves on by a character at least, so a cut always ends.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import slices

SIZE, OVERLAP = 2000, 250
#: Lines under LINE bytes that occur REPEATS times or more are boilerplate.
LINE, REPEATS = 80, 3


def clean_text(text: str) -> str:
    """Without short lines that occur three times or more."""
    lines = [x.removesuffix("\r") for x in text.removesuffix("\n").split("\n")]
    count = Counter(t for t in map(str.strip, lines) if t)
    return "\n".join(x for x in lines if not ((t := x.strip()) and count[t] >= REPEATS and len(t.encode()) < LINE))


def paragraphs(text: str) -> list[str]:
    return [p for p in map(str.strip, text.split("\n\n")) if p]


def _whole(data: bytes, at: int) -> int:
    """The last character boundary at or before a byte."""
    at = max(0, min(at, len(data)))
    while 0 < at < len(data) and data[at] & 0xC0 == 0x80:
        at -= 1
    return at


def split_point(data: bytes, target: int) -> int:
    """Where to cut at most `target` bytes: after a blank line or a sentence in the second half, else at a space, else at the target."""
    target = _whole(data, target)
    for mark in (b"\n\n", b". "):
        at = data.rfind(mark, 0, target)
        if at > target // 2:
            return at + len(mark)
    at = data.rfind(b" ", 0, target)
    return at + 1 if at >= 0 else target


def chunk_text(text: str, size: int = SIZE, overlap: int = OVERLAP) -> list[str]:
    out: list[str] = []
    held = b""

    def keep(part: bytes) -> None:
        if s := part.decode("utf-8").strip():
            out.append(s)

    for p in paragraphs(clean_text(text)):
        data = p.encode("utf-8", "replace")
        if held and len(held) + len(data) > size:
            keep(held)
            held = held[_whole(held, len(held) - overlap) :]
        held = held + b"\n" + data if held else data
        while len(held) > size:
            cut = split_point(held, size)
            keep(held[:cut])
            # Overlap is given up where it would not move on.
            after = _whole(held, cut - overlap)
            held = held[after if after > 0 and cut - after < cut else cut :]
    keep(held)
    return out


def cleaned_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, text): clean_text() of every document; null stays null."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, 1):
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([t if t is None else clean_text(t) for t in b.column(1).to_pylist()], pa.string())], ["id", "text"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(of, "id long, text string").withColumnRenamed("id", id_col)


def chunk_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(id_col, chunk_index, text): a row per chunk; a document without text has none."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, 1):
                rows = [(i, k, c) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if t for k, c in enumerate(chunk_text(t, size, overlap))]
                ids, at, text = zip(*rows, strict=True) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(at, pa.int64()), pa.array(text, pa.string())], ["id", "chunk_index", "text"])

    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(of, "id long, chunk_index long, text string").withColumnRenamed("id", id_col)
