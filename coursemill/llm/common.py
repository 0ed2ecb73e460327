"""Shared helpers: tables, durable cuts of lineage, and a vectorised word hasher over Arrow buffers."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes hashed at a time, so that the 64-bit temporaries stay in cache.
PIECE = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session. Where none is set, a local master (tests) gets a temporary one; a cluster is refused, as its executors wouldn't see the driver's folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="coursemill-"))
    return sc.getCheckpointDir()


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there is deleted when the session's JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def cut(df: DataFrame) -> DataFrame:
    """The same rows read from the shared checkpoint folder: later jobs survive lost executors and don't recompute."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Like cut(), as a compressed columnar table; for rows that are read again, some columns at a time."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def plain(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """(docs with its columns named c0, c1, ..., those names): columns of helpers, which begin with an underscore, then clash with none."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), names


def text_list(col: pa.Array) -> list[str]:
    """Python strings, null as empty."""
    return [x or "" for x in col.to_pylist()]


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes, n + 1 offsets) of a string column, null as empty, without copying the text where there is no null."""
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type)
    if not wide and not pa.types.is_string(col.type):
        col, wide = col.cast(pa.large_string()), True
    _, offsets, data = col.buffers()
    if len(col) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def _word_table() -> np.ndarray:
    """Lower-cased byte for letters, digits and every byte beyond ASCII; 0 for what parts words."""
    out = np.zeros(256, np.uint8)
    for b in range(256):
        c = chr(b)
        if b >= 128 or (c.isascii() and c.isalnum()):
            out[b] = ord(c.lower()) if b < 128 else b
    return out


WORD_BYTES = _word_table()
SPACE_BYTES = np.ones(256, np.uint8)
SPACE_BYTES[[32, *range(9, 14)]] = 0
_powers: list[np.ndarray] = []


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base and of its inverse, modulo 2^64."""
    if not _powers or len(_powers[0]) < n:
        inverse = pow(_BASE, -1, 1 << 64)
        with np.errstate(over="ignore"):
            _powers[:] = [np.concatenate([[np.uint64(1)], np.full(n - 1, b, np.uint64)]).cumprod(dtype=np.uint64) for b in (np.uint64(_BASE), np.uint64(inverse))]
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Final mixing of 64-bit hashes (in place)."""
    with np.errstate(over="ignore"):
        h ^= h >> np.uint64(33)
        h *= np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(33)
        h *= np.uint64(0xC4CEB9FE1A85EC53)
        h ^= h >> np.uint64(33)
    return h


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct integers; numpy's vectorised sort is several times faster here than its unique()."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def _gap(data: np.ndarray, at: int, end: int, kinds: np.ndarray) -> int:
    """The first byte from `at` on that parts words, or `end`."""
    for b in range(at, end, PIECE):
        gap = np.flatnonzero(kinds[data[b : min(end, b + PIECE)]] == 0)
        if len(gap):
            return b + int(gap[0])
    return end


def _pieces(data: np.ndarray, offsets: np.ndarray, kinds: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(first byte, end byte, first document, end document): whole documents up to PIECE bytes, or a part of a long one that ends between words."""
    n, d = len(offsets) - 1, 0
    while d < n:
        e = max(d + 1, int(np.searchsorted(offsets, offsets[d] + PIECE, "right")) - 1)
        b, end = int(offsets[d]), int(offsets[e])
        while end - b > PIECE:
            stop = _gap(data, b + PIECE, end, kinds)
            yield b, stop, d, e
            b = stop
        yield b, end, d, e
        d = e


def word_spans(data: np.ndarray, offsets: np.ndarray, kinds: np.ndarray = WORD_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]]:
    """For each piece: (mapped bytes, starts, ends, document of each word, first byte); a word is a run of bytes that `kinds` keeps and never crosses documents."""
    for b, e, d0, d1 in _pieces(data, offsets, kinds):
        m = kinds[data[b:e]]
        if kinds is WORD_BYTES and len(m) > 1:  # capitals of Latin-1 letters, C3 80 to C3 9E but for the times sign
            raw = data[b:e]
            up = np.flatnonzero((raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)) + 1
            m[up] += 0x20
        isw = m != 0
        first, last = isw.copy(), isw.copy()
        first[1:] &= ~isw[:-1]
        last[:-1] &= ~isw[1:]
        edge = offsets[d0 : d1 + 1] - b
        inner = edge[(edge > 0) & (edge < e - b)]
        first[inner] = isw[inner]
        last[inner - 1] = isw[inner - 1]
        s, t = np.flatnonzero(first), np.flatnonzero(last) + 1
        yield m, s, t, d0 + np.searchsorted(edge, s, "right") - 1 if d1 - d0 > 1 else np.full(len(s), d0), b


def hash_words(m: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte run, from one running sum over the piece."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _pow(max(PIECE, len(m)))
    with np.errstate(over="ignore"):
        total = np.zeros(len(m) + 1, np.uint64)
        np.cumsum(m * up[: len(m)], dtype=np.uint64, out=total[1:])
        return mix((total[ends] - total[starts]) * down[starts])


def hashed_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, document, first byte, end byte) of every word of a batch."""
    out = [(hash_words(m, s, t), d, s + b, t + b) for m, s, t, d, b in word_spans(data, offsets)]
    if not out:
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def slices(batch: pa.RecordBatch, column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about `most` bytes of text, so that temporaries don't grow with the batch."""
    i = batch.schema.get_field_index(column)
    sizes = text_buffer(batch.column(i))[1][1:] if batch.num_rows else np.zeros(0, np.int64)
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, end - at)
        at = end
