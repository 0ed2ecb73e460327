"""Alignment of two tokenizers over a corpus: which ids stand for the same bytes, and how often.

Byte offsets at which tokens of both sides end cut a document into groups; every pair of tokens
in a group is a link. An id pair counts in as many documents as link it.

Each task encodes its documents a few MB at a time (a slice) and writes a row for every
document, and one for every id of side A in a slice: the sorted postings (id of side B,
document, times) of its links. Counts of pairs are summed by tasks first and then by id of
side A. For the contributions a stream sorted by id of side A has its counts first and its
postings after them, so a task holds the counts of one id (a number for each id of side B) and
sums by document; those sums meet the documents of their slice. An id with many postings is
dealt to several tasks, each with its counts.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, written

TOKENIZERS = "/opt/tokenizers"
#: Bytes of text in a slice, links unpacked at a time, and document sums held by a task before it sends them.
SLICE, LINKS, HELD = 4 << 20, 4 << 20, 2 << 20
#: Characters from which on a text goes to the slower encoder, whose stack doesn't grow with runs of white space.
LONG = 200_000
#: What both sides encode apart: up to a blank or line break after a visible character.
SEGMENT = re.compile(r"\s*\S[^ \n]*(?:(?<=\s)[ \n][^ \n]*)*|\s+")


class Sides:
    """Both encoders with their tokens' bytes. Side A: byte-level merges over space + text; side B: pieces with byte fallback over text."""

    def __init__(self, folder: str, a_file: str = "byte_bpe_50k.json", b_file: str = "piece_bpe_32k.model"):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        with open(f"{folder}/{a_file}", encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        letters = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(shown)))}
        ranks = {bytes(letters[c] for c in token): i for token, i in vocab.items()}
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.a_bytes[i] = token
        self.slow = Tokenizer.from_file(f"{folder}/{a_file}")
        self.slow.encode_special_tokens = True
        # Ids are in the order of merges, and every token is what its own bytes are merged to; so merging by rank equals merging by the file's list (tests hold both against each other).
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.fast = tiktoken.Encoding("merges", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/{b_file}")
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.pieces.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(map(self.pieces.id_to_piece, range(self.pieces.get_piece_size())))]
        self.a_len, self.b_len = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        self.blank = self.pieces.piece_to_id("▁")
        self.parted = not any(" " in x.lstrip(b" ").decode("utf-8", "replace") or b"\n" in x[:-1] or b"\n" in x[1:] for x in self.b_bytes)
        digits = [str(i).encode() for i in range(max(len(self.a_bytes), len(self.b_bytes)))]
        self.width = max(map(len, digits)) + 1
        self.digits = np.frombuffer(b"".join((d + s).ljust(self.width, b"\0") for d in digits for s in (b",", b"|", b";")), np.uint8).reshape(-1, self.width)

    def encode_a(self, text: str) -> list[int]:
        if len(text) < LONG:
            try:
                return self.fast.encode_ordinary(text)
            except BaseException as e:  # the encoder's panic on a long run is no Exception
                if isinstance(e, KeyboardInterrupt | SystemExit | MemoryError):
                    raise
        return self.slow.encode(text, add_special_tokens=False).ids

    def segments(self, text: str) -> list[str]:
        """Space + text in pieces that both sides encode apart from each other, none for an empty text.

        Side A parts words before white space, and no token of side B goes on after a blank or
        holds a line break, so a blank or line break after a visible character begins a segment.
        """
        if not text:
            return []
        return SEGMENT.findall(" " + text) if self.parted else [" " + text]

    def encode(self, segments: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both sides; none where a side's bytes aren't the segment's. Side B puts a blank before what it reads: that of the segment, or one that is taken off again."""
        a = [self.encode_a(x) for x in segments]
        b = self.pieces.encode([x[1:] if x[0] == " " else x for x in segments], num_threads=1)
        for i, x in enumerate(segments):
            if x == " ":
                b[i] = [self.blank]  # as nothing is what comes of an empty text
            elif x[0] != " ":
                b[i] = b[i][1:]
            raw = x.encode()
            if b"".join(map(self.b_bytes.__getitem__, b[i])) != raw or b"".join(map(self.a_bytes.__getitem__, a[i])) != raw:
                a[i], b[i] = [], []
        return a, b


@lru_cache(1)
def sides(folder: str) -> Sides:
    return Sides(folder)


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(x) for x in lists], np.int64)
    return np.fromiter((i for x in lists for i in x), np.int64, int(sizes.sum())), np.concatenate([[0], np.cumsum(sizes)])


def _reduced(group: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, id, times), sorted, of tokens in their groups; groups are under 2^40 and ids under 2^20."""
    key, times = np.unique((group << 20) | ids, return_counts=True)
    return key >> 20, key & 0xFFFFF, times


def _pairs(ga: np.ndarray, a: np.ndarray, ta: np.ndarray | None, gb: np.ndarray, b: np.ndarray, tb: np.ndarray | None, doc_of: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text << 36 | a << 20 | b, times) of all links, about `most` at a time; the inputs are sorted by group, and no times are times of 1."""
    n_b = np.bincount(gb, minlength=len(doc_of))
    first, width = (np.cumsum(n_b) - n_b)[ga], n_b[ga]
    left_key, right_key = (doc_of[ga].astype(np.uint64) << np.uint64(36)) | (a.astype(np.uint64) << np.uint64(20)), b.astype(np.uint64)
    total = np.concatenate([[0], np.cumsum(width)])
    at = 0
    while at < len(ga):
        end = max(at + 1, int(np.searchsorted(total, total[at] + most, "right")) - 1)
        w = width[at:end]
        left = np.repeat(np.arange(at, end), w)
        right = np.arange(total[end] - total[at]) - np.repeat(total[at:end] - total[at], w) + np.repeat(first[at:end], w)
        yield _add(left_key[left] | right_key[right], None if ta is None else ta[left] * tb[right])
        at = end


def _add(key: np.ndarray, times: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys, summed times), sorted."""
    if times is None:
        key = np.sort(key)
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        return key[first], np.diff(np.append(first, len(key)))
    order = np.argsort(key)
    key, times = key[order], times[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(times, first) if len(key) else times


@dataclass
class Aligned:
    """What texts are made of, as arrays over texts: numbers of tokens, groups and links, the groups as written, and a text's distinct links as [at[i], at[i + 1]) of pairs (a << 20 | b) and times."""

    numbers: np.ndarray
    written: list[bytes]
    at: np.ndarray
    pairs: np.ndarray
    times: np.ndarray


def align(s: Sides, texts: list[str], links: int = LINKS) -> Aligned:
    """Groups and links of texts that are encoded as they are; a text without tokens has none."""
    la, lb = s.encode(texts)
    (a, at_a), (b, at_b) = _flat(la), _flat(lb)
    n_texts = len(texts)
    if not len(a):
        return Aligned(np.zeros((n_texts, 4), np.int64), [b""] * n_texts, np.zeros(n_texts + 1, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
    end_a, end_b = np.cumsum(s.a_len[a]), np.cumsum(s.b_len[b])
    both = np.intersect1d(end_a, end_b, assume_unique=True)
    ga, gb = np.searchsorted(both, end_a), np.searchsorted(both, end_b)
    n = len(both)
    na, nb = np.bincount(ga, minlength=n), np.bincount(gb, minlength=n)
    first_group = np.searchsorted(both, np.concatenate([[0], end_a])[at_a], "right")
    text_of = np.repeat(np.arange(n_texts), np.diff(first_group))
    n_links = np.add.reduceat(np.append(na * nb, 0), first_group[:-1]) * (np.diff(first_group) > 0)
    # The groups as written: tokens of side A of a group, then those of side B, each with what follows it.
    last_a, last_b = np.append(ga[1:] != ga[:-1], True), np.append(gb[1:] != gb[:-1], True)
    merged = np.empty(len(a) + len(b), np.int64)
    merged[np.arange(len(a)) + (np.cumsum(nb) - nb)[ga]] = a * 3 + last_a
    merged[np.arange(len(b)) + np.cumsum(na)[gb]] = b * 3 + 2 * last_b
    shown = s.digits[merged]
    kept = shown != 0
    raw, byte_at = shown[kept].tobytes(), np.concatenate([[0], np.cumsum(kept.sum(1))])[at_a + at_b].tolist()
    large = (na * nb).max() > 1 << 12  # then links of equal ids in a group are counted, not listed
    tokens = (*_reduced(ga, a), *_reduced(gb, b)) if large else (ga, a, None, gb, b, None)
    key, times, parts, held = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0
    for part in _pairs(*tokens, text_of, links):
        parts.append(part)
        held += len(part[0])
        if held > 2 * links:
            key, times = _add(np.concatenate([key, *(k for k, _ in parts)]), np.concatenate([times, *(t for _, t in parts)]))
            parts, held = [], 0
    if parts:
        key, times = _add(np.concatenate([key, *(k for k, _ in parts)]), np.concatenate([times, *(t for _, t in parts)]))
    at = np.searchsorted(key >> np.uint64(36), np.arange(n_texts + 1, dtype=np.uint64))
    numbers = np.stack([np.diff(at_a), np.diff(at_b), np.diff(first_group), n_links], 1)
    return Aligned(numbers, [raw[i : max(i, j - 1)] for i, j in zip(byte_at[:-1], byte_at[1:], strict=True)], at, key & np.uint64((1 << 36) - 1), times)


class Memory:
    """Segments that a task has aligned; forgotten when they are many or long."""

    def __init__(self, s: Sides, most: int = 300_000, chars: int = 16 << 20):
        self.s, self.most, self.chars = s, most, chars
        self.clear()

    def clear(self) -> None:
        self.number, self.size = {}, 0
        self.numbers, self.written, self.at, self.pairs, self.times = np.zeros((0, 4), np.int64), [], np.zeros(1, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def numbered(self, segments: list[list[str]]) -> list[list[int]]:
        """Numbers of each document's segments, after those that are new were aligned."""
        if len(self.number) > self.most or self.size > self.chars:
            self.clear()
        new = list(dict.fromkeys(x for doc in segments for x in doc if x not in self.number))
        more, at = [], 0
        while at < len(new):
            end, size = at, 0
            while end < len(new) and end - at < 65536 and (end == at or size < 2 << 20):
                size += len(new[end])
                end += 1
            more.append(align(self.s, new[at:end]))
            self.size += size
            at = end
        if new:
            self.number.update((x, i) for i, x in enumerate(new, len(self.written)))
            self.written += [w for m in more for w in m.written]
            self.numbers = np.concatenate([self.numbers, *(m.numbers for m in more)])
            ends = np.cumsum([self.at[-1], *(len(m.pairs) for m in more)])
            self.at = np.concatenate([self.at, *(m.at[1:] + e for m, e in zip(more, ends, strict=False))])
            self.pairs, self.times = (np.concatenate([getattr(self, k), *(getattr(m, k) for m in more)]) for k in ("pairs", "times"))
        get = self.number.__getitem__
        return [[*map(get, doc)] for doc in segments]


def align_documents(memory: Memory, texts: list[str], links: int = LINKS) -> tuple[dict[str, list], np.ndarray, np.ndarray]:
    """Per document n_a, n_b, n_groups, n_links and groups_sha256, and (a << 40 | b << 20 | document, times) of each distinct link of a document, sorted."""
    docs = memory.numbered([memory.s.segments(t) for t in texts])
    seg, at_doc = _flat(docs)
    n = len(texts)
    doc = np.repeat(np.arange(n), np.diff(at_doc))
    failed = np.bincount(doc, memory.numbers[seg, 0] == 0, n) > 0  # a segment that a side doesn't give back: no tokens in all the document
    keep = ~failed[doc]
    seg, doc = seg[keep], doc[keep]
    values = [np.bincount(doc, memory.numbers[seg, i], n).astype(np.int64) for i in range(4)]
    digests = ["" if f or not d else hashlib.sha256(b";".join(map(memory.written.__getitem__, d))).hexdigest() for d, f in zip(docs, failed.tolist(), strict=True)]
    width = np.diff(memory.at)[seg]
    total = np.concatenate([[0], np.cumsum(width)])
    key, times, at = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0
    while at < len(seg):
        end = max(at + 1, int(np.searchsorted(total, total[at] + links, "right")) - 1)
        w = width[at:end]
        i = np.arange(total[end] - total[at]) + np.repeat(memory.at[seg[at:end]] - total[at:end] + total[at], w)
        k, t = (memory.pairs[i] << np.uint64(20)) | np.repeat(doc[at:end], w).astype(np.uint64), memory.times[i]
        k, t = _add(k, None if t.max(initial=1) == 1 else t)
        key, times = _add(np.concatenate([key, k]), np.concatenate([times, t])) if len(key) else (k, t)
        at = end
    return dict(zip(("n_a", "n_b", "n_groups", "n_links", "groups_sha256"), (*values, digests), strict=True)), key, times


def pack(b: np.ndarray, doc: np.ndarray, times: np.ndarray) -> bytes:
    """Postings of one id of side A in a slice: distinct ids of side B with how many documents each has, the documents (2 bytes, or 4 where a slice has more), and times (1 byte, or 8)."""
    ids, n = np.unique(b, return_counts=True)
    wide_doc, wide_times = bool(len(doc) and doc.max() > 65535), bool(len(times) and times.max() > 255)
    head = np.array([len(ids), wide_doc, wide_times], "<u4").tobytes()
    return head + ids.astype("<u2").tobytes() + n.astype("<u4").tobytes() + doc.astype("<u4" if wide_doc else "<u2").tobytes() + times.astype("<i8" if wide_times else "u1").tobytes()


def unpack(raw: bytes, counts_only: bool = False) -> tuple[np.ndarray, ...]:
    """(distinct ids of side B, documents of each), and with them the documents and times of all."""
    k, wide_doc, wide_times = np.frombuffer(raw, "<u4", 3).tolist()
    ids, n = np.frombuffer(raw, "<u2", k, 12), np.frombuffer(raw, "<u4", k, 12 + 2 * k)
    if counts_only:
        return ids, n
    at, total = 12 + 6 * k, int(n.sum())
    doc = np.frombuffer(raw, "<u4" if wide_doc else "<u2", total, at)
    return ids, n, doc, np.frombuffer(raw, "<i8" if wide_times else "u1", total, at + doc.nbytes)


ENCODED = "slice long, a int, doc int, id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, postings binary"


def encoded(docs: DataFrame, folder: str) -> DataFrame:
    """Rows of docs(_id, _text) with `a` null, and rows of postings, one for each id of side A in a slice."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory, number = Memory(sides(folder)), TaskContext.get().partitionId() << 32
        names = [f.split(" ")[0] for f in ENCODED.split(", ")]
        types = [pa.int64(), pa.int32(), pa.int32(), *[pa.int64()] * 5, pa.string(), pa.binary()]
        for batch in batches:
            for part in slices(batch, "_text", SLICE):
                rows, key, times = align_documents(memory, [t or "" for t in part.column(1).to_pylist()])
                n = part.num_rows
                nothing = [None] * n
                cols = [[number] * n, nothing, range(n), part.column(0), *rows.values(), nothing]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)
                a, b, doc = (key >> np.uint64(40)).astype(np.int64), ((key >> np.uint64(20)) & np.uint64(0xFFFFF)).astype(np.int64), (key & np.uint64(0xFFFFF)).astype(np.int64)
                first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.zeros(0, np.int64)
                edges = [*first.tolist(), len(a)]
                packed = [pack(b[i:j], doc[i:j], times[i:j]) for i, j in zip(edges[:-1], edges[1:], strict=True)]
                for i in range(0, len(packed), 4096):
                    m = len(packed[i : i + 4096])
                    cols = [[number] * m, a[first[i : i + m]], *[[None] * m] * 7, packed[i : i + m]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)
                number += 1

    return docs.mapInArrow(of, ENCODED)


def _dense(width: int, rows: Iterator[tuple[int, np.ndarray, np.ndarray]]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(a, ids, sums) from rows (a, ids, counts) that are sorted by a; one id's counts are held at a time."""
    now, total = None, np.zeros(width, np.int64)
    for a, ids, n in rows:
        if a != now:
            if now is not None:
                yield now, np.flatnonzero(total), total[total > 0]
                total[:] = 0
            now = a
        total[ids] += n
    if now is not None:
        yield now, np.flatnonzero(total), total[total > 0]


def pair_counts(postings: DataFrame, partitions: int) -> DataFrame:
    """(a, ids, counts, weight): for each id of side A the ids of side B that it is linked to, in how many documents each, and how many postings it has."""
    schema, width = "a int, ids array<int>, counts array<long>, weight long", 1 << 16

    def made(rows: list[tuple]) -> pa.RecordBatch:
        a, ids, n = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())), pa.array(n, pa.list_(pa.int64())), pa.array([int(x.sum()) for x in n])], ["a", "ids", "counts", "weight"])

    def batched(sums: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for x in sums:
            rows.append(x)
            size += len(x[1])
            if size > 1 << 18:
                yield made(rows)
                rows, size = [], 0
        if rows:
            yield made(rows)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = {}, 0  # ids of side A in the order of the vocabulary, with (id of side B, documents) of several slices
        for batch in batches:
            for a, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids, n = unpack(raw.as_buffer(), True)
                held.setdefault(a, []).append((ids.copy(), n.copy()))
                size += len(ids)
            if size > 4 << 20:
                yield from batched(_dense(width, ((a, i, n) for a in sorted(held) for i, n in held[a])))
                held, size = {}, 0
        yield from batched(_dense(width, ((a, i, n) for a in sorted(held) for i, n in held[a])))

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for a, ids, n in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                    yield a, ids.values.to_numpy(), n.values.to_numpy()

        yield from batched(_dense(width, rows()))

    return postings.select("a", "postings").mapInArrow(local, schema).repartition(partitions, "a").sortWithinPartitions("a").mapInArrow(total, schema)


def contributions(postings: DataFrame, counts: DataFrame, partitions: int, held: int = HELD) -> DataFrame:
    """(slice, doc, n_best, count_sum), arrays of documents of a slice: sums over the postings that a task has read.

    An id with over half of a task's share of all postings is dealt to several tasks, by slice;
    how many is at most `partitions` for each of the vocabulary's ids, which are broadcast.
    """
    total = counts.agg(F.sum("weight")).first()[0] or 0
    share = max(total / (2 * partitions), 1)
    deal = counts.select("a", F.least(F.ceil(F.col("weight") / share), F.lit(partitions)).cast("int").alias("deal"))
    lots = counts.join(F.broadcast(deal), "a").select("a", F.explode(F.sequence(F.lit(0), F.col("deal") - 1)).alias("lot"), F.lit(-1).cast("long").alias("slice"), "ids", "counts", F.lit(None).cast("binary").alias("postings"))
    nothing = [F.lit(None).cast(t).alias(n) for n, t in (("ids", "array<int>"), ("counts", "array<long>"))]
    dealt = postings.join(F.broadcast(deal), "a").select("a", F.pmod(F.xxhash64("slice"), F.col("deal")).cast("int").alias("lot"), "slice", *nothing, "postings")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, best, sums, size = np.zeros(1 << 16, np.int64), 0, {}, 0

        def sent() -> Iterator[pa.RecordBatch]:
            for number in sorted(sums):
                b, t = sums[number]
                doc = np.flatnonzero(t)
                yield pa.RecordBatch.from_arrays([pa.array([number]), *(pa.array([v], pa.list_(k)) for v, k in ((doc.astype(np.int32), pa.int32()), (b[doc], pa.int64()), (t[doc], pa.int64())))], ["slice", "doc", "n_best", "count_sum"])

        for batch in batches:
            for number, ids, n, raw in zip(batch.column(2).to_pylist(), batch.column(3), batch.column(4), batch.column(5), strict=True):
                if number < 0:
                    count[:] = 0
                    count[ids.values.to_numpy()] = n.values.to_numpy()
                    best = count.max()
                    continue
                ids, n, doc, times = unpack(raw.as_buffer())
                c = np.repeat(count[ids], n)
                b, t = np.bincount(doc, times * (c == best)), np.bincount(doc, times * c.astype(np.float64))
                if number not in sums or len(sums[number][0]) < len(b):
                    old = sums.get(number, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
                    grown = max(len(b), 64)
                    size += grown - len(old[0])
                    sums[number] = tuple(np.concatenate([x, np.zeros(grown - len(x), np.int64)]) for x in old)
                sums[number][0][: len(b)] += b.astype(np.int64)
                sums[number][1][: len(t)] += t.astype(np.int64)
                if size > held:
                    yield from sent()
                    sums, size = {}, 0
        yield from sent()

    both = lots.unionByName(dealt).repartition(partitions, "a", "lot").sortWithinPartitions("a", "lot", "slice")
    return both.mapInArrow(of, "slice long, doc array<int>, n_best array<long>, count_sum array<long>")


def alignment(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str = TOKENIZERS) -> DataFrame:
    """(id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) per row.

    Null and empty texts, and those that a side doesn't give back byte by byte, have no tokens:
    zeros and an empty digest. Repeated rows are documents of their own, a null id too. Other
    columns aren't read, so their names can't clash. A count has to stay under 2^53 / links
    of a document in a slice.
    """
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    table = written(encoded(rows, folder), "alignment")
    postings = table.where("a IS NOT NULL").select("a", "slice", "postings")
    counts = written(pair_counts(postings, partitions), "pair-counts")
    sums = contributions(postings, counts, partitions)
    values = ["n_a", "n_b", "n_groups", "n_links"]
    out = f"{id_col} long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        doc = left["doc"].to_numpy()
        best, total = np.zeros(int(doc.max(initial=-1)) + 1, np.int64), np.zeros(int(doc.max(initial=-1)) + 1, np.int64)
        for d, b, t in zip(*(right[c].combine_chunks() for c in ("doc", "n_best", "count_sum")), strict=True):
            at = d.values.to_numpy()
            best[at] += b.values.to_numpy()
            total[at] += t.values.to_numpy()
        cols = [left["id"], *(left[v] for v in values), pa.array(best[doc]), pa.array(total[doc]), left["groups_sha256"]]
        return pa.table(cols, names=[f.split(" ")[0] for f in out.split(", ")])

    documents = table.where("a IS NULL").select("slice", "doc", "id", *values, "groups_sha256")
    return documents.groupBy("slice").cogroup(sums.groupBy("slice")).applyInArrow(meet, out)
