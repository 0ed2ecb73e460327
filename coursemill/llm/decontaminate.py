"""Benchmark decontamination by latent semantic retrieval.

1. Document frequencies of hashed words are summed over all documents.
2. A randomised SVD, with its products summed over tasks, finds the leading directions of
   the TF-IDF passages: all of the corpus and of the benchmark items.
3. Every window of every document is projected on those directions and compared by cosine
   with the items of its length class, one bounded block of items after the other.
4. Candidates are verified on the words themselves: longest common subsequence with the
   item in the window's surroundings, and for looser matches (paraphrases) the item's
   answer, its rarest words, too. Candidates whose surroundings lack half of the item's
   words by IDF weight are left out first, all at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import distinct, hashed_words, plain, shared_path, slices, text_buffer, written

#: Hashed vocabulary, directions kept, extra directions of the range finder, items searched at a time and about the bytes of their texts.
BITS, RANK, EXTRA, ITEM_BLOCK, ITEM_BYTES = 16, 64, 16, 4_000, 32 << 20
#: The most frequent words, which are multiplied as dense columns; passages multiplied at a time; passages projected and words summed at a time; tasks of a product at most.
COMMON, PIECE, SOME, WORDS, TASKS = 256, 10_000, 2_048, 512, 64
FOUND = "id long, item_id long, share double, start long, end long, answered boolean"
STRIDE, PASSAGE = 8, 32
#: Window widths in blocks of STRIDE words; the longest item (or part of a longer one) that each serves, and the least cosine of a candidate, which is less where a window's place matters more.
WIDTHS = {2: (20, 0.48), 3: (28, 0.5), 4: (40, 0.55), 6: (56, 0.55), 8: (64, 0.55)}
MOST_BLOCKS, PART = 8, 64
NONE = (1 << 31) - 1
#: Least share of the item's words by IDF weight; least share in common order, without and with the answer; words of the answer, and how many of them have to be there.
COVER, SURE, LOOSE, ANSWER, ANSWERED = 0.45, 0.7, 0.5, 3, 2


def _buckets(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


def document_frequencies(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, int]:
    """(documents per hashed word, documents), over all documents; what reaches the driver has a fixed size."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((1 << BITS) + 1, np.int64)
        for batch in batches:
            for b in slices(batch, "text"):
                h, doc, _, _ = hashed_words(*text_buffer(b.column(0)))
                keys = distinct(doc.astype(np.int64) << BITS | _buckets(h))
                total[:-1] += np.bincount(keys & ((1 << BITS) - 1), minlength=1 << BITS)
                total[-1] += b.num_rows
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(total[hit])], ["k", "n"])

    got = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(of, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros((1 << BITS) + 1, np.int64)
    total[got["k"].to_numpy()] = got["n"].to_numpy()
    return total[:-1], int(total[-1])


def _passages(rows: DataFrame) -> DataFrame:
    """rows(text) -> (words binary): the hashed words, 16 bits each, of every PASSAGE words of every text; a text's last passage may be shorter."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text"):
                h, doc, _, _ = hashed_words(*text_buffer(b.column(0)))
                if len(h):
                    first = np.flatnonzero(np.diff(doc, prepend=-1))
                    place = np.arange(len(h)) - np.repeat(first, np.diff(np.append(first, len(h))))
                    at = np.append(np.flatnonzero(place % PASSAGE == 0), len(h)).astype(np.int32) * 2
                    words = _buckets(h).astype("<u2").tobytes()
                    yield pa.RecordBatch.from_arrays([pa.BinaryArray.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.tobytes()), pa.py_buffer(words)])], ["words"])

    return rows.mapInArrow(of, "words binary")


def _passage_words(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(words of the passages, n + 1 offsets)."""
    wide = pa.types.is_large_binary(col.type)
    _, offsets, data = col.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]].view("<u2").astype(np.int64), (at - at[0]) // 2


def _projected(idf: np.ndarray, words: np.ndarray, offsets: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """idf-weighted sums of the basis rows of each passage's words, a place of all passages at a time."""
    out, sums = np.zeros((len(offsets) - 1, basis.shape[1]), np.float32), np.empty((SOME, basis.shape[1]), np.float32)
    for at in range(0, len(out), SOME):
        left, start, sizes = out[at : at + SOME], offsets[at : at + SOME], np.diff(offsets[at : at + SOME + 1])
        part, start = sums[: len(left)], start[: len(left)]
        for k in range(int(sizes.max())):
            word = words[np.minimum(start + k, len(words) - 1)]
            np.take(basis, word, axis=0, out=part, mode="clip")
            part *= np.where(k < sizes, idf[word], np.float32(0))[:, None]
            left += part
    return out


def _add_by_word(total: np.ndarray, idf: np.ndarray, words: np.ndarray, rows: np.ndarray, left: np.ndarray) -> None:
    """total[w] += idf[w] * the sum of left[rows] where `words` is w: words of about equal counts together, an occurrence of each at a time."""
    order = np.argsort(words.astype(np.uint16), kind="stable")
    words, rows = words[order], rows[order]
    first = np.flatnonzero(np.diff(words, prepend=-1))
    counts = np.diff(np.append(first, len(words)))
    by_count = np.argsort(-counts, kind="stable")
    first, counts = first[by_count], counts[by_count]
    sums, part = np.empty((2, WORDS, left.shape[1]), np.float32)
    for at in range(0, len(first), WORDS):
        f, n = first[at : at + WORDS], counts[at : at + WORDS]
        np.take(left, rows[f], axis=0, out=sums[: len(f)], mode="clip")
        for k, m in enumerate(np.searchsorted(-n, -np.arange(1, n[0])).tolist(), 1):
            np.take(left, rows[f[:m] + k], axis=0, out=part[:m], mode="clip")
            sums[:m] += part[:m]
        w = words[f]
        total[w] += idf[w, None] * sums[: len(f)]


def _add_product(total: np.ndarray, idf: np.ndarray, words: np.ndarray, offsets: np.ndarray, basis: np.ndarray, common: np.ndarray, place: np.ndarray) -> None:
    """total += A^T (A B) for the unit TF-IDF rows A of passages, 65,536 at most. common: the words whose columns are dense; place: a word's number among them, or -1.

    A is counts times idf, each row divided by its length; the sums below are over words with
    their repeats, so only the lengths need the counts.
    """
    n = len(offsets) - 1
    row = np.repeat(np.arange(n), np.diff(offsets))
    key = np.sort((row << BITS | words).astype(np.uint32))
    first = np.flatnonzero(np.diff(key, prepend=key[:1] ^ 1))
    w = np.diff(np.append(first, len(key))) * idf[key[first] & ((1 << BITS) - 1)]
    squares = np.bincount(key[first] >> BITS, weights=w * w, minlength=n)
    left = _projected(idf, words, offsets, basis)
    left /= np.maximum(squares, 1e-24).astype(np.float32)[:, None]
    col = place[words]
    dense = np.flatnonzero(col >= 0)
    cell, many = row[dense] * len(common) + col[dense], 512 * len(common)
    for at in range(0, n, 512):
        some = left[at : at + 512]
        lo, hi = np.searchsorted(row[dense], [at, at + 512])
        counts = np.bincount(cell[lo:hi] - at * len(common), minlength=many)[: len(some) * len(common)]
        total[common] += idf[common, None] * (counts.astype(np.float32).reshape(len(some), -1).T @ some)
    rare = np.flatnonzero(col < 0)
    if len(rare):
        _add_by_word(total, idf, words[rare], row[rare], left)


def latent_basis(spark: SparkSession, passages: DataFrame, idf: np.ndarray, rank: int = RANK, extra: int = EXTRA, rounds: int = 2, seed: int = 13, shards: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """(directions, singular values) of passages(words) by a randomised range finder; each round is a distributed product over all of them, made orthogonal here by its small Gram matrix.

    Tasks draw the random start themselves, and products come back in small shards, of a task
    for each core and TASKS at most, so what is shuffled doesn't grow with the passages.
    """
    size, wide = 1 << BITS, rank + extra
    passages = passages.coalesce(min(spark.sparkContext.defaultParallelism, TASKS))
    common = np.sort(np.argsort(idf, kind="stable")[:COMMON])
    place = np.full(size, -1)
    place[common] = np.arange(len(common))
    basis, values = np.zeros((size, wide), np.float32), np.ones(wide)
    for k in range(rounds):
        sent = spark.sparkContext.broadcast(basis) if k else None

        def of(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            basis = sent.value if sent else np.random.default_rng(seed).standard_normal((size, wide), dtype=np.float32)
            total = np.zeros_like(basis)
            for b in batches:
                words, at = _passage_words(b.column(0))
                for i in range(0, b.num_rows, PIECE):
                    some = at[i : i + PIECE + 1]
                    _add_product(total, idf, words[some[0] : some[-1]], some - some[0], basis, common, place)
            yield pa.RecordBatch.from_arrays([pa.array(range(shards), pa.int32()), pa.array([p.tobytes() for p in np.split(total, shards)], pa.binary())], ["shard", "part"])

        def added(parts: pd.DataFrame) -> pd.DataFrame:
            total = sum(np.frombuffer(p, np.float32).astype(np.float64) for p in parts["part"])
            return pd.DataFrame({"shard": parts["shard"].iloc[:1], "part": [total.astype(np.float32).tobytes()]})

        n = size // shards
        for r in passages.mapInArrow(of, "shard int, part binary").groupBy("shard").applyInPandas(added, "shard int, part binary").collect():
            basis[r["shard"] * n : (r["shard"] + 1) * n] = np.frombuffer(r["part"], np.float32).reshape(n, -1)
        if sent:
            sent.destroy()
        gram = sum(part.T @ part for part in (basis[a : a + 4096].astype(np.float64) for a in range(0, size, 4096)))
        squares, turn = np.linalg.eigh(gram)
        values = np.sqrt(np.maximum(squares[::-1], 1e-24))
        turn = (turn[:, ::-1] / values).astype(np.float32)
        for a in range(0, size, 4096):
            basis[a : a + 4096] = basis[a : a + 4096] @ turn
    return basis[:, :rank], np.sqrt(np.maximum(values[:rank], 1e-12))


@dataclass(frozen=True)
class Items:
    """A block of benchmark items: ids, words and what verification needs; and the latent vectors of their parts, of length 1 / least cosine, with the item, first word and window width of each."""

    ids: list
    words: list
    answers: list
    known: list
    weights: list
    vectors: np.ndarray
    owner: np.ndarray
    first: np.ndarray
    width: np.ndarray


def make_items(rows: list, table: np.ndarray, idf: np.ndarray) -> Items:
    """rows: (item_id, text). Items without words are left out."""
    ids, words, answers, known, weights, vectors, parts = [], [], [], [], [], [], []
    for i, text in rows:
        h = hashed_words(*text_buffer(pa.array([text or ""])))[0]
        if not len(h):
            continue
        ids.append(i)
        words.append(h)
        answers.append(frozenset(sorted(set(h.tolist()), key=lambda x: (-idf[x >> (64 - BITS)], x))[:ANSWER]))
        known.append(np.unique(h))
        weight = idf[_buckets(known[-1])].astype(float)
        weights.append(weight / weight.sum())
        n = -(-len(h) // PART)
        for part in np.array_split(np.arange(len(h)), n):
            v = table[_buckets(h[part])].sum(axis=0)
            norm = float(np.sqrt((v * v).sum()))
            width, least = next((w, c) for w, (most, c) in WIDTHS.items() if len(part) <= most)
            vectors.append(v / (norm * least) if norm > 0 else v)
            parts.append((len(ids) - 1, int(part[0]), width))
    owner, first, width = np.array(parts, np.int64).reshape(-1, 3).T
    return Items(ids, words, answers, known, weights, np.array(vectors, np.float32).reshape(len(parts), table.shape[1]), owner, first, width)


def lcs(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, a bit per word of a."""
    place: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        place[x] = place.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for x in b.tolist():
        if m := place.get(x):
            u = v & m
            v = (v + u | v - u) & full
    return len(a) - v.bit_count()


def verify(item: np.ndarray, answer: frozenset, region: np.ndarray) -> tuple[float, int, int, bool] | None:
    """(share of the item's words in common order, first and end word, answer found) of the best stretch of the region of about the item's length; None below the thresholds."""
    n = len(item)
    known = np.isin(region, item)
    if known.sum() < LOOSE * n:
        return None
    span, step = n + n // 4 + 2, max(2, n // 8)
    best = (0, 0)
    for a in range(0, max(len(region) - span, 0) + step, step):
        # Stretches with too few of the item's words can't reach the best so far.
        if known[a : a + span].sum() > best[0]:
            found = lcs(item, region[a : a + span])
            if found > best[0]:
                best = (found, a)
    share, a = best[0] / n, best[1]
    if share < LOOSE:
        return None
    stretch = region[a : a + span]
    hit = np.flatnonzero(known[a : a + span])
    answered = len(answer & set(stretch.tolist())) >= min(ANSWERED, len(answer))
    # A short item has to be there in whole: few words meet by chance.
    need = SURE if n >= 16 else 0.9
    return (share, a + int(hit[0]), a + int(hit[-1]) + 1, answered) if share >= need or (answered and n >= 16) else None


def _window_sums(table: np.ndarray, words: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sums of each STRIDE words, document of each, first word of each). A document's last block may be shorter, and zero blocks follow it, -1 their document, so that no window reaches the next document."""
    first = np.flatnonzero(np.diff(doc, prepend=-1))
    sizes = np.diff(np.append(first, len(doc)))
    n = -(-sizes // STRIDE) + MOST_BLOCKS - 1
    rank = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    start, end = np.repeat(first, n) + STRIDE * rank, np.repeat(first + sizes, n)
    at = np.append(words, len(table) - 1)  # the table's last row is zero
    sums = np.zeros((len(start), table.shape[1]), np.float32)
    for a in range(0, len(start), 1 << 13):
        part = sums[a : a + (1 << 13)]
        for k in range(STRIDE):
            i = start[a : a + (1 << 13)] + k
            part += table[at[np.where(i < end[a : a + (1 << 13)], i, len(words))]]
    return sums, np.where(start < end, doc[np.minimum(start, len(doc) - 1)], -1), start


def _candidates(sums: np.ndarray, doc: np.ndarray, items: Items) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(first block, part of an item) of windows close to the part."""
    windows = {1: sums}

    def widened(a: int, b: int) -> np.ndarray:
        longer = windows[a].copy()
        longer[:-a] += windows[b][a:]
        return longer

    for wide, (a, b) in {2: (1, 1), 3: (2, 1), 4: (2, 2), 6: (3, 3), 8: (4, 4)}.items():
        windows[wide] = widened(a, b)
        mine = np.flatnonzero(items.width == wide)
        if not len(mine):
            continue
        for at in range(0, len(doc), 4096):
            v = windows[wide][at : at + 4096]
            w, i = np.nonzero(v @ items.vectors[mine].T > np.sqrt(np.einsum("ij,ij->i", v, v))[:, None])
            real = doc[at + w] >= 0
            if real.any():
                yield at + w[real], mine[i[real]]


def _gathered(parts: Iterator[tuple[np.ndarray, np.ndarray]], most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The parts of _candidates() together, `most` candidates at a time or a part more, so that an item is looked at once."""
    held, n = [], 0
    for part in parts:
        held.append(part)
        n += len(part[0])
        if n >= most:
            yield tuple(map(np.concatenate, zip(*held, strict=True)))
            held, n = [], 0
    if held:
        yield tuple(map(np.concatenate, zip(*held, strict=True)))


def _covered(items: Items, i: int, words: np.ndarray, low: np.ndarray, high: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Share, by IDF weight, of the item's distinct words that each stretch of hashed words holds. place: scratch space, NONE for every hashed word before and after."""
    known, none = _buckets(items.known[i]), len(items.known[i])
    place[known] = np.arange(none)
    out = np.empty(len(low))
    weights = np.append(items.weights[i], 0.0)
    rows = min(4096, max(1, (1 << 22) // max(none + 1, int((high - low).max()))))
    for a in range(0, len(low), rows):
        lo, hi = low[a : a + rows, None], high[a : a + rows, None]
        at = lo + np.arange(int((hi - lo).max()))
        column = np.minimum(np.where(at < hi, place[words[np.minimum(at, len(words) - 1)]], none), none)
        there = np.zeros((len(column), none + 1), bool)
        there[np.arange(len(column))[:, None], column] = True
        out[a : a + rows] = there @ weights
    place[known] = NONE
    return out


def _merged(d: np.ndarray, place: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One stretch for those of a document that put an item of several parts at about the same place: parts of one copy agree on it, so the whole item is looked at once."""
    order = np.lexsort((place, d))
    d, place, low, high = d[order], place[order], low[order], high[order]
    first = np.flatnonzero((np.diff(d, prepend=-1) != 0) | (np.diff(place, prepend=place[0]) != 0))
    return d[first], np.minimum.reduceat(low, first), np.maximum.reduceat(high, first)


def _matches(h: np.ndarray, doc: np.ndarray, bounds: np.ndarray, items: Items, table: np.ndarray) -> dict:
    """{(document, item): (share, start, end, answered)} of one slice; start and end in words of the document."""
    words = _buckets(h)
    sums, of_doc, start = _window_sums(table, words, doc)
    place, out = np.full(1 << BITS, NONE, np.int32), {}
    for blocks, which in _gathered(_candidates(sums, of_doc, items)):
        owner = items.owner[which]
        order = np.argsort(owner, kind="stable")
        blocks, which, owner = blocks[order], which[order], owner[order]
        for part in np.split(np.arange(len(which)), np.flatnonzero(np.diff(owner)) + 1):
            i, k, p = int(owner[part[0]]), blocks[part], which[part]
            d, n, at = of_doc[k], len(items.words[i]), start[k] - items.first[p]
            slack = n // 4 + 2 * STRIDE + items.width[p] * STRIDE // 2
            low, high = np.maximum(at - slack, bounds[d]), np.minimum(at + n + slack, bounds[d + 1])
            if n > PART:
                d, low, high = _merged(d, at // max(STRIDE, n // 16), low, high)
            for c in np.flatnonzero(_covered(items, i, words, low, high, place) >= COVER).tolist():
                key = (int(d[c]), i)
                if key in out and out[key][0] == 1.0:
                    continue
                if got := verify(items.words[i], items.answers[i], h[low[c] : high[c]]):
                    at_word = int(low[c] - bounds[d[c]])
                    new = (got[0], at_word + got[1], at_word + got[2], got[3])
                    out[key] = max(new, out.get(key, new))
    return out


def search(docs: DataFrame, items: Broadcast, table: Broadcast, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, item_id, share, start, end, answered): contaminated stretches, one per document row and item of the block; start and end in words."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, directions = items.value, table.value
        for batch in batches:
            out: list = []
            for b in slices(batch, "text", 2 << 20):
                h, doc, _, _ = hashed_words(*text_buffer(b.column(1)))
                if len(h):
                    found = _matches(h, doc, np.searchsorted(doc, np.arange(b.num_rows + 1)), block, directions)
                    ids = b.column(0)
                    out += [(ids[d].as_py(), block.ids[i], *v) for (d, i), v in found.items()]
            cols = list(zip(*out, strict=True)) or [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["id", "item_id", "share", "start", "end", "answered"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(of, FOUND)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_block: int = ITEM_BLOCK) -> DataFrame:
    """(id_col, item_id, lcs_share, start_word, end_word, answer_found): one row per document id and benchmark item that it holds.

    Clean documents have no row. Documents with a null or empty text hold nothing, and so do
    rows without an id; items with a null or blank text are in no document; equal items each
    have rows. Rows that share an id report their best stretch. Words are runs of letters and
    digits, lower-cased. Items are read in blocks of bounded size, each searched over all
    documents; what a block finds is written before the next one is read, and its broadcast
    freed. Other columns, whatever their names, aren't looked at.
    """
    spark = docs.sparkSession
    docs = docs.where(F.col(id_col).isNotNull())
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    count, n = document_frequencies(docs, text_col)
    idf = np.log((n + 1) / (count + 0.5)).astype(np.float32)
    np.maximum(idf, 0.05, out=idf)
    n_items, n_bytes = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    # Equal passages, of which a table may have very many, are one.
    texts = docs.select(F.col(text_col).cast("string").alias("text")).unionByName(items.select("text"))
    basis, values = latent_basis(spark, written(_passages(texts).distinct(), "passages"), idf)
    # Directions are evened out, so that the few that all passages share don't decide.
    table = np.zeros(((1 << BITS) + 1, basis.shape[1]), np.float32)  # the last row stands for no word
    np.multiply(basis, idf[:, None], out=table[:-1])
    table /= np.maximum(values, values[0] * 1e-3).astype(np.float32)
    del basis
    blocks, path, any_items = max(1, -(-n_items // item_block), -(-n_bytes // ITEM_BYTES)), shared_path(spark, "contaminated"), False
    sent_table = spark.sparkContext.broadcast(table)
    for k in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("id", F.lit(31)), F.lit(blocks)) == k)
        some = make_items(sorted(map(tuple, part.collect()), key=lambda r: (r[0], r[1])), table, idf)
        if some.ids:
            sent = spark.sparkContext.broadcast(some)
            search(docs, sent, sent_table, id_col, text_col).write.mode("append").parquet(path)
            sent.destroy()
            any_items = True
    sent_table.destroy()
    found = spark.read.schema(FOUND).parquet(path) if any_items else spark.createDataFrame([], FOUND)
    best = found.groupBy("id", "item_id").agg(F.max(F.struct("share", "start", "end", "answered")).alias("b"))
    return best.select(F.col("id").alias(id_col), "item_id", F.col("b.share").alias("lcs_share"), F.col("b.start").alias("start_word"), F.col("b.end").alias("end_word"), F.col("b.answered").alias("answer_found"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the documents that hold a benchmark item; all columns, whatever their names, and other rows, null ids included, stay.

    The ids that go are written before texts are read again, so Spark knows their size and
    doesn't shuffle texts for few of them.
    """
    bad = written(contaminated(docs, benchmark, id_col, text_col).select(F.col(id_col).alias("_bad_id")).distinct(), "contaminated-ids")
    rows, names = plain(docs)
    key = F.col(names[docs.columns.index(id_col)]).cast("long")
    return rows.join(bad, key == F.col("_bad_id"), "left_anti").toDF(*docs.columns)
