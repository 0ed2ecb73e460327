"""Document quality by Bradley-Terry pairwise ranking.

Features are shares that one pass over a text's bytes gives. Preference pairs of a better
and a worse labelled document, every pair there is, train weights by logistic loss on the
difference of their features; a score's quantile among all labelled documents is the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE_BYTES, hash_words, slices, text_buffer, word_spans, written

#: Pairs that fit_ranker() draws of rows in memory; train_ranker() has all pairs of all rows.
PAIRS = 40_000
#: Weight of the ridge; bins of strengths, and standard deviations that they reach to; Newton steps at most, and the gain at which they end; tasks that sum.
DECAY, BINS, REACH, STEPS, GAIN, TASKS = 1e-3, 256, 6.0, 40, 1e-7, 8
PREDICT_AT = 0.3
#: Classes of bytes: 1 lower case, 2 capital, 3 digit, 4 sentence mark, 5 bar, 6 other ASCII mark, 7 beyond ASCII, 8 white space, 9 control.
CLASS = np.zeros(256, np.uint8)
for _b in range(256):
    _c = chr(_b)
    CLASS[_b] = 7 if _b > 127 else 1 if _c.islower() else 2 if _c.isupper() else 3 if _c.isdigit() else 4 if _c in ".,;:?'\"()-" else 5 if _c == "|" else 8 if _b in (32, *range(9, 14)) else 9 if _b < 32 or _b == 127 else 6
NAMES = ("capitals", "digits", "sentence_marks", "bars", "marks", "beyond_ascii", "controls", "repeats", "distinct", "capital_words", "marked_words", "word_length", "long_words", "log_words", "lines")


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(documents, features): log-scaled shares of bytes and words; zeros for texts without words."""
    n = len(offsets) - 1
    count = np.zeros((n, 10))
    lines = np.zeros(n)
    keys, words, repeats, caps, marked, long_words, letters = [], *(np.zeros(n) for _ in range(6))
    for m, s, t, doc, b in word_spans(data, offsets, SPACE_BYTES):
        if not len(m):  # empty texts alone
            continue
        raw = data[b : b + len(m)]
        kind = CLASS[raw]
        d0, d1 = int(np.searchsorted(offsets, b, "right")) - 1, int(np.searchsorted(offsets, b + len(m), "left"))
        of_byte = np.repeat(np.arange(d0, d1), np.diff(np.clip(offsets[d0 : d1 + 1], b, b + len(m)))) if d1 > d0 else np.zeros(0, np.int64)
        part = np.bincount((of_byte - d0) * 10 + kind, minlength=(d1 - d0) * 10)
        count[d0:d1] += part.reshape(-1, 10)
        lines[d0:d1] += np.bincount(of_byte[raw == 10] - d0, minlength=d1 - d0)
        if not len(s):
            continue
        h = hash_words(raw, s, t)
        size = t - s
        add = lambda total, hit: np.add(total, np.bincount(doc[hit], minlength=n), out=total)
        add(words, slice(None))
        add(repeats, np.flatnonzero((h[1:] == h[:-1]) & (doc[1:] == doc[:-1])) + 1)
        first, second, last = kind[s], kind[np.minimum(s + 1, len(kind) - 1)], kind[t - 1]
        add(caps, (size > 1) & (first == 2) & (second == 2))
        add(marked, (last == 6) | (last == 5))
        add(long_words, size > 24)
        letters += np.bincount(doc, weights=size, minlength=n)
        keys.append((doc.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24)))
    distinct = np.zeros(n)
    if keys:
        k = np.sort(np.concatenate(keys))
        k = k[np.concatenate([[True], k[1:] != k[:-1]])]
        distinct = np.bincount((k >> np.uint64(40)).astype(np.int64), minlength=n).astype(float)
    byte, word = np.maximum(count.sum(axis=1), 1), np.maximum(words, 1)
    share = [count[:, 2] / byte, count[:, 3] / byte, count[:, 4] / byte, count[:, 5] / byte, count[:, 6] / byte, count[:, 7] / byte, count[:, 9] / byte, repeats / word]
    ratio = [np.log1p(distinct) / np.log1p(word), caps / word, marked / word, letters / word / 10, long_words / word, np.log1p(words) / 10, lines / word]
    x = np.column_stack([*(np.log1p(50 * v) for v in share), *ratio])
    x[words == 0] = 0
    return x


def document_features(docs: DataFrame, keep: dict[str, Column], text_col: str = "text") -> DataFrame:
    """The kept columns and `x` array<double> for each row's whole text; a null text is empty."""
    rows = docs.select(*(c.alias(k) for k, c in keep.items()), F.col(text_col).cast("string").alias("_text"))
    schema = rows.drop("_text").schema.add("x", T.ArrayType(T.DoubleType()))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "_text"):
                x = features(*text_buffer(b.column(b.num_columns - 1)))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], lists], names=[*schema.names])

    return rows.mapInArrow(of, schema)


@dataclass(frozen=True)
class Ranker:
    """Weights on standardised features; the score is 0.3 at the threshold and grows with the Bradley-Terry strength."""

    mean: np.ndarray
    sd: np.ndarray
    weights: np.ndarray
    threshold: float

    def strength(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.sd, -8, 8) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        base = np.log(PREDICT_AT / (1 - PREDICT_AT))
        return 1 / (1 + np.exp(-np.clip(self.strength(x) - self.threshold + base, -30, 30)))


def fit_ranker(x: np.ndarray, y: np.ndarray, bad_share: float, seed: int = 5, pairs: int = PAIRS, rounds: int = 300, decay: float = DECAY) -> Ranker:
    """Bradley-Terry strengths of rows in memory, from drawn pairs of a document labelled 1 and one labelled 0; without both labels every document passes."""
    mean = x.mean(axis=0) if len(x) else np.zeros(len(NAMES))
    sd = np.maximum(x.std(axis=0), 1e-3) if len(x) else np.ones(len(NAMES))
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return Ranker(mean, sd, np.zeros(x.shape[1] if len(x) else len(NAMES)), -1.0 if len(good) or not len(bad) else 1.0)
    rng = np.random.default_rng(seed)
    z = np.clip((x - mean) / sd, -8, 8)
    diff = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
    w, m, v = np.zeros(z.shape[1]), np.zeros(z.shape[1]), np.zeros(z.shape[1])
    for i in range(1, rounds + 1):
        p = 1 / (1 + np.exp(np.clip(diff @ w, -30, 30)))
        g = -(diff * p[:, None]).mean(axis=0) + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.1 * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)
    s = z @ w
    # Weighted to the share that all labelled documents have: the sample is of equal parts at most.
    order = np.argsort(s)
    weight = np.where(y[order] == 1, (1 - bad_share) / len(good), bad_share / len(bad))
    at = np.cumsum(weight)
    i = min(int(np.searchsorted(at, bad_share, "left")), len(s) - 1)
    low, high = s[order[max(i - 1, 0)]], s[order[min(i + 1, len(s) - 1)]]
    return Ranker(mean, sd, w, float((low + high) / 2))


def _bins(x: np.ndarray, y: np.ndarray, mean: np.ndarray, sd: np.ndarray, w: np.ndarray, width: float) -> np.ndarray:
    """(2 * BINS, 2 + d + d * d): of each label and bin of strengths the rows, and the sums of their strengths, features and products of features."""
    z = np.clip((x - mean) / sd, -8, 8)
    s = z @ w
    at = y * BINS + np.clip(np.floor(s / width) + BINS // 2, 0, BINS - 1).astype(np.int64)
    order = np.argsort(at, kind="stable")
    first = np.flatnonzero(np.diff(at[order], prepend=-1))
    out = np.zeros((2 * BINS, 2 + z.shape[1] + z.shape[1] ** 2))
    for i, j in zip(first, np.append(first[1:], len(order)), strict=True):
        some = z[order[i:j]]
        out[at[order[i]]] = np.concatenate([[j - i, s[order[i:j]].sum()], some.sum(axis=0), (some.T @ some).ravel()])
    return out


def pair_sums(bins: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """(loss, gradient, Hessian) of the mean over all pairs, with the ridge, from _bins(): the rows of a bin count with their mean strength."""
    d = len(w)
    n, z, zz = bins[:, 0], bins[:, 2 : 2 + d], bins[:, 2 + d :].reshape(-1, d, d)
    bad = np.flatnonzero(n[:BINS])
    good = np.flatnonzero(n[BINS:]) + BINS
    gap = (bins[good, 1] / n[good])[:, None] - (bins[bad, 1] / n[bad])[None, :]
    p = 1 / (1 + np.exp(np.clip(gap, -30, 30)))
    q, pairs = p * (1 - p), n[good].sum() * n[bad].sum()
    loss = n[good] @ np.logaddexp(0, -gap) @ n[bad]
    slope = (n[good] @ p) @ z[bad] - (p @ n[bad]) @ z[good]
    cross = z[good].T @ q @ z[bad]
    bend = np.tensordot(q @ n[bad], zz[good], 1) + np.tensordot(n[good] @ q, zz[bad], 1) - cross - cross.T
    return loss / pairs + DECAY / 2 * w @ w, slope / pairs + DECAY * w, bend / pairs + DECAY * np.eye(d)


def fit_pairs(rows: DataFrame, mean: np.ndarray, sd: np.ndarray) -> np.ndarray:
    """Bradley-Terry weights from all pairs of rows(x, _y), by Newton's method.

    A step sums the rows by bins of their strengths, in at most TASKS tasks, and pairs the
    bins, so it takes time in proportion to the rows, though their pairs grow with the square.
    """
    few = rows.select("x", F.col("_y").cast("int").alias("_y")).coalesce(TASKS)

    def summed(w: np.ndarray, width: float) -> np.ndarray:
        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((2 * BINS, 2 + len(w) + len(w) ** 2))
            for b in batches:
                total += _bins(b.column(0).flatten().to_numpy().reshape(-1, len(w)), b.column(1).to_numpy().astype(np.int64), mean, sd, w, width)
            hit = np.flatnonzero(total[:, 0])
            yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array([t.tobytes() for t in total[hit]], pa.binary())], ["i", "sums"])

        total = np.zeros((2 * BINS, 2 + len(w) + len(w) ** 2))
        for r in few.mapInArrow(of, "i long, sums binary").collect():
            total[r["i"]] += np.frombuffer(r["sums"])
        return total

    w = np.zeros(len(mean))
    bins = summed(w, 1.0)
    spread = bins[:, 2 + len(w) :].sum(axis=0).reshape(len(w), -1) / bins[:, 0].sum()
    loss, slope, bend = pair_sums(bins, w)
    for _ in range(STEPS):
        move, part = np.linalg.solve(bend, slope), 1.0
        if slope @ move < GAIN:
            break
        while True:
            near = w - part * move
            new = pair_sums(summed(near, max(2 * REACH * float(np.sqrt(near @ spread @ near)) / BINS, 1e-9)), near)
            if new[0] <= loss or part < 1e-3:
                break
            part /= 2
        w, (loss, slope, bend) = near, new
    return w


def kth(rows: DataFrame, rank: int, few: int = 10_000) -> float:
    """The value of column s that has `rank` rows before it in order, by counts in ever smaller ranges."""
    low, high = rows.agg(F.min("s"), F.max("s")).first()
    while True:
        inside = rows.where(F.col("s").between(low, high))
        width = (high - low) / 1024
        bins = {r["b"]: r for r in inside.groupBy((F.least(F.floor((F.col("s") - low) / width), F.lit(1023)) if width > 0 else F.lit(0)).alias("b")).agg(F.count("*").alias("n"), F.min("s").alias("low"), F.max("s").alias("high")).collect()}
        for _, r in sorted(bins.items()):
            if rank < r["n"]:
                break
            rank -= r["n"]
        low, high = r["low"], r["high"]
        if low == high:
            return low
        if r["n"] <= few:
            return sorted(x["s"] for x in rows.where(F.col("s").between(low, high)).select("s").collect())[rank]


def train_ranker(features: DataFrame, labels: DataFrame, trainable: Column, id_col: str = "doc_id", label_col: str = "quality") -> Ranker:
    """Fit on all labelled documents where `trainable` (of column _id) holds; features(_id, x) as document_features() gives them.

    Features, not texts, are joined with the labels. Of rows that share an id the smallest
    features count, so a table that repeats a labelled id doesn't outweigh the others. Without
    both labels every document passes, or none if all labels are bad.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("_id")).agg(F.min(label_col).cast("int").alias("_y")).where(trainable)
    rows = written(features.where("_id is not null").join(known, "_id").groupBy("_id", "_y").agg(F.min("x").alias("x")).select("x", "_y"), "quality-labelled")
    of = [F.col("x")[k] for k in range(len(NAMES))]
    got = rows.agg(F.count("*"), F.count_if(F.col("_y") == 0), *(F.avg(c) for c in of), *(F.stddev_pop(c) for c in of)).first()
    n, n_bad, d = got[0], got[1], len(NAMES)
    mean = np.array(got[2 : 2 + d], float) if n else np.zeros(d)
    sd = np.maximum(np.array(got[2 + d :], float), 1e-3) if n else np.ones(d)
    if n_bad in (0, n):
        return Ranker(mean, sd, np.zeros(d), 1.0 if n_bad else -1.0)
    w = fit_pairs(rows, mean, sd)

    def strengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(0).flatten().to_numpy().reshape(-1, d)
            yield pa.RecordBatch.from_arrays([pa.array(np.clip((x - mean) / sd, -8, 8) @ w)], ["s"])

    s = written(rows.select("x").mapInArrow(strengths, "s double"), "quality-strengths")
    return Ranker(mean, sd, w, (kth(s, max(n_bad - 2, 0)) + kth(s, min(n_bad, n - 1))) / 2)


def score_quality(docs: DataFrame, model: Ranker, keep: dict[str, Column], text_col: str = "text") -> DataFrame:
    """The kept columns and `score` for every row; an empty or null text is scored like any other."""
    rows = docs.select(*(c.alias(k) for k, c in keep.items()), F.col(text_col).cast("string").alias("_text"))
    schema = rows.drop("_text").schema.add("score", "double")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "_text"):
                score = model.score(features(*text_buffer(b.column(b.num_columns - 1))))
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(score)], names=[*schema.names])

    return rows.mapInArrow(of, schema)


def score_features(found: DataFrame, model: Ranker) -> DataFrame:
    """The columns of document_features(), with `score` in place of the last one, `x`."""
    schema = found.drop("x").schema.add("score", "double")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(b.num_columns - 1).flatten().to_numpy().reshape(b.num_rows, -1)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(model.score(x))], names=[*schema.names])

    return found.mapInArrow(of, schema)


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held: int = 0) -> DataFrame:
    """(id_col, held_out, score, predicted) per row; labels are learned only from ids whose crc32 leaves another remainder than `held`.

    A null id is held out. Repeated rows get equal scores; a document with two labels counts
    as the lower one.
    """
    fold = lambda c: F.crc32(c.cast("string").cast("binary")) % folds
    found = written(document_features(docs, {"_id": F.col(id_col).cast("long")}, text_col), "quality-features")
    model = train_ranker(found, labels, fold(F.col("_id")) != held, id_col)
    out = score_features(found, model).select(F.col("_id").alias("id"), "score")
    held_out = F.coalesce(fold(F.col("id")) == held, F.lit(True))
    return out.select(F.col("id").alias(id_col), held_out.alias("held_out"), "score", (F.col("score") >= PREDICT_AT).cast("int").alias("predicted"))
