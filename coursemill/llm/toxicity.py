"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; every other text, whatever its label, is
unlabelled. A text's features are the hashed words and word beginnings that positives hold
clearly more often than unlabelled text. Linear numpy classifiers minimise

    prior * E_P[l(z)] + max(0, E_U[l(-z)] - prior * E_P[l(-z)]),  l(z) = log(1 + exp(-z)),

the class-prior-corrected risk whose negative part is kept from falling under zero.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hash_words, slices, text_buffer, word_spans, written

#: Documents used for training at most; the features chosen; classifiers averaged.
MAX_POSITIVE, MAX_UNLABELLED, MAX_FEATURES, MODELS = 8_000, 16_000, 1_024, 3
PREDICT_AT = 0.7
#: A feature is chosen if positives hold it so many times as often as unlabelled text does, times the prior: 1 is what a feature of toxic text alone reaches.
LIFT = 0.4
BITS = 18
#: Bytes of the word beginnings that are features beside whole words.
PREFIXES = (4, 5, 6, 8)


def _keys(data: np.ndarray, offsets: np.ndarray, chosen: np.ndarray | None = None) -> np.ndarray:
    """Sorted distinct (document << 32 | feature) of a batch. chosen: feature number per bucket, -1 for buckets left out."""
    out = []
    for m, s, t, doc, _ in word_spans(data, offsets):
        doc = doc.astype(np.int64)
        for k in (0, *PREFIXES):
            long = slice(None) if not k else np.flatnonzero(t - s > k)
            h = hash_words(m, s[long], t[long] if not k else s[long] + k)
            f = ((h ^ np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) >> np.uint64(64 - BITS)).astype(np.int64)
            d = doc[long]
            if chosen is not None:
                f = chosen[f]
                hit = f >= 0
                f, d = f[hit], d[hit]
            out.append(np.unique(d << 32 | f))
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.int64)


@dataclass(frozen=True)
class Scorer:
    chosen: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        keys = _keys(data, offsets, self.chosen)
        z = self.bias + np.bincount(keys >> 32, weights=self.weights[keys & 0xFFFFFFFF], minlength=len(offsets) - 1)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def nn_risk(z: np.ndarray, positive: np.ndarray, prior: float) -> tuple[float, np.ndarray]:
    """(the unlabelled texts' part of the risk, what a step descends by z): the whole risk's derivative, or, where that part is under zero, the derivative that leads it back up."""
    p, u = positive, ~positive
    s, g = 1 / (1 + np.exp(-np.clip(z, -30, 30))), np.zeros(len(z))
    negative = np.logaddexp(0, z[u]).mean() - prior * np.logaddexp(0, z[p]).mean()
    if negative >= 0:
        g[p] = prior * (s[p] - 1) / p.sum() - prior * s[p] / p.sum()
        g[u] = s[u] / u.sum()
    else:
        g[p] = prior * s[p] / p.sum()
        g[u] = -s[u] / u.sum()
    return negative, g


def fit_nnpu(rows: np.ndarray, cols: np.ndarray, positive: np.ndarray, n_features: int, prior: float, rounds: int = 400, rate: float = 0.05, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias from sparse 0/1 features; positive marks the confirmed rows, the rest are unlabelled."""
    n = len(positive)
    w, b = np.zeros(n_features), np.log(prior / (1 - prior))
    m, v = np.zeros(n_features + 1), np.zeros(n_features + 1)
    for i in range(1, rounds + 1):
        _, g = nn_risk(b + np.bincount(rows, weights=w[cols], minlength=n), positive, prior)
        grad = np.append(np.bincount(cols, weights=g[rows], minlength=n_features) + decay * w, g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        step = rate * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def _sample_keys(rows: DataFrame) -> DataFrame:
    """rows(_id, _p, _text) -> (_id, _p, features array<int>)."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "_text"):
                keys = _keys(*text_buffer(b.column(2)))
                at = np.searchsorted(keys >> 32, np.arange(b.num_rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(pa.array(at), pa.array((keys & 0xFFFFFFFF).astype(np.int32)))], ["_id", "_p", "features"])

    return rows.mapInArrow(of, "_id long, _p boolean, features array<int>")


def feature_counts(docs: DataFrame, features: list[int]) -> dict[int, int]:
    """Documents of docs(_text) that hold each feature; each task sends one row per feature at most."""
    chosen = np.full(1 << BITS, -1)
    chosen[features] = np.arange(len(features))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(features), np.int64)
        for batch in batches:
            for b in slices(batch, "_text"):
                total += np.bincount(_keys(*text_buffer(b.column(0)), chosen) & 0xFFFFFFFF, minlength=len(features))
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(total[hit])], ["k", "n"])

    return {features[r["k"]]: r["n"] for r in docs.select("_text").mapInArrow(of, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()}


def _only(chosen: np.ndarray):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = [sorted(x for x in chosen[np.asarray(f, np.int64)].tolist() if x >= 0) if f else [] for f in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lists, pa.list_(pa.int32()))], ["_id", "_p", "features"])

    return of


def train_scorer(docs: DataFrame, labels: DataFrame, trainable: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", seed: int = 3) -> Scorer:
    """Fit on documents where `trainable` (of column _id) holds: MAX_POSITIVE positives at most and about MAX_UNLABELLED others by a hash of the id.

    How often unlabelled text holds a feature is counted over all trainable documents. The
    prior is the positives' share of the labelled trainable documents. Without a positive
    every score is the prior, or nearly 0 where nothing is labelled. Of sampled rows that
    share an id the smallest features count, so a much repeated id doesn't outweigh the others.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("_id")).agg(F.max(label_col).cast("int").alias("_y")).where(trainable)
    n = {r["_y"]: r["count"] for r in known.groupBy("_y").count().collect()}
    prior = min(max(n.get(1, 0) / max(sum(n.values()), 1), 1e-3), 0.5)
    nothing = Scorer(np.full(1 << BITS, -1), np.zeros(1), float(np.log(prior / (1 - prior))))
    if not n.get(1):
        return nothing
    lot = F.pmod(F.xxhash64("_id", F.lit(seed)), F.lit(1_000_003)) / 1_000_003
    all_docs = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text")).where(trainable)
    n_docs = all_docs.count()
    few = all_docs.where(lot < MAX_UNLABELLED / max(n_docs, 1)).select("_id", F.lit(False).alias("_p"), "_text")
    # At most MAX_POSITIVE ids go to every task, so texts are picked where they are read.
    toxic = known.where("_y = 1").orderBy(lot, "_id").limit(MAX_POSITIVE).select("_id")
    toxic = all_docs.join(F.broadcast(toxic), "_id", "left_semi").select("_id", F.lit(True).alias("_p"), "_text")
    rows = written(_sample_keys(toxic.unionByName(few)).groupBy("_id", "_p").agg(F.min("features").alias("features")), "toxicity-sample")
    total = {r["_p"]: r["count"] for r in rows.groupBy("_p").count().collect()}
    if not total.get(True) or not total.get(False):
        return nothing
    least = max(2, total[True] // 400)
    each = rows.select("_p", F.explode("features").alias("f")).groupBy("f").agg(F.count_if("_p").alias("p"), F.count_if(~F.col("_p")).alias("u")).where(F.col("p") >= least)
    # Of 2^BITS features at most. Those that the sample shows to be too frequent, by six standard deviations, aren't counted any further.
    need, held = max(2, LIFT / prior), {}
    for r in each.collect():
        most = total[False] * r["p"] / total[True] / need
        if r["u"] <= most + 6 * np.sqrt(most) + 6:
            held[r["f"]] = r["p"]
    spread = feature_counts(all_docs, sorted(held)) if held else {}
    found = []
    for f, p in held.items():
        lift = (p + 0.5) / (total[True] + 1) / ((spread.get(f, 0) + 0.5) / (n_docs + 1))
        if lift > need:
            found.append((-p * np.log(lift), f))
    features = sorted(f for _, f in sorted(found)[:MAX_FEATURES])
    if not features:
        return nothing
    chosen = np.full(1 << BITS, -1)
    chosen[features] = np.arange(len(features))
    got = rows.mapInArrow(_only(chosen), "_id long, _p boolean, features array<int>").toArrow().sort_by([("_id", "ascending"), ("_p", "ascending")])
    lists, positive = got["features"].combine_chunks(), got["_p"].to_numpy(zero_copy_only=False)
    at, cols = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy().astype(np.int64)
    rng = np.random.default_rng(seed)
    fits = []
    for _ in range(MODELS):
        keep = rng.random(len(lists)) < 0.8
        if not positive[keep].any() or positive[keep].all():
            keep[:] = True
        number = np.cumsum(keep) - 1
        hit = keep[at]
        fits.append(fit_nnpu(number[at[hit]], cols[hit], positive[keep], len(features), prior))
    return Scorer(chosen, np.mean([w for w, _ in fits], axis=0), float(np.mean([b for _, b in fits])))


def score_toxicity(docs: DataFrame, model: Scorer, keep: dict[str, Column], text_col: str = "text") -> DataFrame:
    """The kept columns and `score` for every row; an empty or null text gets the score of no feature."""
    rows = docs.select(*(c.alias(k) for k, c in keep.items()), F.col(text_col).cast("string").alias("_text"))
    schema = rows.drop("_text").schema.add("score", "double")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "_text"):
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(model.score(*text_buffer(b.column(b.num_columns - 1))))], names=[*schema.names])

    return rows.mapInArrow(of, schema)


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 3, held: int = 1) -> DataFrame:
    """(id_col, held_out, score, predicted) per row; neither labels nor unlabelled text of ids whose crc32 leaves the remainder `held` are learned from.

    A null id is held out. Repeated rows get equal scores; a document with two labels counts
    as toxic.
    """
    fold = lambda c: F.crc32(c.cast("string").cast("binary")) % folds
    model = train_scorer(docs, labels, fold(F.col("_id")) != held, id_col, text_col)
    out = score_toxicity(docs, model, {"id": F.col(id_col).cast("long")}, text_col)
    held_out = F.coalesce(fold(F.col("id")) == held, F.lit(True))
    return out.select(F.col("id").alias(id_col), held_out.alias("held_out"), "score", (F.col("score") >= PREDICT_AT).cast("int").alias("predicted"))
