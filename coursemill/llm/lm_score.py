"""Log-likelihood of whole documents under a gated recurrent language model that is trained here.

Words are counted over all training documents. The most frequent ones (HOT at most, seen twice
or more) go to every task; what depends on the count of a rarer word is joined by the word's
hash. The network is trained on every training document in ROUNDS: each task learns from its
documents of the round, starting at the model of the round before, and the tasks' models are
averaged by their tokens. Words are told apart by 64-bit hashes.

A probability is over the words seen in training, the end, and one outcome that stands for
every unseen word: P(class | state) P(word | class, state) for the head's words; by count
within a band of frequency, beyond the head; and by discounted count among rare words, with
what the discount takes (as much as words seen once suggest) for unseen ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import gru
from .common import hash_words, slices, text_buffer, word_spans, written

#: Most words that go to every task, 12 bytes each.
HOT = 1 << 18
#: Shares of the training documents that rounds take, of 16.
ROUNDS = ((0, 1), (1, 2), (2, 4), (4, 8), (8, 16))
#: Tokens that are laid out in streams at a time, and parameters in a row of an average.
POOL, BLOCK = 1_500_000, 4096
#: Stands for the end of a document among the words' hashes.
END = -1
SHAPE = gru.Shape()


def _lower_bytes() -> np.ndarray:
    """Each byte with A-Z lower-cased, 0 for white space, and 255 (in no text) for the byte 0."""
    out = np.arange(256, dtype=np.uint8)
    out[65:91] += 32
    out[[32, *range(9, 14)]] = 0
    out[0] = 255
    return out


LOWER_BYTES = _lower_bytes()


def hashed(batch: pa.RecordBatch, column: str = "_text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(slice, signed hash of each word, its row in the slice), a few MB of text at a time."""
    for b in slices(batch, column):
        data, offsets = text_buffer(b.column(b.schema.get_field_index(column)))
        got = [(hash_words(m, s, e), d) for m, s, e, d, _ in word_spans(data, offsets, LOWER_BYTES)]
        h = np.concatenate([x for x, _ in got]) if got else np.zeros(0, np.uint64)
        yield b, h.view(np.int64), np.concatenate([d for _, d in got]).astype(np.int32) if got else np.zeros(0, np.int32)


def _summed(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(h, kind="stable")
    h, n = h[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    return h[first], np.add.reduceat(n, first) if len(h) else n


def count_words(docs: DataFrame, most: int = 1 << 20) -> DataFrame:
    """(h, n): every word of docs(_text) and the end, which each row has once. Tasks sum before they send, `most` words at a time."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, n, rows = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        for batch in batches:
            rows += batch.num_rows
            for _, x, _ in hashed(batch):
                h, n = _summed(np.concatenate([h, x]), np.concatenate([n, np.ones(len(x), np.int64)]))
                if len(h) > most:
                    yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(n)], ["h", "n"])
                    h, n = h[:0], n[:0]
        h, n = np.append(h, END), np.append(n, rows)
        yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(n)], ["h", "n"])

    return docs.select("_text").mapInArrow(of, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 0")


@dataclass
class Lexicon:
    """Frequent words by hash, and what corpus counts say of a token. total, distinct: N and V; once, twice: how many words were seen so often."""

    hashes: np.ndarray
    counts: np.ndarray
    ends: int
    total: int
    distinct: int
    once: int
    twice: int
    shape: gru.Shape = SHAPE
    starts: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        by_count = np.lexsort((self.hashes, -self.counts))
        rank = np.empty(len(by_count), np.int64)
        rank[by_count] = np.arange(1, len(by_count) + 1)  # 0 is the end
        order = np.argsort(self.hashes.view(np.uint64), kind="stable")
        self.hashes, self.counts, rank = self.hashes[order], self.counts[order], rank[order]
        self.starts = np.searchsorted(self.hashes.view(np.uint64), np.arange(1 << 20, dtype=np.uint64) << np.uint64(44)).astype(np.int32)
        self.starts = np.append(self.starts, np.int32(len(self.hashes)))
        head, rare = self.shape.head, self.shape.head + self.shape.tails - 1
        band = np.minimum(np.log2(np.maximum(rank, head) / head).astype(np.int64), self.shape.tails - 2)
        self.target = np.append(np.where(rank < head, rank, head + band), rare).astype(np.int16)  # the last row is that of rare words
        mass = np.bincount(self.target[:-1], self.counts, rare + 1)
        self.rare_tokens = self.total - self.ends - int(self.counts.sum())
        self.rare_words = self.distinct - (self.ends > 0) - len(self.counts)
        self.discount = (self.once + 0.5) / (self.once + 2 * self.twice + 1)
        self.unseen = self.discount * self.rare_words / self.rare_tokens if self.rare_tokens else 1.0
        self.norm = np.log10(self.total + 0.5 * (self.distinct + 1))
        self.base = np.append(np.log10(self.counts + 0.5) - self.norm, 0.0)
        self.within = np.append(np.where(rank < head, 0.0, np.log10(self.counts / np.maximum(mass[self.target[:-1]], 1))), 0.0)
        words = np.zeros(head)
        words[0] = self.ends
        words[self.target[:-1][rank < head]] = self.counts[rank < head]
        mass[rare] = max(self.rare_tokens, 1)
        classes = np.concatenate([words.reshape(self.shape.heads, -1).sum(1), mass[head:]])
        self.initial = gru.initial(self.shape, classes, words)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Row of each word's hash, and the last row (of rare words) where it isn't among the frequent ones."""
        slot = (h.view(np.uint64) >> np.uint64(44)).astype(np.int32)
        at, end, out = self.starts[slot], self.starts[slot + 1], np.full(len(h), len(self.hashes), np.int32)
        todo = np.flatnonzero(at < end)
        while len(todo):
            k = at[todo]
            hit = self.hashes[k] == h[todo]
            out[todo[hit]] = k[hit]
            todo = todo[~hit]
            at[todo] += 1
            todo = todo[at[todo] < end[todo]]
        return out

    def laid_out(self, h: np.ndarray, rows: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(inputs, targets, offsets) of n documents with their ends: a token's input is the word before it, and the end before the first."""
        head = self.shape.head
        offsets = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=n) + 1)])
        at = np.arange(len(doc)) + doc
        targets = np.zeros(offsets[-1], np.int16)
        targets[at] = self.target[rows]
        seen = np.zeros(offsets[-1], np.int16)
        known = self.target[rows]
        seen[at] = np.where(known < head, known, head + (h.view(np.uint64) % np.uint64(self.shape.buckets)).astype(np.int16))
        inputs = np.empty_like(seen)
        inputs[1:] = seen[:-1]
        inputs[:1] = 0
        return inputs, targets, offsets


def learn_lexicon(counts: DataFrame, hot: int = HOT) -> Lexicon:
    """The `hot` most frequent words that were seen twice or more, and totals of a table of count_words()."""
    word = F.col("h") != END
    t = counts.agg(F.sum("n").alias("total"), F.count("*").alias("distinct"), F.count_if(word & (F.col("n") == 1)).alias("once"), F.count_if(word & (F.col("n") == 2)).alias("twice"), F.max(F.when(~word, F.col("n"))).alias("ends")).first()
    top = counts.where(word & (F.col("n") > 1)).orderBy(F.desc("n"), "h").limit(hot).toArrow()
    return Lexicon(top["h"].to_numpy().copy(), top["n"].to_numpy().copy(), t["ends"] or 0, t["total"] or 0, t["distinct"], t["once"], t["twice"])


def _pools(lexicon: Lexicon, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[pa.RecordBatch], np.ndarray, np.ndarray, np.ndarray]]:
    """(slices, hashes, rows of the lexicon, documents) with POOL tokens or a little more, so that long documents run beside many others."""
    parts, tokens = [], 0
    for batch in batches:
        for b, h, doc in hashed(batch):
            parts.append((b.drop_columns(["_text"]), h, lexicon.find(h), doc))
            tokens += len(h) + b.num_rows
            if tokens >= POOL:
                yield _joined(parts)
                parts, tokens = [], 0
    if parts:
        yield _joined(parts)


def _joined(parts: list) -> tuple:
    first = np.cumsum([0, *(b.num_rows for b, *_ in parts)])
    return [b for b, *_ in parts], np.concatenate([h for _, h, _, _ in parts]), np.concatenate([r for _, _, r, _ in parts]), np.concatenate([d + np.int32(f) for (*_, d), f in zip(parts, first, strict=False)])


def train(docs: DataFrame, lexicon: Lexicon, part: Column, rounds: tuple = ROUNDS, sent: Broadcast | None = None) -> np.ndarray:
    """Parameters after one pass over docs(_text, and `part`, 0 to 15): rounds of local training, averaged by tokens in two steps of grouping."""
    sent, size = sent or docs.sparkSession.sparkContext.broadcast(lexicon), lexicon.shape.size()
    flat, seen = lexicon.initial, np.full(size, 1e-8, np.float32)
    schema = "block int, part int, weight double, data array<double>"
    for low, high in rounds:

        def of(batches: Iterator[pa.RecordBatch], flat=flat, seen=seen) -> Iterator[pa.RecordBatch]:
            lexicon = sent.value
            t = gru.Trainer(lexicon.shape, flat, seen)
            for parts, h, rows, doc in _pools(lexicon, ((b.append_column("_row", pa.array(np.zeros(b.num_rows, bool)))) for b in batches)):
                t.learn(*lexicon.laid_out(h, rows, doc, sum(b.num_rows for b in parts)))
            if t.tokens:
                both = np.concatenate([t.flat, t.seen]).astype(np.float64)
                cuts = [both[i : i + BLOCK] for i in range(0, len(both), BLOCK)]
                n = len(cuts)
                yield pa.RecordBatch.from_arrays([pa.array(range(n), pa.int32()), pa.array([TaskContext.get().partitionId()] * n, pa.int32()), pa.array([float(t.tokens)] * n), pa.array([x.tolist() for x in cuts], pa.list_(pa.float64()))], ["block", "part", "weight", "data"])

        made = docs.where((part >= low) & (part < high)).select("_text").mapInArrow(of, schema)
        parts = _averaged(made.withColumn("part", F.col("part") % 64).groupBy("block", "part"), schema)
        got = {r["block"]: r["data"] for r in _averaged(parts.groupBy("block"), schema).select("block", "data").collect()}
        if got:
            both = np.concatenate([np.asarray(got[b]) for b in sorted(got)])
            flat, seen = both[:size].astype(np.float32), both[size:].astype(np.float32)
    return flat


def _averaged(groups, schema: str) -> DataFrame:
    """Weighted mean of equal blocks; a group has a block of one in 64 tasks, then 64 blocks at most."""

    def mean(t: pa.Table) -> pa.Table:
        w = t["weight"].to_numpy()
        data = t["data"].combine_chunks()
        both = data.flatten().to_numpy().reshape(len(w), -1)
        return pa.table({"block": t["block"][:1], "part": pa.array([t["part"][0].as_py() % 64], pa.int32()), "weight": [float(w.sum())], "data": pa.array([(w @ both / w.sum()).tolist()], pa.list_(pa.float64()))})

    return groups.applyInArrow(mean, schema)


SCORED = "uid long, n_tokens long, n_known long, base_score double, score double, rare array<long>, times array<int>"


def score_documents(docs: DataFrame, keep: dict[str, Column], lexicon: Lexicon, flat: np.ndarray, counts: DataFrame, text: Column, sent: Broadcast | None = None) -> DataFrame:
    """The kept columns, n_tokens, n_known, base_score and score of every row; logs are decimal, and a null text is empty.

    Frequent words are scored where the text is read. Rare ones leave it as (row, hash, times)
    and meet their counts in a join; none of them is frequent, so no key is hot but where
    one unseen word repeats in many rows, which a skew join splits.
    """
    rows = docs.select(*(c.alias(k) for k, c in keep.items()), F.coalesce(text.cast("string"), F.lit("")).alias("_text"))
    schema = StructType(rows.drop("_text").schema.fields + StructType.fromDDL(SCORED).fields)
    sent = sent or docs.sparkSession.sparkContext.broadcast(lexicon)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, uid = sent.value, TaskContext.get().partitionId() << 40
        for parts, h, at, doc in _pools(lexicon, batches):
            n = sum(b.num_rows for b in parts)
            inputs, targets, offsets = lexicon.laid_out(h, at, doc, n)
            score = gru.score(lexicon.shape, flat, inputs, targets, offsets) / np.log(10) + np.bincount(doc, lexicon.within[at], n)
            rare = at == len(lexicon.hashes)
            known, tokens = np.bincount(doc, ~rare, n).astype(np.int64), np.bincount(doc, minlength=n) + 1
            base = np.bincount(doc, lexicon.base[at], n) + np.log10(lexicon.ends + 0.5) - lexicon.norm
            order = np.lexsort((h[rare], doc[rare]))
            d, x = doc[rare][order], h[rare][order]
            first = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (x[1:] != x[:-1])])) if len(d) else np.zeros(0, np.int64)
            times = np.diff(np.append(first, len(d)))
            edges = np.searchsorted(d[first], np.arange(n + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(edges), pa.array(v)) for v in (x[first], times.astype(np.int32))]
            kept = pa.Table.from_batches(parts).combine_chunks()
            cols = [c.combine_chunks() if c.num_chunks != 1 else c.chunk(0) for c in kept.columns]
            known += lexicon.ends > 0
            all_cols = [*cols, pa.array(np.arange(uid, uid + n)), pa.array(tokens.astype(np.int64)), pa.array(known), pa.array(base), pa.array(score), *lists]
            uid += n
            step = 4096
            whole = pa.RecordBatch.from_arrays(all_cols, names=schema.names)
            yield from (whole.slice(i, step) for i in range(0, n, step))

    scored = written(rows.mapInArrow(of, schema), "lm-scored")
    c = F.col("n")
    base = F.log10(F.coalesce(c, F.lit(0)) + 0.5) - float(lexicon.norm)
    rare = F.when(c > 0, F.log10((c - lexicon.discount) / max(lexicon.rare_tokens, 1))).otherwise(float(np.log10(max(lexicon.unseen, 1e-12))))
    found = scored.select("uid", F.inline(F.arrays_zip("rare", "times"))).join(counts.select(F.col("h").alias("rare"), "n"), "rare", "left")
    sums = found.groupBy("uid").agg(F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("_known"), F.sum(F.col("times") * base).alias("_base"), F.sum(F.col("times") * rare).alias("_score"))
    more = lambda a, b: (F.col(a) + F.coalesce(F.col(b), F.lit(0))).alias(a)
    return scored.drop("rare", "times").join(sums, "uid", "left").select(*keep, "n_tokens", more("n_known", "_known"), more("base_score", "_base"), more("score", "_score"))


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held: int = 1, hot: int = HOT) -> DataFrame:
    """(id_col, held_out, n_tokens, n_known, train_tokens, base_score, score) per row, learned from ids whose crc32 doesn't leave the remainder `held`.

    A null text is empty: its only token is the end. A null id is held out. Repeated rows are
    counted and scored each. Without training documents every word is unseen. Columns beside
    the two named ones aren't read, so their names can't clash.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    held_out = F.coalesce(F.crc32(F.col("_id").cast("string").cast("binary")) % folds == held, F.lit(True))
    training = rows.where(~held_out)
    counts = written(count_words(training), "lm-counts")
    lexicon = learn_lexicon(counts, hot)
    sent = docs.sparkSession.sparkContext.broadcast(lexicon)  # once for all rounds, a few MB
    flat = train(training, lexicon, F.pmod(F.xxhash64("_id", F.lit(17)), F.lit(ROUNDS[-1][1])), sent=sent)
    out = score_documents(rows, {"_id": F.col("_id"), "_held": held_out}, lexicon, flat, counts, F.col("_text"), sent)
    sent.unpersist()
    return out.select(F.col("_id").alias(id_col), F.col("_held").alias("held_out"), "n_tokens", "n_known", F.lit(lexicon.total).cast("long").alias("train_tokens"), "base_score", "score")
