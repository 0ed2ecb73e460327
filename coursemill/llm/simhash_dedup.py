"""SimHash near-duplicates with the generalised pigeonhole principle.

The 64 fingerprint bits are dealt into partitions of correlated bits. Partition i gets a
threshold t_i >= -1 with sum(t_i + 1) = limit + 1: two fingerprints that differ in at most
`limit` bits then differ in at most t_i bits of some partition i. A dynamic programme picks
the thresholds with the least estimated cost; -1 leaves a partition out. Fingerprints meet
in the buckets of equal masked partition values and are verified on all 64 bits there.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, plain, text_list, written
from .graph import components

BITS = 64
SEED = 42
#: Fingerprints that one task compares in a bucket; larger buckets are dealt again by the bits that are still free.
BUCKET = 1 << 14


def shingle_hashes(text: str, words: int = 3) -> np.ndarray:
    """XXH64 of each run of words (ASCII capitals lowered), or of all words if they are fewer."""
    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    line, digest = b" ".join(parts), xxhash.xxh64_intdigest
    if len(parts) <= words:
        return np.array([digest(line, SEED)], np.uint64)
    ends = np.fromiter(map(len, parts), np.int64, len(parts)).cumsum() + np.arange(len(parts))
    starts = np.concatenate([[0], ends[:-1] + 1])
    view = memoryview(line)
    return np.array([digest(view[a:b], SEED) for a, b in zip(starts[: 1 - words].tolist(), ends[words - 1 :].tolist(), strict=True)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half the hashes; 0 if there are none."""
    total = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = np.ascontiguousarray(hashes[at : at + (1 << 15)].astype("<u8"))
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    bits = np.packbits(total * 2 > len(hashes), bitorder="little")
    return int.from_bytes(bits.tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(id, fp): the fingerprint of each whole text, as a signed long; null or blank texts get 0."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([majority(shingle_hashes(t, words)) for t in text_list(b.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(fps)], ["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(of, "id long, fp long")


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, share of ones per bit, correlation of each two bits), over all rows; what reaches the driver is 64 x 64 sums."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, both = 0, np.zeros((BITS, BITS))
        for b in batches:
            x = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint8).reshape(-1, 8)
            x = np.unpackbits(x, axis=1, bitorder="little").astype(np.float32)
            n += len(x)
            both += x.T @ x
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS * BITS + 1, dtype=np.int32)), pa.array(np.concatenate([both.ravel(), [n]]).astype(np.int64))], ["k", "v"])

    got = {r.k: r.v for r in fps.select("fp").mapInArrow(of, "k int, v long").groupBy("k").agg(F.sum("v").alias("v")).collect()}
    n = got.get(BITS * BITS, 0)
    both = np.array([got.get(k, 0) for k in range(BITS * BITS)], float).reshape(BITS, BITS) / max(n, 1)
    p = both.diagonal().copy()
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    return n, p, (both - np.outer(p, p)) / np.outer(sd, sd)


def correlated_parts(corr: np.ndarray, m: int) -> list[list[int]]:
    """Deal the bits into m parts: each starts with the most correlated free pair and takes the bit closest to it until it is full."""
    free, c, out = set(range(len(corr))), np.abs(corr), []
    for i in range(m):
        size = -(-len(free) // (m - i))
        bits = sorted(free)
        pair = max(combinations(bits, 2), key=lambda x: (c[x], -x[0], -x[1])) if size > 1 else (bits[0],)
        part = list(pair)
        free -= set(pair)
        while len(part) < size:
            b = max(sorted(free), key=lambda x: c[x, part].sum())
            part.append(b)
            free.remove(b)
        out.append(sorted(part))
    return out


def allocate(parts: list[list[int]], p: np.ndarray, n: int, limit: int) -> tuple[float, list[int]]:
    """The dynamic programme: (estimated cost, thresholds). Cost: bucket rows, and candidate pairs under the bits' own shares."""
    cost = []
    for bits in parts:
        dist = np.array([1.0])
        for b in bits:
            q = 2 * p[b] * (1 - p[b])
            dist = np.convolve(dist, [1 - q, q])
        pairs = n * max(n - 1, 0) / 2
        cost.append([0.0] + [n * comb(len(bits), e) + 0.1 * pairs * dist[: e + 1].sum() * comb(len(bits), e) for e in range(limit + 1) if e <= len(bits)])
    best = {0: (0.0, [])}
    for c in cost:
        after: dict = {}
        for spent, (total, ts) in best.items():
            for e in range(len(c)):
                if spent + e <= limit + 1:
                    new = (total + c[e], [*ts, e - 1])
                    if spent + e not in after or new < after[spent + e]:
                        after[spent + e] = new
        best = after
    return best[limit + 1]


@dataclass(frozen=True)
class Plan:
    """Masks whose equality makes a bucket: (masked bits of a partition, as a 64-bit mask)."""

    parts: tuple
    thresholds: tuple

    def masks(self) -> list[int]:
        out = []
        for bits, t in zip(self.parts, self.thresholds, strict=True):
            if t >= 0:
                out += [sum(1 << b for b in bits if b not in gone) for gone in combinations(bits, min(t, len(bits)))]
        return out


def make_plan(fps: DataFrame, limit: int = 2, most_parts: int = 4) -> Plan:
    n, p, corr = bit_statistics(fps)
    found = []
    for m in range(2, most_parts + 1):
        parts = correlated_parts(corr, m)
        cost, ts = allocate(parts, p, n, limit)
        found.append((cost, m, parts, ts))
    _, _, parts, ts = min(found)
    return Plan(tuple(map(tuple, parts)), tuple(ts))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _forest(fp: np.ndarray, rep: np.ndarray, limit: int) -> tuple[list, list]:
    """Links that join the bucket's members as their distances do, one fewer than members at most."""
    us, vs, left = [], [], np.arange(len(fp))
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            i = queue.pop()
            near = np.bitwise_count(fp[left] ^ fp[i]) <= limit
            if near.any():
                found = left[near]
                us += rep[found].tolist()
                vs += [int(rep[i])] * len(found)
                queue += found.tolist()
                left = left[~near]
    return us, vs


def links(fps: DataFrame, plan: Plan, limit: int = 2, bucket: int = BUCKET) -> DataFrame:
    """(u, v) over representatives `rep` of distinct fingerprints: what they connect is what all pairs within `limit` bits connect.

    A bucket of more than `bucket` fingerprints is dealt once more: the bits that its mask
    leaves free are cut into limit + 1 parts, of which two members within the limit share
    one. That is repeated until no bucket is too large for a task.
    """
    spark, masks = fps.sparkSession, plan.masks()
    keys = fps.select("fp", "rep", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks])).alias("mask", "val"))
    cold = None
    while True:
        # Distinct fingerprints that agree in all but `limit` bits are 1 << limit at most, so larger buckets have a bit for each part.
        hot = written(keys.groupBy("mask", "val").agg(F.count("*").alias("n")).where(F.col("n") > max(bucket, 1 << limit)).select("mask", "val"), "hot-buckets")
        wide = sorted(r["mask"] for r in hot.select("mask").distinct().collect())
        part = keys.join(hot, ["mask", "val"], "left_anti") if wide else keys
        cold = part if cold is None else cold.unionByName(part)
        if not wide:
            break
        finer = []
        for i in wide:
            free = [b for b in range(BITS) if not masks[i] >> b & 1]
            for k in range(limit + 1):
                finer.append((i, len(masks), _signed(masks[i] | sum(1 << b for b in free[k :: limit + 1]))))
                masks.append(finer[-1][2] & ((1 << BITS) - 1))
        finer = spark.createDataFrame(finer, "mask int, finer int, bits long")
        keys = keys.join(hot, ["mask", "val"], "left_semi").join(finer, "mask").select("fp", "rep", F.col("finer").alias("mask"), F.col("fp").bitwiseAND(F.col("bits")).alias("val"))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list = []
        for b in batches:
            x = [np.concatenate([k, c.to_numpy(zero_copy_only=False)]) if kept else c.to_numpy(zero_copy_only=False) for k, c in zip(kept or [None] * 4, b.columns, strict=True)]
            kept = []
            new = np.flatnonzero((x[0][1:] != x[0][:-1]) | (x[1][1:] != x[1][:-1])) + 1
            last = int(new[-1]) if len(new) else 0  # the last bucket may go on in the next batch
            yield _bucket_links(x[2][:last], x[3][:last], new, limit)
            kept = [c[last:] for c in x]
        if kept:
            yield _bucket_links(kept[2], kept[3], np.array([len(kept[2])]), limit)

    return cold.select("mask", "val", "fp", "rep").repartition("mask", "val").sortWithinPartitions("mask", "val").mapInArrow(of, "u long, v long")


def _bucket_links(fp: np.ndarray, rep: np.ndarray, bounds: np.ndarray, limit: int) -> pa.RecordBatch:
    us: list = []
    vs: list = []
    fp, starts = fp.astype(np.int64).view(np.uint64), np.concatenate([[0], bounds[:-1]]) if len(bounds) else bounds
    sizes = bounds - starts
    two = starts[sizes == 2]
    near = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= limit] if len(two) else two
    us += rep[near].tolist()
    vs += rep[near + 1].tolist()
    for a, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
        u, v = _forest(fp[a : a + n], rep[a : a + n], limit)
        us += u
        vs += v
    return pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 2, words: int = 3, bucket: int = BUCKET) -> DataFrame:
    """(id_col, fp long, fingerprint string, component_id): one row per document row.

    Null and blank texts have fingerprint 0 and link like any other. A row without an id
    keeps its fingerprint, links nothing, and gets the component of its fingerprint's
    smallest id, null if there is none. Rows that share an id are one document. An empty
    table gives an empty result; other columns, whatever their names, are not looked at.
    """
    each = cut(fingerprints(docs, id_col, text_col, words))
    distinct = cut(each.where("id is not null").groupBy("fp").agg(F.min("id").alias("rep")))
    found = components(links(distinct, make_plan(distinct, limit), limit, bucket))
    of_fp = distinct.join(found, distinct["rep"] == found["node"], "left").select(F.col("fp"), F.coalesce("component", "rep").alias("component_id"))
    return each.join(of_fp, "fp", "left").select(F.col("id").alias(id_col), "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 2, words: int = 3, bucket: int = BUCKET) -> DataFrame:
    """docs with one row for each component: the row of its smallest id. All columns stay, whatever their names.

    Rows that share an id are one document, of which the row with the smallest JSON stays.
    Rows without an id stay where no row with an id has their fingerprint, one for each such
    fingerprint. Null and blank texts are one component. The ids that go are written before
    texts are read, so Spark knows their size and doesn't shuffle texts for few of them.
    """
    rows, names = plain(docs)
    at = docs.columns.index(id_col), docs.columns.index(text_col)
    key = F.col(names[at[0]]).cast("long")
    found = written(simhash_components(docs, id_col, text_col, limit, words, bucket).toDF("_id", "_fp", "_fingerprint", "_component").drop("_fingerprint"), "components")
    twice = found.where("_id = _component").groupBy("_id").agg(F.count("*").alias("n")).where("n > 1").select("_id")
    twice = written(twice, "repeated-ids")
    gone = written(found.where("_id <> _component").select("_id").distinct().unionByName(twice), "dropped-ids")
    every = F.struct(*names)
    least = lambda df, by: df.groupBy(by).agg(F.min_by(every, F.to_json(every)).alias("r")).select("r.*")
    out = rows.where(key.isNotNull()).join(gone, key == F.col("_id"), "left_anti")
    if twice.limit(1).count():
        out = out.unionByName(least(rows.join(twice, key == F.col("_id"), "left_semi"), key))
    if found.where("_id is null").limit(1).count():
        free = found.where("_id is null and _component is null").select("_fp").distinct()
        nulls = rows.where(key.isNull())
        schema = T.StructType([*nulls.schema, T.StructField("_own", T.LongType())])

        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                fps = np.array([majority(shingle_hashes(t, words)) for t in text_list(b.column(at[1]).cast(pa.string()))], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fps)], names=[*schema.names])

        nulls = nulls.mapInArrow(of, schema)
        out = out.unionByName(least(nulls.join(free, F.col("_own") == F.col("_fp"), "left_semi"), "_own"))
    return out.toDF(*docs.columns)
