"""Near-duplicate vectors by p-stable hashing for Euclidean distance, checked by exact cosine.

A vector of length 1 is projected on Gaussian directions; floor((a.x + b) / w) of `k`
directions is its bucket in one of `tables` hash tables. `k` follows the logarithm of the
number of vectors, so that a bucket has about `LOAD` unrelated ones, and `tables` is what the
wanted recall at the threshold then needs. What travels to the buckets is not the vector but
a sketch, the signs of `SIGNS` more projections; only members whose sketches are close to
another's send their vectors in a second step, where each pair is multiplied in the first
table where it meets. A bucket of any size is dealt into blocks that separate tasks compare.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import acos, ceil, erf, exp, log, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, mix, written
from .graph import components

BLOCK, LOAD, SIGNS = 2048, 512.0, 128


def collision(distance: float, width: float) -> float:
    """Chance that one quantised projection of two points at this distance is the same."""
    r = width / distance
    return erf(r / sqrt(2)) - 2 / (sqrt(2 * pi) * r) * (1 - exp(-r * r / 2))


def table_shape(n: int, cosine: float, recall: float, width: float = 2.0, load: float = LOAD) -> tuple[int, int]:
    """(k, tables): unrelated (orthogonal) vectors share a bucket with `load` others at most; a pair at the threshold is found with chance `recall`."""
    near, far = collision(sqrt(max(2 - 2 * cosine, 1e-6)), width), collision(sqrt(2), width)
    k = max(4, ceil(log(max(n, 2) / load) / -log(far)))
    return k, ceil(log(1 - recall) / log(1 - near**k))


def sign_limit(cosine: float) -> int:
    """Most differing signs of a pair at the threshold: its mean and 6.2 standard deviations, so one pair in 10^9 has more."""
    p = acos(max(-1.0, min(1.0, cosine))) / pi
    return min(SIGNS, ceil(SIGNS * p + 6.2 * sqrt(SIGNS * p * (1 - p)) + 1))


def _unit(values: np.ndarray) -> np.ndarray:
    x = values.astype(float)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _rows(col: pa.Array, a: int, b: int) -> np.ndarray:
    at = col.offsets.to_numpy()
    return col.values.to_numpy(zero_copy_only=False)[at[a] : at[b]].reshape(b - a, -1)


def _hasher(k: int, tables: int, width: float, seed: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict = {}
        for batch in batches:
            ids, vecs = batch.column(0), batch.column(1)
            sizes = np.diff(vecs.offsets.to_numpy())
            keys, signs = np.zeros((len(sizes), tables), np.uint64), np.zeros((len(sizes), SIGNS // 64), np.uint64)
            for d in np.unique(sizes).tolist():
                if d not in made:
                    rng = np.random.default_rng([seed, d])
                    made[d] = rng.standard_normal((d, tables * k)), rng.uniform(0, width, tables * k), rng.integers(1, 1 << 62, tables * k, dtype=np.uint64) | np.uint64(1), rng.standard_normal((d, SIGNS))
                directions, shift, odd, more = made[d]
                rows = np.flatnonzero(sizes == d)
                for part in np.array_split(rows, max(1, len(rows) // 1024)):
                    x = _unit(np.concatenate([_rows(vecs, i, i + 1) for i in part]))
                    cell = np.floor((x @ directions + shift) / width).astype(np.int64).astype(np.uint64)
                    with np.errstate(over="ignore"):
                        total = (cell * odd).reshape(len(part), tables, k).sum(axis=2, dtype=np.uint64)
                        keys[part] = mix(total + np.arange(tables, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(d))
                    signs[part] = np.packbits(x @ more > 0, axis=1).view(np.uint64)
            flat = pa.array(keys.view(np.int64).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, tables), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([ids, lists, *(pa.array(c.view(np.int64)) for c in np.ascontiguousarray(signs.T))], ["cls", "keys", "s0", "s1"])

    return of


def _by_bucket(run: Callable[[dict, int, int], pa.RecordBatch | None]):
    """A function of sorted batches that calls run(columns, first row, end row) for each (key, pair) with two rows or more."""

    def whole(table: pa.Table) -> Iterator[pa.RecordBatch]:
        cols = {c: table.column(c).combine_chunks() for c in table.column_names}
        cols = {c: v if pa.types.is_list(v.type) else v.to_numpy(zero_copy_only=False) for c, v in cols.items()}
        bounds = [0, *(np.flatnonzero((cols["key"][1:] != cols["key"][:-1]) | (cols["pair"][1:] != cols["pair"][:-1])) + 1).tolist(), table.num_rows]
        for a, b in zip(bounds, bounds[1:], strict=False):
            if b - a > 1 and (out := run(cols, a, b)) is not None:
                yield out

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        for batch in batches:
            kept.append(batch)
            if sum(b.num_rows for b in kept) < 8 * BLOCK:
                continue
            table = pa.Table.from_batches(kept)
            key = [table.column(c).to_numpy() for c in ("key", "pair")]
            change = np.flatnonzero(np.any([k[1:] != k[:-1] for k in key], axis=0))
            if len(change):
                yield from whole(table.slice(0, int(change[-1]) + 1))
                kept = table.slice(int(change[-1]) + 1).to_batches()
        if kept:
            yield from whole(pa.Table.from_batches(kept))

    return of


def _sides(pair: int, chunk: np.ndarray) -> tuple[bool, np.ndarray, np.ndarray]:
    """(whether the block meets itself, rows of one block, rows of the other)."""
    low, high = pair >> 32, pair & 0xFFFFFFFF
    return low == high, np.flatnonzero(chunk == low), np.flatnonzero(chunk == high)


def _close(s0: np.ndarray, s1: np.ndarray, same: bool, left: np.ndarray, right: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (a, b) of members whose sketches differ in `most` signs or fewer, some rows of the left block at a time."""
    s0, s1 = s0.view(np.uint64), s1.view(np.uint64)
    for at in range(0, len(left), 256):
        rows = left[at : at + 256]
        near = np.bitwise_count(s0[rows, None] ^ s0[right]) + np.bitwise_count(s1[rows, None] ^ s1[right]) <= most
        a, b = np.nonzero(near)
        a, b = rows[a], right[b]
        if same:
            a, b = a[a < b], b[a < b]
        if len(a):
            yield a, b


def _sketched(cosine: float):
    """Members (key, pair, chunk, cls) of buckets whose sketch is close to another's there."""
    most = sign_limit(cosine)

    def run(cols: dict, a: int, b: int) -> pa.RecordBatch | None:
        s0, s1 = cols["s0"][a:b], cols["s1"][a:b]
        hit = np.zeros(b - a, bool)
        for i, j in _close(s0, s1, *_sides(int(cols["pair"][a]), cols["chunk"][a:b]), most):
            hit[i] = hit[j] = True
        if not hit.any():
            return None
        return pa.RecordBatch.from_arrays([pa.array(cols[c][a:b][hit]) for c in ("key", "pair", "chunk", "cls")], ["key", "pair", "chunk", "cls"])

    return _by_bucket(run)


def _compared(cosine: float):
    """Rows (cls, links, u, v): link counts of a class with u and v null, or the ends of a link that joins two."""
    most = sign_limit(cosine)

    def run(cols: dict, a: int, b: int) -> pa.RecordBatch | None:
        keys, x = _rows(cols["keys"], a, b), _unit(_rows(cols["vec"], a, b))
        cls, rep, n = (cols[c][a:b] for c in ("cls", "rep", "n"))
        table = int(np.flatnonzero(keys[0] == cols["key"][a])[0])
        count, label, us, vs = np.zeros(len(cls), np.int64), np.arange(len(cls)), [], []
        for i, j in _close(cols["s0"][a:b], cols["s1"][a:b], *_sides(int(cols["pair"][a]), cols["chunk"][a:b]), most):
            for s in range(table):  # pairs that met in an earlier table were multiplied there
                new = keys[i, s] != keys[j, s]
                i, j = i[new], j[new]
            part = [np.einsum("ij,ij->i", x[i[k : k + 65536]], x[j[k : k + 65536]]) >= cosine for k in range(0, len(i), 65536)]
            link = np.concatenate(part) if part else np.zeros(0, bool)
            i, j = i[link], j[link]
            np.add.at(count, i, n[j])
            np.add.at(count, j, n[i])
            for k in np.split(np.arange(len(i)), np.flatnonzero(np.diff(i)) + 1) if len(i) else []:
                met = np.unique(label[np.append(j[k], i[k[0]])])
                if len(met) > 1:
                    us += rep[met[1:]].tolist()
                    vs += [int(rep[met[0]])] * (len(met) - 1)
                    label[np.isin(label, met)] = met[0]
        hit = count > 0
        if not hit.any():
            return None
        h, e = int(hit.sum()), len(us)
        cols_ = [[*cls[hit].tolist(), *[None] * e], [*count[hit].tolist(), *[None] * e], [*[None] * h, *us], [*[None] * h, *vs]]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols_], ["cls", "links", "u", "v"])

    return _by_bucket(run)


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = 0.95, recall: float = 0.995, width: float = 2.0, seed: int = 7, block: int = BLOCK, load: float = LOAD) -> DataFrame:
    """(id_col, n_links long, component_id long, kept boolean): one row per row of `vectors`.

    Equal vectors (by a digest of 128 bits) are one class, compared once; their members count
    each other. Vectors that are null, empty, zero or hold null or non-finite components link
    with nothing, as do vectors of other lengths and rows without an id (component and kept
    are null for those). Rows that share an id stay rows of their own and links between them
    count. No pair under the cosine is linked; the chance to find a pair at the very
    threshold is `recall`. An empty table gives an empty result; other columns, whatever
    their names, aren't looked at.
    """
    c, kind = F.col("vec"), dict(vectors.dtypes)[vec_col]
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast(kind if kind in ("array<float>", "array<double>") else "array<double>").alias("vec"))
    finite = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    fit = F.coalesce(F.col("id").isNotNull() & finite & F.exists(c, lambda x: x != 0), F.lit(False))
    rows = rows.select("id", F.when(fit, c).alias("vec")).select("id", "vec", F.when(c.isNotNull(), F.xxhash64("vec")).alias("h"), F.when(c.isNotNull(), F.xxhash64(F.lit(seed), "vec", F.lit(seed))).alias("g"))
    classes = rows.where("vec is not null").groupBy("h", "g").agg(F.min("id").alias("rep"), F.count("*").alias("n"), F.first("vec").alias("vec"))
    classes = written(classes.withColumn("cls", F.monotonically_increasing_id()), "vectors")
    k, tables = table_shape(classes.count(), cosine, recall, width, load)
    hashed = written(classes.select("cls", "vec").mapInArrow(_hasher(k, tables, width, seed), "cls long, keys array<long>, s0 long, s1 long"), "buckets")
    member = hashed.select("cls", "s0", "s1", F.explode("keys").alias("key"))
    full = written(member.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > block).select("key", F.ceil(F.col("size") / block).cast("int").alias("chunks")), "full-buckets")
    member = member.join(full, "key", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    member = member.withColumn("chunk", F.expr("pmod(xxhash64(cls, key), chunks)").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    pair = F.least("chunk", "other").cast("long") * (1 << 32) + F.greatest("chunk", "other")
    by_bucket = lambda df, *more: df.select("key", "pair", "chunk", "cls", "s0", "s1", *more).repartition("key", "pair").sortWithinPartitions("key", "pair")
    close = written(by_bucket(member.withColumn("pair", pair)).mapInArrow(_sketched(cosine), "key long, pair long, chunk int, cls long"), "close-members")
    facts = classes.select("cls", "rep", "n", "vec")
    found = cut(by_bucket(close.join(hashed, "cls").join(facts, "cls"), "keys", "rep", "n", "vec").mapInArrow(_compared(cosine), "cls long, links long, u long, v long"))
    count = found.where("cls is not null").groupBy("cls").agg(F.sum("links").alias("links"))
    comp = components(found.where("cls is null").select("u", "v"))
    linked = classes.select("h", "g", "cls", "rep", "n").join(count, "cls", "left").join(comp.withColumnRenamed("node", "rep"), "rep", "left")
    linked = linked.select("h", "g", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = rows.where("h is not null").select("id", "h", "g").join(linked, ["h", "g"]).select("id", "n_links", "component_id")
    alone = rows.where("h is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return out.unionByName(alone).select(F.col("id").alias(id_col), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
