"""Vectors: pooling, cosine and exact top-k search in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Queries that are held at a time while all vectors pass by, and those and the vectors that are multiplied at once.
QUERY_BLOCK, QUERY_PIECE, VECTOR_PIECE = 16_384, 256, 1024
#: Documents of a course that a task multiplies with as many others, about.
COURSE_BLOCK = 1024


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of unit vectors in [-1, 1]; 0 where one is missing or empty or the lengths differ."""
    fit = F.coalesce((F.size(a) == F.size(b)) & (F.size(a) > 0), F.lit(False))
    return F.when(fit, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b)))).otherwise(F.lit(0.0))


def normalised(v: Column) -> Column:
    """Divided by the length; a zero vector stays."""
    norm = F.sqrt(dot(v, v))
    return F.when(norm > 0, F.transform(v, lambda x: x / norm)).otherwise(v)


def mean_pool(chunks: DataFrame, key: str, v: str = "v") -> DataFrame:
    """(key, pooled): unit mean of a key's vectors; null where a vector is empty or lengths differ. Sums are combined before the shuffle."""
    each = chunks.select(key, F.size(v).alias("dim"), F.posexplode_outer(v).alias("i", "x"))
    mean = each.groupBy(key, "i").agg(F.avg("x").alias("x"), F.min("dim").alias("low"), F.max("dim").alias("high"))
    out = mean.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("s"), F.min("low").alias("low"), F.max("high").alias("high"))
    fit = (F.col("low") == F.col("high")) & (F.col("low") > 0)
    return out.select(key, F.when(fit, normalised(F.transform("s", lambda p: p["x"]))).alias("pooled"))


def top_k(queries: DataFrame, vectors: DataFrame, k: int, floor: float | None = None, query_id: str = "query_id", vec_id: str = "vec_id", v: str = "v", skip_self: bool = False) -> DataFrame:
    """(query_id, vec_id, score, rank): for each query the k vectors with the largest dot product of at least `floor`; ties go to the smaller id.

    Queries are read in blocks of bounded size, and each block meets every vector where the
    vector is: a task keeps its best k for each query, and only those are shuffled.
    """
    q = queries.select(F.col(query_id).alias("q"), F.col(v).cast("array<double>").alias("v")).where("v is not null and size(v) > 0")
    n = q.count()
    blocks = max(1, -(-n // QUERY_BLOCK))
    found = None
    for b in range(blocks):
        part = q if blocks == 1 else q.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b)
        rows = part.collect()
        one = _best(rows, vectors.select(F.col(vec_id).alias("i"), F.col(v).cast("array<double>").alias("v")), k, floor, skip_self)
        found = one if found is None else found.unionByName(one)
    w = Window.partitionBy("q").orderBy(F.desc("score"), "i")
    best = found.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)
    return best.select(F.col("q").alias(query_id), F.col("i").alias(vec_id), "score", "rank")


def _best(rows: list, vectors: DataFrame, k: int, floor: float | None, skip_self: bool) -> DataFrame:
    pieces: list[tuple[int, np.ndarray, np.ndarray]] = []
    for dim in sorted({len(r.v) for r in rows}):
        own = [r for r in rows if len(r.v) == dim]
        ids, x = np.array([r.q for r in own], np.int64), np.array([r.v for r in own], float)
        pieces += [(dim, ids[a : a + QUERY_PIECE], x[a : a + QUERY_PIECE]) for a in range(0, len(own), QUERY_PIECE)]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [(np.full((len(q), k), -np.inf), np.full((len(q), k), np.iinfo(np.int64).max)) for _, q, _ in pieces]
        for batch in batches:
            vec = batch.column(1).fill_null([])
            size = np.diff(vec.offsets.to_numpy())
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for d in {d for d, _, _ in pieces}:
                mine = np.flatnonzero(size == d)
                for part in np.array_split(mine, -(-len(mine) // VECTOR_PIECE)) if len(mine) else ():
                    y = vec.take(pa.array(part)).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
                    for at, (dim, q, x) in enumerate(pieces):
                        if dim != d:
                            continue
                        s = x @ y.T
                        s[~np.isfinite(s)] = -np.inf
                        if floor is not None:
                            s[s < floor] = -np.inf
                        if skip_self:
                            s[q[:, None] == ids[part][None, :]] = -np.inf
                        score = np.concatenate([kept[at][0], s], axis=1)
                        who = np.concatenate([kept[at][1], np.broadcast_to(ids[part], s.shape)], axis=1)
                        order = np.lexsort((who, -score), axis=1)[:, :k]
                        kept[at] = np.take_along_axis(score, order, 1), np.take_along_axis(who, order, 1)
        for (_, q, _), (score, who) in zip(pieces, kept, strict=True):
            r, c = np.nonzero(np.isfinite(score))
            yield pa.RecordBatch.from_arrays([pa.array(q[r]), pa.array(who[r, c]), pa.array(score[r, c])], ["q", "i", "score"])

    return vectors.mapInArrow(of, "q long, i long, score double")


def neighbour_pairs(vectors: DataFrame, k: int = 4, floor: float = 0.70, vec_id: str = "vec_id", v: str = "v") -> DataFrame:
    """(a, b, score), a < b: unordered pairs of which one is among the other's k nearest at the floor or above."""
    directed = top_k(vectors.withColumnRenamed(vec_id, "query_id"), vectors, k, floor, "query_id", vec_id, v, skip_self=True)
    a, b = F.col("query_id"), F.col(vec_id)
    return directed.groupBy(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).agg(F.max("score").alias("score"))


def candidate_count(k: Column) -> Column:
    """How many candidates a reranker is given for k results: 4k within 30 and 80, k at least."""
    return F.greatest(F.least(F.greatest(k * 4, F.lit(30)), F.lit(80)), k)


def reranked(candidates: DataFrame, order: DataFrame, k: int) -> DataFrame:
    """candidates(query_id, idx, score, ...) by the reranker's (query_id, idx, rerank): best k, out-of-range and repeated idx skipped; queries the reranker left out, or with one candidate, keep their order."""
    n = Window.partitionBy("query_id")
    best = order.groupBy("query_id", "idx").agg(F.max("rerank").alias("rerank"))
    rows = candidates.join(best, ["query_id", "idx"], "left").withColumn("_n", F.count("*").over(n)).withColumn("_any", F.count("rerank").over(n))
    keep = (F.col("_n") <= 1) | (F.col("_any") == 0) | F.col("rerank").isNotNull()
    w = Window.partitionBy("query_id").orderBy(F.desc_nulls_last(F.when(F.col("_n") > 1, F.col("rerank"))), "idx")
    return rows.where(keep).withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k).drop("_n", "_any")


def course_neighbours(docs: DataFrame, k: int = 4, floor: float = 0.70, most: int = 300) -> DataFrame:
    """docs(course_id, doc_id, v) -> (course_id, a, b, score), a < b: pairs of one course of which one is among the other's k nearest.

    The first `most` documents of a course take part, by id: this bounds the group that a
    task multiplies. Vectors of other lengths, null and empty ones are near nothing.
    """
    w = Window.partitionBy("course_id").orderBy("doc_id")
    few = docs.where("v is not null and size(v) > 0").withColumn("at", F.row_number().over(w)).where(F.col("at") <= most)
    rows = few.select("course_id", "doc_id", F.col("v").cast("array<double>").alias("v"), F.size("v").alias("dim"))

    def near(pdf):
        x, ids = np.array(pdf["v"].tolist()), pdf["doc_id"].to_numpy(np.int64)
        score = np.clip(x @ x.T, -1.0, 1.0)
        np.fill_diagonal(score, -np.inf)
        score[score < floor] = -np.inf
        best = np.lexsort((np.broadcast_to(ids, score.shape), -score), axis=1)[:, :k]
        i = np.repeat(np.arange(len(ids)), best.shape[1])
        j = best.ravel()
        hit = np.isfinite(score[i, j])
        i, j = i[hit], j[hit]
        return type(pdf)({"course_id": pdf["course_id"].iloc[:1].repeat(len(i)).to_numpy(), "a": np.minimum(ids[i], ids[j]), "b": np.maximum(ids[i], ids[j]), "score": score[i, j]})

    kind = docs.schema["course_id"].dataType.simpleString()
    found = rows.groupBy("course_id", "dim").applyInPandas(near, f"course_id {kind}, a long, b long, score double")
    return found.groupBy("course_id", "a", "b").agg(F.max("score").alias("score"))


def course_pairs(docs: DataFrame, k: int | None = None, floor: float = 0.70, block: int = COURSE_BLOCK) -> DataFrame:
    """Like course_neighbours(), of all documents of a course; without k every pair at the floor or above.

    A course is dealt into blocks by hash, and each pair of blocks is a group of its own, so
    a group is bounded whatever the course's size. With k each group keeps the best k of a
    document, and only those are merged.
    """
    rows = docs.where("v is not null and size(v) > 0").select("course_id", "doc_id", F.col("v").cast("array<double>").alias("v"), F.size("v").alias("dim"))
    sizes = rows.groupBy(F.col("course_id").alias("_course"), F.col("dim").alias("_dim")).agg(F.ceil(F.count("*") / block).cast("int").alias("_blocks"))
    dealt = rows.join(sizes, F.col("course_id").eqNullSafe(F.col("_course")) & (F.col("dim") == F.col("_dim")))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("_blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    dealt = dealt.select("course_id", "dim", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "doc_id", "v")

    def near(pdf):
        ids, own, low = pdf["doc_id"].to_numpy(np.int64), pdf["own"].to_numpy(), pdf["low"].iloc[0]
        x = np.array(pdf["v"].tolist())
        left = own == low
        right = left if low == pdf["high"].iloc[0] else ~left
        p, q = ids[left], ids[right]
        score = np.clip(x[left] @ x[right].T, -1.0, 1.0)
        score[~(score >= floor) | (p[:, None] == q[None, :])] = -np.inf
        if k is None:
            i, j = np.nonzero(np.isfinite(score))
            found = [(p[i], q[j], score[i, j])]
        else:
            found = []
            for s, a, b in ((score, p, q), (score.T, q, p)):
                best = np.lexsort((np.broadcast_to(b, s.shape), -s), axis=1)[:, :k]
                i, j = np.repeat(np.arange(len(a)), best.shape[1]), best.ravel()
                hit = np.isfinite(s[i, j])
                found.append((a[i[hit]], b[j[hit]], s[i[hit], j[hit]]))
        a, b, s = (np.concatenate(c) for c in zip(*found, strict=True))
        return type(pdf)({"course_id": pdf["course_id"].iloc[:1].repeat(len(a)).to_numpy(), "a": a, "b": b, "score": s})

    kind = docs.schema["course_id"].dataType.simpleString()
    found = dealt.groupBy("course_id", "dim", "low", "high").applyInPandas(near, f"course_id {kind}, a long, b long, score double")
    if k is not None:
        found = found.groupBy("course_id", "a", "b").agg(F.max("score").alias("score"))
        w = Window.partitionBy("course_id", "a").orderBy(F.desc("score"), "b")
        found = found.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= k)
    return found.groupBy("course_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("score").alias("score"))
