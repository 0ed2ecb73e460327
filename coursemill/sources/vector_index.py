"""An inverted file of vectors: k-means cells, a Parquet folder for each, searched cell by cell with exact scores.

Cells are fitted on a bounded sample; every vector is stored, in the cell whose centre it is
nearest to. A search probes some cells for each query, or all of them, which is exact. Queries
and vectors meet in groups of a cell that are dealt into blocks on both sides, so a group is
bounded however many vectors a cell has or queries probe it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

#: Vectors that cells are fitted on, at most about; vectors and queries in a group, about.
SAMPLE, BLOCK = 50_000, 4096
#: Products that a task holds at a time, and rows that it sends at once, about.
PRODUCTS, ROWS = 1 << 18, 1 << 14
#: Cell of vectors whose length isn't the index's.
OTHER = -1


def _matrix(col: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(places of finite vectors of the length, those as rows)."""
    col = col.fill_null([]) if col.null_count else col
    size = np.diff(col.offsets.to_numpy())
    at = np.flatnonzero(size == dim)
    x = col.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(at), dim)
    ok = np.isfinite(x).all(1)
    return at[ok], x[ok]


def _order(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Cells of each row from the nearest centre on."""
    far = (centres * centres).sum(1)[None, :] - 2 * x @ centres.T
    return np.argsort(far, axis=1, kind="stable")


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The cell of the nearest centre, the first of equally near ones, some rows at a time."""
    square, step = (centres * centres).sum(1)[None, :], max(1, PRODUCTS // max(len(centres), 1))
    return np.concatenate([np.argmin(square - 2 * x[a : a + step] @ centres.T, axis=1) for a in range(0, len(x), step)])


def fit_cells(vectors: DataFrame, cells: int, sample: int = SAMPLE, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """Centres by Lloyd's rounds over a sample by hash of the ids; each task sums its vectors by cell, and the sums of at most 8 tasks are added. Empty cells keep their centres."""
    n = max(vectors.count(), 1)
    lot = F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(1_000_003)) / 1_000_003
    some = vectors.where(lot < sample / n).where("v is not null and size(v) > 0").select("vec_id", F.col("v").cast("array<double>").alias("v")).repartition(8, "vec_id").persist()
    dim = some.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if dim is None:
        some.unpersist()
        return np.zeros((0, 0))
    d = dim["d"]
    first = some.where(F.size("v") == d).orderBy(F.xxhash64("vec_id", F.lit(seed + 1)), "vec_id").limit(cells).collect()
    centres = np.array([r.v for r in first])
    for _ in range(rounds):

        def of(batches: Iterator[pa.RecordBatch], centres=centres) -> Iterator[pa.RecordBatch]:
            total, n = np.zeros_like(centres), np.zeros(len(centres), np.int64)
            for b in batches:
                _, x = _matrix(b.column(0), d)
                if len(x):
                    c = _nearest(x, centres)
                    np.add.at(total, c, x)
                    n += np.bincount(c, minlength=len(centres))
            hit = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(n[hit]), pa.array(list(total[hit]), pa.list_(pa.float64()))], ["cell", "n", "total"])

        total, n = np.zeros_like(centres), np.zeros(len(centres))
        for r in some.select("v").mapInArrow(of, "cell long, n long, total array<double>").collect():
            total[r.cell] += r.total
            n[r.cell] += r.n
        centres = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centres)
    some.unpersist()
    return centres


def placed(rows: DataFrame, centres: np.ndarray, probes: int | None = 1, v: str = "v") -> DataFrame:
    """rows with `cell`: one row for each of a vector's `probes` nearest cells, or of all. Other lengths are in OTHER; null, empty and non-finite vectors have no row."""
    keep, dim = [c for c in rows.columns if c != v], centres.shape[1]
    given = rows.where(f"{v} is not null and size({v}) > 0").select(*keep, F.col(v).cast("array<double>").alias("v"))
    schema = StructType([*given.schema.fields, StructField("cell", IntegerType())])
    step = max(1, min(PRODUCTS // max(len(centres), 1), ROWS // max(min(probes or len(centres), len(centres)), 1)))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in (batch.slice(i, step) for i in range(0, batch.num_rows, step)):
                col = b.column(len(keep))
                at, x = _matrix(col, dim)
                cells = _order(x, centres)[:, :probes] if len(x) else np.zeros((0, 0), int)
                size = np.diff(col.offsets.to_numpy())
                other = np.flatnonzero(size != dim)
                take = np.concatenate([np.repeat(at, cells.shape[1]), other])
                cell = np.concatenate([cells.ravel(), np.full(len(other), OTHER)]).astype(np.int32)
                out = b.take(pa.array(take))
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(cell)], names=schema.names)

    return given.mapInArrow(of, schema)


class VectorIndex:
    """A written index: its vectors (vec_id, v, cell) in a folder for each cell, its centres, and how many vectors each cell has."""

    def __init__(self, spark: SparkSession, path: str):
        self.vectors = spark.read.schema("vec_id long, v array<double>, cell int").parquet(f"{path}/vectors")
        rows = spark.read.parquet(f"{path}/cells").orderBy("cell").collect()
        self.centres = np.array([r.centre for r in rows if r.cell >= 0]) if any(r.cell >= 0 for r in rows) else np.zeros((0, 0))
        self.spark, self.counts = spark, [(r.cell, r.n) for r in rows]
        self.sizes = spark.createDataFrame(self.counts, "cell int, n long")

    @classmethod
    def build(cls, vectors: DataFrame, path: str, cells: int = 256, sample: int = SAMPLE) -> VectorIndex:
        """Writes the index of vectors(vec_id, v)."""
        spark = vectors.sparkSession
        centres = fit_cells(vectors, cells, sample)
        rows = placed(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "v"), centres)
        rows.repartition("cell", F.pmod(F.xxhash64("vec_id"), F.lit(4))).write.partitionBy("cell").parquet(f"{path}/vectors")
        n = {r["cell"]: r["n"] for r in spark.read.schema("vec_id long, cell int").parquet(f"{path}/vectors").groupBy("cell").agg(F.count("*").alias("n")).collect()}
        about = [(i, n.get(i, 0), c.tolist()) for i, c in enumerate(centres)] + [(OTHER, n.get(OTHER, 0), None)]
        spark.createDataFrame(about, "cell int, n long, centre array<double>").coalesce(1).write.parquet(f"{path}/cells")
        return cls(spark, path)

    def _whole(self, queries: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(queries, vectors, sizes) for a search of every cell: neighbouring cells of BLOCK vectors together are one, so a query is sent to as many as there are blocks of vectors, not cells."""
        of_cell, size = [], [0]
        for cell, n in self.counts:
            if size[-1] and size[-1] + n > BLOCK:
                size.append(0)
            size[-1] += n
            of_cell.append((cell, len(size) - 1))
        sizes = self.spark.createDataFrame(list(enumerate(size)), "cell int, n long")
        bundle = F.broadcast(self.spark.createDataFrame(of_cell, "cell int, bundle int"))
        q = queries.where("v is not null and size(v) > 0").select("query_id", F.col("v").cast("array<double>").alias("v")).crossJoin(F.broadcast(sizes.select("cell")))
        return q, self.vectors.join(bundle, "cell").select("vec_id", "v", F.col("bundle").alias("cell")), sizes

    def probes_for(self, queries: DataFrame, k: int, recall: float = 0.9, most: int = 200) -> int:
        """The fewest probes with which at least that share of the exact best k is found, measured on `most` queries by hash of the id."""
        some = queries.orderBy(F.xxhash64("query_id"), "query_id").limit(most)
        best = self.search(some, k).join(self.vectors.select("vec_id", "cell"), "vec_id").select("query_id", "cell")
        rank = placed(some.select("query_id", "v"), self.centres, None).select("query_id", "v", "cell")
        centres, dim = self.centres, self.centres.shape[1]

        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                at, x = _matrix(b.column(1), dim)
                place = np.argsort(_order(x, centres), axis=1)
                cell = b.column(2).to_numpy()[at]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), b.column(2).take(pa.array(at)), pa.array(place[np.arange(len(at)), cell] + 1)], ["query_id", "cell", "place"])

        places = rank.where("cell >= 0").mapInArrow(of, "query_id long, cell int, place long").join(best, ["query_id", "cell"]).groupBy("place").count().orderBy("place").collect()
        need, found = recall * sum(r["count"] for r in places), 0
        for r in places:
            found += r["count"]
            if found >= need:
                return r["place"]
        return 1

    def search(self, queries: DataFrame, k: int, probes: int | None = None, floor: float | None = None, excluded: DataFrame | None = None, skip_self: bool = False) -> DataFrame:
        """queries(query_id, v) -> (query_id, vec_id, score, rank): the k largest dot products among the probed cells, of at least `floor`; ties go to the smaller id.

        Without probes every cell is searched, which is exact. Ids in excluded(vec_id) are left
        out before the best are taken. Null, empty and non-finite vectors find nothing.
        """
        blocks = lambda n: F.greatest(F.ceil(n / BLOCK), F.lit(1)).cast("int")
        given = queries.select(F.col("query_id").cast("long").alias("query_id"), "v")
        q, v, sizes = self._whole(given) if probes is None else (placed(given, self.centres, probes), self.vectors, self.sizes)
        asked = q.groupBy("cell").agg(F.count("*").alias("asked")).join(sizes.where("n > 0"), "cell").select("cell", blocks(F.col("asked")).alias("qs"), blocks(F.col("n")).alias("vs"))
        asked = F.broadcast(asked)  # a row for each cell
        v = v if excluded is None else v.join(excluded.select("vec_id").distinct(), "vec_id", "left_anti")
        lot = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = q.join(asked, "cell").withColumn("qb", lot("query_id", "qs")).select("cell", "qb", every("vs").alias("vb"), "query_id", "v")
        right = v.join(asked, "cell").withColumn("vb", lot("vec_id", "vs")).select("cell", every("qs").alias("qb"), "vb", "vec_id", "v")

        def best(a: pa.Table, b: pa.Table) -> pa.Table:
            out = []
            x, y = a["v"].combine_chunks(), b["v"].combine_chunks()
            dims = {*np.diff(x.offsets.to_numpy()).tolist()} & {*np.diff(y.offsets.to_numpy()).tolist()} if len(x) and len(y) else ()
            for d in dims:
                (i, x_d), (j, y_d) = _matrix(x, d), _matrix(y, d)
                qid, vid = a["query_id"].to_numpy()[i], b["vec_id"].to_numpy()[j]
                step = max(1, PRODUCTS // max(len(j), 1))
                for at in range(0, len(i), step):
                    s, who = x_d[at : at + step] @ y_d.T, qid[at : at + step]
                    s[~np.isfinite(s)] = -np.inf
                    if floor is not None:
                        s[s < floor] = -np.inf
                    if skip_self:
                        s[who[:, None] == vid[None, :]] = -np.inf
                    top = np.lexsort((np.broadcast_to(vid, s.shape), -s), axis=1)[:, :k]
                    got = np.take_along_axis(s, top, 1)
                    r, c = np.nonzero(np.isfinite(got))
                    out.append((who[r], vid[top[r, c]], got[r, c]))
            cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
            return pa.table(dict(zip(("query_id", "vec_id", "score"), cols, strict=True)))

        key = ["cell", "qb", "vb"]
        found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(best, "query_id long, vec_id long, score double")
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def cells_for(n: int) -> int:
    """About the square root of the number of vectors, at most 1,024."""
    return int(min(max(round(n**0.5), 1), 1024))
