"""The inverted file against all products."""

import numpy as np
import pytest

from coursemill.sources import vector_index
from coursemill.sources.vector_index import VectorIndex


def rows(n=600, dim=8, seed=1):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(12, dim))
    x = centres[r.integers(0, 12, n)] + r.normal(scale=0.25, size=(n, dim))
    x[1] = x[0]  # a tie
    out = [(i, (v / np.linalg.norm(v)).tolist()) for i, v in enumerate(x)]
    return out + [(n, None), (n + 1, []), (n + 2, [1.0, 0.0]), (n + 3, [float("nan")] * dim), (n + 4, [0.5, 0.5])]


def brute(vectors, queries, k, floor=None, excluded=(), skip_self=False):
    out = set()
    for q, x in queries:
        got = []
        for i, y in vectors:
            if x and y and len(x) == len(y) and i not in excluded and not (skip_self and i == q):
                s = float(np.dot(x, y))
                if np.isfinite(s) and (floor is None or s >= floor):
                    got.append((-round(s, 9), i))
        out |= {(q, i, r + 1) for r, (_, i) in enumerate(sorted(got)[:k])}
    return out


def triples(df):
    """With ranks by scores to nine digits, as products of equal vectors in unlike blocks may differ in the last."""
    found = {}
    for r in df.collect():
        found.setdefault(r.query_id, []).append((-round(r.score, 9), r.vec_id))
    return {(q, i, n + 1) for q, got in found.items() for n, (_, i) in enumerate(sorted(got))}


@pytest.mark.parametrize("block", [50, 4096])
def test_all_cells_are_exact(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(vector_index, "BLOCK", block)
    vectors = rows()
    df = spark.createDataFrame(vectors, "vec_id long, v array<double>")
    index = VectorIndex.build(df, str(tmp_path / "index"), cells=16)
    queries = vectors[:600:7] + vectors[-5:]
    q = spark.createDataFrame(queries, "query_id long, v array<double>")
    assert triples(index.search(q, 5)) == brute(vectors, queries, 5)
    gone = spark.createDataFrame([(i,) for i in range(0, 600, 3)], "vec_id long")
    assert triples(index.search(q, 5, floor=0.6, excluded=gone, skip_self=True)) == brute(vectors, queries, 5, 0.6, set(range(0, 600, 3)), True)


def test_recall_with_few_probes(spark, tmp_path):
    vectors = rows(3000)[:3000]
    df = spark.createDataFrame(vectors, "vec_id long, v array<double>")
    index = VectorIndex.build(df, str(tmp_path / "index"), cells=vector_index.cells_for(3000), sample=1500)
    queries = vectors[::50]
    q = spark.createDataFrame(queries, "query_id long, v array<double>")
    probes = index.probes_for(q, 10)
    assert probes <= len(index.centres) // 3
    got = {(a, b) for a, b, _ in triples(index.search(q, 10, probes=probes))}
    want = {(a, b) for a, b, _ in brute(vectors, queries, 10)}
    assert len(got & want) / len(want) >= 0.9
    plan = index.vectors.where("cell = 3")._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "cell" in plan.split("PartitionFilters")[1][:80]


def test_no_vectors_and_no_queries(spark, tmp_path):
    none = spark.createDataFrame([], "vec_id long, v array<double>")
    q = spark.createDataFrame([(1, [1.0])], "query_id long, v array<double>")
    assert VectorIndex.build(none, str(tmp_path / "none")).search(q, 3).count() == 0
    some = VectorIndex.build(spark.createDataFrame([(1, [1.0])], "vec_id long, v array<double>"), str(tmp_path / "some"))
    assert some.search(q.where("query_id > 1"), 3).count() == 0 and some.search(q, 3).count() == 1


def test_a_search_of_all_cells_sends_queries_to_blocks_of_vectors(spark, tmp_path):
    """Not to every cell: 40 cells of 600 vectors are one block."""
    data = rows()
    index = VectorIndex.build(spark.createDataFrame(data, "vec_id long, v array<double>"), str(tmp_path / "i"), 40)
    q, v, sizes = index._whole(spark.createDataFrame(data[:20], "query_id long, v array<double>"))
    assert sizes.count() == 1 and q.count() == 20 and v.count() == sum(n for _, n in index.counts) == 602


def test_nearest_cells_in_pieces(monkeypatch):
    r = np.random.default_rng(2)
    x, centres = r.normal(size=(500, 6)), r.normal(size=(30, 6))
    monkeypatch.setattr(vector_index, "PRODUCTS", 100)
    assert (vector_index._nearest(x, centres) == vector_index._order(x, centres)[:, 0]).all()
