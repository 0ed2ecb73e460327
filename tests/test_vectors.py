import numpy as np

from coursemill.operators import vectors
from coursemill.plans import retrieval


def test_pairs_of_a_course_of_any_size(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(500, 8))
    x /= np.linalg.norm(x, axis=1)[:, None]
    rows = [(None if i % 10 == 9 else i % 2, i, x[i].tolist()) for i in range(500)] + [(0, 900, None), (0, 901, []), (0, 902, [1.0])]
    df = spark.createDataFrame(rows, "course_id int, doc_id long, v array<double>")
    s = np.clip(x @ x.T, -1, 1)
    course = np.array([-1 if c is None else c for c, *_ in rows[:500]])
    s[(course[:, None] != course[None, :]) | (s < 0.6) | np.eye(500, dtype=bool)] = -np.inf
    every = {(int(i), int(j)) for i, j in np.argwhere(np.isfinite(s)) if i < j}
    nearest = {(min(i, int(j)), max(i, int(j))) for i in range(500) for j in np.argsort(-s[i], kind="stable")[:3] if np.isfinite(s[i, j])}
    for block in (64, 1024):
        for k, want in ((None, every), (3, nearest)):
            got = vectors.course_pairs(df, k, 0.6, block).collect()
            assert len(got) == len(want) and {(g.a, g.b) for g in got} == want
            assert all(abs(g.score - s[g.a, g.b]) < 1e-12 for g in got)


def test_similar_documents_past_the_linkers_cap(spark, tmp_path):
    ids = [i for i in range(2_000) if i % 5 == 0]
    spark.createDataFrame([(i, 0, [float(i > 1_900), float(i <= 1_900)]) for i in ids], "vec_id long, label int, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    late = [i for i in ids if i > 1_900 and i % 19]
    pairs = retrieval.j11_similar_documents(spark, str(tmp_path)).where("a_id > 1900").collect()
    assert {(p.a_id, p.b_id) for p in pairs} == {(a, b) for a in late for b in late if a < b}


def test_searching_holds_little_at_a_time(monkeypatch):
    """1,024 queries over a batch of 8,192 vectors: products, ids and orders of a piece, not of all queries and half the batch."""
    import tracemalloc
    from types import SimpleNamespace

    import pyarrow as pa

    r = np.random.default_rng(4)
    q, x = r.normal(size=(1024, 8)), r.normal(size=(8192, 8))
    held = []
    stand_in = SimpleNamespace(mapInArrow=lambda of, schema: held.append(of))
    vectors._best([SimpleNamespace(q=i, v=v.tolist()) for i, v in enumerate(q)], stand_in, 5, None, False)
    batch = pa.record_batch({"i": pa.array(range(8192)), "v": pa.array(list(x), pa.list_(pa.float64()))})
    tracemalloc.start()
    got = pa.Table.from_batches(list(held[0](iter([batch]))))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30e6
    best = np.argsort(-(q @ x.T), axis=1, kind="stable")[:, :5]
    assert {(a, b) for a, b in zip(got["q"].to_pylist(), got["i"].to_pylist(), strict=True)} == {(i, int(j)) for i in range(1024) for j in best[i]}
