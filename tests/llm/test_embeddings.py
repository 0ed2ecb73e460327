import numpy as np

from coursemill.llm import embedding_dedup as e

VEC = "vec_id long, embedding array<float>, label int"


def sample(n=400, d=24):
    rng = np.random.default_rng(2)
    out = []
    while len(out) < n:
        base = rng.standard_normal(d)
        for _ in range(int(rng.choice([1, 1, 3, 10]))):
            out.append(base + rng.standard_normal(d) * rng.choice([0, 0.05, 0.2]))
    return np.array(out[:n], np.float32)


def test_links_against_brute_force(spark):
    x = sample()
    df = spark.createDataFrame([(i, [float(c) for c in v], 0) for i, v in enumerate(x)], VEC)
    u = x.astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    c = u @ u.T
    np.fill_diagonal(c, 0)
    want = (c >= 0.95).sum(axis=1)
    for block in (e.BLOCK, 4):
        got = {r.vec_id: r for r in e.near_vectors(df, block=block).collect()}
        links = np.array([got[i].n_links for i in range(len(x))])
        assert (links <= want).all()
        assert links.sum() >= 0.97 * want.sum()
        comp = np.array([got[i].component_id for i in range(len(x))])
        for i in range(len(x)):
            if want[i] == 0:
                assert comp[i] == i
        exact = [(i, j) for i in range(len(x)) for j in range(i) if (x[i] == x[j]).all()]
        assert exact and all(comp[i] == comp[j] for i, j in exact)
        assert all(got[i].kept == (comp[i] == i) for i in got)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 0), (2, [1.0, 0.0], 0), (3, [2.0, 0.0], 0), (4, None, 0), (5, [0.0, 0.0], 0), (6, [nan, 1.0], 0), (7, [inf, 1.0], 0), (8, [None, 1.0], 0), (9, [], 0), (10, [1.0, 0.0, 0.0], 0), (None, [1.0, 0.0], 0), (11, [0.0, 0.0], 0)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in e.near_vectors(spark.createDataFrame(rows, VEC)).collect()}
    assert got[1] == (2, 1, True) and got[2] == (2, 1, False) and got[3] == (2, 1, False)
    for i in range(4, 12):
        assert got[i] == (0, i, True)
    assert got[None] == (0, None, None)
    assert e.near_vectors(spark.createDataFrame([], VEC)).count() == 0


def test_repeated_rows_count(spark):
    rows = [(1, [1.0, 2.0], 0), (1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)]
    assert [r.n_links for r in e.near_vectors(spark.createDataFrame(rows, VEC)).collect()] == [2, 2, 2]


def test_shape_reaches_recall():
    for n in (10, 10_000, 10_000_000):
        k, tables = e.table_shape(n, 0.95, 0.99)
        assert 1 - (1 - e.collision(np.sqrt(0.1), 2.0) ** k) ** tables >= 0.99


def test_recall_just_above_the_threshold(spark):
    """Planted pairs at cosines of 0.95 to 0.96 among vectors that are far from each other."""
    rng = np.random.default_rng(9)
    a, b = rng.standard_normal((2, 700, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    c = rng.uniform(0.9502, 0.96, 700)[:, None]
    x = np.concatenate([a, c * a + np.sqrt(1 - c * c) * b, rng.standard_normal((600, 64))])
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in e.near_vectors(df, load=16.0).collect()}
    hit = sum(got[i + 700].component_id == i for i in range(700))
    assert hit >= 0.985 * 700
    assert all(got[i].n_links <= 1 for i in range(1400)) and all(got[i].n_links == 0 for i in range(1400, 2000))


def test_sketches_lose_no_pair_at_the_threshold():
    rng = np.random.default_rng(1)
    for cosine in (0.8, 0.95, 0.99):
        most, x = e.sign_limit(cosine), rng.standard_normal((2, 4000, e.SIGNS))
        y = cosine * x[0] + np.sqrt(1 - cosine**2) * x[1]
        assert ((x[0] > 0) != (y > 0)).sum(axis=1).max() <= most
