import random

from coursemill.llm import mixing as m

from .helpers import awkward, empty

UNITS = "id long, source string, size long"


def brute_targets(sizes, share=1.5, most=2.0):
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: m.WEIGHTS[i % 3] for i, s in enumerate(order)}
    left, open_, out = share * sum(sizes.values()), set(order), {}
    while open_:
        per = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if per * weight[s] >= most * sizes[s]}
        if not full:
            return out | {s: per * weight[s] for s in open_}
        for s in full:
            out[s] = most * sizes[s]
            left -= out[s]
        open_ -= full
    return out


def test_targets_equal_resharing(spark):
    r = random.Random(5)
    for k in range(3):
        sizes = {(None if i == 3 else f"s{i}é" if i == 2 else f"s{i}"): r.choice([0, 5, 100, 4000]) + 1 * (i == 0) for i in range(3 + 3 * k)}
        rows = [(i, s, n) for i, (s, n) in enumerate(sizes.items())]
        got = {x.source: x.target for x in m.source_targets(spark.createDataFrame(rows, UNITS)).collect()}
        want = brute_targets(sizes)
        assert got.keys() == want.keys()
        assert all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in want)


def test_mix_meets_targets_and_reruns_agree(spark, monkeypatch):
    monkeypatch.setattr(m, "BUCKET_ROWS", 50)  # several levels of the tree
    monkeypatch.setattr(m, "FAN", 3)
    r = random.Random(6)
    rows = [(i, r.choice(["hot", "hot", "hot", "b", "c", None]), r.randint(1, 60)) for i in range(3000)]
    df = spark.createDataFrame(rows, UNITS)
    got = m.mix_sources(df).collect()
    again = m.mix_sources(df.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert len(got) == len(rows)
    for s in {x.source for x in got}:
        mine = [x for x in got if x.source == s]
        assert abs(sum(x.copies * x.size for x in mine) - mine[0].target) <= 60
        assert all(0 <= x.copies <= 2 and abs(x.copies - x.target / x.source_size) < 1 + 1e-9 for x in mine)


def test_chance_of_a_document_is_its_share():
    import numpy as np

    p, w = np.array([0.3, 0.6, 0.2, 0.9, 0.5]), np.array([5.0, 1.0, 9.0, 3.0, 2.0])
    total = np.mean([m.pivot(p, w, np.random.default_rng(i)) for i in range(4000)], axis=0)
    assert np.abs(total - p).max() < 0.03
    for i in range(50):
        q = m.pivot(p, w, np.random.default_rng(i))
        assert abs((q * w).sum() - (p * w).sum()) < 1e-9
        assert ((q > 0) & (q < 1)).sum() <= 1


def test_awkward_rows(spark):
    counts = sorted((r.id or 0, r.size) for r in m.word_counts(awkward(spark)).collect())
    assert counts == [(0, 0), (0, 3), (1, 0), (2, 0), (3, 0), (4, 30000), (5, 10), (5, 10), (6, 10), (7, 6)]
    assert len(m.mix_sources(m.word_counts(awkward(spark))).collect()) == 10
    assert m.mix_sources(m.word_counts(empty(spark))).count() == 0
    zero = spark.createDataFrame([(1, "a", 0), (2, None, 0)], UNITS)
    assert [(r.target, r.copies) for r in m.mix_sources(zero).collect()] == [(0.0, 0), (0.0, 0)]


def test_equal_units_spread_over_buckets(spark, monkeypatch):
    monkeypatch.setattr(m, "BUCKET_ROWS", 50)
    monkeypatch.setattr(m, "REPEATS", 7)
    rows = [(None, "hot", 5)] * 700 + [(1, "hot", 5)] * 300 + [(i, "b", 3) for i in range(500)]
    got = m.mix_sources(spark.createDataFrame(rows, UNITS)).collect()
    again = m.mix_sources(spark.createDataFrame(rows[::-1], UNITS)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(rows)
    for s in ("hot", "b"):
        mine = [x for x in got if x.source == s]
        assert abs(sum(x.copies * x.size for x in mine) - mine[0].target) <= 5
    shares = [sum(x.copies for x in got if x.source == "hot" and x.id == i) / n for i, n in ((None, 700), (1, 300))]
    assert abs(shares[0] - shares[1]) < 0.25


def test_a_huge_document_is_balanced_by_small_ones(spark, monkeypatch):
    r = random.Random(9)
    small = {s: [r.randint(20, 90) for _ in range(4000)] for s in ("a", "b", "c")}
    rows = [(i, s, n) for i, (s, n) in enumerate((s, n) for s in small for n in small[s])] + [(10**6 + k, s, 100_000) for k, s in enumerate("abc")]
    for rows_of_bucket in (8192, 1000):
        monkeypatch.setattr(m, "BUCKET_ROWS", rows_of_bucket)
        for seed in range(3):
            got = m.mix_sources(spark.createDataFrame(rows, UNITS), seed=seed).collect()
            for s in small:
                mine = [x for x in got if x.source == s]
                off = abs(sum(x.copies * x.size for x in mine) - mine[0].target)
                assert off <= (90 if rows_of_bucket == 8192 else 50_000)


def test_the_fraction_left_is_the_smallest():
    import numpy as np

    r = np.random.default_rng(3)
    for equal in (True, False):
        for k in range(200):
            w = np.sort(r.integers(1, 50, 60).astype(float))[::-1].copy()
            w[0] = 500.0
            p = np.full(60, 0.45) if equal else r.uniform(0.3, 0.7, 60)
            q = m.pivot(p, w, np.random.default_rng(k))
            open_ = np.flatnonzero((q > 0) & (q < 1))
            assert abs((q * w).sum() - (p * w).sum()) < 1e-6 and len(open_) <= 1
            assert all(w[i] <= 50 for i in open_)
    total = np.mean([m.pivot(np.full(6, 0.4), np.array([90.0, 20, 10, 5, 5, 1]), np.random.default_rng(i)) for i in range(8000)], axis=0)
    assert np.abs(total - 0.4).max() < 0.03
