import random
from itertools import product

import numpy as np
import xxhash

from coursemill.llm import simhash_dedup as s
from coursemill.llm.graph import components

from .helpers import awkward, empty, prose


def brute_fp(t):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").replace("\n", " ").replace("\t", " ").split(" ")
    w = [x for x in w if x]
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, limit=2):
    parent = dict.fromkeys(fps)
    ids = sorted(fps)
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in ids:
        for j in ids:
            if i < j and (fps[i] ^ fps[j]).bit_count() <= limit:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def fingerprints_with_clusters(n=300):
    r = random.Random(1)
    out = []
    while len(out) < n:
        base = r.getrandbits(64)
        for _ in range(r.choice([1, 1, 2, 12])):
            x = base
            for _ in range(r.randint(0, 3)):
                x ^= 1 << r.randrange(64)
            out.append(x)
    return dict(enumerate(out[:n]))


def test_fingerprints(spark):
    got = s.simhash_components(awkward(spark))
    rows = got.collect()
    assert len(rows) == 10
    texts = {r.doc_id: r.text for r in awkward(spark).collect() if r.doc_id is not None}
    for r in rows:
        if r.doc_id is not None:
            assert int(r.fingerprint, 16) == brute_fp(texts[r.doc_id])
    comp = {r.doc_id: r.component_id for r in rows if r.doc_id is not None}
    assert comp == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 5, 7: 7}
    assert s.simhash_components(empty(spark)).count() == 0


def test_links_equal_brute_force_at_each_plan_and_bucket_size(spark):
    fps = fingerprints_with_clusters()
    distinct = {}
    for i, f in fps.items():
        distinct.setdefault(f, i)
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)), i) for f, i in distinct.items()], "fp long, rep long")
    want = brute_components({i: f for f, i in distinct.items()})
    parts4 = tuple(tuple(range(a, a + 16)) for a in range(0, 64, 16))
    plans = [s.make_plan(df), s.Plan((tuple(range(32)), tuple(range(32, 64))), (1, 0)), s.Plan(parts4, (0, 0, 0, -1))]
    for plan in plans:
        assert sum(t + 1 for t in plan.thresholds) == 3
        for bucket in (s.BUCKET, 3):
            got = {r.node: r.component for r in components(s.links(df, plan, bucket=bucket)).collect()}
            assert {i: got.get(i, i) for i in want} == want


def test_allocation_is_the_cheapest_of_all():
    """The dynamic programme against every way to deal three allowances to the parts."""
    r = np.random.default_rng(2)
    for sizes in ((40, 24), (20, 20, 24), (10, 14, 18, 22)):
        ends = np.cumsum(sizes).tolist()
        parts = [list(range(a, b)) for a, b in zip([0, *ends], ends, strict=False)]
        p = r.uniform(0.1, 0.9, 64)
        alone = []  # cost of each part at each threshold: the programme over that part alone
        for part in parts:
            alone.append([0.0] + [s.allocate([part], p, 50_000, t)[0] for t in range(3)])
        want = min(sum(alone[i][e] for i, e in enumerate(es)) for es in product(range(4), repeat=len(parts)) if sum(es) == 3)
        cost, ts = s.allocate(parts, p, 50_000, 2)
        assert np.isclose(cost, want) and sum(t + 1 for t in ts) == 3
        assert np.isclose(cost, sum(alone[i][t + 1] for i, t in enumerate(ts)))


def test_correlated_bits_share_a_part():
    corr = np.eye(64)
    corr[0, 63] = corr[63, 0] = 0.9
    parts = s.correlated_parts(corr, 4)
    assert sorted(sum(parts, [])) == list(range(64))
    assert any({0, 63} <= set(x) for x in parts)


def test_one_of_each(spark):
    r = random.Random(3)
    a, b = prose(r, 80), prose(r, 80)
    rows = [(3, a, 1), (1, a, 2), (2, b, 3), (2, b, 3), (9, None, 4), (8, "", 5), (None, a, 6), (None, "other words entirely", 7)]
    got = s.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, fp long"))
    assert sorted((r.doc_id, r.fp) for r in got.collect() if r.doc_id is not None) == [(1, 2), (2, 3), (8, 5)]
    assert [r.fp for r in got.collect() if r.doc_id is None] == [7]
    assert s.one_of_each(empty(spark)).count() == 0


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 140)}}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
