import random
from functools import lru_cache

import numpy as np

from coursemill.llm import decontaminate as d

from .helpers import awkward, empty, prose

ITEM = "item_id long, text string, share double"


def test_lcs_against_a_table():
    r = random.Random(1)

    def table(a, b):
        @lru_cache(None)
        def f(i, j):
            return 0 if i == len(a) or j == len(b) else 1 + f(i + 1, j + 1) if a[i] == b[j] else max(f(i + 1, j), f(i, j + 1))

        return f(0, 0)

    for _ in range(200):
        a, b = [tuple(r.randrange(6) for _ in range(r.randint(1, 25))) for _ in "ab"]
        assert d.lcs(np.array(a), np.array(b)) == table(a, b)


def test_finds_copies_and_paraphrases(spark):
    r = random.Random(2)
    common = [prose(r, 1) for _ in range(40)]
    word = lambda: r.choice(common) if r.random() < 0.4 else prose(r, 1)
    words = lambda n: [word() for _ in range(n)]
    items = [(i, " ".join(words(r.randint(12, 60))), 0.0) for i in range(30)]
    docs, want = [], set()
    for k in range(300):
        body = words(r.randint(5, 400))
        if k % 3 == 0:
            i = r.randrange(30)
            text = items[i][1].split()
            if k % 2 and len(text) >= 24:  # every eighth word changed, another dropped
                text = [w if j % 8 else "other" for j, w in enumerate(text) if j % 11 != 5]
            at = r.randint(0, len(body))
            body[at:at] = [w.upper() if k % 5 == 0 else w for w in text]
            want.add((k, i))
        docs.append((k, r.choice([" ", "\n", ", "]).join(body), "en", "s", 0))
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    bench = spark.createDataFrame([*items, (99, None, 0.0), (98, " ", 0.0), (None, "x y z", 0.0)], ITEM)
    for block in (d.ITEM_BLOCK, 10):
        got = {(x.doc_id, x.item_id) for x in d.contaminated(df, bench, item_block=block).collect()}
        assert not got - want
        assert len(want - got) <= 0.02 * len(want)
    left = {x.doc_id for x in d.without_contaminated(df, bench).collect()}
    assert left == set(range(300)) - {k for k, _ in got}


def test_awkward_rows(spark):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten", 0.0), (2, "one two three four five six seven eight nine ten", 0.0)], ITEM)
    got = sorted((x.doc_id, x.item_id, x.lcs_share) for x in d.contaminated(awkward(spark), bench).collect())
    assert got == [(5, 1, 1.0), (5, 2, 1.0), (6, 1, 1.0), (6, 2, 1.0)]
    assert d.contaminated(empty(spark), bench).count() == 0
    assert d.contaminated(awkward(spark), spark.createDataFrame([], ITEM)).count() == 0
    assert d.without_contaminated(awkward(spark), bench).count() == 7


def test_against_all_stretches_and_items(spark):
    """Every stretch of every document against every item, word by word: what is sure is found, and what is found is there."""
    import re

    r = random.Random(7)
    items = [(i, " ".join(prose(r, r.randint(18, 40)).split()), 0.0) for i in range(12)]
    docs = []
    for k in range(120):
        body = prose(r, r.randint(20, 120)).split()
        if k % 2:
            words = r.choice(items)[1].split()
            words = [w if r.random() > (k % 5) * 0.12 else "zz" for w in words]
            at = r.randint(0, len(body))
            body[at:at] = words
        docs.append((k, " ".join(body), "en", "s", 0))
    found = {(x.doc_id, x.item_id): x.lcs_share for x in d.contaminated(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(items, ITEM)).collect()}
    best = {}
    for k, text, *_ in docs:
        words = np.array([hash(w) for w in re.findall(r"\w+", text.lower())])
        for i, item, _ in items:
            want = np.array([hash(w) for w in re.findall(r"\w+", item.lower())])
            span = len(want) + len(want) // 4 + 2
            best[k, i] = max(d.lcs(want, words[a : a + span]) for a in range(max(1, len(words) - span + 1))) / len(want)
    sure = {p for p, share in best.items() if share >= d.SURE + 0.05}
    assert len(sure) > 30 and sure <= set(found)
    assert all(best[p] >= d.LOOSE and share <= best[p] + 1e-9 for p, share in found.items())


def test_passages_hold_every_word(spark):
    """Directions come from all words of all texts, not from one passage of some."""
    r = random.Random(5)
    texts = [prose(r, n) for n in (1, 31, 32, 33, 500)] + [None, "", " ... "]
    got = d._passages(spark.createDataFrame([(t,) for t in texts], "text string")).collect()
    sizes = sorted(len(x.words) // 2 for x in got)
    assert sum(sizes) == 597 and sizes[-1] == d.PASSAGE and len(sizes) == 1 + 1 + 1 + 2 + 16
    import pyarrow as pa

    words = d._buckets(d.hashed_words(*d.text_buffer(pa.array(texts)))[0])
    assert sorted(np.concatenate([np.frombuffer(x.words, "<u2") for x in got]).tolist()) == sorted(words.tolist())


def test_directions_of_all_passages(spark):
    """The product equals that of plain matrices, and the directions are those of a full decomposition."""
    r = np.random.default_rng(3)
    near = [r.choice(1 << d.BITS, 8, replace=False) for _ in range(6)]
    rows = [r.choice(near[i % 6], r.integers(16, 33)) for i in range(900)]
    idf = r.random(1 << d.BITS).astype(np.float32) + 0.5
    a = np.zeros((len(rows), 1 << d.BITS), np.float32)
    for i, x in enumerate(rows):
        np.add.at(a[i], x, idf[x])
    a /= np.sqrt((a * a).sum(axis=1))[:, None]
    basis = r.standard_normal((1 << d.BITS, 5)).astype(np.float32)
    common, place = np.unique(near[0]), np.full(1 << d.BITS, -1)
    place[common] = np.arange(len(common))
    total = np.zeros_like(basis)
    d._add_product(total, idf, np.concatenate(rows), np.cumsum([0, *map(len, rows)]), basis, common, place)
    assert np.abs(total - a.T @ (a @ basis)).max() < 1e-3
    df = spark.createDataFrame([(x.astype("<u2").tobytes(),) for x in rows], "words binary").repartition(3)
    got, values = d.latent_basis(spark, df, idf, rank=6, extra=10)
    want = np.linalg.svd(a[:, np.unique(np.concatenate(near))], full_matrices=False)[1][:6]
    assert np.abs(values - want).max() < 0.02 * want[0]
    assert np.linalg.norm(a - (a @ got) @ got.T) < 1.05 * np.sqrt((a * a).sum() - (want * want).sum())


def test_long_items(spark):
    r = random.Random(11)
    words = [f"w{r.randrange(30_000)}" for _ in range(12_000)]
    items = [(1, " ".join(words[:1000]), 0.0), (2, " ".join(words[4000:8000]), 0.0), (3, " ".join(words), 0.0)]
    changed = [w if j % 11 else "other" for j, w in enumerate(words)]
    noise = lambda n: [f"v{r.randrange(30_000)}" for _ in range(n)]
    docs = [(1, " ".join(noise(300) + changed[:1000] + noise(300)), "en", "s", 0), (2, " ".join(noise(50) + changed), "en", "s", 0), (3, " ".join(noise(5000)), "en", "s", 0)]
    got = {(x.doc_id, x.item_id): x for x in d.contaminated(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(items, ITEM)).collect()}
    assert set(got) == {(1, 1), (2, 1), (2, 2), (2, 3)}
    assert all(0.9 < x.lcs_share < 0.92 for x in got.values())


def test_stretches_of_one_copy_are_merged():
    one = d._merged(np.array([0, 1, 0, 0]), np.array([5, 5, 5, 9]), np.array([10, 10, 8, 90]), np.array([50, 60, 48, 120]))
    assert [x.tolist() for x in one] == [[0, 0, 1], [8, 90, 10], [50, 120, 60]]


def test_an_item_is_looked_at_once_in_a_slice(monkeypatch):
    """Candidates of all windows of a slice come together by item, and are those of the single parts."""
    import pyarrow as pa

    r = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    pick = lambda n: " ".join(r.choice(words) for _ in range(n))
    items = [(i, pick(r.randint(18, 60))) for i in range(8)]
    texts = [" ".join([pick(40_000), items[k % 8][1], pick(40_000), items[k % 5][1]]) for k in range(3)]
    table = np.random.default_rng(1).standard_normal(((1 << d.BITS) + 1, d.RANK)).astype(np.float32)
    table[-1] = 0
    block = d.make_items(items, table, np.ones(1 << d.BITS, np.float32))
    h, doc, _, _ = d.hashed_words(*d.text_buffer(pa.array(texts)))
    calls, covered = [], d._covered
    monkeypatch.setattr(d, "_covered", lambda *a: calls.append(a[1]) or covered(*a))
    bounds = np.searchsorted(doc, np.arange(len(texts) + 1))
    found = d._matches(h, doc, bounds, block, table)
    assert {(k, i) for k in range(3) for i in (k % 8, k % 5)} <= {k for k, v in found.items() if v[0] == 1.0}
    assert len(calls) == len(set(calls))
    whole = list(d._gathered(iter([(np.arange(n), np.arange(n) + 7) for n in (3, 1, 4)]), most=4))
    assert [w.tolist() for w, _ in whole] == [[0, 1, 2, 0], [0, 1, 2, 3]] and whole[1][1].tolist() == [7, 8, 9, 10]


def test_product_of_many_passages():
    """Passages of one word to many, words repeated, more of them than are projected at a time."""
    r = np.random.default_rng(6)
    rows = [r.integers(0, 40, n) * 1_500 for n in r.integers(1, 50, d.SOME + 700)]
    idf = r.random(1 << d.BITS).astype(np.float32) + 0.5
    words, at = np.concatenate(rows), np.cumsum([0, *map(len, rows)])
    a = np.zeros((len(rows), 40))
    np.add.at(a, (np.repeat(np.arange(len(rows)), np.diff(at)), words // 1_500), idf[words])
    a /= np.sqrt((a * a).sum(axis=1))[:, None]
    basis, used = r.standard_normal((1 << d.BITS, 3)).astype(np.float32), np.arange(40) * 1_500
    for common in (used[:7], used, used[:0]):
        place, total = np.full(1 << d.BITS, -1), np.zeros_like(basis)
        place[common] = np.arange(len(common))
        d._add_product(total, idf, words, at, basis, common, place)
        want = a.T @ (a @ basis[used])
        assert np.abs(total[used] - want).max() < 1e-4 * np.abs(want).max()
        total[used] = 0
        assert not total.any()
