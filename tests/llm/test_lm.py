"""The network against numeric gradients and plain loops; counts and scores of documents against brute force."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from coursemill.llm import gru
from coursemill.llm import lm_score as lm

from .helpers import DOCS, awkward, empty

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def small(seed=0):
    shape, r = gru.Shape(4, 2, 3, 2, 3, 3), np.random.default_rng(seed)
    flat = gru.initial(shape, np.array([5, 4, 3, 2]), np.arange(1, 7)) + r.normal(0, 0.3, shape.size()).astype(np.float32)
    return shape, flat, r.integers(0, 9, 60), r.integers(0, 8, 60), np.array([0, 7, 7, 20, 60])


def plain_score(shape, flat, inputs, targets):
    """A document's log probability, word by word in double precision."""
    p = {k: v.astype(np.float64) for k, v in shape.view(flat).items()}
    h, n, total = np.zeros(shape.hidden), shape.hidden, 0.0
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    for x, y in zip(inputs, targets, strict=True):
        i, a = p["x"][x] @ p["w"] + p["b"], h @ p["u"]
        r, z = sigmoid(i[:n] + a[:n]), sigmoid(i[n : 2 * n] + a[n : 2 * n])
        c = np.tanh(i[2 * n :] + r * a[2 * n :])
        h = (1 - z) * c + z * h
        c = y // shape.words if y < shape.head else y - shape.head + shape.heads
        logit = h @ p["wc"] + p["bc"]
        total += logit[c] - np.log(np.exp(logit).sum())
        if y < shape.head:
            logit = h @ p["wo"][c] + p["bo"][c]
            total += logit[y % shape.words] - np.log(np.exp(logit).sum())
    return total


def test_gradient_is_numeric():
    shape, flat, inputs, targets, offsets = small()
    t = gru.Trainer(shape, flat, np.zeros(len(flat)), 2, 60)
    x, y, _, begins, active = next(gru.windows(inputs, targets, offsets, 2, 60))
    h = np.zeros((2, 4), np.float32)
    _, grad, _ = t.gradient(x, y, begins, active, h)
    for i in range(0, len(flat), 3):
        held, sides = t.flat[i], []
        for d in (1e-2, -1e-2):
            t.flat[i] = held + d
            sides.append(t.gradient(x, y, begins, active, h)[0])
        t.flat[i] = held
        assert abs((sides[0] - sides[1]) / 2e-2 - grad[i]) < 5e-3


def test_score_carries_the_state_over_windows():
    shape, flat, inputs, targets, offsets = small(1)
    want = [plain_score(shape, flat, inputs[a:b], targets[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    for n, steps in ((1, 3), (2, 4), (9, 100)):
        assert np.allclose(gru.score(shape, flat, inputs, targets, offsets, n, steps), want, atol=1e-4)


def test_training_learns_what_follows():
    shape = gru.Shape(8, 2, 4, 2, 3, 4)
    seq = np.tile([1, 5, 2, 7], 2000)
    offsets = np.arange(0, len(seq) + 1, 100)
    inputs = np.concatenate([[0], seq[:-1]])
    flat = gru.initial(shape, np.array([1, 1, 1, 1]), np.ones(8))
    t = gru.Trainer(shape, flat, np.full(len(flat), 1e-8), 8, 16)
    for _ in range(5):
        t.learn(inputs, seq, offsets)
    per_word = gru.score(shape, t.flat, inputs, seq, offsets).sum() / len(seq)
    assert per_word > -0.5 > gru.score(shape, flat, inputs, seq, offsets).sum() / len(seq)


def corpus(n=150):
    r = random.Random(8)
    kinds = [[f"{k}{i}" for i in range(60)] for k in ("a", "B", "é")]
    out = []
    for i in range(n):
        w = kinds[i % 3]
        out.append((i, " ".join(w[min(int(r.expovariate(0.1)), 59)] for _ in range(r.randint(1, 90))) + r.choice(["", f"\n once{i} once{i}", " \t"]), "en", "s", 0))
    return out


def brute(rows):
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 5 == 1
    tokens = [(i, [*words(t), None]) for i, t in rows]
    c = Counter(w for i, ws in tokens if not held(i) for w in ws)
    n, v = sum(c.values()), len(c)
    return [(i, held(i), len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)) for i, ws in tokens]


def same(got, want):
    assert len(got) == len(want)
    key = lambda x: (x[0] is None, x[0] or 0, x[2], x[5])
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert tuple(a)[:5] == b[:5] and abs(a[5] - b[5]) < 1e-6 * (1 + abs(b[5])) and a[6] <= 0 and math.isfinite(a[6])


def test_counts_and_base_are_brute_force(spark):
    df = spark.createDataFrame(corpus(), DOCS).repartition(3)
    for hot in (lm.HOT, 20):
        got = lm.lm_scores(df, hot=hot)
        assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        got = got.collect()
        same(got, brute([(r[0], r[1]) for r in corpus()]))
        # Words of one kind foretell each other, so the network beats the counts on documents that it hasn't seen.
        unseen = [r for r in got if r.held_out]
        assert sum(r.score for r in unseen) > sum(r.base_score for r in unseen)


def test_probabilities_add_up_to_one(spark):
    """Over all words, the end and the unseen word, at some state."""
    rows = spark.createDataFrame(corpus(), DOCS).selectExpr("doc_id AS _id", "text AS _text")
    counts = lm.count_words(rows).persist()
    lexicon = lm.learn_lexicon(counts, hot=30)
    flat = lm.train(rows, lexicon, rows._id % 16)
    state = np.random.default_rng(0).normal(0, 1, (1, lexicon.shape.hidden)).astype(np.float32)
    log = lambda target: float(gru.log_probs(lexicon.shape.view(flat), lexicon.shape, state, np.array([target]), gru.classes_of(lexicon.shape, np.array([target])))[0])
    total = math.exp(log(0))
    for i in range(len(lexicon.hashes)):
        total += math.exp(log(lexicon.target[i])) * 10 ** lexicon.within[i]
    hot = set(lexicon.hashes.tolist())
    rare = [r.n for r in counts.collect() if r.h not in hot and r.h != lm.END]
    share = sum((n - lexicon.discount) / lexicon.rare_tokens for n in rare) + lexicon.unseen
    assert abs(share - 1) < 1e-9
    total += math.exp(log(lexicon.shape.head + lexicon.shape.tails - 1)) * share
    assert abs(total - 1) < 1e-3


def test_awkward_and_empty(spark):
    rows = awkward(spark)
    same(lm.lm_scores(rows).collect(), brute([(r.doc_id, r.text) for r in rows.collect()]))
    assert lm.lm_scores(empty(spark)).count() == 0
    none = spark.createDataFrame([(None, "all held out", "en", "s", 1), (None, None, "en", "s", 1)], DOCS)
    same(lm.lm_scores(none).collect(), brute([(None, "all held out"), (None, None)]))
