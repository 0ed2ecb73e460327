import random
import zlib

import numpy as np

from coursemill.llm import quality, toxicity

from .helpers import awkward, empty, prose

LABELS = "doc_id long, quality int, toxic int, score double"


def corpus(spark, n=600, seed=8):
    """Documents whose labels the text explains: marks or stuttered words are bad, a rude word is toxic. A third has no label."""
    r = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = prose(r, r.randint(5, 120)).split()
        bad, toxic = r.random() < 0.2, r.random() < 0.15
        if bad:
            words = [w + "%%%" for w in words] if i % 2 else [w for w in words for _ in range(6)]
        if toxic:
            for _ in range(r.randint(1, 4)):
                words.insert(r.randint(0, len(words)), r.choice(["zzrude", "zzvile", "Zzawful,"]))
        docs.append((i, " ".join(words), "en", "s", 0))
        if r.random() < 0.67:
            labels.append((i, int(not bad), int(toxic), 0.0))
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels, LABELS), {x[0]: x for x in labels}


def agreement(rows, labels, column):
    held = [(r.predicted, labels[r.doc_id][column]) for r in rows if r.held_out and r.doc_id in labels]
    assert len(held) > 50
    return sum(a == b for a, b in held) / len(held)


def test_quality_on_held_out_labels(spark):
    docs, labels, known = corpus(spark)
    rows = quality.quality_scores(docs, labels).collect()
    assert len(rows) == 600 and all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert agreement(rows, known, 1) > 0.95


def test_toxicity_on_held_out_labels(spark):
    docs, labels, known = corpus(spark)
    rows = toxicity.toxicity_scores(docs, labels).collect()
    assert len(rows) == 600 and all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert agreement(rows, known, 2) > 0.95


def test_held_out_labels_are_never_read(spark):
    docs, labels, known = corpus(spark, 300)
    from pyspark.sql import functions as F

    for of, folds, held, column in ((quality.quality_scores, 5, 0, "quality"), (toxicity.toxicity_scores, 3, 1, "toxic")):
        flipped = labels.withColumn(column, F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == held, 1 - F.col(column)).otherwise(F.col(column)))
        assert sorted(map(str, of(docs, labels).collect())) == sorted(map(str, of(docs, flipped).collect()))


def test_awkward_rows(spark):
    docs, labels, _ = corpus(spark, 200)
    for of in (quality.quality_scores, toxicity.toxicity_scores):
        got = of(awkward(spark), labels).collect()
        assert len(got) == 10 and all(r.score is not None and 0 <= r.score <= 1 for r in got)
        assert all(r.held_out for r in got if r.doc_id is None)
        assert of(empty(spark), labels).count() == 0
        none = spark.createDataFrame([], LABELS)
        assert of(awkward(spark), none).count() == 10
        odd = spark.createDataFrame([(None, 1, 1, 0.0), (5, None, None, 0.0), (1, 0, 1, 0.0), (1, 1, 0, 0.0)], LABELS)
        assert of(awkward(spark), odd).count() == 10


def test_risk_steps_are_derivatives_and_clamped():
    r = np.random.default_rng(3)
    positive = np.arange(40) < 10
    log = np.logaddexp
    for shift, back in ((0.0, False), (-9.0, True)):
        z = r.standard_normal(40) + np.where(positive, 6.0 if back else 0.0, shift)
        negative, g = toxicity.nn_risk(z, positive, 0.4)
        assert (negative < 0) == back

        def descended(x):
            part = log(0, x[~positive]).mean() - 0.4 * log(0, x[positive]).mean()
            return -part if back else 0.4 * log(0, -x[positive]).mean() + part

        for i in (0, 5, 12, 39):
            e = np.zeros(40)
            e[i] = 1e-5
            assert abs((descended(z + e) - descended(z - e)) / 2e-5 - g[i]) < 1e-6


def test_positive_unlabelled_fit_ranks_hidden_positives():
    r = np.random.default_rng(4)
    truth = np.concatenate([np.ones(200, bool), r.random(2000) < 0.2])
    x = r.random((2200, 12)) < np.where(truth[:, None], 0.6, 0.2)
    x[:, 6:] = r.random((2200, 6)) < 0.4  # says nothing
    rows, cols = np.nonzero(x)
    w, b = toxicity.fit_nnpu(rows, cols, np.arange(2200) < 200, 12, 0.2)
    assert w[:6].min() > np.abs(w[6:]).max()
    score = x[200:] @ w + b
    hidden, rest = score[truth[200:]], score[~truth[200:]]
    assert (hidden[:, None] > rest).mean() > 0.85
    assert abs((1 / (1 + np.exp(-score))).mean() - 0.2) < 0.08  # the class prior, though no unlabelled text is marked


def test_bradley_terry_fit_equals_newton():
    r = np.random.default_rng(6)
    y = (r.random(300) < 0.7).astype(int)
    x = r.standard_normal((300, 4)) + y[:, None] * np.array([0.8, -0.5, 0.0, 0.2])
    got = quality.fit_ranker(x, y, 0.3, pairs=3000)
    z = np.clip((x - x.mean(axis=0)) / x.std(axis=0), -8, 8)
    rng = np.random.default_rng(5)
    diff = z[rng.choice(np.flatnonzero(y == 1), 3000)] - z[rng.choice(np.flatnonzero(y == 0), 3000)]
    w = np.zeros(4)
    for _ in range(30):
        p = 1 / (1 + np.exp(diff @ w))
        gradient = -(diff * p[:, None]).mean(axis=0) + 1e-3 * w
        w -= np.linalg.solve((diff * (p * (1 - p))[:, None]).T @ diff / len(diff) + 1e-3 * np.eye(4), gradient)
    assert np.abs(got.weights - w).max() < 0.02


def test_ranker_has_all_pairs_and_all_labels(spark):
    """Weights and threshold against Newton over every pair of every labelled row, however many of a label."""
    from pyspark.sql import functions as F

    r = np.random.default_rng(9)
    d, n = len(quality.NAMES), 400
    y = (r.random(n) < 0.7).astype(int)
    x = r.standard_normal((n, d)) + y[:, None] * np.linspace(-0.5, 0.5, d)
    found = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "_id long, x array<double>")
    labels = spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)], "doc_id long, quality int")
    got = quality.train_ranker(found, labels, F.lit(True))
    z = np.clip((x - x.mean(axis=0)) / x.std(axis=0), -8, 8)
    diff = (z[y == 1][:, None, :] - z[y == 0][None, :, :]).reshape(-1, d)
    w = np.zeros(d)
    for _ in range(30):
        p = 1 / (1 + np.exp(diff @ w))
        w -= np.linalg.solve((diff * (p * (1 - p))[:, None]).T @ diff / len(diff) + quality.DECAY * np.eye(d), quality.DECAY * w - (diff * p[:, None]).mean(axis=0))
    assert np.abs(got.weights - w).max() < 2e-3
    s, bad = np.sort(z @ got.weights), int((y == 0).sum())
    assert abs(got.threshold - (s[bad - 2] + s[bad]) / 2) < 1e-9


def test_kth_value(spark):
    r = random.Random(3)
    values = sorted([r.gauss(0, 1) for _ in range(300)] + [0.5] * 200)
    rows = spark.createDataFrame([(v,) for v in values], "s double")
    assert [quality.kth(rows, k, 10) for k in (0, 7, 250, 350, 499)] == [values[k] for k in (0, 7, 250, 350, 499)]


def test_a_repeated_labelled_id_counts_once(spark):
    docs, labels, _ = corpus(spark, 200)
    again = docs.where("doc_id = 3 or doc_id = 4")
    many = docs
    for _ in range(4):
        many = many.unionByName(again)
    for of in (quality.quality_scores, toxicity.toxicity_scores):
        one, two = ({r.doc_id: r.score for r in of(x, labels).collect()} for x in (docs, many))
        assert max(abs(one[i] - two[i]) for i in one) < 0.05
