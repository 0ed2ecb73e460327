"""Small documents with the awkward cases that every operator has to take."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def awkward(spark):
    """Null, empty, blank and very long texts, repeated rows, null ids and extra columns that clash with names used inside."""
    r = random.Random(4)
    long = " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(1, 8))) for _ in range(30_000))
    rows = [
        (1, None, "en", "a"), (2, "", "en", "a"), (3, " \n\t ", None, None), (4, long, "en", "a"), (5, "One two three four five six seven eight nine ten.", "en", "b"),
        (5, "One two three four five six seven eight nine ten.", "en", "b"), (6, "One two three four five six seven eight nine ten.", "en", "b"), (None, "No id here.", "en", "a"), (None, None, None, None), (7, "Été à Zürich 日本 😀 end.", "fr", "c"),
    ]
    full = [(*x, len(x[1]) if x[1] is not None else None, -1, "clash", 0.5) for x in rows]
    return spark.createDataFrame(full, f"{DOCS}, id long, fp string, score double")


def empty(spark):
    return spark.createDataFrame([], DOCS)


def prose(r, n, letters="abcdefghijklmnop"):
    return " ".join("".join(r.choice(letters) for _ in range(r.randint(2, 7))) for _ in range(n))
