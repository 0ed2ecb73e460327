"""The inverted index against a loop over all chunks."""

import random

import pytest

from coursemill.operators import retrieval
from coursemill.sources import text_index

C = "chunk_id long, body array<string>, name array<string>"


def corpus(n=300):
    r = random.Random(4)
    words = [f"w{i}" for i in range(40)]
    pick = lambda k: ["all", *(words[min(int(r.expovariate(0.15)), 39)] for _ in range(k))]
    rows = [(r.choice([-1, 1]) * i * 997, pick(r.randint(0, 12)), pick(r.randint(0, 3))[1:]) for i in range(n)]
    return rows + [(5, None, ["w1"]), (6, [], None), (7, [None, "w2"], []), (None, ["w1"], ["w1"])]


def queries():
    r = random.Random(5)
    return [(i, r.choices([f"w{j}" for j in range(40)] + ["all"] * 30, k=r.randint(1, 4))) for i in range(60)] + [(90, ["all"]), (91, ["absent"]), (92, ["all", "absent"]), (93, []), (94, None), (95, ["w1", None, "w1"])]


def brute():
    out = set()
    for q, t in queries():
        t = {x for x in t or [] if x}
        out |= {(q, c) for c, body, name in corpus() if t and c is not None and (t <= set(body or []) or t <= set(name or []))}
    return sorted(out)


@pytest.mark.parametrize("segment", [8, 1 << 14])
def test_search_is_brute_force(spark, tmp_path, monkeypatch, segment):
    monkeypatch.setattr(text_index, "SEGMENT", segment)
    chunks, q = spark.createDataFrame(corpus(), C), spark.createDataFrame(queries(), "query_id long, tokens array<string>")
    text_index.write_index(chunks, str(tmp_path / "index"), buckets=4)
    index = text_index.read_index(spark, str(tmp_path / "index"))
    assert sorted(map(tuple, text_index.search(q, index, buckets=4).collect())) == brute()
    assert sorted(map(tuple, retrieval.keyword_matches(q, chunks).collect())) == brute()
    assert max(r.n for r in index.collect()) <= segment


def test_frequencies(spark):
    chunks = spark.createDataFrame([(1, ["a", "a", "b"], ["x"]), (2, ["a"], [])], C)
    got = text_index.frequencies(text_index.postings(text_index.exploded(chunks))).collect()
    assert sorted((r.token, r.part, r.chunks, r.occurrences) for r in got) == [("a", "body", 2, 3), ("b", "body", 1, 1), ("x", "name", 1, 1)]


def test_no_chunks_and_no_queries(spark):
    none, q = spark.createDataFrame([], C), spark.createDataFrame([(1, ["a"])], "query_id long, tokens array<string>")
    assert retrieval.keyword_matches(q, none).count() == 0
    assert retrieval.keyword_matches(q.where("query_id > 1"), spark.createDataFrame(corpus(), C)).count() == 0


def test_postings_are_grouped_in_partitions_that_grow_with_the_chunks(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    from coursemill.sources import text_index

    asked, before = [], text_index.postings
    monkeypatch.setattr(text_index, "postings", lambda tokens, buckets, partitions=1: asked.append(partitions) or before(tokens, buckets, partitions))
    chunks = spark.range(5000).select(F.col("id").alias("chunk_id"), F.array(F.lit("a")).alias("body"), F.array(F.lit("b")).alias("name"))
    text_index.write_index(chunks, str(tmp_path / "i"))
    assert asked == [-(-5000 // text_index.CHUNKS)]
    assert {(r.token, r.chunks) for r in text_index.frequencies(text_index.read_index(spark, str(tmp_path / "i"))).collect()} == {("a", 5000), ("b", 5000)}
