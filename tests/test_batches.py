"""Slices of Arrow batches."""

import pyarrow as pa

from coursemill.functions import batches


def test_slices_are_bounded_and_whole():
    texts = ["é" * 40, None, "", "x" * 500, "a", "b" * 99, None]
    b = pa.record_batch({"id": list(range(7)), "text": texts})
    got = list(batches.slices(b, 1, 100))
    assert [x for s in got for x in s["id"].to_pylist()] == list(range(7))
    assert all(s.num_rows == 1 or sum(len((t or "").encode()) for t in s["text"].to_pylist()) <= 100 for s in got) and len(got) == 3
    assert list(batches.slices(b.slice(0, 0), 1)) == []


def test_texts_become_strings_in_slices(spark, monkeypatch):
    """What a task makes of a batch of 20 MB is never more than of a slice: the functions get the batch cut."""
    from coursemill.functions import chunker

    held = []
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, of, schema: held.append(of) or self)
    big = pa.record_batch({"id": list(range(400)), "text": ["word " * 10_000] * 400})
    for f in (chunker.cleaned_documents, chunker.chunk_documents):
        f(docs)
        out = list(held.pop()(iter([big])))
        assert len(out) > 5 and max(b.nbytes for b in out) < 2 * batches.SLICE
        assert len({i for b in out for i in b.column(0).to_pylist()}) == 400
