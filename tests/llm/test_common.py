import random
import re

import numpy as np
import pyarrow as pa

from coursemill.llm import common as c


def test_words_equal_a_pattern(monkeypatch):
    monkeypatch.setattr(c, "PIECE", 64)  # documents longer than a piece
    r = random.Random(1)
    texts = [None, "", " ", "É", *("".join(r.choice("aB éÉß×9-_.\n😀") for _ in range(r.randint(0, 300))) for _ in range(200))]
    data, offsets = c.text_buffer(pa.array(texts))
    h, doc, start, end = c.hashed_words(data, offsets)
    got = [[] for _ in texts]
    raw = data.tobytes()
    for d, a, b in zip(doc.tolist(), start.tolist(), end.tolist(), strict=True):
        got[d].append(raw[a:b].decode())
    want = [re.findall(r"[a-zA-Z0-9\u0080-\U0010ffff]+", t or "") for t in texts]
    assert got == want
    seen = {}
    for x, w in zip(h.tolist(), (w for ws in got for w in ws), strict=True):
        key = re.sub("[A-Z]|[À-ÖØ-Þ]", lambda m: m[0].lower(), w)
        assert seen.setdefault(x, key) == key
    assert len(set(seen.values())) == len(seen)


def test_sliced_arrays_and_slices():
    a = pa.array(["xx", "ab cd", None, "e"]).slice(1)
    data, offsets = c.text_buffer(a)
    assert len(c.hashed_words(data, offsets)[0]) == 3
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 10] * 7), pa.array(range(7))], ["t", "i"])
    parts = list(c.slices(batch, "t", 25))
    assert [p.num_rows for p in parts] == [2, 2, 2, 1] and sum((p.column(1).to_pylist() for p in parts), []) == list(range(7))
    assert list(c.slices(batch.slice(0, 0), "t")) == []


def test_no_documents():
    assert all(len(x) == 0 for x in c.hashed_words(np.zeros(0, np.uint8), np.zeros(1, np.int64)))
