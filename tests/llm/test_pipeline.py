import random

import pytest

from .helpers import prose

pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture()
def tables(spark, tmp_path):
    r = random.Random(12)
    docs, labels = [], []
    for i in range(240):
        text = prose(r, r.randint(30, 200))
        if i % 12 == 0:
            text = " ".join(w + "%%%" for w in text.split())
        if i % 12 == 1:
            text += " Mail me.now@mail3.example.com today."
        docs.append((i, text, "en", r.choice(["a", "b", None]), len(text)))
        if i % 3:
            labels.append((i, int(i % 12 != 0), 0))
        elif i % 24 == 0:
            labels.append((i, 0, 0))
    item = prose(r, 40)
    docs[14] = (14, docs[14][1] + " " + item, "en", "a", 0)
    docs[15] = (15, docs[16][1], "en", "b", len(docs[16][1]))
    docs += [(None, None, None, None, None), (900, "", "en", "a", 0)]
    d = tmp_path / "in"
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d)


def test_stages_have_the_order_and_columns(spark, tables):
    assert [n for n, _ in pipeline.STAGES] == ["quality", "simhash", "decontaminate", "pii", "mix"]
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    seen = {}
    for name, f in pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = pipeline.written(f(spark, docs, tables), f"test-{name}")
        seen[name] = (before, docs.collect(), docs.columns)
    first = ["doc_id", "text", "lang", "source", "n_chars"]
    assert all(c == first for n, (_, _, c) in seen.items() if n != "mix") and seen["mix"][2] == [*first, "copy"]
    ids = {n: {r.doc_id for r in rows} for n, (_, rows, _) in seen.items()}
    assert not {i for i in range(0, 240, 12)} & ids["quality"] and len(ids["quality"]) > 200
    # The row without an id is as empty as document 900, which stands for both.
    assert ids["quality"] - ids["simhash"] == {16, None} & ids["quality"] and 16 in ids["quality"]
    assert ids["simhash"] - ids["decontaminate"] == {14}
    masked = {r.doc_id: r for r in seen["pii"][1]}
    assert ids["pii"] == ids["decontaminate"] and "<EMAIL>" in masked[13].text and masked[13].n_chars == len(masked[13].text)
    assert all(r.text == seen["pii"][0][r.doc_id] for r in seen["pii"][1] if "@" not in (seen["pii"][0][r.doc_id] or ""))
    sizes = sum(len((r.text or "").split()) for r in seen["pii"][1])
    mixed = sum(len((r.text or "").split()) for r in seen["mix"][1])
    assert abs(mixed - 1.5 * sizes) < 0.03 * sizes and ids["mix"] <= ids["pii"]
    assert sorted(map(str, pipeline.run(spark, tables).collect())) == sorted(map(str, seen["mix"][1]))


def test_empty_tables_and_clashing_columns(spark, tables, tmp_path):
    r = random.Random(3)
    clash = "_id _fp _n _bad_id _source _copies copies copy c0 c1 id score fingerprint component_id size".split()
    text = prose(r, 60)
    rows = [(1, text, "en", "a", 1), (1, text, "en", "a", 1), (2, text, "en", "b", 1), (3, None, None, None, None), (4, " ".join([prose(r, 50)] * 400), "en", "a", 0), (None, text, "en", "a", 1), (None, prose(r, 40), "en", "a", 1), (5, prose(r, 50), "en", None, 1)]
    full = spark.createDataFrame([(*x, *range(len(clash))) for x in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} long" for c in clash))
    none = full.limit(0)
    for name, f in pipeline.STAGES:
        for docs in (full, none):
            got = f(spark, docs, tables)
            assert set(got.columns) == set(docs.columns) and len(got.columns) == len(set(got.columns))
            if name != "mix":
                assert got.columns == docs.columns
            kept = got.collect()
            assert all(r["_id"] == 0 and r["c0"] == 8 and r["size"] == 14 for r in kept)
            if docs is none:
                assert kept == []
            elif name == "simhash":
                assert sorted((r.doc_id or 0, (r.text or "")[:5]) for r in kept) == sorted([(1, text[:5]), (3, ""), (4, rows[4][1][:5]), (5, rows[7][1][:5]), (0, rows[6][1][:5])])
            elif name in ("decontaminate", "pii"):
                assert len(kept) == len(rows)
            elif name == "mix":
                assert {r.copy for r in kept} <= {1, 2} and 3 not in {r.doc_id for r in kept}
