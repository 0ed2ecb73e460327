"""Cuts by masks against a pattern, and outputs put back together."""

import hashlib
import random
import re

from coursemill.llm import fim

from .helpers import DOCS, awkward, empty

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(doc_id, text):
    t = text or ""
    units = UNIT.findall(t)
    n = len(units)
    x = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(x[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    plain = not t or any(k in t for k in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50
    form = "plain" if plain else "spm" if h[3] % 100 < 80 else "psm"
    out = {"plain": t, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
    return doc_id, n, form, None if plain else len(p), None if plain else len(m), out


def texts():
    r = random.Random(2)
    return ["", " ", "a", " a", "a ", "a  b\t\n", "<P>x", "x<P", "<S", "S> <M", "M>", "<<S>", "é 日本 😀  x\x85y z ", *("".join(r.choice("ab <PSM>\n\té日😀\xa0") for _ in range(r.randint(1, 80))) for _ in range(400))]


def test_ends_and_selection():
    for t in texts():
        raw, at = t.encode(), 0
        want = [at := at + len(u.encode()) for u in UNIT.findall(t)]
        bits = fim.unit_ends(raw)
        assert bits.bit_count() == len(want)
        assert [fim.select(bits, len(raw), k + 1) + 1 for k in range(len(want))] == want


def test_documents_are_brute_force(spark):
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, DOCS)
    made = fim.fill_in_middle(df)
    assert made.columns == ["doc_id", "text", "lang", "source", "n_chars", "n", "form", "prefix_chars", "middle_chars"]
    want = sorted(brute(i, t) for i, t, *_ in rows)
    assert sorted((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.text) for r in made.collect()) == want
    assert {w[2] for w in want} == {"plain", "psm", "spm"}
    back = fim.restored(made, made.text, made.form).collect()
    assert all(r.restored == rows[r.doc_id][1] for r in back)


def test_awkward_and_empty(spark):
    rows = awkward(spark)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = [(*b[:5], sha(b[5]), sha(x.text or "")) for x in rows.collect() for b in [brute(x.doc_id, x.text)]]
    assert sorted(map(str, want)) == sorted(str(tuple(x)) for x in fim.fim_digests(rows).collect())
    kept = fim.fill_in_middle(rows.withColumnRenamed("score", "form"))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars", "id", "fp", "n", "form", "prefix_chars", "middle_chars"] and kept.count() == rows.count()
    assert fim.fim_digests(empty(spark)).count() == 0
