"""Both tokenizers' alignment against encoders that read whole texts, and loops over tokens."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from coursemill.llm import token_align as t

from .helpers import DOCS, awkward, empty, prose

CASES = [
    "", " ", "   ", "\n", "a", " a", "a ", "a  b\tc\nd \n e\n\n\nf", "tab\t then blank", "don't can't I'll WE'VE", "x▁y", "▁", "naïve café 日本語テキスト 😀😀 é", "<s> </s> <|endoftext|> <unk> <0x41>",
    "\x00\x1c \x1f x\x85y z w　 v", "a" * 500, " " * 700 + "b", "1234567890 12 1a2b", "!!! ??? ...,,, --- ''' \"\"\"", "\r\n a\r\n\r\nb \r", "a\x1c b", "ﬁ ① Ⅳ", "﻿ bom", "word " * 50,
]


@pytest.fixture(scope="module")
def sides():
    return t.Sides(t.TOKENIZERS)


@pytest.fixture(scope="module")
def whole():
    a = Tokenizer.from_file(f"{t.TOKENIZERS}/byte_bpe_50k.json")
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=f"{t.TOKENIZERS}/piece_bpe_32k.model")


def brute(whole, sides, texts):
    """Rows without ids, by reading each whole text once and walking both sides' ends."""
    docs, counts = [], Counter()
    for text in texts:
        a, b = ([], []) if not text else (whole[0].encode(" " + text, add_special_tokens=False).ids, whole[1].encode(text))
        if not text or any(b"".join(names[i] for i in ids) != (" " + text).encode() for names, ids in ((sides.a_bytes, a), (sides.b_bytes, b))):
            docs.append(([], []))
            continue
        ends = [set(np.cumsum([len(names[i]) for i in ids]).tolist()) for names, ids in ((sides.a_bytes, a), (sides.b_bytes, b))]
        both = ends[0] & ends[1]
        groups = []
        for names, ids in ((sides.a_bytes, a), (sides.b_bytes, b)):
            out, at = [[]], 0
            for i in ids:
                out[-1].append(i)
                at += len(names[i])
                if at in both:
                    out.append([])
            groups.append(out[:-1])
        docs.append(groups)
        counts.update({(x, y) for g, h in zip(*groups, strict=True) for x in g for y in h})
    best = defaultdict(int)
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    rows = []
    for g, h in docs:
        links = [(x, y) for p, q in zip(g, h, strict=True) for x in p for y in q]
        said = ";".join(f"{','.join(map(str, p))}|{','.join(map(str, q))}" for p, q in zip(g, h, strict=True))
        rows.append((sum(map(len, g)), sum(map(len, h)), len(g), len(links), sum(counts[x] == best[x[0]] for x in links), sum(counts[x] for x in links), hashlib.sha256(said.encode()).hexdigest() if g else ""))
    return rows


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_segments_are_encoded_as_whole_texts(sides, whole):
    assert sides.parted
    r = random.Random(3)
    letters = "ab e.,'\n\t\r 日é😀 \x1c ▁-1'sT"
    texts = CASES + ["".join(r.choice(letters) for _ in range(r.randint(1, 60))) for _ in range(1500)]
    for text in texts:
        parts = sides.segments(text)
        assert "".join(parts) == (" " + text if text else "")
        a, b = sides.encode(parts)
        if "▁" not in text and text:
            assert sum(a, []) == whole[0].encode(" " + text, add_special_tokens=False).ids, repr(text)
            assert sum(b, []) == whole[1].encode(text), repr(text)


def test_every_token_is_what_its_bytes_merge_to(sides, whole):
    """With ids in the order of merges, this makes merging by rank equal to merging by the list."""
    vocab = whole[0].get_vocab()
    assert all([x.id for x in whole[0].model.tokenize(k)] == [i] for k, i in vocab.items() if k != "<|endoftext|>")
    assert sides.encode_a(" " * 300_000 + "x") == whole[0].encode(" " * 300_000 + "x").ids


def test_alignment_is_brute_force(spark, sides, whole, monkeypatch):
    r = random.Random(5)
    texts = CASES + [prose(r, r.randint(1, 80)) for _ in range(40)] + ["same text of many"] * 40 + ["日" * 400 + "x̀" * 50, "".join(chr(r.randint(0x4E00, 0x9FFF)) for _ in range(300))]
    rows = [(i, x, "en", "s", len(x)) for i, x in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS).repartition(5)
    monkeypatch.setattr(t, "SLICE", 500)
    got = t.alignment(df)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    got = sorted(tuple(x) for x in got.collect())
    for mine, theirs, text in zip(got, brute(whole, sides, texts), texts, strict=True):
        assert mine[1:] == theirs, repr(text)


def test_large_groups_are_counted_in_parts(sides):
    a = t.align(sides, [" " + "é" * 3000, " x"], links=50)
    b = t.align(sides, [" " + "é" * 3000, " x"])
    assert (a.pairs == b.pairs).all() and (a.times == b.times).all() and a.written == b.written


def test_memory_forgets(sides):
    r = random.Random(1)
    texts = [prose(r, 30) for _ in range(20)]
    m, few = t.Memory(sides), t.Memory(sides, most=5)
    for i in range(0, 20, 4):
        x, y = t.align_documents(m, texts[i : i + 4]), t.align_documents(few, texts[i : i + 4], links=7)
        assert {k: list(v) for k, v in x[0].items()} == {k: list(v) for k, v in y[0].items()} and (x[1] == y[1]).all() and (x[2] == y[2]).all()


def test_postings_are_packed_and_unpacked():
    for docs, times in (([0, 3, 2], [1, 1, 2]), ([70000, 70001, 1], [1, 300, 1])):
        ids, n, doc, k = t.unpack(t.pack(np.array([5, 5, 31999]), np.array(docs), np.array(times)))
        assert (ids.tolist(), n.tolist(), doc.tolist(), k.tolist()) == ([5, 31999], [2, 1], docs, times)


def test_awkward_and_empty(spark, sides, whole):
    rows = awkward(spark)
    got = sorted(map(str, (tuple(x) for x in t.alignment(rows).collect())))
    given = [(x.doc_id, x.text or "") for x in rows.collect()]
    assert got == sorted(str((i, *b)) for (i, _), b in zip(given, brute(whole, sides, [x for _, x in given]), strict=True))
    assert t.alignment(empty(spark)).count() == 0
