import random
import re

from coursemill.llm import substring_dedup as s

from .helpers import awkward, empty, prose

SPANS = re.compile(r"\d+:\d+")


def test_passages_inside_other_text(spark):
    r = random.Random(9)
    sentence = lambda n: prose(r, n).capitalize() + "."
    passage = " ".join(sentence(12) for _ in range(6))
    docs = [(i, f"{sentence(9)} {prose(r, 4)} {passage if i % 2 else sentence(15)} {prose(r, 6)} 😀 {sentence(10)}\n{sentence(9)}") for i in range(20)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {x.doc_id: x for x in s.documents_with_repeats(df).collect()}
    assert sorted(got) == list(range(3, 20, 2))
    text = dict(docs)
    for i, row in got.items():
        assert row.kept_in == [1]
        cut = [text[i][slice(*map(int, m.split(":")))] for m in SPANS.findall(row.removed)]
        assert all(c in passage for c in cut) and sum(len(c.split()) for c in cut) == row.words_removed >= 60


def passages(spans, min_passage, gap=s.GAP):
    """(start, end, words) of passages that are long enough."""
    out, run = [], []
    for span in [*spans, None]:
        if run and (span is None or span[0] - run[-1][1] > gap):
            out += run if sum(x[2] for x in run) >= min_passage else []
            run = []
        run.append(span)
    return out


def brute(docs, min_words=s.MIN_WORDS, min_passage=0):
    """Units by plain splitting: each sentence, and a line of which a sentence is too short."""
    seen, out = set(), {}
    for i, t in sorted(set(docs), key=lambda d: d[0]):
        found, at = [], 0
        for line in (t or "").split("\n"):
            ends = [k + 1 for k in range(len(line) - 1) if line[k] in ".!?" and line[k + 1].isspace()]
            spans = [(a, b) for a, b in zip([0, *ends], [*ends, len(line)], strict=True) if line[a:b].split()]
            if len(spans) > 1 and any(len(line[a:b].split()) < min_words for a, b in spans):
                spans.insert(0, (0, len(line)))
            found += [(at + b - len(line[a:b].lstrip()), at + b, " ".join(line[a:b].lower().split())) for a, b in spans if len(line[a:b].split()) >= min_words]
            at += len(line) + 1
        known: set = set()
        again, reach = [], -1
        for a, b, key in sorted(found, key=lambda u: (u[0], -u[1])):
            if (key in seen or key in known) and b > reach:
                again.append((a, b, len(key.split())))
                reach = b
            known.add(key)
        out[i] = passages(again, min_passage)
        seen |= known
    return {i: ",".join(f"{a}:{b}" for a, b, _ in v) for i, v in out.items() if v}


def test_lines_of_short_sentences(spark):
    line = "One! Two! Three four. Five six seven! Eight."
    df = spark.createDataFrame([(1, line), (2, f"Before.\n{line}\nAfter it."), (3, "One! Two! Other words.")], "doc_id long, text string")
    got = {x.doc_id: x.removed for x in s.documents_with_repeats(df, min_passage=0).collect()}
    assert got == {2: f"8:{8 + len(line)}"}


def test_against_brute_force(spark):
    r = random.Random(10)
    lines = [prose(r, n, "ab") + r.choice([".", "", "!"]) for n in [3, 8, 9, 12] * 8]
    docs = [(i, r.choice(["\n", " ", "\n \n"]).join(r.choice(lines) for _ in range(r.randint(0, 8)))) for i in range(200)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for least in (0, s.MIN_PASSAGE):
        got = {x.doc_id: x.removed for x in s.documents_with_repeats(df, min_passage=least).collect()}
        assert got == brute(docs, min_passage=least)


def test_a_lone_short_line_stays(spark):
    r = random.Random(12)
    line, long = "Subscribe to our letter and never miss any news.", prose(r, 55) + "."
    docs = [(i, f"{prose(r, 20)}.\n{line}\n{prose(r, 15)}." + (f"\n{long}" if i > 3 else "")) for i in range(6)]
    assert [x.doc_id for x in s.documents_with_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()] == [5]


def test_normalised_and_ranked(spark):
    line = "One TWO three  four five six\tseven eight nine."
    df = spark.createDataFrame([(1, line, 5), (2, line.lower(), 1), (3, "x\n" + line + "\ny", None)], "doc_id long, text string, rank long")
    got = {x.doc_id: x.removed for x in s.documents_with_repeats(df, rank_col="rank", min_passage=0).collect()}
    assert got == {1: f"0:{len(line)}", 3: f"2:{2 + len(line)}"}
    kept = {x.doc_id: (x.text, x.removed_spans) for x in s.remove_repeats(df, rank_col="rank", min_passage=0).collect()}
    assert kept[1][0] == "" and kept[2] == (line.lower(), None) and kept[3][0] == "x\n\ny" and kept[3][1][0].start == 2


def test_awkward_rows(spark):
    got = {x.doc_id: x.removed for x in s.documents_with_repeats(awkward(spark), min_passage=0).collect()}
    assert got == {6: "0:49"}  # the repeated row 5 is one document
    assert s.documents_with_repeats(empty(spark)).count() == 0
    assert s.remove_repeats(awkward(spark)).count() == 10


bare = lambda text: "".join(text.split())


def removed_words(spark, docs):
    """By id: what is removed, without blanks, and its words."""
    rows = s.documents_with_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    text = dict(docs)
    return {x.doc_id: ("".join(bare(text[x.doc_id][slice(*map(int, m.split(":")))]) for m in SPANS.findall(x.removed)), x.words_removed) for x in rows}


def test_passages_of_short_sentences(spark):
    r = random.Random(13)
    sentence = lambda n: prose(r, n).capitalize() + "."
    short = [sentence(7) for _ in range(8)]
    for joint in (" ", "\n"):
        docs = [(i, f"{sentence(12)} {joint.join(short)} {sentence(4)} {sentence(15)}") for i in range(3)]
        assert removed_words(spark, docs) == {i: (bare(joint.join(short)), 56) for i in (1, 2)}
    # Not a passage: the same short sentences in other orders.
    docs = [(i, f"{sentence(12)} {' '.join(r.sample(short, 2))} {sentence(15)} {' '.join(short[i : i + 1])}") for i in range(3)]
    assert removed_words(spark, docs) == {}


def test_long_sentences_apart_by_short_ones(spark):
    r = random.Random(14)
    sentence = lambda n, of=prose: of(r, n).capitalize() + "."
    mixed = " ".join(sentence(n) for n in (9, 7, 7) * 3)
    docs = [(i, f"{sentence(12)} {mixed} {sentence(15)}") for i in range(3)]
    assert removed_words(spark, docs) == {i: (bare(mixed), 69) for i in (1, 2)}
    # A lone short sentence of over GAP code points stays but parts nothing.
    lone = " ".join("".join(r.choice("abcdef") for _ in range(12)) for _ in range(7)) + "."
    a, b = sentence(9), sentence(9)
    docs = [(i, f"{sentence(12)} {a} {lone} {b} {sentence(15)}") for i in range(3)]
    assert len(lone) > s.GAP and removed_words(spark, docs) == {i: (bare(a + b), 18) for i in (1, 2)}


def test_text_without_blanks(spark):
    r = random.Random(15)
    han = lambda n: "".join(chr(r.randrange(0x4E00, 0x9000)) for _ in range(n)) + "。"
    passage = "".join(han(n) for n in (24, 9, 9, 30, 20))
    docs = [(i, f"{han(25)}{passage}{han(40)}") for i in range(3)]
    assert {i: t for i, (t, _) in removed_words(spark, docs).items()} == {1: passage, 2: passage}
    token = "".join(r.choice("abcdef0123456789") for _ in range(400))
    assert {i: t for i, (t, _) in removed_words(spark, [(i, f"{prose(r, 9)}\n{token}\n{prose(r, 9)}") for i in range(2)]).items()} == {1: token}


def test_the_first_of_a_text_that_repeats_itself_stays(spark):
    beat = "Ha ha now. Ho ho ho."
    docs = [(1, " ".join([beat] * 20))]
    got, words = removed_words(spark, docs)[1]
    assert bare(docs[0][1]).endswith(got) and 14 <= words <= 120 - 9
