"""Chunker, topics, pseudonyms and text sources: what SQL can't say."""

import random
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from coursemill.functions import chunker
from coursemill.functions import text as T
from coursemill.operators import durable, graph, queues, sync, topics
from coursemill.sources import archives
from coursemill.sources.text import html_text, text_files


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab. \né日"), max_size=900), st.integers(20, 120))
def test_chunks_are_bounded_and_end(text, size):
    parts = chunker.chunk_text(text, size, size // 8)
    assert all(0 < len(p.encode()) <= size for p in parts)
    kept = "".join(chunker.clean_text(text).split())
    # Nothing but white space and boilerplate is lost: what is left of each paragraph is a part of the chunks' text, in order.
    at, joined = 0, "".join("".join(parts).split())
    for c in kept:
        at = joined.find(c, at)
        assert at >= 0


def test_chunks_of_awkward_texts():
    assert chunker.chunk_text("") == []
    assert chunker.chunk_text("One line.") == ["One line."]
    assert chunker.chunk_text("x\n" * 3 + "y") == ["y"]
    assert len(chunker.chunk_text("a " + "b" * 3000)) >= 2
    assert all(len(c.encode()) <= 2000 for c in chunker.chunk_text("日" * 5000))


def test_chunks_overlap_and_join_as_measured():
    words = lambda letter, n: (letter * 9 + " ") * (n // 10 - 1) + letter * 10
    one, two = words("a", 1900), words("b", 1900)
    parts = chunker.chunk_text(f"{one}\n\n{two}")
    assert parts[0] == one
    # The second chunk begins with the end of the first, though its paragraph alone would fit.
    assert parts[1].startswith(one[-250:].strip() + "\n" + two[:100]) and len(parts) == 3 and parts[2].endswith(two[-100:])
    # Two paragraphs of exactly the size together share a chunk; the line break between them makes it one byte too long, so it is cut.
    assert [len(p) for p in chunker.chunk_text("c" * 1000 + "\n\n" + "d" * 1000)][0] == 2000
    assert chunker.chunk_text("c" * 1001 + "\n\n" + "d" * 1000)[0] == "c" * 1001
    assert chunker.clean_text("head\r\na\r\nhead\nb\nhead\n") == "a\nb"


def one_row(spark, value, *texts):
    df = spark.createDataFrame([texts], ", ".join(f"c{i} string" for i in range(len(texts))))
    return df.select(value(*[F.col(f"c{i}") for i in range(len(texts))]).alias("x")).first().x


def test_headings_and_repeats(spark):
    prior = "#Über  uns: heute\n\t**Next steps!**\nNext things\n# One"
    assert one_row(spark, T.headings, prior) == ["über uns heute", "next steps", "one"]
    assert one_row(spark, T.headings, "****\n**\n#\n###   \n** x **\nplain **bold** text") == ["x"]
    assert one_row(spark, T.heading_repeat, "## one\n## next STEPS", prior) == "next steps"
    assert one_row(spark, T.heading_repeat, "## One", prior) is None


def test_tails(spark):
    end = "".join(chr(97 + i * i % 23) for i in range(150))
    assert one_row(spark, T.tail_repeat, end[:80], end) is None  # under 150 bytes
    assert one_row(spark, T.tail_repeat, end, f"x{end}y") == 0
    assert one_row(spark, T.tail_repeat, "head " + end, f"x{end}y") == 5
    assert one_row(spark, T.tail_repeat, "é" * 76 + end[:1], "é" * 80 + end[:1]) == 2  # 153 bytes, back to the beginning of a character
    assert one_row(spark, T.tail_repeat, end[:60] + " " * 90, end) is None  # under 75 bytes are left
    assert one_row(spark, T.tail_repeat, end, "") is None


def test_citations(spark):
    cite = lambda s, *chunks: [int(x) for x in one_row(spark, lambda c: T.citation_numbers(c, F.array(*map(F.lit, chunks)) if chunks else None), s)]
    assert cite("[1] 【#2】 〔3〕 [4】 (5) (#6) [#x] [ 7 ]") == [1, 2, 3, 4]
    assert cite("【A.b(c).PDF】 [other.txt] [a.B(C).pdf ]", "none", "[Source: a.b(c).pdf]\nx", "[Source: a.b(c).pdf]") == [2, 2]


def test_codes_slugs_titles_and_headers(spark):
    assert one_row(spark, T.course_code, "mar-({x)]algo hi") == "ALGO"
    assert one_row(spark, T.course_code, "[IB-VT2") is None
    assert one_row(spark, T.slug, " Été à Zürich: 日本!") == "Été_à_Zürich_日本"
    assert one_row(spark, T.slug, "?!") == "untitled"
    assert one_row(spark, T.title, "a" * 58 + "  bcd") == "a" * 58 + "..."
    assert one_row(spark, T.title, " " + "a" * 59) == " " + "a" * 59
    assert one_row(spark, T.source_header, "[Source: a[1].pdf]\ntext") == "a[1].pdf"
    assert one_row(spark, T.source_header, "[Source: a.pdf] text") is None


def test_claims_have_one_claimant(spark):
    rows = spark.createDataFrame([(i, "pending" if i % 3 else "ready", 50 - i, None) for i in range(40)], "doc_id long, status string, created long, started long")
    got = []
    for now in range(4):
        taken = queues.claims(rows, ["a", "b"], 4)
        got += [(r.doc_id, r.claimant) for r in taken.collect()]
        rows = spark.createDataFrame(queues.claimed(rows, taken, F.lit(now).cast("long")).collect(), rows.schema)
    assert len(got) == len({i for i, _ in got}) == 26 and [i for i, _ in got] == [i for i in range(39, -1, -1) if i % 3]
    assert rows.where("status = 'pending'").count() == 0 and rows.where("started is null").count() == 14


def test_upload_keys_and_orphans(spark):
    docs = [(1, "x", "m", "r1", "h1", False), (2, "x", "n", "r1", "h2", False), (3, "x", None, None, "h3", False), (4, "y", "m", "r1", "h4", False), (5, "x", "m", "r5", "h5", True)]
    ups = [(1, "x", "m", "r1", "h1"), (2, "x", "m", "r1", "new"), (3, "x", "m", "r1", "h3"), (4, "x", "o", "r1", "new"), (5, "y", "m", "r1", "h1"), (6, "x", None, "r1", "h2"), (7, "x", "m", "r5", "h5")]
    got = sync.upload_actions(spark.createDataFrame(ups, "upload_id long, course_id string, source_system string, source_ref string, content_hash string"), spark.createDataFrame(docs, "doc_id long, course_id string, source_system string, source_ref string, content_hash string, orphaned boolean"))
    assert {r.upload_id: (r.action, r.doc_id, r.orphaned_id) for r in got.collect()} == {
        1: ("reuse", 1, None), 2: ("insert", None, 1), 3: ("reuse", 3, 1), 4: ("insert", None, None), 5: ("insert", None, 4), 6: ("reuse", 2, None), 7: ("insert", None, None),
    }


def test_one_direction_is_a_veto(spark):
    rows = [(1, 2, "solution_of"), (2, 1, "part_of_unit"), (4, 3, "solution_of"), (3, 4, "applied_in"), (5, 6, "part_of_unit")]
    assert [tuple(r) for r in graph.fully_rejected(spark.createDataFrame(rows, "src long, dst long, relation string")).collect()] == [(1, 2)]


def test_a_cluster_needs_a_named_folder():
    from types import SimpleNamespace as N

    conf = N(get=lambda key, default: default)
    with pytest.raises(ValueError):
        durable.checkpoint_dir(N(sparkContext=N(getCheckpointDir=lambda: None, master="spark://host:7077"), conf=conf))


def test_chunk_rows(spark):
    d = spark.createDataFrame([(1, "a\n\nb"), (2, None), (3, "")], "doc_id long, text string")
    assert [tuple(r) for r in chunker.chunk_documents(d).collect()] == [(1, 0, "a\nb")]


def brute_topics(rows, most=15):
    stop, convs = set(T.STOP_WORDS), defaultdict(set)
    for conv, words in rows:
        for w in words:
            if w not in stop:
                convs[w].add(conv)
        for a, b in zip(words, words[1:], strict=False):
            if not stop & {a, b}:
                convs[f"{a} {b}"].add(conv)
    taken, out = set(), []
    for term, c in sorted(((t, c) for t, c in convs.items() if len(c) >= 2), key=lambda x: (" " not in x[0], -len(x[1]), x[0])):
        if len(c - taken) >= 2 and len(out) < most:
            out.append((len(out) + 1, term, len(c)))
            taken |= c
    return out


def test_popular_topics_against_brute_force(spark):
    r = random.Random(3)
    words = ["graph", "index", "the", "query", "matrix", "about", "proof", "tensor", "limit", "vector"]
    rows = [(c, [r.choice(words) for _ in range(r.randint(1, 5))]) for c in range(60) for _ in range(2)]
    got = topics.popular(spark.createDataFrame([(c, " ".join(w)) for c, w in rows], "conv_id long, text string"))
    assert sorted(map(tuple, got.collect())) == brute_topics(rows)
    assert topics.popular(spark.createDataFrame([], "conv_id long, text string")).count() == 0


def test_pseudonyms_are_unique_and_the_same_again(spark):
    names = spark.range(300).selectExpr("concat('u', id) as name")
    one = {tuple(r) for r in topics.pseudonyms(names, ("a", "b", "c"), ("x", "y"), "s").collect()}
    two = {tuple(r) for r in topics.pseudonyms(names.repartition(3), ("a", "b", "c"), ("x", "y"), "s").collect()}
    assert one == two
    assert len(one) == len({a for _, a in one}) == 300


def test_text_files(spark, tmp_path):
    (tmp_path / "a.md").write_text("héllo\nthere")
    (tmp_path / "b.pdf").write_bytes(b"%PDF")
    (tmp_path / "c.CSV").write_text("1,2")
    assert sorted((r.name, r.text) for r in text_files(spark, str(tmp_path)).collect()) == [("a.md", "héllo\nthere"), ("c.CSV", "1,2")]


def test_html_text_keeps_scripts():
    assert html_text("<p>a &amp;\n b</p><script>x = 1</script><style>p{}</style>") == "a & b x = 1 p{}"
    assert html_text(None) == "" == html_text("")


def test_archive_items(spark, tmp_path):
    import io
    import tarfile

    files = {
        "sections/section_1/section.xml": '<section id="1"><visible>1</visible><availabilityjson>$@NULL@$</availabilityjson></section>',
        "sections/section_2/section.xml": '<section id="2"><visible>0</visible></section>',
        "activities/page_1/module.xml": '<module id="11"><modulename>page</modulename><sectionid>1</sectionid><visible>1</visible></module>',
        "activities/page_1/page.xml": '<activity id="1"><page id="5"><name>Week 1: start!</name><content>Hello</content></page></activity>',
        "activities/page_2/module.xml": '<module id="12"><modulename>page</modulename><sectionid>2</sectionid><visible>1</visible></module>',
        "activities/page_2/page.xml": '<activity id="2"><page id="6"><name>Hidden section</name></page></activity>',
        "activities/page_3/module.xml": '<module id="13"><modulename>page</modulename><sectionid>1</sectionid><visible>1</visible><availability>{"op":"&amp;","c":[{"type":"date","d":"&gt;=","t":100}]}</availability></module>',
        "activities/page_3/page.xml": '<activity id="3"><page id="7"><name>Later</name></page></activity>',
        "broken.xml": "<a>",
    }
    with tarfile.open(tmp_path / "b.mbz", "w:gz") as tar:
        for name, text in files.items():
            info = tarfile.TarInfo(name)
            info.size = len(text.encode())
            tar.addfile(info, io.BytesIO(text.encode()))
    now = sorted((r.kind, r.title, r.text) for r in archives.archive_items(spark, str(tmp_path), 50).collect())
    assert now == [("page", "Hidden_section", ""), ("page", "Week_1_start", "Hello")]  # a module decides for itself
    assert {r.title for r in archives.archive_items(spark, str(tmp_path), 100).collect()} == {"Week_1_start", "Hidden_section", "Later"}


def test_topics_and_their_conversations(spark):
    said = [(1, "graph theory"), (2, "graph theory"), (3, "graph theory basics"), (4, "basics"), (5, "basics"), (None, "basics"), (7, None)]
    m = spark.createDataFrame(said, "conv_id long, text string")
    about = spark.createDataFrame([(1, 10, 4), (2, 10, 1), (3, 11, 2), (4, None, 9)], "conv_id long, user_id long, messages long")
    top = topics.popular(m)
    members = topics.topic_conversations(top, m)
    got = {r.term: (r.conversations, r.unique_users, r.total_messages) for r in topics.topic_overview(members, about).collect()}
    assert got["graph theory"] == (3, 2, 7)
    assert got["basics"] == (4, 1, 11)
    none = spark.createDataFrame([], "conv_id long, text string")
    assert topics.topic_overview(topics.topic_conversations(topics.popular(none), none), about).count() == 0
