"""The rules whose edges the driver's tables don't show."""

import re

import pytest
from pyspark.sql import functions as F

from coursemill.functions import text as T
from coursemill.operators import graph, sync

LONG = "word " * 70


def value(spark, f, *args):
    return spark.createDataFrame([args], ", ".join(f"c{i} string" for i in range(len(args)))).select(f(*(F.col(f"c{i}") for i in range(len(args)))).alias("x")).first().x


@pytest.mark.parametrize(("html", "empty"), [(">", True), ("<p", True), ("\xa0<br> ", True), ("<p>a", False), ("a <", False), ("> b", False), ("<<p>>", True), ("", True), ("\n\t<a\nb>\r", True)])
def test_html_without_text(spark, html, empty):
    assert value(spark, T.no_text_in_html, html) is empty


@pytest.mark.parametrize(
    ("reply", "kind"),
    [('{"kind":"exam","confidence":0.5} Hope that helps!', None), ('{"kind":"exam","confidence":0.5}', "exam"), ('```json\n{"kind":"exam","confidence":2}\n```', "exam"), ('{"kind":"exam","confidence":0.5},{"kind":"exam","confidence":0.5}', None), ("", None), ('{"kind":"exam"}', None)],
)
def test_replies(spark, reply, kind):
    got = value(spark, lambda c: T.verdict(c, ("exam",)), reply)
    assert (got and got.kind) == kind


@pytest.mark.parametrize(
    ("text", "ends"),
    [(LONG + "\n- item\n\n", True), (LONG + "\n| a | b |\n\n", True), (LONG + "\n- item.\n", False), (LONG + "\n\t| a.", False), (LONG + "end.", True), (LONG + "end. \n", True), (LONG + "end", False), (LONG + "```\n\n", False), (LONG + "\n* a.\r\n", False), ("short.\n\n", False)],
)
def test_sentence_boundaries(spark, text, ends):
    assert value(spark, T.sentence_boundary, text) is ends


@pytest.mark.parametrize(
    ("url", "got"),
    [("https://play.example.org/", None), ("https://play.example.org", None), ("https://x.example/v?p=a%20b+c&q=1", "a b c"), ("https://x.example/v/w/?q=1", "w"), ("https://x.example/v#p=1", "v"), ("https://x.example/v?p=&p=2", "2"), ("https://x.example/a/b;v=1", "b"), ("https://x.example/v?p=%zz", "%zz")],
)
def test_url_ids(spark, url, got):
    assert value(spark, T.url_id, url) == got


@pytest.mark.parametrize(("name", "inside"), [("d@x@uni.example", True), ("a b@uni.example", True), ("a@x_y.uni.example", True), (" A@Uni.Example\t", True), ("@uni.example", False), ("a@otheruni.example", False), ("uni.example", False), ("a@uni.example@", False)])
def test_realms(spark, name, inside):
    assert value(spark, lambda c: T.in_realm(c, "uni.example"), name) is inside


def test_excerpt_notes_what_is_left_out(spark):
    assert value(spark, T.excerpt, "a" * 8500 + "b" * 1000 + "c" * 1500) == "a" * 8500 + "\n\n[… 1000 characters omitted …]\n\n" + "c" * 1500


def test_teacher_roles(spark):
    at = "http://purl.imsglobal.org/vocab/lis/v2/"
    yes = ["membership#Instructor", "institution/person#Instructor", "membership#ContentDeveloper", "institution/person#Faculty", "system/person#Administrator", "institution/person#Administrator", "membership#Administrator"]
    for name in [*yes, "membership/Instructor#TeachingAssistant", "membership#Learner"]:
        assert value(spark, sync.teaches, at + name) is (name in yes)
    assert value(spark, sync.teaches, "Instructor") is False


def test_rejections_are_taken_back(spark):
    e = spark.createDataFrame([(1, 2, "a", False), (1, 2, "b", True), (3, 4, "a", True)], "src long, dst long, relation string, rejected boolean")
    v = e.where("rejected").select("src", "dst", "relation")
    e1, v1 = graph.reject_edges(e, v, spark.createDataFrame([(1, 2, "a"), (9, 9, "a")], "src long, dst long, relation string"))
    assert sorted(map(tuple, e1.collect())) == [(1, 2, "a", True), (1, 2, "b", True), (3, 4, "a", True)] and v1.count() == 3
    e2, v2 = graph.unreject_edges(e1, v1, spark.createDataFrame([(1, 2, "b")], "src long, dst long, relation string"))
    assert sorted(map(tuple, e2.collect())) == [(1, 2, "a", True), (1, 2, "b", False), (3, 4, "a", True)]
    assert sorted(map(tuple, v2.collect())) == [(1, 2, "a"), (3, 4, "a")]


def test_suggested_questions(spark):
    courses = spark.createDataFrame([("young", 1.0, None), ("unasked", None, None), ("none", 30.0, []), ("gone", 30.0, [1]), ("same", 30.0, [2, 1])], "course_id string, age_hours double, seen array<long>")
    docs = spark.createDataFrame([("same", 1, 1, "ready"), ("same", 2, 2, "ready")], "course_id string, doc_id long, created long, status string")
    assert {r.course_id: r.state for r in sync.suggestion_state(courses, docs).collect()} == {"young": "keep", "unasked": "make", "none": "touch", "gone": "make", "same": "touch"}


def test_course_codes_of_any_text(spark):
    """Brackets character by character, tokens one by one, as the rule says."""
    import random

    r = random.Random(8)
    pieces = [*"()[]{}- -", "MAR", "s", "AB", "hi", "DIST", "x", "åß", " ", "\t", "7", "MARS", "--", "\n", "$1\\"]
    titles = ["", "-", "S-AB-", "MAR-MAR", "(S) AB", None, "))a((", *("".join(r.choice(pieces) for _ in range(r.randint(1, 14))) for _ in range(3_000))]

    def code(title):
        depth, flat = 0, ""
        for c in title:
            if c in "([{":
                depth += 1
            elif c in ")]}":
                depth = max(depth - 1, 0)
            elif not depth:
                flat += c
        parts = [p for p in re.split(r"[-\s]+", flat.upper()) if p]
        return "-".join([p for p in parts if p not in T.SECTION_MARKERS] or parts) or None

    got = spark.createDataFrame([(t,) for t in titles], "t string").select("t", T.course_code(F.col("t")).alias("c")).collect()
    assert len(got) == len(titles) and [x for x in got if x.c != (None if x.t is None else code(x.t))] == []


def test_suggestions_leave_lone_courses_out_before_lists(spark):
    rows = [(1, "a", "X", "X-B", None), (2, "a", "X", "X-A", 1), (3, "a", "X", "X-B", 0), (4, "b", "X", "X", 0), (5, None, "Y", "Y", 1), (6, None, "Y", "Y", 1), (7, "a", None, "", 0), (8, "a", None, "", 0)]
    found = sync.merge_suggestions(spark.createDataFrame(rows, "course_id long, semester string, core string, code string, name int"))
    assert sorted(map(tuple, found.collect()), key=str) == [("a", "X", [2, 1, 3], 3), (None, "Y", [5, 6], 2)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("collect_list") < plan.index("(n#") < plan.index("Window")
