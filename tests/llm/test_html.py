import time

from coursemill.llm import html_extract as h

PAGE = """<!DOCTYPE html><html><head><title>Some title</title><style>p{margin:0}</style><script>var t="</p>";</script></head><body>
<nav class="menu"><ul><li><a href="/a">Home</a></li><li><a href="/b">About us</a></li></ul></nav><!-- ad --><div class="cookie-notice">We use cookies. <button>OK</button></div>
<article><h1>A &amp; B</h1><p>First  para\n with <b>bold</b> &eacute;.<br><p>Second one here, with a few more words in it.</p><div class="ad">Buy this thing now.</div><p>Third paragraph.</p></article>
<section id="comments"><h3>Comments</h3><p>I like this a lot, thank you for it.</p></section><aside><p>Related things to read.</p></aside>
<form><label>Search</label><input></form><footer>&copy; example &middot; all rights.</footer></body></html>"""


def test_article_without_the_rest():
    assert h.main_text(PAGE, h.train_field()) == "A & B\nFirst para with bold é.\nSecond one here, with a few more words in it.\nThird paragraph."


def test_held_out_built_pages():
    model, right, total = h.train_field(), 0, 0
    for blocks, labels in h.training_pages(150, seed=99):
        right += sum(a == b for a, b in zip(model.decode(blocks), labels, strict=True))
        total += len(labels)
    assert right / total > 0.97


def test_viterbi_equals_all_sequences():
    from itertools import product

    model = h.train_field()
    for blocks, _ in h.training_pages(40, seed=7):
        blocks = blocks[:8]
        names = h.features(blocks)

        def score(y):
            s = model.start[y[0]] + sum(model.weights.get(n, (0, 0))[y[i]] for i, f in enumerate(names) for n in f)
            return s + sum(model.move[2 * a + b] for a, b in zip(y, y[1:]))

        best = max(score(y) for y in product((0, 1), repeat=len(blocks)))
        assert abs(score(model.decode(blocks)) - best) < 1e-9


def test_broken_markup():
    m = h.train_field()
    for page in ("", "plain text", "<p", "<<<>>", "<p class='", "<script>never closed", "</div></p>", "<p>a<p>b" * 2000, "<div>" * 5000 + "x", '<a href="' * 3000, "<!-- open", "&#0; &amp &bogus; <b>x"):
        h.main_text(page, m)


def test_pages(spark):
    rows = [(1, "u", PAGE, "clash"), (1, "u", PAGE, "clash"), (2, None, None, None), (None, "v", "", ""), (3, "w", "<article><p>" + "word " * 200_000 + "</p></article>", "")]
    got = h.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert len(got) == 5
    assert [(r.text, r.n_chars) for r in got if r.page_id in (2, None)] == [("", 0)] * 2
    assert next(r.n_chars for r in got if r.page_id == 3) == 999_999
    assert h.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_attributes_of_any_length():
    long = "iVBORw0KGgo/+ab>" * 6_250
    model, plain = h.train_field(), h.main_text(PAGE, h.train_field())
    assert len(long) == 100_000
    for quote in "\"'":
        image = PAGE.replace("<p>Second one", f"<p><img src={quote}data:image/png;base64,{long}{quote}>Second one")
        menu = PAGE.replace('<nav class="menu">', f'<nav data-state={quote}{long}{quote} class="menu">').replace('id="comments"', f"data-state={quote}{long}{quote} id='comments'")
        assert h.main_text(image, model) == plain and h.main_text(menu, model) == plain
        assert [(b.tag, b.path, b.words, b.text) for b in h.leaf_blocks(menu)] == [(b.tag, b.path, b.words, b.text) for b in h.leaf_blocks(PAGE)]


def test_broken_tags_end_at_the_next_bracket():
    assert [b.text for b in h.leaf_blocks('<p>One <a href="x>two</a> three</p>')] == ["One two three"]
    assert [b.text for b in h.leaf_blocks("a < b <p")] == ["a < b <p"]


def test_tags_are_found_in_linear_time():
    from time import perf_counter

    for piece in ('<a href="', "<a ", "<a<a", "<!", "<a '\"", "<a \">'", "<a '><b \">"):
        took = []
        for n in (20_000, 200_000):
            began = perf_counter()
            h.leaf_blocks(piece * n)
            took.append(perf_counter() - began)
        assert took[1] < 60 * max(took[0], 0.02), piece


def test_quotes_within_tags():
    long = "A" * 1_000_000
    assert [b.text for b in h.leaf_blocks(f"<article><p>One<img src='data:image/png;base64,{long}'></p><p>Two</p></article>")] == ["One", "Two"]
    assert [b.text for b in h.leaf_blocks("<article><p data-x=it's>One</p><p don't title=a\"b>Two</p></article>")] == ["One", "Two"]
    assert [b.text for b in h.leaf_blocks("<p title = 'a>b' class=\">\">One</p>")] == ["One"]
    assert [b.words for b in h.leaf_blocks("<p data-x='class=no' class=side-Bar ID = \"top nav\" role='main'>One</p>")] == [("side", "bar", "top", "nav", "main")]
    assert [b.text for b in h.leaf_blocks("<p>One</p><p title='never closed>Two</p><p>Three</p>")] == ["One", "Two", "Three"]


def test_hidden_elements_end_at_their_own_closing_tag():
    said = lambda page: [b.text for b in h.leaf_blocks(page)]
    for inner in ('<script src="a.js"/>var a = 1;</script>', "<script src=/js/app/>var t = 1 < 2;</script>", "<textarea/>typed words</textarea>", "<svg><svg>in</svg>more</svg>", "<svg/>", "<math/>", "<svg><svg/>x</svg>", "<template><template>a</template>b</template>", '<style>a<style>b</style>'):
        assert said(f"<p>One.</p>{inner}<p>Two.</p>") == ["One.", "Two."], inner
    assert said("<p>One.</p><svg><svg>never</svg><p>closed</p>") == ["One."]
    assert said("<p>One.</p><script>x</scripty></script><p>Two.</p>") == ["One.", "Two."]


def test_deep_and_unclosed_pages_are_linear():
    n = 30_000
    for page, blocks in (("<div>x" * n, n), ("<p><span>x" * n + "</b>" * n, n), ("<table><a>" + "<span>x" * n + "</a>" * n, 1), ("<svg>x" * n, 0), ("<svg " * n, 0), ("<li>x" * n + "</ul>" * n, n)):
        began = time.process_time()
        found = h.leaf_blocks(page)
        h.features(found)
        assert len(found) == blocks or page.startswith("<svg ")
        assert time.process_time() - began < 10
    deep = h.leaf_blocks("<div class=a><section class='b a'><div><p>x</p></div></section><p>y</p></div>")
    assert [(b.tag, b.path, b.part, b.words) for b in deep] == [("p", ("div", "section", "p"), "section", ("a", "b")), ("p", ("div", "p"), "body", ("a",))]
