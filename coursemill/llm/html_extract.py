"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page becomes the sequence of its leaf blocks: runs of text between block-level tags, each
with its path of ancestor tags and their class and id words. Features of path and text score
each block as article or not, transitions score neighbours, and Viterbi picks the sequence.
The field is trained here, on labelled pages that `training_pages` builds from a seed.
"""

from __future__ import annotations

import html
import random
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_list

#: Fixed values of HTML: elements without content, elements whose text isn't shown, block-level elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style template noscript iframe object svg math textarea select".split())
#: Of those: elements that may hold their like, and elements that a slash closes.
NESTED, FOREIGN = frozenset("svg math template object".split()), frozenset("svg math".split())
BLOCK = frozenset(
    "html head body title div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th section article aside nav header footer main form fieldset legend blockquote pre figure figcaption address details summary hr center button label dialog hgroup menu search".split()
)
#: What an opening tag closes when it is open inside the nearest container.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
PARTS = frozenset("article main nav aside header footer form section dialog".split())
BARRIER = frozenset("ul ol dl table div section article aside nav header footer main form body html td blockquote menu".split())

OPEN = re.compile(r"<(?:!--|[!?]|/?[a-zA-Z])")
NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
#: From a place between attributes: the tag's end, or one attribute up to its unquoted value's end or its value's opening quote. A quote anywhere else is a character of a name or value.
STEP = re.compile(r"""[\s/]*+(?:(>)|([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:(["'])|([^\s>]*+)))?+)""")
NAMING = frozenset(("class", "id", "role"))
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Leaf:
    """One leaf block: its tag, its ancestors' distinct names from the outermost, the nearest part of the page, and distinct words of the ancestors' class, id and role."""

    tag: str
    path: tuple
    part: str
    words: tuple
    text: str
    linked: int
    marks: dict = field(default_factory=dict)


def tag_finder(page: str) -> Callable[[int], tuple | None]:
    """A function that gives the next tag from a position on: (start, end, slash, name or None for a comment, words of its class, id and role).

    Quoted values have any length; where no '>' follows outside quotes, the next one ends the
    tag. Positions from which that was seen are kept, so ascending calls are linear together.
    """
    last, dead = page.rfind(">"), set()
    last_quote = {q: page.rfind(q) for q in "\"'"}

    def close(first: int) -> tuple[int, tuple]:
        p, seen, words = first, [], []
        while p <= last and p not in dead:
            seen.append(p)
            m = STEP.match(page, p)
            if not m:
                break
            if m[1]:
                return m.start(1), tuple(words)
            a, p = (m.end(), m.end()) if m[3] else (m.start(4), m.end())
            if m[3]:
                if a > last_quote[m[3]]:
                    break
                p = page.find(m[3], a)
            if m.end(2) - m.start(2) < 6 and m[2].lower() in NAMING and a > 0:
                words += [w.lower() for w in WORD.findall(page, a, p)]
            p += bool(m[3])
        dead.update(seen)
        return page.find(">", first), tuple(words)

    def following(at: int) -> tuple | None:
        while m := OPEN.search(page, at):
            start = m.start()
            if m[0] == "<!--":
                end = page.find("-->", m.end())
                return start, end + 3 if end >= 0 else len(page), "", None, ()
            if start < last:
                if m[0] in ("<!", "<?"):
                    return start, page.find(">", start) + 1, "", None, ()
                n = NAME.match(page, start)
                end, words = close(n.end())
                return start, end + 1, n[1], n[2], words
            at = m.end()
        return None

    return following


def hidden_end(page: str, name: str, at: int) -> int:
    """Where a hidden element that was opened before `at` ends: at its own closing tag, or with the page. Those that may hold their like are counted in and out."""
    depth = 1
    for m in re.compile(rf"<(/?){re.escape(name)}(?=[\s/>])[^>]*>", re.IGNORECASE).finditer(page, at, page.rfind(">") + 1):
        if m[1]:
            depth -= 1
        elif name in NESTED and not (name in FOREIGN and m[0].endswith("/>")):
            depth += 1
        if not depth:
            return m.end()
    return len(page)


class Stack:
    """The open elements, with what is asked about them kept up to date: no question looks through all of them."""

    def __init__(self) -> None:
        self.names: list[str] = []
        self.said: list[tuple] = []
        self.at: dict[str, list[int]] = {}  # places of each open name; names in the order of their outermost
        self.words: dict[str, int] = {}
        self.barriers: list[int] = []
        self.blocks: list[str] = []
        self.parts: list[str] = []

    def push(self, name: str, words: tuple) -> None:
        i = len(self.names)
        self.names.append(name)
        self.said.append(words)
        self.at.setdefault(name, []).append(i)
        for w in words:
            self.words[w] = self.words.get(w, 0) + 1
        for kept, kinds, x in ((self.barriers, BARRIER, i), (self.blocks, BLOCK, name), (self.parts, PARTS, name)):
            if name in kinds:
                kept.append(x)

    def pop_to(self, i: int) -> None:
        while len(self.names) > i:
            name = self.names.pop()
            self.at[name].pop()
            if not self.at[name]:
                del self.at[name]
            for w in self.said.pop():
                self.words[w] -= 1
                if not self.words[w]:
                    del self.words[w]
            for kept, kinds in ((self.barriers, BARRIER), (self.blocks, BLOCK), (self.parts, PARTS)):
                if name in kinds:
                    kept.pop()

    def close(self, name: str) -> None:
        """A closing tag ends the innermost element of its name; one that isn't a block doesn't reach out of its container."""
        if name in self.at:
            i = self.at[name][-1]
            if name in BLOCK or not self.barriers or i >= self.barriers[-1]:
                self.pop_to(i)

    def make_room(self, name: str) -> None:
        """An opening block ends paragraphs, and what it stands beside, inside the nearest container that isn't such itself."""
        ends = ("p", *CLOSES.get(name, ()))
        low = next((i for i in reversed(self.barriers) if self.names[i] not in ends), -1)
        first = [places[k] for t in ends if (places := self.at.get(t)) and (k := bisect_right(places, low)) < len(places)]
        if first:
            self.pop_to(min(first))


def leaf_blocks(page: str) -> list[Leaf]:
    """The leaf blocks of a page in order; unclosed and stray tags are taken as browsers mostly do.

    Linear in the page but for a block's distinct ancestor names and words, however deep it is.
    """
    stack = Stack()
    out: list[Leaf] = []
    parts: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Leaf(stack.blocks[-1] if stack.blocks else "body", tuple(stack.at), stack.parts[-1] if stack.parts else "body", tuple(stack.words), text, linked))
            parts.clear()
        linked = 0

    def text(a: int, b: int) -> None:
        nonlocal linked
        if a < b:
            parts.append(page[a:b])
            if "a" in stack.at:
                linked += b - a

    at, following = 0, tag_finder(page)
    while found := following(at):
        start, end, slash, name, words = found
        text(at, start)
        at = end
        if name is None:
            continue
        name = name.lower()
        if name in BLOCK:
            flush()
        if slash:
            stack.close(name)
            continue
        if name in HIDDEN:
            if not (name in FOREIGN and page[end - 2] == "/"):  # elsewhere the slash means nothing
                at = hidden_end(page, name, at)
            continue
        if name == "br":
            parts.append(" ")
        if name in VOID:
            continue
        if name in BLOCK:
            stack.make_room(name)
        stack.push(name, words)
    text(at, len(page))
    flush()
    return out


#: Names that sites give to parts of a page.
ARTICLE_NAMES = "article content post entry story main body text blog news single page prose detail".split()
OTHER_NAMES = {
    "nav": "nav menu navbar navigation breadcrumb breadcrumbs links toc pagination pager skip tabs dropdown".split(),
    "header": "header masthead top topbar banner logo brand site title tagline head".split(),
    "footer": "footer foot copyright legal bottom colophon credits site imprint".split(),
    "sidebar": "sidebar side aside related widget recommended popular trending more rail secondary archive tags".split(),
    "notice": "cookie consent gdpr notice alert popup modal newsletter subscribe overlay warning message paywall toast announcement".split(),
    "ad": "ad ads advert advertisement sponsor sponsored promo promotion banner commercial adsense dfp".split(),
    "form": "form search login signup register contact subscribe input field".split(),
    "comments": "comments comment reply replies discussion responses respond disqus thread reader feedback".split(),
    "share": "share social sharing follow buttons meta byline author tools".split(),
}


def features(blocks: list[Leaf]) -> list[list[str]]:
    """Names of the features that hold for each block."""
    out = []
    for i, b in enumerate(blocks):
        n = b.text.count(" ") + 1
        link = b.linked / max(len(b.text), 1)
        f = ["bias", f"tag={b.tag}", f"words={min(n.bit_length(), 7)}", f"link={0 if link < 0.2 else 1 if link < 0.7 else 2}"]
        f += [f"in={t}" for t in b.path]
        # The block's tag under the nearest part of the page: a paragraph right in an article differs from a box in it.
        f.append(f"under={b.part}>{b.tag}")
        f += [f"name={w}" for w in b.words]
        f += [f"named={kind}" for kind, names in OTHER_NAMES.items() if not set(b.words).isdisjoint(names)]
        f.append(f"end={b.text[-1] if b.text[-1] in '.!?:,;' else 'other'}")
        if "©" in b.text:
            f.append("copyright")
        if b.tag in ("h1", "h2", "h3"):
            f.append("heading")
        if i < 3:
            f.append(f"start={i}")
        if i >= len(blocks) - 2:
            f.append(f"last={len(blocks) - 1 - i}")
        out.append(f)
    return out


@dataclass(frozen=True)
class Field:
    """Scores by feature for (other, article), start and transitions."""

    weights: dict
    start: tuple
    move: tuple

    def decode(self, blocks: list[Leaf]) -> list[int]:
        if not blocks:
            return []
        (a, b), (aa, ab, ba, bb) = self.start, self.move
        back, none = [], (0.0, 0.0)
        for i, names in enumerate(features(blocks)):
            x = y = 0.0
            for n in names:
                p, q = self.weights.get(n, none)
                x += p
                y += q
            if i:
                to_a, to_b = (0, a + aa) if a + aa >= b + ba else (1, b + ba), (0, a + ab) if a + ab > b + bb else (1, b + bb)
                back.append((to_a[0], to_b[0]))
                a, b = to_a[1] + x, to_b[1] + y
            else:
                a, b = a + x, b + y
        state, out = int(b > a), [int(b > a)]
        for pair in reversed(back):
            state = pair[state]
            out.append(state)
        return out[::-1]


# Labelled pages -------------------------------------------------------------------------

OTHER_TAGS = {
    "nav": ("nav", "ul", "div"), "header": ("header", "div"), "footer": ("footer", "div"), "sidebar": ("aside", "div", "section"), "notice": ("div", "section", "dialog"),
    "ad": ("div", "aside", "section", "p"), "form": ("form", "div"), "comments": ("section", "div", "ol"), "share": ("div", "ul"),
}


class _Maker:
    """Builds a page and the label of each leaf block's text."""

    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)
        self.labels: dict[str, int] = {}
        self.n = 0

    def say(self, label: int, low: int, high: int, stop: bool = True) -> str:
        self.n += 1
        r = self.r
        key = f"w{self.n}q"  # makes each text one of a kind
        words = [key] + ["".join(r.choice("abcdefghilmnoprstu") for _ in range(r.randint(1, 9))) for _ in range(r.randint(low, high) - 1)]
        if r.random() < 0.2:
            r.shuffle(words)
        text = " ".join(words)
        text = text[0].upper() + text[1:] + (r.choice("..!?") if stop and r.random() < 0.9 else "")
        self.labels[key] = label
        return text

    def named(self, tag: str, names: list, inner: str, chance: float = 0.8) -> str:
        r = self.r
        attrs = ""
        if r.random() < chance:
            joiner = r.choice(["-", " ", "_"])
            attrs = f' {r.choice(["class", "id", "class"])}="{joiner.join(r.sample(names, r.choice([1, 1, 2])))}"'
        return f"<{tag}{attrs}>{inner}</{tag}>"

    def links(self, low: int, high: int) -> str:
        items = [f'<a href="/x">{self.say(0, 1, 3, False)}</a>' for _ in range(self.r.randint(low, high))]
        return f"<ul>{''.join(f'<li>{i}</li>' for i in items)}</ul>" if self.r.random() < 0.7 else "".join(f"<div>{i}</div>" for i in items)

    def other(self, kind: str) -> str:
        r = self.r
        tag = r.choice(OTHER_TAGS[kind])
        if kind == "nav":
            inner = self.links(2, 8)
        elif kind == "header":
            inner = (f"<h1>{self.say(0, 1, 4, False)}</h1>" if r.random() < 0.5 else f"<div>{self.say(0, 1, 4, False)}</div>") + (f"<p>{self.say(0, 3, 10)}</p>" if r.random() < 0.5 else "") + (self.links(2, 5) if r.random() < 0.4 else "")
        elif kind == "footer":
            inner = (f"&copy; {self.say(0, 1, 14)}" if r.random() < 0.6 else f"<p>{self.say(0, 3, 20)}</p>") + (self.links(2, 6) if r.random() < 0.4 else "")
        elif kind == "sidebar":
            inner = f"<h3>{self.say(0, 1, 4, False)}</h3>" + self.links(2, 6) + (f"<p>{self.say(0, 5, 40)}</p>" if r.random() < 0.6 else "")
        elif kind == "form":
            inner = f"<label>{self.say(0, 1, 4, False)}</label><input><button>{self.say(0, 1, 2, False)}</button>" + (f"<p>{self.say(0, 4, 15)}</p>" if r.random() < 0.4 else "")
        elif kind == "comments":
            each = [f"<{t}>{self.say(0, 2, 60)}</{t}>" for t in [r.choice(["p", "p", "div", "li"])] * r.randint(1, 6)]
            inner = (f"<h3>{self.say(0, 1, 3, False)}</h3>" if r.random() < 0.6 else "") + "".join(self.named("div", OTHER_NAMES[kind], e, 0.5) if r.random() < 0.5 else e for e in each)
        elif kind == "share":
            inner = self.links(1, 4) if r.random() < 0.5 else f"<span>{self.say(0, 1, 5, False)}</span>"
        else:
            inner = self.say(0, 3, 40) if r.random() < 0.6 else f"<p>{self.say(0, 3, 40)}</p>" + (f"<button>{self.say(0, 1, 2, False)}</button>" if r.random() < 0.5 else "")
        # A tag that says what it is may stand without a name; others are named.
        return self.named(tag, OTHER_NAMES[kind], inner, 0.6 if tag not in ("div", "section", "p", "ul", "ol") else 1.0)

    def article(self) -> str:
        r = self.r
        out = [f"<h1>{self.say(1, 1, 12, False)}</h1>"] if r.random() < 0.85 else []
        for _ in range(r.randint(1, 14)):
            kind = r.random()
            long = r.choice([(1, 6), (5, 40), (30, 120), (60, 200)])
            if kind < 0.68:
                inner = self.say(1, *long)
                out.append(f"<p>{r.choice(['', '', '<b>'])}{inner}{r.choice(['', '', '<br>'])}" + r.choice(["</p>", "</p>", ""]))
            elif kind < 0.76:
                out.append(f"<{(h := r.choice(['h2', 'h3', 'h4']))}>{self.say(1, 1, 8, False)}</{h}>")
            elif kind < 0.82:
                out.append(f"<ul>{''.join(f'<li>{self.say(1, 2, 25)}</li>' for _ in range(r.randint(1, 5)))}</ul>")
            elif kind < 0.86:
                out.append(f"<blockquote>{self.say(1, 5, 40)}</blockquote>")
            elif kind < 0.9:
                out.append(f"<div>{self.say(1, *long)}</div>")
            elif kind < 0.93:
                out.append(f"<pre>{self.say(1, 3, 20)}</pre>")
            elif kind < 0.95:
                out.append(f"<table><tr><td>{self.say(1, 1, 6)}</td><td>{self.say(1, 1, 6)}</td></tr></table>")
            elif kind < 0.97:
                out.append(f'<p><a href="/y">{self.say(1, 2, 8, False)}</a> {self.say(1, 10, 50)}</p>')
            else:
                out.append(f"<figure><img><figcaption>{self.say(1, 2, 15)}</figcaption></figure>")
        # Things that are not the article also stand between its paragraphs.
        for kind in r.sample(["ad", "share", "notice", "comments", "form", "sidebar"], r.choice([0, 0, 1, 2, 3])):
            out.insert(len(out) if kind == "comments" else r.randint(1, len(out)), self.other(kind))
        tag = r.choice(["article", "article", "article", "main", "div", "section"])
        body = self.named(tag, ARTICLE_NAMES, "".join(out), 0.5 if tag in ("article", "main") else 1.0)
        return self.named(r.choice(["main", "div"]), [*ARTICLE_NAMES, "wrapper", "container"], body) if r.random() < 0.4 else body

    def page(self) -> str:
        r = self.r
        before = [k for k in ("notice", "header", "nav", "form", "ad", "sidebar") if r.random() < 0.45]
        after = [k for k in ("comments", "share", "sidebar", "ad", "form", "notice", "nav") if r.random() < 0.3]
        parts = [*map(self.other, before), self.article(), *map(self.other, after)]
        if r.random() < 0.8:
            parts.append(self.other("footer"))
        body = "".join(parts)
        if r.random() < 0.3:
            body = self.named("div", ["page", "wrapper", "container", "site", "layout"], body)
        return f"<html><head><title>{self.say(0, 1, 12, False)}</title></head><body>{body}</body></html>"


def training_pages(n: int = 500, seed: int = 1) -> Iterator[tuple[list[Leaf], list[int]]]:
    """(leaf blocks, labels) of built pages."""
    for i in range(n):
        maker = _Maker(seed * 1_000_003 + i)
        blocks = leaf_blocks(maker.page())
        labels = []
        for b in blocks:
            keys = re.findall(r"w\d+q", b.text.lower())
            labels.append(maker.labels[keys[0]])
        yield blocks, labels


@lru_cache(maxsize=4)
def train_field(n: int = 500, seed: int = 1, rounds: int = 120, decay: float = 2e-4) -> Field:
    """Maximum likelihood with a square penalty: forward-backward over all pages at once, one padded step at a time."""
    data = list(training_pages(n, seed))
    number: dict[str, int] = {}
    rows, cols, n_blocks, starts, y = [], [], 0, [], []
    for blocks, labels in data:
        starts.append(n_blocks)
        for names in features(blocks):
            for name in names:
                rows.append(n_blocks)
                cols.append(number.setdefault(name, len(number)))
            n_blocks += 1
        y += labels
    rows, cols, y, starts = np.array(rows), np.array(cols), np.array(y), np.array(starts)
    size = np.diff(np.append(starts, n_blocks))
    steps = int(size.max())
    at = np.minimum(starts[:, None] + np.arange(steps), n_blocks - 1)
    real = np.arange(steps) < size[:, None]
    d = len(number)
    theta, m, v = np.zeros(2 * d + 6), np.zeros(2 * d + 6), np.zeros(2 * d + 6)
    one = np.eye(2)[y]
    seen = np.zeros((2, 2))
    inner = np.ones(n_blocks, bool)
    inner[starts] = False
    np.add.at(seen, (y[:-1][inner[1:]], y[1:][inner[1:]]), 1)
    for i in range(1, rounds + 1):
        w, start, move = theta[: 2 * d].reshape(d, 2), theta[2 * d : 2 * d + 2], theta[2 * d + 2 :].reshape(2, 2)
        e = np.column_stack([np.bincount(rows, weights=w[cols, k], minlength=n_blocks) for k in (0, 1)])
        ep = e[at]
        alpha, beta = np.zeros((len(starts), steps, 2)), np.zeros((len(starts), steps, 2))
        alpha[:, 0] = ep[:, 0] + start
        for t in range(1, steps):
            new = np.logaddexp(alpha[:, t - 1, 0, None] + move[0], alpha[:, t - 1, 1, None] + move[1]) + ep[:, t]
            alpha[:, t] = np.where(real[:, t, None], new, alpha[:, t - 1])
        for t in range(steps - 2, -1, -1):
            ahead = beta[:, t + 1] + ep[:, t + 1]
            new = np.logaddexp(move[:, 0] + ahead[:, 0, None], move[:, 1] + ahead[:, 1, None])
            beta[:, t] = np.where(real[:, t + 1, None], new, 0)
        total = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
        p = np.exp(alpha + beta - total[:, None, None])
        pair = np.exp(alpha[:, :-1, :, None] + move + (ep + beta)[:, 1:, None, :] - total[:, None, None, None]) * real[:, 1:, None, None]
        marg = np.zeros((n_blocks, 2))
        marg[at[real]] = p[real]
        diff = (marg - one) / n_blocks
        g = np.concatenate([np.column_stack([np.bincount(cols, weights=diff[rows, k], minlength=d) for k in (0, 1)]).ravel(), diff[starts].sum(axis=0), ((pair.sum(axis=(0, 1)) - seen) / n_blocks).ravel()])
        g += decay * theta
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta - 0.2 * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)
    w = theta[: 2 * d].reshape(d, 2)
    return Field({k: (float(w[i, 0]), float(w[i, 1])) for k, i in number.items()}, tuple(theta[2 * d : 2 * d + 2].tolist()), tuple(theta[2 * d + 2 :].tolist()))


def main_text(page: str, model: Field) -> str:
    blocks = leaf_blocks(page)
    return "\n".join(b.text for b, keep in zip(blocks, model.decode(blocks), strict=True) if keep)


def extract_pages(pages: DataFrame, model: Field | None = None) -> DataFrame:
    """pages(page_id, url, html) -> (page_id, url, text, n_chars): one row per row, from the whole html.

    A null or empty page, and one without article blocks, has the text "". Repeated rows and
    null ids and urls stay as they are; other columns aren't looked at.
    """
    model = model or train_field()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [main_text(t, model) for t in text_list(b.column(2))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(of, "page_id long, url string, text string, n_chars long")
