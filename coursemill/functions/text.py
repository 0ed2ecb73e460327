"""Text functions as column expressions; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A short list of our own: frequent words of English that say nothing about a topic.
STOP_WORDS = ("about", "all", "and", "any", "are", "but", "can", "does", "for", "from", "had", "has", "have", "how", "its", "may", "not", "our", "should", "that", "the", "their", "them", "then", "there", "this", "was", "what", "when", "where", "which", "who", "why", "will", "with", "would", "you", "your")
TOKEN_GAP = r"[^\p{L}\p{N}']+"


def extension(name: Column, default: str = "bin") -> Column:
    """What follows the last dot, lower case; the default where there is none."""
    return F.lower(F.coalesce(F.nullif(F.regexp_extract(name, r"\.([^./\\]+)$", 1), F.lit("")), F.lit(default)))


def topic_tokens(text: Column) -> Column:
    """Lower-case words of letters, digits and apostrophes: over two bytes before and after apostrophes at their ends are trimmed."""
    words = F.filter(F.split(F.lower(text), TOKEN_GAP), lambda w: F.octet_length(w) > 2)
    return F.filter(F.transform(words, lambda w: F.regexp_replace(w, "^'+|'+$", "")), lambda w: F.octet_length(w) > 2)


def paragraphs(text: Column) -> Column:
    """What blank lines part, trimmed, without empty parts."""
    return F.filter(F.transform(F.split(text, "\n\n"), stripped), lambda p: p != "")


def bigrams(tokens: Column) -> Column:
    """Neighbouring tokens joined by a space."""
    return F.when(F.size(tokens) > 1, F.zip_with(F.slice(tokens, 1, F.size(tokens) - 1), F.slice(tokens, 2, F.size(tokens) - 1), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))


def index_tokens(text: Column, longest: int = 20) -> Column:
    """Words of a text index: lower case, accents of Latin letters folded, 2 to `longest` characters."""
    folded = F.translate(F.lower(text), "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
    return F.array_distinct(F.filter(F.split(folded, r"[^\p{L}\p{N}]+"), lambda w: (F.length(w) >= 2) & (F.length(w) <= longest)))


#: White space of any kind, for a character class.
WHITE = r"\s\x0B\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"


def excerpt(text: Column, whole: int = 10_000, head: int = 8_500, tail: int = 1_500) -> Column:
    """The text, or its head, a note of how much is left out, and its tail."""
    n = F.length(text)
    note = F.concat(F.lit("\n\n[… "), (n - head - tail).cast("string"), F.lit(" characters omitted …]\n\n"))
    return F.when(n <= whole, text).otherwise(F.concat(F.substring(text, 1, head), note, F.right(text, F.lit(tail))))


def slug(text: Column, longest: int = 120) -> Column:
    """Runs of anything but letters, digits, _ and - become one _; none at the ends; "untitled" where nothing is left."""
    s = F.regexp_replace(F.regexp_replace(text, r"[^\p{IsAlphabetic}\p{N}_-]+", "_"), "^_+|_+$", "")
    return F.substring(F.coalesce(F.nullif(s, F.lit("")), F.lit("untitled")), 1, longest)


def suffix_id(text: Column) -> Column:
    """Trailing ASCII digits as a number; null where there are none or too many."""
    return F.regexp_extract(text, "([0-9]+)$", 1).try_cast("long")


def escaped(text: Column) -> Column:
    """The five characters that HTML needs escaped."""
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    for c, e in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(c), F.lit(e))
    return out


def no_text_in_html(html: Column) -> Column:
    """Is nothing but white space, of any kind, left when tags are dropped? A bracket that closes nothing goes, and one that isn't closed takes the rest with it."""
    return F.regexp_replace(html, r"<[^>]*(>|\z)|>", "").rlike(rf"\A[{WHITE}]*\z")


def user_key(name: Column, source: Column, user: Column) -> Column:
    """Trimmed and lower case; made of source and id where there is no name."""
    return F.coalesce(F.nullif(F.lower(F.trim(name)), F.lit("")), F.concat(F.lit("lti_"), source, F.lit("_"), user))


def url_id(url: Column) -> Column:
    """The first query parameter p that isn't empty, decoded, else the last part of the path; null where the path is empty, whatever the host."""
    p = F.nullif(F.regexp_extract(F.regexp_extract(url, r"\A[^?#]*\?([^#]*)", 1), r"(?:\A|&)p=([^&]+)", 1), F.lit(""))
    path = F.regexp_extract(url, r"\A(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    path = F.regexp_replace(F.regexp_replace(path, r";[^/]*\z", ""), r"/+\z", "")
    return F.coalesce(F.try_url_decode(p), p, F.nullif(F.regexp_extract(path, r"([^/]*)\z", 1), F.lit("")))


#: Tokens of a course code that mark a variant of the course.
SECTION_MARKERS = ("MAR", "DIST", "HI", "S", "AB", "CD")


def course_code(title: Column) -> Column:
    """Upper case without what brackets hold, split at hyphens and white space, marker tokens dropped unless all are, joined by hyphens; null if empty.

    Brackets of any kind nest and close each other; an open one hides the rest, and one that
    closes nothing is dropped.
    """
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("out"))

    def step(at: Column, part: Column) -> Column:
        opens, closes = part.rlike(r"\A[(\[{]"), part.rlike(r"\A[)\]}]")
        depth = F.when(opens, at["depth"] + 1).when(closes, F.greatest(at["depth"] - 1, F.lit(0))).otherwise(at["depth"])
        return F.struct(depth.alias("depth"), F.when(depth > 0, at["out"]).otherwise(F.concat(at["out"], F.when(opens | closes, F.substring(part, 2, (1 << 31) - 1)).otherwise(part))).alias("out"))

    # Titles are folded a bracket at a time, and only those that have one.
    open_text = F.when(title.rlike(r"[()\[\]{}]"), F.aggregate(F.split(title, r"(?=[()\[\]{}])"), start, step)["out"]).otherwise(title)
    tokens = F.btrim(F.regexp_replace(F.upper(open_text), r"(?U)[-\s]+", "-"), F.lit("-"))
    real = F.btrim(F.regexp_replace(F.concat(F.lit("-"), tokens, F.lit("-")), f"(?<=-)(?:{'|'.join(SECTION_MARKERS)})-", ""), F.lit("-"))
    return F.when(real != "", real).when(tokens != "", tokens)


def semester_ok(label: Column) -> Column:
    return F.upper(F.trim(label)).rlike("^[VH]T20[0-9]{2}$")


def semester_key(label: Column) -> Column:
    """Year, half a year more for autumn; minus infinity for what isn't a semester."""
    s = F.upper(F.trim(label))
    year = F.substring(s, 3, 4).try_cast("double")
    return F.when(semester_ok(label), year + F.when(s.startswith("HT"), 0.5).otherwise(0.0)).otherwise(F.lit(float("-inf")))


def semesters_of(day: Column) -> Column:
    """The semester of a date and the next one."""
    y = F.year(day)
    label = lambda term, year: F.concat(F.lit(term), year.cast("string"))
    return F.when(F.month(day) <= 6, F.array(label("VT", y), label("HT", y))).otherwise(F.array(label("HT", y), label("VT", y + 1)))


def in_realm(name: Column, realm: str) -> Column:
    """Is what follows the last @ the realm or a subdomain of it, and something before it? Trimmed, any case; the rest isn't looked at."""
    at = F.regexp_extract(F.lower(stripped(name)), r"(?s)\A.+@([^@]+)\z", 1)
    return (at == realm) | at.endswith(f".{realm}")


def yes(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, r"^[^\p{L}]+|[^\p{L}]+$", "")) == "yes"


def stripped(text: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def tail_repeat(text: Column, prior: Column, tail: int = 150) -> Column:
    """The byte where the end of a text begins, if what came before holds that end already, else null.

    The end is the last `tail` bytes, from the beginning of a character, without white space
    around it; half as many bytes have to be left, and a text under `tail` bytes repeats nothing.
    """
    data = text.cast("binary")
    n = F.octet_length(text)
    inside = lambda at: F.hex(F.substring(data, at + 1, F.lit(1))).between("80", "BF")
    start = F.when(~inside(n - tail), n - tail)
    for back in (1, 2, 3):
        start = start.when(~inside(n - tail - back), n - tail - back)
    end = stripped(F.substring(data, start + 1, n).cast("string"))
    return F.when((n >= tail) & (F.octet_length(end) >= tail // 2) & prior.contains(end), start)


def headings(text: Column) -> Column:
    """Normalised headings: lines that start with # or are bold in whole, lower case, with single spaces for other characters than letters and digits."""
    lines = F.transform(F.split(text, "\n"), stripped)
    marked = F.filter(lines, lambda x: x.startswith("#") | (x.startswith("**") & x.endswith("**") & (F.octet_length(x) > 4)))
    inner = F.transform(marked, lambda x: F.when(x.startswith("#"), x).otherwise(F.substring(x, F.lit(3), F.length(x) - 4)))
    plain = F.transform(inner, lambda x: F.btrim(F.regexp_replace(F.lower(x), r"[^\p{IsAlphabetic}\p{N}]+", " ")))
    return F.filter(plain, lambda x: x != "")


def heading_repeat(text: Column, prior: Column) -> Column:
    """The first heading of two words or more that what came before has too; null if none."""
    there = headings(prior)
    return F.get(F.filter(headings(text), lambda h: h.contains(" ") & F.array_contains(there, h)), F.lit(0))


def source_header(text: Column) -> Column:
    """The file named in a leading [Source: file] line; null where there is none."""
    return F.nullif(F.regexp_extract(text, r"\A\[Source: (.+?)\](?:\n|\z)", 1), F.lit(""))


#: The brackets that a citation may open and close with.
OPENING, CLOSING = "[\\[【〔]", "[\\]】〕]"


def citation_numbers(text: Column, chunks: Column | None = None) -> Column:
    """Numbers cited as n or #n in brackets, which needn't be of one kind, in order.

    With the chunks shown, a file name in brackets (any case, blanks around it) counts as the
    number of the first chunk whose [Source: file] header names it.
    """
    if chunks is not None:
        named = F.transform(chunks, lambda c, i: F.struct(source_header(c).alias("name"), (i + 1).cast("string").alias("n")))
        named = F.filter(named, lambda x: x["name"].isNotNull() & ~x["name"].rlike(f"#|{CLOSING}"))
        # Sources are taken in order, so of two with one name the first gets the citations.
        cited = lambda x: F.concat(F.lit(f"(?iu){OPENING}\\s*\\Q"), F.btrim(x["name"]), F.lit(f"\\E\\s*{CLOSING}"))
        text = F.aggregate(named, text, lambda s, x: F.regexp_replace(s, cited(x), F.concat(F.lit("[#"), x["n"], F.lit("]"))))
    found = F.regexp_extract_all(text, F.lit(f"{OPENING}#?([0-9]+){CLOSING}"), F.lit(1))
    return F.transform(found, lambda m: m.try_cast("int"))


def masked_source(name: Column, text: Column, hidden: Column) -> Column:
    """[Source: file], and the text below it unless the document is hidden."""
    head = F.concat(F.lit("[Source: "), name, F.lit("]"))
    return F.when(hidden, head).otherwise(F.concat(head, F.lit("\n"), text))


def title(text: Column, longest: int = 60) -> Column:
    """The first characters, trimmed and with dots where more follow."""
    return F.when(F.length(text) > longest, F.concat(stripped(F.substring(text, 1, longest)), F.lit("..."))).otherwise(text)


def unfenced(raw: Column) -> Column:
    """Trimmed, without a code fence around it."""
    return F.trim(F.regexp_replace(raw, r"^\s*```(?:json)?\s*|\s*```\s*$|^\s+|\s+$", ""))


def verdict(raw: Column, kinds: tuple) -> Column:
    """struct(kind, confidence) of a classifier's JSON reply, confidence within 0 and 1; null where it isn't JSON from end to end, lacks a field or names an unknown kind."""
    # As the one element of a list, so that nothing may follow it.
    all_of = F.from_json(F.concat(F.lit("["), unfenced(raw), F.lit("]")), "array<struct<kind: string, confidence: double>>")
    got = F.get(all_of, F.lit(0))
    ok = (F.size(all_of) == 1) & got["kind"].isin(*kinds) & got["confidence"].isNotNull()
    return F.when(ok, F.struct(got["kind"].alias("kind"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), got["confidence"])).alias("confidence")))


def last_line(text: Column) -> Column:
    """Trimmed; one line break at the end ends a line and begins none."""
    return F.regexp_replace(F.element_at(F.split(F.regexp_replace(text, r"\n\z", ""), "\n"), -1), rf"\A[{WHITE}]+|[{WHITE}]+\z", "")


def sentence_boundary(text: Column, least: int = 100, long: int = 300) -> Column:
    """May a streamed text be cut at its end? Not in short ones, table rows, open code fences and list items; after a blank line, or a sentence's end in a long one."""
    in_row = lambda line: line.startswith("|") | line.startswith("- ") | line.startswith("* ")
    fences = (F.length(text) - F.length(F.replace(text, F.lit("```"), F.lit("")))) / 3
    body = F.regexp_replace(text, rf"[{WHITE}]+\z", "")
    ended = (F.octet_length(text) > long) & body.rlike(r"[.?!]\z") & ~in_row(last_line(body))
    return (F.octet_length(text) >= least) & ~in_row(last_line(text)) & (fences % 2 == 0) & (text.endswith("\n\n") | ended)


def tool_summary(message: Column, longest: int = 120) -> Column:
    """One line for a tool's reply: its error, its number of results, or its first characters."""
    v = F.try_parse_json(message)
    got = lambda path, kind: F.try_variant_get(v, path, kind)
    listed, inside = got("$", "array<variant>"), got("$.results", "array<variant>")
    left = F.coalesce(got("$.truncated_omitted", "long"), F.lit(0))
    count = lambda a: F.concat(F.size(a).cast("string"), F.lit(" results"))
    more = F.when(left > 0, F.concat(F.lit(" ("), left.cast("string"), F.lit(" more omitted)"))).otherwise(F.lit(""))
    cut = F.when(F.length(message) > longest, F.concat(F.substring(message, 1, longest), F.lit("…"))).otherwise(message)
    error = F.when(F.schema_of_variant(got("$.error", "variant")) == "STRING", got("$.error", "string"))
    return F.coalesce(F.concat(F.lit("error: "), error), count(listed), F.concat(count(inside), more), cut)


def pdf_download(url: Column, raw_hosts: tuple, page_hosts: tuple) -> Column:
    """The path on the host from which a code host serves a PDF file, null for any other address.

    raw_hosts serve /owner/repo/ref/path; page_hosts serve files under raw, blob (a viewer,
    for which raw is asked) and releases.
    """
    parts = F.regexp_extract(F.trim(url), r"^https://([^/?#]+)/([^?#]*)", 0)
    host, path = F.regexp_extract(parts, r"^https://([^/]+)/(.*)$", 1), F.regexp_extract(parts, r"^https://([^/]+)/(.*)$", 2)
    name = F.regexp_extract(path, "([^/]*)$", 1)
    fit = (parts != "") & ~path.contains("..") & F.lower(name).rlike(r".\.pdf$")
    served = path.rlike("^[^/]+/[^/]+/(raw(/[^/]+){2,}|releases/download(/[^/]+){2,}|releases/latest/download/[^/]+)$")
    viewed = path.rlike("^[^/]+/[^/]+/blob(/[^/]+){2,}$")
    raw = F.size(F.filter(F.split(path, "/"), lambda s: s != "")) >= 4
    return F.when(fit & host.isin(*raw_hosts) & raw, path).when(fit & host.isin(*page_hosts) & served, path).when(fit & host.isin(*page_hosts) & viewed, F.regexp_replace(path, "^([^/]+/[^/]+)/blob/", "$1/raw/"))


def pdf_filename(stored: Column, fallback: Column) -> Column:
    """The stored name without .url, as a .pdf; the fallback where nothing is left."""
    name = F.regexp_replace(stored, r"\.url$", "")
    return F.when(name == "", fallback).when(F.lower(name).endswith(".pdf"), name).otherwise(F.concat(name, F.lit(".pdf")))


#: Headings that make a member responsible for a course, as a beginning and in whole.
RESPONSIBLE_START, RESPONSIBLE = "kurs-/delkursansvarig", "kursansvarig"


def member_role(kind: Column, roles: Column) -> Column:
    """struct(role, owner): students are ta; others are teachers, who may own the course if a role says that they are responsible for it."""
    resp = F.exists(roles, lambda r: F.lower(F.trim(r)).startswith(RESPONSIBLE_START) | (F.lower(F.trim(r)) == RESPONSIBLE))
    return F.struct(F.when(kind == "student", "ta").otherwise("teacher").alias("role"), ((kind != "student") & F.coalesce(resp, F.lit(False))).alias("owner"))


def prefixed_query(text: Column, model: Column, models: tuple) -> Column:
    """Models that want queries marked get them so."""
    return F.when(model.isin(*models), F.concat(F.lit("query: "), text)).otherwise(text)


def knob_error(kind: Column, raw: Column, low: Column, high: Column, options: Column) -> Column:
    """What is wrong with a JSON value for a typed setting; null if nothing is. A text's limit is `high`, in bytes."""
    v = F.try_parse_json(raw)
    of = F.schema_of_variant(v)
    number = F.try_variant_get(v, "$", "double")
    text = F.when(of == "STRING", F.try_variant_get(v, "$", "string"))
    span = F.when((number < low) | (number > high), "out_of_range")
    return (
        F.when(kind == "bool", F.when(F.coalesce(of != "BOOLEAN", F.lit(True)), "invalid_bool"))
        .when(kind == "int", F.when(F.coalesce(of != "BIGINT", F.lit(True)), "invalid_int").otherwise(span))
        .when(kind == "float", F.when(number.isNull() | ~F.coalesce(of.isin("BIGINT", "DOUBLE") | of.startswith("DECIMAL"), F.lit(False)), "invalid_float").otherwise(span))
        .when(kind == "text", F.when(text.isNull(), "invalid_string").when(F.octet_length(text) > high, "too_long"))
        .when(kind == "enum", F.when(text.isNull(), "invalid_string").when(~F.array_contains(options, text), "invalid_enum"))
    )
