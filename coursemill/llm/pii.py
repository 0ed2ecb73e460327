"""Personal data by anchor expansion.

One Aho-Corasick automaton finds at-signs, plus signs, digits, schemes and identifier cues
in a whole text. At each anchor a small parser expands to the boundaries and validates what
it found. No parser looks at text without an anchor, and each moves forward only.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import plain, text_list

#: The base kinds, in the order that breaks ties of start.
KINDS = ("email", "ip", "card", "phone")
#: What the anchors add: web addresses, keyed secrets and cued account numbers.
MORE = ("url", "account")
#: Schemes and identifier cues, matched in lower case as well as in capitals.
SCHEMES = ("http://", "https://", "ftp://")
CUES = ("iban", "account", "acct", "passport", "password", "passwd", "token", "api_key", "apikey", "secret", "akia")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
RUN = re.compile(r"[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
URL = re.compile(r"[^\s<>\"']+")
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
AKIA = re.compile(r"AKIA[A-Z0-9]{16}(?![A-Za-z0-9])")
#: A cue, an optional "no.", "number" or "key", a colon, equals sign or space, and then an identifier that has a digit.
VALUE = re.compile(r"(?:\x20?(?:no\.?|number|nr\.?|key|id))?\x20?[:=#]\x20?[\"']?([A-Za-z0-9_/+=.-]{6,})", re.IGNORECASE)


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for word, kind in [("@", "at"), ("+", "plus"), *((d, "digit") for d in "0123456789"), *((s, "scheme") for s in SCHEMES), *((c, "cue") for c in CUES)]:
        for form in {word, word.upper(), word.capitalize()}:
            a.add_word(form, (kind, len(form)))
    a.make_automaton()
    return a


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def iban_ok(text: str) -> bool:
    """The remainder by 97 that an IBAN must have."""
    s = text.replace(" ", "")
    s = s[4:] + s[:4]
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s)) % 97 == 1


def _octet(s: str) -> bool:
    s = s.lstrip("0")
    return len(s) <= 3 and int(s or "0") <= 255


class Finder:
    """Finds spans (start, kind, end) in one text; code points, end exclusive."""

    def __init__(self) -> None:
        self.anchors = _automaton()

    def spans(self, text: str) -> list[tuple[int, str, int]]:
        out: list[tuple[int, str, int]] = []
        email_end = ip_from = card_from = url_end = account_end = 0
        for last, (kind, size) in self.anchors.iter(text):
            at = last - size + 1
            if kind == "digit":
                if at >= card_from and (m := CARD.match(text, at)):
                    card_from = m.end()
                    digits = m[0].replace(" ", "").replace("-", "")
                    if 14 <= len(digits) <= 19 and luhn(digits):
                        out.append((at, "card", card_from))
                if at >= ip_from:
                    # A start further right in a run of digits fails or ends as the run's first does.
                    if m := IP.match(text, at):
                        ip_from = m.end()
                        if all(map(_octet, m.groups())):
                            out.append((at, "ip", ip_from))
                    else:
                        ip_from = RUN.match(text, at).end()
            elif kind == "at":
                start = at
                while start > email_end and text[start - 1] in LOCAL:
                    start -= 1
                if start < at and (m := DOMAIN.match(text, at + 1)):
                    email_end = m.end()
                    out.append((start, "email", email_end))
            elif kind == "plus":
                if (m := PHONE.match(text, at)) and 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                    out.append((at, "phone", m.end()))
            elif kind == "scheme":
                if at >= url_end and (m := URL.match(text, last + 1)):
                    url_end = last + 1 + len(m[0].rstrip(".,;:!?)]}"))
                    if url_end > last + 1:
                        out.append((at, "url", url_end))
            elif at >= account_end and not (at and text[at - 1].isalnum()):
                if text.startswith("AKIA", at):
                    if m := AKIA.match(text, at):
                        account_end = m.end()
                        out.append((at, "account", account_end))
                    continue
                begin = last + 1
                while begin < len(text) and text[begin] in " :" and begin < last + 4:
                    begin += 1
                if (m := IBAN.match(text, begin)) and iban_ok(m[0]):
                    account_end = m.end()
                    out.append((begin, "account", account_end))
                elif (m := VALUE.match(text, last + 1)) and any(c.isdigit() for c in m[1]):
                    account_end = m.end(1)
                    out.append((m.start(1), "account", account_end))
        order = {k: i for i, k in enumerate((*KINDS, *MORE))}
        return sorted(out, key=lambda s: (s[0], order[s[1]]))


def _joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, k, b in spans)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_url, n_account): one row per row of docs.

    A null or empty text has no spans: counts 0, the digest of the empty string, spans "".
    Repeated rows and null ids keep a row each; other columns aren't looked at. Where spans
    start together they go by kind; spans of different kinds may overlap.
    """
    names = ["id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", *(f"n_{k}" for k in MORE)]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder()
        for b in batches:
            found = [finder.spans(t) for t in text_list(b.column(1))]
            base = [[s for s in f if s[1] in KINDS] for f in found]
            count = lambda k: pa.array([sum(s[1] == k for s in f) for f in found], pa.int64())  # noqa: B023, E731
            digests = pa.array([hashlib.sha256(_joined(s).encode()).hexdigest() for s in base], pa.string())
            cols = [b.column(0), *map(count, KINDS), digests, pa.array(map(_joined, found), pa.string()), *map(count, MORE)]
            yield pa.RecordBatch.from_arrays(cols, names)

    kinds = ", ".join(f"{n} {'string' if n in ('base_sha256', 'spans') else 'long'}" for n in names)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(of, kinds).withColumnRenamed("id", id_col)


def mask(text: str, spans: list[tuple[int, str, int]]) -> str:
    """The text with every span replaced by its kind in angle brackets; overlapping spans become one, named after the first."""
    out, at, i = [], 0, 0
    while i < len(spans):
        a, kind, b = spans[i]
        i += 1
        while i < len(spans) and spans[i][0] < b:
            b = max(b, spans[i][2])
            i += 1
        out += [text[at:a], f"<{kind.upper()}>"]
        at = b
    return "".join([*out, text[at:]])


def mask_pii(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with personal data in the text masked; a null text stays null, other columns stay as they are."""
    at, (rows, _) = docs.columns.index(text_col), plain(docs)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder()
        for b in batches:
            new = pa.array([t and mask(t, finder.spans(t)) for t in b.column(at).to_pylist()], b.schema.field(at).type)
            yield b.set_column(at, b.schema.field(at), new)

    return rows.mapInArrow(of, rows.schema).toDF(*docs.columns)
