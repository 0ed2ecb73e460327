"""Fill-in-the-middle: documents cut at two drawn places and put together again around sentinels.

A unit is a run of other characters with the white space before it, or white space at the very
end. A text's UTF-8 bytes are translated to a mask with a bit for each byte (set where it is
no white space), as one big integer whose lowest bit is the first byte. A run's last byte is a
set bit below a clear one, so shifting and masking marks all ends of units, bit_count() numbers
them, and halving the integer again and again finds the end of the k-th: all linear in the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import plain, slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: The digit 0 for bytes of white space, 1 for all others.
MASK = bytes(48 if b == 32 or 9 <= b <= 13 else 49 for b in range(256))


def unit_ends(raw: bytes) -> int:
    """Bit i is set where byte i is a unit's last."""
    if not raw:
        return 0
    kept = int(raw.translate(MASK)[::-1], 2)
    ends = kept & ~(kept >> 1)
    last = 1 << (len(raw) - 1)
    return ends | last  # a text that ends in white space has one more unit; else that bit is set already


def select(bits: int, size: int, k: int) -> int:
    """Place of the k-th set bit (k from 1) of an integer of `size` bits."""
    at = 0
    while size > 1:
        half = size // 2
        low = bits & ((1 << half) - 1)
        n = low.bit_count()
        if k <= n:
            bits, size = low, half
        else:
            bits, size, at, k = bits >> half, size - half, at + half, k - n
    return at


def cut(text: str, h1: int, h2: int) -> tuple[int, str, str, str]:
    """(units, prefix, middle, suffix): cuts after the smaller and the larger of h1 and h2 modulo units + 1."""
    raw = text.encode()
    ends = unit_ends(raw)
    n = ends.bit_count()
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    i = select(ends, len(raw), a) + 1 if a else 0
    j = select(ends, len(raw), b) + 1 if b else 0
    return n, raw[:i].decode(), raw[i:j].decode(), raw[j:].decode()


def rebuild(output: str, form: str) -> str:
    """The text of an output. A cut text holds no sentinel, and no part of one beside it can make one up, as `<` only begins and `>` only ends them."""
    if form == "plain":
        return output
    first, second = (SUFFIX, PREFIX) if form == "spm" else (PREFIX, SUFFIX)
    one, rest = output[len(first) :].split(second, 1)
    two, middle = rest.split(MIDDLE, 1)
    return two + middle + one if form == "spm" else one + middle + two


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, rate: int = 50, spm_rate: int = 80) -> DataFrame:
    """docs with its text column replaced by the form (psm, spm or plain) of it, plus n, form, prefix_chars and middle_chars; columns of those names are replaced.

    Draws are the first four 8-digit groups of sha256("seed:id"), so reruns and repeated rows
    agree; a null id counts as no digits. A null text is empty; empty texts and those that
    hold a sentinel stay plain, with null prefix_chars and middle_chars. Other columns keep
    their names, whatever they are.
    """
    rows, names = plain(docs)
    at_id, at_text = names[docs.columns.index(id_col)], names[docs.columns.index(text_col)]
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(at_id).cast("string"), F.lit(""))).cast("binary"), 256)
    h = [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]
    text = F.coalesce(F.col(at_text).cast("string"), F.lit(""))
    whole = (h[2] % 100 >= rate) | (text == "") | F.greatest(*(F.contains(text, F.lit(s)) for s in (PREFIX, SUFFIX, MIDDLE)))
    form = F.when(whole, "plain").when(h[3] % 100 < spm_rate, "spm").otherwise("psm")
    others = [c for c in names if c != at_text]
    rows = rows.select(*others, text.alias("_text"), form.alias("_form"), h[0].alias("_h1"), h[1].alias("_h2"))
    schema = StructType(rows.select(*others).schema.fields + StructType.fromDDL("_text string, _n long, _form string, _prefix long, _middle long").fields)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(others)
        for batch in batches:
            for b in slices(batch, "_text"):
                made = []
                for t, f, h1, h2 in zip(*(b.column(k + i).to_pylist() for i in range(4)), strict=True):
                    if f == "plain":
                        made.append((t, unit_ends(t.encode()).bit_count(), f, None, None))
                        continue
                    n, p, m, s = cut(t, h1, h2)
                    out = f"{SUFFIX}{s}{PREFIX}{p}{MIDDLE}{m}" if f == "spm" else f"{PREFIX}{p}{SUFFIX}{s}{MIDDLE}{m}"
                    made.append((out, n, f, len(p), len(m)))
                kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([*b.columns[:k], *(pa.array(c, t) for c, t in zip(zip(*made, strict=True), kinds, strict=True))], names=schema.names)

    out = rows.mapInArrow(of, schema)
    new = {"n": "_n", "form": "_form", "prefix_chars": "_prefix", "middle_chars": "_middle"}
    kept = [F.col("_text" if n == at_text else n).alias(c) for n, c in zip(names, docs.columns, strict=True) if c not in new]
    return out.select(*kept, *(F.col(v).alias(k) for k, v in new.items()))


def restored(rows: DataFrame, output: Column, form: Column, name: str = "restored") -> DataFrame:
    """rows with column `name`: the text that each output and form stand for."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "_output"):
                n = b.num_columns
                texts = [rebuild(o, f) for o, f in zip(b.column(n - 2).to_pylist(), b.column(n - 1).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*b.columns[: n - 1], pa.array(texts, pa.string())], names=[*b.schema.names[: n - 1], name])

    given = rows.select("*", output.alias("_output"), form.alias("_form_of"))
    return given.mapInArrow(of, StructType(given.drop("_form_of").schema.fields + StructType.fromDDL(f"{name} string").fields)).drop("_output")


def fim_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256) per row; the last is of the text rebuilt from output and form."""
    made = fill_in_middle(docs.select(F.col(id_col).cast("long").alias(id_col), text_col), id_col, text_col)
    both = restored(made, F.col(text_col), F.col("form"), "_restored")
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return both.select(id_col, "n", "form", "prefix_chars", "middle_chars", digest(text_col).alias("output_sha256"), digest("_restored").alias("restored_sha256"))
