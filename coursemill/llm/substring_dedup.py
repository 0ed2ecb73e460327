"""Repeated passages by hashing lines and their sentences.

Units are the sentences of each line that are long enough, the whole line where some of its
sentences are too short, and in a run of short sentences, over line breaks too, each sentence
with those after it that make it long enough. A unit's words, lowered and with single spaces,
are digested; digests are counted over all documents after map-side sums, and the occurrence
with the smallest (rank, id, start) stays. Every other occurrence that is part of a repeated
passage of MIN_PASSAGE words or more is removed, with its offsets in the original text (code
points, end exclusive) kept beside what is left; a lone short line that many pages share is
left alone.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import plain, text_list, written

#: Shorter units repeat by chance.
MIN_WORDS = 8
#: Words that neighbouring repeated units have together at least, and the code points between neighbours at most; sentences too short to be a unit may be longer.
MIN_PASSAGE, GAP = 14, 64
LINE = re.compile(r"[^\n]+")
SENTENCE = re.compile(r".+?(?:[.!?](?=\s)|[。！？｡](?![。！？｡])|\Z)")
#: Scripts that put no blanks between words; two characters count as a word, and so do 16 of any other text without blanks.
NO_BLANKS = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")


def _size(part: str, words: list[str], dense: bool) -> int:
    n = len(words) + (len(NO_BLANKS.findall(part)) // 2 if dense else 0)
    return n if len(part) <= 16 * n else max(n, sum(map(len, words)) // 16)


def _digest(words: list[str]) -> bytes:
    return hashlib.blake2b(" ".join(words).encode("utf-8", "surrogatepass"), digest_size=16).digest()


def text_units(text: str, min_words: int = MIN_WORDS) -> Iterator[tuple[int, int, int, int, int, bytes]]:
    """(start, end, words, words of the text up to its end, lead, 16-byte digest) of each unit of at least min_words words.

    lead: code points back to the end of the unit before, over sentences too short for one.
    """
    dense = NO_BLANKS.search(text) is not None
    run: deque[tuple[int, int, list[str]]] = deque()
    held = upto = covered = 0
    for line in LINE.finditer(text):
        before, smallest, n = upto, min_words, 0
        for m in SENTENCE.finditer(line[0]):
            n += 1
            words = m[0].lower().split()
            if not words:
                continue
            size = _size(m[0], words, dense)
            upto, smallest = upto + size, min(smallest, size)
            start, end = line.start() + m.end() - len(m[0].lstrip()), line.start() + m.end()
            if size >= min_words:
                yield start, end, size, upto, max(start - covered, 0), _digest(words)
                run.clear()
                held, covered = 0, end
                continue
            run.append((start, size, words))
            held += size
            while held >= min_words:
                yield run[0][0], end, held, upto, max(run[0][0] - covered, 0), _digest([w for s in run for w in s[2]])
                held, covered = held - run.popleft()[1], end
        if n > 1 and upto - before >= min_words and smallest < min_words:
            yield line.end() - len(line[0].lstrip()), line.end(), upto - before, upto, 0, _digest(line[0].lower().split())


def find_units(docs: DataFrame, id_col: str, text_col: str, rank_col: str | None, min_words: int) -> DataFrame:
    names = ["id", "rank", "start", "end", "words", "upto", "lead", "digest"]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, ids, ranks = [], b.column(0).to_pylist(), b.column(1).to_pylist()
            for i, r, t in zip(ids, ranks, text_list(b.column(2)), strict=True):
                rows += [(i, r, *u) for u in text_units(t, min_words)]
            cols = list(zip(*rows, strict=True)) or [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.int64(), *[pa.int32()] * 5, pa.binary()], strict=True)], names)

    rank = F.col(rank_col).cast("long") if rank_col else F.lit(0).cast("long")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), rank.alias("rank"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(of, "id long, rank long, start int, end int, words int, upto int, lead int, digest binary")


def later_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rank_col: str | None = None, min_words: int = MIN_WORDS) -> DataFrame:
    """(id, start, end, words, digest, first_id, first_start, passage_words): all occurrences but the first of each unit; one that begins within another is cut to what is left of it.

    Repeated units with at most GAP code points, or only sentences too short for a unit,
    between them are one passage, whose words are counted together.

    Rows without an id take no part; rows that share an id are read as one document, so an
    identical row repeats nothing. A null rank comes after every rank.
    """
    units = written(find_units(docs.where(F.col(id_col).isNotNull()), id_col, text_col, rank_col, min_words), "units")
    place = F.struct(F.col("rank").isNull().alias("unranked"), "rank", "id", "start", "end")
    # The digest's first half would do as a key; all of it is kept, so equal keys are equal units.
    first = units.groupBy("digest").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1")
    # Written, so that the join has a shuffle of its own, in which Spark splits the rows of a frequent unit.
    first = written(first.select("digest", F.col("first.id").alias("first_id"), F.col("first.start").alias("first_start"), F.col("first.end").alias("_first_end")), "repeated-units")
    gone = units.join(first, "digest").where("id <> first_id or start >= _first_end").select("id", "start", "end", "words", "upto", "lead", "digest", "first_id", "first_start")
    before = Window.partitionBy("id").orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    gone = gone.repartition("id").distinct().withColumn("_reach", F.max(F.struct("end", "upto")).over(before))
    gone = gone.where("_reach is null or end > _reach.end")
    inside = F.col("_reach.end") > F.col("start")
    gone = gone.withColumns({"words": F.when(inside, F.col("upto") - F.col("_reach.upto")).otherwise(F.col("words")), "start": F.when(inside, F.col("_reach.end")).otherwise(F.col("start")), "lead": F.when(inside, 0).otherwise(F.col("lead"))})
    place = Window.partitionBy("id").orderBy("start")
    last = F.lag("end").over(place)
    new = F.coalesce((F.col("start") - last > GAP) & (last < F.col("start") - F.col("lead")), F.lit(False)).cast("int")
    gone = gone.withColumn("_new", new).withColumn("_passage", F.sum("_new").over(place.rowsBetween(Window.unboundedPreceding, 0)))
    gone = gone.withColumn("passage_words", F.sum("words").over(Window.partitionBy("id", "_passage")))
    return gone.select("id", "start", "end", "words", "digest", "first_id", "first_start", "passage_words")


def repeated_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rank_col: str | None = None, min_words: int = MIN_WORDS, min_passage: int = MIN_PASSAGE) -> DataFrame:
    """The later_units() to remove: those of passages of `min_passage` words or more; 0 takes every repeated unit."""
    return later_units(docs, id_col, text_col, rank_col, min_words).where(F.col("passage_words") >= min_passage).drop("passage_words")


def documents_with_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rank_col: str | None = None, min_words: int = MIN_WORDS, min_passage: int = MIN_PASSAGE) -> DataFrame:
    """(id_col, n_removed, words_removed, n_left, words_left, removed, kept_in): a row per document that loses text.

    removed: start:end of each removed unit in page order, comma-joined; kept_in: the ids
    where those units stay, sorted; n_left, words_left: its repeated units that stay, as their
    passages are too short. Documents that lose nothing have no row; so do empty, null and
    blank texts, and an empty table. Other columns, whatever their names, aren't looked at.
    """
    gone = F.col("passage_words") >= min_passage
    each = later_units(docs, id_col, text_col, rank_col, min_words)
    spans = F.array_sort(F.collect_list(F.when(gone, F.struct("start", "end"))))
    words = lambda which: F.coalesce(F.sum(F.when(which, F.col("words"))), F.lit(0))
    out = each.groupBy("id").agg(F.count_if(gone).alias("n_removed"), words(gone).alias("words_removed"), F.count_if(~gone).alias("n_left"), words(~gone).alias("words_left"), spans.alias("s"), F.array_sort(F.collect_set(F.when(gone, F.col("first_id")))).alias("kept_in")).where("n_removed > 0")
    joined = F.array_join(F.transform("s", lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"))), ",")
    return out.select(F.col("id").alias(id_col), "n_removed", "words_removed", "n_left", "words_left", joined.alias("removed"), "kept_in")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rank_col: str | None = None, min_words: int = MIN_WORDS, min_passage: int = MIN_PASSAGE) -> DataFrame:
    """docs with repeated units cut out of the text, and a last column removed_spans array<struct<start, end>> (null where nothing was), in place of one of that name.

    Null and empty texts and rows without an id stay as they are; rows that share an id lose
    the same spans. Other columns stay, whatever their names.
    """
    docs = docs.drop("removed_spans")
    rows, names = plain(docs)
    at, text = names[docs.columns.index(id_col)], names[docs.columns.index(text_col)]
    gone = repeated_units(docs, id_col, text_col, rank_col, min_words, min_passage).groupBy(F.col("id").alias("_gone_id")).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("_spans"))
    out = rows.join(gone, F.col(at).cast("long") == F.col("_gone_id"), "left").drop("_gone_id")
    pick = lambda s: F.substring(F.col(text), F.lit(1) + s["start"], s["end"] - s["start"])
    bounds = F.transform(F.concat(F.array(F.lit(0)), F.col("_spans.end")), lambda e, i: F.struct(e.alias("start"), F.coalesce(F.get(F.col("_spans.start"), i), F.length(text)).alias("end")))
    return out.withColumn(text, F.when(F.col("_spans").isNull(), F.col(text)).otherwise(F.array_join(F.transform(bounds, pick), ""))).toDF(*docs.columns, "removed_spans")
