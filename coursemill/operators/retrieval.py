"""Retrieval: what becomes of the chunks that a search has found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import text_index
from .durable import written

#: Kinds of chunks that only signal an assignment, and kinds that are never shown.
SIGNAL_KINDS = ("assignment_brief", "lab_brief", "exam")
HIDDEN_KINDS = ("sample_solution", "unknown")
STRONG = 0.65


def without_orphans(chunks: DataFrame, orphans: DataFrame) -> DataFrame:
    """Chunks whose document isn't an orphan."""
    return chunks.join(orphans.select("doc_id").distinct(), "doc_id", "left_anti")


def bucket(kind: Column, classified: Column, graph_on: Column) -> Column:
    """context, signal or dropped; everything is context where the graph is off."""
    shown = F.when(kind.isin(*HIDDEN_KINDS), "dropped").when(kind.isin(*SIGNAL_KINDS), "signal").when(~classified, "dropped").otherwise("context")
    return F.when(~graph_on, "context").otherwise(shown)


def strong_signals(found: DataFrame, least: float = STRONG) -> DataFrame:
    """(query_id, files): the sorted names of the files whose signals are strong, comma-joined."""
    strong = found.where((F.col("bucket") == "signal") & (F.col("score") >= least))
    return strong.groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_set("filename")), ", ").alias("files"))


def first_wins(chunks: DataFrame, keys: list, order: list) -> DataFrame:
    """One row for each key, the first in the order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return chunks.withColumn("_at", F.row_number().over(w)).where("_at = 1").drop("_at")


def source_documents(found: DataFrame, n: int = 3) -> DataFrame:
    """(query_id, doc_id, place): the first n distinct documents of each query's context."""
    first = found.where("bucket = 'context'").groupBy("query_id", "doc_id").agg(F.min("rank").alias("rank"))
    w = Window.partitionBy("query_id").orderBy("rank", "doc_id")
    return first.withColumn("place", F.row_number().over(w).cast("long")).where(F.col("place") <= n).select("query_id", "doc_id", "place")


def partner_documents(found: DataFrame, edges: DataFrame, orphans: DataFrame, sources: int = 3, most: int = 4) -> DataFrame:
    """(query_id, partner, place): graph partners of a query's first documents that its context doesn't have, the first `most`.

    part_of_unit is followed both ways, applied_in forwards. A document of the sources that is
    another's partner is in the context already and drops out.
    """
    src = source_documents(found, sources)
    live = edges.where("not rejected and src <> dst")
    ways = live.where(F.col("relation").isin("part_of_unit", "applied_in")).select("src", "dst").unionByName(live.where("relation = 'part_of_unit'").select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    partners = src.join(ways.distinct(), src["doc_id"] == ways["src"]).select("query_id", "place", F.col("dst").alias("partner"))
    partners = partners.groupBy("query_id", "partner").agg(F.min("place").alias("near"))
    have = found.where("bucket = 'context'").select("query_id", F.col("doc_id").alias("partner")).distinct()
    partners = partners.join(have, ["query_id", "partner"], "left_anti").join(orphans.select(F.col("doc_id").alias("partner")).distinct(), "partner", "left_anti")
    w = Window.partitionBy("query_id").orderBy("near", "partner")
    return partners.withColumn("place", F.row_number().over(w).cast("long")).where(F.col("place") <= most).select("query_id", "partner", "place")


def keyword_matches(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """queries(query_id, tokens), chunks(chunk_id, body, name) of token arrays -> (query_id, chunk_id): all tokens in the body, or all in the name.

    The queries' tokens are written first: while they are few, Spark sends them to the chunks,
    of which only those tokens are put into posting lists. A query meets the chunks of its
    rarest token, and its other tokens only there; see text_index.search().
    """
    want = written(queries.select(F.explode("tokens").alias("token")).distinct(), "query-tokens")
    held = text_index.exploded(chunks.select("chunk_id", *(F.array_distinct(p).alias(p) for p in ("body", "name"))))
    return text_index.search(queries, written(text_index.postings(held.join(want, "token", "left_semi")), "postings"))


def scrolled(chunks: DataFrame, key: str = "doc_id", order: str = "chunk_index", version: str = "version") -> DataFrame:
    """A document's chunks in index order; of chunks with one index the latest stays."""
    last = Window.partitionBy(key, order).orderBy(F.desc(version))
    return chunks.withColumn("_at", F.row_number().over(last)).where("_at = 1").drop("_at")


def linker_excerpt(chunks: DataFrame, most_chunks: int = 5, most: int = 1500) -> DataFrame:
    """(doc_id, excerpt): the first chunks in index order with single spaces, joined, cut to a number of characters."""
    first = chunks.where(F.col("chunk_index") < most_chunks).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "text"))).alias("c"))
    joined = F.array_join(F.transform("c", lambda c: F.trim(F.regexp_replace(c["text"], r"\s+", " "))), " ")
    return first.select("doc_id", F.substring(joined, 1, most).alias("excerpt"))


def passed(chunks: DataFrame, verdicts: DataFrame, budget_ms: int = 800) -> DataFrame:
    """Chunks that no verdict in time calls adversarial; a late or missing verdict lets a chunk pass."""
    bad = verdicts.where(F.col("adversarial") & (F.col("took_ms") <= budget_ms)).select("vec_id").distinct()
    return chunks.join(bad, "vec_id", "left_anti")
