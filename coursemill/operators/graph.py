"""The document graph: typed edges, one-hop expansion, and the linker's rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THEORY = ("lecture", "reading", "transcript")
PRACTICE = ("assignment_brief", "lab_brief", "exam", "tutorial_exercise")


EDGE = ["src", "dst", "relation"]


def reject_edges(edges: DataFrame, vetoes: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, vetoes) after a teacher's rejection: the edges are marked, and their keys become vetoes; keys without an edge do nothing."""
    hit = edges.join(keys.select(*EDGE).distinct(), EDGE, "left_semi").select(*EDGE).distinct()
    marked = edges.join(hit.withColumn("_hit", F.lit(True)), EDGE, "left").withColumn("rejected", F.col("rejected") | F.coalesce("_hit", F.lit(False)))
    return marked.select(*edges.columns), vetoes.select(*EDGE).unionByName(hit).distinct()


def unreject_edges(edges: DataFrame, vetoes: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, vetoes) after rejections were taken back: the edges stay, no longer marked, and their vetoes go; keys without an edge do nothing."""
    hit = edges.join(keys.select(*EDGE).distinct(), EDGE, "left_semi").select(*EDGE).distinct()
    cleared = edges.join(hit.withColumn("_hit", F.lit(True)), EDGE, "left").withColumn("rejected", F.col("rejected") & F.col("_hit").isNull())
    return cleared.select(*edges.columns), vetoes.join(hit, EDGE, "left_anti")


def neighbours(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, partner): part_of_unit both ways, applied_in from its source only; rejected edges and the node itself are left out. Where both ends are sources, only src gets the partner."""
    live = edges.where("not rejected and src <> dst")
    both = live.where("relation = 'part_of_unit'")
    out = live.where("relation = 'applied_in'").select("src", "dst")
    forward = both.select("src", "dst").unionByName(out)
    s = sources.select(F.col("doc_id").alias("_s")).distinct()
    first = forward.join(s, F.col("src") == F.col("_s"), "left_semi").select(F.col("src").alias("source"), F.col("dst").alias("partner"))
    back = both.join(s, F.col("dst") == F.col("_s"), "left_semi").join(s, F.col("src") == F.col("_s"), "left_anti")
    return first.unionByName(back.select(F.col("dst").alias("source"), F.col("src").alias("partner"))).distinct()


def applied_assignments(edges: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, partner): lectures' applied_in targets that are assignments, labs or exams."""
    lecture = docs.where("kind = 'lecture'").select(F.col("doc_id").alias("src"))
    target = docs.where(F.col("kind").isin("assignment_brief", "lab_brief", "exam")).select(F.col("doc_id").alias("dst"))
    live = edges.where("relation = 'applied_in' and not rejected")
    return live.join(lecture, "src", "left_semi").join(target, "dst", "left_semi").select(F.col("src").alias("doc_id"), F.col("dst").alias("partner")).distinct()


def adjacency(edges: DataFrame) -> DataFrame:
    """(node, other) in both directions, each node its own neighbour."""
    ways = edges.select(F.col("src").alias("node"), F.col("dst").alias("other")).unionByName(edges.select(F.col("dst").alias("node"), F.col("src").alias("other")))
    return ways.unionByName(ways.select("node", F.col("node").alias("other"))).distinct()


def visible_graph(nodes: DataFrame, edges: DataFrame, kinds: list, relations: list, rejected: bool) -> tuple[DataFrame, DataFrame]:
    """Nodes of the chosen kinds (null counts as unclassified), and edges of the chosen relations with both ends visible."""
    shown = nodes.where(F.coalesce("kind", F.lit("unclassified")).isin(kinds))
    ids = shown.select(F.col("doc_id").alias("_n"))
    e = edges.where(F.col("relation").isin(relations) & (F.lit(rejected) | ~F.col("rejected")))
    return shown, e.join(ids, F.col("src") == F.col("_n"), "left_semi").join(ids, F.col("dst") == F.col("_n"), "left_semi")


def canonical_edges(verdicts: DataFrame, rejected: DataFrame, least: float = 0.70, least_solution: float = 0.75) -> DataFrame:
    """verdicts(a_id, a_kind, b_id, b_kind, relation, confidence, similarity) -> (src, dst, relation, confidence, similarity).

    Confidence 0.5 at least. part_of_unit goes from the smaller id; solution_of starts at a
    sample solution; applied_in goes from theory to practice; prerequisite keeps its side.
    Similarity is at least `least_solution` for solution_of, else `least`. A pair vetoed in
    either direction is dropped.
    """
    rel, a, b = F.col("relation"), F.col("a_id"), F.col("b_id")
    base = F.regexp_replace(rel, "_(ab|ba)$", "")
    flip = rel.endswith("_ba")
    src, dst = F.when(flip, b).otherwise(a), F.when(flip, a).otherwise(b)
    src_kind, dst_kind = F.when(flip, F.col("b_kind")).otherwise(F.col("a_kind")), F.when(flip, F.col("a_kind")).otherwise(F.col("b_kind"))
    low = F.least(a, b)
    ok: Column = F.when(base == "solution_of", src_kind == "sample_solution").when(base == "applied_in", src_kind.isin(*THEORY) & dst_kind.isin(*PRACTICE)).when(base.isin("part_of_unit", "prerequisite"), True).otherwise(False)
    floor = F.when(base == "solution_of", least_solution).otherwise(least)
    rows = verdicts.where((F.col("confidence") >= 0.5) & F.coalesce(ok, F.lit(False)) & (F.col("similarity") >= floor))
    rows = rows.select(F.when(base == "part_of_unit", low).otherwise(src).alias("src"), F.when(base == "part_of_unit", F.greatest(a, b)).otherwise(dst).alias("dst"), base.alias("relation"), "confidence", "similarity")
    veto = rejected.select("src", "dst", "relation").unionByName(rejected.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "relation")).distinct()
    return rows.where("src <> dst").join(veto, ["src", "dst", "relation"], "left_anti")


def fully_rejected(rejected: DataFrame) -> DataFrame:
    """(a, b), a < b: pairs vetoed as solution_of and as part_of_unit, each in either direction; other relations don't matter."""
    a, b = F.least("src", "dst"), F.greatest("src", "dst")
    n = rejected.groupBy(a.alias("a"), b.alias("b")).agg(F.max(F.col("relation") == "solution_of").alias("x"), F.max(F.col("relation") == "part_of_unit").alias("y"))
    return n.where("x and y").select("a", "b")


def fresh_decisions(cache: DataFrame, docs: DataFrame) -> DataFrame:
    """Cached decisions whose both classification stamps still hold; two nulls are equal."""
    stamp = lambda side: docs.select(F.col("doc_id").alias(f"{side}_id"), F.col("classified_at").alias(f"{side}_now"))
    return cache.join(stamp("a"), "a_id").join(stamp("b"), "b_id").where("a_at <=> a_now and b_at <=> b_now").select(*cache.columns)


def stale_decisions(cache: DataFrame, docs: DataFrame) -> DataFrame:
    """Cached decisions of which a classification stamp has changed, to or from null included."""
    stamp = lambda side: docs.select(F.col("doc_id").alias(f"{side}_id"), F.col("classified_at").alias(f"{side}_now"))
    return cache.join(stamp("a"), "a_id").join(stamp("b"), "b_id").where("not (a_at <=> a_now and b_at <=> b_now)").select(*cache.columns)
