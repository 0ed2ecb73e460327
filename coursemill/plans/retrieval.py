"""Vector search, retrieval and graph queries over `embeddings`.

Vectors of the driver's tables are far from each other, so queries use lower floors than
the operators' defaults.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import graph, ingest, retrieval, vectors
from ..operators.durable import shared_path
from ..sources import tables
from ..sources.vector_index import VectorIndex, cells_for
from .bindings import CHUNKS, COURSE_DOCS, KINDS, chunks, course_docs, nth, table
from .registry import query
from .text import BARE, REPLIES, replies

FLOOR, EACH, K = 0.2, 50, 10
SIGNALS = "('assignment_brief', 'lab_brief', 'exam')"
BUCKET_SQL = f"CASE WHEN kind IN ('sample_solution', 'unknown') THEN 'dropped' WHEN kind IN {SIGNALS} THEN 'signal' WHEN NOT classified THEN 'dropped' ELSE 'context' END"
FOUND = f"""{CHUNKS}, q AS (SELECT vec_id AS query_id, v FROM chunks WHERE vec_id % {EACH} = 0),
  hits AS (SELECT query_id, c.vec_id, c.doc_id, c.filename, {BUCKET_SQL} AS bucket, list_dot_product(q.v, c.v) AS score FROM q JOIN chunks c ON c.vec_id <> q.query_id WHERE NOT c.orphaned),
  found AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM hits WHERE score >= {FLOOR}) WHERE rank <= {K})"""
#: Documents of the linker: each vector is one, 200 in a course, so the linker's bound of 300 leaves none out.
LINKED = f"""ldocs AS (SELECT vec_id AS doc_id, vec_id // 200 AS course_id, CASE WHEN vec_id % 19 = 0 THEN NULL ELSE ([{", ".join(f"'{k}'" for k in KINDS)}])[label + 1] END AS kind, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
  eligible AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY course_id ORDER BY doc_id) AS place FROM ldocs WHERE kind IS NOT NULL) WHERE place <= 300),
  sims AS (SELECT a.doc_id AS a, b.doc_id AS b, list_dot_product(a.v, b.v) AS s FROM eligible a JOIN eligible b ON a.course_id = b.course_id AND a.doc_id <> b.doc_id),
  pairs AS (SELECT least(a, b) AS a_id, greatest(a, b) AS b_id, max(s) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS r FROM sims WHERE s >= {FLOOR}) WHERE r <= 4 GROUP BY 1, 2)"""
#: A model's verdict on a pair, here a fixed formula of the ids.
RAW = ("part_of_unit", "solution_of_ab", "applied_in_ab", "prerequisite_ab", "solution_of_ba", "applied_in_ba", "prerequisite_ba", "none")
VERDICTS = f"""{LINKED}, verdicts AS (SELECT p.*, a.kind AS a_kind, b.kind AS b_kind, ([{", ".join(f"'{r}'" for r in RAW)}])[(a_id * 3 + b_id) % 8 + 1] AS relation, CAST((a_id * 7 + b_id * 3) % 10 AS DOUBLE) / 10 AS confidence
  FROM pairs p JOIN ldocs a ON a.doc_id = a_id JOIN ldocs b ON b.doc_id = b_id)"""
EDGES = f"""{VERDICTS}, sided AS (SELECT *, regexp_replace(relation, '_(ab|ba)$', '') AS base, relation LIKE '%\\_ba' ESCAPE '\\' AS flip FROM verdicts WHERE confidence >= 0.5),
  turned AS (SELECT base AS relation, confidence, similarity, CASE WHEN flip THEN b_id ELSE a_id END AS src, CASE WHEN flip THEN a_id ELSE b_id END AS dst, CASE WHEN flip THEN b_kind ELSE a_kind END AS src_kind, CASE WHEN flip THEN a_kind ELSE b_kind END AS dst_kind FROM sided WHERE base <> 'none'),
  edges AS (SELECT src, dst, relation, confidence, similarity, (src + dst) % 6 = 0 AS rejected FROM turned WHERE similarity >= CASE relation WHEN 'solution_of' THEN 0.22 ELSE 0.2 END
    AND (relation IN ('part_of_unit', 'prerequisite') OR (relation = 'solution_of' AND src_kind = 'sample_solution') OR (relation = 'applied_in' AND src_kind IN ('lecture', 'reading', 'transcript') AND dst_kind IN ('assignment_brief', 'lab_brief', 'exam', 'tutorial_exercise'))))"""


def found(spark, d, k=K):
    c = chunks(spark, d)
    q = c.where(F.col("vec_id") % EACH == 0).select(F.col("vec_id").alias("query_id"), "v")
    best = vectors.top_k(q, c.where("not orphaned"), k, FLOOR, skip_self=True)
    facts = c.select("vec_id", "doc_id", "filename", retrieval.bucket(F.col("kind"), F.col("classified"), F.lit(True)).alias("bucket"))
    return best.join(facts, "vec_id")


def linked(spark, d):
    i = F.col("vec_id")
    return table(spark, d, "embeddings").select(i.alias("doc_id"), F.expr("vec_id div 200").alias("course_id"), F.when(i % 19 != 0, nth(KINDS, F.col("label"))).alias("kind"), F.col("embedding").cast("array<double>").alias("v"))


def pairs(spark, d):
    return vectors.course_neighbours(linked(spark, d).where("kind is not null"), 4, FLOOR)


def verdicts(spark, d):
    kinds = linked(spark, d).select("doc_id", "kind")
    a, b = F.col("a"), F.col("b")
    side = lambda x: kinds.select(F.col("doc_id").alias(x), F.col("kind").alias(f"{x}_kind"))
    p = pairs(spark, d).join(side("a"), "a").join(side("b"), "b")
    return p.select(a.alias("a_id"), "a_kind", b.alias("b_id"), "b_kind", nth(RAW, (a * 3 + b) % 8).alias("relation"), (((a * 7 + b * 3) % 10).cast("double") / 10).alias("confidence"), F.col("score").alias("similarity"))


def edges(spark, d):
    none = spark.createDataFrame([], "src long, dst long, relation string")
    return graph.canonical_edges(verdicts(spark, d), none, FLOOR, 0.22).withColumn("rejected", (F.col("src") + F.col("dst")) % 6 == 0)


@query(
    f"""WITH {CHUNKS}, x AS (SELECT doc_id, unnest(range(1, 65)) AS i, v FROM chunks), m AS (SELECT doc_id, i, avg(v[i]) AS x FROM x GROUP BY ALL), n AS (SELECT doc_id, sqrt(sum(x * x)) AS norm FROM m GROUP BY doc_id)
  SELECT doc_id, count(*) AS dim, round(max(x / norm), 6) + 0 AS largest, round(min(CASE i WHEN 1 THEN x / norm END), 6) + 0 AS first FROM m JOIN n USING (doc_id) GROUP BY doc_id"""
)
def a16_mean_pool(spark, d):
    p = vectors.mean_pool(chunks(spark, d), "doc_id")
    return p.select("doc_id", F.size("pooled").cast("long").alias("dim"), (F.round(F.array_max("pooled"), 6) + 0).alias("largest"), (F.round(F.get("pooled", F.lit(0)), 6) + 0).alias("first"))


@query(f"WITH {CHUNKS} SELECT a.vec_id, CASE WHEN b.v IS NULL THEN 0 ELSE round(greatest(-1, least(1, list_dot_product(a.v, b.v))), 6) + 0 END AS cosine FROM chunks a LEFT JOIN chunks b ON b.vec_id = a.vec_id + 1")
def t10_cosine(spark, d):
    c = chunks(spark, d).select("vec_id", "v")
    after = c.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w"))
    return c.join(after, "vec_id", "left").select("vec_id", (F.round(vectors.cosine(F.col("v"), F.col("w")), 6) + 0).alias("cosine"))


@query(f"WITH {FOUND} SELECT query_id, vec_id, rank, round(score, 6) AS score FROM found")
def k1_nearest_chunks(spark, d):
    return found(spark, d).select("query_id", "vec_id", "rank", F.round("score", 6).alias("score"))


@query(f"WITH {FOUND} SELECT query_id, vec_id, rank, round(score, 6) AS score FROM found")
def k1_indexed_chunks(spark, d):
    """The same search through an index on disk, all of whose cells are probed; orphans are left out before the best are taken."""
    c = chunks(spark, d)
    index = VectorIndex.build(c.select("vec_id", "v"), shared_path(spark, "vector-index"), cells_for(c.count()))
    q = c.where(F.col("vec_id") % EACH == 0).select(F.col("vec_id").alias("query_id"), "v")
    best = index.search(q, K, floor=FLOOR, excluded=c.where("orphaned").select("vec_id"), skip_self=True)
    return best.select("query_id", "vec_id", "rank", F.round("score", 6).alias("score"))


@query("SELECT k, greatest(least(greatest(k * 4, 30), 80), k) AS candidates FROM (SELECT CAST(range AS BIGINT) AS k FROM range(1, 121))")
def k2_candidates(spark, d):
    return spark.range(1, 121).select(F.col("id").alias("k"), vectors.candidate_count(F.col("id")).cast("long").alias("candidates"))


@query(
    f"""WITH {FOUND}, r AS (SELECT *, rank - 1 AS idx FROM found), o AS (SELECT query_id, idx, (vec_id * 37) % 101 AS rerank FROM r WHERE query_id % 4 <> 3 AND idx % 5 <> 4),
  j AS (SELECT r.*, o.rerank, count(*) OVER (PARTITION BY r.query_id) AS n, count(o.rerank) OVER (PARTITION BY r.query_id) AS any_ FROM r LEFT JOIN o USING (query_id, idx))
  SELECT query_id, vec_id, new AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN n > 1 THEN rerank END DESC NULLS LAST, idx) AS new FROM j WHERE n <= 1 OR any_ = 0 OR rerank IS NOT NULL) WHERE new <= 5"""
)
def k3_rerank(spark, d):
    c = found(spark, d).withColumn("idx", F.col("rank") - 1).drop("rank")
    order = c.where("query_id % 4 <> 3 and idx % 5 <> 4").select("query_id", "idx", ((F.col("vec_id") * 37) % 101).alias("rerank"))
    wild = order.where("idx = 0").withColumn("idx", F.lit(999).cast("long"))  # out of range, so ignored
    return vectors.reranked(c, order.unionByName(wild), 5).select("query_id", "vec_id", "rank")


@query(f"WITH {LINKED} SELECT a_id, b_id, round(similarity, 6) AS similarity FROM pairs")
def k4_linker_neighbours(spark, d):
    return pairs(spark, d).select(F.col("a").alias("a_id"), F.col("b").alias("b_id"), F.round("score", 6).alias("similarity"))


@query(f"WITH {FOUND} SELECT query_id, doc_id, vec_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY rank) AS r FROM found) WHERE r = 1")
def k5_best_chunk_per_document(spark, d):
    return retrieval.first_wins(found(spark, d), ["query_id", "doc_id"], ["rank"]).select("query_id", "doc_id", "vec_id", F.round("score", 6).alias("score"))


@query(f"WITH {LINKED} SELECT a AS a_id, b AS b_id, round(s, 6) AS similarity FROM sims WHERE a < b AND s >= 0.3")
def j11_similar_documents(spark, d):
    every = vectors.course_pairs(linked(spark, d).where("kind is not null"), floor=0.3)
    return every.select(F.col("a").alias("a_id"), F.col("b").alias("b_id"), F.round("score", 6).alias("similarity"))


@query(f"WITH {CHUNKS} SELECT vec_id, doc_id FROM chunks WHERE NOT orphaned")
def p1_orphan_filter(spark, d):
    c = chunks(spark, d).select("vec_id", "doc_id", "orphaned")
    return retrieval.without_orphans(c, c.where("orphaned").select("doc_id")).select("vec_id", "doc_id")


@query(f"WITH {CHUNKS} SELECT vec_id, {BUCKET_SQL} AS bucket, 'context' AS off FROM chunks")
def p2_chunk_partition(spark, d):
    c = chunks(spark, d)
    of = lambda on: retrieval.bucket(F.col("kind"), F.col("classified"), F.lit(on))
    return c.select("vec_id", of(True).alias("bucket"), of(False).alias("off"))


@query(f"WITH {FOUND} SELECT query_id, string_agg(DISTINCT filename, ', ' ORDER BY filename) AS files FROM found WHERE bucket = 'signal' AND score >= 0.25 GROUP BY query_id")
def p3_strong_signals(spark, d):
    return retrieval.strong_signals(found(spark, d), 0.25)


@query(
    f"""WITH {FOUND} SELECT query_id, count(*) FILTER (WHERE bucket = 'context') AS context, count(*) FILTER (WHERE bucket = 'signal') AS signals, coalesce(string_agg(CASE WHEN bucket = 'context' THEN CAST(vec_id AS VARCHAR) END, ',' ORDER BY rank), '') AS chunks
  FROM found WHERE (vec_id % 7 <> 2 OR (vec_id * 11) % 1000 > 800) GROUP BY query_id"""
)
def c3_retrieval(spark, d):
    """Search without orphans, the adversarial filter, and what the context of each query is."""
    f = found(spark, d)
    verdict = chunks(spark, d).select("vec_id", (F.col("vec_id") % 7 == 2).alias("adversarial"), ((F.col("vec_id") * 11) % 1000).alias("took_ms"))
    f = retrieval.passed(f, verdict)
    shown = F.array_sort(F.collect_list(F.when(F.col("bucket") == "context", F.struct("rank", "vec_id"))))
    return f.groupBy("query_id").agg(F.count_if(F.col("bucket") == "context").alias("context"), F.count_if(F.col("bucket") == "signal").alias("signals"), F.array_join(F.transform(shown, lambda c: c["vec_id"].cast("string")), ",").alias("chunks"))


@query(f"WITH {CHUNKS} SELECT vec_id FROM chunks WHERE NOT (vec_id % 7 = 2 AND (vec_id * 11) % 1000 <= 800)")
def st16_adversarial_filter(spark, d):
    c = chunks(spark, d).select("vec_id")
    return retrieval.passed(c, c.withColumn("adversarial", F.col("vec_id") % 7 == 2).withColumn("took_ms", (F.col("vec_id") * 11) % 1000))


PARTNERS = f"""{EDGES}, found AS (SELECT b AS doc_id, a AS query_id, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS rank FROM sims WHERE a % {EACH} = 0 AND s >= {FLOOR}),
  src AS (SELECT query_id, doc_id, rank AS place FROM found WHERE rank <= 3), ways AS (SELECT src, dst FROM edges WHERE NOT rejected AND relation IN ('part_of_unit', 'applied_in') UNION SELECT dst, src FROM edges WHERE NOT rejected AND relation = 'part_of_unit'),
  p AS (SELECT query_id, dst AS partner, min(place) AS near FROM src JOIN ways ON ways.src = src.doc_id GROUP BY 1, 2),
  fresh AS (SELECT * FROM p WHERE partner % 11 <> 4 AND NOT EXISTS (SELECT 1 FROM found f WHERE f.query_id = p.query_id AND f.doc_id = p.partner AND f.rank <= 8))"""


@query(f"WITH {PARTNERS} SELECT query_id, partner, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY near, partner) AS place FROM fresh) WHERE place <= 4")
def c4_graph_expansion(spark, d):
    """Partners, one hop from the first documents of each query's context; here the context is documents of its course."""
    docs = linked(spark, d).where("kind is not null")
    q = docs.where(F.col("doc_id") % EACH == 0).select("course_id", F.col("doc_id").alias("query_id"), F.col("v").alias("q"))
    both = docs.join(q, "course_id").where("doc_id <> query_id").select("query_id", "doc_id", vectors.cosine(F.col("q"), F.col("v")).alias("score")).where(F.col("score") >= FLOOR)
    from ..operators.review import top_by

    ctx = top_by(both, ["query_id"], [F.desc("score"), "doc_id"], 8).withColumn("bucket", F.lit("context"))
    return retrieval.partner_documents(ctx, edges(spark, d), docs.where("doc_id % 11 = 4"))


@query(f"WITH {EDGES} SELECT src, dst, relation, confidence, round(similarity, 6) AS similarity FROM edges")
def c6_canonical_edges(spark, d):
    return edges(spark, d).select("src", "dst", "relation", "confidence", F.round("similarity", 6).alias("similarity"))


@query(
    f"""WITH {VERDICTS}, cand AS (SELECT *, a_kind IN ('unknown', 'syllabus') AND b_kind IN ('unknown', 'syllabus') AS auto, (a_id + b_id) % 4 = 1 AS cached FROM verdicts WHERE similarity < 0.45 AND NOT ((a_id + b_id) % 5 = 0 AND a_id % 2 = 0))
  SELECT a_id, b_id, CASE WHEN auto THEN 'none' ELSE relation END AS relation, CASE WHEN auto THEN 'auto' WHEN cached THEN 'cache' ELSE 'model' END AS decided_by FROM cand"""
)
def c5_linker(spark, d):
    """Candidate pairs, near copies and vetoed pairs dropped, and who decides on each: a rule, the cache or the model."""
    v = verdicts(spark, d).where("similarity < 0.45")
    veto = v.where("(a_id + b_id) % 5 = 0 and a_id % 2 = 0").select("a_id", "b_id")
    ways = [("b_id", "a_id", "solution_of"), ("a_id", "b_id", "part_of_unit")]
    rejected = veto.select(F.explode(F.array(*[F.struct(F.col(s).alias("src"), F.col(t).alias("dst"), F.lit(r).alias("relation")) for s, t, r in ways])).alias("r")).select("r.*")
    gone = graph.fully_rejected(rejected).toDF("a_id", "b_id")
    v = v.join(gone, ["a_id", "b_id"], "left_anti")
    stamp = linked(spark, d).select("doc_id", (F.col("doc_id") * 3).alias("classified_at"))
    cache = v.select("a_id", "b_id", (F.col("a_id") * 3).alias("a_at"), F.when((F.col("a_id") + F.col("b_id")) % 4 == 1, F.col("b_id") * 3).otherwise(F.col("b_id")).alias("b_at"))
    fresh = graph.fresh_decisions(cache, stamp).select("a_id", "b_id", F.lit(True).alias("cached"))
    auto = F.col("a_kind").isin("unknown", "syllabus") & F.col("b_kind").isin("unknown", "syllabus")
    v = v.join(fresh, ["a_id", "b_id"], "left")
    return v.select("a_id", "b_id", F.when(auto, "none").otherwise(F.col("relation")).alias("relation"), F.when(auto, "auto").when(F.col("cached") & (F.col("b_id") > 0), "cache").otherwise("model").alias("decided_by"))


@query(f"WITH {LINKED} SELECT a_id, b_id FROM pairs WHERE (a_id + b_id) % 4 < 2")
def c7_fully_rejected(spark, d):
    """Pairs with a veto of both relations, in one direction or the other; the rest lack one, or have vetoes that don't count."""
    p = pairs(spark, d).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    kind = (F.col("src") + F.col("dst")) % 4
    veto = lambda s, t, name: F.struct(F.col(s).alias("src"), F.col(t).alias("dst"), F.lit(name).alias("relation"))
    rows = F.when(kind == 0, F.array(veto("src", "dst", "solution_of"), veto("dst", "src", "part_of_unit"))).when(kind == 1, F.array(veto("dst", "src", "solution_of"), veto("src", "dst", "part_of_unit")))
    rows = rows.when(kind == 2, F.array(veto("src", "dst", "solution_of"), veto("dst", "src", "solution_of"))).otherwise(F.array(veto("src", "dst", "part_of_unit"), veto("src", "dst", "applied_in")))
    return graph.fully_rejected(p.select(F.explode(rows).alias("r")).select("r.*")).toDF("a_id", "b_id")


@query(
    f"""WITH {EDGES}, r AS (SELECT src, dst, relation, (rejected OR ((src * dst) % 5 = 0 AND relation = 'part_of_unit')) AND NOT dst % 7 = 0 AS now FROM edges)
  SELECT src, dst, relation, now AS rejected, now AS veto FROM r"""
)
def c8_reject_edges(spark, d):
    """Edges and vetoes after teachers have rejected some and taken back rejections, whose edges stay."""
    e = edges(spark, d).select("src", "dst", "relation", "rejected")
    e, vetoes = graph.reject_edges(e, e.where("rejected"), e.where("(src * dst) % 5 = 0 and relation = 'part_of_unit'"))
    e, vetoes = graph.unreject_edges(e, vetoes, e.where("dst % 7 = 0").unionByName(e.where("dst % 7 = 1").withColumn("relation", F.lit("no_such"))))
    v = vetoes.withColumn("veto", F.lit(True))
    return e.join(v, ["src", "dst", "relation"], "left").select("src", "dst", "relation", "rejected", F.coalesce("veto", F.lit(False)).alias("veto"))


@query(
    f"""WITH {EDGES}, s AS (SELECT DISTINCT src AS doc_id FROM edges WHERE src % 2 = 0), e AS (SELECT * FROM edges WHERE NOT rejected AND src <> dst)
  SELECT src AS source, dst AS partner FROM e WHERE relation IN ('part_of_unit', 'applied_in') AND src IN (SELECT doc_id FROM s) UNION SELECT dst, src FROM e WHERE relation = 'part_of_unit' AND dst IN (SELECT doc_id FROM s) AND src NOT IN (SELECT doc_id FROM s)"""
)
def j12_graph_neighbours(spark, d):
    e = edges(spark, d)
    return graph.neighbours(e, e.where("src % 2 = 0").select(F.col("src").alias("doc_id")))


@query(f"WITH {EDGES} SELECT DISTINCT src AS doc_id, dst AS partner FROM edges JOIN ldocs a ON a.doc_id = src AND a.kind = 'lecture' JOIN ldocs b ON b.doc_id = dst AND b.kind IN {SIGNALS} WHERE relation = 'applied_in' AND NOT rejected")
def j13_applied_assignments(spark, d):
    return graph.applied_assignments(edges(spark, d), linked(spark, d))


@query(
    f"""WITH {EDGES}, n AS (SELECT doc_id FROM ldocs WHERE coalesce(kind, 'unclassified') IN ('lecture', 'reading', 'exam', 'unclassified', 'syllabus'))
  SELECT src, dst, relation, rejected FROM edges WHERE relation IN ('part_of_unit', 'prerequisite') AND src IN (FROM n) AND dst IN (FROM n)"""
)
def p21_visible_graph(spark, d):
    _, e = graph.visible_graph(linked(spark, d), edges(spark, d), ["lecture", "reading", "exam", "unclassified", "syllabus"], ["part_of_unit", "prerequisite"], True)
    return e.select("src", "dst", "relation", "rejected")


@query(f"WITH {EDGES} SELECT src AS node, dst AS other FROM edges UNION SELECT dst, src FROM edges UNION SELECT src, src FROM edges UNION SELECT dst, dst FROM edges")
def p22_adjacency(spark, d):
    return graph.adjacency(edges(spark, d))


@query(
    f"""WITH {EDGES}, st AS (SELECT DISTINCT doc_id, course_id FROM ldocs), n AS (SELECT course_id, count(*) AS nodes FROM ldocs GROUP BY 1), e AS (SELECT course_id, count(*) AS edges FROM edges JOIN ldocs ON doc_id = src GROUP BY 1),
  stale AS (SELECT course_id, count(*) AS stale FROM verdicts JOIN ldocs ON doc_id = a_id WHERE (a_id + b_id) % 4 <> 1 GROUP BY 1)
  SELECT n.course_id, nodes, coalesce(edges, 0) AS edges, coalesce(stale, 0) AS stale, n.course_id = 1 OR coalesce(stale, 0) > 0 AS pending FROM n LEFT JOIN e USING (course_id) LEFT JOIN stale USING (course_id)"""
)
def c14_graph_view(spark, d):
    """Nodes, edges and cached decisions that no longer hold by course; pending if a relink is queued or something is stale (j9)."""
    docs = linked(spark, d)
    course = docs.select("doc_id", "course_id")
    e = edges(spark, d).join(course, F.col("src") == F.col("doc_id")).groupBy("course_id").agg(F.count("*").alias("edges"))
    stamp = docs.select("doc_id", (F.col("doc_id") * 3).alias("classified_at"))
    cache = verdicts(spark, d).select("a_id", "b_id", (F.col("a_id") * 3).alias("a_at"), F.when((F.col("a_id") + F.col("b_id")) % 4 == 1, F.col("b_id") * 3).otherwise(F.lit(-1)).alias("b_at"))
    s = graph.stale_decisions(cache, stamp).join(course, F.col("a_id") == F.col("doc_id")).groupBy("course_id").agg(F.count("*").alias("stale"))
    out = docs.groupBy("course_id").agg(F.count("*").alias("nodes")).join(e, "course_id", "left").join(s, "course_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select("course_id", "nodes", zero("edges"), zero("stale"), ((F.col("course_id") == 1) | (F.coalesce("stale", F.lit(0)) > 0)).alias("pending"))


@query(f"WITH {CHUNKS} SELECT query_id, vec_id, rank FROM (SELECT q.vec_id AS query_id, c.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(q.v, c.v) DESC, c.vec_id) AS rank FROM chunks q JOIN chunks c ON q.vec_id % {EACH} = 0) WHERE rank <= 20")
def c15_chunk_search(spark, d):
    """Top chunks without threshold or reranking."""
    c = chunks(spark, d)
    return vectors.top_k(c.where(F.col("vec_id") % EACH == 0).select(F.col("vec_id").alias("query_id"), "v"), c, 20).select("query_id", "vec_id", "rank")


@query(f"WITH {CHUNKS} SELECT doc_id, chunk_index, vec_id FROM (SELECT doc_id, chunk_index // 2 AS chunk_index, vec_id, row_number() OVER (PARTITION BY doc_id, chunk_index // 2 ORDER BY vec_id DESC) AS r FROM chunks) WHERE r = 1")
def s10_scroll_by_document(spark, d):
    c = chunks(spark, d).select("doc_id", F.expr("chunk_index div 2").alias("chunk_index"), "vec_id")
    return retrieval.scrolled(c, version="vec_id").select("doc_id", "chunk_index", "vec_id").orderBy("doc_id", "chunk_index")


@query(f"WITH {VERDICTS} SELECT a_id, b_id FROM verdicts WHERE (a_id + b_id) % 4 <> 1")
def j9_stale_decisions(spark, d):
    """Cached decisions of which one document has been classified anew, by two joins to the documents."""
    stamp = linked(spark, d).select("doc_id", (F.col("doc_id") * 3).alias("classified_at"))
    cache = pairs(spark, d).select(F.col("a").alias("a_id"), F.col("b").alias("b_id"), (F.col("a") * 3).alias("a_at"), F.when((F.col("a") + F.col("b")) % 4 == 1, F.col("b") * 3).otherwise(F.lit(-1)).alias("b_at"))
    return graph.stale_decisions(cache, stamp).select("a_id", "b_id")


POOL = "x AS (SELECT doc_id, unnest(range(1, 65)) AS i, v FROM {0}), m AS (SELECT doc_id, i, avg(v[i]) AS x FROM x GROUP BY ALL), n AS (SELECT doc_id, sqrt(sum(x * x)) AS norm FROM m GROUP BY doc_id), pool AS (SELECT doc_id, round(max(x / norm), 6) + 0 AS largest FROM m JOIN n USING (doc_id) GROUP BY doc_id)"


@query(
    f"""WITH {COURSE_DOCS}, {CHUNKS}, {REPLIES}, p AS (SELECT doc_id, CASE WHEN json_valid({BARE}) THEN json_extract_string({BARE}, '$.kind') END AS k, CASE WHEN json_valid({BARE}) THEN json_extract_string({BARE}, '$.confidence') END AS c FROM replies),
  d AS (SELECT doc_id, doc_id % 23 = 0 AS blank, CASE WHEN doc_id % 3 <> 0 AND k IN {KINDS} AND c IS NOT NULL THEN k ELSE kind END AS kind FROM course_docs JOIN p USING (doc_id)), live AS (SELECT c.doc_id, vec_id, v FROM chunks c JOIN d USING (doc_id) WHERE NOT blank), {POOL.format('live')},
  pts AS (SELECT doc_id, count(*) AS points FROM live JOIN d USING (doc_id) WHERE kind IS DISTINCT FROM 'sample_solution' GROUP BY 1), l AS (SELECT doc_id, count(*) AS chunks FROM live GROUP BY 1)
  SELECT d.doc_id, d.kind, CASE WHEN blank OR l.chunks > 0 THEN 'ready' ELSE 'failed' END AS status, coalesce(l.chunks, 0) AS chunks, coalesce(points, 0) AS points, largest FROM d LEFT JOIN l USING (doc_id) LEFT JOIN pts USING (doc_id) LEFT JOIN pool USING (doc_id)"""
)
def c1_pool_and_upsert(spark, d):
    """The end of an ingest: classifier's verdicts, points, pooled vectors and status; `c1_ingest` cuts the chunks."""
    i = F.col("doc_id")
    verdict = replies(spark, d).select("doc_id", text.verdict(F.col("raw"), KINDS)["kind"].alias("verdict"))
    docs = course_docs(spark, d).join(verdict, "doc_id").select("doc_id", (i % 23 == 0).alias("blank"), "kind", (i % 3 == 0).alias("locked"), "verdict")
    documents, points = ingest.ingested(docs, chunks(spark, d).select("doc_id", "chunk_index", "v"))
    n = points.groupBy("doc_id").agg(F.count("*").alias("points"))
    return documents.join(n, "doc_id", "left").select("doc_id", "kind", "status", "chunks", F.coalesce("points", F.lit(0)).alias("points"), (F.round(F.array_max("pooled"), 6) + 0).alias("largest"))


@query(
    f"""WITH {CHUNKS} SELECT 'course_' || doc_id % 4 || CASE WHEN doc_id % 3 > 1 THEN '_v' || doc_id % 3 ELSE '' END AS collection, count(*) AS points, CAST(sum(vec_id) AS BIGINT) AS ids, round(sum(v[1]), 6) AS first FROM chunks WHERE kind IS DISTINCT FROM 'sample_solution' GROUP BY 1"""
)
def s11_vector_sink(spark, d):
    """Points appended in two batches and read back, a partition for each collection and version."""
    path, c = shared_path(spark, "points"), chunks(spark, d).where("kind is distinct from 'sample_solution'").select("doc_id", "vec_id", "v")
    for odd in (0, 1):
        tables.append_points(c.where(F.col("vec_id") % 2 == odd), (F.col("doc_id") % 4).cast("string"), F.col("doc_id") % 3, path)
    back = spark.read.schema("doc_id long, vec_id long, v array<double>, collection string").parquet(path)
    return back.groupBy("collection").agg(F.count("*").alias("points"), F.sum("vec_id").alias("ids"), F.round(F.sum(F.get("v", F.lit(0))), 6).alias("first"))
