"""Queries of tables that change: upserts, an incremental ledger, claims, and a merge in one commit."""

from __future__ import annotations

import contextlib

from pyspark.sql import functions as F

from ..operators import sync
from ..operators.durable import shared_path
from ..sources.store import Store, claim
from ..streaming import flows
from .bindings import COURSE_DOCS, USAGE, course_docs, nth, table
from .registry import query
from .sync import MERGE, ROLES, merge_docs


@query(
    "WITH n AS (SELECT user_id, event_type, arg_max(value, event_id) AS v FROM events WHERE event_id % 3 = 0 GROUP BY ALL), o AS (SELECT DISTINCT user_id, event_type, 0.5 AS v FROM events WHERE event_id % 3 = 1) SELECT user_id, event_type, round(coalesce(n.v, CAST(o.v AS DOUBLE)), 6) AS v FROM o FULL JOIN n USING (user_id, event_type)"
)
def s12_upsert_sink(spark, d):
    """Two batches into a stored table, the second of them twice; its replay changes nothing."""
    store = Store(spark, shared_path(spark, "store"))
    store.run(lambda t: t.create("latest", "user_id long, event_type string, v double", ["user_id", "event_type"], 8))
    e = table(spark, d, "events")
    put = store.sink("latest", "events", seq="event_id")
    put(e.where("event_id % 3 = 1").select("user_id", "event_type", F.lit(0.5).alias("v"), "event_id"), 0)
    new = e.where("event_id % 3 = 0").select("user_id", "event_type", F.col("value").alias("v"), "event_id")
    put(new, 1)
    put(new.withColumn("v", F.lit(-1.0)), 1)
    return store.read("latest").withColumn("v", F.round("v", 6))


@query(f"WITH {USAGE} SELECT user_id, course_id, day, model, CAST(sum(prompt) AS BIGINT) AS prompt, CAST(sum(completion) AS BIGINT) AS completion, count(*) AS requests FROM usage GROUP BY ALL")
def a1_ledger_stream(spark, d):
    """Usage that a stream adds to the stored ledger micro-batch by micro-batch; a restart finds nothing new."""
    path = shared_path(spark, "ledger")
    store = Store(spark, f"{path}/store")
    sums = ("prompt", "completion", "requests")
    store.run(lambda t: t.create("usage", "user_id long, course_id long, day date, model string, prompt long, completion long, requests long", ["user_id", "course_id", "day", "model"], 8))
    for _ in range(2):
        e = flows.file_stream(spark, d, "events")
        rows = e.select("user_id", (F.col("user_id") % 10).alias("course_id"), F.to_date("ts").alias("day"), F.col("event_type").alias("model"), F.floor(F.col("value") * 100).cast("long").alias("prompt"), F.get_json_object("props", "$.k").cast("long").alias("completion"), F.lit(1).cast("long").alias("requests"))
        rows.writeStream.foreachBatch(store.sink("usage", "usage", add=sums)).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return store.read("usage")


@query(
    f"""WITH {COURSE_DOCS}, p AS (SELECT doc_id, status, row_number() OVER (PARTITION BY status ORDER BY n_chars, doc_id) AS r FROM course_docs)
  SELECT doc_id, CASE WHEN status = 'pending' AND r <= 15 THEN 'processing' ELSE status END AS status, CASE WHEN status = 'pending' AND r <= 15 THEN (['a', 'b', 'c'])[(r - 1) // 5 + 1] END AS claimant FROM p"""
)
def st4_stored_claims(spark, d):
    """A queue from which three claimants took five documents each, one commit after the other."""
    store = Store(spark, shared_path(spark, "queue"))
    store.run(lambda t: t.create("queue", "doc_id long, status string, created long, started long, claimant string", ["doc_id"], 8))
    rows = course_docs(spark, d).select("doc_id", "status", F.col("n_chars").cast("long").alias("created"), F.lit(None).cast("long").alias("started"), F.lit(None).cast("string").alias("claimant"))
    store.run(lambda t: t.upsert("queue", rows))
    for name in "abc":
        claim(store, "queue", name, 5, F.lit(600).cast("long"))
    return store.read("queue").select("doc_id", "status", "claimant")


ROLE_OF = "(['student', 'ta', 'teacher'])[CAST(r AS INTEGER) + 1]"


@query(
    f"""WITH {MERGE}, g AS (SELECT *, NOT orphaned AND (doc_id IN (FROM hit) OR coalesce(parent_id IN (FROM hit), false)) AS gone FROM md WHERE course_id = 'de'),
  mem AS (SELECT CASE c_nationkey % 3 WHEN 2 THEN 'fr' ELSE 'en' END AS course_id, c_custkey % 40 AS user_id, max(c_custkey % 3) AS r FROM customer GROUP BY ALL),
  led AS (SELECT CASE lang WHEN 'de' THEN 'en' ELSE lang END AS course_id, doc_id % 10 AS day, CAST(sum(n_chars) AS BIGINT) AS n FROM documents GROUP BY ALL)
  SELECT 'document' AS what, doc_id AS id, course_id, concat_ws(' ', status, orphaned, source_url) AS value FROM md WHERE course_id <> 'de'
  UNION ALL SELECT 'document', doc_id, 'en', concat_ws(' ', CASE WHEN NOT orphaned AND NOT gone AND NOT is_link THEN 'pending' ELSE status END, orphaned OR gone, CASE WHEN NOT gone THEN source_url END) FROM g
  UNION ALL SELECT 'member', user_id, course_id, {ROLE_OF} FROM mem UNION ALL SELECT 'tokens', day, course_id, CAST(n AS VARCHAR) FROM led
  UNION ALL SELECT DISTINCT 'config', doc_id % 30, CASE lang WHEN 'de' THEN 'en' ELSE lang END, 'k' || doc_id % 30 FROM documents
  UNION ALL SELECT DISTINCT 'course', CAST(0 AS BIGINT), lang, CASE lang WHEN 'de' THEN 'merged' ELSE 'active' END FROM documents"""
)
def c11_merge_commit(spark, d):
    """All tables of a course merge in one commit, after one that failed midway and left no trace."""
    store = Store(spark, shared_path(spark, "merge"))
    docs, lang = merge_docs(spark, d), F.col("lang").alias("course_id")
    c, texts = F.col("c_nationkey") % 3, table(spark, d, "documents")
    members = table(spark, d, "customer").select(F.when(c == 0, "de").when(c == 1, "en").otherwise("fr").alias("course_id"), (F.col("c_custkey") % 40).alias("user_id"), (F.col("c_custkey") % 3).alias("rank"))

    def filled(t):
        for name, rows, keys, buckets in (
            ("documents", docs, ["doc_id"], 8),
            ("members", members.groupBy("course_id", "user_id").agg(F.max("rank").alias("rank")).select("course_id", "user_id", nth(ROLES, F.col("rank")).alias("role")), ["course_id", "user_id"], 4),
            ("ledger", texts.groupBy(lang, (F.col("doc_id") % 10).alias("day")).agg(F.sum("n_chars").alias("tokens")), ["course_id", "day"], 4),
            ("config", texts.select(lang, F.concat(F.lit("k"), (F.col("doc_id") % 30).cast("string")).alias("name")).distinct(), ["course_id", "name"], 4),
            ("courses", texts.select(lang, F.lit("active").alias("state")).distinct(), ["course_id"], 1),
        ):
            t.create(name, rows.schema, keys, buckets)
            t.upsert(name, rows)

    def stopped(t):
        sync.merge_course(t, "de", "en")
        raise RuntimeError("stopped midway")

    store.run(filled)
    with contextlib.suppress(RuntimeError):
        store.run(stopped)
    store.run(lambda t: sync.merge_course(t, "de", "en"))
    value = F.concat_ws(" ", "status", F.col("orphaned").cast("string"), "source_url")
    row = lambda name, what, i, v: store.read(name).select(F.lit(what).alias("what"), i.cast("long").alias("id"), "course_id", v.cast("string").alias("value"))
    out = row("documents", "document", F.col("doc_id"), value).unionByName(row("members", "member", F.col("user_id"), F.col("role"))).unionByName(row("ledger", "tokens", F.col("day"), F.col("tokens")))
    return out.unionByName(row("config", "config", F.substring("name", 2, 9), F.col("name"))).unionByName(row("courses", "course", F.lit(0), F.col("state")))
