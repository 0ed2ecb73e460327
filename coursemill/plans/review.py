"""Conversation review queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import review
from .bindings import FEEDBACK, FLAGS, MESSAGES, NOTES, REVIEWS, STATUSES, conversation_ids, course_docs, COURSE_DOCS, feedback, flags, messages, notes, reviews, table
from .registry import query

TURNS = f"{MESSAGES}, turns AS (SELECT *, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS user_turn FROM messages)"
OPEN = f"{MESSAGES}, {FEEDBACK}, {NOTES}, open_down AS (SELECT f.* FROM feedback f WHERE rating = 'down' AND NOT acknowledged AND NOT EXISTS (SELECT 1 FROM notes n WHERE n.message_id = f.message_id))"


@query(f"WITH {TURNS} SELECT message_id, role, user_turn FROM turns")
def w1_turn_numbers(spark, d):
    return review.numbered_turns(messages(spark, d)).select("message_id", "role", "user_turn")


@query(f"WITH {TURNS}, {FLAGS} SELECT message_id, user_turn FROM turns WHERE role = 'assistant' AND EXISTS (SELECT 1 FROM flags WHERE flags.conv_id = turns.conv_id AND flags.turn = user_turn)")
def w2_flagged_answers(spark, d):
    return review.answers_on_flagged_turns(messages(spark, d), flags(spark, d)).select("message_id", "user_turn")


@query(f"WITH {MESSAGES} SELECT conv_id, turn, back FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM messages WHERE role = 'user') WHERE back <= 5")
def w3_last_user_messages(spark, d):
    return review.last_per_conversation(messages(spark, d), "user", 5).select("conv_id", "turn", "back")


@query(
    """WITH near AS (SELECT DISTINCT user_id AS conv_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS turn, CAST(json_extract_string(props, '$.k') AS BIGINT) % 12 AS doc FROM events WHERE event_type = 'view'),
  hit AS (SELECT t.conv_id, t.turn, n.doc FROM near t JOIN near n ON n.conv_id = t.conv_id AND n.turn BETWEEN t.turn - 4 AND t.turn GROUP BY ALL HAVING count(DISTINCT n.turn) >= 2)
  SELECT conv_id, turn, string_agg(CAST(doc AS VARCHAR), ',' ORDER BY doc) AS docs FROM hit GROUP BY conv_id, turn"""
)
def w4_sliding_proximity(spark, d):
    views = table(spark, d, "events").where("event_type = 'view'")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    near = views.select(F.col("user_id").alias("conv_id"), F.row_number().over(order).cast("long").alias("turn"), (F.get_json_object("props", "$.k").cast("long") % 12).alias("doc"))
    from ..operators.guard import proximity

    return proximity(near).select("conv_id", "turn", F.array_join(F.transform("docs", lambda x: x.cast("string")), ",").alias("docs"))


@query(f"WITH {COURSE_DOCS} SELECT course_id, doc_id, rank FROM (SELECT course_id, doc_id, row_number() OVER (PARTITION BY course_id ORDER BY n_chars DESC, doc_id) AS rank FROM course_docs WHERE status = 'ready') WHERE rank <= 3")
def w6_latest_ready_documents(spark, d):
    ready = course_docs(spark, d).where("status = 'ready'").select("course_id", "doc_id", "n_chars")
    return review.top_by(ready, ["course_id"], [F.desc("n_chars"), "doc_id"], 3).select("course_id", "doc_id", "rank")


@query("SELECT content_hash, doc_id, lang FROM (SELECT sha256(text) AS content_hash, doc_id, lang, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def w7_first_occurrence_wins(spark, d):
    docs = table(spark, d, "documents").select(F.sha2("text", 256).alias("content_hash"), "doc_id", "lang")
    return docs.groupBy("content_hash").agg(F.min(F.struct("doc_id", "lang")).alias("f")).select("content_hash", "f.doc_id", "f.lang")


@query(f"WITH {MESSAGES}, {REVIEWS}, m AS (SELECT conv_id, max(turn) FILTER (WHERE role = 'user') AS last_user_turn FROM messages GROUP BY conv_id) SELECT m.conv_id, m.last_user_turn FROM m LEFT JOIN reviews r USING (conv_id) WHERE last_user_turn IS NOT NULL AND (reviewed IS NULL OR last_user_turn > reviewed)")
def w9_unreviewed(spark, d):
    last = messages(spark, d).where("role = 'user'").groupBy("conv_id").agg(F.max("turn").alias("last_user_turn"))
    return last.join(reviews(spark, d), "conv_id", "left").where("reviewed is null or last_user_turn > reviewed").select("conv_id", "last_user_turn")


@query(
    f"""WITH {OPEN}, {FLAGS}, {REVIEWS}, base AS (SELECT conv_id, user_id, course_id, count(*) AS messages, max(turn) FILTER (WHERE role = 'user') AS last_user_turn FROM messages GROUP BY ALL),
  votes AS (SELECT conv_id, count(*) FILTER (WHERE rating = 'up') AS up, count(*) FILTER (WHERE rating = 'down') AS down FROM feedback GROUP BY conv_id),
  o AS (SELECT conv_id, count(*) AS n FROM open_down GROUP BY conv_id), marks AS (SELECT conv_id, string_agg(DISTINCT flag, ',' ORDER BY flag) AS flags FROM flags WHERE NOT acknowledged GROUP BY conv_id)
  SELECT conv_id, user_id, course_id, messages, last_user_turn, coalesce(up, 0) AS up, coalesce(down, 0) AS down, coalesce(n, 0) AS unaddressed_down, coalesce(flags, '') AS flags,
    coalesce(last_user_turn > reviewed, reviewed IS NULL AND last_user_turn IS NOT NULL) AS unreviewed
  FROM base LEFT JOIN votes USING (conv_id) LEFT JOIN o USING (conv_id) LEFT JOIN marks USING (conv_id) LEFT JOIN reviews USING (conv_id)"""
)
def a20_dashboard(spark, d):
    return review.dashboard(messages(spark, d), feedback(spark, d), notes(spark, d), flags(spark, d), reviews(spark, d))


@query(
    f"""WITH {OPEN}, {FLAGS}, o AS (SELECT conv_id, count(*) AS unaddressed_down FROM open_down GROUP BY conv_id), x AS (SELECT DISTINCT conv_id FROM flags WHERE flag = 'extraction_attempt')
  SELECT c.conv_id, x.conv_id IS NOT NULL AS extraction, coalesce(unaddressed_down, 0) AS unaddressed_down FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN o USING (conv_id) LEFT JOIN x ON x.conv_id = c.conv_id
  ORDER BY extraction DESC, unaddressed_down DESC, c.conv_id"""
)
def k9_review_order(spark, d):
    extraction = flags(spark, d).where("flag = 'extraction_attempt'").select("conv_id", F.lit(True).alias("extraction")).distinct()
    n = review.unaddressed(feedback(spark, d), notes(spark, d)).groupBy("conv_id").agg(F.count("*").alias("unaddressed_down"))
    out = conversation_ids(spark, d).join(n, "conv_id", "left").join(extraction, "conv_id", "left").select("conv_id", F.coalesce("extraction", F.lit(False)).alias("extraction"), F.coalesce("unaddressed_down", F.lit(0)).alias("unaddressed_down"))
    return out.orderBy(F.desc("extraction"), F.desc("unaddressed_down"), "conv_id")


@query(f"WITH {COURSE_DOCS} SELECT s.status, count(doc_id) AS n FROM (SELECT unnest([{', '.join(repr(s) for s in STATUSES)}]) AS status) s LEFT JOIN course_docs USING (status) GROUP BY s.status")
def a9_count_by_status(spark, d):
    known = spark.createDataFrame([(s,) for s in STATUSES], "status string")
    n = course_docs(spark, d).groupBy("status").agg(F.count("*").alias("n"))
    return known.join(n, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"WITH {MESSAGES}, {FEEDBACK} SELECT m.course_id, CAST(coalesce(sum(CASE WHEN rating = 'up' THEN 1 ELSE 0 END), 0) AS BIGINT) AS up, CAST(coalesce(sum(CASE WHEN rating = 'down' THEN 1 ELSE 0 END), 0) AS BIGINT) AS down FROM messages m LEFT JOIN feedback f USING (message_id) GROUP BY m.course_id")
def a10_vote_totals(spark, d):
    votes = feedback(spark, d).groupBy((F.col("conv_id") % 5).alias("course_id")).agg(F.count_if(F.col("rating") == "up").alias("up"), F.count_if(F.col("rating") == "down").alias("down"))
    courses = messages(spark, d).select("course_id").distinct()
    return courses.join(votes, "course_id", "left").select("course_id", F.coalesce("up", F.lit(0)).alias("up"), F.coalesce("down", F.lit(0)).alias("down"))


@query(f"WITH {MESSAGES}, {FEEDBACK} SELECT category, count(*) AS n FROM feedback WHERE rating = 'down' GROUP BY category ORDER BY n DESC, category NULLS LAST")
def a11_categories_by_count(spark, d):
    return feedback(spark, d).where("rating = 'down'").groupBy("category").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc_nulls_last("category"))


@query("SELECT event_type AS attribute, json_extract_string(props, '$.k') AS v, count(*) AS n FROM events GROUP BY ALL HAVING count(*) >= 12 ORDER BY attribute, n DESC, v")
def a12_frequent_values(spark, d):
    e = table(spark, d, "events").groupBy(F.col("event_type").alias("attribute"), F.get_json_object("props", "$.k").alias("v")).agg(F.count("*").alias("n"))
    return e.where("n >= 12").orderBy("attribute", F.desc("n"), "v")


@query("SELECT attribute, string_agg(v || ':' || n, ' ' ORDER BY n DESC, v) AS suggestions FROM (SELECT event_type AS attribute, json_extract_string(props, '$.k') AS v, count(*) AS n FROM events WHERE event_type IN ('click', 'view') GROUP BY ALL HAVING count(*) >= 2) GROUP BY attribute")
def a26_suggestions_by_attribute(spark, d):
    e = table(spark, d, "events").where(F.col("event_type").isin("click", "view")).groupBy(F.col("event_type").alias("attribute"), F.get_json_object("props", "$.k").alias("v")).agg(F.count("*").alias("n"))
    listed = e.where("n >= 2").groupBy("attribute").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "v"))).alias("s"))
    return listed.select("attribute", F.array_join(F.transform("s", lambda x: F.concat(x["v"], F.lit(":"), (-x["m"]).cast("string"))), " ").alias("suggestions"))


@query(
    """SELECT o_custkey, string_agg(DISTINCT o_orderpriority, '|' ORDER BY o_orderpriority) AS priorities, count(DISTINCT o_orderpriority) AS n, min(o_orderkey) AS first_key FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderpriority) > 1"""
)
def a13_distinct_arrays(spark, d):
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_set("o_orderpriority")).alias("p"), F.min("o_orderkey").alias("first_key"))
    return o.where(F.size("p") > 1).select("o_custkey", F.array_join("p", "|").alias("priorities"), F.size("p").cast("long").alias("n"), "first_key")


@query(f"WITH {FLAGS} SELECT conv_id, string_agg(DISTINCT flag, ',' ORDER BY flag) AS flags FROM flags WHERE NOT acknowledged GROUP BY conv_id")
def a14_open_flags(spark, d):
    return flags(spark, d).where("not acknowledged").groupBy("conv_id").agg(F.array_join(F.array_sort(F.collect_set("flag")), ",").alias("flags"))


@query("SELECT CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_orderpriority END AS semester, count(DISTINCT o_custkey) AS members, min(o_custkey) AS first_member, count(*) AS n FROM orders GROUP BY 1 ORDER BY semester DESC NULLS LAST")
def a18_groups_newest_first(spark, d):
    o = table(spark, d, "orders").groupBy(F.when(F.col("o_orderkey") % 10 != 0, F.col("o_orderpriority")).alias("semester"))
    return o.agg(F.countDistinct("o_custkey").alias("members"), F.min("o_custkey").alias("first_member"), F.count("*").alias("n")).orderBy(F.desc_nulls_last("semester"))


@query(f"WITH {NOTES}, {MESSAGES}, n AS (SELECT conv_id, created, conv_id % 3 AS viewed, conv_id % 6 = 5 AS never FROM notes) SELECT conv_id FROM (SELECT DISTINCT conv_id FROM conversations) c WHERE EXISTS (SELECT 1 FROM n WHERE n.conv_id = c.conv_id AND (never OR n.created > n.viewed))")
def j5_unread_notes(spark, d):
    n = notes(spark, d).select("conv_id", "created")
    seen = conversation_ids(spark, d).withColumn("viewed", F.when(F.col("conv_id") % 6 != 5, F.col("conv_id") % 3))
    return seen.join(n, (seen["conv_id"] == n["conv_id"]) & (seen["viewed"].isNull() | (n["created"] > seen["viewed"])), "left_semi").select("conv_id")


@query(f"WITH {NOTES} SELECT conv_id % 5 AS course_id, count(*) AS unread FROM notes WHERE conv_id % 6 = 5 OR created > conv_id % 3 GROUP BY 1")
def a25_unread_per_course(spark, d):
    return j5_unread_notes(spark, d).groupBy((F.col("conv_id") % 5).alias("course_id")).agg(F.count("*").alias("unread"))


@query(f"WITH {OPEN} SELECT message_id, category FROM open_down")
def j6_unaddressed_down_votes(spark, d):
    return review.unaddressed(feedback(spark, d), notes(spark, d)).select("message_id", "category")


@query(
    f"""WITH {MESSAGES}, {FEEDBACK} SELECT c.conv_id, (SELECT count(*) FROM messages m WHERE m.conv_id = c.conv_id) AS messages, (SELECT count(*) FROM feedback f WHERE f.conv_id = c.conv_id AND rating = 'up') AS up,
  (SELECT max(turn) FROM messages m WHERE m.conv_id = c.conv_id AND role = 'user') AS last_user_turn FROM (SELECT DISTINCT conv_id FROM conversations) c"""
)
def j7_counts_per_conversation(spark, d):
    m = messages(spark, d).groupBy("conv_id").agg(F.count("*").alias("messages"), F.max(F.when(F.col("role") == "user", F.col("turn"))).alias("last_user_turn"))
    up = feedback(spark, d).where("rating = 'up'").groupBy("conv_id").agg(F.count("*").alias("up"))
    return m.join(up, "conv_id", "left").select("conv_id", "messages", F.coalesce("up", F.lit(0)).alias("up"), "last_user_turn")


@query(f"WITH {NOTES} SELECT note_id, a.n_name AS author, b.n_name AS acknowledger FROM notes JOIN nation a ON a.n_nationkey = author_id LEFT JOIN nation b ON b.n_nationkey = CASE WHEN note_id % 3 = 0 THEN author_id + 7 END")
def j4_two_names(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    a, b = n.toDF("author_id", "author"), n.toDF("ack_id", "acknowledger")
    rows = notes(spark, d).withColumn("ack_id", F.when(F.col("note_id") % 3 == 0, F.col("author_id") + 7))
    return rows.join(a, "author_id").join(b, "ack_id", "left").select("note_id", "author", "acknowledger")


@query(
    f"""WITH {TURNS}, {FLAGS}, hidden AS (SELECT message_id FROM turns WHERE role = 'assistant' AND (message_id % 5 = 0 OR EXISTS (SELECT 1 FROM flags WHERE flags.conv_id = turns.conv_id AND flag = 'constraint_lifted' AND flags.turn = user_turn)))
  SELECT message_id, CASE WHEN message_id NOT IN (SELECT message_id FROM hidden) THEN length(text) END AS chunks FROM turns WHERE role = 'assistant'"""
)
def j19_suppressed_chunks(spark, d):
    m = review.numbered_turns(messages(spark, d)).where("role = 'assistant'")
    rewritten = flags(spark, d).where("flag = 'constraint_lifted'").select("conv_id", F.col("turn").alias("user_turn")).distinct()
    hidden = m.where("message_id % 5 = 0").select("message_id").unionByName(m.join(rewritten, ["conv_id", "user_turn"], "left_semi").select("message_id")).distinct().withColumn("hide", F.lit(True))
    return m.join(hidden, "message_id", "left").select("message_id", F.when(F.col("hide").isNull(), F.length("text")).cast("long").alias("chunks"))


@query("SELECT s.suggestion, s.conv_id FROM (SELECT conv_id, unnest(['clarity', 'scope', 'examples']) AS suggestion FROM (SELECT DISTINCT conv_id FROM conversations)) s WHERE NOT EXISTS (SELECT 1 FROM conversations c WHERE c.conv_id = s.conv_id AND c.turn % 4 = CASE s.suggestion WHEN 'clarity' THEN 3 WHEN 'scope' THEN 5 ELSE 2 END)")
def p19_not_yet_coached(spark, d):
    kind = F.element_at(F.create_map(F.lit(3), F.lit("clarity"), F.lit(2), F.lit("examples")), (F.col("turn") % 4).cast("int"))
    trail = table(spark, d, "conversations").select("conv_id", kind.alias("suggestion")).where("suggestion is not null").distinct()
    offered = conversation_ids(spark, d).withColumn("suggestion", F.explode(F.array(*map(F.lit, ("clarity", "scope", "examples")))))
    return offered.join(trail, ["conv_id", "suggestion"], "left_anti").select("suggestion", "conv_id")


@query("SELECT event_id, ts, user_id FROM events WHERE (ts, event_id) > (TIMESTAMP '2024-01-10', 100) ORDER BY ts, event_id LIMIT 200")
def s9_keyset_page(spark, d):
    from datetime import datetime

    rows = table(spark, d, "events").select("event_id", "ts", "user_id")
    return review.page_after(rows.withColumn("ts", F.col("ts")), ["ts", "event_id"], (datetime(2024, 1, 10), 100), 200)
