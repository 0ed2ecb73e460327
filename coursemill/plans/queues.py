"""Queues, state by event order, and metrics over `events`."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import guard, metrics, queues
from .bindings import COURSE_DOCS, course_docs, table
from .registry import query


@query(f"WITH {COURSE_DOCS} SELECT doc_id FROM course_docs WHERE status = 'pending' ORDER BY n_chars, doc_id LIMIT 5")
def k6_claim_oldest(spark, d):
    return queues.claim_oldest(course_docs(spark, d), 5, "n_chars").select("doc_id")


@query(
    f"""WITH {COURSE_DOCS}, p AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars, doc_id) AS r FROM course_docs WHERE status = 'pending')
  SELECT doc_id, (['a', 'b', 'c'])[(r - 1) % 15 // 5 + 1] AS claimant, CASE WHEN r <= 15 THEN 1 ELSE 2 END AS round FROM p WHERE r <= 30"""
)
def st4_claims(spark, d):
    """Three claimants in two rounds: what one has claimed no other gets."""
    rows = course_docs(spark, d).select("doc_id", "status", "n_chars").withColumn("started", F.lit(None).cast("long"))
    one = queues.claims(rows, ["a", "b", "c"], 5, "n_chars")
    two = queues.claims(queues.claimed(rows, one, F.lit(1).cast("long")), ["a", "b", "c"], 5, "n_chars")
    return one.select("doc_id", "claimant", F.lit(1).alias("round")).unionByName(two.select("doc_id", "claimant", F.lit(2).alias("round")))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN least(CASE WHEN c_custkey % 8 <> 0 THEN c_custkey % 100 ELSE 42 END, 42) ELSE c_custkey % 100 END AS due FROM customer WHERE c_custkey % 3 = 0 OR c_custkey % 8 <> 0")
def st2_immediate_marks(spark, d):
    k = F.col("c_custkey")
    c = table(spark, d, "customer").select("c_custkey", (k % 100).alias("due"))
    return queues.mark_now(c.where(k % 8 != 0), c.where(k % 3 == 0), F.lit(42).cast("long"), "c_custkey")


@query("SELECT c_custkey, CASE WHEN c_custkey % 8 <> 0 THEN c_custkey % 100 END AS due, coalesce(c_custkey % 8 <> 0 AND c_custkey % 100 <= 42, false) AS taken FROM customer")
def st3_take_due(spark, d):
    k = F.col("c_custkey")
    taken, left = queues.take_due(table(spark, d, "customer").select("c_custkey", F.when(k % 8 != 0, k % 100).alias("due")), F.lit(42))
    return taken.withColumn("taken", F.lit(True)).unionByName(left.withColumn("taken", F.lit(False)))


DUE = "(SELECT s_suppkey, CASE WHEN s_suppkey % 6 <> 0 THEN s_suppkey * 37 % 100 END AS synced FROM supplier)"


def suppliers(spark, d):
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(k, F.when(k % 6 != 0, k * 37 % 100).alias("synced"))


@query(f"SELECT s_suppkey, synced FROM {DUE} WHERE synced IS NULL OR synced < 40 ORDER BY synced NULLS FIRST, s_suppkey")
def k7_due_list(spark, d):
    return queues.due_list(suppliers(spark, d), "synced", F.lit(40), "s_suppkey")


@query(f"SELECT s_suppkey FROM {DUE} WHERE synced IS NULL OR synced <= 100 - 24")
def st6_interval_poll(spark, d):
    return suppliers(spark, d).where("synced is null or synced <= 100 - 24").select("s_suppkey")


@query(f"SELECT s_suppkey FROM {DUE} WHERE synced >= 100 - 30")
def st7_prune_by_last_seen(spark, d):
    """What stays when rows not seen for 30 units are pruned."""
    return suppliers(spark, d).where("synced >= 100 - 30").select("s_suppkey")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN age > 7 WHEN o_orderstatus = 'F' THEN age > 30 ELSE false END AS deleted FROM (SELECT o_orderkey, o_orderstatus, o_custkey % 40 AS age FROM orders)")
def st8_grace_delete(spark, d):
    age, s = F.col("o_custkey") % 40, F.col("o_orderstatus")
    return table(spark, d, "orders").select("o_orderkey", F.when(s == "P", age > 7).when(s == "F", age > 30).otherwise(F.lit(False)).alias("deleted"))


@query("SELECT o_custkey, count(*) AS open FROM orders WHERE o_orderkey % 4 <> 0 AND o_orderkey % 100 > 10 GROUP BY o_custkey")
def p16_expiry(spark, d):
    """One-time tokens that are neither used nor expired."""
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", (F.col("o_orderkey") % 100).alias("expires"))
    used = rows.where("o_orderkey % 4 = 0").select("o_orderkey")
    return rows.where("expires > 10").join(used, "o_orderkey", "left_anti").groupBy("o_custkey").agg(F.count("*").alias("open"))


STALE = "(SELECT event_id, CASE WHEN event_type = 'view' THEN 'processing' ELSE 'ready' END AS status, CASE WHEN event_id % 9 <> 0 THEN event_id % 2000 END AS started FROM events)"


@query(f"SELECT event_id, CASE WHEN s THEN 'pending' ELSE status END AS status, CASE WHEN NOT s THEN started END AS started FROM (SELECT *, status = 'processing' AND (started IS NULL OR started < 1500 - 600) AS s FROM {STALE})")
def st5_stale_reset(spark, d):
    i = F.col("event_id")
    rows = table(spark, d, "events").select(i, F.when(F.col("event_type") == "view", "processing").otherwise("ready").alias("status"), F.when(i % 9 != 0, i % 2000).alias("started"))
    return queues.stale_reset(rows, F.lit(1500))


CHECKS = "(SELECT user_id AS id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos, event_type NOT IN ('error', 'view') AS ok FROM events)"


def checks(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select(F.col("user_id").alias("id"), "event_id", F.row_number().over(w).cast("long").alias("at"), (~F.col("event_type").isin("error", "view")).alias("ok"))


@query(
    f"""SELECT event_id, CASE WHEN NOT ok THEN min(CASE WHEN NOT ok THEN pos END) OVER (PARTITION BY id, run) END AS since FROM (SELECT *, count(*) FILTER (WHERE ok) OVER (PARTITION BY id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM {CHECKS})"""
)
def st9_first_seen_latch(spark, d):
    return queues.bad_since(checks(spark, d)).select("event_id", "since")


MARKS = "m AS (SELECT user_id % 10 AS course_id, epoch(ts) - epoch(TIMESTAMP '2024-01-01') AS tm, event_type = 'purchase' AND event_id % 50 = 0 AS now FROM events)"


@query(
    f"""WITH RECURSIVE {MARKS}, o AS (SELECT *, row_number() OVER (PARTITION BY course_id ORDER BY tm, now) AS i FROM m),
  f AS (SELECT course_id, i, tm AS first, CASE WHEN now THEN tm ELSE tm + 20 END AS due, CAST(1 AS BIGINT) AS n, 1 AS run FROM o WHERE i = 1
    UNION ALL SELECT o.course_id, o.i, CASE WHEN o.tm >= f.due THEN o.tm ELSE f.first END, CASE WHEN o.now THEN CASE WHEN o.tm >= f.due THEN o.tm ELSE least(o.tm, f.first + 300) END WHEN o.tm >= f.due THEN o.tm + 20 ELSE least(o.tm + 20, f.first + 300) END, CASE WHEN o.tm >= f.due THEN 1 ELSE f.n + 1 END, CASE WHEN o.tm >= f.due THEN f.run + 1 ELSE f.run END
    FROM f JOIN o ON o.course_id = f.course_id AND o.i = f.i + 1)
  SELECT course_id, CAST(max(first) AS DOUBLE) AS first, CAST(arg_max(due, i) AS DOUBLE) AS due, max(n) AS marks FROM f GROUP BY course_id, run"""
)
def st1_debounce(spark, d):
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 - 1704067200
    m = table(spark, d, "events").select((F.col("user_id") % 10).alias("course_id"), at.alias("at"), ((F.col("event_type") == "purchase") & (F.col("event_id") % 50 == 0)).alias("immediate"))
    return queues.debounced(m)


@query(
    """WITH t AS (SELECT conv_id AS stream_id, turn AS pos, length(text) % 7 - 5.5 AS logprob, text LIKE '%.' OR turn % 3 = 2 AS ends FROM conversations), s AS (SELECT *, coalesce(count(*) FILTER (WHERE ends) OVER (PARTITION BY stream_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sentence FROM t)
  SELECT stream_id, sentence, coalesce(min(logprob) < -2, false) AS low FROM s GROUP BY ALL"""
)
def st10_low_confidence(spark, d):
    t = table(spark, d, "conversations").select(F.col("conv_id").alias("stream_id"), F.col("turn").alias("pos"), (F.length("text") % 7 - 5.5).alias("logprob"), "text")
    return queues.low_confidence(t, F.col("text").endswith(".") | (F.col("pos") % 3 == 2))


STEPS = "s AS (SELECT user_id AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, event_type <> 'view' AS found, CAST(floor(value * 100) AS BIGINT) AS bytes, event_id % 11 = 0 AS repeated, event_type <> 'signup' AS low FROM events)"


def steps(spark, d):
    c = checks(spark, d).select("event_id", F.col("at").alias("i"))
    e = F.col("event_type")
    return table(spark, d, "events").join(c, "event_id").select(F.col("user_id").alias("run_id"), "i", (e != "view").alias("found"), F.floor(F.col("value") * 100).cast("long").alias("bytes"), (F.col("event_id") % 11 == 0).alias("repeated"), (e != "signup").alias("low"), "event_id", e, F.get_json_object("props", "$.k").alias("k"))


@query(
    f"""WITH {STEPS}, r AS (SELECT *, count(*) FILTER (WHERE found) OVER w AS rs, sum(bytes) OVER w AS b FROM s WINDOW w AS (PARTITION BY run_id ORDER BY i ROWS UNBOUNDED PRECEDING)),
  y AS (SELECT run_id, i, CASE WHEN repeated THEN 'repeated' WHEN b > 20000 THEN 'bytes' WHEN NOT low THEN 'confident' WHEN rs >= 5 THEN 'restarts' WHEN i >= 8 THEN 'iterations' END AS reason FROM r)
  SELECT run_id, min(i) AS last, arg_min(reason, i) AS reason FROM y WHERE reason IS NOT NULL GROUP BY run_id"""
)
def st11_stop_reasons(spark, d):
    return queues.stop_reasons(steps(spark, d), most_bytes=20_000)


@query(
    f"""WITH {STEPS.replace("event_type <> 'signup' AS low", "event_type AS tool, CAST(json_extract_string(props, '$.k') AS BIGINT) % 4 AS args, event_id")}, c AS (SELECT *, (i + 1) // 2 AS turn FROM s), o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, tool, args ORDER BY turn, i) AS r FROM c WHERE turn <= 8) WHERE r = 1)
  SELECT run_id, event_id, n FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY turn, i) AS n FROM o) WHERE n <= 12"""
)
def st12_counted_calls(spark, d):
    c = steps(spark, d).select("run_id", F.expr("(i + 1) div 2").alias("turn"), F.col("i").alias("pos"), F.col("event_type").alias("tool"), (F.col("k").cast("long") % 4).alias("args"), "event_id")
    return queues.counted_calls(c).select("run_id", "event_id", "n")


@query("SELECT user_id, hash_key, min(event_id) AS event_id FROM (SELECT user_id, event_type || json_extract_string(props, '$.k') AS hash_key, event_id FROM events) GROUP BY ALL")
def st14_dedupe_within_stream(spark, d):
    rows = table(spark, d, "events").select("user_id", F.concat("event_type", F.get_json_object("props", "$.k")).alias("hash_key"), "event_id")
    return rows.groupBy("user_id", "hash_key").agg(F.min("event_id").alias("event_id"))


@query("SELECT page_id, CASE page_id % 5 WHEN 0 THEN CASE page_id % 3 WHEN 0 THEN 'tracked' WHEN 1 THEN 'awaiting_transcript' ELSE 'unsupported' END WHEN 1 THEN 'processing' WHEN 2 THEN 'unsupported' ELSE 'processing' END AS status FROM pages")
def st17_status_routing(spark, d):
    i = F.col("page_id")
    name = F.when(i % 5 == 0, "link.url").when(i % 5 == 1, "a.PDF").when(i % 5 == 2, "movie.mkv").otherwise("notes.md")
    url = F.when(i % 3 == 0, "https://files.example.org/o/r/main/a.pdf").when(i % 3 == 1, "https://play.example.org/watch?p=1").otherwise("https://example.org/")
    pdf = T.pdf_download(url, ("files.example.org",), ()).isNotNull()
    return table(spark, d, "pages").select("page_id", queues.routed_status(T.extension(name), pdf, url.contains("play.example.org"), ("pdf", "md", "txt", "html")).alias("status"))


def guard_turns(spark, d):
    e = checks(spark, d).select("event_id", F.col("at").alias("turn"))
    k = F.get_json_object("props", "$.k").cast("long")
    near = F.when(F.col("event_type") == "view", F.array(k % 6)).otherwise(F.array().cast("array<long>"))
    return table(spark, d, "events").join(e, "event_id").select(F.col("user_id").alias("conv_id"), "turn", (F.col("event_type") == "error").alias("intent"), near.alias("near"), (F.col("event_id") % 3 == 0).alias("engaged"))


def latch_sql(turn: str) -> str:
    """The guard folded over each user's events, the n-th of which is its n-th turn; `turn` is what a turn is called."""
    return f"""WITH RECURSIVE t AS (SELECT user_id AS conv_id, row_number() OVER w AS i, {turn} AS turn, event_type = 'error' AS intent, CASE WHEN event_type = 'view' THEN [CAST(json_extract_string(props, '$.k') AS BIGINT) % 6] ELSE [] END AS near, event_id % 3 = 0 AS engaged FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
  n AS (SELECT conv_id, i, unnest(near) AS doc FROM t), h AS (SELECT t.conv_id, t.i, doc FROM t JOIN n ON n.conv_id = t.conv_id AND n.i BETWEEN t.i - 4 AND t.i GROUP BY ALL HAVING count(*) >= 2), win AS (SELECT conv_id, i, list(doc ORDER BY doc) AS docs FROM h GROUP BY ALL),
  s AS (SELECT t.*, coalesce(win.docs, []) AS won, t.intent OR win.docs IS NOT NULL AS flagged FROM t LEFT JOIN win USING (conv_id, i)),
  f AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS turn, false AS active, false AS flagged, CAST([] AS BIGINT[]) AS docs, CAST(NULL AS BIGINT) AS lifted_at, '' AS events FROM (SELECT DISTINCT conv_id FROM t)
    UNION ALL SELECT s.conv_id, s.i, s.turn, s.flagged OR (f.active AND NOT s.engaged), s.flagged, CASE WHEN s.flagged AND NOT f.active THEN CASE WHEN len(s.won) > 0 THEN s.won ELSE s.near END ELSE f.docs END, CASE WHEN s.flagged AND NOT f.active THEN NULL WHEN f.active AND s.engaged THEN s.turn ELSE f.lifted_at END,
      array_to_string(list_filter([CASE WHEN s.intent THEN 'intent_detected' END, CASE WHEN f.active THEN CASE WHEN s.engaged THEN 'constraint_lifted' ELSE 'engagement_refused' END END,
        CASE WHEN s.flagged AND NOT (f.active AND NOT s.engaged) THEN 'constraint_activated:' || CASE WHEN s.intent AND len(s.won) > 0 THEN 'intent_and_proximity' WHEN s.intent THEN 'intent' ELSE 'proximity' END END], lambda x: x IS NOT NULL), ',')
    FROM f JOIN s ON s.conv_id = f.conv_id AND s.i = f.i + 1)
  SELECT conv_id, turn, active, flagged, array_to_string(docs, ',') AS docs, lifted_at, events FROM f WHERE i > 0"""


def latch_rows(states):
    return states.withColumns({"docs": F.array_join(F.transform("docs", lambda x: x.cast("string")), ","), "events": F.array_join("events", ",")})


@query(latch_sql("row_number() OVER w"))
def w5_guard_latch(spark, d):
    return latch_rows(guard.latch_by_conversation(guard_turns(spark, d)))


# Metrics --------------------------------------------------------------------------------

#: A counter per user and type that restarts at each 40th of its samples.
SERIES = """s AS (SELECT user_id, event_type, ts, CAST(n % 40 AS DOUBLE) * 2 AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events))"""
INC = f"{SERIES}, i AS (SELECT *, CASE WHEN b IS NULL THEN 0 WHEN value < b THEN value ELSE value - b END AS inc FROM (SELECT *, lag(value) OVER (PARTITION BY user_id, event_type ORDER BY ts) AS b FROM s))"


def counters(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return table(spark, d, "events").select("user_id", "event_type", "ts", ((F.row_number().over(w) % 40).cast("double") * 2).alias("value"))


@query(f"WITH {INC} SELECT event_type, strftime(time_bucket(INTERVAL 5 MINUTE, ts), '%Y-%m-%d %H:%M:%S') AS bucket, round(sum(inc) / 300, 6) AS rate FROM i GROUP BY ALL")
def m1_rate(spark, d):
    r = metrics.rate_by(counters(spark, d), ["user_id", "event_type"], ["event_type"], 5)
    return r.select("event_type", F.date_format("bucket", "yyyy-MM-dd HH:mm:ss").alias("bucket"), F.round("rate", 6).alias("rate"))


@query("SELECT user_id, round(CAST(count(*) FILTER (WHERE event_type = 'error') AS DOUBLE) / greatest(count(*) FILTER (WHERE event_type = 'signup'), 1), 6) AS ratio FROM events GROUP BY user_id")
def m2_clamped_ratio(spark, d):
    g = table(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("a"), F.count_if(F.col("event_type") == "signup").alias("b"))
    return g.select("user_id", F.round(metrics.ratio(F.col("a"), F.col("b")), 6).alias("ratio"))


BOUNDS = (1, 5, 10, 25, 50, 100)


@query(
    f"""WITH b AS (SELECT event_type, CAST(le AS DOUBLE) AS le, count(*) FILTER (WHERE value <= le) AS n FROM events, (VALUES {', '.join(f'({x}.0)' for x in BOUNDS)}, ('inf'::DOUBLE)) t(le) GROUP BY ALL),
  o AS (SELECT *, coalesce(lag(le) OVER w, 0) AS low, coalesce(lag(n) OVER w, 0) AS before, 0.9 * max(n) OVER (PARTITION BY event_type) AS rank FROM b WINDOW w AS (PARTITION BY event_type ORDER BY le)),
  f AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY le) AS r FROM o WHERE n >= rank AND rank > 0)
  SELECT event_type, round(CASE WHEN isinf(le) THEN low ELSE low + (le - low) * (rank - before) / (n - before) END, 6) AS p90 FROM f WHERE r = 1"""
)
def m3_histogram_quantile(spark, d):
    e = table(spark, d, "events")
    per = e.groupBy("event_type").agg(*[F.count_if(F.col("value") <= x).alias(f"b{i}") for i, x in enumerate(BOUNDS)], F.count("value").alias("all"))
    each = F.array(*[F.struct(F.lit(float(x)).alias("le"), F.col(f"b{i}").alias("n")) for i, x in enumerate(BOUNDS)], F.struct(F.lit(float("inf")).alias("le"), F.col("all").alias("n")))
    b = per.select("event_type", F.explode(each).alias("x")).select("event_type", "x.*")
    return metrics.histogram_quantile(b, 0.9, ["event_type"]).select("event_type", F.round("quantile", 6).alias("p90"))


@query("SELECT event_type, user_id % 7 AS node, round(max(value), 6) AS top FROM events GROUP BY ALL HAVING max(value) > 50")
def m4_gauge_max(spark, d):
    return table(spark, d, "events").groupBy("event_type", (F.col("user_id") % 7).alias("node")).agg(F.round(F.max("value"), 6).alias("top"), F.max("value").alias("m")).where("m > 50").drop("m")


@query(f"WITH {INC} SELECT event_type, strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, sum(inc) AS increase FROM i GROUP BY ALL")
def m5_increase(spark, d):
    r = metrics.rate_by(counters(spark, d), ["user_id", "event_type"], ["event_type"], 60)
    return r.select("event_type", F.date_format("bucket", "yyyy-MM-dd HH").alias("hour"), "increase")


@query(
    f"""WITH {INC}, r AS (SELECT event_type, time_bucket(INTERVAL 60 MINUTE, ts) AS h, sum(inc) / 3600 AS rate FROM i GROUP BY ALL), a AS (SELECT h, rate FROM r WHERE event_type = 'view'), b AS (SELECT h, rate FROM r WHERE event_type = 'click')
  SELECT strftime(h, '%Y-%m-%d %H') AS hour, round(100 - a.rate / (a.rate + b.rate) * 100, 6) AS busy FROM a JOIN b USING (h) WHERE a.rate + b.rate > 0"""
)
def m6_across_series(spark, d):
    r = metrics.rate_by(counters(spark, d), ["user_id", "event_type"], ["event_type"], 60)
    a, b = r.where("event_type = 'view'").select("bucket", F.col("rate").alias("a")), r.where("event_type = 'click'").select("bucket", F.col("rate").alias("b"))
    j = a.join(b, "bucket").where("a + b > 0")
    return j.select(F.date_format("bucket", "yyyy-MM-dd HH").alias("hour"), F.round(100 - F.col("a") / (F.col("a") + F.col("b")) * 100, 6).alias("busy"))


@query("SELECT event_id, regexp_full_match(event_type, 'view|c.*') AS hit, NOT regexp_full_match(event_type, 'err.*') AS no FROM events")
def m7_label_match(spark, d):
    return table(spark, d, "events").select("event_id", metrics.matches(F.col("event_type"), "view|c.*").alias("hit"), (~metrics.matches(F.col("event_type"), "err.*")).alias("no"))


@query("SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)(license|secret|warranty)')")
def m8_line_filter(spark, d):
    return table(spark, d, "documents").where(metrics.line_matches(F.col("text"), ("license", "secret", "warranty"))).select("doc_id")


@query(f"WITH {INC} SELECT event_type, round(sum(inc) / 3600 / 24 / 30 * 3600 / 1e6, 12) AS usd_per_hour FROM i GROUP BY event_type")
def m9_unit_conversion(spark, d):
    g = metrics.increases(counters(spark, d), ["user_id", "event_type"]).groupBy("event_type").agg(F.sum("inc").alias("v"))
    return g.select("event_type", F.round(F.col("v") / 3600 / 24 / 30 * 3600 / 1e6, 12).alias("usd_per_hour"))


def range_sql(seconds: int, step: int, node: int) -> str:
    """The growth of each series (event_type, node) in each window, by a join of windows and samples."""
    return f"""t AS (SELECT event_type, user_id % {node} AS node, epoch_us(ts) AS tm, CAST(n % 40 AS DOUBLE) * 2 AS v FROM (SELECT *, row_number() OVER (PARTITION BY event_type, user_id % {node} ORDER BY ts, event_id) AS n FROM events)),
  e AS (SELECT unnest(range((SELECT min(tm) FROM t) // {step * 10**6} * {step * 10**6}, (SELECT max(tm) FROM t) + {(seconds + step) * 10**6}, {step * 10**6})) AS e),
  j AS (SELECT event_type, node, e, tm, v, lag(v) OVER (PARTITION BY event_type, node, e ORDER BY tm) AS b FROM e JOIN t ON tm > e - {seconds * 10**6} AND tm <= e),
  g AS (SELECT event_type, node, e, count(*) AS n, min(tm) AS a, max(tm) AS z, arg_min(v, tm) AS va, arg_max(v, tm) - arg_min(v, tm) + sum(CASE WHEN b > v THEN b ELSE 0 END) AS inc FROM j GROUP BY ALL HAVING count(*) > 1),
  q AS (SELECT *, CAST(z - a AS DOUBLE) AS span, CAST(z - a AS DOUBLE) / (n - 1) AS gap, CAST(a - (e - {seconds * 10**6}) AS DOUBLE) AS l, CAST(e - z AS DOUBLE) AS r FROM g),
  x AS (SELECT event_type, node, make_timestamp(e) AS at_time, inc * ((span + CASE WHEN inc > 0 THEN least(CASE WHEN l >= gap * 1.1 THEN gap / 2 ELSE l END, span * (va / inc)) WHEN l >= gap * 1.1 THEN gap / 2 ELSE l END + CASE WHEN r >= gap * 1.1 THEN gap / 2 ELSE r END) / span) AS increase FROM q)"""


def range_counters(spark, d, node: int):
    """A counter per type and node that restarts at each 40th of its samples."""
    from pyspark.sql import Window

    k = F.col("user_id") % node
    w = Window.partitionBy("event_type", k).orderBy("ts", "event_id")
    return table(spark, d, "events").select("event_type", k.alias("node"), F.col("ts").cast("timestamp").alias("ts"), ((F.row_number().over(w) % 40).cast("double") * 2).alias("value"))


@query(f"WITH {range_sql(7200, 1800, 2)} SELECT event_type, strftime(at_time, '%Y-%m-%d %H:%M') AS time, round(sum(increase / 7200.0), 6) AS rate FROM x GROUP BY ALL")
def m1_rate_of_ranges(spark, d):
    """sum by (event_type)(rate(c[2h])) at every half hour."""
    r = metrics.range_increase(range_counters(spark, d, 2), ["event_type", "node"], 7200, 1800)
    return r.groupBy("event_type", "time").agg(F.round(F.sum("rate"), 6).alias("rate")).withColumn("time", F.date_format("time", "yyyy-MM-dd HH:mm"))


@query(f"WITH {range_sql(10800, 3600, 3)} SELECT event_type, node, strftime(at_time, '%Y-%m-%d %H:%M') AS time, round(increase, 6) AS increase FROM x")
def m5_increase_of_ranges(spark, d):
    """increase(c[3h]) at every hour."""
    r = metrics.range_increase(range_counters(spark, d, 3), ["event_type", "node"], 10800, 3600)
    return r.select("event_type", "node", F.date_format("time", "yyyy-MM-dd HH:mm").alias("time"), F.round("increase", 6).alias("increase"))


#: Failures, successes, and statuses that are neither.
STATES = "(SELECT user_id AS id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos, CASE WHEN event_type IN ('error', 'view') THEN false WHEN event_type <> 'click' THEN true END AS ok FROM events)"


@query(
    f"""WITH RECURSIVE s AS {STATES}, f AS (SELECT id, event_id, pos, CASE WHEN NOT ok THEN pos END AS since FROM s WHERE pos = 1
    UNION ALL SELECT s.id, s.event_id, s.pos, CASE WHEN s.ok IS NULL THEN f.since WHEN NOT s.ok THEN coalesce(f.since, s.pos) END FROM f JOIN s ON s.id = f.id AND s.pos = f.pos + 1)
  SELECT event_id, since FROM f"""
)
def st9_latch_of_three_states(spark, d):
    """Of clicks the latch learns nothing."""
    e = table(spark, d, "events").select("event_id", "event_type")
    c = checks(spark, d).join(e, "event_id").withColumn("ok", F.when(F.col("event_type") != "click", F.col("ok")))
    return queues.bad_since(c).select("event_id", "since")


LOOPS = """(SELECT user_id * 1000 + (i - 1) // 10 AS run_id, (i - 1) % 10 + 1 AS i, CASE WHEN event_id % 41 = 0 THEN 'error' WHEN event_id % 43 = 0 THEN 'completed' WHEN event_id % 47 = 0 THEN 'repeat' ELSE 'limit' END AS outcome,
  event_type <> 'signup' AS low, event_id % 7 <> 0 AS added, CAST(floor(value * 10) AS BIGINT) AS tokens, CAST(floor(value * 100) AS BIGINT) AS bytes, event_id % 31 = 0 AS heading
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events))"""


@query(
    f"""WITH RECURSIVE s AS MATERIALIZED {LOOPS},
  f AS (SELECT run_id, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS restarts, CAST(0 AS BIGINT) AS tokens, CAST(0 AS BIGINT) AS bytes, CAST(NULL AS VARCHAR) AS reason FROM (SELECT DISTINCT run_id FROM s)
    UNION ALL SELECT s.run_id, s.i, f.restarts + CASE WHEN s.outcome = 'limit' AND s.low AND s.added THEN 1 ELSE 0 END, f.tokens + s.tokens, f.bytes + s.bytes,
      CASE WHEN s.outcome = 'error' THEN 'error' WHEN s.heading AND f.bytes > 0 AND s.bytes > 0 THEN 'heading' WHEN s.outcome <> 'limit' THEN s.outcome WHEN s.low AND f.restarts >= 5 THEN 'restarts'
        WHEN f.tokens + s.tokens >= 3000 THEN 'tokens' WHEN s.i >= 8 THEN 'iterations' WHEN f.bytes + s.bytes > 30000 THEN 'bytes' END
    FROM f JOIN s ON s.run_id = f.run_id AND s.i = f.i + 1 WHERE f.reason IS NULL)
  SELECT run_id, i AS iterations, reason FROM f WHERE reason IS NOT NULL"""
)
def st11_loop_ends(spark, d):
    """Runs of ten events of a user each."""
    c = checks(spark, d).select("event_id", (F.col("at") - 1).alias("at"))
    e, i = F.col("event_type"), F.col("event_id")
    outcome = F.when(i % 41 == 0, "error").when(i % 43 == 0, "completed").when(i % 47 == 0, "repeat").otherwise("limit")
    s = table(spark, d, "events").join(c, "event_id").select(
        (F.col("user_id") * 1000 + F.expr("at div 10")).alias("run_id"), (F.col("at") % 10 + 1).alias("i"), outcome.alias("outcome"), (e != "signup").alias("low"), (i % 7 != 0).alias("added"),
        F.floor(F.col("value") * 10).cast("long").alias("tokens"), F.floor(F.col("value") * 100).cast("long").alias("bytes"), (i % 31 == 0).alias("heading"),
    )
    return queues.loop_ends(s, token_cap=3000, most_bytes=30_000)
