"""Streams over the events table, run to the end of what is there."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.durable import checkpoint_dir, shared_path
from ..streaming import flows
from .queues import latch_rows, latch_sql
from .registry import query


def events(spark, d):
    return flows.file_stream(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query(
    """WITH w AS (SELECT time_bucket(INTERVAL 60 MINUTE, ts) AS b, event_type AS model, count(*) AS calls, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS tokens FROM events GROUP BY ALL)
  SELECT strftime(b, '%Y-%m-%d %H:%M') AS bucket, model, calls, tokens FROM w WHERE b + INTERVAL 60 MINUTE <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)"""
)
def st_usage_windows(spark, d):
    """Windows that the watermark has closed."""
    e = events(spark, d).select("ts", F.col("event_type").alias("model"), F.get_json_object("props", "$.k").cast("long").alias("tokens"))
    out = flows.run_to_end(flows.usage_windows(e), checkpoint_dir(spark))
    return out.select(F.date_format("bucket", "yyyy-MM-dd HH:mm").alias("bucket"), "model", "calls", "tokens")


@query("SELECT DISTINCT user_id, event_type FROM events")
def st_first_of_each(spark, d):
    e = events(spark, d).select("ts", "user_id", "event_type")
    return flows.run_to_end(flows.first_of_each(e, ["user_id", "event_type"], "40 days"), checkpoint_dir(spark)).select("user_id", "event_type")


@query(
    """WITH RECURSIVE m AS (SELECT user_id % 10 AS course_id, epoch_us(ts) / 1e6 AS tm, event_type = 'purchase' AND event_id % 50 = 0 AS now FROM events), o AS (SELECT *, row_number() OVER (PARTITION BY course_id ORDER BY tm, now) AS i FROM m),
  f AS (SELECT course_id, i, tm AS first, CASE WHEN now THEN tm ELSE tm + 20 END AS due, CAST(1 AS BIGINT) AS n, 1 AS run FROM o WHERE i = 1
    UNION ALL SELECT o.course_id, o.i, CASE WHEN o.tm >= f.due THEN o.tm ELSE f.first END, CASE WHEN o.now THEN CASE WHEN o.tm >= f.due THEN o.tm ELSE least(o.tm, f.first + 300) END WHEN o.tm >= f.due THEN o.tm + 20 ELSE least(o.tm + 20, f.first + 300) END, CASE WHEN o.tm >= f.due THEN 1 ELSE f.n + 1 END, CASE WHEN o.tm >= f.due THEN f.run + 1 ELSE f.run END
    FROM f JOIN o ON o.course_id = f.course_id AND o.i = f.i + 1),
  r AS (SELECT course_id, run, max(first) AS first, arg_max(due, i) AS due, max(n) AS marks FROM f GROUP BY course_id, run)
  SELECT course_id, CAST(first AS DOUBLE) AS first, CAST(due AS DOUBLE) AS due, marks FROM r WHERE due < (SELECT max(tm) - 60 FROM m) OR run < (SELECT max(run) FROM r x WHERE x.course_id = r.course_id)"""
)
def st_debounce(spark, d):
    """Like st1_debounce; courses whose timer the watermark hasn't reached are not there yet."""
    m = events(spark, d).select((F.col("user_id") % 10).alias("course_id"), "ts", ((F.col("event_type") == "purchase") & (F.col("event_id") % 50 == 0)).alias("immediate"))
    return flows.run_to_end(flows.debounced_stream(m), checkpoint_dir(spark))


@query(latch_sql("epoch_us(ts)"))
def st13_guard_stream(spark, d):
    """The guard over a stream of turns, here of one event each, numbered by their time."""
    e = events(spark, d)
    k = F.get_json_object("props", "$.k").cast("long")
    near = F.when(F.col("event_type") == "view", F.array(k % 6)).otherwise(F.array().cast("array<long>"))
    turns = e.select(F.col("user_id").alias("conv_id"), F.unix_micros("ts").alias("turn"), (F.col("event_type") == "error").alias("intent"), near.alias("near"), (F.col("event_id") % 3 == 0).alias("engaged"))
    return latch_rows(flows.run_to_end(flows.latched_stream(turns), checkpoint_dir(spark)))


@query("SELECT status, CAST(coalesce(n, 0) AS BIGINT) AS n FROM (SELECT unnest(['click', 'error', 'purchase', 'signup', 'view', 'never']) AS status) LEFT JOIN (SELECT event_type AS status, count(*) AS n FROM events GROUP BY 1) USING (status)")
def st15_gauges(spark, d):
    """Counts of each known status, zeros too, that micro-batches hand on; here added up."""
    path = shared_path(spark, "gauges")
    sink = flows.gauges(events(spark, d).select(F.col("event_type").alias("status")), ["click", "error", "purchase", "signup", "view", "never"], lambda df: df.write.mode("append").parquet(path))
    sink.option("checkpointLocation", shared_path(spark, "gauges-state")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("status string, n long").parquet(path).groupBy("status").agg(F.sum("n").alias("n"))
