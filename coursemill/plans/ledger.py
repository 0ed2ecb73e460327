"""Usage, cost and count queries over the events ledger."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ledger
from .bindings import AS_OF, PRICE, USAGE, prices, table, usage
from .registry import query

COST = "CAST(CAST(coalesce(sum(prompt * coalesce(rate_in, 0) + completion * coalesce(rate_out, 0)), 0) AS DECIMAL(26,6)) * CAST(0.000001 AS DECIMAL(7,6)) AS DOUBLE)"


@query(f"WITH {USAGE} SELECT user_id, course_id, day, model, CAST(sum(prompt) AS BIGINT) AS prompt, CAST(sum(completion) AS BIGINT) AS completion, count(*) AS requests FROM usage GROUP BY ALL")
def a1_usage_daily(spark, d):
    rows = usage(spark, d).withColumn("requests", F.lit(1).cast("long")).select("user_id", "course_id", "day", "model", "prompt", "completion", "requests")
    old, new = rows.where(F.col("day") < AS_OF), rows.where(F.col("day") >= AS_OF)
    return ledger.add_usage(ledger.add_usage(old), new)


@query(f"WITH {USAGE} SELECT u.user_id, CAST(coalesce(sum(prompt + completion), 0) AS BIGINT) AS tokens FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN usage ON usage.user_id = u.user_id AND day = DATE '{AS_OF}' GROUP BY u.user_id")
def a2_user_tokens_of_day(spark, d):
    u = usage(spark, d)
    used = u.where(F.col("day") == F.lit(AS_OF).cast("date")).groupBy("user_id").agg(F.sum(F.col("prompt") + F.col("completion")).alias("tokens"))
    return ledger.with_zero(u.select("user_id").distinct(), used, "user_id", "tokens")


@query(f"WITH {USAGE} SELECT course_id % 3 AS owner_id, CAST(sum(prompt + completion) AS BIGINT) AS tokens FROM usage WHERE day = DATE '{AS_OF}' GROUP BY 1")
def a3_owner_tokens_of_day(spark, d):
    courses = spark.range(10).select(F.col("id").alias("course_id"), (F.col("id") % 3).alias("owner_id"))
    per_course = usage(spark, d).where(F.col("day") == F.lit(AS_OF).cast("date")).groupBy("course_id").agg(F.sum(F.col("prompt") + F.col("completion")).alias("t"))
    return per_course.join(courses, "course_id").groupBy("owner_id").agg(F.sum("t").alias("tokens"))


@query(f"WITH {USAGE}, {PRICE} SELECT user_id, day, {COST} AS cost FROM usage LEFT JOIN price USING (model) GROUP BY user_id, day")
def a4_user_daily_cost(spark, d):
    return ledger.cost_by(usage(spark, d), prices(spark), "user_id", "day")


@query(
    f"""WITH {USAGE}, {PRICE}, chat AS (SELECT {COST} AS cost FROM usage LEFT JOIN price USING (model) WHERE day = DATE '{AS_OF}' AND course_id % 3 = 1),
  pipe AS (SELECT {COST} AS cost FROM usage LEFT JOIN price USING (model) WHERE day = DATE '{AS_OF}' AND course_id % 3 = 1 AND model IN ('error', 'view'))
  SELECT chat.cost AS chat_cost, pipe.cost AS pipeline_cost, round(chat.cost + pipe.cost, 9) AS total FROM chat, pipe"""
)
def a5_owner_daily_cost(spark, d):
    mine = usage(spark, d).where((F.col("day") == F.lit(AS_OF).cast("date")) & (F.col("course_id") % 3 == 1)).withColumn("owner", F.lit(1))
    tokens = mine.groupBy("model").agg(F.sum("prompt").alias("p"), F.sum("completion").alias("c")).join(prices(spark), "model", "left")
    pipeline = F.col("model").isin("error", "view")
    # Both ledgers in one pass instead of a join of two single rows.
    both = tokens.agg(ledger.usd(ledger.cost(F.col("p"), F.col("c"))).alias("chat_cost"), ledger.usd(ledger.cost(F.when(pipeline, F.col("p")).otherwise(0), F.when(pipeline, F.col("c")).otherwise(0))).alias("pipeline_cost"))
    return both.withColumn("total", F.round(F.col("chat_cost") + F.col("pipeline_cost"), 9))


@query(
    f"""WITH {USAGE} SELECT c.course_id, CAST(coalesce(sum(prompt), 0) AS BIGINT) AS prompt, CAST(coalesce(sum(completion), 0) AS BIGINT) AS completion, count(usage.event_id) AS requests, count(DISTINCT usage.user_id) AS users
  FROM (SELECT CAST(range AS BIGINT) AS course_id FROM range(12)) c LEFT JOIN usage ON usage.course_id = c.course_id GROUP BY c.course_id"""
)
def a6_course_summary(spark, d):
    facts = usage(spark, d).groupBy("course_id").agg(F.sum("prompt").alias("prompt"), F.sum("completion").alias("completion"), F.count("*").alias("requests"), F.countDistinct("user_id").alias("users"))
    return ledger.with_zero(spark.range(12).select(F.col("id").alias("course_id")), facts, "course_id", "prompt", "completion", "requests", "users")


@query(f"WITH {USAGE} SELECT course_id AS category, model, count(*) AS calls, CAST(sum(prompt) AS BIGINT) AS prompt, CAST(sum(completion) AS BIGINT) AS completion FROM usage WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 10 DAY AND ts < TIMESTAMP '{AS_OF}' GROUP BY ALL ORDER BY category, model")
def a7_category_rollup(spark, d):
    since = F.col("ts") >= F.expr(f"timestamp_ntz '{AS_OF}' - interval 10 days")
    rows = usage(spark, d).where(since & (F.col("ts") < F.expr(f"timestamp_ntz '{AS_OF}'")))
    out = rows.groupBy(F.col("course_id").alias("category"), "model").agg(F.count("*").alias("calls"), F.sum("prompt").alias("prompt"), F.sum("completion").alias("completion"))
    return out.orderBy("category", "model")


@query("SELECT user_id, count(*) AS total, count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) FILTER (WHERE event_type = 'purchase' AND value > 10) AS large, count(*) FILTER (WHERE value IS NULL) AS unknown FROM events GROUP BY user_id")
def a8_conditional_counts(spark, d):
    e = F.col("event_type")
    return table(spark, d, "events").groupBy("user_id").agg(
        F.count("*").alias("total"), F.count_if(e == "error").alias("errors"), F.count_if((e == "purchase") & (F.col("value") > 10)).alias("large"), F.count_if(F.col("value").isNull()).alias("unknown")
    )


@query(f"WITH {USAGE} SELECT user_id % 4 AS grp, count(*) AS n FROM usage GROUP BY 1")
def a15_count_per_group(spark, d):
    return usage(spark, d).groupBy((F.col("user_id") % 4).alias("grp")).agg(F.count("*").alias("n"))


@query(
    f"""WITH {USAGE}, t AS (SELECT course_id, user_id, sum(prompt + completion) AS total, sum(CASE WHEN model = 'view' THEN prompt + completion ELSE 0 END) AS research FROM usage GROUP BY GROUPING SETS ((course_id), (user_id), ()))
  SELECT course_id, user_id, CAST(total AS BIGINT) AS total, CAST(research AS BIGINT) AS research, CAST(total - research AS BIGINT) AS writeup FROM t ORDER BY total DESC, course_id, user_id"""
)
def a17_client_rollups(spark, d):
    u = usage(spark, d).withColumn("t", F.col("prompt") + F.col("completion"))
    out = u.groupingSets([["course_id"], ["user_id"], []], "course_id", "user_id").agg(F.sum("t").alias("total"), F.sum(F.when(F.col("model") == "view", F.col("t")).otherwise(0)).alias("research"))
    return out.withColumn("writeup", F.col("total") - F.col("research")).orderBy(F.desc("total"), "course_id", "user_id")


@query(
    f"""WITH {USAGE}, used AS (SELECT user_id, sum(prompt + completion) AS used FROM usage WHERE day = DATE '{AS_OF}' GROUP BY user_id), lim AS (SELECT DISTINCT user_id, (user_id % 3) * 20000 AS "limit" FROM events)
  SELECT lim.user_id, "limit", CAST(coalesce(used, 0) AS BIGINT) AS used, "limit" > 0 AND coalesce(used, 0) >= "limit" AS refused FROM lim LEFT JOIN used USING (user_id)"""
)
def c13_quota_gate(spark, d):
    u = usage(spark, d)
    used = u.where(F.col("day") == F.lit(AS_OF).cast("date")).groupBy("user_id").agg(F.sum(F.col("prompt") + F.col("completion")).alias("used"))
    limits = u.select("user_id", ((F.col("user_id") % 3) * 20000).alias("limit")).distinct()
    return ledger.over_limit(used, limits, "user_id")


@query("SELECT user_id, CASE WHEN budget > 0 THEN CAST(least(CAST(budget AS HUGEINT) * 2, 9223372036854775807) AS BIGINT) ELSE 200000 END AS cap FROM (SELECT user_id, CASE WHEN user_id % 5 = 0 THEN 9000000000000000000 ELSE (user_id % 4) * 1000 END AS budget FROM (SELECT DISTINCT user_id FROM events))")
def t31_token_cap(spark, d):
    u = table(spark, d, "events").select("user_id").distinct()
    budget = F.when(F.col("user_id") % 5 == 0, F.lit(9000000000000000000)).otherwise((F.col("user_id") % 4) * 1000)
    doubled = F.when(budget > 4611686018427387903, F.lit(9223372036854775807)).otherwise(F.expr("try_multiply(budget, 2)"))
    return u.withColumn("budget", budget).select("user_id", F.when(F.col("budget") > 0, doubled).otherwise(200000).cast("long").alias("cap"))


@query(
    f"""WITH {USAGE}, {PRICE} SELECT model, day, {COST} AS cost, round(CAST(sum(prompt) AS DOUBLE) / greatest(sum(completion), 1), 6) AS prompt_per_completion FROM usage LEFT JOIN price USING (model)
  WHERE rate_in IS NOT NULL GROUP BY model, day"""
)
def j2_priced_usage(spark, d):
    known = prices(spark).where("rate_in is not null")
    u = usage(spark, d).groupBy("model", "day").agg(F.sum("prompt").alias("p"), F.sum("completion").alias("c")).join(known, "model")
    ratio = F.round(F.sum("p").cast("double") / F.greatest(F.sum("c"), F.lit(1)), 6)
    return u.groupBy("model", "day").agg(ledger.usd(ledger.cost(F.col("p"), F.col("c"))).alias("cost"), ratio.alias("prompt_per_completion"))


@query(f"WITH {USAGE}, {PRICE} SELECT event_id, CAST(CAST(prompt * coalesce(rate_in, 0) + completion * coalesce(rate_out, 0) AS DECIMAL(26,6)) * CAST(0.000001 AS DECIMAL(7,6)) AS DOUBLE) AS cost FROM usage LEFT JOIN price USING (model)")
def t30_cost(spark, d):
    u = usage(spark, d).join(prices(spark), "model", "left")
    return u.select("event_id", ledger.usd(ledger.micro_usd(F.col("prompt"), F.col("completion"))).alias("cost"))


@query("SELECT (SELECT count(*) FROM events WHERE event_type = 'error') AS errors, (SELECT count(*) FROM conversations WHERE role = 'user') AS questions, (SELECT count(*) FROM events WHERE event_type = 'error') + (SELECT count(*) FROM conversations WHERE role = 'user') AS total")
def j8_two_totals(spark, d):
    """Totals of two tables side by side: united single rows, so nothing is cross-joined."""
    one = table(spark, d, "events").agg(F.count_if(F.col("event_type") == "error").alias("errors")).withColumn("questions", F.lit(0))
    two = table(spark, d, "conversations").agg(F.count_if(F.col("role") == "user").alias("questions")).withColumn("errors", F.lit(0))
    both = one.unionByName(two).agg(F.sum("errors").alias("errors"), F.sum("questions").alias("questions"))
    return both.withColumn("total", F.col("errors") + F.col("questions"))


@query(
    f"""SELECT user_id, count(*) FILTER (WHERE CAST(ts AS DATE) = DATE '{AS_OF}') AS of_day, count(*) FILTER (WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY AND ts < TIMESTAMP '{AS_OF}') AS of_week, strftime(least(max(ts), TIMESTAMP '{AS_OF}' + INTERVAL 10 DAY), '%Y-%m-%d %H') AS until FROM events GROUP BY user_id"""
)
def t32_intervals(spark, d):
    """Dates and intervals from a day that is an argument, never from the clock."""
    day = F.expr(f"timestamp_ntz '{AS_OF}'")
    week = (F.col("ts") >= day - F.expr("interval 7 days")) & (F.col("ts") < day)
    g = table(spark, d, "events").groupBy("user_id").agg(F.count_if(F.to_date("ts") == F.to_date(F.lit(AS_OF))).alias("of_day"), F.count_if(week).alias("of_week"), F.max("ts").alias("ts"))
    return g.select("user_id", "of_day", "of_week", F.date_format(F.least("ts", day + F.expr("interval 10 days")), "yyyy-MM-dd HH").alias("until"))
