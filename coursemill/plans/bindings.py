"""The application's tables, derived from the driver's: as DataFrames, and as SQL for the twins.

Formulas are fixed, so that both engines see the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2024-01-15"
RATE = "decimal(12,6)"
#: (model, USD per million prompt tokens, per million completion tokens); null: unknown, 0: free.
PRICES = [("click", "0.150000", "0.600000"), ("error", None, None), ("purchase", "2.500000", "10.000000"), ("signup", "0.000000", "0.000000"), ("view", "0.050000", "0.080000")]
#: Kinds of a chunk by its number, the last is what a null is shown as; and statuses of a document.
KINDS = ("lecture", "reading", "tutorial_exercise", "assignment_brief", "sample_solution", "lab_brief", "exam", "syllabus", "transcript", "unknown")
STATUSES = ("awaiting_transcript", "failed", "pending", "processing", "ready", "unsupported", "awaiting_video_index")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Usage ledger ---------------------------------------------------------------------------

USAGE = """usage AS (SELECT event_id, ts, CAST(ts AS DATE) AS day, user_id, user_id % 10 AS course_id, event_type AS model,
  CAST(floor(value * 100) AS BIGINT) AS prompt, CAST(json_extract_string(props, '$.k') AS BIGINT) AS completion FROM events)"""
PRICE = "price(model, rate_in, rate_out) AS (VALUES " + ", ".join(f"('{m}', CAST({a or 'NULL'} AS DECIMAL(12,6)), CAST({b or 'NULL'} AS DECIMAL(12,6)))" for m, a, b in PRICES) + ")"


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id", "ts", F.to_date("ts").alias("day"), "user_id", (F.col("user_id") % 10).alias("course_id"), F.col("event_type").alias("model"),
        F.floor(F.col("value") * 100).cast("long").alias("prompt"), F.get_json_object("props", "$.k").cast("long").alias("completion"),
    )


def prices(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(PRICES, "model string, a string, b string")
    return rows.select("model", F.col("a").cast(RATE).alias("rate_in"), F.col("b").cast(RATE).alias("rate_out"))


# Conversations --------------------------------------------------------------------------

MESSAGES = """messages AS (SELECT conv_id, turn, conv_id * 1000 + turn AS message_id, role, text, conv_id % 25 AS user_id, conv_id % 5 AS course_id FROM conversations)"""
FEEDBACK = """feedback AS (SELECT message_id, conv_id, turn, CASE WHEN (conv_id + turn) % 3 = 0 THEN 'up' ELSE 'down' END AS rating,
  CASE (conv_id + turn) % 5 WHEN 0 THEN NULL WHEN 2 THEN 'unclear' WHEN 3 THEN 'off_topic' ELSE 'wrong' END AS category, conv_id % 6 = 0 AS acknowledged
  FROM messages WHERE role = 'assistant' AND (conv_id * 7 + turn) % 4 <> 0)"""
NOTES = """notes AS (SELECT conv_id * 10 AS note_id, conv_id, CASE WHEN conv_id % 2 = 0 THEN conv_id * 1000 + 1 END AS message_id, conv_id % 7 AS author_id, conv_id % 4 AS created FROM (SELECT DISTINCT conv_id FROM conversations) WHERE conv_id % 4 <> 2)"""
REVIEWS = """reviews AS (SELECT conv_id, conv_id % 5 AS reviewed FROM (SELECT DISTINCT conv_id FROM conversations) WHERE conv_id % 3 = 0)"""
FLAGS = """flags AS (SELECT conv_id, turns.n AS turn, CASE WHEN turns.n % 2 = 1 THEN 'extraction_attempt' ELSE 'constraint_lifted' END AS flag, conv_id % 9 = 0 AS acknowledged
  FROM (SELECT conv_id, count(*) FILTER (WHERE role = 'user') AS users FROM conversations GROUP BY conv_id), (SELECT unnest([1, 2, 3]) AS n) AS turns WHERE turns.n <= users AND (conv_id + turns.n) % 4 = 0)"""


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", (F.col("conv_id") * 1000 + F.col("turn")).alias("message_id"), "role", "text", (F.col("conv_id") % 25).alias("user_id"), (F.col("conv_id") % 5).alias("course_id")
    )


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = messages(spark, sf_dir).where((F.col("role") == "assistant") & ((F.col("conv_id") * 7 + F.col("turn")) % 4 != 0))
    s = F.col("conv_id") + F.col("turn")
    category = F.when(s % 5 == 0, F.lit(None).cast("string")).when(s % 5 == 2, "unclear").when(s % 5 == 3, "off_topic").otherwise("wrong")
    return m.select("message_id", "conv_id", "turn", F.when(s % 3 == 0, "up").otherwise("down").alias("rating"), category.alias("category"), (F.col("conv_id") % 6 == 0).alias("acknowledged"))


def conversation_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id").distinct()


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("conv_id")
    return conversation_ids(spark, sf_dir).where(c % 4 != 2).select((c * 10).alias("note_id"), "conv_id", F.when(c % 2 == 0, c * 1000 + 1).alias("message_id"), (c % 7).alias("author_id"), (c % 4).alias("created"))


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_ids(spark, sf_dir).where("conv_id % 3 = 0").select("conv_id", (F.col("conv_id") % 5).alias("reviewed"))


def flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("users"))
    turn = users.withColumn("turn", F.explode(F.sequence(F.lit(1), F.least(F.col("users"), F.lit(3)).cast("int")))) .where("users > 0")
    turn = turn.where((F.col("conv_id") + F.col("turn")) % 4 == 0)
    return turn.select("conv_id", F.col("turn").cast("long").alias("turn"), F.when(F.col("turn") % 2 == 1, "extraction_attempt").otherwise("constraint_lifted").alias("flag"), (F.col("conv_id") % 9 == 0).alias("acknowledged"))


# Documents and chunks -------------------------------------------------------------------

COURSE_DOCS = f"""course_docs AS (SELECT d.doc_id, d.lang AS course_id, d.source AS source_system, CASE WHEN d.doc_id % 11 <> 0 THEN 'ref-' || (d.doc_id // 2) END AS source_ref,
  sha256(d.text) AS content_hash, d.n_chars, 'file_' || d.doc_id || CASE d.doc_id % 4 WHEN 0 THEN '.pdf' WHEN 1 THEN '.HTML' WHEN 2 THEN '' ELSE '.tar.gz' END AS filename,
  CASE WHEN d.doc_id % 13 = 0 THEN NULL ELSE ([{", ".join(f"'{k}'" for k in KINDS)}])[CAST(d.doc_id % 10 AS INTEGER) + 1] END AS kind, l.doc_id IS NOT NULL AS classified, d.doc_id % 17 = 0 AS orphaned,
  ([{", ".join(f"'{s}'" for s in STATUSES[:5])}])[CAST(d.doc_id % 5 AS INTEGER) + 1] AS status
  FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id))"""


def nth(names: tuple, i):
    return F.element_at(F.array(*[F.lit(n) for n in names]), i.cast("int") + 1)


def course_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    labelled = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("_l")).distinct()
    suffix = F.when(i % 4 == 0, ".pdf").when(i % 4 == 1, ".HTML").when(i % 4 == 2, "").otherwise(".tar.gz")
    return d.join(labelled, i == F.col("_l"), "left").select(
        "doc_id", F.col("lang").alias("course_id"), F.col("source").alias("source_system"), F.when(i % 11 != 0, F.concat(F.lit("ref-"), F.expr("doc_id div 2").cast("string"))).alias("source_ref"),
        F.sha2("text", 256).alias("content_hash"), "n_chars", F.concat(F.lit("file_"), i.cast("string"), suffix).alias("filename"),
        F.when(i % 13 != 0, nth(KINDS, i % 10)).alias("kind"), F.col("_l").isNotNull().alias("classified"), (i % 17 == 0).alias("orphaned"), nth(STATUSES[:5], i % 5).alias("status"),
    )


CHUNKS = f"""chunks AS (SELECT vec_id, vec_id // 5 AS doc_id, CAST(vec_id % 5 AS BIGINT) AS chunk_index, CASE WHEN vec_id % 19 = 0 THEN NULL ELSE ([{", ".join(f"'{k}'" for k in KINDS)}])[label + 1] END AS kind,
  'file_' || (vec_id // 5) AS filename, CAST(embedding AS DOUBLE[]) AS v, (vec_id // 5) % 7 <> 3 AS classified, (vec_id // 5) % 11 = 4 AS orphaned FROM embeddings)"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("vec_id")
    doc = F.expr("vec_id div 5")
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", doc.alias("doc_id"), (i % 5).alias("chunk_index"), F.when(i % 19 != 0, nth(KINDS, F.col("label"))).alias("kind"), F.concat(F.lit("file_"), doc.cast("string")).alias("filename"),
        F.col("embedding").cast("array<double>").alias("v"), (doc % 7 != 3).alias("classified"), (doc % 11 == 4).alias("orphaned"),
    )
