"""Queries of the paginated sources: pages that Spark stores from the driver's tables stand in for the network."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.durable import shared_path
from ..sources import paged
from ..streaming import flows
from .bindings import table
from .registry import query

FILES = """SELECT c_nationkey AS course_id, c_custkey AS file_id, c_name AS display_name, CAST((row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1) // 10 AS INTEGER) AS page,
  CAST((row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1) % 10 AS INTEGER) AS place FROM customer"""


def _files(spark, sf_dir):
    """(first links, folder) of each nation's customers as a course's listing of files, ten a page."""
    path = shared_path(spark, "pages")
    rows = table(spark, sf_dir, "customer")
    paged.store_pages(rows, "c_nationkey", "c_custkey", F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("display_name")), 10, path)
    courses = [r[0] for r in rows.select("c_nationkey").distinct().orderBy("c_nationkey").collect()]
    return [f"{path}/listing={c}/page=0" for c in courses], path


def _listed(items):
    course = F.regexp_extract("start", "listing=([0-9]+)/", 1).cast("int")
    item = F.from_json("item", "id long, display_name string")
    return items.select(course.alias("course_id"), item["id"].alias("file_id"), item["display_name"].alias("display_name"), "page", "place")


@query(FILES)
def s7_paged_files(spark, sf_dir):
    """Files of every course, by following next links to the end."""
    return _listed(paged.paged(spark, _files(spark, sf_dir)[0]))


@query(FILES)
def s7_paged_stream(spark, sf_dir):
    """The same listings as a stream, which is started twice and reads nothing again."""
    starts, path = _files(spark, sf_dir)
    rows = lambda: _listed(paged.paged(spark, starts, stream=True))
    flows.run_to_end(rows(), f"{path}-out")
    return flows.run_to_end(rows(), f"{path}-out")


@query("""WITH m AS (SELECT c_nationkey AS context_id, 'u' || c_custkey AS user_id, CASE WHEN c_custkey % 7 = 0 THEN 'Inactive' ELSE 'Active' END AS status, lower(c_mktsegment) || '@uni.example' AS email,
  (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1) AS i, c_nationkey AS n FROM customer WHERE c_acctbal > 0)
  SELECT context_id, user_id, status, email, CAST(i // 100 AS INTEGER) AS page FROM m""")
def s8_roster(spark, sf_dir):
    """Members of every roster container, a hundred a page, to the end, as containers grow with the table; a last page that links to itself ends the container."""
    path = shared_path(spark, "rosters")
    c = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").where("c_acctbal > 0")
    item = F.struct(F.concat(F.lit("u"), c.cast("string")).alias("user_id"), F.when(c % 7 == 0, "Inactive").otherwise("Active").alias("status"), F.concat(F.lower("c_mktsegment"), F.lit("@uni.example")).alias("email"))
    paged.store_pages(rows, "c_nationkey", "c_custkey", item, 100, path, self_link=True)
    contexts = [r[0] for r in rows.select("c_nationkey").distinct().orderBy("c_nationkey").collect()]
    got = paged.roster_members(spark, [f"{path}/listing={x}/page=0" for x in contexts], most=0)
    m = F.from_json("item", "user_id string, status string, email string")
    return got.select(F.regexp_extract("start", "listing=([0-9]+)/", 1).cast("int").alias("context_id"), m["user_id"].alias("user_id"), m["status"].alias("status"), m["email"].alias("email"), "page")
