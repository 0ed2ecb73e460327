"""An inverted index of tokens: posting lists in blocks by ranges of ids, as a Parquet table of buckets.

A row has the postings of a token in one part (body or name) and one segment of SEGMENT ids:
the ids' sorted places in the segment, how often each has the token, and the bounds by which
blocks are skipped. The file format delta-codes the places. No row and no group is larger than
a segment, however common the token is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEGMENT, BUCKETS = 1 << 14, 64
#: Chunks for each partition in which postings are grouped.
CHUNKS = 1 << 10
INDEX = "bucket int, token string, part string, segment long, n int, first int, last int, places array<int>, times array<int>"


def exploded(chunks: DataFrame, parts: tuple = ("body", "name")) -> DataFrame:
    """(token, part, segment, place) of chunks(chunk_id, one array of tokens for each part)."""
    at = [F.floor(F.col("chunk_id") / SEGMENT).alias("segment"), F.pmod("chunk_id", F.lit(SEGMENT)).cast("int").alias("place")]
    out = None
    for p in parts:
        one = chunks.where("chunk_id IS NOT NULL").select(F.explode(p).alias("token"), F.lit(p).alias("part"), *at)
        out = one if out is None else out.unionByName(one)
    return out.where("token IS NOT NULL")


def postings(tokens: DataFrame, buckets: int = BUCKETS, partitions: int = 1) -> DataFrame:
    """Index rows of exploded tokens, grouped in `partitions` or as many as the session has, if those are more. Both groupings share one shuffle; a repeated chunk id counts once for each of its tokens' occurrences."""
    block = ["token", "part", "segment"]
    partitions = max(partitions, int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    each = tokens.repartition(partitions, *block).groupBy(*block, "place").agg(F.count("*").cast("int").alias("t"))
    rows = each.groupBy(*block).agg(F.array_sort(F.collect_list(F.struct("place", "t"))).alias("p"))
    places = F.transform("p", lambda x: x["place"])
    return rows.select(
        F.pmod(F.xxhash64("token"), F.lit(buckets)).cast("int").alias("bucket"), *block, F.size("p").alias("n"), F.element_at("p", 1)["place"].alias("first"), F.element_at("p", -1)["place"].alias("last"),
        places.alias("places"), F.transform("p", lambda x: x["t"]).alias("times"),
    )


def write_index(chunks: DataFrame, path: str, parts: tuple = ("body", "name"), buckets: int = BUCKETS) -> None:
    """The index of chunks as a table with a folder for each bucket of tokens, sorted by token in its files.

    Postings are grouped in a partition for each CHUNKS chunks, so a task doesn't grow with the table.
    """
    rows = postings(exploded(chunks, parts), buckets, -(-chunks.count() // CHUNKS)).repartition("bucket", F.pmod("segment", F.lit(8))).sortWithinPartitions("bucket", "token", "part", "segment")
    rows.write.partitionBy("bucket").option("parquet.writer.version", "PARQUET_2_0").option("parquet.enable.dictionary", "false").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(path)


def frequencies(index: DataFrame) -> DataFrame:
    """(token, part, chunks, occurrences, blocks)."""
    total = F.aggregate("times", F.lit(0).cast("long"), lambda a, x: a + x)
    return index.groupBy("token", "part").agg(F.sum("n").alias("chunks"), F.sum(total).alias("occurrences"), F.count("*").alias("blocks"))


def search(queries: DataFrame, index: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """queries(query_id, tokens) -> distinct (query_id, chunk_id): chunks that have all tokens in one part.

    A query begins with its rarest token in a part and reads the blocks of its other tokens
    only in segments that this one has, where their bounds overlap. Queries without tokens find
    nothing, nor do tokens that the index doesn't hold; null and repeated tokens don't count.
    """
    q = queries.select("query_id", F.array_distinct(F.filter("tokens", lambda t: t.isNotNull())).alias("tokens")).where("size(tokens) > 0").withColumn("need", F.size("tokens"))
    bucket = F.pmod(F.xxhash64("token"), F.lit(buckets)).cast("int").alias("bucket")
    wanted = q.select(F.explode("tokens").alias("token")).distinct().select("token", bucket)
    df = index.join(wanted, ["bucket", "token"], "left_semi").groupBy("token", "part").agg(F.sum("n").alias("df"))
    known = q.select("query_id", "need", F.explode("tokens").alias("token")).join(df, "token")
    lead = known.groupBy("query_id", "part").agg(F.first("need").alias("need"), F.count("*").alias("held"), F.min(F.struct("df", "token")).alias("least"), F.collect_list("token").alias("all"))
    lead = lead.where("held = need").select("query_id", "part", "need", F.col("least.token").alias("token"), F.array_remove("all", F.col("least.token")).alias("others"))
    led = lead.withColumn("bucket", bucket).join(index.select("bucket", "token", "part", "segment", "first", "last", "places"), ["bucket", "token", "part"])
    alone = led.where("need = 1").select("query_id", "segment", "places")
    more = led.where("need > 1").select("query_id", "part", "segment", "need", F.col("first").alias("low"), F.col("last").alias("high"), F.col("places").alias("lead"), F.explode("others").alias("token")).withColumn("bucket", bucket)
    met = more.join(index.select("bucket", "token", "part", "segment", "first", "last", "places"), ["bucket", "token", "part", "segment"]).where("first <= high AND last >= low")
    cut = met.select("query_id", "part", "segment", "need", F.array_intersect("lead", "places").alias("places")).where("size(places) > 0")
    both = cut.groupBy("query_id", "part", "segment").agg(F.first("need").alias("need"), F.collect_list("places").alias("sets")).where("size(sets) = need - 1")
    both = both.select("query_id", "segment", F.aggregate("sets", F.element_at("sets", 1), lambda a, x: F.array_intersect(a, x)).alias("places"))
    found = alone.unionByName(both)
    return found.select("query_id", "segment", F.explode("places").alias("place")).select("query_id", (F.col("segment") * SEGMENT + F.col("place")).alias("chunk_id")).distinct()
