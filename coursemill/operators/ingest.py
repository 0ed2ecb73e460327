"""What becomes of a new document: its kind, its chunks' points in the vector table, its pooled vector and its status."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectors

#: A fixed value: chunks of this kind are never searched.
UNSEARCHED = "sample_solution"


def ingested(docs: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs(doc_id, blank, kind, locked, verdict), chunks(doc_id, chunk_index, v) -> documents and points.

    documents(doc_id, kind, status, chunks, pooled): a blank document is ready with no chunk,
    another one without chunks has failed; the classifier's verdict is the kind unless the
    teacher has locked it or there is no verdict; pooled is the unit mean of all its chunks.
    points(doc_id, chunk_index, v): the rows to append to the vector table.
    """
    kind = F.when(F.col("locked"), F.col("kind")).otherwise(F.coalesce("verdict", "kind"))
    d = docs.select("doc_id", "blank", kind.alias("kind"))
    live = chunks.join(d.where("not blank"), "doc_id", "left_semi")
    n = live.groupBy("doc_id").agg(F.count("*").alias("chunks"))
    out = d.join(n, "doc_id", "left").join(vectors.mean_pool(live, "doc_id"), "doc_id", "left").withColumn("chunks", F.coalesce("chunks", F.lit(0)))
    status = F.when(F.col("blank") | (F.col("chunks") > 0), "ready").otherwise("failed")
    hidden = d.where(F.col("kind") == UNSEARCHED).select("doc_id")
    points = live.join(hidden, "doc_id", "left_anti").select("doc_id", "chunk_index", "v")
    return out.select("doc_id", "kind", status.alias("status"), "chunks", "pooled"), points
