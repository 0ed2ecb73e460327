"""Preparing a training corpus: five stages over `documents`, each written as Parquet and read again by the next.

Every stage works on all rows that the one before kept. Quality, SimHash and
decontamination drop rows, PII masks text, and mixing repeats rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coursemill.llm import decontaminate, mixing, pii, quality, simhash_dedup
from coursemill.llm.common import plain, table, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ranker predicts to be good.

    Null and empty texts are scored like any other. Repeated rows share a score, so all or
    none stay; rows without an id are scored too. An empty table stays empty, and columns
    keep their names and order, whatever they are called.
    """
    fold = F.crc32(F.col("_id").cast("string").cast("binary")) % 5
    found = quality.document_features(table(spark, sf_dir, "documents"), {"_id": F.col("doc_id").cast("long")})
    model = quality.train_ranker(found, table(spark, sf_dir, "labels"), fold != 0)
    rows, names = plain(docs)
    scored = quality.score_quality(rows, model, {n: F.col(n) for n in names}, names[docs.columns.index("text")])
    return scored.where(F.col("score") >= quality.PREDICT_AT).select(*names).toDF(*docs.columns)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component, the one with the smallest id.

    Null and blank texts are one component. Of rows that share an id the one with the
    smallest JSON stays; a row without an id stays where no other row has its fingerprint.
    Empty tables and clashing names as in quality_stage().
    """
    return simhash_dedup.one_of_each(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item.

    Null and empty texts hold none and stay, as do rows without an id. Rows that share an id
    stay or go together. Empty tables and clashing names as in quality_stage().
    """
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data masked, and n_chars counted anew.

    A null text stays null, with a null n_chars; every row stays. Empty tables and clashing
    names as in quality_stage().
    """
    masked = pii.mask_pii(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, numbered in column `copy` from 1; a column of that name is replaced.

    Rows that share an id and a source are taken together, null ones too; a null source is a
    source of its own. Null and blank texts have no words and are never taken. Empty tables
    and clashing names as in quality_stage().
    """
    rows, names = plain(docs)
    at = {c: names[docs.columns.index(c)] for c in ("doc_id", "source", "text")}
    units = mixing.word_counts(rows, at["doc_id"], at["source"], at["text"]).groupBy("id", "source").agg(F.sum("size").alias("size"))
    taken = mixing.mix_sources(units).where("copies > 0").select(F.col("id").alias("_id"), F.col("source").alias("_source"), F.col("copies").alias("_copies"))
    same = F.col(at["doc_id"]).cast("long").eqNullSafe(F.col("_id")) & F.col(at["source"]).cast("string").eqNullSafe(F.col("_source"))
    out = rows.join(taken, same).select(*names, F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))).alias("_copy")).toDF(*docs.columns, "_copy")
    return out.drop("copy").withColumnRenamed("_copy", "copy")


STAGES = [
    ("quality", quality_stage),
    ("simhash", simhash_stage),
    ("decontaminate", decontaminate_stage),
    ("pii", pii_stage),
    ("mix", mix_stage),
]
#: Learned scores, fingerprints and random rounding have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixed corpus: rows of `documents` after all stages, with column `copy`."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"stage-{name}")
    return docs
