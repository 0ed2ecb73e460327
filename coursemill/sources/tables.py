"""Keyed and partitioned tables: how rows are named, appended and upserted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def collection_name(course: Column, version: Column) -> Column:
    """course_<id>, with _v<n> from the second version on."""
    base = F.concat(F.lit("course_"), course)
    return F.when(version <= 1, base).otherwise(F.concat(base, F.lit("_v"), version.cast("string")))


def upsert(old: DataFrame, new: DataFrame, keys: list, keep_old_if_null: tuple = ()) -> DataFrame:
    """old with the rows of new in place of those with the same key; of several new rows with a key the last in column order `seq` counts. For the columns of keep_old_if_null a null in new leaves the old value."""
    w = Window.partitionBy(*keys).orderBy(F.desc("seq"))
    last = new.withColumn("_at", F.row_number().over(w)).where("_at = 1").drop("_at", "seq")
    rest = [c for c in last.columns if c not in keys]
    n = last.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in rest], F.lit(True).alias("_hit"))
    joined = old.join(n, keys, "full_outer")
    pick = lambda c: F.coalesce(F.col(f"_new_{c}"), F.col(c)) if c in keep_old_if_null else F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c))
    return joined.select(*keys, *[pick(c).alias(c) for c in rest])


def append(rows: DataFrame, path: str, *by: str) -> None:
    """Append to a Parquet table partitioned by columns."""
    rows.write.mode("append").partitionBy(*by).parquet(path)


def append_points(points: DataFrame, course: Column, version: Column, path: str) -> None:
    """Append vectors to the table of all collections, a partition for each course and version."""
    append(points.withColumn("collection", collection_name(course, version)), path, "collection")


def zipped(df: DataFrame, *arrays: str) -> DataFrame:
    """One row per position of arrays of one length."""
    return df.withColumn("_z", F.explode(F.arrays_zip(*arrays))).select(*[c for c in df.columns if c not in arrays], "_z.*")
