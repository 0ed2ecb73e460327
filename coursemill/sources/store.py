"""Keyed tables that change: upserts that rewrite only the buckets they touch, several tables in one commit.

A store is a folder with Parquet files and a log of manifests, one JSON file for each version.
A commit creates the next version's file if it isn't there; who comes second starts again from
the new version. Files that no manifest names are never read, so a failed write changes nothing.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import tables


class Conflict(Exception):
    """Another commit came first."""


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        at = self._hadoop.Path(self.path)
        self._fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._log = self._hadoop.Path(f"{self.path}/_log")
        self._fs.mkdirs(self._log)

    def version(self) -> int:
        """The latest version, -1 where nothing was committed."""
        names = [f.getPath().getName() for f in self._fs.listStatus(self._log)]
        return max((int(n.removesuffix(".json")) for n in names if n.endswith(".json")), default=-1)

    def manifest(self, version: int) -> dict:
        if version < 0:
            return {"tables": {}, "applied": {}}
        stream = self._fs.open(self._hadoop.Path(f"{self.path}/_log/{version:020}.json"))
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _create(self, version: int, manifest: dict) -> None:
        """Writes a version's file; Conflict where it is there. Local files are linked in, so that they are whole as soon as they are there; other file systems have to create files exclusively."""
        name, body = f"{self.path}/_log/{version:020}.json", json.dumps(manifest)
        if self._fs.getScheme() == "file":
            local = self._hadoop.Path(name).toUri().getPath()
            draft = f"{os.path.dirname(local)}/.{uuid.uuid4().hex}"
            with open(draft, "w", encoding="utf-8") as f:
                f.write(body)
            try:
                os.link(draft, local)
            except FileExistsError as e:
                raise Conflict(f"version {version}") from e
            finally:
                os.unlink(draft)
            return
        try:
            out = self._fs.create(self._hadoop.Path(name), False)
        except Exception as e:
            if self._fs.exists(self._hadoop.Path(name)):
                raise Conflict(f"version {version}") from e
            raise
        out.write(bytearray(body.encode()))
        out.close()

    def begin(self) -> Transaction:
        return Transaction(self)

    def read(self, table: str) -> DataFrame:
        return self.begin().read(table)

    def run(self, change: Callable[[Transaction], object], writer: str | None = None, batch: int | None = None, tries: int = 20) -> object:
        """change(transaction), then commit; begun again from the newest version where another commit came first.

        With a writer's name a batch whose number is not above the writer's last is left out
        (None is returned), so a replayed micro-batch changes nothing.
        """
        for _ in range(tries):
            t = self.begin()
            if writer is not None and t.manifest["applied"].get(writer, -1) >= batch:
                return None
            out = change(t)
            if writer is not None:
                t.manifest["applied"][writer] = batch
            try:
                t.commit()
                return out
            except Conflict:
                continue
        raise Conflict(f"{tries} other commits came first")

    def sink(self, table: str, writer: str, **how) -> Callable[[DataFrame, int], None]:
        """For foreachBatch: upserts each micro-batch once."""
        return lambda rows, batch: self.run(lambda t: t.upsert(table, rows, **how), writer, batch)


class Transaction:
    """Changes of a store's tables on top of one version; nothing is seen by others before commit()."""

    def __init__(self, store: Store):
        self.store, self.spark = store, store.spark
        self.base = store.version()
        self.manifest = store.manifest(self.base)
        self.changed = False

    def create(self, table: str, schema: str | StructType, keys: list[str], buckets: int = 16) -> None:
        """An empty table; one that is there stays. buckets: choose them so that a bucket is rewritten in a task."""
        kind = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
        if table not in self.manifest["tables"]:
            self.manifest["tables"][table] = {"schema": kind.jsonValue(), "keys": keys, "buckets": buckets, "folders": {}}
            self.changed = True

    def _about(self, table: str) -> tuple[dict, StructType]:
        about = self.manifest["tables"][table]
        return about, StructType.fromJson(about["schema"])

    def read(self, table: str, buckets: list[int] | None = None) -> DataFrame:
        about, schema = self._about(table)
        folders = sorted(f for b, f in about["folders"].items() if buckets is None or int(b) in buckets)
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.store.path}/{f}" for f in folders))

    def _bucket(self, about: dict) -> Column:
        return F.pmod(F.xxhash64(*about["keys"]), F.lit(about["buckets"])).cast("int")

    def _write(self, table: str, rows: DataFrame, touched: list[int]) -> None:
        about, schema = self._about(table)
        folder = f"data/{table}-{uuid.uuid4().hex}"
        placed = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields]).withColumn("_bucket", self._bucket(about))
        placed.repartition(max(len(touched), 1), "_bucket").write.partitionBy("_bucket").parquet(f"{self.store.path}/{folder}")
        there = {f.getPath().getName() for f in self.store._fs.listStatus(self.store._hadoop.Path(f"{self.store.path}/{folder}"))}
        for b in touched:
            about["folders"].pop(str(b), None)
            if f"_bucket={b}" in there:  # a bucket that lost all rows has no folder
                about["folders"][str(b)] = f"{folder}/_bucket={b}"
        self.changed = True

    def upsert(self, table: str, rows: DataFrame, seq: str | None = None, keep_old_if_null: tuple = (), add: tuple = ()) -> list[int]:
        """Puts rows in place of those with their keys and returns the buckets that were rewritten.

        Of several rows with a key the last by `seq` counts, or any where there is no seq.
        keep_old_if_null: columns in which a null leaves the old value. add: columns whose sums
        over the new rows are added to the old value instead. Rows with a null key are refused.
        """
        about, schema = self._about(table)
        keys, names = about["keys"], schema.names
        if add:
            rows = rows.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in add))
        new = rows.withColumn("seq", F.col(seq) if seq else F.lit(0)).select(*[n for n in names if n in rows.columns], "seq")
        new = new.persist()
        try:
            found = new.select(self._bucket(about).alias("b"), F.greatest(*(F.col(k).isNull().cast("int") for k in keys), F.lit(0)).alias("bad")).groupBy("b").agg(F.max("bad").alias("bad")).collect()  # a row for each bucket
            if any(r.bad for r in found):
                raise ValueError(f"null key in rows of {table}")
            touched = sorted(r.b for r in found)
            if touched:
                old = self.read(table, touched)
                if add:
                    given = new.drop("seq").select(*keys, *(F.col(c).alias(f"_{c}") for c in add))
                    value = lambda n: (F.coalesce(F.col(n), F.lit(0)) + F.coalesce(F.col(f"_{n}"), F.lit(0))).alias(n) if n in add else F.col(n)
                    merged = old.join(given, keys, "full_outer").select(*map(value, names))
                else:
                    given = new.columns
                    filled = new.select(*given, *(F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields if f.name not in given))
                    merged = tables.upsert(old, filled, keys, tuple({*keep_old_if_null, *(n for n in names if n not in given)}))
                self._write(table, merged, touched)
            return touched
        finally:
            new.unpersist()

    def delete(self, table: str, keys: DataFrame) -> list[int]:
        """Takes out the rows whose keys are given; only their buckets are rewritten."""
        about, _ = self._about(table)
        gone = keys.select(*about["keys"]).distinct()
        touched = sorted(r.b for r in gone.select(self._bucket(about).alias("b")).distinct().collect())
        if touched:
            self._write(table, self.read(table, touched).join(gone, about["keys"], "left_anti"), touched)
        return touched

    def commit(self) -> int:
        """The new version; Conflict where another transaction made it. Without a change the version stays."""
        if not self.changed:
            return self.base
        self.store._create(self.base + 1, self.manifest)
        return self.base + 1


def claim(store: Store, table: str, claimant: str, n: int, now: Column, created: str = "created") -> DataFrame:
    """The oldest n pending rows of a queue, now in work for this claimant alone; no other claim gets them.

    The table has key columns, status, started, claimant and `created`. Claims that collide begin
    again, so each row has one claimant, and none is left out while it is pending.
    """

    def change(t: Transaction) -> DataFrame:
        keys = t.manifest["tables"][table]["keys"]
        taken = t.read(table).where("status = 'pending'").orderBy(created, *keys).limit(n)
        rows = taken.withColumns({"status": F.lit("processing"), "started": now, "claimant": F.lit(claimant)})
        rows = t.spark.createDataFrame(rows.collect(), rows.schema)  # n rows, so that what is returned is what was written
        t.upsert(table, rows)
        return rows

    return store.run(change)
