"""Upserts, transactions and claims against plain dictionaries, with failures and rivals."""

import random
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from coursemill.sources.store import Conflict, Store, claim
from coursemill.streaming import flows

from .test_streams import files

SCHEMA = "id long, name string, n long"


def new_store(spark, path, keys=("id",), buckets=4, schema=SCHEMA, table="t"):
    s = Store(spark, str(path))
    s.run(lambda t: t.create(table, schema, list(keys), buckets))
    return s


def rows(s, table="t"):
    return sorted(map(tuple, s.read(table).collect()))


def test_upserts_are_a_dictionary(spark, tmp_path):
    s, want, r = new_store(spark, tmp_path), {}, random.Random(1)
    assert rows(s) == []
    for i in range(5):
        batch = [(r.randint(0, 20), f"b{i}-{j}" if r.random() < 0.8 else None, j) for j in range(r.randint(1, 12))]
        s.run(lambda t, b=batch: t.upsert("t", spark.createDataFrame(b, SCHEMA), seq="n", keep_old_if_null=("name",)))
        last = {}
        for x in batch:  # the last of a batch counts, and its null leaves the old name
            last[x[0]] = x
        for k, name, n in last.values():
            want[k] = (k, name if name is not None else want.get(k, (k, None, 0))[1], n)
        assert rows(s) == sorted(want.values())
    s.run(lambda t: t.delete("t", spark.createDataFrame([(k,) for k in list(want)[:5]], "id long")))
    assert rows(s) == sorted(list(want.values())[5:])


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    s = new_store(spark, tmp_path, buckets=8)
    s.run(lambda t: t.upsert("t", spark.range(100).select("id", F.lit("x").alias("name"), F.lit(1).cast("long").alias("n"))))
    before = s.manifest(s.version())["tables"]["t"]["folders"]
    touched = s.run(lambda t: t.upsert("t", spark.createDataFrame([(7, "y", 2)], SCHEMA)))
    after = s.manifest(s.version())["tables"]["t"]["folders"]
    assert len(touched) == 1 and {b for b in before if before[b] != after[b]} == {str(touched[0])}
    assert len(rows(s)) == 100


def test_replay_and_failure_change_nothing(spark, tmp_path):
    s = new_store(spark, tmp_path)
    put = lambda b, i: s.run(lambda t: t.upsert("t", spark.createDataFrame(b, SCHEMA), add=("n",)), "w", i)
    put([(1, None, 5), (1, None, 2), (2, None, 1)], 0)
    put([(1, None, 5), (1, None, 2), (2, None, 1)], 0)
    put([(1, None, 1)], 1)
    assert rows(s) == [(1, None, 8), (2, None, 1)]
    broken = spark.createDataFrame([(1, "x", 1)], SCHEMA).withColumn("n", F.raise_error(F.lit("broken")).cast("long"))
    with pytest.raises(Exception, match="broken"):
        s.run(lambda t: t.upsert("t", broken))
    with pytest.raises(ValueError, match="null key"):
        s.run(lambda t: t.upsert("t", spark.createDataFrame([(None, "x", 1)], SCHEMA)))
    assert rows(s) == [(1, None, 8), (2, None, 1)] and s.version() == 2


def test_tables_change_together_or_not_at_all(spark, tmp_path):
    s = new_store(spark, tmp_path)
    s.run(lambda t: t.create("u", SCHEMA, ["id"], 2))
    one = spark.createDataFrame([(1, "a", 1)], SCHEMA)

    def half(t):
        t.upsert("t", one)
        raise RuntimeError("between two tables")

    with pytest.raises(RuntimeError):
        s.run(half)
    assert rows(s) == rows(s, "u") == []
    s.run(lambda t: (t.upsert("t", one), t.upsert("u", one)))
    assert rows(s) == rows(s, "u") == [(1, "a", 1)]


def test_second_of_two_commits_conflicts_and_begins_again(spark, tmp_path):
    s = new_store(spark, tmp_path)
    a, b = s.begin(), s.begin()
    a.upsert("t", spark.createDataFrame([(1, "a", 1)], SCHEMA))
    b.upsert("t", spark.createDataFrame([(1, "b", 1), (2, "b", 1)], SCHEMA), keep_old_if_null=("name",))
    a.commit()
    with pytest.raises(Conflict):
        b.commit()
    assert rows(s) == [(1, "a", 1)]


def test_stream_is_added_once(spark, tmp_path):
    r = random.Random(2)
    events = [(r.randint(1, 5), "x", i, i) for i in range(60)]
    files(spark, events, "id long, name string, n long, at long", str(tmp_path), lambda x: x[3], 3)
    s = new_store(spark, tmp_path / "store")
    for _ in range(2):  # the second run finds nothing new
        stream = flows.file_stream(spark, str(tmp_path), "rows", 1)
        stream.writeStream.foreachBatch(s.sink("t", "ledger", add=("n",))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    want = {}
    for k, _, n, _ in events:
        want[k] = want.get(k, 0) + n
    assert rows(s) == sorted((k, None, n) for k, n in want.items())
    s.sink("t", "ledger", add=("n",))(spark.createDataFrame([(1, None, 10**6)], SCHEMA), 2)  # batch 2 once more
    assert rows(s) == sorted((k, None, n) for k, n in want.items())


QUEUE = "id long, status string, started long, claimant string, created long"
WORKER = """
import sys
from pyspark.sql import SparkSession, functions as F
from coursemill.sources.store import Store, claim
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.driver.memory", "1g").config("spark.sql.shuffle.partitions", "1").getOrCreate()
store, got = Store(spark, sys.argv[1]), []
while rows := claim(store, "q", sys.argv[2], 3, F.lit(1).cast("long")).collect():
    got += [r.id for r in rows]
print("CLAIMED", *got)
"""


def test_two_processes_share_a_queue(spark, tmp_path):
    s = new_store(spark, tmp_path, schema=QUEUE, table="q", buckets=2)
    s.run(lambda t: t.upsert("q", spark.range(18).select("id", F.when(F.col("id") == 4, "ready").otherwise("pending").alias("status"), F.lit(None).cast("long").alias("started"), F.lit(None).cast("string").alias("claimant"), (-F.col("id")).alias("created"))))
    first = claim(s, "q", "here", 2, F.lit(1).cast("long")).collect()
    assert [r.id for r in first] == [17, 16]
    work = [subprocess.Popen([sys.executable, "-c", WORKER, str(tmp_path), name], stdout=subprocess.PIPE, text=True) for name in ("a", "b")]
    got = {}
    for name, p in zip("ab", work, strict=True):
        said = p.communicate(timeout=240)[0]
        got[name] = [int(x) for x in next(x for x in said.splitlines() if x.startswith("CLAIMED")).split()[1:]]
    assert sorted(got["a"] + got["b"]) == [i for i in range(16) if i != 4]
    after = {r.id: (r.status, r.claimant) for r in s.read("q").collect()}
    assert after[4] == ("ready", None) and all(after[i] == ("processing", n) for n, ids in got.items() for i in ids)
