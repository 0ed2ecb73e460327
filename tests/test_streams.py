"""Streams give what the batch forms give."""

import random

import pytest
from pyspark.sql import functions as F

from coursemill.operators import guard, queues
from coursemill.streaming import flows


def files(spark, rows, schema, folder, by, n):
    """Rows in n files, whose times follow the order of `by`."""
    import os
    import time

    rows = sorted(rows, key=by)
    for i in range(n):
        part = rows[i * len(rows) // n : (i + 1) * len(rows) // n]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{folder}/t{i}")
    os.makedirs(f"{folder}/rows.parquet")
    for i in range(n):
        src = next(p for p in os.listdir(f"{folder}/t{i}") if p.endswith(".parquet"))
        os.rename(f"{folder}/t{i}/{src}", f"{folder}/rows.parquet/{i:03}.parquet")
        os.utime(f"{folder}/rows.parquet/{i:03}.parquet", (time.time() - 100 + i,) * 2)


def test_guard_stream_is_the_batch(spark, tmp_path):
    r = random.Random(1)
    rows = [(c, t, r.random() < 0.2, [r.randint(0, 4) for _ in range(r.randint(0, 2))], r.random() < 0.4) for c in range(12) for t in range(1, 15)]
    schema = "conv_id long, turn long, intent boolean, near array<long>, engaged boolean"
    files(spark, rows, schema, str(tmp_path), lambda x: x[1], 3)
    stream = flows.latched_stream(flows.file_stream(spark, str(tmp_path), "rows", 1))
    got = flows.run_to_end(stream, str(tmp_path / "out")).collect()
    want = guard.latch_by_conversation(spark.createDataFrame(rows, schema)).collect()
    assert sorted(map(str, got)) == sorted(map(str, want))


def brute_debounce(marks):
    out, state = [], {}
    for course, at, now in sorted(marks, key=lambda m: (m[1], m[2])):
        first, due, n = state.get(course, (None, None, 0))
        if n and at >= due:
            out.append((course, first, due, n))
            n = 0
        first, due = (at, at + 20) if not n else (first, min(at + 20, first + 300))
        state[course] = (first, min(due, at) if now else due, n + 1)
    return out, [(c, *s) for c, s in state.items()]


@pytest.mark.parametrize("gap", [6, 60])
def test_debounce_stream_and_batch(spark, tmp_path, gap):
    r = random.Random(gap)
    marks, at = [], 1_700_000_000.0
    for _ in range(400):
        at += r.randint(1, gap)
        marks.append((r.randint(1, 2), at, r.random() < 0.02))
    done, left = brute_debounce(marks)
    batch = queues.debounced(spark.createDataFrame(marks, "course_id long, at double, immediate boolean"))
    assert sorted(map(tuple, batch.collect())) == sorted(done + left)
    files(spark, marks, "course_id long, at double, immediate boolean", str(tmp_path), lambda x: x[1], 4)
    stream = flows.file_stream(spark, str(tmp_path), "rows", 1).select("course_id", F.timestamp_seconds("at").alias("ts"), "immediate")
    got = sorted(map(tuple, flows.run_to_end(flows.debounced_stream(stream), str(tmp_path / "out")).collect()))
    assert set(done) <= set(got) <= set(done + left)
    assert len(got) == len(set(got))


def test_windows_close_with_the_watermark(spark, tmp_path):
    rows = [(t * 600, "a" if t % 2 else "b", 5) for t in range(40)]
    files(spark, rows, "s long, model string, tokens long", str(tmp_path), lambda x: x[0], 2)
    stream = flows.file_stream(spark, str(tmp_path), "rows", 1).select(F.timestamp_seconds("s").alias("ts"), "model", "tokens")
    got = flows.run_to_end(flows.usage_windows(stream), str(tmp_path / "out")).collect()
    assert len(got) == 12  # the last window is still open
    assert {(r.calls, r.tokens) for r in got} == {(3, 15)}


def test_gauges_fill_with_zero(spark, tmp_path):
    files(spark, [(1, "ready"), (2, "ready")], "id long, status string", str(tmp_path), lambda x: x[0], 1)
    seen = []
    q = flows.gauges(flows.file_stream(spark, str(tmp_path), "rows"), ["ready", "failed"], lambda df: seen.append(sorted(map(tuple, df.collect())))).trigger(availableNow=True).start()
    q.awaitTermination()
    assert seen == [[("failed", 0), ("ready", 2)]]


def test_latch_follows_the_order_of_a_turn():
    s = guard.Latch()
    assert s.step(1, False, [7], None)["active"] is False
    on = s.step(2, False, [7, 8], None)
    assert on["active"] and on["docs"] == [7] and on["events"] == ["constraint_activated:proximity"]
    assert s.step(3, False, [], False)["events"] == ["engagement_refused"]
    again = s.step(4, True, [], True)  # lifted and active again in one turn: documents and lifted_at stay
    assert again["active"] and again["docs"] == [7] and again["lifted_at"] == 4
    assert again["events"] == ["intent_detected", "constraint_lifted", "constraint_activated:intent_and_proximity"]
