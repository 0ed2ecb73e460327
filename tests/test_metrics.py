"""Growth of counters over ranges, latches and loops, against plain loops."""

import random

from pyspark.sql import functions as F

from coursemill.operators import metrics, queues

SCHEMA = "s string, sec double, value double"


def brute(rows, seconds, step):
    best = {}
    for s, t, v in rows:
        if t is not None and v is not None and v == v:
            best[s, t] = max(v, best.get((s, t), v))
    out = {}
    for s in {k for k, _ in best}:
        mine = sorted((t, v) for (k, t), v in best.items() if k == s)
        for end in range(0, int(mine[-1][0]) + seconds + step, step):
            w = [(t, v) for t, v in mine if end - seconds < t <= end]
            if len(w) < 2:
                continue
            inc = sum(b[1] if b[1] < a[1] else b[1] - a[1] for a, b in zip(w, w[1:], strict=False))
            span = w[-1][0] - w[0][0]
            gap, left, right = span / (len(w) - 1), w[0][0] - (end - seconds), end - w[-1][0]
            left, right = (gap / 2 if x >= gap * 1.1 else x for x in (left, right))
            if inc > 0 and w[0][1] >= 0:
                left = min(left, span * w[0][1] / inc)
            out[s, end] = inc * (span + left + right) / span
    return out


def got(spark, rows, seconds, step):
    df = spark.createDataFrame(rows, SCHEMA).select("s", F.timestamp_seconds("sec").alias("ts"), "value")
    found = metrics.range_increase(df, ["s"], seconds, step).select("s", F.unix_seconds("time").alias("t"), "increase", "rate").collect()
    assert all(abs(r.rate - r.increase / seconds) < 1e-9 for r in found)
    return {(r.s, r.t): r.increase for r in found}


def same(a, b):
    assert a.keys() == b.keys()
    assert all(abs(a[k] - b[k]) <= 1e-6 * max(1, abs(b[k])) for k in a)


def test_ranges_against_a_loop(spark):
    r = random.Random(4)
    rows = []
    for s in ("a", "b", None):
        t, v = r.randint(0, 300), 0.0
        for _ in range(150):
            t += r.choice([1, 5, 15, 15, 15, 200, 900])
            v = 0.0 if r.random() < 0.05 else r.choice([1.0, 7.0]) if r.random() < 0.05 else v + r.choice([0, 0.5, 3, 20])
            rows.append((s, float(t), v))
    for seconds, step in ((300, 60), (300, 300), (60, 300), (1000, 70)):
        want = brute(rows, seconds, step)
        assert want
        same(got(spark, rows, seconds, step), want)


def test_ranges_of_awkward_samples(spark):
    assert got(spark, [], 300, 60) == {}
    rows = [("a", 10.0, 1.0), ("a", 10.0, 3.0), ("a", 10.0, 3.0), ("a", 20.0, float("nan")), ("a", None, 9.0), ("a", 30.0, None), ("a", 40.0, 5.0), ("b", 10.0, 1.0), (None, 10.0, -5.0), (None, 60.0, 1.0)]
    found = got(spark, rows, 300, 60)
    same(found, brute(rows, 300, 60))
    assert {s for s, _ in found} == {"a", None}
    clash = spark.createDataFrame([(1, 0, 1.0), (1, 30, 2.0)], "_at long, ts long, value double").withColumn("ts", F.timestamp_seconds("ts"))
    assert metrics.range_increase(clash, ["_at"], 60, 60).columns == ["_at", "time", "increase", "rate"]


def test_a_check_that_is_neither_leaves_the_latch(spark):
    rows = [(1, 1, None), (1, 2, False), (1, 3, None), (1, 4, False), (1, 5, True), (1, 6, None), (1, 7, False)]
    out = queues.bad_since(spark.createDataFrame(rows, "id long, at long, ok boolean")).orderBy("at").collect()
    assert [r.since for r in out] == [None, 2, 2, 2, None, None, 7]


def brute_loop(steps, cap, most_bytes):
    restarts = tokens = size = done = 0
    for outcome, low, added, t, b, heading in steps:
        done += 1
        if outcome == "error":
            return done, "error"
        if heading and size > 0 and b:
            return done, "heading"
        if outcome != "limit":
            return done, outcome
        if low and restarts >= 5:
            return done, "restarts"
        restarts, tokens, size = restarts + bool(low and added), tokens + (t or 0), size + (b or 0)
        for reason, holds in (("tokens", tokens >= cap), ("iterations", done >= 8), ("bytes", size > most_bytes)):
            if holds:
                return done, reason
    return None


def test_loops_end_as_a_plain_loop_does(spark):
    r = random.Random(8)
    rows, want = [], {}
    for run in range(600):
        steps = [
            (r.choices(["limit", "error", "completed", "repeat"], [20, 1, 1, 1])[0], r.choice([True, True, True, False, None]), r.random() < 0.9, r.choice([None, 1, 10, 60]), r.choice([None, 0, 10, 40]), r.random() < 0.03)
            for _ in range(r.randint(1, 11))
        ]
        rows += [(run, i, *s) for i, s in enumerate(steps, 1)]
        if end := brute_loop(steps, 300, 150):
            want[run] = end
    df = spark.createDataFrame(rows, "run_id long, i long, outcome string, low boolean, added boolean, tokens long, bytes long, heading boolean")
    got = {x.run_id: (x.iterations, x.reason) for x in queues.loop_ends(df, 300, most_bytes=150).collect()}
    assert got == want
    assert {reason for _, reason in want.values()} == {"error", "heading", "completed", "repeat", "restarts", "tokens", "iterations", "bytes"}
