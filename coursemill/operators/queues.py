"""Queues, due lists and latches. Time is always an argument."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEBOUNCE, MAX_AGE = 20, 300
LOW = -2.0


def claim_oldest(rows: DataFrame, n: int, created: str = "created", key: str = "doc_id") -> DataFrame:
    """The n oldest pending rows."""
    return rows.where("status = 'pending'").orderBy(created, key).limit(n)


def claims(rows: DataFrame, claimants: list, n: int, created: str = "created", key: str = "doc_id") -> DataFrame:
    """The oldest pending rows, `n` for each claimant in turn, with `claimant`: a row has one claimant at most."""
    first = claim_oldest(rows, n * len(claimants), created, key)
    place = F.row_number().over(Window.orderBy(created, key)) - 1  # over the few claimed rows alone
    return first.withColumn("claimant", F.element_at(F.array(*map(F.lit, claimants)), (F.floor(place / n) + 1).cast("int")))


def claimed(rows: DataFrame, taken: DataFrame, now: Column, key: str = "doc_id") -> DataFrame:
    """rows after a claim: what was taken is in work since now."""
    hit = taken.select(key, F.lit(True).alias("_hit"))
    out = rows.join(hit, key, "left").withColumns({"status": F.when(F.col("_hit"), "processing").otherwise(F.col("status")), "started": F.when(F.col("_hit"), now).otherwise(F.col("started"))})
    return out.select(*rows.columns)


def mark_now(queue: DataFrame, marks: DataFrame, now: Column, key: str) -> DataFrame:
    """queue(key, due) after marks that may not wait: a marked row is due now at the latest, and joins the queue if it wasn't there."""
    m = marks.select(key, F.lit(True).alias("_now")).distinct()
    return queue.join(m, key, "full_outer").select(key, F.when(F.col("_now"), F.least(F.coalesce("due", now), now)).otherwise(F.col("due")).alias("due"))


def take_due(queue: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(what is due and leaves the queue, what stays); a row without a time stays."""
    due = F.coalesce(F.col("due") <= now, F.lit(False))
    return queue.where(due), queue.where(~due)


def due_list(rows: DataFrame, at: str, before: Column, key: str) -> DataFrame:
    """Rows never done, then those last done before a time, oldest first."""
    return rows.where(F.col(at).isNull() | (F.col(at) < before)).orderBy(F.asc_nulls_first(at), key)


def stale_reset(rows: DataFrame, now: Column, seconds: int = 600) -> DataFrame:
    """Rows that have been in work for too long, or since nobody knows when, wait again."""
    stale = (F.col("status") == "processing") & (F.col("started").isNull() | (F.col("started") < now - seconds))
    return rows.withColumns({"status": F.when(stale, "pending").otherwise(F.col("status")), "started": F.when(~stale, F.col("started"))})


def debounced(marks: DataFrame, sweep: float | None = None, quiet: float = DEBOUNCE, longest: float = MAX_AGE) -> DataFrame:
    """marks(course_id, at, immediate), times in seconds -> (course_id, first, due, marks): one row per run of the linker.

    A mark makes a course due `quiet` seconds later, a further mark puts that off to at most
    `longest` after the first, an immediate mark makes it due at once. A course that is due
    when a mark comes has been taken. Rows pass as a sorted stream, one state at a time.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        course = first = due = None
        n = 0
        for b in batches:
            out = []
            for c, at, now in zip(b["course_id"], b["at"], b["immediate"], strict=True):
                if n and (c != course or at >= due):
                    out.append((course, first, due, n))
                    n = 0
                if not n:
                    course, first, due = c, at, at + quiet
                else:
                    due = min(at + quiet, first + longest)
                if now:
                    due = min(due, at)
                n += 1
            yield pd.DataFrame(out, columns=["course_id", "first", "due", "marks"])
        if n:
            yield pd.DataFrame([(course, first, due, n)], columns=["course_id", "first", "due", "marks"])

    rows = marks.select("course_id", F.col("at").cast("double").alias("at"), "immediate")
    kind = rows.schema["course_id"].dataType.simpleString()
    return rows.repartition("course_id").sortWithinPartitions("course_id", "at").mapInPandas(fold, f"course_id {kind}, first double, due double, marks long")


def bad_since(checks: DataFrame) -> DataFrame:
    """checks(id, at, ok) -> with `since`: when the current row of failures began; null while it is well. A check that is neither (ok is null) leaves it as it was. No state but windows."""
    w = Window.partitionBy("id").orderBy("at")
    runs = checks.withColumn("_run", F.count_if("ok").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    so_far = Window.partitionBy("id", "_run").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    return runs.withColumn("since", F.min(F.when(~F.col("ok"), F.col("at"))).over(so_far)).drop("_run")


def low_confidence(tokens: DataFrame, boundary: Column, least: float = LOW) -> DataFrame:
    """tokens(stream_id, pos, logprob) -> (stream_id, sentence, low): sentences end with the row where boundary holds; low if a token's log-probability is under the limit."""
    w = Window.partitionBy("stream_id").orderBy("pos")
    ends = tokens.withColumn("_end", boundary)
    before = F.count_if("_end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return ends.withColumn("sentence", F.coalesce(before, F.lit(0))).groupBy("stream_id", "sentence").agg(F.coalesce(F.min("logprob") < least, F.lit(False)).alias("low"))


def counted_calls(calls: DataFrame, most_calls: int = 12, most_turns: int = 8) -> DataFrame:
    """calls(run_id, turn, pos, tool, args) -> those that ran: each (tool, args) once, within the turns and the number of calls."""
    w = Window.partitionBy("run_id", "tool", "args").orderBy("turn", "pos")
    once = calls.where(F.col("turn") <= most_turns).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    order = Window.partitionBy("run_id").orderBy("turn", "pos")
    return once.withColumn("n", F.row_number().over(order).cast("long")).where(F.col("n") <= most_calls)


def stop_reasons(steps: DataFrame, restarts: int = 5, iterations: int = 8, most_bytes: int = 100_000) -> DataFrame:
    """steps(run_id, i, found, bytes, repeated, low) -> (run_id, last, reason): the first step at which a retrieval loop stops.

    A restart counts only where something was found. Reasons in order of test: repeated,
    bytes, confident (nothing to look up), restarts, iterations.
    """
    w = Window.partitionBy("run_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    s = steps.withColumn("_r", F.count_if("found").over(w)).withColumn("_b", F.sum("bytes").over(w))
    why = F.when(F.col("repeated"), "repeated").when(F.col("_b") > most_bytes, "bytes").when(~F.col("low"), "confident").when(F.col("_r") >= restarts, "restarts").when(F.col("i") >= iterations, "iterations")
    first = s.withColumn("reason", why).where("reason is not null").groupBy("run_id").agg(F.min(F.struct("i", "reason")).alias("f"))
    return first.select("run_id", F.col("f.i").alias("last"), F.col("f.reason").alias("reason"))


def loop_ends(steps: DataFrame, token_cap: int, restarts: int = 5, iterations: int = 8, most_bytes: int = 100_000) -> DataFrame:
    """steps(run_id, i, outcome, low, added, tokens, bytes, heading) -> (run_id, iterations, reason): how a loop of retrieval and writing ended; a run that hasn't has no row.

    i counts from 1. A step's outcome is `error`, `completed`, `repeat` or `limit`; low: a
    sentence of low confidence is there; added: its lookup brought something new, which
    makes it a restart; heading: what was written repeats a heading of the text before it.
    First the step is judged (error, heading, completed, repeat, restarts), then whether
    another may follow (tokens, iterations, bytes). Steps after the last allowed one are
    left out first, so a run has few rows. Unknown flags and numbers count as no and 0.
    """
    w = Window.partitionBy("run_id").orderBy("i")
    before, so_far = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, 0)
    yes, n = lambda c: F.coalesce(F.col(c), F.lit(False)), lambda c: F.coalesce(F.col(c), F.lit(0))
    s = steps.where(F.col("i") <= iterations).select("run_id", "i", "outcome", yes("low").alias("low"), yes("added").alias("added"), n("tokens").alias("tokens"), n("bytes").alias("bytes"), yes("heading").alias("heading"))
    s = s.withColumns({"text": F.coalesce(F.sum("bytes").over(before), F.lit(0)), "all_bytes": F.sum("bytes").over(so_far), "all_tokens": F.sum("tokens").over(so_far)})
    limit = F.col("outcome") == "limit"
    s = s.withColumn("again", F.coalesce(F.count_if(limit & F.col("low") & F.col("added")).over(before), F.lit(0)))
    why = F.when(F.col("outcome") == "error", "error").when(F.col("heading") & (F.col("text") > 0) & (F.col("bytes") > 0), "heading")
    why = why.when(F.col("outcome").isin("completed", "repeat"), F.col("outcome")).when(limit & F.col("low") & (F.col("again") >= restarts), "restarts")
    why = why.when(F.col("all_tokens") >= token_cap, "tokens").when(F.col("i") >= iterations, "iterations").when(F.col("all_bytes") > most_bytes, "bytes")
    first = s.withColumn("reason", why).where("reason is not null").groupBy("run_id").agg(F.min(F.struct("i", "reason")).alias("f"))
    return first.select("run_id", F.col("f.i").alias("iterations"), F.col("f.reason").alias("reason"))


def routed_status(ext: Column, hosted_pdf: Column, awaits: Column, supported: tuple) -> Column:
    """What becomes of a new document: links to hosted PDFs are tracked, links to a video wait for its transcript, other links and unknown types are unsupported."""
    return F.when(ext == "url", F.when(hosted_pdf, "tracked").when(awaits, "awaiting_transcript").otherwise("unsupported")).when(ext.isin(*supported), "processing").otherwise("unsupported")
