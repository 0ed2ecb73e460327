"""Streams over usage events and marks, and how a stream is run to its end into a table."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from ..operators.guard import EVENTS, Latch
from ..operators.queues import DEBOUNCE, MAX_AGE


def file_stream(spark: SparkSession, folder: str, name: str, files_per_batch: int = 8) -> DataFrame:
    """A table's files as a stream, a bounded number of them in each micro-batch."""
    path = f"{folder}/{name}.parquet"
    # The pattern lets the table be a folder or a single file; a stream refuses the plain path of a file.
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{path}*")


def run_to_end(stream: DataFrame, folder: str) -> DataFrame:
    """Everything that the stream emits over what its source has now, written with a checkpoint under `folder`, so that a restart goes on and emits nothing twice."""
    out = f"{folder}/stream-{uuid.uuid4().hex}"
    q = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start(f"{out}/rows")
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{out}/rows")


def usage_windows(events: DataFrame, minutes: int = 60, late: str = "10 minutes") -> DataFrame:
    """(bucket, model, calls, tokens) of tumbling windows, emitted once the watermark has passed their end; later rows are dropped."""
    w = F.window("ts", f"{minutes} minutes")
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "model").agg(F.count("*").alias("calls"), F.sum("tokens").alias("tokens")).select(F.col("w.start").alias("bucket"), "model", "calls", "tokens")


def first_of_each(events: DataFrame, keys: list, late: str = "1 hour") -> DataFrame:
    """A row for each key; copies that come within the watermark are dropped, and state is kept for no longer."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def debounced_stream(marks: DataFrame, quiet: float = DEBOUNCE, longest: float = MAX_AGE, late: str = "1 minute") -> DataFrame:
    """marks(course_id, ts, immediate) -> (course_id, first, due, marks), as operators.queues.debounced; a course whose time has come without a further mark is emitted by its timer."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        if state.hasTimedOut:
            out.append((key[0], *state.get))
            state.remove()
        else:
            first, due, n = state.get if state.exists else (0.0, 0.0, 0)
            rows = pd.concat(list(batches)).sort_values(["at", "immediate"], kind="stable")
            for at, now in zip(rows["at"], rows["immediate"], strict=True):
                if n and at >= due:
                    out.append((key[0], first, due, n))
                    n = 0
                first, due = (at, at + quiet) if not n else (first, min(at + quiet, first + longest))
                if now:
                    due = min(due, at)
                n += 1
            # The timer can't be set before the watermark.
            state.update((first, due, n))
            state.setTimeoutTimestamp(max(int(due * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["course_id", "first", "due", "marks"])

    rows = marks.withWatermark("ts", late).select("course_id", "ts", (F.unix_micros("ts") / 1e6).alias("at"), "immediate")
    return rows.groupBy("course_id").applyInPandasWithState(fold, "course_id long, first double, due double, marks long", "first double, due double, marks long", "append", "EventTimeTimeout")


def latched_stream(turns: DataFrame) -> DataFrame:
    """turns(conv_id, turn, intent, near, engaged) -> the guard's state after each turn, as operators.guard.latch_by_conversation; turns of a conversation must come in order of micro-batches."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        latch = Latch(**json.loads(state.get[0])) if state.exists else Latch()
        rows = []
        for r in pd.concat(list(batches)).sort_values("turn").itertuples(index=False):
            near = [] if r.near is None else [int(x) for x in r.near]
            rows.append({"conv_id": key[0], **latch.step(int(r.turn), bool(r.intent), near, r.engaged)})
        state.update((json.dumps({"active": latch.active, "docs": [int(x) for x in latch.docs], "lifted_at": latch.lifted_at, "recent": [list(map(int, x)) for x in latch.recent]}),))
        out = pd.DataFrame(rows, columns=["conv_id", "turn", "active", "flagged", "docs", "lifted_at", "events"])
        out["lifted_at"] = out["lifted_at"].astype("Int64")
        yield out

    rows = turns.select("conv_id", "turn", "intent", "near", "engaged")
    return rows.groupBy("conv_id").applyInPandasWithState(fold, EVENTS, "state string", "append", "NoTimeout")


def gauges(stream: DataFrame, known: list, emit: Callable[[DataFrame], None]):
    """A sink that hands on the count of each known status for every micro-batch, 0 where none came."""

    def each(batch: DataFrame, _: int) -> None:
        names = batch.sparkSession.createDataFrame([(k,) for k in known], "status string")
        n = batch.groupBy("status").agg(F.count("*").alias("n"))
        emit(names.join(n, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n")))

    return stream.writeStream.foreachBatch(each)
