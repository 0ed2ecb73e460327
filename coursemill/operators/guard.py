"""The extraction guard: document proximity over recent turns, and the latch that it trips."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW, THRESHOLD = 5, 2
EVENTS = "conv_id long, turn long, active boolean, flagged boolean, docs array<long>, lifted_at long, events array<string>"


def proximity(near: DataFrame, window: int = WINDOW, threshold: int = THRESHOLD) -> DataFrame:
    """near(conv_id, turn, doc), one row per document near a turn -> (conv_id, turn, docs): documents near at least `threshold` of the last turns.

    Each turn's document is dealt to the turns whose window holds it, so no range join is
    needed; turns that aren't in `near` have no row.
    """
    turns = near.select("conv_id", "turn").distinct()
    dealt = near.select("conv_id", "doc", F.col("turn").alias("seen")).distinct().withColumn("turn", F.explode(F.sequence(F.col("seen"), F.col("seen") + window - 1)))
    hit = dealt.groupBy("conv_id", "turn", "doc").agg(F.count("*").alias("n")).where(F.col("n") >= threshold)
    return hit.groupBy("conv_id", "turn").agg(F.array_sort(F.collect_list("doc")).alias("docs")).join(turns, ["conv_id", "turn"], "left_semi")


class Latch:
    """State of one conversation; `step` takes a turn and returns what it shows."""

    def __init__(self, active: bool = False, docs: tuple = (), lifted_at: int | None = None, recent: tuple = ()) -> None:
        self.active, self.docs, self.lifted_at, self.recent = active, tuple(docs), lifted_at, tuple(recent)

    def step(self, turn: int, intent: bool, near: list, engaged: bool | None) -> dict:
        events = []
        self.recent = (*self.recent, tuple(sorted(set(near))))[-WINDOW:]
        seen: dict = {}
        for docs in self.recent:
            for doc in docs:
                seen[doc] = seen.get(doc, 0) + 1
        winners = tuple(sorted(doc for doc, n in seen.items() if n >= THRESHOLD))
        if intent:
            events.append("intent_detected")
        was = self.active
        if was:
            if engaged:
                self.active, self.lifted_at = False, turn
                events.append("constraint_lifted")
            else:
                events.append("engagement_refused")
        if (intent or winners) and not self.active:
            self.active = True
            if not was:
                self.docs, self.lifted_at = winners or self.recent[-1], None
            cause = "intent_and_proximity" if intent and winners else "intent" if intent else "proximity"
            events.append(f"constraint_activated:{cause}")
        return {"turn": turn, "active": self.active, "flagged": bool(intent or winners), "docs": list(self.docs), "lifted_at": self.lifted_at, "events": events}


def latch_by_conversation(turns: DataFrame) -> DataFrame:
    """turns(conv_id, turn, intent, near array<long>, engaged) -> the guard's state after each turn.

    Conversations are sorted within partitions and folded as a stream of rows, so none is
    held in memory whole.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv, latch = None, Latch()
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                if r.conv_id != conv:
                    conv, latch = r.conv_id, Latch()
                near = [] if r.near is None else list(r.near)
                rows.append({"conv_id": conv, **latch.step(r.turn, bool(r.intent), near, r.engaged)})
            out = pd.DataFrame(rows, columns=["conv_id", "turn", "active", "flagged", "docs", "lifted_at", "events"])
            out["lifted_at"] = out["lifted_at"].astype("Int64")
            yield out

    rows = turns.select("conv_id", "turn", "intent", "near", "engaged")
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn").mapInPandas(fold, EVENTS)
