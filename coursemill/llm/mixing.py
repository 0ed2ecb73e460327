"""Mixing sources to target weights by pivotal dependent rounding.

Each source's documents get the same expected number of copies, target / size of the
source. Whole copies are certain; the fractions are rounded in pairs: a random transfer of
words between a document and those still open keeps each one's chance and the words of all,
and makes one of them whole, large documents first. Buckets of documents round on their own and leave one fraction each;
those are rounded again, `FAN` buckets at a time, until one is left for a source.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_BYTES, text_buffer, word_spans, written

BUCKET_ROWS = 8192
FAN = 256
#: Equal units that one row is expanded to at a time.
REPEATS = 1 << 16
#: Weights dealt to the sources in order, repeating. Fixed values.
WEIGHTS = (3, 1, 2)


def word_counts(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(id, source, size): runs of anything but ASCII white space in each whole text; null counts 0."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = text_buffer(b.column(2))
            n = np.zeros(b.num_rows, np.int64)
            for _, starts, _, doc, _ in word_spans(data, offsets, SPACE_BYTES):
                if len(starts):
                    n += np.bincount(doc, minlength=len(n))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n)], ["id", "source", "size"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(of, "id long, source string, size long")


def _placed(rows: DataFrame) -> DataFrame:
    """rows(source, ...) with `at`, the source's place from 0 by code point, null last; sorted by range, so no task holds all sources."""
    order = rows.orderBy(F.col("source").isNull(), F.col("source")).withColumn("_row", F.monotonically_increasing_id())
    order = written(order.withColumn("_part", F.shiftright("_row", 33)), "sources")
    before, starts = 0, []
    for r in order.groupBy("_part").count().orderBy("_part").collect():
        starts.append((r["_part"], before))
        before += r["count"]
    starts = rows.sparkSession.createDataFrame(starts, "_part long, _start long")
    return order.join(starts, "_part").withColumn("at", F.col("_start") + F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))).drop("_part", "_row", "_start")


def source_targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple = WEIGHTS) -> DataFrame:
    """sizes(source, size) or (source, size, n), n equal rows each -> (source, rows, source_size, target, most_equal): the targets are min(most x size, weight x level) with one level for all that makes them sum to share x all sizes.

    The level grows while sources reach their caps and the others share the excess by
    weight; each round is one sum over the sources.
    """
    n = F.col("n") if "n" in sizes.columns else F.lit(1)
    src = sizes.groupBy("source").agg(F.sum(n).alias("rows"), F.sum(F.col("size") * n).alias("source_size"), F.max(n).alias("most_equal"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("at") % len(weights) + 1).cast("int"))
    src = _placed(src).withColumn("weight", weight)
    cap = most * F.col("source_size")

    def sums(where: Column) -> tuple[int, float]:
        r = src.where(where).agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
        return int(r[0]), float(r[1])

    size, weight = sums(F.lit(True))
    level, before = share * size / weight if weight else 0.0, (-1, -1.0)
    while (capped := sums(cap < F.col("weight") * F.lit(level))) != before:
        before, left = capped, weight - capped[1]
        level = (share * size - most * capped[0]) / left if left > 0 else float("inf")
    return src.select("source", "rows", "source_size", F.least(cap, F.col("weight") * F.lit(level)).alias("target"), "most_equal")


def pivot(p: np.ndarray, w: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Round the chances p, keeping each one's expectation and sum(p * w); one of them may stay a fraction.

    The open unit of the largest w is paired with all other open ones: a random transfer of
    words makes it whole, or one of them. So the fraction that is left is the smallest
    unit's, unless a unit is larger than all the others can balance.
    """
    p, eps = p.astype(float).copy(), 1e-12
    p[p <= eps], p[p >= 1 - eps] = 0.0, 1.0
    left = np.flatnonzero((p > 0) & (p < 1))
    left = left[np.argsort(-w[left], kind="stable")]
    if len(left) > 1 and np.ptp(p[left]) == 0:
        # Equal chances stay equal, so one number stands for all that are open.
        q, rest, u = float(p[left[0]]), np.cumsum(w[left][::-1])[::-1], rng.random(len(left))
        for k, i in enumerate(left[:-1]):
            mine, others = float(w[i]), float(rest[k + 1])
            up, down = min((1 - q) * mine, q * others), min(q * mine, (1 - q) * others)
            if u[k] * (up + down) < down:
                p[i], q = (1.0, q - up / others) if up < q * others else (q + up / mine, 0.0)
            else:
                p[i], q = (0.0, q + down / others) if down < (1 - q) * others else (q - down / mine, 1.0)
            if q <= eps or q >= 1 - eps:
                break
        p[left[k + 1 :]] = round(q) if q <= eps or q >= 1 - eps else q
        p[np.abs(p - np.round(p)) <= eps] = np.round(p[np.abs(p - np.round(p)) <= eps])
        return p
    while len(left) > 1:
        i, rest = left[0], left[1:]
        share = p[rest] * (1 - p[rest])
        share /= (share * w[rest]).sum()
        up, down = min((1 - p[i]) * w[i], (p[rest] / share).min()), min(p[i] * w[i], ((1 - p[rest]) / share).min())
        step = up if rng.random() * (up + down) < down else -down
        p[i] += step / w[i]
        p[rest] -= step * share
        p[left] = np.where(p[left] <= eps, 0.0, np.where(p[left] >= 1 - eps, 1.0, p[left]))
        left = left[(p[left] > 0) & (p[left] < 1)]
    return p


def _round(level: int, seed: int):
    def of(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "order", "id", "p"], ascending=[False, True, True, True], kind="stable", ignore_index=True)
        rng = np.random.default_rng([seed, level, int(pdf["group"].iloc[0]), *str(pdf["source"].iloc[0]).encode()])
        pdf["p"] = pivot(pdf["p"].to_numpy(), pdf["size"].to_numpy(float), rng)
        return pdf

    return of


def mix_sources(units: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple = WEIGHTS, seed: int = 11) -> DataFrame:
    """units(id, source, size) -> (id, source, size, source_size, target, copies): one row per unit.

    Copies are within one of target / source_size, so a unit never exceeds `most` copies. A
    source's words end within the smallest unit of a bucket of its target; where one unit is
    larger than its bucket's others can balance, within half of that unit. Order, file layout and reruns
    don't change the result: buckets and random numbers follow from ids and sizes, and equal
    units, null ids included, are counted and then numbered, so they spread over buckets too.
    A null source is a source of its own and comes last; a unit of size 0 is never taken; an
    empty table gives an empty result.
    """
    units = written(units.groupBy("id", "source", "size").agg(F.count("*").alias("n")), "units")
    targets = source_targets(units, share, most, weights)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rate = F.when(F.abs(rate - F.round(rate)) < 1e-9, F.round(rate)).otherwise(rate)
    each = units.withColumn("step", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {REPEATS}"))))
    rows, equal = targets.agg(F.max("rows"), F.max("most_equal")).first()
    if (equal or 0) > REPEATS:
        each = each.repartition("id", "source", "size", "step")
    each = each.withColumn("number", F.explode(F.sequence(F.col("step") * REPEATS, F.least(F.col("n"), (F.col("step") + 1) * REPEATS) - 1)))
    each = each.withColumnRenamed("source", "src").join(targets, F.col("src").eqNullSafe(F.col("source"))).drop("src").withColumn("rate", rate)
    each = each.withColumn("whole", F.floor("rate")).withColumn("p", F.when(F.col("size") > 0, F.col("rate") - F.col("whole")).otherwise(F.lit(0.0)))
    each = each.withColumn("whole", F.when(F.col("size") > 0, F.col("whole")).otherwise(F.lit(0))).withColumn("order", F.xxhash64(F.col("id"), F.col("size"), F.col("number"), F.lit(seed)))
    # Buckets of one size for all sources, so a large source has many.
    each = each.withColumn("group", F.expr(f"pmod(order, cast(ceil(rows / {BUCKET_ROWS}) as bigint))"))
    schema = "id long, source string, size long, source_size long, target double, whole long, p double, order long, group long"
    each = each.select("id", "source", "size", "source_size", "target", "whole", "p", "order", "group")
    groups = max(1, -(-(rows or 1) // BUCKET_ROWS))
    now, done, level = written(each.groupBy("source", "group").applyInPandas(_round(0, seed), schema), "rounded"), [], 0
    while groups > 1:
        done.append(now.where("p in (0, 1)"))
        groups, level = -(-groups // FAN), level + 1
        rest = now.where("p not in (0, 1)").withColumn("group", F.expr(f"group div {FAN}"))
        now = written(rest.groupBy("source", "group").applyInPandas(_round(level, seed), schema), "rounded")
    done.append(now)
    every = done[0]
    for more in done[1:]:
        every = every.unionByName(more)
    # The last fraction of a source goes where its words come nearest to the target.
    last = F.col("p") >= 0.5
    copies = F.col("whole") + F.when(F.col("p").isin(0.0, 1.0), F.col("p")).otherwise(last.cast("double")).cast("long")
    return every.select("id", "source", "size", "source_size", "target", copies.alias("copies"))
