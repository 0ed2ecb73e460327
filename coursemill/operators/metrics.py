"""Series of samples: rates of counters, quantiles of histograms, label matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def increases(samples: DataFrame, series: list, at: str = "ts", value: str = "value") -> DataFrame:
    """`inc`: growth since the series' sample before; a counter that fell has started anew from 0, a first sample tells nothing."""
    before = F.lag(value).over(Window.partitionBy(*series).orderBy(at))
    v = F.col(value)
    return samples.withColumn("_b", before).withColumn("inc", F.when(F.col("_b").isNull(), F.lit(0)).when(v < F.col("_b"), v).otherwise(v - F.col("_b"))).drop("_b")


def rate_by(samples: DataFrame, series: list, by: list, minutes: int, at: str = "ts", value: str = "value") -> DataFrame:
    """(bucket, by, increase, rate): growth by window of time, and a second's share of it; edges aren't extrapolated (see range_increase)."""
    inc = increases(samples, series, at, value).groupBy(F.window(at, f"{minutes} minutes").alias("w"), *by).agg(F.sum("inc").alias("increase"))
    return inc.select(F.col("w.start").alias("bucket"), *by, "increase", (F.col("increase") / (60.0 * minutes)).alias("rate"))


def range_increase(samples: DataFrame, series: list, seconds: int, step: int, at: str = "ts", value: str = "value") -> DataFrame:
    """(series, time, increase, rate) at every multiple of `step` seconds: growth of a counter over the `seconds` before it, extrapolated to the edges.

    A window holds the samples after its start and up to its end, and needs two of them. A
    value under the one before is a restart from 0. Growth is carried on to an edge that is
    nearer than 1.1 mean gaps, else half a gap towards it, and at the start no further than
    to where the counter would be 0. Samples without a time or a number don't count; of
    those at one time of a series the largest does.

    Samples are dealt to the windows that hold them and summed there. The sample before is
    looked for in slices of the window's length, each with the last sample of the slice
    before it, so no series has to be in one task.
    """
    size, every = seconds * 1_000_000, step * 1_000_000
    keys = [f"_k{i}" for i in range(len(series))]
    rows = samples.select(*[F.col(c).alias(k) for c, k in zip(series, keys, strict=True)], F.unix_micros(F.col(at).cast("timestamp")).alias("_at"), F.col(value).cast("double").alias("_v"))
    rows = rows.where("_at is not null and _v is not null and not isnan(_v)").groupBy(*keys, "_at").agg(F.max("_v").alias("_v"))
    rows = rows.withColumns({"_slice": F.floor(F.col("_at") / size), "_own": F.lit(True)})
    last = rows.groupBy(*keys, "_slice").agg(F.max(F.struct("_at", "_v")).alias("s"))
    last = last.select(*keys, F.col("s._at").alias("_at"), F.col("s._v").alias("_v"), (F.col("_slice") + 1).alias("_slice"), F.lit(False).alias("_own"))
    w = Window.partitionBy(*keys, "_slice").orderBy("_at")
    rows = rows.unionByName(last).withColumns({"_before": F.lag("_v").over(w), "_before_at": F.lag("_at").over(w)}).where("_own")
    first, end = F.ceil(F.col("_at") / every) * every, F.floor((F.col("_at") + size - 1) / every) * every
    dealt = rows.where(first <= end).withColumn("_end", F.explode(F.sequence(first, end, F.lit(every))))
    restart = F.when((F.col("_before") > F.col("_v")) & (F.col("_before_at") > F.col("_end") - size), F.col("_before")).otherwise(0.0)
    g = dealt.groupBy(*keys, "_end").agg(F.count("*").alias("_n"), F.min(F.struct("_at", "_v")).alias("_a"), F.max(F.struct("_at", "_v")).alias("_z"), F.sum(restart).alias("_r")).where("_n > 1")
    a, z = F.col("_a._at"), F.col("_z._at")
    inc, span = F.col("_z._v") - F.col("_a._v") + F.col("_r"), (z - a).cast("double")
    g = g.withColumns({"_inc": inc, "_span": span, "_gap": span / (F.col("_n") - 1)})
    left, right = (a - (F.col("_end") - size)).cast("double"), (F.col("_end") - z).cast("double")
    near = lambda x: F.when(x >= F.col("_gap") * 1.1, F.col("_gap") / 2).otherwise(x)
    zero = F.when((F.col("_inc") > 0) & (F.col("_a._v") >= 0), F.col("_span") * (F.col("_a._v") / F.col("_inc")))
    grown = F.col("_inc") * ((F.col("_span") + F.least(near(left), zero) + near(right)) / F.col("_span"))
    out = g.select(*[F.col(k).alias(c) for c, k in zip(series, keys, strict=True)], F.timestamp_micros("_end").alias("time"), grown.alias("increase"))
    return out.withColumn("rate", F.col("increase") / float(seconds))


def ratio(part: Column, whole: Column) -> Column:
    """The whole counts as 1 at least."""
    return part / F.greatest(whole, F.lit(1))


def histogram_quantile(buckets: DataFrame, q: float, by: list) -> DataFrame:
    """buckets(by, le, n), n cumulative and le infinite for all -> (by, quantile): linear within the bucket that the rank falls in; the largest finite bound beyond it; null where nothing was counted."""
    w = Window.partitionBy(*by).orderBy("le")
    b = buckets.withColumn("_low", F.coalesce(F.lag("le").over(w), F.lit(0.0))).withColumn("_before", F.coalesce(F.lag("n").over(w), F.lit(0)))
    b = b.withColumn("_rank", q * F.max("n").over(Window.partitionBy(*by)))
    first = b.where((F.col("n") >= F.col("_rank")) & (F.col("_rank") > 0)).groupBy(*by).agg(F.min(F.struct("le", "_low", "_before", "n", "_rank")).alias("f"))
    f = F.col("f")
    inside = f["_low"] + (f["le"] - f["_low"]) * (f["_rank"] - f["_before"]) / (f["n"] - f["_before"])
    found = first.select(*by, F.when(f["le"] == float("inf"), f["_low"]).otherwise(inside).alias("quantile"))
    return buckets.select(*by).distinct().join(found, by, "left")


def matches(label: Column, pattern: str) -> Column:
    """Label matching takes the whole label; a missing label is empty."""
    return F.coalesce(label, F.lit("")).rlike(f"^(?:{pattern})$")


def line_matches(line: Column, words: tuple) -> Column:
    """A log line with one of the words, in any case."""
    return line.rlike("(?i)(?:" + "|".join(words) + ")")
