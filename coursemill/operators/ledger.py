"""Token ledger and exact costs. Money is decimal from the rates to the last cast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MICRO = "cast(0.000001 as decimal(7,6))"


def add_usage(*ledgers: DataFrame) -> DataFrame:
    """Additive upsert: one row per (user, course, day, model) with the tokens and requests of all ledgers."""
    every = ledgers[0]
    for more in ledgers[1:]:
        every = every.unionByName(more)
    return every.groupBy("user_id", "course_id", "day", "model").agg(F.sum("prompt").alias("prompt"), F.sum("completion").alias("completion"), F.sum("requests").alias("requests"))


def micro_usd(prompt: Column, completion: Column) -> Column:
    """Tokens at the rates of the row; an unknown rate counts as 0."""
    rate = lambda c: F.coalesce(F.col(c), F.lit(0).cast("decimal(12,6)"))
    return prompt * rate("rate_in") + completion * rate("rate_out")


def cost(prompt: Column, completion: Column) -> Column:
    return F.sum(micro_usd(prompt, completion))


def usd(micro: Column) -> Column:
    return (F.coalesce(micro, F.lit(0)).cast("decimal(26,6)") * F.expr(MICRO)).cast("double")


def cost_by(usage: DataFrame, prices: DataFrame, *keys: str) -> DataFrame:
    """(keys, cost): usage is summed by key and model before the price is joined, so the join is as small as its keys."""
    tokens = usage.groupBy(*keys, "model").agg(F.sum("prompt").alias("p"), F.sum("completion").alias("c"))
    return tokens.join(prices, "model", "left").groupBy(*keys).agg(usd(cost(F.col("p"), F.col("c"))).alias("cost"))


def with_zero(dim: DataFrame, facts: DataFrame, key: str, *measures: str) -> DataFrame:
    """Every key of dim, measures 0 where there are no facts."""
    return dim.join(facts, key, "left").select(key, *[F.coalesce(m, F.lit(0)).alias(m) for m in measures])


def over_limit(used: DataFrame, limits: DataFrame, key: str) -> DataFrame:
    """Quota gate: keys whose limit is over 0 and reached."""
    return limits.join(used, key, "left").select(key, "limit", F.coalesce("used", F.lit(0)).alias("used"), ((F.col("limit") > 0) & (F.coalesce("used", F.lit(0)) >= F.col("limit"))).alias("refused"))
