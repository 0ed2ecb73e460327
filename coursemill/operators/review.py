"""Conversations: turns, flags, feedback and what still needs a teacher's eye."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered_turns(messages: DataFrame) -> DataFrame:
    """user_turn: user messages up to and including the row, so an answer has its question's number."""
    so_far = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return messages.withColumn("user_turn", F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(so_far).cast("long"))


def answers_on_flagged_turns(messages: DataFrame, flags: DataFrame) -> DataFrame:
    """Assistant messages on a turn that has a flag."""
    turns = flags.select("conv_id", F.col("turn").alias("user_turn")).distinct()
    return numbered_turns(messages).where("role = 'assistant'").join(turns, ["conv_id", "user_turn"], "left_semi")


def last_per_conversation(messages: DataFrame, role: str, n: int) -> DataFrame:
    """The last n messages of a role, `back` 1 for the last."""
    back = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return messages.where(F.col("role") == role).withColumn("back", F.row_number().over(back).cast("long")).where(F.col("back") <= n)


def unaddressed(feedback: DataFrame, notes: DataFrame) -> DataFrame:
    """Down-votes that are neither acknowledged nor have a note on their message."""
    on_message = notes.where("message_id is not null").select("message_id").distinct()
    return feedback.where("rating = 'down' and not acknowledged").join(on_message, "message_id", "left_anti")


def dashboard(messages: DataFrame, feedback: DataFrame, notes: DataFrame, flags: DataFrame, reviews: DataFrame) -> DataFrame:
    """One row per conversation: counts, unaddressed down-votes, flags, and whether it has moved on since its review.

    Each child table is aggregated by conversation on its own, then joined once.
    """
    user = F.col("role") == "user"
    base = messages.groupBy("conv_id", "user_id", "course_id").agg(F.count("*").alias("messages"), F.max(F.when(user, F.col("turn"))).alias("last_user_turn"))
    votes = feedback.groupBy("conv_id").agg(F.count_if(F.col("rating") == "up").alias("up"), F.count_if(F.col("rating") == "down").alias("down"))
    open_ = unaddressed(feedback, notes).groupBy("conv_id").agg(F.count("*").alias("unaddressed_down"))
    marks = flags.where("not acknowledged").groupBy("conv_id").agg(F.array_join(F.array_sort(F.collect_set("flag")), ",").alias("flags"))
    out = base.join(votes, "conv_id", "left").join(open_, "conv_id", "left").join(marks, "conv_id", "left").join(reviews, "conv_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    unreviewed = F.coalesce(F.col("last_user_turn") > F.col("reviewed"), F.col("reviewed").isNull() & F.col("last_user_turn").isNotNull())
    return out.select("conv_id", "user_id", "course_id", "messages", "last_user_turn", zero("up"), zero("down"), zero("unaddressed_down"), F.coalesce("flags", F.lit("")).alias("flags"), unreviewed.alias("unreviewed"))


def first_by(df: DataFrame, keys: list, order: list) -> DataFrame:
    """The first row of each key in the order, which must break ties."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def top_by(df: DataFrame, keys: list, order: list, n: int, rank: str = "rank") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w).cast("long")).where(F.col(rank) <= n)


def page_after(df: DataFrame, keys: list, after: tuple, n: int) -> DataFrame:
    """Keyset paging: the n rows after the cursor in the order of the keys."""
    beyond: Column = F.lit(False)
    for i in range(len(keys) - 1, -1, -1):
        beyond = (F.col(keys[i]) > F.lit(after[i])) | ((F.col(keys[i]) == F.lit(after[i])) & beyond)
    # The first key alone is a predicate that a scan can push down.
    return df.where(F.col(keys[0]) >= F.lit(after[0])).where(beyond).orderBy(*keys).limit(n)
