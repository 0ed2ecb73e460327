"""Popular topics of conversations, and other orders over text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .durable import cut, written


def terms(messages: DataFrame) -> DataFrame:
    """messages(conv_id, text) -> distinct (conv_id, term): words and word pairs of one message. Pairs are neighbours before stop words go, and go if one of them is a stop word."""
    stop = F.array(*map(F.lit, T.STOP_WORDS))
    words = messages.select("conv_id", T.topic_tokens(F.col("text")).alias("w"))
    single = F.filter("w", lambda w: ~F.array_contains(stop, w))
    pairs = F.filter(T.bigrams(F.col("w")), lambda p: ~F.arrays_overlap(F.split(p, " "), stop))
    return words.select("conv_id", F.explode(F.array_distinct(F.concat(single, pairs))).alias("term")).distinct()


def candidates(posting: DataFrame) -> DataFrame:
    """(term, n): terms of two conversations or more."""
    return posting.groupBy("term").agg(F.count("*").alias("n")).where("n >= 2")


def popular(messages: DataFrame, most: int = 15) -> DataFrame:
    """(place, term, n): up to `most` topics, pairs first, then by conversations, then by term; a topic needs two conversations that no topic before it has.

    Postings stay distributed and are written once: each round is a count without the chosen
    terms' conversations and a top-1. Rounds don't exceed `most`.
    """
    posting = terms(messages)
    posting = written(posting.join(candidates(posting), "term"), "postings")
    chosen: list[tuple[int, str, int]] = []
    while len(chosen) < most:
        taken = posting.where(F.col("term").isin([t for _, t, _ in chosen])).select("conv_id").distinct()
        free = posting.join(taken, "conv_id", "left_anti") if chosen else posting
        live = free.groupBy("term", "n").agg(F.count("*").alias("left")).where(F.col("left") >= 2)
        # A term that was passed over before has lost conversations since, never gained some.
        best = live.orderBy((F.instr("term", " ") > 0).desc(), F.desc("n"), "term").select("term", "n").first()
        if best is None:
            break
        chosen.append((len(chosen) + 1, best["term"], best["n"]))
    return messages.sparkSession.createDataFrame(chosen, "place long, term string, n long")


def topic_conversations(topics: DataFrame, messages: DataFrame) -> DataFrame:
    """(place, term, conv_id): every conversation of each topic, those that another topic has too. Topics are few (see popular), so they are sent to the postings, which stay where they are."""
    return terms(messages).join(F.broadcast(topics.select("place", "term")), "term").select("place", "term", "conv_id")


def topic_overview(members: DataFrame, conversations: DataFrame) -> DataFrame:
    """members(place, term, conv_id), conversations(conv_id, user_id, messages) -> (place, term, conversations, unique_users, total_messages); a conversation that isn't known counts, without user or messages."""
    known = members.join(conversations.select("conv_id", "user_id", "messages"), "conv_id", "left")
    # By user first, so that a topic of very many users isn't made distinct in one task.
    users = known.groupBy("place", "term", "user_id").agg(F.count("*").alias("n"), F.sum("messages").alias("m"))
    return users.groupBy("place", "term").agg(F.sum("n").alias("conversations"), F.count("user_id").alias("unique_users"), F.coalesce(F.sum("m"), F.lit(0)).alias("total_messages"))


def kept_prefix(items: DataFrame, key: str, order: str, size: Column, budget: int = 8192, slack: int = 80) -> DataFrame:
    """(key, kept, omitted): how many leading items fit when written as a JSON array; all of them if the whole fits without slack."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    each = items.select(key, F.row_number().over(Window.partitionBy(key).orderBy(order)).alias("i"), F.sum(size).over(w).alias("bytes"))
    each = each.withColumn("length", F.col("bytes") + F.col("i") + 1)
    got = each.groupBy(key).agg(F.count("*").alias("n"), F.max("length").alias("whole"), F.count_if(F.col("length") + slack <= budget).alias("fit"))
    kept = F.when(F.col("whole") <= budget, F.col("n")).otherwise(F.col("fit"))
    return got.select(key, kept.alias("kept"), (F.col("n") - kept).alias("omitted"))


def pseudonyms(names: DataFrame, first: tuple, second: tuple, salt: str, plain: int = 3) -> DataFrame:
    """names(name) -> (name, alias): two words from a salted hash. Where names clash the first in order keeps the alias and the others draw again; after `plain` draws hex digits follow the words.

    A round is a grouped minimum and an anti-join; each round leaves only names that clashed.
    """
    word = lambda words, h, at: F.element_at(F.array(*map(F.lit, words)), (F.pmod(F.conv(F.substring(h, at, 8), 16, 10).cast("long"), F.lit(len(words))) + 1).cast("int"))
    left, done, n = names.select("name").distinct(), None, 0
    while True:
        h = F.sha2(F.concat(F.lit(f"{salt}\0"), F.col("name"), F.lit(f"\0{n}")), 256)
        alias = F.concat_ws("-", word(first, h, 1), word(second, h, 9), *([F.substring(h, 17, 8)] if n >= plain else []))
        drawn = left.withColumn("alias", alias)
        if done is not None:
            drawn = drawn.join(done.select("alias").withColumn("taken", F.lit(True)), "alias", "left")
        else:
            drawn = drawn.withColumn("taken", F.lit(None).cast("boolean"))
        won = drawn.where("taken is null").groupBy("alias").agg(F.min("name").alias("name")).select("name", "alias")
        done = cut(won if done is None else done.unionByName(won))
        left = cut(left.join(done, "name", "left_anti"))
        n += 1
        if not left.limit(1).count():
            return done
