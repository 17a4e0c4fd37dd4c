"""Conversation cleaning: noise out, consecutive turns of a role merged, secrets masked, sizes bounded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkquill.functions.text import clip, is_tool_noise, redact

# Fixed values of the capture contract.
MESSAGE_CHARS, SESSION_CHARS, LEAST_HUMAN = 3000, 256_000, 3
CUT_MARK = "\n[…]"


def merged(turns: DataFrame, keep: Column) -> DataFrame:
    """session, island, role, first, n, text: runs of one role after the rows that keep excludes are gone."""
    rows = turns.where(F.col("role").isin("user", "assistant") & keep)
    by_turn = Window.partitionBy("session").orderBy("turn")
    change = F.coalesce((F.lag("role").over(by_turn) != F.col("role")).cast("int"), F.lit(1))
    marked = rows.withColumn("change", change).withColumn("island", F.sum("change").over(by_turn.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return marked.groupBy("session", "island", "role").agg(F.min("turn").alias("first"), F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n\n").alias("text"))


def substantial(turns: DataFrame, least: int = LEAST_HUMAN) -> DataFrame:
    """Sessions with enough human messages."""
    return turns.groupBy("session").agg(F.count_if(F.col("role") == "user").alias("human"), F.count("*").alias("messages")).where(F.col("human") >= least)


def truncated(turns: DataFrame, message_chars: int = MESSAGE_CHARS, session_chars: int = SESSION_CHARS) -> DataFrame:
    """Messages clipped, and each session up to and with the message that passes its limit."""
    clipped = turns.withColumn("text", clip(F.col("text"), message_chars, CUT_MARK))
    before = Window.partitionBy("session").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return clipped.withColumn("before", F.coalesce(F.sum(F.length("text")).over(before), F.lit(0))).where(F.col("before") <= session_chars).drop("before")


def new_sessions(turns: DataFrame, captured: DataFrame) -> DataFrame:
    """Sessions whose first eight characters no captured file has."""
    return turns.withColumn("id8", F.substring("session", 1, 8)).join(captured.select("id8").distinct(), "id8", "left_anti")


def captured(turns: DataFrame, existing: DataFrame) -> DataFrame:
    """session, name, human, text of the sessions that no captured file has: meta rows and tool noise out, secrets masked,
    messages clipped, too short sessions left out, turns of one role merged, sizes bounded. turns: session, turn, role, is_meta, text.
    """
    said = turns.where(F.col("role").isin("user", "assistant") & ~F.coalesce("is_meta", F.lit(False)) & ~is_tool_noise(F.col("text")) & (F.trim(F.coalesce("text", F.lit(""))) != ""))
    fresh = new_sessions(said, existing)
    enough = substantial(fresh).select("session", "human")
    cut = truncated(fresh.withColumn("text", redact(F.col("text"))).join(enough.select("session"), "session", "left_semi"))
    parts = merged(cut, F.lit(True)).select("session", F.struct("first", F.concat(F.lit("**"), "role", F.lit("**\n\n"), "text").alias("text")).alias("part"))
    whole = parts.groupBy("session").agg(F.array_join(F.transform(F.array_sort(F.collect_list("part")), lambda p: p["text"]), "\n\n").alias("text"))
    return whole.join(enough, "session").select("session", F.concat(F.lit("session-"), F.substring("session", 1, 8), F.lit(".md")).alias("name"), "human", "text")
