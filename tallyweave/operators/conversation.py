"""Conversation history: last messages, token budgets, prompts, facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.functions.text import strip

BLOCK = 1000


def last_messages(messages: DataFrame, count: int, order: str = "turn") -> DataFrame:
    """The newest `count` messages of each session with their position, oldest first.

    The rank limit is applied before the shuffle, so a huge session only sends
    `count` rows per input partition.
    """
    newest_first = Window.partitionBy("session_id").orderBy(F.col(order).desc())
    return (
        messages.withColumn("_newest", F.row_number().over(newest_first))
        .filter(F.col("_newest") <= count)
        .withColumn(
            "position",
            F.row_number().over(Window.partitionBy("session_id").orderBy(order)),
        )
        .drop("_newest")
    )


def context_messages(messages: DataFrame, max_tokens: int = 4000) -> DataFrame:
    """The newest messages of each session that fit into a token budget.

    Token counts are never negative, so the running total only grows and the
    messages that fit are those up to the first overflow. Totals are built per
    block of turns first: no task sorts a whole session, and blocks behind the
    overflow never reach the second step.
    """
    blocked = messages.withColumn("_block", F.floor(F.col("turn") / BLOCK))
    newer = (
        Window.partitionBy("session_id")
        .orderBy(F.col("_block").desc())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = (
        blocked.groupBy("session_id", "_block")
        .agg(F.sum("token_count").alias("_tokens"))
        .withColumn("_before", F.coalesce(F.sum("_tokens").over(newer), F.lit(0)))
        .filter(F.col("_before") <= max_tokens)
        .drop("_tokens")
    )
    inside = (
        Window.partitionBy("session_id", "_block")
        .orderBy(F.col("turn").desc())
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        blocked.join(offsets, ["session_id", "_block"])
        .withColumn("tokens_used", F.col("_before") + F.sum("token_count").over(inside))
        .filter(F.col("tokens_used") <= max_tokens)
        .drop("_block", "_before")
    )


def chat_prompts(
    messages: DataFrame, contexts: DataFrame | None = None, history: int = 10, shown: int = 6
) -> DataFrame:
    """One prompt per session: context block, the recent history, the newest message."""
    recent = last_messages(messages, history + 1)
    newest = Window.partitionBy("session_id").orderBy(F.col("turn").desc())
    ranked = recent.withColumn("_back", F.row_number().over(newest) - 1)
    speaker = F.when(F.col("role") == "user", "User").otherwise("Assistant")
    line = F.concat(speaker, F.lit(": "), "content", F.lit("\n"))
    nested = ranked.groupBy("session_id").agg(
        F.max(F.when(F.col("_back") == 0, F.col("content"))).alias("_message"),
        F.sort_array(
            F.collect_list(
                F.when(F.col("_back").between(1, shown), F.struct("turn", line.alias("line")))
            )
        ).alias("_past"),
    )
    past = F.array_join(F.col("_past.line"), "")
    history_part = F.when(
        F.size("_past") > 0, F.concat(F.lit("Previous conversation:\n"), past, F.lit("\n"))
    ).otherwise("")
    if contexts is None:
        joined, context_part = nested, F.lit("")
    else:
        joined = nested.join(contexts.select("session_id", "context"), "session_id", "left")
        context_part = F.when(
            F.coalesce("context", F.lit("")) != "",
            F.concat(
                F.lit("Use the following context to help answer the question:\n\n"),
                "context",
                F.lit("\n\n---\n"),
            ),
        ).otherwise("")
    prompt = F.concat(
        context_part, history_part, F.lit("User: "), "_message", F.lit("\n\nAssistant:")
    )
    return joined.select("session_id", prompt.alias("prompt"))


def summary_inputs(messages: DataFrame, count: int = 50, each: int = 200, total: int = 2000) -> DataFrame:
    """Text to summarise per session: the last messages, cut to size."""
    line = F.concat("role", F.lit(": "), F.substring("content", 1, each))
    nested = (
        last_messages(messages, count)
        .groupBy("session_id")
        .agg(F.sort_array(F.collect_list(F.struct("turn", line.alias("line")))).alias("_lines"))
    )
    text = F.array_join(F.col("_lines.line"), "\n")
    return nested.select("session_id", F.substring(text, 1, total).alias("summary_input"))


def session_activity(messages: DataFrame) -> DataFrame:
    return messages.groupBy("session_id").agg(F.max("created_at").alias("last_message_at"))


def needs_summary(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """More than 20 messages, more than 10 of them not summarised yet."""
    counts = messages.groupBy("session_id").agg(F.count(F.lit(1)).alias("message_count"))
    n = F.coalesce("message_count", F.lit(0))
    return sessions.join(counts, "session_id", "left").select(
        "session_id",
        n.alias("message_count"),
        ((n > 20) & (n - F.col("summary_message_count") > 10)).alias("needs_summary"),
    )


def fact_key(value: Column, prefix: str = "extracted_") -> Column:
    """Stable key of a fact text."""
    return F.concat(F.lit(prefix), F.sha2(value, 256))


def extract_facts(responses: DataFrame, text_col: str = "response") -> DataFrame:
    """Facts from the "- " lines of a reply; a reply that says NONE has none."""
    lines = responses.filter(~F.contains(F.upper(text_col), F.lit("NONE"))).select(
        "session_id", F.explode(F.split(text_col, "\n")).alias("_line")
    )
    line = strip(F.col("_line"))
    value = strip(F.substring(line, 3, 2_000_000_000))
    return (
        lines.filter(line.startswith("- "))
        .select("session_id", F.lit("entity").alias("fact_type"), value.alias("value"))
        .filter(F.length("value") > 5)
        .withColumn("key", fact_key(F.col("value")))
    )


def upsert_facts(facts: DataFrame, order: Column) -> DataFrame:
    """Latest value per (session, key); every rewrite counts as one access."""
    return facts.groupBy("session_id", "key").agg(
        F.max_by("value", order).alias("value"),
        F.max("updated_at").alias("updated_at"),
        (F.count(F.lit(1)) - 1).alias("access_count"),
    )


def session_facts(facts: DataFrame, session_id=None, fact_type: str | None = None) -> DataFrame:
    if session_id is not None:
        facts = facts.filter(F.col("session_id") == F.lit(session_id))
    if fact_type is not None:
        facts = facts.filter(F.col("fact_type") == fact_type)
    return facts.orderBy(F.col("updated_at").desc(), "session_id", "key")
