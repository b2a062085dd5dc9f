"""Conversation sessions: which are idle, their first messages, language, importance and grounding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom.functions.gates import boost_of, grounding, importance, normalize_whitespace, words
from memloom.functions.text import ARABIC
from memloom.shared import first_rows

IDLE_MINUTES, MOST_MESSAGES = 30, 100


def idle_sessions(sessions: DataFrame, messages: DataFrame, done: DataFrame, as_of: Column, least: int = 2, minutes: int = IDLE_MINUTES, most: int | None = 5) -> DataFrame:
    """Sessions that rest, are long enough, no cron jobs and not yet summarised; the newest ``most`` of them."""
    recent = messages.filter(F.col("timestamp") > as_of - F.expr(f"INTERVAL {minutes} MINUTES")).select(F.col("session_id").alias("id"))
    rows = sessions.filter((F.col("message_count") >= least) & ~F.col("id").startswith("cron_"))
    rows = rows.join(recent, "id", "left_anti").join(done.select(F.col("session_id").alias("id")), "id", "left_anti")
    return rows.orderBy(F.desc("started_at"), "id").limit(most) if most else rows


def head(messages: DataFrame, most: int = MOST_MESSAGES, by: str = "session_id", order: str = "id") -> DataFrame:
    """The first ``most`` messages of every session."""
    return first_rows(messages, [F.col(by)], [F.col(order)], most)


def _ratio(text: Column) -> Column:
    arabic = F.sum(F.length(F.regexp_replace(text, f"[^{ARABIC}]", "")))
    solid = F.sum(F.length(F.regexp_replace(text, r"(?U)\s", "")))
    return F.when(solid > 0, arabic / solid).otherwise(F.lit(0.0))


def user_ratio(messages: DataFrame, by: str = "session_id") -> DataFrame:
    """``session, ratio`` of Arabic characters over all user text."""
    return messages.filter("role = 'user'").groupBy(by).agg(_ratio(F.coalesce("content", F.lit(""))).alias("ratio"))


def opening_ratio(messages: DataFrame, most: int = 10, chars: int = 200, by: str = "session_id", order: str = "id") -> DataFrame:
    """``session, ratio`` over the beginnings of the first messages, whoever wrote them."""
    return head(messages, most, by, order).groupBy(by).agg(_ratio(F.substring(F.coalesce("content", F.lit("")), 1, chars)).alias("ratio"))


def session_importance(messages: DataFrame, model: Column, has_facts: Column, by: str = "session_id") -> DataFrame:
    """``session, importance`` from keywords, thanks and length, without gathering a session's text in one row."""
    text = F.lower(F.coalesce("content", F.lit("")))
    has = lambda w: F.max(F.contains(text, F.lit(w)))
    flags = messages.groupBy(by).agg(
        F.max(boost_of(text)).alias("_b"), F.sum(F.size(words(text))).alias("_w"), model.alias("_m"), has_facts.alias("_f"),
        *(has(w).alias(f"_{w}") for w in ("ok", "thanks", "done", "thank")),
    )
    thanks = (F.col("_ok") & F.col("_thanks")) | (F.col("_done") & F.col("_thank"))
    return flags.select(by, importance(F.col("_b"), F.col("_w"), thanks, F.col("_f"), F.col("_m")).alias("importance"))


def grounded(facts: DataFrame, messages: DataFrame, fact: str = "key", by: str = "session_id", least: float | None = 0.40) -> DataFrame:
    """Facts with ``grounding`` in their session's words; only those above ``least``, unless it is None.

    A session's distinct words are what is gathered, not its text.
    """
    heard = messages.groupBy(by).agg(F.array_distinct(F.flatten(F.collect_set(F.array_distinct(words(F.lower(normalize_whitespace(F.coalesce("content", F.lit("")))))))))
    .alias("_heard"))
    out = facts.join(heard, by, "left").withColumn("grounding", F.coalesce(grounding(F.col(fact), F.col("_heard")), F.lit(0.0))).drop("_heard")
    return out if least is None else out.filter(F.col("grounding") >= least)
