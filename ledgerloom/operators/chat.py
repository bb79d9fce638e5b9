"""A batch of chat turns: context, reply held to the facts, and what is kept of each turn."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import dollars, short_number
from ..functions.text import strip
from ..lineage import cut
from . import advice as A
from . import claims as C
from . import finance as N
from . import memory as M

#: Adds ``reply`` to rows with message, history, system_prompt and feedback.
Author = Callable[[DataFrame, int], DataFrame]


def echo_author(rows: DataFrame, attempt: int) -> DataFrame:
    """A stand-in for a model: always the same advice."""
    return rows.withColumn("reply", F.lit("Build a budget first, then keep an emergency reserve and review it every month."))


def prompt_messages(message: Column, history: Column, system_prompt: Column) -> Column:
    """The messages for a model: the system prompt if any, past dialogue, the new message."""
    of = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    past = F.filter(history, lambda m: m["role"].isin("user", "assistant"))
    first = F.when(F.coalesce(system_prompt, F.lit("")) != "", F.array(of("system", system_prompt))).otherwise(F.slice(F.array(of("system", F.lit(""))), 1, 0))
    return F.concat(first, past, F.array(of("user", message)))


def finished(reply: Column) -> Column:
    """A model's reply without role marks and with at most one blank line in a row."""
    for mark in A.ROLE_MARKS:
        reply = F.replace(reply, F.lit(mark), F.lit(""))
    return F.regexp_replace(strip(reply), r"\n{3,}", "\n\n")


def facts_text(facts: str = "facts") -> Column:
    """The stated facts as bullet lines, null without any."""
    f = lambda name: F.col(f"{facts}.{name}")
    line = lambda label, value: F.concat(F.lit(f"- {label}: "), dollars(value))
    each = lambda rows: F.when(F.size(rows) > 0, F.array_join(rows, "\n"))
    text = F.array_join(F.array_compact(F.array(
        line("Income", f("income")), each(F.transform(f("expenses"), lambda e: F.concat(F.lit("- "), e["category"], F.lit(": "), dollars(e["amount"])))),
        F.when(F.size(f("expenses")) > 0, line("Total monthly expenses", N.total_expenses(facts))), line("Savings", f("savings_balance")),
        F.when(F.size(f("savings_contributions")) > 0, line("Monthly savings contributions", N.total(f("savings_contributions")))),
        each(F.transform(f("debts"), lambda d: F.concat(F.lit("- "), d["description"], F.lit(": "), dollars(d["amount"]), F.coalesce(F.concat(F.lit(" ("), short_number(d["apr"]), F.lit("% APR)")), F.lit(""))))),
        F.when(F.size(f("debt_payments")) > 0, line("Monthly debt payments", N.total(f("debt_payments")))), line("Monthly surplus", N.surplus(facts)))), "\n")
    return F.when(text != "", text)


def brief(message: Column, history: Column, known: Column) -> Column:
    """What the author is told of the conversation so far; null for a first message.

    A follow-up gets the previous answer, to correct if need be; other messages are to stay
    on topic. Facts stated earlier go along.
    """
    before = F.filter(history, lambda m: m["role"] == "assistant")
    previous = F.try_element_at(before, F.lit(-1))["content"]
    previous = F.when(strip(F.coalesce(previous, F.lit(""))) != "", strip(previous))
    follow = C.is_follow_up(message) & previous.isNotNull()
    head = F.when(follow, F.concat(F.lit("This message follows up on your last answer. Stay with it, and correct any figure in it that has no support. Your last answer was:\n"), previous)).otherwise(
        F.lit("Stay on the topic of the conversation unless the message opens a new one."))
    facts = F.when(known.isNotNull(), F.concat(F.lit("Facts the user stated earlier:\n"), known))
    return F.when((F.coalesce(F.size(history), F.lit(0)) > 0) | known.isNotNull(), F.concat_ws("\n\n", head, facts))


@dataclass
class ChatTurns:
    """What a batch of turns leaves: replies, new turns, advice items and memories."""

    replies: DataFrame
    turns: DataFrame
    advice: DataFrame
    memories: DataFrame


def run_chat(requests: DataFrame, turns: DataFrame, memories: DataFrame, author: Author = echo_author, system_prompt: str = "", history: int = M.HISTORY) -> ChatTurns:
    """One new message for each conversation, all at once.

    requests: (conv_id, user_id, message), one for each conversation. turns: (conv_id, turn, role,
    text) so far. memories: (user_id, memory_id, content, category, created_at). The author
    writes, figures are held to what was said, and at most three attempts are made.
    """
    past = turns.join(requests.select("conv_id"), "conv_id", "left_semi")
    ordered = F.sort_array(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    packed = past.groupBy("conv_id").agg(
        F.transform(ordered, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("history"), F.max("turn").alias("last_turn"))
    said = past.where("role = 'user'").select("conv_id", "turn", "text")
    now = requests.select("conv_id", F.lit(1 << 60).alias("turn"), F.col("message").alias("text"))
    earlier = N.merge_facts(N.with_facts(said), "conv_id", "turn").select("conv_id", facts_text().alias("known"))
    every = N.merge_facts(N.with_facts(said.union(now)), "conv_id", "turn")
    ask = requests.select(F.col("conv_id").alias("query_id"), "user_id", F.col("message").alias("text"))
    found = M.contexts(ask, memories).withColumnRenamed("query_id", "conv_id").withColumnRenamed("context", "remembered")
    rows = requests.join(packed, "conv_id", "left").join(earlier, "conv_id", "left").join(every, "conv_id", "left").join(found, "conv_id", "left")
    empty = F.array().cast("array<struct<role:string,content:string>>")
    rows = rows.withColumn("history", F.coalesce("history", empty))
    rows = C.with_grounding(N.with_plan(rows)).withColumn("window", F.when(F.size("history") > history, F.slice("history", -history, history)).otherwise(F.col("history")))
    rows = rows.withColumn("system_prompt", F.concat_ws("\n\n", F.lit(system_prompt or None), "remembered", N.context_text(), brief(F.col("message"), F.col("window"), F.col("known"))))
    rows = rows.withColumn("context", F.concat_ws("\n", "message", F.array_join(F.transform("window", lambda m: m["content"]), "\n"), "remembered"))
    of_message = N.with_facts(requests.select("conv_id", F.col("message").alias("text"))).select("conv_id", N.verified_block().alias("block"))
    # Read by every attempt: computed once.
    rows = cut(rows.join(of_message, "conv_id"))

    def corrected(r: DataFrame, attempt: int) -> DataFrame:
        return author(r, attempt).withColumn("reply", N.corrected(finished(F.col("reply")), F.col("message"), F.col("block")))

    done = cut(C.refine(rows, "conv_id", corrected))
    replies = requests.join(done, "conv_id")
    last = packed.select("conv_id", "last_turn")
    new = replies.join(last, "conv_id", "left").withColumn("at", F.coalesce("last_turn", F.lit(-1)))
    written = new.select("conv_id", F.explode(F.array(
        F.struct((F.col("at") + 1).alias("turn"), F.lit("user").alias("role"), F.col("message").alias("text")),
        F.struct((F.col("at") + 2).alias("turn"), F.lit("assistant").alias("role"), F.col("reply").alias("text")))).alias("t")).select("conv_id", "t.*")
    items = A.structured(replies.where((F.col("attempt") > 0) & A.is_advice(F.col("reply"))), "reply", "message").select(
        "conv_id", "category", "short_title", "key_recommendation", "full_text", F.col("message").alias("source_question"))
    kept = M.candidates(requests.select("conv_id", "user_id", F.col("message").alias("text"))).select("user_id", "conv_id", "place", "content", "category", "importance")
    return ChatTurns(replies, written, items, kept)
