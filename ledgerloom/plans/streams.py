"""Registered queries that run streams over the tables, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import cut
from ..operators import finance as N
from ..operators import memory as M
from ..streaming.exchanges import conversation_facts, exchanges, latest_facts
from ..streaming.memories import kept_memories
from ..streaming.runs import new_folder, run_now, stream_of
from . import advice
from .finance import ORACLES as FINANCE
from .inputs import budget_rows, intent_messages


def memory_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates arrive in two parts, the second after the stream has stopped; what the changes leave."""
    rows = M.candidates(intent_messages(spark, sf_dir)).select(
        "user_id", F.col("msg_id").alias("ord"), "content", "category", "importance", F.timestamp_seconds(F.col("msg_id")).alias("ts"))
    feed, at = new_folder(spark, "candidates"), new_folder(spark, "memories")
    rows = cut(rows)
    ends = [float("-inf"), *rows.approxQuantile("ord", [0.5], 0.01), float("inf")]
    for low, high in zip(ends, ends[1:]):
        rows.where((F.col("ord") > low) & (F.col("ord") <= high)).write.mode("append").parquet(feed)
        changes = run_now(kept_memories(spark.readStream.schema(rows.schema).parquet(feed)), at)
    last = lambda c: F.max_by(c, "ord").alias(c)
    return changes.groupBy("user_id", "memory_id").agg(last("content"), last("category"), last("importance"), F.max("ord").alias("updated_ord"))


def facts_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two turns of each customer with a reply each: a budget, then a raise and a new expense."""
    customers = budget_rows(stream_of(spark, sf_dir, "customer"))
    when = lambda s: F.timestamp_seconds(F.lit(1_700_000_000) + F.col("user_id") + s)
    raised = F.expr("concat('Income: $', income + 100, chr(10), 'Gym: $45', chr(10), 'Rent: $1')")
    said = F.array(F.struct(F.lit(1).alias("turn"), F.col("text")), F.struct(F.lit(2).alias("turn"), raised.alias("text")))
    turns = customers.select("user_id", F.inline(said)).select(F.col("user_id").alias("conv_id"), "turn", when(60 * F.col("turn")).alias("ts"), "text")
    answered = budget_rows(stream_of(spark, sf_dir, "customer")).select("user_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("turn"))
    replies = answered.select(F.col("user_id").alias("conv_id"), when(60 * F.col("turn") + 5).alias("ts"), F.lit("Noted.").alias("reply"))
    rows = latest_facts(run_now(conversation_facts(exchanges(turns, replies, "30 seconds")), new_folder(spark, "facts")))
    return rows.select(
        F.col("conv_id").alias("user_id"), F.col("facts.income").alias("income"), N.total_expenses().alias("expenses"), F.col("facts.savings_balance").alias("savings"),
        F.size("facts.debts").alias("n_debts"))


QUERIES = {"memory_stream": memory_stream, "facts_stream": facts_stream}
ORACLES = {"memory_stream": advice.UPSERT, "facts_stream": FINANCE["aggregate_financials"]}
