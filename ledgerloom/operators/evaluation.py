"""Evaluation of conversations: question and answer pairs, metrics, aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metrics import METRICS, category_of, quality_share, summarise, with_metrics


def answered_questions(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, question, response): user turns followed at once by an assistant turn."""
    after = Window.partitionBy("conv_id").orderBy("turn")
    return turns.select(
        "conv_id", "turn", "role", F.col("text").alias("question"), F.lead("role").over(after).alias("__next"), F.lead("text").over(after).alias("response")
    ).where("role = 'user' and __next = 'assistant'").drop("role", "__next")


def scored(pairs: DataFrame) -> DataFrame:
    return with_metrics(pairs).withColumn("category", category_of(F.col("question")))


def by_category(rows: DataFrame) -> DataFrame:
    """One row for each category and metric, with the category's share of good answers."""
    return summarise(rows, ["category"]).join(quality_share(rows, ["category"]).select("category", "n_good", "share"), "category")


def extremes(rows: DataFrame, k: int = 3) -> DataFrame:
    """The k best and the k weakest rows by rubric, ties by conversation and turn."""
    best = rows.orderBy(F.desc("rubric"), "conv_id", "turn").limit(k).withColumn("side", F.lit("best"))
    weak = rows.orderBy("rubric", "conv_id", "turn").limit(k).withColumn("side", F.lit("weakest"))
    return best.union(weak).select("side", "conv_id", "turn", "rubric")


def histogram(rows: DataFrame, metric: str = "rubric", low: float = 1.0, high: float = 5.0, bins: int = 8) -> DataFrame:
    """(bin, n): equal bins, the upper end in the last."""
    at = F.least(F.floor((F.col(metric) - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("int")
    return rows.groupBy(at.alias("bin")).agg(F.count("*").alias("n"))


def box_plot(rows: DataFrame, metric: str = "rubric") -> DataFrame:
    """(category, q1, median, q3) of a metric."""
    q = F.percentile(metric, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return rows.groupBy("category").agg(q.alias("q")).select("category", *[F.round(F.col("q")[k], 3).alias(n) for k, n in enumerate(("q1", "median", "q3"))])


def scatter(rows: DataFrame) -> DataFrame:
    return rows.select("conv_id", "turn", "word_count", "rubric")


def describe(rows: DataFrame) -> DataFrame:
    return summarise(rows.withColumn("all", F.lit("all")), ["all"]).drop("all")


__all__ = ["METRICS", "answered_questions", "box_plot", "by_category", "describe", "extremes", "histogram", "scatter", "scored"]


# What a judge is asked, and how much of a response it reads.
JUDGE_RUBRIC = "Scoring rubric: relevance 1-5 (addresses the question), helpfulness 1-5 (actionable, useful advice).\nOutput exactly: RELEVANCE: <1-5> and HELPFULNESS: <1-5>"
JUDGE_READS = 1200


def judge_prompt(question: Column, response: Column) -> Column:
    """The message for a judge model; its reply goes to :func:`parse_judge`."""
    return F.concat(F.lit("USER QUESTION:\n"), question, F.lit("\n\nASSISTANT RESPONSE:\n"), F.left(response, F.lit(JUDGE_READS)), F.lit("\n\n" + JUDGE_RUBRIC))


def parse_judge(df: DataFrame, reply: str) -> DataFrame:
    """Adds judge_relevance and judge_helpfulness (1 to 5), null unless both can be read.

    The last mention of either counts.
    """
    def last(key: str):
        hits = F.regexp_extract_all(reply, F.lit(rf"{key}\s*[:=]\s*([1-5])"), F.lit(1))
        return F.try_element_at(hits, F.lit(-1)).cast("int")

    a, b = last("RELEVANCE"), last("HELPFULNESS")
    return df.withColumn("judge_relevance", F.when(b.isNotNull(), a)).withColumn("judge_helpfulness", F.when(a.isNotNull(), b))
