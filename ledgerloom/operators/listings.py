"""Listings over conversations and advice: summaries, search, pages, groups, chips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip

# Sizes of pages and titles.
PAGE = 8
RECENT = 4
TITLE = 48
#: Request limits.
LONGEST_MESSAGE = 4000
LONGEST_TITLE = 100


def derived_title(first: Column) -> Column:
    """The first user message on one line, 48 characters at most; a stock title without any."""
    text = F.replace(strip(F.coalesce(first, F.lit(""))), F.lit("\n"), F.lit(" "))
    return F.when(text == "", "New conversation").when(F.length(text) > TITLE, F.concat(F.regexp_replace(F.left(text, F.lit(TITLE)), r"(?U)\s+$", ""), F.lit("…"))).otherwise(text)


def conversation_list(turns: DataFrame, user_id: str | None = None) -> DataFrame:
    """(id, title, last_message, n_turns) of each conversation, newest first by last turn.

    One aggregate: nothing is collected but the first user text and the last text.
    """
    rows = turns if user_id is None else turns.where(F.col("user_id") == user_id)
    return rows.groupBy(F.col("conv_id").alias("id")).agg(
        derived_title(F.min_by("text", F.when(F.col("role") == "user", F.col("turn")))).alias("title"),
        F.coalesce(F.max_by("text", "turn"), F.lit("")).alias("last_message"), F.count("*").alias("n_turns")).orderBy(F.desc("n_turns"), "id")


def search(conversations: DataFrame, query: str) -> DataFrame:
    """Conversations whose title or last message holds the query; all for a blank one."""
    q = query.strip().lower()
    if not q:
        return conversations
    return conversations.where(F.contains(F.lower(F.coalesce("title", F.lit(""))), F.lit(q)) | F.contains(F.lower(F.coalesce("last_message", F.lit(""))), F.lit(q)))


def latest_turns(turns: DataFrame, n: int) -> DataFrame:
    """The last n user and assistant turns of each conversation."""
    nth = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return turns.where("role != 'system'").withColumn("nth", nth).where(F.col("nth") <= n)


def advice_list(advice: DataFrame, category: str | None = None) -> DataFrame:
    """Advice of a category (any for none), newest first, equal times by id."""
    rows = advice.where(F.lower("category") == category.lower()) if category else advice
    return rows.orderBy(F.desc("ts"), F.desc("id"))


def groups(advice: DataFrame) -> DataFrame:
    """(category, n, newest, place): groups by size, equal sizes by their newest item."""
    out = advice.groupBy("category").agg(F.count("*").alias("n"), F.max(F.struct("ts", "id")).alias("m"))
    return out.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), F.desc("m")))).select("category", "n", F.col("m.id").alias("newest"), "place")


def topic_weights(advice: DataFrame) -> DataFrame:
    """(category, n, weight): font weights from 0.75 to 1.6 by count."""
    out = advice.groupBy("category").agg(F.count("*").alias("n"))
    return out.withColumn("weight", F.round(0.75 + 0.85 * F.col("n") / F.max("n").over(Window.partitionBy()), 6))


def chips(advice: DataFrame) -> DataFrame:
    return advice.agg(F.count("*").alias("items"), F.countDistinct("category").alias("categories"), F.count_if("saved").alias("saved"))


def page(advice: DataFrame, number: int, size: int = PAGE) -> DataFrame:
    """One page, newest first; numbers beyond either end give the first or the last page."""
    n = advice.count()
    last = max(1, -(-n // size))
    at = min(max(number, 1), last) - 1
    return advice.orderBy(F.desc("ts"), F.desc("id")).offset(at * size).limit(size)


def page_count(advice: DataFrame, size: int = PAGE) -> DataFrame:
    return advice.agg(F.greatest(F.lit(1), F.ceil(F.count("*") / size)).cast("long").alias("pages"))


def saved_only(advice: DataFrame) -> DataFrame:
    return advice.where("saved")


def shown_date(ts: Column) -> Column:
    """A date as M/d/yyyy, empty for what is none."""
    return F.coalesce(F.date_format(F.try_to_timestamp(ts) if not isinstance(ts, str) else F.try_to_timestamp(F.col(ts)), "M/d/yyyy"), F.lit(""))


def valid_request(message: Column) -> Column:
    return F.coalesce(F.length(message).between(1, LONGEST_MESSAGE), F.lit(False))


def valid_title(name: Column) -> Column:
    return F.coalesce(F.length(name).between(1, LONGEST_TITLE) & (strip(name) != ""), F.lit(False))


def valid_role(role: Column) -> Column:
    return F.coalesce(role.isin("user", "assistant"), F.lit(False))


def columns_like(df: DataFrame, pattern: str) -> list[str]:
    """The names of columns that match a pattern: a guard against unwanted fields."""
    import re

    return [c for c in df.columns if re.search(pattern, c, re.IGNORECASE)]
