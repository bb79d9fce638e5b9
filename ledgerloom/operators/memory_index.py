"""Memories by token: a stored index that answers queries without moving memories.

* Postings lie in a table bucketed by user and token, so a query's tokens travel to them and
  they stay where they are; a user with very many memories is spread over the buckets by
  token. A posting has the memory's distinct tokens, so whoever finds it has its score at once.
* Bounds. A query's tokens go from rare to frequent (within its user). A memory that none of
  the first i tokens has found shares at most the r others, so its score is at most
  r / sqrt(max(r, n) * m) + NAMED, n the fewest tokens of a memory with that token, m the query's.
  The ``SEEDS`` rarest tokens give a first k-th score; of the others only those are looked up
  whose bound reaches it. So frequent tokens, whose postings are long, are mostly never read.
* Classes. Memories of a user that say the same in the same category have one score for any
  query. Postings hold the newest of a class, with its number; a third table has them all, and
  the k newest of the classes found are taken from it. Equal texts of a user are asked once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .memory import RELEVANT, TOP_K, newest_first, of_queries, tokens

SEEDS = 2
NAMED = 0.05
_SLACK = 1e-9  # rounding never leaves out an equal score


@dataclass
class MemoryIndex:
    postings: str
    stats: str
    members: str


def build_index(memories: DataFrame, name: str, folder: str, buckets: int = 32) -> MemoryIndex:
    """Stores memories (user_id, memory_id, content, category, created_at) as tables name_postings, name_stats and name_members below a folder.

    A memory without tokens is found by no query and left out, as in ``retrieve``.
    """
    spark = memories.sparkSession
    # A class goes by what it says: 128 bits of a hash tell classes apart.
    said = F.to_json(F.struct(F.col("user_id").cast("string"), "content", "category"))
    members = memories.select(F.unhex(F.md5(said)).alias("class"), "user_id", "content", "category", "memory_id", "created_at")
    members.write.bucketBy(buckets, "class").sortBy("class").option("path", f"{folder}/members").mode("overwrite").saveAsTable(f"{name}_members")
    newest = F.max(F.struct("created_at", "memory_id"))
    heads = spark.table(f"{name}_members").groupBy("class").agg(*[F.first(c).alias(c) for c in ("user_id", "content", "category")], newest.alias("h")).select("class", "user_id", "content", "category", "h.*")
    held = heads.select("class", "user_id", "memory_id", "created_at", "category", tokens(F.col("content")).alias("t"), F.array_distinct(tokens(F.col("category"))).alias("named"))
    rows = held.select("class", "user_id", F.explode(F.array_distinct("t")).alias("token"), "memory_id", "created_at", "named", F.array_distinct("t").alias("words"), F.size("t").alias("nm"))
    rows.write.bucketBy(buckets, "user_id", "token").sortBy("user_id", "token").option("path", f"{folder}/postings").mode("overwrite").saveAsTable(f"{name}_postings")
    stats = spark.table(f"{name}_postings").groupBy("user_id", "token").agg(F.count("*").alias("df"), F.min("nm").alias("least"))
    stats.write.bucketBy(buckets, "user_id", "token").sortBy("user_id", "token").option("path", f"{folder}/stats").mode("overwrite").saveAsTable(f"{name}_stats")
    return MemoryIndex(f"{name}_postings", f"{name}_stats", f"{name}_members")


def ranked_tokens(spark: SparkSession, queries: DataFrame, index: MemoryIndex) -> DataFrame:
    """(query_id, user_id, words, nq, token, df, place, bound): the tokens of queries (query_id, user_id, text) that the user's memories have, rare ones first."""
    asked = queries.select("query_id", "user_id", tokens(F.col("text")).alias("t")).select("query_id", "user_id", F.array_distinct("t").alias("words"), F.size("t").alias("nq"))
    each = asked.select("*", F.explode("words").alias("token")).join(spark.table(index.stats), ["user_id", "token"])
    by_df = Window.partitionBy("query_id").orderBy("df", "token")
    placed = each.withColumns({"place": F.row_number().over(by_df), "found": F.count("*").over(Window.partitionBy("query_id"))})
    rest = (F.col("found") - F.col("place") + 1).cast("double")
    return placed.withColumn("bound", rest / F.sqrt(F.greatest(rest, F.col("least").cast("double")) * F.col("nq")) + NAMED).drop("found", "least")


def _scored(spark: SparkSession, wanted: DataFrame, index: MemoryIndex, threshold: float) -> DataFrame:
    met = wanted.select("query_id", "user_id", "token", "words", "nq").join(spark.table(index.postings).withColumnRenamed("words", "own"), ["user_id", "token"])
    score = F.size(F.array_intersect("words", "own")) / F.sqrt(F.col("nm").cast("double") * F.col("nq")) + F.when(F.arrays_overlap("named", "words"), NAMED).otherwise(0.0)
    return met.select("query_id", "class", "memory_id", "created_at", score.alias("score")).where(F.col("score") >= threshold)


def retrieve_indexed(spark: SparkSession, queries: DataFrame, index: MemoryIndex, k: int = TOP_K, threshold: float = RELEVANT, seeds: int = SEEDS) -> DataFrame:
    """(query_id, user_id, rank, memory_id, score): as ``retrieve`` with the keyword score, from a stored index.

    The threshold has to be above NAMED: below it memories count that share no token.
    """
    if threshold <= NAMED:
        raise ValueError(f"a threshold of {NAMED} or less asks for memories that share no token")
    texts = queries.where(F.col("text").isNotNull()).groupBy("user_id", "text").agg(F.min("query_id").alias("query_id"))
    ranked = ranked_tokens(spark, texts, index)
    once = Window.partitionBy("query_id").orderBy(*newest_first(F.col("score")))
    first = _scored(spark, ranked.where(F.col("place") <= seeds), index, threshold).distinct()
    best = first.withColumn("rank", F.row_number().over(once)).where(F.col("rank") <= k)
    # The k-th score so far, or the threshold where there are fewer.
    reach = best.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(threshold).alias("reach"))
    more = ranked.where(F.col("place") > seeds).join(reach, "query_id", "left").where(F.col("bound") + _SLACK >= F.coalesce("reach", F.lit(threshold)))
    found = best.drop("rank").union(_scored(spark, more, index, threshold)).distinct()
    classes = found.withColumn("rank", F.row_number().over(once)).where(F.col("rank") <= k).select("query_id", "class", "score")
    newest = Window.partitionBy("class").orderBy(F.desc("created_at"), F.desc("memory_id"))
    members = spark.table(index.members).select("class", "memory_id", "created_at").withColumn("nth", F.row_number().over(newest)).where(F.col("nth") <= k)
    each = classes.join(members, "class").withColumn("rank", F.row_number().over(once)).where(F.col("rank") <= k)
    told = each.select("query_id", "rank", "memory_id", "score").join(texts, "query_id").select("user_id", "text", "rank", "memory_id", "score")
    return of_queries(queries, told).select("query_id", "user_id", "rank", "memory_id", "score")
