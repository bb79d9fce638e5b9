"""The stored index against retrieval over all memories."""

import random
import re
import uuid

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import memory as M
from ledgerloom.operators.memory_index import build_index, ranked_tokens, retrieve_indexed

WORDS = ["saving", "house", "car", "bonds", "risk", "debt", "goal", "fact", "school", "trip", "rare%d", "odd%d"]


@pytest.fixture(scope="module")
def memories(spark):
    rnd, rows = random.Random(5), []
    for k in range(300):
        words = [w % rnd.randrange(40) if "%" in w else w for w in rnd.choices(WORDS, weights=[9, 8, 7, 6, 5, 4, 3, 2, 1, 1, 6, 6], k=rnd.randrange(9))]
        rows.append((0 if k % 3 else k % 7, k, " ".join(words), rnd.choice(["goal", "fact", "preference"]), k // 4))
    return spark.createDataFrame(rows, "user_id long, memory_id long, content string, category string, created_at long")


@pytest.fixture(scope="module")
def index(spark, memories, tmp_path_factory):
    return build_index(memories, f"m{uuid.uuid4().hex[:8]}", str(tmp_path_factory.mktemp("index")), buckets=4)


def asked(spark, memories):
    return memories.select((F.col("memory_id") + 1000).alias("query_id"), "user_id", F.concat_ws(" ", "content", F.lit("what about saving debt")).alias("text")).where("query_id % 2 = 0")


@pytest.mark.parametrize("k, threshold, seeds", [(3, 0.18, 2), (1, 0.5, 1), (5, 0.06, 3)])
def test_index_equals_retrieval(spark, memories, index, k, threshold, seeds):
    queries = asked(spark, memories)
    rows = lambda df: sorted((r["query_id"], r["user_id"], r["rank"], r["memory_id"], round(r["score"], 9)) for r in df.collect())
    want = rows(M.retrieve(queries, memories, k, threshold))
    assert rows(retrieve_indexed(spark, queries, index, k, threshold, seeds)) == want and len(want) > 100


def test_bounds_hold_and_leave_tokens_out(spark, memories, index):
    queries = asked(spark, memories)
    ranked = ranked_tokens(spark, queries, index)
    scores = M.retrieve(queries, memories, 10_000, 0.06).select("query_id", "memory_id", "score")
    words = memories.select("memory_id", M.tokens(F.col("content")).alias("t"))
    # The first token by which a memory is found bounds its score.
    first = ranked.join(scores, "query_id").join(words, "memory_id").where("array_contains(t, token)").groupBy("query_id", "memory_id").agg(F.min_by("bound", "place").alias("bound"), F.first("score").alias("score"))
    assert first.where("score > bound + 1e-9").count() == 0 and first.count() > 1000
    third = M.retrieve(queries, memories).where("rank = 3").select("query_id", "score")
    assert ranked.join(third, "query_id").where("bound < score").count() > 0


def test_postings_stay_where_they_are(spark, memories, index):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = retrieve_indexed(spark, asked(spark, memories), index)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lines = plan.splitlines()
    at = lambda line: re.search("[A-Za-z*]", line).start()
    scans = [k for k, line in enumerate(lines) if "FileScan" in line and "postings" in line and "memory_id" in line]
    assert scans
    for k in scans:
        assert "Bucketed: true" in lines[k]
        depth = at(lines[k])
        for line in reversed(lines[:k]):
            if re.search("[A-Za-z*]", line) and at(line) < depth:
                depth = at(line)
                assert "Exchange" not in line
                if "SortMergeJoin" in line:
                    break


def test_a_threshold_without_tokens_is_refused(spark, index):
    with pytest.raises(ValueError):
        retrieve_indexed(spark, spark.createDataFrame([], "query_id long, user_id long, text string"), index, threshold=0.05)
