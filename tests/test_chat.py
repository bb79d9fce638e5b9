"""A batch of chat turns, the mutable tables and the settings."""

import pytest
from pyspark.sql import functions as F

from ledgerloom import config
from ledgerloom.operators.chat import prompt_messages, run_chat
from ledgerloom.operators.tables import Store


def test_chat_batch(spark):
    ask = spark.createDataFrame([
        (1, 7, "Income: $3,000\nRent: $900\nHow should I budget for a house?"), (2, 8, "why?"), (3, 9, "I want to save for a boat.")], "conv_id long, user_id long, message string")
    turns = spark.createDataFrame([(2, 0, "user", "Income: $2,000\nRent: $500"), (2, 1, "assistant", "Keep a reserve.")], "conv_id long, turn long, role string, text string")
    memories = spark.createDataFrame([(7, 1, "user is saving for a house.", "goal", 1)], "user_id long, memory_id long, content string, category string, created_at long")
    prompts = {}

    def author(rows, attempt):
        if attempt == 1:
            prompts.update({r["conv_id"]: r["system_prompt"] for r in rows.select("conv_id", "system_prompt").collect()})
        text = F.when(F.col("conv_id") == 3, "You need $75,000 to start.").when((F.col("conv_id") == 2) & (F.lit(attempt) < 2), "You need $75,000 to start.").otherwise(
            "You should keep an emergency reserve first and review the budget every month.<|im_end|>")
        return rows.withColumn("reply", text)

    out = run_chat(ask, turns, memories, author)
    replies = {r["conv_id"]: r for r in out.replies.collect()}
    assert [replies[k]["attempt"] for k in (1, 2, 3)] == [1, 2, 0]
    assert replies[1]["reply"].startswith("Verified monthly summary:") and "won't invent" in replies[3]["reply"]
    assert "saving for a house" in prompts[1] and "Recommended plan" in prompts[1] and "Keep a reserve." in prompts[2] and "$2,000" in prompts[2] and prompts[3] == ""
    assert sorted((r["conv_id"], r["turn"], r["role"]) for r in out.turns.collect()) == [(1, 0, "user"), (1, 1, "assistant"), (2, 2, "user"), (2, 3, "assistant"), (3, 0, "user"), (3, 1, "assistant")]
    assert {r["conv_id"] for r in out.advice.collect()} == {1, 2}
    assert [(r["user_id"], r["content"]) for r in out.memories.collect()] == [(9, "user wants to save for a boat.")]


def test_prompt(spark):
    df = spark.createDataFrame([("m", [("system", "s"), ("user", "u"), ("assistant", "a")], "p"), ("m", [], None)], "message string, history array<struct<role:string,content:string>>, sp string")
    got = [[(x["role"], x["content"]) for x in r["x"]] for r in df.select(prompt_messages(F.col("message"), F.col("history"), F.col("sp")).alias("x")).collect()]
    assert got == [[("system", "p"), ("user", "u"), ("assistant", "a"), ("user", "m")], [("user", "m")]]


def test_store(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    say = lambda *t: [{"role": "user" if k % 2 == 0 else "assistant", "content": x} for k, x in enumerate(t)]
    one, two = s.create_conversation(say("Hello there", "Hi"), "u1"), s.create_conversation(say("Other"), "u2")
    items = spark.createDataFrame([("Debt", "t", "k", "f", "q")], "category string, short_title string, key_recommendation string, full_text string, source_question string")
    s.add_advice(items, one)
    s.add_advice(items)
    assert [(r["title"], r["last_message"]) for r in s.conversations("u1").collect()] == [("Hello there", "Hi")]
    s.update_conversation(one, say("Hello there", "Hi", "More"))
    assert s.rename_conversation(one, "New") and not s.rename_conversation("none", "x")
    assert [(r["title"], len(r["messages"])) for r in s.conversation(one).collect()] == [("New", 3)]
    assert s.advice("DEBT").count() == 2 and s.advice("tax").count() == 0
    item = s.advice().first()["id"]
    assert s.save_advice(item) and s.advice_item(item).first()["saved"] and not s.save_advice("none")
    assert not s.delete_conversation(one, "u2") and s.delete_conversation(one, "u1")
    assert s.advice().count() == 1 and s.conversations("u1").count() == 0 and s.conversation(two).count() == 1
    m = s.create_memory("u1", "card 4111 1111 1111 1111", "goal", 0.7)
    assert "4111" not in s.memory(m).first()["content"]
    assert not s.update_memory(m, "u2", content="x") and s.update_memory(m, "u1", content="house", category=None)
    s.touch_memories(s.memories("u1").select("id"))
    assert [(r["content"], r["category"]) for r in s.memories("u1").collect()] == [("house", "goal")]
    s.compact()
    assert [(r["content"], r["category"]) for r in s.memories("u1").collect()] == [("house", "goal")] and s.log.changes("memories").count() == 1
    assert not s.delete_memory(m, "u2") and s.delete_memory(m, "u1") and s.memories("u1").count() == 0


def test_operators_by_settings(spark):
    records = spark.createDataFrame([(k, "a" if k % 2 else "b", f"how do I save money for a house number {k}?", "put some money aside every month") for k in range(20)], "ord long, source string, question string, answer string")
    strict = config.settings({"cleaning": {"filtering": {"max_question_chars": 30}, "dedup": {"enabled": False}}, "split": {"train": 0.5, "val": 0.5, "test": 0.0, "stratify_by_source": False}}, {})
    assert {r["reason"] for r in config.clean(records, strict).collect()} == {"question_too_long"} and {r["reason"] for r in config.clean(records, config.settings({}, {})).collect()} == {None}
    assert {r["kind"] for r in config.dedup(records, strict).collect()} == {"kept"} and "fuzzy" in {r["kind"] for r in config.dedup(records, config.settings({}, {})).collect()}
    rows = config.split(records.withColumn("id", records["ord"].cast("string")), strict)
    assert rows.where("split = 'train'").count() == 10 and rows.where("split = 'test'").count() == 0
    asked = spark.createDataFrame([(1, 7, "save for a house")], "query_id long, user_id long, text string")
    held = spark.createDataFrame([(7, k, f"user wants to save for a house {k}", "goal", k) for k in range(5)], "user_id long, memory_id long, content string, category string, created_at long")
    assert config.retrieve(asked, held, config.settings({"memory": {"top_k": 2}}, {})).count() == 2 and config.retrieve(asked, held, config.settings({"memory": {"relevance_threshold": 0.99}}, {})).count() == 0


def test_settings():
    assert config.settings({"split": {"train": 0.7, "val": 0.2}}, {})["split"]["seed"] == 42
    assert config.settings({}, {"LEDGERLOOM_STORE": "/x"})["store"]["path"] == "/x"
    assert config.for_source(config.settings({}, {}), "financebench")["filtering"]["min_answer_words"] == 1
    with pytest.raises(ValueError):
        config.settings({"split": {"train": 0.9}}, {})


def test_requests(spark, tmp_path):
    from ledgerloom.operators import requests as R
    from ledgerloom.operators.tables import Store

    s = Store(spark, str(tmp_path / "requests"))
    id_ = s.create_conversation([{"role": "user", "content": "How do I save?"}])
    assert R.rename_conversation(s, id_, "Saving") == id_ and R.get_conversation(s, id_).first()["title"] == "Saving" and R.list_conversations(s).count() == 1
    for fails in (lambda: R.get_advice(s, "x"), lambda: R.save_advice(s, "x"), lambda: R.get_conversation(s, "x"), lambda: R.delete_conversation(s, id_, "other"), lambda: R.delete_memory(s, "x")):
        with pytest.raises(R.NotFound):
            fails()
    with pytest.raises(ValueError):
        R.rename_conversation(s, id_, "")
    assert R.delete_conversation(s, id_) == id_ and R.list_conversations(s).count() == 0 and R.list_memories(s).count() == R.list_advice(s).count() == 0
