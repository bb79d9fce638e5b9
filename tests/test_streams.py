"""Keyed state and joined streams against the batch operators, with late rows and expiry."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import finance as N
from ledgerloom.operators import memory as M
from ledgerloom.streaming.exchanges import conversation_facts, exchanges, latest_facts, merged
from ledgerloom.streaming.memories import STATE_STORE, kept_memories
from ledgerloom.streaming.runs import run_now

START = datetime.datetime(2026, 1, 1)
CANDIDATE = "user_id long, ord long, content string, category string, importance double, ts timestamp"


def at(seconds):
    return START + datetime.timedelta(seconds=seconds)


class Feed:
    """A folder that a stream reads; every call of ``more`` is a batch."""

    def __init__(self, spark, folder, kind):
        self.spark, self.folder, self.kind = spark, str(folder), kind
        spark.createDataFrame([], kind).write.parquet(self.folder)

    def stream(self):
        return self.spark.readStream.schema(self.kind).parquet(self.folder)

    def more(self, rows):
        self.spark.createDataFrame(rows, self.kind).coalesce(1).write.mode("append").parquet(self.folder)


@pytest.fixture()
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, STATE_STORE)
    yield spark
    spark.conf.unset(name)


def started(df, name):
    return df.writeStream.format("memory").queryName(name).outputMode("append").start()


def contents(rows):
    """What is held after the changes in order."""
    held = {}
    for r in rows:
        if r["change"] == "expired":
            del held[r["user_id"], r["memory_id"]]
        else:
            held[r["user_id"], r["memory_id"]] = r["content"]
    return held


def made_up(n):
    rnd = random.Random(4)
    words = "saving car house low risk bonds stocks trip rent debt card school loan".split()
    return [(k % 3, k, "user wants " + " ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 5))), "goal", 0.7, at(k)) for k in range(n)]


def test_state_over_batches_equals_batch(rocks, tmp_path):
    rows, feed = made_up(90), Feed(rocks, tmp_path / "in", CANDIDATE)
    query = started(kept_memories(feed.stream()), "kept_in_batches")
    try:
        for k in range(0, 90, 30):
            feed.more(rows[k : k + 30])
            query.processAllAvailable()
    finally:
        query.stop()
    got = contents(rocks.table("kept_in_batches").collect())
    want = {(r["user_id"], r["memory_id"]): r["content"] for r in M.upserted(rocks.createDataFrame(rows, CANDIDATE)).collect()}
    assert got == want and len(want) > 6


def slow_upserts(rows):
    """Every stored memory is looked at for every candidate."""
    held, words = {}, {}
    for user, number, content, *_ in rows:
        own, best, top = words_of(content), None, 0.0
        for key in [k for k in held if k[0] == user]:
            value = len(set(own) & set(words[key])) / (len(own) * len(words[key])) ** 0.5
            if value > top:
                best, top = key, value
        key = (user, number) if best is None or top < M.SAME else best
        held[key], words[key] = content, own
    return held


_STEMS = {}


def words_of(content):
    return _STEMS[content]


def test_fold_equals_looking_at_every_memory(spark):
    rows = made_up(150)
    df = spark.createDataFrame(rows, CANDIDATE)
    _STEMS.update({r["content"]: r["t"] for r in df.select("content", M.tokens(F.col("content")).alias("t")).collect()})
    assert {(r["user_id"], r["memory_id"]): r["content"] for r in M.upserted(df.repartition(3)).collect()} == slow_upserts(rows)
    assert M.upserted(df.limit(0)).count() == 0


def test_memories_expire_unless_used(rocks, tmp_path):
    feed = Feed(rocks, tmp_path / "in", CANDIDATE)
    stored = rocks.createDataFrame([(1, 500, "user owns the boat", "fact", 0.6, at(0))], "user_id long, memory_id long, content string, category string, importance double, ts timestamp")
    query = started(kept_memories(feed.stream(), keep=100, start=stored), "kept_for_a_while")
    try:
        feed.more([(1, 1, "user wants new car", "goal", 0.7, at(0)), (1, 2, "user prefers bonds", "preference", 0.7, at(10))])
        query.processAllAvailable()
        feed.more([(1, 1, None, None, None, at(90)), (2, 3, "user rents flat", "fact", 0.6, at(95))])
        query.processAllAvailable()
        feed.more([(2, 4, "user plans trip", "goal", 0.7, at(150))])
        query.processAllAvailable()
        feed.more([(1, 9, "user wants late thing", "goal", 0.7, at(20)), (2, 5, "she likes snow", "goal", 0.7, at(151))])
        query.processAllAvailable()
    finally:
        query.stop()
    told = [(r["user_id"], r["memory_id"], r["change"]) for r in rocks.table("kept_for_a_while").collect()]
    assert sorted(told) == sorted([(1, 1, "stored"), (1, 2, "stored"), (2, 3, "stored"), (2, 4, "stored"), (2, 5, "stored"), (1, 500, "expired"), (1, 2, "expired")])


TURN, REPLY = "conv_id long, turn long, ts timestamp, text string", "conv_id long, ts timestamp, reply string"


def conversation():
    texts = ["Income: $3,000\nRent: $900", "Savings: $500\nRent: $1\nGoals:\n- buy a boat", "Income: $3,100\nCar loan: $4,000 at 7% APR", "Car loan: $4,000\nFood: $300"]
    return [(c, k, at(600 * k + c), t) for c in (1, 2) for k, t in enumerate(texts)]


def test_facts_of_joined_streams_equal_batch(rocks, tmp_path):
    turns, replies = Feed(rocks, tmp_path / "turns", TURN), Feed(rocks, tmp_path / "replies", REPLY)
    asked = conversation()
    query = started(conversation_facts(exchanges(turns.stream(), replies.stream(), "10 minutes", "1 hour")), "facts_so_far")
    try:
        # The second turn of conversation 1 comes after the third; 2 gets no reply to its last turn.
        turns.more([r for r in asked if r[:2] != (1, 1)])
        replies.more([(c, at(600 * k + c + 5), f"reply {k}") for c in (1, 2) for k in range(4) if (c, k) not in ((1, 1), (2, 3))])
        query.processAllAvailable()
        turns.more([r for r in asked if r[:2] == (1, 1)])
        replies.more([(1, at(606), "reply 1"), (1, at(600 * 3 + 700), "too late a reply")])
        query.processAllAvailable()
        turns.more([(9, 0, at(20_000), "Rent: $5")])
        replies.more([(9, at(20_001), "r")])
        query.processAllAvailable()
        turns.more([(1, 7, at(10), "Income: $1")])  # behind the watermark: dropped
        replies.more([(1, at(12), "never")])
        query.processAllAvailable()
    finally:
        query.stop()
    rows = rocks.table("facts_so_far")
    seen = {(r["conv_id"], r["turn"]): r["n_turns"] for r in rows.collect()}
    assert seen == {(1, 0): 1, (1, 2): 2, (1, 3): 3, (1, 1): 2, (2, 0): 1, (2, 1): 2, (2, 2): 3, (9, 0): 1}
    batch = rocks.createDataFrame([r for r in asked if r[:2] != (2, 3)], TURN)
    want = {r["conv_id"]: r["facts"] for r in N.merge_facts(N.with_facts(batch), "conv_id", "turn").collect()}
    got = {r["conv_id"]: r["facts"] for r in latest_facts(rows).collect()}
    assert got[2] == want[2]


def test_merging_in_order_equals_batch(spark):
    rows = spark.createDataFrame(conversation(), TURN)
    facts = N.with_facts(rows)
    want = {r["conv_id"]: r["facts"].asDict(True) for r in N.merge_facts(facts, "conv_id", "turn").collect()}
    each = {}
    for r in facts.orderBy("turn").collect():
        each.setdefault(r["conv_id"], []).append(r["facts"].asDict(True))
    assert {c: merged(parts) for c, parts in each.items()} == want
    assert merged([]) == {"income": None, "expenses": [], "savings_balance": None, "savings_contributions": [], "debts": [], "debt_payments": [], "goals": []}


def test_a_stream_run_now_is_a_table(spark, tmp_path):
    feed = Feed(spark, tmp_path / "in", CANDIDATE)
    feed.more(made_up(30))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    got = run_now(kept_memories(feed.stream()), str(tmp_path / "run"))
    assert contents(got.collect()) and spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) == before
