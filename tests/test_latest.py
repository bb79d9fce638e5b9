"""The latest view by batches against the whole log's, with late versions, repeats and streams."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators.latest import LatestTable, follow, merged_states, state_of, view_of
from ledgerloom.operators.store import latest_view

KIND = "id long, version long, op string, a string, b int"


def log(n, keys=12, seed=2):
    rnd = random.Random(seed)
    versions = list(range(n))
    rnd.shuffle(versions)
    return [(rnd.randrange(keys), v, rnd.choice("IUUUUD"), rnd.choice(["x", "y", None]), rnd.choice([1, 2, None])) for v in versions]


def as_set(df):
    return {(r["id"], r["version"], r["a"], r["b"]) for r in df.collect()}


def test_states_merge_to_the_view_of_the_log(spark):
    rows = log(150)
    changes = spark.createDataFrame(rows, KIND)
    parts = [state_of(spark.createDataFrame(rows[k : k + 40], KIND), "id") for k in range(0, 150, 40)]
    states = parts[0]
    for p in parts[1:]:
        states = merged_states(states.unionByName(p), "id")
    assert as_set(view_of(states, "id")) == as_set(latest_view(changes, "id")) != set()


def test_batches_in_a_table(spark, tmp_path):
    rows = log(90)
    table = LatestTable(spark, str(tmp_path / "t"), spark.createDataFrame([], KIND).schema, "id", buckets=4)
    assert table.view().count() == 0
    for batch, k in enumerate(range(0, 90, 45)):
        assert table.apply(spark.createDataFrame(rows[k : k + 45], KIND), batch)
        assert as_set(table.view()) == as_set(latest_view(spark.createDataFrame(rows[: k + 45], KIND), "id"))
    before = as_set(table.view())
    assert not table.apply(spark.createDataFrame(rows[:5], KIND), 1) and as_set(table.view()) == before
    # A change of one key rewrites its bucket only.
    old = table._state()["buckets"]
    table.apply(spark.createDataFrame([(3, 1000, "I", "new", 9)], KIND), 2)
    new = table._state()["buckets"]
    assert sum(old[k] != new[k] for k in old) == 1 and (3, 1000, "new", 9) in as_set(table.view())
    table.tidy()
    assert (3, 1000, "new", 9) in as_set(table.view()) and len(as_set(table.view()) - before) == 1


def test_two_writers_do_not_overwrite_each_other(spark, tmp_path):
    table = LatestTable(spark, str(tmp_path / "t"), spark.createDataFrame([], KIND).schema, "id", buckets=2)
    table.apply(spark.createDataFrame(log(10), KIND), 0)
    stale = table._state()
    table.apply(spark.createDataFrame([(1, 99, "I", "x", 1)], KIND), 1)
    table._state = lambda: stale
    with pytest.raises(RuntimeError, match="another writer"):
        table.apply(spark.createDataFrame([(2, 98, "I", "x", 1)], KIND), 2)


def test_a_stream_keeps_the_table(spark, tmp_path):
    rows = log(60)
    feed, table = str(tmp_path / "in"), LatestTable(spark, str(tmp_path / "t"), spark.createDataFrame([], KIND).schema, "id", buckets=3)
    for k in (0, 30):
        spark.createDataFrame(rows[k : k + 30], KIND).coalesce(1).write.mode("append").parquet(feed)
        follow(spark.readStream.schema(KIND).parquet(feed), table, str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert as_set(table.view()) == as_set(latest_view(spark.createDataFrame(rows, KIND), "id"))
    assert table.view().where(F.col("id").isNull()).count() == 0
