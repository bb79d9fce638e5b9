"""Steps that lambdas name are computed once, not once for each element, with the same results."""

import time

from pyspark.sql import functions as F

from ledgerloom.functions.money import PAIR, spans
from ledgerloom.operators import finance as N
from ledgerloom.plans import inputs as I


def test_long_replies_take_time_in_proportion(spark):
    """Four hundred lines: computing the steps anew for each line would take hours."""
    lines = [f"Put ${k} aside for month {k} of the plan." if k % 4 else "Investing strategy" for k in range(400)] + ["Keep a reserve.", "keep a reserve"]
    df = spark.createDataFrame([("\n".join(lines), "I ask.\nPut $1 aside for month 1 of the plan.")], "reply string, message string")
    begin = time.time()
    got = df.repartition(1).select(N.corrected(F.col("reply"), F.col("message"), F.lit(None).cast("string")).alias("x")).collect()[0][0].split("\n")
    assert time.time() - begin < 30
    # The first title stands, its repeats go; the echo goes; the last line repeats another.
    assert got == ["1. Investing strategy"] + [x for k, x in enumerate(lines[:400]) if k % 4 and k != 1] + ["Keep a reserve."]


def test_places_of_many_matches(spark):
    text = "\n".join(f"Item {k}: ${k}" for k in range(200))
    out = spark.createDataFrame([(text,), ("none",), (None,)], "t string").select(spans(F.col("t"), PAIR, 2).alias("s")).collect()
    assert [text[s["start"]: s["end"]] for s in out[0]["s"]] == [s["all"] for s in out[0]["s"]] and len(out[0]["s"]) == 200
    assert [s["groups"][1] for s in out[0]["s"]] == [str(k) for k in range(200)]
    assert out[1]["s"] == [] and out[2]["s"] is None


def test_messages_are_dealt_to_all_tasks(spark, small):
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert I.budget_messages(spark, small).rdd.getNumPartitions() == n == I.intent_messages(spark, small).rdd.getNumPartitions()
