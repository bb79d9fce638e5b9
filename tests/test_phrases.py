"""One pass of many phrases against an expression for each of them."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import phrases as P
from ledgerloom.functions.metrics import category_of, matched_terms
from ledgerloom.operators.advice import topic

from .conftest import SMALL


def test_overlapping_phrases_and_their_own_occurrences(spark):
    words = ["aa", "aaa", "ab", "b", "saving", "savings", "éé"]
    texts = ["aaaaab", "abab", "", None, "savings saving", "ééé é", "x" * 50_000 + "aa"]
    got = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", P.mentions(F.col("t"), words).alias("m")).orderBy("k").collect()
    for row, t in zip(got, texts):
        want = None if t is None else [(k, t.count(w)) for k, w in enumerate(words) if w in t]
        assert (row["m"] if row["m"] is None else [tuple(x) for x in row["m"]]) == want


def test_random_texts(spark):
    rnd = random.Random(3)
    words = sorted({"".join(rnd.choice("ab") for _ in range(rnd.randint(1, 4))) for _ in range(12)})
    texts = ["".join(rnd.choice("abc") for _ in range(rnd.randint(0, 60))) for _ in range(300)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", P.mentions(F.col("t"), words).alias("m")).collect()
    assert len(rows) == 300
    assert all([tuple(x) for x in r["m"]] == [(k, r["t"].count(w)) for k, w in enumerate(words) if w in r["t"]] for r in rows)


def test_no_or_bad_phrases(spark):
    assert spark.range(1).select(P.mentions(F.lit("x"), []).alias("m")).first()["m"] == []
    for bad in (["a", ""], ["a", "a"]):
        with pytest.raises(ValueError):
            P.mentions(F.lit("x"), bad)


def test_equals_the_expressions(spark):
    texts = [
        "What is an IRA?", "Roth IRA or 401k and a TAX CREDIT", "explain my budget, budget, budget", "", "nothing", "emergency fund savings account high-yield savings", "meaning of debt", "invest in index funds"]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("text").union(spark.createDataFrame([(t,) for t in texts], "text string"))
    turns = spark.read.parquet(f"{SMALL}/conversations.parquet").select("text")
    rows = P.with_phrases(docs.union(turns)).where("text is not null").withColumns({"c": category_of(F.col("text")), "m": matched_terms(F.col("text")), "t": topic(F.col("text"))})
    for r in rows.collect():
        assert (r["category"], r["terms"], r["topic"]) == (r["c"], r["m"], r["t"]), r["text"]


def test_one_pass_a_text(spark):
    rows = P.with_phrases(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")).where("category = 'general' and size(terms) = 0 and topic = 'General'")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_null_text_and_other_columns(spark):
    rows = P.with_phrases(spark.createDataFrame([(1, None, {"a": 1}), (2, "debt", None)], "id int, text string, m map<string,int>")).orderBy("id").collect()
    assert tuple(rows[0]) == (1, None, {"a": 1}, None, None, None) and rows[1]["terms"] == ["debt"]
    assert P.with_phrases(spark.createDataFrame([], "text string")).count() == 0
