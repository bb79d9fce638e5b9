"""What a row's category, goals and claims are decided by is computed once, and only if it is read."""

from pyspark.sql import functions as F

from ledgerloom.functions.constants import ADVICE_CATEGORIES, QUESTION_CATEGORIES
from ledgerloom.functions.metrics import category_of
from ledgerloom.functions.text import argmax, contained, occurrences
from ledgerloom.operators import advice as A
from ledgerloom.operators import claims as C
from ledgerloom.operators import finance as N
from ledgerloom.plans import finance as P


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_categories_are_scored_once(spark):
    words = [w for s in (QUESTION_CATEGORIES, ADVICE_CATEGORIES) for ws in s.values() for w in ws]
    texts = [None, "", "Nothing of it", *words, *(f"{a} AND {b}" for a, b in zip(words, words[7:])), *(f"{a} {b} {a}" for a, b in zip(words, words[31:]))]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    low = F.lower("t")
    name, top = argmax([(k, contained(low, ws)) for k, ws in QUESTION_CATEGORIES.items()])
    plain = F.when(top > 0, name).otherwise(F.lit("general"))
    first, most = argmax([(k, sum((occurrences(low, w) for w in ws), F.lit(0))) for k, ws in ADVICE_CATEGORIES.items()])
    found = df.select(category_of(F.col("t")).alias("a"), plain.alias("b"), A.topic(F.col("t")).alias("topic"), first.alias("first"), most.alias("most"))
    rows = found.collect()
    assert len({r["a"] for r in rows}) > 5 and all(r["a"] == r["b"] for r in rows)
    assert all(r["topic"] in (r["first"], "Concepts") if r["most"] != 0 else r["topic"] in ("General", "Concepts") for r in rows)
    # Each list of phrases is named once: with argmax as many times as there are categories, and more.
    some = next(iter(QUESTION_CATEGORIES.values()))[0]
    assert _plan(df.select(category_of(F.col("t")))).count(f"[{some},") == 1


def test_only_what_is_read_is_computed(spark, small):
    rows = N.with_facts(spark.createDataFrame([(1, "Income: $3000\nRent: $900\nDebt: $500 at 20% APR")], "user_id long, text string"))
    rows = C.with_grounding(N.with_plan(rows)).withColumn("reply", F.lit("Your income is $4000. You need $75,000 to start."))
    assert "__money" not in C.claim_sentences(rows, labels=False).columns and "__computed_sums" not in C.claim_sentences(rows, sums=("grounds",)).columns
    assert [r["kind"] for r in C.unsupported(C.claim_sentences(rows, sums=("grounds",), labels=False)).collect()] == ["requirement"]
    assert [r["contradiction"] for r in C.contradicts(C.claim_sentences(rows.select("facts", "reply"), sums=())).orderBy("place").collect()] == [True, False]
    # Nothing of a plan is computed for contradictions, which read facts alone.
    assert "grounds" not in P.contradictions(spark, small)._jdf.queryExecution().analyzed().toString()


def test_priced_lines_are_no_goals(spark):
    text = "My goals:\n1. Save for a $20 book\n- Retire early\nRent: $500\nBuy a car for $9\nfree: 30"
    other = "I want to buy a house now\nbuy it for $30 now\n* invest $5\n2) reduce debt\nSavings = 300 to invest"
    got = spark.createDataFrame([(text,), (other,)], "text string").transform(N.with_facts).select("facts.goals").collect()
    assert [r[0] for r in got] == [["Retire early"], ["I want to buy a house now", "reduce debt"]]
