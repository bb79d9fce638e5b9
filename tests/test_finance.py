"""Facts, plans, claims and replies on literal inputs."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import claims as C
from ledgerloom.operators import finance as N

CASES = [
    ("Income: $1,500/month\n- Rent: $450\n- Food: $250\n- Transportation: $100\n- Utilities: $100\n- Entertainment: $150\n- Other: $100", {"income": 1500.0, "total": 1150.0, "surplus": 350.0}),
    ("Income: $1,500\nRent: $450\nFood: $250\nTransportation: $100", {"total": 800.0, "surplus": 700.0}),
    ("Income: $800\nRent: $600\nFood: $400", {"total": 1000.0, "surplus": -200.0}),
    ("My income is $3,000. Rent: $900, Food: $400, Transport: $200, Utilities: $150, Insurance: $100, Entertainment: $120, Other: $130", {"income": 3000.0, "total": 2000.0, "surplus": 1000.0}),
    ("Income: $2,000\nSavings: $150/month\nRent: $500", {"contributions": [150.0], "savings": None}),
    ("Income: $2,000\nSavings: $4,000\nRent: $500", {"savings": 4000.0, "contributions": []}),
    ("Income: $18,000/year\nRent: $600\nFood: $400", {"income": 1500.0}),
    ("I have $30,000 and want to open a startup.", {"savings": 30000.0, "income": None, "surplus": None}),
    ("I have $5,000 in credit card debt.", {"savings": None}),
    ("Goals:\n1. Pay off my card\n2. Retire early", {"goals": ["Pay off my card", "Retire early"]}),
    ("", {"income": None, "goals": []}),
    (None, {"income": None, "total": 0.0}),
]


@pytest.mark.parametrize("text, want", CASES)
def test_facts(spark, text, want):
    rows = N.with_facts(spark.createDataFrame([(text,)], "text string"))
    r = rows.select(
        F.col("facts.income").alias("income"), N.total_expenses().alias("total"), N.surplus().alias("surplus"), F.col("facts.savings_balance").alias("savings"),
        F.col("facts.savings_contributions").alias("contributions"), F.col("facts.goals").alias("goals")).first().asDict()
    assert {k: r[k] for k in want} == want


def test_plan(spark):
    text = "Income: $3,000\nRent: $1,500\nFood: $600\nSavings: $4,000\nCredit card debt: $3,000 at 22% APR"
    p = N.with_plan(N.with_facts(spark.createDataFrame([(text,)], "text string"))).first()["plan"]
    assert (p["recommended_initial_payment"], p["remaining_high_interest_debt"], p["recommended_monthly_debt_payment"], p["recommended_monthly_savings"]) == (1900.0, 1100.0, 630.0, 270.0)
    assert (p["estimated_months_to_debt_free"], p["emergency_fund_target"], p["near_term_buffer"], p["retained_buffer"]) == (2, 6300.0, 2100.0, 2100.0)


def grounded(spark, text):
    return C.with_grounding(N.with_plan(N.with_facts(spark.createDataFrame([(1, text)], "id int, text string"))))


def test_claims(spark):
    rows = grounded(spark, "Income: $3,000\nRent: $900").withColumn("reply", F.lit(
        "Your income is $3,000. Your surplus is $2,100. You need $75,000 upfront. It costs about $40 a day. Suppose $77."))
    got = [(r["figure"], r["category"]) for r in C.claims(C.claim_sentences(rows)).orderBy("place", "nth").collect()]
    assert got == [(3000.0, "USER_PROVIDED"), (2100.0, "CALCULATED"), (75000.0, "UNKNOWN"), (40.0, "UNKNOWN"), (77.0, "UNKNOWN")]


def test_verdict_and_guard(spark):
    rows = grounded(spark, "Income: $3,000\nRent: $900").withColumn("context", F.col("text"))
    fine = rows.withColumn("reply", F.lit("Your income is $3,000."))
    bad = rows.withColumn("reply", F.lit("Your income is $9,000. Stocks return 8% per year."))
    assert C.verdicts(fine, "id").first()["passed"]
    issues = C.verdicts(bad, "id").first()["issues"]
    assert [i.split(" ")[0] for i in issues] == ["Presents", "Presents", "Contradicts", "Topic"]
    assert not C.guarded(fine, "id").first()["is_clarification"] and C.guarded(bad, "id").first()["is_clarification"]


@pytest.mark.parametrize("text, want", [
    ("why?", True), ("How come?", True), ("Explain that please", True), ("tell me why", False), ("say how", True), ("How do I begin investing with a small budget?", False),
    ("What about credit card balances?", False), ("", False), (None, False)])
def test_follow_up(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(C.is_follow_up(F.col("t")).alias("x")).first()["x"] == want


def test_merge(spark):
    rows = spark.createDataFrame([(1, 1, "Income: $1,000\nRent: $500"), (1, 2, "Income: $2,000\nRent: $700\nFood: $10"), (2, 1, None)], "u int, turn int, text string")
    got = {r["u"]: r["facts"] for r in N.merge_facts(N.with_facts(rows), "u", "turn").collect()}
    assert got[1]["income"] == 2000.0 and [(e["category"], e["amount"]) for e in got[1]["expenses"]] == [("Rent", 500.0), ("Food", 10.0)]
    assert got[2]["income"] is None
