"""Driver tables as inputs of the operators, and messages derived from numeric tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Rows dealt to as many tasks as shuffles have: a table of short rows is a file of few row groups,
    and what is made of a row costs far more than to read it. A given number is not merged again."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def docs_as_qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ord, source, question, answer): the first line asks, the rest answers."""
    text = F.col("text")
    at = F.locate("\n", text)
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("ord"), "source",
        F.when(at > 0, F.left(text, at - 1)).otherwise(text).alias("question"),
        F.when(at > 0, F.substr(text, at + 1)).otherwise(F.lit("")).alias("answer"))


DOCS_AS_QA_SQL = """
qa AS (SELECT doc_id AS ord, source,
  CASE WHEN instr(text, chr(10)) > 0 THEN left(text, instr(text, chr(10)) - 1) ELSE text END AS question,
  CASE WHEN instr(text, chr(10)) > 0 THEN substr(text, instr(text, chr(10)) + 1) ELSE '' END AS answer
  FROM documents)"""

# One budget message for each customer, from its numbers.
_LINES = "concat('Income: $', income, chr(10), 'Rent: $', rent, chr(10), 'Food: $', food, chr(10), 'Savings: $', savings, chr(10), 'Credit card debt: $', debt, ' at ', apr, '% APR')"
BUDGET_NUMBERS = """c_custkey AS user_id,
  1500 + c_custkey * 37 % 4000 AS income, 400 + c_custkey * 13 % 1400 AS rent, 150 + c_custkey * 7 % 600 AS food,
  c_custkey * 101 % 9000 AS savings, 200 + c_custkey * 211 % 8000 AS debt, 3 + c_custkey * 5 % 25 AS apr"""


def budget_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, income, rent, food, savings, debt, apr, text)."""
    return budget_rows(spread(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey"))


def budget_rows(customers: DataFrame) -> DataFrame:
    return customers.selectExpr(*[x.strip() for x in BUDGET_NUMBERS.split(",")]).withColumn("text", F.expr(_LINES))


BUDGET_SQL = f"budgets AS (SELECT *, {_LINES} AS text FROM (SELECT {BUDGET_NUMBERS} FROM customer))"



def money_sql(c: str) -> str:
    return f"concat('$', replace(format('{{:,.2f}}', ({c})::DOUBLE), '.00', ''))"


#: The verified summary of a budget in DuckDB.
VERIFIED_SQL = f"""concat('Verified monthly summary:', chr(10), '- Income: ', {money_sql('income')}, chr(10), '- Total monthly expenses: ', {money_sql('rent + food')}, chr(10), '- Savings: ', {money_sql('savings')}, chr(10),
  '- Credit card debt: ', {money_sql('debt')}, ' at ', apr, '% APR', chr(10), '- Monthly surplus: ', CASE WHEN income < rent + food THEN '-' ELSE '' END, {money_sql('abs(income - rent - food)')})"""

# Fixed list of message templates; {} stands for a part's name.
INTENTS = (
    "I want to save for a {}.",
    "What is compound interest?",
    "My goal is to pay off my credit card debt before buying a {}.",
    "Should I invest in an index fund or a {}?",
    "I prefer low risk bonds over a {}.",
    "How should I budget for a {} every month?",
    "why",
    "I make 3000 a month and want to retire early.",
    "Does life insurance coverage pay for a {}?",
    "Tell me about my credit score and the {}.",
)
_CHOICE = "CASE p_partkey % 10 " + " ".join(f"WHEN {k} THEN '{t}'" for k, t in enumerate(INTENTS)) + " END"
INTENT_COLUMNS = f"p_partkey AS msg_id, p_partkey % 37 AS user_id, replace({_CHOICE}, '{{}}', p_name) AS text"


def intent_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(msg_id, user_id, text): template messages over the parts."""
    return spread(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_partkey").select(
        F.col("p_partkey").alias("msg_id"), (F.col("p_partkey") % 37).alias("user_id"), F.expr(f"replace({_CHOICE}, '{{}}', p_name)").alias("text"))


# Fixed list of openings of a message, alone or before a turn's text.
OPENINGS = ("Why", "why not?", "What's the ", "ok", "I don't get it!", "So you're saying ", "HOW  come?", "that s it", "Tell me ", "Please explain", "and how", "Explain to me ", "", "how?!", "wait , ")
_OPENING = "CASE (conv_id * 7 + turn) % 15 " + " ".join(f"WHEN {k} THEN '{o.replace(chr(39), chr(39) * 2)}'" for k, o in enumerate(OPENINGS)) + " END"
OPENED_COLUMNS = f"conv_id, turn, concat({_OPENING}, CASE WHEN (conv_id + turn) % 2 = 0 THEN coalesce(text, '') ELSE '' END) AS text"


def opened_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, text): turns of conversations behind the openings, every other one cut to its opening."""
    return table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", OPENED_COLUMNS.split(", ", 2)[2])


# Fixed list of messages of several lines; {} stands for a part's name.
GOAL_MESSAGES = (
    "My goals:@1. Pay off the {}@- Build an emergency fund.@Rent: $500@no item", "I want to buy a {}.@Savings = 300", "Goals@* retire early@* retire early@* see a {} $40",
    "{}@2) reduce debt -@3) eat {}", "We will save for a {} and invest.@What I want to accomplish:@• start {}@free text to increase", "Nothing of the {} here", "set up {}", "become a {} owner : ")
_GOALS = "CASE p_partkey % 8 " + " ".join(f"WHEN {k} THEN replace('{t}', '@', chr(10))" for k, t in enumerate(GOAL_MESSAGES)) + " END"
GOAL_COLUMNS = f"p_partkey AS msg_id, replace({_GOALS}, '{{}}', p_name) AS text"
INTENTS_SQL = f"intents AS (SELECT {INTENT_COLUMNS} FROM part)"

def goal_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(msg_id, text): messages of several lines over the parts."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("msg_id"), F.expr(f"replace({_GOALS}, '{{}}', p_name)").alias("text"))


ADVICE_CATEGORIES = ("Saving", "Budgeting", "Retirement", "Investing", "Debt", "Credit", "Insurance", "Taxes", "Concepts", "General")
_CATEGORY = "CASE o_orderkey % 10 " + " ".join(f"WHEN {k} THEN '{c}'" for k, c in enumerate(ADVICE_CATEGORIES)) + " END"
ADVICE_COLUMNS = (
    "o_orderkey AS id", "o_custkey % 40 AS conversation_id", "o_custkey AS user_id", "o_orderdate AS ts", f"{_CATEGORY} AS category",
    "o_totalprice > 200000 AS saved", "concat('Plan ', o_orderkey) AS short_title")


def advice_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, conversation_id, user_id, ts, category, saved, short_title) from the orders."""
    return table(spark, sf_dir, "orders").selectExpr(*ADVICE_COLUMNS)


ADVICE_SQL = f"advice AS (SELECT {', '.join(ADVICE_COLUMNS)} FROM orders)"
PAIRS_SQL = """
pairs AS (SELECT conv_id, turn, question, response FROM (
  SELECT conv_id, turn, role, text AS question, lead(role) OVER w AS nx, lead(text) OVER w AS response
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND nx = 'assistant')"""
