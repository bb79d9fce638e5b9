"""Registered queries on financial facts, plans and claims.

The messages are composed from numbers, so the SQL starts from the numbers and shares nothing
with the parser it checks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.money import PAIR, dollars, payoff_months
from ..lineage import cut
from ..operators import claims as C
from ..operators import finance as N
from .inputs import BUDGET_SQL, GOAL_COLUMNS, OPENED_COLUMNS, VERIFIED_SQL, budget_messages, goal_messages, money_sql, opened_messages, table
from .sql_text import WS, quoted


def _planned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.with_plan(N.with_facts(budget_messages(spark, sf_dir)))


def extract_financials(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = N.with_facts(budget_messages(spark, sf_dir))
    debt = F.col("facts.debts")[0]
    return f.select(
        "user_id", F.col("facts.income").alias("income"), F.size("facts.expenses").alias("n_expenses"), N.total_expenses().alias("expenses"), N.surplus().alias("surplus"),
        F.col("facts.savings_balance").alias("savings"), debt["amount"].alias("debt"), debt["apr"].alias("apr"), debt["description"].alias("debt_name"))


def aggregate_financials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two turns a user: the budget, then a raise and a new expense."""
    first = budget_messages(spark, sf_dir).select("user_id", F.lit(1).alias("turn"), "text")
    then = budget_messages(spark, sf_dir).select("user_id", F.lit(2).alias("turn"), F.expr("concat('Income: $', income + 100, chr(10), 'Gym: $45', chr(10), 'Rent: $1')").alias("text"))
    m = N.merge_facts(N.with_facts(first.union(then)), "user_id", "turn")
    return m.select("user_id", F.col("facts.income").alias("income"), N.total_expenses().alias("expenses"), F.col("facts.savings_balance").alias("savings"), F.size("facts.debts").alias("n_debts"))


def financial_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = (
        "emergency_fund_target", "emergency_fund_gap", "near_term_buffer", "recommended_initial_payment", "retained_buffer", "remaining_high_interest_debt",
        "recommended_monthly_debt_payment", "recommended_monthly_savings", "recommended_monthly_investing", "estimated_months_to_debt_free", "estimated_months_to_emergency_target")
    return _planned(spark, sf_dir).select("user_id", *[F.col(f"plan.{n}").alias(n) for n in names])


def payoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = budget_messages(spark, sf_dir)
    return b.select("user_id", payoff_months(F.col("debt").cast("double"), F.col("apr").cast("double"), (F.col("food") / 4).cast("double")).alias("months"))


def verified_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _planned(spark, sf_dir).select("user_id", N.verified_block().alias("block"))


def plan_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _planned(spark, sf_dir).select("user_id", N.plan_text().alias("plan_text"), N.context_text().alias("context_text"))


def formatted_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", dollars(F.col("c_acctbal")).alias("amount"))


def goals(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = N.with_facts(goal_messages(spark, sf_dir))
    return f.select("msg_id", F.array_join("facts.goals", "; ").alias("goals"))


# Sentences of replies, as SQL for both engines; a reply is five of them, chosen by user. Their
# figures are the user's, sums, multiples and months of those, or made up.
SENTENCES = (
    "concat('Your income is $', income, ' and your rent is $', rent, '.')", "'You will need $75,000 in starting capital.'",
    "concat('Saving 3 months of expenses means $', 3 * (rent + food), '.')", "concat('Your surplus is $', income - rent - food, '!')", "'Index funds return about 7% per year.'",
    "concat('Your $', savings, ' is not enough to start a business.')", "concat('It charges ', apr, '% interest.')", "concat('You must keep $', income + 12 * food, ' upfront.')",
    "concat('A minimum of $', rent + debt, ' is required?')", "concat('Expect to earn ', apr + 1, '% annually.')", "concat('It costs about $', 12 * rent + 5, ' a year.')", "'Keep a reserve.'",
    "concat('You need $', 6 * rent, ' over 6 months.')", "concat('$', food + 2, ' won''t cover the project.')", "concat('The yield is ', apr, '% a year.')")
_CHOSEN = ", ".join("CASE (user_id * 11 + %d * (user_id %% 7 + 1)) %% %d %s END" % (k, len(SENTENCES), " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(SENTENCES))) for k in range(5))


def _replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Budgets with facts, plan and a reply; written down, as facts and plan are long expressions."""
    return _with_reply(cut(C.with_grounding(_planned(spark, sf_dir))))


def _with_reply(rows: DataFrame) -> DataFrame:
    return rows.withColumn("reply", F.expr(f"array_join(array({_CHOSEN}), ' ')".replace("''", "\\'"))).withColumn("context", F.col("text"))


def claim_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.claims(C.claim_sentences(_replies(spark, sf_dir), labels=False)).groupBy("place", "nth", "category").agg(F.count("*").alias("n"))


def unsupported_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.unsupported(C.claim_sentences(_replies(spark, sf_dir), sums=("grounds",), labels=False)).select("user_id", "place", "kind")


def contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.drifts(C.contradicts(C.claim_sentences(_with_reply(cut(N.with_facts(budget_messages(spark, sf_dir)))), sums=())))
    return rows.groupBy("place").agg(F.count_if("contradiction").alias("n_contradictions"), F.count_if("drift").alias("n_drifts"))


def reply_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.verdicts(_replies(spark, sf_dir), "user_id").select("user_id", "passed", F.array_join("issues", "\n").alias("issues"))


def guarded_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.guarded(_replies(spark, sf_dir), "user_id").select("user_id", "is_clarification", F.length("reply").alias("n_chars"))


def refined_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stand-in author that drops its made-up figure at the second or third try, or never. To some
    users the figure is none: it is a year, a sum or so of theirs, and the first try passes."""
    def author(rows: DataFrame, attempt: int) -> DataFrame:
        fine = F.expr("concat('Your income is $', format_number(income, 0), '.')")
        return rows.withColumn("reply", F.when(F.col("user_id") % 4 < attempt, fine).otherwise("You need $75,000 to start."))

    return C.refine(_replies(spark, sf_dir).drop("reply"), "user_id", author).select("user_id", "attempt")


def follow_ups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return opened_messages(spark, sf_dir).select("conv_id", "turn", C.is_follow_up(F.col("text")).alias("follow_up"))


# Lines of replies, as SQL for both engines; a reply is nine of them, chosen by user.
REPLY_LINES = (
    "'1. Financial situation'", "'You earn more than you spend.'", "'Reduce rent and utilities by 20%.'", "concat('$', income, ' - $', rent + food, ' = $', income - rent - food)", "concat('Rent: $', rent)",
    "'3. Investing strategy:'", "'- Wait before you invest.'", "'wait  before you invest'", "'Income: $9,999'", "'Find a roommate to save money.'", "'Spending adjustments'", "'You can pay off the whole debt this month.'",
    "'Keep a reserve of some months.'", "'  Why this plan makes sense  '", "concat('Put $', food, ' aside.')", "'Monthly budget overview'", "''")
_REPLY = ", ".join("CASE (user_id * 13 + %d * (user_id %% 5 + 1)) %% %d %s END" % (k, len(REPLY_LINES), " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(REPLY_LINES))) for k in range(9))
_MESSAGE = "CASE WHEN user_id % 4 = 0 THEN 'How do I start?' ELSE text END"


def corrected_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies of nine lines to budgets, and to a question without one."""
    rows = budget_messages(spark, sf_dir).select("user_id", F.expr(f"array_join(array({_REPLY}), '\n')").alias("reply"), F.expr(_MESSAGE).alias("text"))
    f = cut(N.with_facts(rows).select("user_id", "reply", "text", N.verified_block().alias("block")))
    return f.select("user_id", N.corrected(F.col("reply"), F.col("text"), F.col("block")).alias("reply"))


# Budgets in other words, as SQL for both engines, chosen by user.
_PAPERS = "chr(10), 'That is all that I could find in my papers today, I think.', chr(10)"
FORMS = (
    f"concat('I make $', income, ' every month.', {_PAPERS}, 'Rent: $', rent, chr(10), 'Savings: $', savings)",
    f"concat('Annual income: $', 12 * income, ' a year', {_PAPERS}, 'So much for what I get and what it is.', chr(10), 'Rent: $', rent)",
    "'How do I start?'",
    f"concat('Income: $', income, chr(10), 'Rent: $', rent, {_PAPERS}, 'Car loan: $', debt, ' at ', apr, '% APR', {_PAPERS}, 'Student loan: $', savings)",
    "concat('Income: $', income, chr(10), 'Food: $', food)",
    f"concat('We have $', savings, ' in the bank and I earn $', income, ' now.', {_PAPERS}, 'Rent = $', rent)",
    f"concat('Income: $', income, {_PAPERS}, 'Savings contribution: $50 per month', {_PAPERS}, 'Credit card payment: $60', {_PAPERS}, 'Rent: $', rent)",
    "concat('Income: $', income, chr(10), 'Rent: $', rent, chr(10), 'RENT: $1', chr(10), 'Food: $', food, chr(10), 'Income: $100')",
    "concat('Salary: ', income, '.50', chr(10), 'Rent and fees: $', rent, '.25', chr(10), 'Emergency fund: $', savings)")
_FORM = f"CASE user_id % {len(FORMS)} " + " ".join(f"WHEN {k} THEN {x}" for k, x in enumerate(FORMS)) + " END"


def budget_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = cut(N.with_facts(budget_messages(spark, sf_dir).select("user_id", F.expr(_FORM).alias("text"))))
    debts = F.col("facts.debts")
    return f.select(
        "user_id", F.col("facts.income").alias("income"), F.size("facts.expenses").alias("n_expenses"), N.total_expenses().alias("expenses"), N.surplus().alias("surplus"),
        F.col("facts.savings_balance").alias("savings"), F.size(debts).alias("n_debts"), F.get(debts, F.lit(0))["apr"].alias("apr"), F.get(debts, F.lit(1))["apr"].alias("second_apr"),
        N.total(F.transform(debts, lambda d: d["amount"])).alias("owed"), N.total(F.col("facts.savings_contributions")).alias("contributions"), N.total(F.col("facts.debt_payments")).alias("payments"))


QUERIES = {f.__name__: f for f in (
    extract_financials, aggregate_financials, financial_plan, payoff, verified_blocks, plan_texts, formatted_amounts, goals, claim_kinds, unsupported_claims, contradictions,
    reply_verdicts, guarded_replies, refined_replies, follow_ups, corrected_replies, budget_forms)}

_B = f"WITH {BUDGET_SQL}"
_D = "::DOUBLE"
_MONTHS = "CASE WHEN {b} <= 0 THEN 0 WHEN {p} <= {b} * {r} THEN NULL ELSE ceil(-ln(1 - {b} * {r} / {p}) / ln(1 + {r})) END"
_PLAN = f"""{_B}, a AS (SELECT *, (rent + food){_D} AS ex, (income - rent - food){_D} AS su, CASE WHEN apr >= 10 THEN debt ELSE 0 END{_D} AS hi, CASE WHEN apr < 10 THEN debt ELSE 0 END{_D} AS other FROM budgets),
b AS (SELECT *, CASE WHEN savings > ex AND hi > 0 THEN least(savings - ex, hi) ELSE 0.0{_D} END AS init FROM a),
c AS (SELECT *, savings - init AS keep, hi - init AS rem, greatest(0.0, ex - (savings - init)) AS bgap, greatest(0.0, 3 * ex - (savings - init)) AS egap FROM b),
d AS (SELECT *, CASE WHEN su <= 0 THEN 'none' WHEN bgap > 0 THEN 'buffer' WHEN rem > 0 THEN 'debt' WHEN other > 0 OR egap > 0 THEN 'save' ELSE 'invest' END AS k FROM c),
e AS (SELECT *, CASE WHEN k = 'buffer' AND rem > 0 THEN su - least(su, bgap) WHEN k = 'debt' THEN round(0.7{_D} * su, 2) ELSE 0.0{_D} END AS dp FROM d),
f AS (SELECT *, CASE WHEN k = 'buffer' THEN least(su, bgap) WHEN k = 'debt' THEN round(su - dp, 2) WHEN k = 'save' THEN su ELSE 0.0{_D} END AS sv,
  CASE WHEN k = 'debt' THEN {_MONTHS.format(b='rem', p='dp', r='(apr / 1200.0::DOUBLE)')} END AS mo FROM e),
g AS (SELECT *, coalesce(round(mo * sv, 2), 0.0) AS saved FROM f)"""
_CASES = "CASE WHEN su > 0 AND egap > 0 AND greatest(0.0, egap - saved) > 0 THEN coalesce(mo, 0) + ceil(greatest(0.0, egap - saved) / su) WHEN k = 'save' AND egap > 0 THEN ceil(egap / su) END"


def _re(pattern: str) -> str:
    return "'" + pattern.replace("(?U)", "").replace("'", "''") + "'"


_KNOWN = """list_filter([income, savings, rent, food, debt, ex, su, 3 * ex, greatest(0.0, 3 * ex - savings), ex, init, keep, rem, hi, other, dp, sv, CASE WHEN k = 'invest' THEN su ELSE 0 END],
  lambda g, i: i <= 7 OR g != 0)"""
_GROUNDED = """(len(list_filter(known, lambda g: abs(a - g) <= 1 OR abs(12 * a - g) <= 1 OR abs(a - 12 * g) <= 1 OR (m BETWEEN 2 AND 24 AND abs(a - g * m) <= 1))) > 0
  OR len(list_filter(known, lambda g, i: len(list_filter(known[:i - 1], lambda h: abs(a - g - h) <= 1)) > 0)) > 0)"""
_UNSUPPORTED = f"""{_PLAN}, known AS (SELECT user_id, apr, {_KNOWN.replace("[income", "[income::DOUBLE")} AS doubled, [{_CHOSEN}] AS sentences FROM g),
once AS (SELECT *, list_filter(doubled, lambda g, i: list_position(doubled, g) = i) AS known FROM known),
each AS (SELECT user_id, apr, known, unnest(sentences) AS s, unnest(range(5))::INTEGER AS place FROM once),
found AS (SELECT *, list_transform(regexp_extract_all(s, {_re(C.DOLLAR)}, 1), lambda x: replace(x, ',', '')::DOUBLE) AS amounts, list_transform(regexp_extract_all(s, {_re(C.PERCENT)}, 1), lambda x: x::DOUBLE) AS percents,
  TRY_CAST(regexp_extract(s, {_re(C.MONTHS)}, 1) AS INTEGER) AS m FROM each),
loose AS (SELECT user_id, place, s, amounts, percents, apr, len(list_filter(amounts, lambda a: NOT {_GROUNDED})) > 0 AS loose FROM found),
flags AS (SELECT user_id, place, unnest([CASE WHEN loose AND regexp_matches(s, {_re(C.REQUIREMENT)}) THEN 'requirement' END,
  CASE WHEN len(amounts) > 0 AND regexp_matches(s, {_re(C.INSUFFICIENCY)}) AND regexp_matches(s, {_re(C.COST_CONTEXT)}) THEN 'insufficiency' END,
  CASE WHEN len(list_filter(percents, lambda p: abs(p - apr) > 0.01)) > 0 AND regexp_matches(s, {_re(C.RETURNS)}) THEN 'returns' END]) AS kind FROM loose)"""
_COMPUTED = _KNOWN.replace("[income, savings, rent, food, debt, ex, su, ", "[ex, su, ").replace("i <= 7", "i <= 2")
_LABELS = "[{'label': 'income', 'value': income}, {'label': 'surplus', 'value': su}, {'label': 'savings', 'value': savings}, {'label': 'expenses', 'value': ex}, {'label': 'rent', 'value': rent}, {'label': 'food', 'value': food}, {'label': 'credit card debt', 'value': debt}]"
_CATEGORY = f"""CASE WHEN list_contains(said, round(f.a, 2)) OR (f.pc AND round(f.a, 2) = apr) THEN 'USER_PROVIDED' WHEN NOT f.pc AND f.grounded THEN 'CALCULATED' WHEN f.pc AND round(f.a, 2) = 10 THEN 'ASSUMPTION'
  WHEN requirement THEN 'UNKNOWN' WHEN regexp_matches(lower(s), {_re(C.ASSUMPTION)}) THEN 'ASSUMPTION' WHEN regexp_matches(lower(s), {_re(C.ESTIMATE)}) THEN 'ESTIMATE' ELSE 'UNKNOWN' END"""
_QUOTED = "chr(39), s, chr(39)"
_JUDGED = f"""{_UNSUPPORTED}, facts AS (SELECT user_id, apr, [income, savings, rent, food, debt]::DOUBLE[] AS said, {_COMPUTED.replace("[ex", "[ex::DOUBLE")} AS twice, {_LABELS} AS labels, lower(text) AS context FROM g),
whole AS (SELECT user_id, place, s, amounts, percents, m, said, apr, labels, context, list_filter(twice, lambda g, i: list_position(twice, g) = i) AS known FROM (SELECT * EXCLUDE known FROM found) JOIN facts USING (user_id, apr)),
marked AS (SELECT w.*, coalesce(loose AND regexp_matches(w.s, {_re(C.REQUIREMENT)}), false) AS requirement,
  len(w.amounts) > 0 AND regexp_matches(w.s, {_re(C.INSUFFICIENCY)}) AND regexp_matches(w.s, {_re(C.COST_CONTEXT)}) AS insufficiency,
  (len(w.amounts) > 0 AND len(list_filter(labels, lambda x: contains(lower(w.s), x.label) AND list_min(list_transform(w.amounts, lambda a: abs(a - x.value))) > 1)) > 0)
    OR (len(w.percents) > 0 AND contains(lower(w.s), 'credit card debt') AND list_min(list_transform(w.percents, lambda a: abs(a - w.apr))) > 0.01) AS contradiction,
  regexp_extract_all(lower(w.s), {_re(C.DRIFT)}, 1) AS hits FROM whole w JOIN (SELECT user_id, place, loose FROM loose) l USING (user_id, place)),
figures AS (SELECT *, list_concat(list_transform(amounts, lambda a: {{'a': a, 'pc': false, 'grounded': {_GROUNDED}}}), list_transform(percents, lambda a: {{'a': a, 'pc': true, 'grounded': false}})) AS fs FROM marked),
one AS (SELECT * EXCLUDE (fs), unnest(fs) AS f, unnest(range(len(fs)))::INTEGER AS nth FROM figures),
judged AS (SELECT user_id, place, nth, s, f, {_CATEGORY} AS category FROM one),
drifts AS (SELECT *, len(fs) > 0 AND len(hits) > 0 AND len(list_filter(hits, lambda h: contains(context, h))) = 0 AS drift FROM figures),
issues AS (SELECT user_id, 0 AS kind, place, nth, concat('Presents ', CASE WHEN f.pc THEN concat(regexp_replace(f.a::VARCHAR, '\\.0$', ''), '%') ELSE {money_sql('f.a')} END, ' as a fact without support: ', {_QUOTED}) AS issue FROM judged WHERE category = 'UNKNOWN'
  UNION ALL SELECT user_id, 1, place, 0, concat('Unsupported financial claim: ', {_QUOTED}) FROM drifts WHERE insufficiency
  UNION ALL SELECT user_id, 2, place, 0, concat('Contradicts a figure the user already provided: ', {_QUOTED}) FROM drifts WHERE contradiction
  UNION ALL SELECT user_id, 3, place, 0, concat('Topic drift / numeric claim unrelated to current intent: ', {_QUOTED}) FROM drifts WHERE drift)"""
_LINES_OF = "list_transform(string_split(text, chr(10)), lambda x: trim(x))"
_CLEAN = "trim(@, ' .:-')"
_ITEM = f"regexp_extract(x, {_re(N.GOAL_ITEM)}, 1)"
_PRICED = f"(contains(x, '$') OR regexp_matches(x, {_re(PAIR)}))"
_GOAL = f"""CASE WHEN regexp_matches(x, {_re(N.GOAL_HEADER)}) THEN NULL WHEN heading > 0 AND i > heading THEN CASE WHEN {_ITEM} != '' AND NOT {_PRICED} THEN {_CLEAN.replace('@', _ITEM)} END
  WHEN {_PRICED} THEN NULL WHEN {_ITEM} != '' THEN CASE WHEN regexp_matches({_CLEAN.replace('@', _ITEM)}, {_re(N.GOAL_MARK)}) THEN {_CLEAN.replace('@', _ITEM)} END
  WHEN len(string_split(regexp_replace(x, '\\s+', ' ', 'g'), ' ')) >= 3 AND regexp_matches(x, {_re(N.GOAL_MARK)}) THEN {_CLEAN.replace('@', 'x')} END"""
_KEY = f"trim(regexp_replace(regexp_replace(trim(regexp_replace(lower(@), '{WS}+', ' ', 'g')), '(^|[^a-z0-9_])[0-9]{{1,2}} *$', '\\1'), '^[-*•·0-9.) ]+', ''), ' .:')"
_TITLE = f"regexp_matches(@, {_re(N.SECTION_TITLE)})"
ORACLES = {
    "extract_financials": f"{_B} SELECT user_id, income{_D} AS income, 2 AS n_expenses, (rent + food){_D} AS expenses, (income - rent - food){_D} AS surplus, savings{_D} AS savings, debt{_D} AS debt, apr{_D} AS apr, 'Credit card debt' AS debt_name FROM budgets",
    "aggregate_financials": f"{_B} SELECT user_id, (income + 100){_D} AS income, (rent + food + 45){_D} AS expenses, savings{_D} AS savings, 1 AS n_debts FROM budgets",
    "financial_plan": f"""{_PLAN} SELECT user_id, 3 * ex AS emergency_fund_target, greatest(0.0, 3 * ex - savings) AS emergency_fund_gap, ex AS near_term_buffer, init AS recommended_initial_payment, keep AS retained_buffer,
      rem AS remaining_high_interest_debt, dp AS recommended_monthly_debt_payment, sv AS recommended_monthly_savings, CASE WHEN k = 'invest' THEN su ELSE 0.0{_D} END AS recommended_monthly_investing,
      mo::INTEGER AS estimated_months_to_debt_free, ({_CASES})::INTEGER AS estimated_months_to_emergency_target FROM g""",
    "payoff": f"{_B} SELECT user_id, ({_MONTHS.format(b='debt', p='(food / 4.0::DOUBLE)', r='(apr / 1200.0::DOUBLE)')})::INTEGER AS months FROM budgets",
    "verified_blocks": f"{_B} SELECT user_id, {VERIFIED_SQL} AS block FROM budgets",
    "formatted_amounts": f"SELECT c_custkey, concat(CASE WHEN c_acctbal < 0 THEN '-' ELSE '' END, '$', regexp_replace(format('{{:,.2f}}', abs(c_acctbal)), '\\.00$', '')) AS amount FROM customer",
    "goals": f"""WITH messages AS (SELECT {GOAL_COLUMNS} FROM part), lines AS (SELECT msg_id, {_LINES_OF} AS xs FROM messages),
      headed AS (SELECT msg_id, xs, coalesce(list_position(list_transform(xs, lambda x: regexp_matches(x, {_re(N.GOAL_HEADER)})), true), 0) AS heading FROM lines),
      found AS (SELECT msg_id, list_filter(list_transform(xs, lambda x, i: {_GOAL}), lambda y: y IS NOT NULL AND y != '') AS ys FROM headed)
      SELECT msg_id, coalesce(array_to_string(list_filter(ys, lambda y, i: list_position(ys, y) = i), '; '), '') AS goals FROM found""",
    "follow_ups": f"""WITH opened AS (SELECT {OPENED_COLUMNS} FROM conversations),
      plain AS (SELECT conv_id, turn, trim(trim(regexp_replace(regexp_replace(lower(trim(text)), '[''’]', '', 'g'), '\\s+', ' ', 'g')), ' ?!,.;:') AS c FROM opened)
      SELECT conv_id, turn, c != '' AND (list_contains({quoted(C.FOLLOW_UPS)}, c) OR len(list_filter({quoted(C.FOLLOW_UP_STARTS)}, lambda p: starts_with(c, p))) > 0
        OR (len(string_split(c, ' ')) <= 2 AND list_contains(['why', 'how', 'what', 'explain'], string_split(c, ' ')[-1]))) AS follow_up FROM plain""",
    "claim_kinds": f"{_JUDGED} SELECT place, nth, category, count(*) AS n FROM judged GROUP BY ALL",
    "contradictions": f"{_JUDGED} SELECT place, count_if(contradiction) AS n_contradictions, count_if(drift) AS n_drifts FROM drifts GROUP BY place",
    "reply_verdicts": f"""{_JUDGED}, firsts AS (SELECT user_id, issue, min(kind * 10000 + place * 100 + nth) AS o FROM issues GROUP BY ALL), told AS (SELECT user_id, string_agg(issue, chr(10) ORDER BY o) AS issues FROM firsts GROUP BY user_id)
      SELECT user_id, told.issues IS NULL AS passed, coalesce(told.issues, '') AS issues FROM budgets LEFT JOIN told USING (user_id)""",
    "unsupported_claims": f"{_UNSUPPORTED} SELECT user_id, place, kind FROM flags WHERE kind IS NOT NULL",
    "refined_replies": f"""{_JUDGED.replace(f"[{_CHOSEN}]", "['You need $75,000 to start.']").replace("range(5)", "range(1)")}, bad AS (SELECT DISTINCT user_id FROM issues)
      SELECT x.user_id, CASE WHEN bad.user_id IS NULL THEN 1 ELSE (x.user_id % 4 + 1)::INTEGER % 4 END::INTEGER AS attempt FROM budgets x LEFT JOIN bad USING (user_id)""",
    "guarded_replies": f"""{_UNSUPPORTED}, bad AS (SELECT DISTINCT user_id FROM flags WHERE kind IS NOT NULL),
      all_ AS (SELECT x.user_id, x.savings, array_to_string([{_CHOSEN}], ' ') AS reply, bad.user_id IS NOT NULL AS is_clarification FROM budgets x LEFT JOIN bad USING (user_id))
      SELECT user_id, is_clarification, CASE WHEN NOT is_clarification THEN length(reply) ELSE
      length('I don''t have enough information to determine that reliably, and I won''t invent a financial figure to fill the gap.') + CASE WHEN savings = 0 THEN 0 ELSE length(concat(chr(10), chr(10), 'Using the ', {money_sql('savings')},
      ' figure you mentioned, I can help you explore options that realistically fit that amount - but I will only work from numbers you provided or that we can calculate from them.')) END
      + length(concat(chr(10), chr(10), 'If you share the specific details (for example, the costs involved, your available budget, or your income and expenses), I can reason from those exact numbers.')) END::INTEGER AS n_chars FROM all_""",
    "corrected_replies": f"""{_B}, r AS (SELECT user_id, list_transform([{_REPLY}], lambda x: rtrim(x)) AS xs, string_split({_MESSAGE}, chr(10)) AS said, CASE WHEN user_id % 4 != 0 THEN {VERIFIED_SQL} END AS block FROM budgets),
      a AS (SELECT user_id, block, list_filter(xs, lambda x: {_KEY.replace('@', 'x')} != '' AND NOT list_contains(list_filter(list_transform(said, lambda m: {_KEY.replace('@', 'm')}), lambda m: length(m) >= 4), {_KEY.replace('@', 'x')})) AS xs FROM r),
      b AS (SELECT user_id, block, list_filter(xs, lambda x, i: list_position(list_transform(xs, lambda y: {_KEY.replace('@', 'y')}), {_KEY.replace('@', 'x')}) = i) AS xs FROM a),
      c AS (SELECT user_id, block, list_filter(xs, lambda x: NOT ({' OR '.join(f'regexp_matches(x, {_re(p)})' for p in (*N.INVENTED, N.MATH_LINE, N.SUMMARY_LINE, N.HEADER_LINE))})) AS xs FROM b),
      d AS (SELECT user_id, block, list_filter(xs, lambda x, i: NOT {_TITLE.replace('@', 'x')} OR (i < len(xs) AND NOT {_TITLE.replace('@', 'xs[i + 1]')})) AS xs FROM c),
      e AS (SELECT user_id, block, array_to_string(list_transform(xs, lambda x, i: CASE WHEN {_TITLE.replace('@', 'x')}
        THEN concat(len(list_filter(xs[:i], lambda y: {_TITLE.replace('@', 'y')})), '. ', regexp_extract(x, {_re(N.SECTION_TITLE)}, 1)) ELSE x END), chr(10)) AS body FROM d)
      SELECT user_id, trim(CASE WHEN block IS NULL THEN coalesce(body, '') ELSE concat(block, chr(10), chr(10), body) END, ' ' || chr(10)) AS reply FROM e""",
    "budget_forms": f"""{_B}, f AS (SELECT *, user_id % {len(FORMS)} AS k FROM budgets), a AS (SELECT *, CASE k WHEN 2 THEN NULL WHEN 8 THEN income + 0.5{_D} ELSE greatest(income, CASE k WHEN 7 THEN 100 ELSE 0 END) END{_D} AS i,
        CASE k WHEN 2 THEN 0 WHEN 4 THEN food WHEN 7 THEN rent + food WHEN 8 THEN rent + 0.25{_D} ELSE rent END{_D} AS e, CASE WHEN k IN (0, 5, 8) THEN savings END{_D} AS s FROM f)
      SELECT user_id, i AS income, CASE k WHEN 2 THEN 0 WHEN 7 THEN 2 ELSE 1 END AS n_expenses, e AS expenses, CASE WHEN k != 2 THEN i - e END AS surplus, s AS savings, CASE k WHEN 3 THEN 2 ELSE 0 END AS n_debts,
        CASE k WHEN 3 THEN apr END{_D} AS apr, NULL{_D} AS second_apr, CASE k WHEN 3 THEN debt + savings ELSE 0 END{_D} AS owed, CASE k WHEN 6 THEN 50 ELSE 0 END{_D} AS contributions, CASE k WHEN 6 THEN 60 ELSE 0 END{_D} AS payments FROM a""",
}
