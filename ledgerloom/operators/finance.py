"""Financial facts from text, the plan they lead to, and replies held to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import (
    APR, DEBT_LABELS, HAVE_FUNDS, INCOME_LABELS, INCOME_PHRASE, INCOME_VERB, MONTHLY, PAIR, SAVING_LABELS,
    amount, around, dollars, label_key, monthly, payoff_months, short_number, spans, stands_for)
from ..functions.text import n_words, named_once, strip

# Assumptions of the plan.
HIGH_APR = 10.0
FUND_MONTHS = 3
BUFFER_MONTHS = 1
DEBT_SHARE = 0.7
# Goals.
GOAL_HEADER = r"(?U)(?i)^\s*(?:my\s+)?(?:goals?|what i want(?: to accomplish)?):?\s*$"
GOAL_ITEM = r"(?U)^\s*(?:\d+[.)]\s*|[-*•]\s*)(.+)$"
GOAL_MARK = (
    r"(?U)(?i)\b(pay off|pay down|build|invest(?:ing)?|save (?:up )?for|become|buy|retire|get out of debt|debt[- ]free|emergency fund|reduce debt|reach|"
    r"increase|create|set up|start)\b")

_DEBT = "struct<description:string,amount:double,apr:double>"


def _goals(text: Column) -> Column:
    """Items after a goals heading; else items and sentences that sound like goals."""
    def goal(line: Column, k: Column, heading: Column) -> Column:
        # What a line is decided by is computed once a line; most lines have no mark and no item.
        clean = lambda c: F.regexp_replace(c, r"^[ .:-]+|[ .:-]+$", "")
        priced = F.contains(line, F.lit("$")) | line.rlike(PAIR)

        def told(item: Column) -> Column:
            listed = F.when((item != "") & ~priced, clean(item))
            free = F.when((item == "") & ~line.rlike(GOAL_MARK), None).when(priced, None).when(item != "", named_once(clean(item), lambda c: F.when(c.rlike(GOAL_MARK), c))).when(
                n_words(line) >= 3, clean(line))
            return F.when((heading > 0) & (k >= heading), listed).otherwise(free)

        # A line with a price is no goal, whatever else it holds: most lines of a budget end here.
        return F.when(F.contains(line, F.lit("$")) | line.rlike(GOAL_HEADER), None).otherwise(named_once(F.regexp_extract(line, GOAL_ITEM, 1), told))

    def found(lines: Column) -> Column:
        heading = F.array_position(F.transform(lines, lambda x: x.rlike(GOAL_HEADER)), True)
        return named_once(heading, lambda h: F.array_distinct(F.filter(F.transform(lines, lambda x, k: goal(x, k, h)), lambda g: g != "")))

    return named_once(F.transform(F.split(text, r"\r\n|\n|\r"), strip), found)


def with_facts(messages: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``facts``: income, expenses, savings_balance, savings_contributions, debts,
    debt_payments and goals, as far as the text states them. A null text states nothing.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    found = F.transform(spans(t, PAIR, 2), lambda s: F.struct(
        s["groups"][0].alias("label"), amount(s["groups"][1]).alias("amount"), s["end"].alias("end"), around(t, s["start"], s["end"]).alias("near"), label_key(s["groups"][0]).alias("key")))
    out = messages.withColumn("__pairs", F.filter(found, lambda p: p["amount"].isNotNull()))
    kind = lambda p: F.when(stands_for(p["key"], INCOME_LABELS), "income").when(stands_for(p["key"], SAVING_LABELS), "saving").when(
        stands_for(p["key"], DEBT_LABELS), "debt").otherwise("expense")
    out = out.withColumn("__pairs", F.transform("__pairs", lambda p: p.withField("kind", kind(p)).withField("monthly", p["near"].rlike(MONTHLY))))
    pick = lambda test, value: F.transform(F.filter("__pairs", test), value)
    money = lambda p: F.round(p["amount"], 2)
    labelled = F.array_max(pick(lambda p: p["kind"] == "income", lambda p: F.round(monthly(t, p["end"], p["amount"]), 2)))
    prose = lambda pattern: F.transform(spans(t, pattern), lambda s: F.round(monthly(t, s["end"], amount(s["groups"][0])), 2))
    told = F.array_max(F.concat(prose(INCOME_PHRASE), prose(INCOME_VERB)))
    held = F.array_max(pick(lambda p: (p["kind"] == "saving") & ~p["monthly"], money))
    have = F.array_max(F.transform(spans(t, HAVE_FUNDS), lambda s: F.round(amount(s["groups"][0]), 2)))
    payment = lambda p: F.contains(p["key"], F.lit("payment")) | p["monthly"]
    rate = lambda p: F.when(p["near"].rlike(APR), F.regexp_extract(p["near"], APR, 1).cast("double"))
    expenses = F.filter("__pairs", lambda p: (p["kind"] == "expense") & (p["key"] != ""))

    def firsts(found: Column) -> Column:
        return named_once(F.transform(found, lambda p: p["key"]), lambda keys: F.filter(found, lambda p, k: F.array_position(keys, p["key"]) == k + 1))

    first = named_once(expenses, firsts)
    return out.withColumn("facts", F.struct(
        F.coalesce(labelled, told).alias("income"),
        F.transform(first, lambda p: F.struct(strip(p["label"]).alias("category"), money(p).alias("amount"))).alias("expenses"),
        F.coalesce(held, have).alias("savings_balance"),
        pick(lambda p: (p["kind"] == "saving") & p["monthly"], money).alias("savings_contributions"),
        pick(lambda p: (p["kind"] == "debt") & ~payment(p), lambda p: F.struct(strip(p["label"]).alias("description"), money(p).alias("amount"), rate(p).alias("apr"))).alias("debts"),
        pick(lambda p: (p["kind"] == "debt") & payment(p), money).alias("debt_payments"),
        _goals(t).alias("goals"))).drop("__pairs")


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def total_expenses(facts: str = "facts") -> Column:
    return F.round(total(F.transform(F.col(f"{facts}.expenses"), lambda e: e["amount"])), 2)


def complete(facts: str = "facts") -> Column:
    return F.col(f"{facts}.income").isNotNull() & (F.size(f"{facts}.expenses") > 0)


def surplus(facts: str = "facts") -> Column:
    return F.when(complete(facts), F.round(F.col(f"{facts}.income") - total_expenses(facts), 2))


def merge_facts(rows: DataFrame, key: str, order: str) -> DataFrame:
    """(key, facts): facts of several turns as one. The last stated income and savings count;
    expenses, debts and goals are those of any turn, the first of equals; payments and
    contributions add up in order.
    """
    f = lambda name: F.col(f"facts.{name}")
    packed = lambda name: F.flatten(F.transform(F.sort_array(F.collect_list(F.struct(order, f(name).alias("v")))), lambda s: s["v"]))
    last = lambda name: F.max_by(f(name), F.when(f(name).isNotNull(), F.col(order)))
    out = rows.groupBy(key).agg(
        last("income").alias("income"), last("savings_balance").alias("savings_balance"), packed("expenses").alias("expenses"), packed("debts").alias("debts"),
        packed("goals").alias("goals"), packed("savings_contributions").alias("savings_contributions"), packed("debt_payments").alias("debt_payments"))

    def first_of(name: str, key) -> Column:
        return named_once(F.transform(name, key), lambda keys: F.filter(name, lambda x, k: F.array_position(keys, F.get(keys, k)) == k + 1))

    expense = lambda x: F.lower(x["category"])
    debt = lambda x: F.struct(F.lower(x["description"]).alias("d"), F.round(x["amount"], 2).alias("a"))

    return out.select(key, F.struct(
        "income", first_of("expenses", expense).alias("expenses"), "savings_balance", "savings_contributions", first_of("debts", debt).alias("debts"),
        "debt_payments", F.array_distinct("goals").alias("goals")).alias("facts"))


def with_plan(rows: DataFrame) -> DataFrame:
    """Adds ``plan`` to rows with ``facts``: reserves, the debt to pay first, and a division of
    the monthly surplus among debt, savings and investing, with estimated months."""
    r2 = lambda c: F.round(c, 2)
    pos = lambda c: F.greatest(F.lit(0.0), c)
    c = F.col
    dear = F.filter("facts.debts", lambda d: F.coalesce(d["apr"] >= HIGH_APR, F.lit(False)))
    rest = F.filter("facts.debts", lambda d: ~F.coalesce(d["apr"] >= HIGH_APR, F.lit(False)))
    owed = lambda ds: r2(total(F.transform(ds, lambda d: d["amount"])))
    out = rows.withColumns({
        "__ok": complete(), "__exp": total_expenses(), "__sur": surplus(), "__sav": F.coalesce(c("facts.savings_balance"), F.lit(0.0)),
        "__dear": dear, "__hi": owed(dear), "__other": owed(rest)})
    out = out.withColumns({"__target": r2(c("__exp") * FUND_MONTHS), "__buffer": r2(c("__exp") * BUFFER_MONTHS)})
    lump = r2(c("__sav") - c("__buffer"))
    out = out.withColumn("__init", F.when((c("__sav") > c("__buffer")) & (c("__hi") > 0), r2(F.least(lump, c("__hi")))).otherwise(0.0))
    out = out.withColumns({"__keep": r2(c("__sav") - c("__init")), "__rem": r2(c("__hi") - c("__init"))})
    out = out.withColumns({"__bgap": r2(pos(c("__buffer") - c("__keep"))), "__egap": r2(pos(c("__target") - c("__keep"))), "__live": F.coalesce(c("__sur") > 0, F.lit(False))})
    case = F.when(~c("__live"), "none").when(c("__bgap") > 0, "buffer").when(c("__rem") > 0, "debt").when((c("__other") > 0) | (c("__egap") > 0), "save").otherwise("invest")
    out = out.withColumn("__case", case)
    save1 = r2(F.least(c("__sur"), c("__bgap")))
    debt = F.when(c("__case") == "buffer", F.when(c("__rem") > 0, r2(c("__sur") - save1)).otherwise(0.0)).when(c("__case") == "debt", r2(DEBT_SHARE * c("__sur"))).otherwise(0.0)
    out = out.withColumn("__debt", debt)
    save = F.when(c("__case") == "buffer", save1).when(c("__case") == "debt", r2(c("__sur") - c("__debt"))).when(c("__case") == "save", c("__sur")).otherwise(0.0)
    top = F.array_max(F.transform("__dear", lambda d: F.coalesce(d["apr"], F.lit(0.0))))
    out = out.withColumn("__save", save).withColumn("__months", F.when(c("__case") == "debt", payoff_months(c("__rem"), top, c("__debt"))))
    saved = F.when(c("__months").isNotNull(), r2(c("__months") * c("__save"))).otherwise(0.0)
    left = r2(pos(c("__egap") - saved))
    fund = F.when(c("__live") & (c("__egap") > 0) & (left > 0), F.coalesce("__months", F.lit(0)) + F.ceil(left / c("__sur"))).when(
        (c("__case") == "save") & (c("__egap") > 0), F.ceil(c("__egap") / c("__sur"))).cast("int")
    if_ok = lambda col, other: F.when(c("__ok"), col).otherwise(other)
    zero = F.lit(0.0)
    plan = F.struct(
        c("__ok").alias("has_budget"), if_ok(c("__target"), zero).alias("emergency_fund_target"), if_ok(r2(pos(c("__target") - c("__sav"))), zero).alias("emergency_fund_gap"),
        if_ok(c("__buffer"), zero).alias("near_term_buffer"), if_ok(c("__hi"), zero).alias("high_interest_total"), if_ok(c("__other"), zero).alias("other_debt_total"),
        if_ok(c("__init"), zero).alias("recommended_initial_payment"), if_ok(c("__keep"), zero).alias("retained_buffer"), if_ok(c("__rem"), zero).alias("remaining_high_interest_debt"),
        if_ok(c("__debt"), zero).alias("recommended_monthly_debt_payment"), if_ok(c("__save"), zero).alias("recommended_monthly_savings"),
        if_ok(F.when(c("__case") == "invest", c("__sur")).otherwise(0.0), zero).alias("recommended_monthly_investing"),
        if_ok(c("__months"), F.lit(None).cast("int")).alias("estimated_months_to_debt_free"), if_ok(fund, F.lit(None).cast("int")).alias("estimated_months_to_emergency_target"),
        F.when(c("__ok"), c("__dear")).otherwise(F.array().cast(f"array<{_DEBT}>")).alias("high_interest_debts"))
    return out.withColumn("plan", plan).select(*rows.columns, "plan")


def _lines(*parts: Column) -> Column:
    return F.array_join(F.array_compact(F.array(*parts)), "\n")


# The wording of the three texts below, which replies are compared with.


def verified_block() -> Column:
    """The figures of a complete budget as text, null without one."""
    debts = F.array_join(F.transform("facts.debts", lambda d: F.concat(
        F.lit("- "), d["description"], F.lit(": "), dollars(d["amount"]), F.coalesce(F.concat(F.lit(" at "), short_number(d["apr"]), F.lit("% APR")), F.lit("")))), "\n")
    line = lambda label, value: F.concat(F.lit(f"- {label}: "), dollars(value))
    some = lambda name: F.size(f"facts.{name}") > 0
    return F.when(complete(), _lines(
        F.lit("Verified monthly summary:"), line("Income", F.col("facts.income")), line("Total monthly expenses", total_expenses()),
        line("Savings", F.col("facts.savings_balance")), F.when(some("savings_contributions"), line("Monthly savings contributions", total(F.col("facts.savings_contributions")))),
        F.when(some("debts"), debts), F.when(some("debt_payments"), line("Monthly debt payments", total(F.col("facts.debt_payments")))), line("Monthly surplus", surplus())))


def plan_text() -> Column:
    """The plan as one line for each recommendation; empty without a budget."""
    p = lambda name: F.col(f"plan.{name}")
    d = lambda name: dollars(p(name))
    debt_list = lambda ds: F.array_join(F.transform(ds, lambda x: F.concat(
        x["description"], F.lit(" "), dollars(x["amount"]), F.coalesce(F.concat(F.lit(" ("), short_number(x["apr"]), F.lit("% APR)")), F.lit("")))), "; ")
    months = lambda n: F.coalesce(F.concat(F.lit("about "), n.cast("string")), F.lit("an unknown number of"))
    top = F.array_max(F.transform("plan.high_interest_debts", lambda x: F.coalesce(x["apr"], F.lit(0.0))))
    lines = _lines(
        F.when(F.col("facts.savings_balance").isNull(), "- Assumption: no savings balance was stated, so this plan assumes $0 saved while you build a first buffer."),
        F.concat(F.lit("- Assumption: emergency-fund target of "), d("emergency_fund_target"), F.lit(f" ({FUND_MONTHS} months of expenses). Adjust if the user states a different target.")),
        F.when(F.size("plan.high_interest_debts") > 0, F.concat(F.lit(f"- High-interest debt (APR >= {HIGH_APR:g}%): "), debt_list("plan.high_interest_debts"), F.lit("."))).when(
            F.size("facts.debts") > 0, F.concat(F.lit("- Debt: "), debt_list("facts.debts"), F.lit("."))),
        F.when(p("recommended_initial_payment") > 0, F.concat(
            F.lit("- Recommendation: pay "), d("recommended_initial_payment"), F.lit(" of the "), dollars(F.coalesce("facts.savings_balance", F.lit(0.0))),
            F.lit(" savings balance toward high-interest debt now, keeping "), d("retained_buffer"), F.lit(" in savings as a reserve (assumption: a minimum reserve of "),
            d("near_term_buffer"), F.lit(f", {BUFFER_MONTHS} month of expenses)."))),
        F.when(p("remaining_high_interest_debt") > 0, F.concat(
            F.lit("- Recommendation: from the "), F.coalesce(dollars(surplus()), F.lit("")), F.lit(" monthly surplus, pay "), d("recommended_monthly_debt_payment"),
            F.lit("/month toward the remaining high-interest debt"),
            F.when(p("recommended_monthly_savings") > 0, F.concat(F.lit(" and add "), d("recommended_monthly_savings"), F.lit("/month to savings"))).otherwise(F.lit("")),
            F.lit(". Estimated debt-free in "), months(p("estimated_months_to_debt_free")), F.lit(" month(s) accounting for "), short_number(top), F.lit("% APR."))).when(
            p("recommended_monthly_savings") > 0, F.concat(F.lit("- Recommendation: add all "), dollars(surplus()), F.lit(" of the monthly surplus to savings."))).when(
            p("recommended_monthly_investing") > 0, F.concat(
                F.lit("- Recommendation: with the emergency fund in place, direct the "), dollars(surplus()), F.lit(" monthly surplus toward investing."))),
        F.when(p("estimated_months_to_emergency_target").isNotNull(), F.concat(
            F.lit("- Estimated emergency fund reaches "), d("emergency_fund_target"), F.lit(" in "), months(p("estimated_months_to_emergency_target")),
            F.lit(" month(s) total, assuming the surplus stays constant."))).when(
            p("emergency_fund_gap") > 0, F.concat(F.lit("- Emergency-fund gap: "), d("emergency_fund_gap"), F.lit(" (target minus current savings)."))),
        F.lit("- Investing: discuss only after high-interest debt is paid and the emergency fund target is reached; acknowledge the exact order can depend on circumstances."))
    return F.when(p("has_budget"), lines).otherwise("")


def context_text() -> Column:
    """Facts, calculation and plan as text for a reply's author; null without a budget."""
    line = lambda label, value: F.concat(F.lit(f"- {label}: "), dollars(value))
    some = lambda name: F.size(f"facts.{name}") > 0
    facts = _lines(
        line("Monthly income", F.col("facts.income")),
        F.array_join(F.transform("facts.expenses", lambda e: F.concat(F.lit("- "), e["category"], F.lit(": "), dollars(e["amount"]), F.lit("/month"))), "\n"),
        line("Total monthly expenses", total_expenses()), line("Savings balance", F.col("facts.savings_balance")),
        F.when(some("savings_contributions"), line("Monthly savings contributions", total(F.col("facts.savings_contributions")))),
        F.when(some("debts"), F.array_join(F.transform("facts.debts", lambda d: F.concat(
            F.lit("- "), d["description"], F.lit(": "), dollars(d["amount"]), F.coalesce(F.concat(F.lit(" ("), short_number(d["apr"]), F.lit("% APR)")), F.lit("")))), "\n")),
        F.when(some("debt_payments"), line("Monthly debt payments", total(F.col("facts.debt_payments")))),
        F.when(some("goals"), F.concat(F.lit("- Goals: "), F.array_join("facts.goals", "; "))))
    sum_ = F.concat(F.lit("- Monthly surplus = monthly income - total monthly expenses = "), dollars(F.col("facts.income")), F.lit(" - "), dollars(total_expenses()), F.lit(" = "), dollars(surplus()))
    return F.when(complete(), F.concat(F.lit("Facts provided by the user:\n"), facts, F.lit("\n\nCalculations:\n"), sum_, F.lit("\n\nRecommended plan:\n"), plan_text()))


# Lines that a reply may not hold.
MATH_LINE = r"(?U)\$\s*[\d,]+(?:\.\d+)?\s*[-−–]\s*\$?\s*[\d,]+(?:\.\d+)?\s*=\s*[-−–]?\$?\s*[\d,]+(?:\.\d+)?"
SUMMARY_LINE = (
    r"(?U)(?i)^\s*(?:[-*•]\s*)?(?:income|(?:total\s+)?(?:monthly\s+)?(?:expense|expenses|expenditure|spending)|(?:monthly\s+)?surplus|left\s*over|leftover|remaining|balance|savings|"
    r"debt\s*payments?)\s*[:=]?\s*\$?\s*[-−–]?\s*[\d,]+")
HEADER_LINE = (
    r"(?U)(?i)^\s*(?:[-*•]\s*)?(?:monthly\s+)?(?:income|budget|expense(?:s)?)(?:\s+and\s+(?:expense(?:s)?|income))?(?:\s+(?:overview|summary|breakdown|details))?\b")
INVENTED = (
    r"(?U)(?i)\b(roommate|move (?:out|in|to|into)|relocate|downsize|change (?:your )?(?:job|career)|get a (?:better|new|second|part[- ]time) job|side hustle|"
    r"ask (?:for|your employer for) a raise|sell (?:your|the) (?:car|home|house))\b",
    r"(?U)(?i)\b(cut|reduce|lower|trim|slash|decrease|drop)\b[^.!?\n]{0,60}?\b\d{1,3}\s*%\b",
    r"(?U)(?i)\b(cut|reduce|reduction|reducing|cutting|lower|trim|decrease|drop)\b[^.!?\n]{0,40}?\b(rent|utilities|utility bills?|housing|groceries|grocery|food|entertainment|"
    r"transport(?:ation)?(?: costs?)?|commute|dining|eating out|subscriptions?|expenses?|spending)\b",
    r"(?U)(?i)\b(pay off (?:your |the )?(?:entire |all(?: of)? |whole |full )?|debt[- ]?free)[^.!?\n]{0,30}?\b(this month|next month|within a month|in (?:a )?single month|immediately|overnight)\b",
)
SECTION_TITLE = (
    r"(?U)(?i)^\s*(?:\d+[.)]\s*)?(financial situation|what i would prioritize|recommended monthly allocation|debt repayment strategy|emergency fund strategy|spending adjustments|"
    r"investing strategy|6[- ]?month action plan|why this plan makes sense)\s*:?\s*$")


def line_key(line: Column) -> Column:
    """What makes two lines the same: no case, bullets, trailing section number or end marks."""
    c = F.regexp_replace(F.lower(strip(line)), r"(?U)\s+", " ")
    c = F.regexp_replace(F.regexp_replace(c, r"(?U)\b\d{1,2}\s*$", ""), r"(?U)^[-*•·\d.)\s]+", "")
    return F.regexp_replace(c, r"^[ .:]+|[ .:]+$", "")


def corrected(reply: Column, message: Column, block: Column) -> Column:
    """The reply without echoes, repeats, invented changes and own sums, sections renumbered,
    after the verified block if there is one."""
    lines_of = lambda c: F.split(F.coalesce(c, F.lit("")), r"\r\n|\n|\r")
    bad = lambda x: F.coalesce(*[F.when(x.rlike(p), True) for p in (*INVENTED, MATH_LINE, SUMMARY_LINE, HEADER_LINE)], F.lit(False))
    keyed = F.transform(F.transform(lines_of(reply), lambda x: F.regexp_replace(x, r"(?U)\s+$", "")), lambda x: F.struct(x.alias("line"), line_key(x).alias("key")))

    # Each step binds what the next one names: a lambda would compute it anew for each of its lines.
    def unsaid(said: Column) -> Column:
        return F.filter(keyed, lambda x: (x["key"] != "") & ~F.array_contains(said, x["key"]))

    def once(rows: Column) -> Column:
        return named_once(F.transform(rows, lambda x: x["key"]), lambda keys: F.filter(rows, lambda x, k: F.array_position(keys, x["key"]) == k + 1))

    def titled(rows: Column) -> Column:
        kept = F.filter(rows, lambda x: ~bad(x["line"]))
        return F.transform(kept, lambda x: F.struct(x["line"].alias("line"), x["line"].rlike(SECTION_TITLE).alias("title")))

    def filled(rows: Column) -> Column:
        return F.filter(rows, lambda x, k: ~x["title"] | F.coalesce(~F.get(rows, k + 1)["title"], F.lit(False)))

    def numbered(rows: Column) -> Column:
        heads = F.filter(F.transform(rows, lambda x, k: F.when(x["title"], k)), lambda k: k.isNotNull())
        return named_once(heads, lambda h: F.transform(rows, lambda x, k: F.when(x["title"], F.concat(
            F.array_position(h, k).cast("string"), F.lit(". "), F.regexp_extract(x["line"], SECTION_TITLE, 1))).otherwise(x["line"])))

    lines = named_once(F.filter(F.transform(lines_of(message), line_key), lambda k: F.length(k) >= 4), unsaid)
    for step in (once, titled, filled, numbered):
        lines = named_once(lines, step)
    body = F.array_join(lines, "\n")
    return strip(F.when(block.isNull(), body).otherwise(F.concat(block, F.lit("\n\n"), body)))


__all__ = ["complete", "context_text", "corrected", "line_key", "merge_facts", "plan_text", "surplus", "total_expenses", "verified_block", "with_facts", "with_plan"]
